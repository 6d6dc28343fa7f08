"""Frame tables: features of pixels, and blends of layers.

frames: video_id, frame, width, height, channels, pixels (row-major bytes). Most of these are narrow maps over small Arrow batches: pixels enter a task and features
or new pixels leave it. Layers that are tables of their own are joined by film and frame; stored by sources.layers, they meet without an exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmspark.functions import pixels as X

_FRAME = "video_id long, frame long"
_IMAGE = f"{_FRAME}, width int, height int, channels int, pixels binary"


def image(r) -> np.ndarray:
    return np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels)


def _rgb(r) -> np.ndarray:
    a = image(r)
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]


def _map(frames: DataFrame, schema: str, make: Callable) -> DataFrame:
    """`make` gives a tuple for each frame; frames without pixels are left out."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 64):
                yield pd.DataFrame([make(r) for r in pdf.iloc[k : k + 64].itertuples(index=False)], columns=names)

    return frames.where("pixels is not null").mapInPandas(run, schema)


def frame_features(frames: DataFrame, width: int = 160, height: int = 90) -> DataFrame:
    """video_id, frame, mean_luma, black_ratio (share under 12), sharpness (Laplacian variance of the full gray frame), and the reduced gray frame."""

    def make(r):
        g = X.gray(_rgb(r))
        small = X.resize_area(g, width, height)
        return r.video_id, r.frame, float(small.mean()), float((small < 12).mean()), X.laplacian_variance(g), small.tobytes()

    return _map(frames, f"{_FRAME}, mean_luma double, black_ratio double, sharpness double, gray_small binary", make)


def frame_histograms(frames: DataFrame, width: int = 160, height: int = 90) -> DataFrame:
    """video_id, frame, hist (32 gray bins) and color_hist (24 hues by 16 saturations), both of unit length, of the reduced frame."""

    def make(r):
        rgb = _rgb(r)
        return r.video_id, r.frame, X.gray_hist(X.resize_area(X.gray(rgb), width, height)), X.color_hist(X.resize_area(rgb, width, height))

    return _map(frames, f"{_FRAME}, hist array<float>, color_hist array<float>", make)


def edge_histogram(frames: DataFrame, width: int = 160, height: int = 90) -> DataFrame:
    """video_id, frame, edge_hist: 16 bins of the edge map of the reduced gray frame; an edge map is black and white, so only the first and last are used."""
    return _map(frames, f"{_FRAME}, edge_hist array<float>", lambda r: (r.video_id, r.frame, X.edge_hist(X.resize_area(X.gray(_rgb(r)), width, height))))


def frame_dhash(frames: DataFrame, width: int = 160, height: int = 90) -> DataFrame:
    """video_id, frame, dhash: 256 neighbour comparisons in four longs."""
    return _map(frames, f"{_FRAME}, dhash array<long>", lambda r: (r.video_id, r.frame, X.dhash(X.resize_area(X.gray(_rgb(r)), width, height))))


def monochrome(frames: DataFrame, videos: DataFrame, threshold: float = 2.5) -> DataFrame:
    """video_id, is_monochrome: the mean difference of the channels over a film's preview frames is under `threshold`; true without frames."""

    def make(r):
        a = _rgb(r).astype(np.int64)
        d = [np.abs(a[..., i] - a[..., j]).mean() for i, j in ((0, 1), (0, 2), (1, 2))]
        return r.video_id, r.frame, float(sum(d) / 3)

    means = _map(frames, f"{_FRAME}, d double", make).groupBy("video_id").agg(F.avg("d").alias("d"))
    return videos.select("video_id").join(means, "video_id", "left").select("video_id", (F.coalesce("d", F.lit(0.0)) < threshold).alias("is_monochrome"))


def letterbox_crop(frames: DataFrame, threshold: int = 18, min_fraction: float = 0.035) -> DataFrame:
    """video_id, frame, crop_left, crop_right, crop_top, crop_bottom."""
    return _map(frames, f"{_FRAME}, crop_left int, crop_right int, crop_top int, crop_bottom int", lambda r: (r.video_id, r.frame, *X.letterbox(X.gray(_rgb(r)), threshold, min_fraction)))


def black_mask_stats(frames: DataFrame, threshold: int = 4) -> DataFrame:
    """video_id, frame, n_black, share_black: pixels with no channel above `threshold`."""

    def make(r):
        m = (image(r) <= threshold).all(-1)
        return r.video_id, r.frame, int(m.sum()), float(m.mean())

    return _map(frames, f"{_FRAME}, n_black long, share_black double", make)


def _mapped(frames: DataFrame, table: np.ndarray) -> DataFrame:
    """Frames with their samples looked up in `table`; other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("pixels")
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                done = [None if x is None else table[np.frombuffer(x, np.uint8)].tobytes() for x in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(done, part.schema.field(at).type))

    return frames.where("pixels is not null").mapInArrow(run, frames.schema)


def black_lift(frames: DataFrame, lift: float = 0.018, gamma: float = 1.06) -> DataFrame:
    """Frames with their samples lifted off black, by a table of 256 values."""
    return _mapped(frames, X.lift_table(lift, gamma))


def black_restore(frames: DataFrame, lift: float = 0.018, gamma: float = 1.06) -> DataFrame:
    return _mapped(frames, X.restore_table(lift, gamma))


def resize_frames(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: video_id, frame, width, height. Frames scaled to the size that is wanted of them, and never cut; those without one, or that have it already, stay as they are."""
    want = sizes.select("video_id", "frame", F.col("width").alias("__w"), F.col("height").alias("__h"))
    x = frames.join(want.hint("merge"), ["video_id", "frame"], "left").where("pixels is not null")
    differs = (F.col("__w") != F.col("width")) | (F.col("__h") != F.col("height"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                part = pdf.iloc[k : k + 16]
                done = [(r.video_id, r.frame, r.to_w, r.to_h, r.channels, X.resize_lanczos(image(r), int(r.to_w), int(r.to_h)).tobytes() if r.scale else bytes(r.pixels)) for r in part.itertuples(index=False)]
                yield pd.DataFrame(done, columns=["video_id", "frame", "width", "height", "channels", "pixels"])

    x = x.select("video_id", "frame", "width", "height", "channels", "pixels", F.coalesce("__w", "width").cast("int").alias("to_w"), F.coalesce("__h", "height").cast("int").alias("to_h"), F.coalesce(differs, F.lit(False)).alias("scale"))
    return x.mapInPandas(run, _IMAGE)


def tone_level(level: Column, lift: float = 0.018, gamma: float = 1.06) -> tuple[Column, Column]:
    """The lifted and the restored value of a sample, as expressions: what the tables hold."""
    v, lift, gamma = level / 255.0, min(0.25, max(0.0, lift)), max(0.1, gamma)
    up = F.rint(255 * (lift + (1 - lift) * F.pow(v, F.lit(1 / gamma))))
    down = F.when(v < lift, 0.0).otherwise(F.rint(255 * F.pow((v - lift) / (1 - lift), F.lit(gamma))))
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)).cast("long") for c in (up, down))


def feather_alpha(x: Column, width: Column, pixels: int = 80) -> Column:
    """Opacity (0 to 255) of column x of a layer: a ramp at either side."""
    f = max(1, pixels)
    return F.when(x < f, 255 * x / f).when(x > width - f, 255 * (width - x) / f).otherwise(255.0)


def pad_canvas(frames: DataFrame, width: int, height: int) -> DataFrame:
    return _map(frames, _IMAGE, lambda r: (r.video_id, r.frame, width, height, r.channels, X.pad_canvas(image(r), width, height).tobytes()))


def _layer(df: DataFrame, tag: str) -> DataFrame:
    # by merging, as images are no table to broadcast
    return df.select("video_id", "frame", F.struct("width", "height", "channels", "pixels").alias(tag)).hint("merge")


def _of(s: dict | None) -> np.ndarray | None:
    """The image of a layer's struct; None for a missing one, whose fields may come as nulls."""
    if s is None or s["pixels"] is None:
        return None
    a = np.frombuffer(s["pixels"], np.uint8).reshape(int(s["height"]), int(s["width"]), int(s["channels"]))
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a


def composite(plate: DataFrame, source: DataFrame, color: DataFrame | None = None, feather: int = 80, saturation: float = 0.82, temperature: float = -0.015, opacity: float = 1.0) -> DataFrame:
    """One frame from the frames of two or three layers with the same video_id and frame; see functions.pixels.composite. Frames without a source are the plate's.
    Layers that sources.layers has stored in one number of buckets are joined as they lie."""
    x = _layer(plate, "p").join(_layer(source, "s"), ["video_id", "frame"], "left")
    x = x.join(_layer(color, "c"), ["video_id", "frame"], "left") if color is not None else x.withColumn("c", F.lit(None).cast(x.schema["p"].dataType))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p, s, c = _of(r.p), _of(r.s), _of(r.c)
                done = p if s is None else X.composite(p, s, c, feather, saturation, temperature, opacity)
                out.append((r.video_id, r.frame, done.shape[1], done.shape[0], 3, done.tobytes()))
            yield pd.DataFrame(out, columns=["video_id", "frame", "width", "height", "channels", "pixels"])

    return x.mapInPandas(run, _IMAGE)


def guide_composite(guides: DataFrame, canvas: DataFrame) -> DataFrame:
    """A guide image laid under each canvas frame; see functions.pixels.guide_composite. Layers that sources.layers has stored in one number of buckets are joined as they lie."""
    x = _layer(guides, "g").join(_layer(canvas, "c"), ["video_id", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                done = X.guide_composite(_of(r.g), _of(r.c))
                out.append((r.video_id, r.frame, done.shape[1], done.shape[0], 3, done.tobytes()))
            yield pd.DataFrame(out, columns=["video_id", "frame", "width", "height", "channels", "pixels"])

    return x.mapInPandas(run, _IMAGE)
