"""Cutting films into shots from frame features, and picking a frame for each shot.

samples: video_id, frame (0, 1, ... or sparser), and the features of functions.distances. Films are spread over tasks by key. Features are large (about 16 KB a sample), so
what needs several samples' features reads a film's rows once in order, and keeps a ring of them; only scores go further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmspark.functions.distances import TRANSITION, centred, centred_distance, transition_score

FEATURES = [*TRANSITION]
_HISTS = ["hist", "color_hist", "edge_hist"]


@dataclass(frozen=True)
class ShotParams:
    """Thresholds of the cut detector; the defaults are fixed values that results depend on."""

    min_shot_seconds: float = 1.0
    boundary_dedupe_seconds: float = 1.5
    shot_threshold: float = 0.075
    dynamic_threshold_scale: float = 2.4
    peak_margin: float = 0.01
    anchor_threshold: float = 0.50
    anchor_min_seconds: float = 8.0
    anchor_adjacent_floor: float = 0.004
    dissolve_threshold: float = 0.20
    dissolve_window_seconds: float = 1.5
    dissolve_min_gap_seconds: float = 4.0
    fade_black_ratio: float = 0.72
    fade_luma: float = 18.0


def _film() -> Window:
    return Window.partitionBy("video_id").orderBy("frame")


def _features() -> Column:
    # histograms are centred once for each sample, not once for each pair
    return F.struct(*[centred(F.col(c)).alias(c) if c in _HISTS else F.col(c) for c in FEATURES])


def _score(a: str, b: str, bits: int) -> Column:
    return transition_score(F.col(a), F.col(b), bits, centred_distance)


def fade_flags(samples: DataFrame, black_ratio: float = 0.72, luma: float = 18.0) -> DataFrame:
    """Adds is_fade (dark frame) and usable (a frame fit to stand for its shot)."""
    dark = (F.col("black_ratio") >= black_ratio) | (F.col("mean_luma") <= luma)
    return samples.withColumns({"is_fade": dark, "usable": (F.col("black_ratio") < 0.82) & F.col("mean_luma").between(14, 242)})


def adjacent_scores(samples: DataFrame, bits: int = 256) -> DataFrame:
    """Adds score: the transition score to the sample before; 0 for the first."""
    x = samples.withColumn("__f", _features()).withColumn("__g", F.lag("__f").over(_film()))
    return x.withColumn("score", F.when(F.col("__g").isNull(), 0.0).otherwise(_score("__g", "__f", bits))).drop("__f", "__g")


def _level(mid: Column, deviation: Column, floor: float, scale: float) -> Column:
    level = F.greatest(F.lit(floor), mid + scale * F.greatest(deviation * 1.4826, F.lit(0.001)))
    return F.coalesce(F.when(mid.isNotNull(), level), F.lit(floor))


def adaptive_threshold(scores: DataFrame, floor: float = 0.075, scale: float = 2.4) -> DataFrame:
    """video_id, threshold: median plus a multiple of the scaled median deviation of a film's positive scores, `floor` at least. Medians are exact."""
    s = scores.select("video_id", F.when(F.col("score") > 0, F.col("score")).alias("s"))
    mid = s.groupBy("video_id").agg(F.percentile("s", F.lit(0.5)).alias("m"))
    dev = s.join(mid, "video_id").groupBy("video_id").agg(F.first("m").alias("m"), F.percentile(F.abs(F.col("s") - F.col("m")), F.lit(0.5)).alias("d"))
    return dev.select("video_id", _level(F.col("m"), F.col("d"), floor, scale).alias("threshold"))


# ---- the ordered pass


_VECTORS = ["hist", "color_hist", "edge_hist", "gray_small", "dhash"]


def _in_order(samples: DataFrame, videos: DataFrame, *more: str) -> DataFrame:
    """Samples by film and frame, each film led by a row with its fps, which spares a join: the only exchange of features, and their only sort for each reading. Films stay whole because
    repartition() says so, which adaptive execution keeps."""
    head = videos.select("video_id", F.col("fps").cast("double").alias("fps"), F.lit(0).alias("kind"))
    both = head.unionByName(samples.select("video_id", "frame", *FEATURES, *more, F.lit(1).alias("kind")), allowMissingColumns=True)
    # the condition that a later join by film would add, so that both readings have one exchange
    return both.where("video_id is not null").repartition("video_id").sortWithinPartitions("video_id", "kind", "frame")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of one length, as an array."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centred_rows(features: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v - v.mean(1, keepdims=True) if k in _HISTS else v for k, v in features.items()}


def pair_scores(a: dict[str, np.ndarray], b: dict[str, np.ndarray], bits: int = 256, weights: dict[str, float] = TRANSITION) -> np.ndarray:
    """transition_score (or another sum of weights) of row i of a and row i of b, for all i. Histograms are centred already."""
    total = 0.0
    for name, weight in weights.items():
        x, y = a[name], b[name]
        if name in _HISTS:
            low = (x * x).sum(1) * (y * y).sum(1)
            part = np.clip(1 - np.where(low > 1e-12, (x * y).sum(1) / np.sqrt(np.where(low > 1e-12, low, 1)), 1.0), 0, 2)
            part = np.where(np.isnan(low), 1.0, part)
        elif name == "gray_small":
            part = np.abs(x.astype(np.int64) - y).sum(1) / x.shape[1] / 255
        elif name == "dhash":
            part = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(1) / bits
        else:
            part = np.abs(x - y) / (255 if name == "mean_luma" else 1)
        total = total + weight * part
    return total


class _Film:
    """One film as its samples come: the features of those that are still needed, and the scores so far, which are narrow."""

    def __init__(self, video_id: object, fps: float | None, window_seconds: float, bits: int) -> None:
        self.video_id, self.fps, self.bits = video_id, fps, bits
        self.reach = max(1, int(np.rint(window_seconds * fps))) if fps is not None else 1
        self.held: dict[str, np.ndarray] = {}
        self.base = 0  # place of the first sample held
        self.frames: list[int] = []
        self.scores: list[float] = []
        self.dissolves: list[float] = []

    def features(self, at: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v[at - self.base] for k, v in self.held.items()}

    def add(self, frames: list[int], features: dict[str, np.ndarray]) -> None:
        run = [*self.frames[-1:], *frames]
        if any(x > y for x, y in zip(run, run[1:], strict=False)):
            raise RuntimeError("a film's samples must come in the order of their frames")
        new = centred_rows(features)
        self.held = {k: np.concatenate([self.held[k], v]) if self.held else v for k, v in new.items()}
        here = np.arange(len(self.frames), len(self.frames) + len(frames))
        score = pair_scores(self.features(np.maximum(here - 1, 0)), self.features(here), self.bits)
        score[here == 0] = 0.0
        self.frames += frames
        self.scores += score.tolist()

    def dissolve(self, last: bool = False) -> None:
        """The wider scores of samples whose partners have come; of all that are left, clamped to the film's last sample, if it is over."""
        n = len(self.frames)
        at = np.arange(len(self.dissolves), n if last else n - self.reach)
        if len(at):
            score = pair_scores(self.features(np.maximum(at - self.reach, 0)), self.features(np.minimum(at + self.reach, n - 1)), self.bits)
            score[(at == 0) | (last & (at == n - 1))] = 0.0
            self.dissolves += score.tolist()

    def drop(self, before: int) -> None:
        """Forget the features of samples before this place, but for those that later scores need."""
        cut = max(0, min(before, len(self.frames) - 1) - self.base)
        self.held = {k: v[cut:] for k, v in self.held.items()}
        self.base += cut


def _films(batches: Iterator[pa.RecordBatch], window_seconds: float, bits: int, part: int = 256) -> Iterator[tuple[_Film, pa.RecordBatch | None]]:
    """(film, samples just added) as rows of _in_order come, and (film, None) when it is over. Films that no leading row names, or that have no fps, are passed over."""
    film = None
    for batch in batches:
        for k in range(0, batch.num_rows, part):
            b = batch.slice(k, part)
            names, kinds = b.column("video_id").to_pylist(), b.column("kind").to_pylist()
            cuts = [i for i in range(len(names)) if i == 0 or (names[i], kinds[i]) != (names[i - 1], kinds[i - 1])]
            for a, z in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if film is not None and film.video_id != names[a]:
                    yield film, None
                    film = None
                if kinds[a] == 0:
                    film = film or _Film(names[a], b.column("fps")[a].as_py(), window_seconds, bits)
                elif film is not None and film.fps is not None:
                    rows = b.slice(a, z - a)
                    film.add(rows.column("frame").to_pylist(), {c: matrix(rows.column(c)) for c in FEATURES})
                    yield film, rows
    if film is not None:
        yield film, None


def _median_level(scores: np.ndarray, floor: float, scale: float) -> float:
    """adaptive_threshold of one film's scores."""
    s = scores[scores > 0]
    if not len(s):
        return floor
    mid = np.median(s)
    return max(floor, float(mid + scale * max(1.4826 * np.median(np.abs(s - mid)), 0.001)))


def dissolve_scores(samples: DataFrame, videos: DataFrame, window_seconds: float = 1.5, bits: int = 256) -> DataFrame:
    """video_id, frame, dissolve: the transition score between the samples w before and w after, clamped to the film; 0 at either end. Samples of films that `videos` lacks are left out.

    w is a number of frames but counts samples, which differs where sampling is sparse. A film is read once in order; the features of its last 2 w samples are all that is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for film, rows in _films(batches, window_seconds, bits):
            film.dissolve(last=rows is None)
            if rows is not None:
                film.drop(len(film.dissolves) - film.reach)
            elif film.frames:
                yield pa.record_batch([pa.array([film.video_id] * len(film.frames)), pa.array(film.frames), pa.array(film.dissolves)], names=["video_id", "frame", "dissolve"])

    return _in_order(samples, videos).mapInArrow(run, f"video_id {dict(samples.dtypes)['video_id']}, frame {dict(samples.dtypes)['frame']}, dissolve double")


def local_peaks(scores: DataFrame) -> DataFrame:
    """Adds local_peak and peak_margin of score against both neighbours; a missing one counts as 0."""
    before, after = F.lag("score", 1, 0.0).over(_film()), F.lead("score", 1, 0.0).over(_film())
    x = scores.withColumns({"__b": before, "__a": after})
    return x.withColumns({"local_peak": F.col("score") >= F.greatest("__b", "__a"), "peak_margin": F.col("score") - F.greatest("__b", "__a")}).drop("__a", "__b")


def fade_spans(samples: DataFrame, black_ratio: float = 0.72, luma: float = 18.0) -> DataFrame:
    """video_id, start_frame, end_frame: runs of dark samples from the first dark one to the first light one after. A run at the film's start, or one that never ends, is none."""
    x = fade_flags(samples, black_ratio, luma).withColumn("__p", F.lag("is_fade").over(_film()))
    x = x.withColumn("__run", F.count_if(F.col("is_fade") & ~F.col("__p")).over(_film().rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.min(F.when(F.col("is_fade") & ~F.col("__p"), F.col("frame")))
    closed = F.min(F.when(~F.col("is_fade") & F.col("__p"), F.col("frame")))
    return x.where("__run > 0").groupBy("video_id", "__run").agg(opened.alias("start_frame"), closed.alias("end_frame")).where("end_frame is not null").drop("__run")


def refine_boundaries(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """spans: video_id, start_frame, end_frame. Adds boundary: the frame in (start, end] with the largest score, the first of equals."""
    inside = spans.join(scores.select("video_id", "frame", "score"), "video_id").where("frame > start_frame and frame <= end_frame")
    w = Window.partitionBy("video_id", "start_frame", "end_frame").orderBy(F.col("score").desc(), "frame")
    return inside.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("video_id", "start_frame", "end_frame", F.col("frame").alias("boundary"))


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    da, db = a - a.mean(), b - b.mean()
    low = float((da * da).sum() * (db * db).sum())
    if np.isnan(low):
        return 1.0
    return float(min(2.0, max(0.0, 1 - (float((da * db).sum()) / np.sqrt(low) if low > 1e-12 else 1.0))))


def frame_score(a: dict, b: dict, bits: int = 256) -> float:
    """transition_score of two samples."""
    differing = sum(int(x ^ y).bit_count() if x >= 0 and y >= 0 else ((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(a["dhash"].tolist(), b["dhash"].tolist(), strict=True))
    part = {
        "color_hist": _distance(a["color_hist"], b["color_hist"]), "hist": _distance(a["hist"], b["hist"]), "edge_hist": _distance(a["edge_hist"], b["edge_hist"]),
        "gray_small": float(np.abs(a["gray_small"].astype(np.int64) - b["gray_small"]).sum()) / len(a["gray_small"]) / 255, "dhash": differing / bits,
        "mean_luma": abs(a["mean_luma"] - b["mean_luma"]) / 255, "black_ratio": abs(a["black_ratio"] - b["black_ratio"]),
    }
    return sum(w * part[k] for k, w in TRANSITION.items())


class _Scan:
    """State of one film's scan: the last boundary, the features of its anchor sample, an open fade with its best frame, and the last few scores."""

    def __init__(self, film: _Film, threshold: float, params: ShotParams) -> None:
        self.film, self.threshold, self.p = film, threshold, params
        half = lambda s: int(np.rint(s * film.fps))
        self.least = max(1, half(params.min_shot_seconds))
        self.dedupe = max(1, half(params.boundary_dedupe_seconds))
        self.gap = max(self.least, half(params.dissolve_min_gap_seconds))
        self.anchor_gap = half(params.anchor_min_seconds)
        self.at, self.last, self.dark = 0, 0, None
        self.fades: list[bool] = []
        self.anchor: dict[str, np.ndarray] = {}

    def steps(self, stop: int) -> list[int]:
        """Boundaries of the samples up to place `stop`, whose scores and next scores are known."""
        out = []
        for i in range(self.at, stop):
            if i == 0:
                out.append(0)
                self.anchor = self.film.features(np.array([0]))
            elif (at := self._step(i)) is not None:
                out.append(at)
        self.at = max(self.at, stop)
        return out

    @staticmethod
    def _margin(scores: list[float], i: int) -> float:
        return scores[i] - max(scores[i - 1] if i else 0.0, scores[i + 1] if i + 1 < len(scores) else 0.0)

    def _found(self, at: int, i: int) -> int:
        self.last, self.anchor = at, self.film.features(np.array([i]))
        return at

    def _step(self, i: int) -> int | None:
        p, film = self.p, self.film
        frame, score, dissolve, dark, before = film.frames[i], film.scores[i], film.dissolves[i], self.fades[i], self.fades[i - 1]
        if self.dark is not None and (self.dark[1] is None or score > self.dark[1]):
            self.dark = (frame, score)
        if dark and not before and self.dark is None:
            # the span that is searched begins after this sample
            self.dark = (frame, None)
        if self.dark is not None and before and not dark:
            at, self.dark = self.dark[0], None
            return self._found(at, i) if at - self.last >= max(self.least, self.dedupe) else None
        if frame - self.last < self.least:
            return None
        margin = self._margin(film.scores, i)
        hard = (margin >= 0 and score >= self.threshold and margin >= p.peak_margin) or score >= self.threshold * 1.8
        cross = p.dissolve_threshold > 0 and dissolve >= p.dissolve_threshold and frame - self.last >= self.gap and self._margin(film.dissolves, i) >= 0
        gradual = not (hard or cross) and p.anchor_threshold > 0 and frame - self.last >= self.anchor_gap and score >= p.anchor_adjacent_floor
        if gradual:
            gradual = float(pair_scores(self.anchor, film.features(np.array([i])), film.bits)[0]) >= p.anchor_threshold
        if not (hard or cross or gradual):
            return None
        # of the last three samples, the one that changed most, the first of equals
        at = max(range(max(0, i - 2), i + 1), key=lambda k: (film.scores[k], -k)) if gradual else i
        if film.frames[at] - self.last >= max(self.least, 0 if hard else self.dedupe):
            self.dark = None
            return self._found(film.frames[at], i)
        return None


def detect_shots(samples: DataFrame, videos: DataFrame, params: ShotParams = ShotParams(), bits: int = 256) -> DataFrame:
    """video_id, boundary: first frames of shots, 0 included. Samples of films that `videos` lacks are left out.

    A cut is a local peak above the film's threshold with a margin, or 1.8 times it. A fade puts its boundary at its strongest change. A dissolve is a peak of the
    wider score. A gradual change is far from the sample at the last boundary. Boundaries keep a least distance.

    The features are exchanged once and read twice in order, without windows: once for the film's scores, whose median gives its threshold, and once for the scan,
    which meets that one number by a hash of films. Both keep a ring of samples and a film's scores, never its features.
    """
    kind = dict(samples.dtypes)["video_id"]
    x = _in_order(fade_flags(samples, params.fade_black_ratio, params.fade_luma), videos, "is_fade")

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for film, rows in _films(batches, params.dissolve_window_seconds, bits):
            if rows is not None:
                film.drop(len(film.frames))
            elif film.frames:
                yield pa.record_batch([pa.array([film.video_id]), pa.array([_median_level(np.array(film.scores), params.shot_threshold, params.dynamic_threshold_scale)])], names=["video_id", "threshold"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for film, rows in _films(batches, params.dissolve_window_seconds, bits):
            film.dissolve(last=rows is None)
            if rows is not None:
                if state is None or state.film is not film:
                    state = _Scan(film, rows.column("threshold")[0].as_py(), params)
                state.fades += rows.column("is_fade").to_pylist()
                # the next sample's scores decide on peaks
                found = state.steps(len(film.dissolves) - 1)
                film.drop(min(state.at, len(film.dissolves) - film.reach))
            else:
                found = state.steps(len(film.frames)) if film.frames else []
            if found:
                yield pa.record_batch([pa.array([film.video_id] * len(found)), pa.array(found, pa.int64())], names=["video_id", "boundary"])

    levels = x.mapInArrow(level, f"video_id {kind}, threshold double")
    read = x.join(levels.hint("shuffle_hash"), "video_id").sortWithinPartitions("video_id", "kind", "frame")
    return read.mapInArrow(scan, f"video_id {kind}, boundary long")


def shots_from_boundaries(boundaries: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id, shot_index, start_frame, end_frame: half-open shots; the last ends with the film."""
    w = Window.partitionBy("video_id").orderBy("boundary")
    x = boundaries.join(videos.select("video_id", "total_frames"), "video_id")
    return x.select("video_id", (F.row_number().over(w).cast("long") - 1).alias("shot_index"), F.col("boundary").alias("start_frame"), F.coalesce(F.lead("boundary").over(w), F.col("total_frames")).alias("end_frame"))


def assign_samples(samples: DataFrame, shots: DataFrame) -> DataFrame:
    """Adds shot_index, start_frame and end_frame to samples that lie in a shot. Starts are merged into the samples in order; samples and shots are never paired."""
    marks = shots.select("video_id", F.col("start_frame").alias("frame"), F.struct("shot_index", "start_frame", "end_frame").alias("__shot"), F.lit(0).alias("__kind"))
    rows = samples.select("video_id", "frame", F.struct(*samples.columns).alias("__row"), F.lit(1).alias("__kind"))
    w = Window.partitionBy("video_id").orderBy("frame", "__kind", "__shot.shot_index").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("__in", F.last("__shot", ignorenulls=True).over(w))
    return both.where("__kind = 1 and frame < __in.end_frame").select("__row.*", "__in.shot_index", "__in.start_frame", "__in.end_frame")


def representative_frames(samples: DataFrame, shots: DataFrame) -> DataFrame:
    """video_id, shot_index, frame, mean_luma: the sharp, well exposed, central sample that stands for each shot; usable ones first, the earliest of equals. A shot without samples gives its middle frame and luma 128."""
    x = fade_flags(assign_samples(samples, shots))
    shot = Window.partitionBy("video_id", "shot_index")
    x = x.withColumn("__any", F.max("usable").over(shot)).where("usable or not __any")
    sharp = F.max("sharpness").over(shot)
    x = x.withColumn("__s", F.col("sharpness") / F.when(sharp != 0, sharp).otherwise(1.0))
    middle = (F.col("start_frame") + F.col("end_frame")) / 2
    merit = F.col("__s") - 1.8 * F.col("black_ratio") - 0.35 * F.abs(F.col("mean_luma") - 92) / 255 - 0.65 * F.abs(F.col("frame") - middle) / F.greatest(F.lit(1).cast("long"), F.col("end_frame") - F.col("start_frame"))
    x = x.withColumn("__r", F.row_number().over(shot.orderBy(merit.desc(), "frame"))).where("__r = 1").select("video_id", "shot_index", "frame", "mean_luma")
    full = shots.join(x, ["video_id", "shot_index"], "left")
    half = F.floor((F.col("start_frame") + F.col("end_frame")) / 2).cast("long")
    return full.select("video_id", "shot_index", F.coalesce("frame", half).alias("frame"), F.coalesce("mean_luma", F.lit(128.0)).alias("mean_luma"))


def shot_summary(rows: DataFrame) -> DataFrame:
    """rows: video_id, reused_color_from. Counts of a film's shots, and of those with a new and with a reused target."""
    reused = F.count_if(F.col("reused_color_from").isNotNull())
    return rows.groupBy("video_id").agg(F.count("*").alias("n_shots"), reused.alias("n_reused"), (F.count("*") - reused).alias("n_new"))


def limit_per_video(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of each film in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("video_id").orderBy(*order))).where(F.col("__r") <= n).drop("__r")
