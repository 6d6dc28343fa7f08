"""Guide frames of chunks, kept as JSON lists in chunk manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GUIDE = "array<struct<frame_idx:long,strength:double,image:string>>"
#: What a guide without a readable strength has, at the start and elsewhere.
START_STRENGTH, END_STRENGTH = 0.7, 1.0


def guide_frames(chunks: DataFrame, migrate_on_bad_json: bool = False) -> DataFrame:
    """chunks: video_id, chunk_index, guide_frames (JSON), guide_image, guide_strength, guide_end_image, guide_end_strength. One row for each guide: place, frame_idx, strength, image.

    Without JSON the older columns give a guide for the first frame (0) and one for the last (-1). Bad JSON gives no guides, or the older columns' if
    `migrate_on_bad_json`.
    """
    raw = F.trim(F.coalesce("guide_frames", F.lit("")))
    parsed = F.from_json(raw, GUIDE)
    strength = lambda c, default: F.round(F.coalesce(F.when(F.trim(c) != "", F.trim(c).try_cast("double")), F.lit(default)), 3)
    old = lambda c, idx, s: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(idx).cast("long").alias("frame_idx"), s.alias("strength"), F.col(c).alias("image")))
    legacy = F.filter(F.array(old("guide_image", 0, strength("guide_strength", START_STRENGTH)), old("guide_end_image", -1, strength("guide_end_strength", END_STRENGTH))), lambda g: g.isNotNull())
    good = raw.rlike(r"^\[[\s\S]*\]$") & parsed.isNotNull()
    otherwise = legacy if migrate_on_bad_json else F.array().cast(GUIDE)
    g = F.when(raw == "", legacy).when(good, parsed).otherwise(otherwise)
    x = chunks.select("video_id", "chunk_index", F.posexplode(g).alias("place", "g"))
    return x.select("video_id", "chunk_index", F.col("place").cast("long").alias("place"), F.coalesce("g.frame_idx", F.lit(0).cast("long")).alias("frame_idx"), F.col("g.strength").alias("strength"), F.col("g.image").alias("image"))


def guide_split(guides: DataFrame, files: DataFrame) -> DataFrame:
    """Guides whose image exists, with kind: `start` for the first at frame 0 of a chunk, else `extra`; a missing strength becomes the kind's default."""
    usable = guides.where(F.coalesce("image", F.lit("")) != "").join(files.select(F.col("path").alias("image")).distinct(), "image", "left_semi")
    w = Window.partitionBy("video_id", "chunk_index").orderBy(F.col("frame_idx") != 0, "place")
    start = (F.row_number().over(w) == 1) & (F.col("frame_idx") == 0)
    x = usable.withColumn("kind", F.when(start, "start").otherwise("extra"))
    return x.withColumn("strength", F.coalesce("strength", F.when(F.col("kind") == "start", START_STRENGTH).otherwise(END_STRENGTH)))


def guide_seconds(start: Column, end: Column, frames: Column, frame_idx: Column, fps: Column) -> Column:
    """Seconds of a guide frame: negative indices count from the chunk's end; held within it."""
    rate = F.greatest(F.lit(1.0), fps)
    actual = F.when(frame_idx < 0, F.greatest(F.lit(0).cast("long"), frames + frame_idx)).otherwise(frame_idx)
    return F.greatest(start, F.least(end - 1 / rate, start + actual / rate))


def guide_duplicates(guides: DataFrame, multiple: int = 8) -> DataFrame:
    """video_id, chunk_index, position, n: positions that several guides of a chunk share once non-negative ones are floored to `multiple`."""
    at = F.when(F.col("frame_idx") < 0, F.col("frame_idx")).otherwise(F.floor(F.col("frame_idx") / multiple) * multiple)
    return guides.groupBy("video_id", "chunk_index", at.cast("long").alias("position")).agg(F.count("*").alias("n")).where("n > 1")
