"""Which outputs can be reused, and which must be made again, from fingerprints and recorded signatures of whole collections."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmspark.sources.shared import shared_dir


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks, so that documents compare without regard to key order; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def signature_match(expected: DataFrame, stored: DataFrame, files: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """expected, stored: path, signature (JSON); files: path. path, matches: the output and its stored signature exist and say the same. Hashes of the canonical texts travel, not the texts.
    on: the columns that tell outputs apart, in all three, where a path alone doesn't; they are given back."""
    digest = F.sha2(canonical_json(F.col("signature")), 256)
    a = expected.select(*on, digest.alias("__a"))
    b = stored.groupBy(*on).agg(F.max(digest).alias("__b"))
    f = files.select(*on).distinct().withColumn("__f", F.lit(True))
    x = a.join(b, list(on), "left").join(f, list(on), "left")
    return x.select(*on, F.coalesce(F.col("__f") & (F.col("__a") == F.col("__b")), F.lit(False)).alias("matches"))


def media_match(outputs: DataFrame, expected: DataFrame, seconds: float = 1.5, frames: int = 3) -> DataFrame:
    """outputs: path, kind (`image`, `segment` or other), width, height, duration, frames, fps. path, matches: sizes are equal; for films also the duration within `seconds` and frames within
    the larger of `frames` and those of that time; for segments only frames within `frames`. A null expectation is met by anything."""
    e = expected.select("path", *[F.col(c).alias(f"__{c}") for c in ("width", "height", "duration", "frames", "fps")])
    x = outputs.join(e, "path", "left")
    same = lambda c: F.col(f"__{c}").isNull() | F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    near = lambda c, most: F.col(f"__{c}").isNull() | F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= most, F.lit(False))
    film = near("duration", F.lit(seconds)) & near("frames", F.greatest(F.lit(frames).cast("double"), F.ceil(F.coalesce(F.col("__fps"), F.lit(0.0)) * seconds).cast("double")))
    rest = F.when(F.col("kind") == "image", F.lit(True)).when(F.col("kind") == "segment", near("frames", F.lit(frames))).otherwise(film)
    return x.select("path", (same("width") & same("height") & rest).alias("matches"))


def resume_worklist(expected: DataFrame, reusable: DataFrame, force: bool = False, on: Sequence[str] = ("path",)) -> DataFrame:
    """Expected outputs to make: those that aren't reusable (path, or the columns `on`, and matches), or all."""
    return expected if force else expected.join(reusable.where("matches").select(*on).distinct(), list(on), "left_anti")


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table of the shared folder that is bucketed by `key`: joins by it need no exchange of it. The catalogue has it only while it is opened."""
    spark, name = df.sparkSession, f"stale_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    out = spark.table(name)
    # its files are outside the warehouse, and stay
    spark.sql(f"DROP TABLE {name}")
    return out


def stale_outputs(outputs: DataFrame, inputs: DataFrame, stages: int) -> DataFrame:
    """outputs: path, stage (1 to stages), matches; inputs: path, input_path. path, stage, stale, own_fault: an output is stale if its own signature differs or an output that it was made
    from, of an earlier stage, is stale.

    Outputs and inputs are dealt by path and by input once, and each stage is written once. Only paths move after that: those that a stage's stale outputs were used for go to where those outputs
    lie. So a stage costs one exchange of marks, however many stages were before it, and nothing is computed twice.
    """
    buckets = int(outputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = outputs.where(F.col("stage").between(1, stages)).select("path", "stage", (~F.col("matches")).alias("own_fault"))
    own = _dealt(own.repartition(buckets, "path"), "path", buckets)
    used = _dealt(inputs.select("path", "input_path").repartition(buckets, "input_path"), "input_path", buckets)
    done, marks = [], None
    for k in range(1, stages + 1):
        now = own.where(F.col("stage") == k)
        if marks is None:
            now = now.withColumn("stale", F.col("own_fault"))
        else:
            now = now.join(marks.hint("merge"), "path", "left").withColumn("stale", F.coalesce(F.col("own_fault"), F.lit(False)) | F.col("__s").isNotNull())
        now = _dealt(now.select("path", "stage", "stale", "own_fault"), "path", buckets)
        done.append(now)
        if k < stages:
            stale = now.where("stale").select(F.col("path").alias("input_path"))
            hit = used.join(stale.hint("merge"), "input_path", "left_semi").select("path")
            hit = hit if marks is None else hit.union(marks.select("path"))
            marks = _dealt(hit.groupBy("path").agg(F.lit(True).alias("__s")), "path", buckets)
    return functools.reduce(DataFrame.union, done)


def row_references(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows: color_reference, reference, source_reference. Adds path and error: the first one given; if that file is missing, the source; `empty` or `missing` if none will do."""
    full = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    have = files.select("path").distinct()
    x = rows.withColumn("__p", F.coalesce(full("color_reference"), full("reference"), full("source_reference"))).withColumn("__s", full("source_reference"))
    x = x.join(have.select(F.col("path").alias("__p"), F.lit(True).alias("__ok")), "__p", "left").join(have.select(F.col("path").alias("__s"), F.lit(True).alias("__sok")), "__s", "left")
    path = F.when(F.col("__ok"), F.col("__p")).when(F.col("__sok"), F.col("__s"))
    error = F.when(F.col("__p").isNull(), "empty").when(path.isNull(), "missing")
    return x.withColumns({"path": path, "error": error}).drop("__p", "__s", "__ok", "__sok")


def overlay_settings(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """stage, key, value of each: later layers win; stages that the defaults don't know are dropped, unknown keys of known ones kept."""
    stages = defaults.select("stage").distinct()
    out = defaults.select("stage", "key", "value")
    for layer in layers:
        new = layer.join(stages, "stage", "left_semi").select("stage", "key", F.col("value").alias("__v"), F.lit(True).alias("__set"))
        out = out.join(new, ["stage", "key"], "full_outer").select("stage", "key", F.when(F.col("__set"), F.col("__v")).otherwise(F.col("value")).alias("value"))
    return out


def resize_plan(images: DataFrame, sources: DataFrame) -> DataFrame:
    """images: path, source, width, height; sources: source, width, height. path, width, height, resize: an image gets its source's size, by scaling and never by a crop, if it differs."""
    s = sources.select("source", F.col("width").alias("__w"), F.col("height").alias("__h"))
    x = images.join(s, "source", "left")
    differs = (F.col("width") != F.col("__w")) | (F.col("height") != F.col("__h"))
    return x.select("path", F.coalesce("__w", "width").alias("width"), F.coalesce("__h", "height").alias("height"), F.coalesce(differs, F.lit(False)).alias("resize"))
