"""Tables of frames that are laid out once, so that layers of one film meet without moving a pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What layers are joined by, and therefore dealt and sorted by.
KEYS = ("video_id", "frame")


def write_frames(frames: DataFrame, name: str, buckets: int = 256, path: str | None = None) -> None:
    """Store frames (video_id, frame, width, height, channels, pixels) as table `name`, bucketed and sorted by film and frame; an existing table of that name is replaced. path: a folder for its files, else the warehouse.

    Frames are dealt here, once, when they enter. Layers with one number of buckets then join as they lie. Buckets are by frame and not by film, so one long
    film fills all of them evenly; a bucket is one file in the order of films and frames, so a clip is found by the statistics of its row groups.
    """
    out = frames.repartition(buckets, *KEYS).write.mode("overwrite").format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS)
    if path:
        out = out.option("path", path)
    out.saveAsTable(name)


def read_frames(spark: SparkSession, name: str) -> DataFrame:
    """A table of write_frames. Projections and filters keep its layout, so operators.frames joins it without an exchange. With spark.sql.legacy.bucketedTableScan.outputOrdering
    its order counts too, and joins don't sort it again."""
    return spark.table(name)
