"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
BLOCK_BYTES = 4 << 20
#: Spark's own setting by which an execution frees its shuffle files at its end.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a temporary one of this machine in local mode (tests), and an error on a cluster, whose executors wouldn't see it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, which cuts its lineage. row_group: bytes of a row group, for tables of large rows, which are read a group at a time.

    The table survives the loss of any executor, and what reads it later starts from files instead of running `df` again. It stays until the folder is cleared, as the result may be read at any time.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if row_group:
        out = out.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", 4).option("parquet.page.size.row.check.min", 4)
    # what was shuffled for this table isn't needed once it is written, and with long chains of tables would pile up until the driver collects its garbage
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, "false")
    conf.set(_FREE_SHUFFLES, "true")
    try:
        out.parquet(path)
    finally:
        conf.set(_FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, total_bytes: int, target_bytes: int) -> int:
    """As many partitions as keep each near `target_bytes`, and at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total_bytes / target_bytes))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column (null: empty): one uint8 array, and the offsets of the rows in it."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with at most about `most` bytes in `column`; a longer row is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def least_of(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(value))
