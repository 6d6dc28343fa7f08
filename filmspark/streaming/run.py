"""Running a stream over what there is now, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmspark.sources.shared import shared_dir


def run_now(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run `stream` until its present input is used up. Complete mode keeps the last result, append mode all rows, update mode the last row of each of `keys`. Results go to files in the shared folder, never
    through the driver. But for complete mode a batch has a folder of its own by its number, so a batch that runs again replaces its rows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/" + ("batch=0" if mode == "complete" else f"batch={number}"))

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{base}/rows").select(stream.columns)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("__last"))
    return last.select("__last.*")
