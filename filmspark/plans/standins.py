"""The driver's test tables in the shapes that the operators expect. Each stand-in is a DataFrame function and a SQL text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filmspark.functions.scalar import format_timecode, padded


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def videos(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    fps = F.when(F.col("o_orderstatus") == "F", 24.0).when(F.col("o_orderstatus") == "O", 25.0).otherwise(F.lit(30000.0) / 1001)
    return o.select(F.col("o_orderkey").alias("video_id"), fps.alias("fps"), (1 + F.floor("o_totalprice") % 20000).cast("long").alias("total_frames"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Short films, for queries with a row for each frame."""
    return videos(spark, d).withColumn("total_frames", 1 + F.col("total_frames") % 200)


#: Rows of a table in one task, so that a task's sorts stay as large at any size.
TASK_ROWS = 300_000


def dealt(rows: DataFrame, n_rows: int, key: str) -> DataFrame:
    """Rows dealt by key to tasks of about TASK_ROWS rows. Partitions that Spark chooses are merged up to some size in bytes, and their number is fixed from above."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)), key)


_FULL = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def manifest(spark: SparkSession, d: str) -> DataFrame:
    # named before the windows, as a name given after them hides the layout from later windows and joins, which would deal the rows again
    w = Window.partitionBy("video_id").orderBy(*_FULL)
    rows = table(spark, d, "lineitem")
    # the count comes from the file's footers
    return dealt(rows.select(F.col("l_orderkey").alias("video_id"), *_FULL), rows.count(), "video_id").select(
        "video_id",
        (F.row_number().over(w).cast("long") - 1).alias("shot_index"),
        (F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("l_discount")).alias("end_seconds"),
        F.when(F.col("l_returnflag") != "N", "true").otherwise("false").alias("fade_to_next"),
        (F.col("l_discount") * 10).alias("crossfade_seconds"),
        F.when(F.col("l_tax") == 0.08, "off").otherwise("true").alias("enabled"),
        "l_quantity", "l_returnflag", "l_linestatus", "l_partkey",
    )


def edited_manifest(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The manifest as its file holds it: text columns. more: further columns of the manifest."""
    m = manifest(spark, d)
    name = F.concat(F.lit("refs/cut_"), padded("shot_index", 4), F.lit("_"), F.translate(format_timecode(F.col("end_seconds") - 0.5), ":", "."), F.lit(".png"))
    return m.select(
        "video_id", "shot_index", "enabled", format_timecode("end_seconds").alias("end"), F.when(F.col("l_partkey") % 3 != 0, name).otherwise("").alias("source_reference"),
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("color/"), F.col("l_partkey").cast("string"), F.lit(".png"))).otherwise("").alias("color_reference"),
        "fade_to_next", F.when(F.col("fade_to_next") == "true", F.format_string("%.1f", "crossfade_seconds")).otherwise("").alias("crossfade_seconds"),
        *more,
    )


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Scalar features of frames: one film for each user of `events`."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    black = F.when(F.col("event_type") == "error", 0.9).otherwise((F.col("event_id") % 50) / 100.0)
    e = table(spark, d, "events").withColumn("frame", F.row_number().over(w).cast("long") - 1)
    return e.select(F.col("user_id").alias("video_id"), "frame", F.least(F.lit(255.0), F.col("value") * 2).alias("mean_luma"), black.alias("black_ratio"), F.col("value").alias("sharpness"))


def vector_samples(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 gray images with their features: one film for each label of `embeddings`. Columns as the distance functions want them."""
    w = Window.partitionBy("label").orderBy("vec_id")
    px = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 0.6) * 212))).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("video_id"), (F.row_number().over(w).cast("long") - 1).alias("frame"), px.alias("px"))
    return with_features(e)


def with_features(e: DataFrame) -> DataFrame:
    """Features of small gray images `px` (array of int): 8-bin histograms, row sums as an edge histogram, neighbour bits as a hash."""
    mean = F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("px")

    def bins(width: int):
        # a filter's function may take an index as its second argument, so the bin is bound outside
        def within(i: int):
            return lambda x: F.floor(x / width) == i

        return F.array(*[F.size(F.filter("px", within(i))).cast("double") for i in range(8)])

    rows = F.array(*[F.aggregate(F.slice("px", 8 * i + 1, 8), F.lit(0).cast("long"), lambda a, x: a + x).cast("double") for i in range(8)])
    # bit i: the next value of the image is larger
    bits = F.expr("aggregate(sequence(0, 62), 0L, (a, i) -> a + if(px[i + 1] > px[i], shiftleft(1L, i), 0L))")
    return e.withColumns({
        "mean_luma": mean, "black_ratio": F.size(F.filter("px", lambda x: x < 60)) / F.size("px"), "sharpness": F.array_max("px").cast("double") - F.array_min("px"),
        "hist": bins(32), "color_hist": bins(29), "edge_hist": rows, "dhash": F.array(bits), "gray_small": F.col("px"),
    })


def files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select(F.regexp_replace("url", r"^[a-z]+://", "").alias("path"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("size"), F.col("page_id").alias("mtime"), F.col("html").alias("content"), "page_id")


#: The same rows in SQL.
SQL = {
    "videos": """SELECT o_orderkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 24.0::DOUBLE WHEN 'O' THEN 25.0::DOUBLE ELSE 30000.0::DOUBLE/1001 END AS fps,
  1 + CAST(floor(o_totalprice) AS BIGINT) % 20000 AS total_frames FROM orders""",
    "clips": """SELECT o_orderkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 24.0::DOUBLE WHEN 'O' THEN 25.0::DOUBLE ELSE 30000.0::DOUBLE/1001 END AS fps,
  1 + (1 + CAST(floor(o_totalprice) AS BIGINT) % 20000) % 200 AS total_frames FROM orders""",
    "manifest": f"""SELECT l_orderkey AS video_id, row_number() OVER w - 1 AS shot_index,
  sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + l_discount AS end_seconds,
  CASE WHEN l_returnflag <> 'N' THEN 'true' ELSE 'false' END AS fade_to_next, l_discount * 10 AS crossfade_seconds,
  CASE WHEN l_tax = 0.08 THEN 'off' ELSE 'true' END AS enabled, l_quantity, l_returnflag, l_linestatus, l_partkey
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(_FULL)})""",
    "edited": """SELECT video_id, shot_index, enabled, printf('%02d:%02d:%06.3f', CAST(floor(end_seconds/3600) AS BIGINT), CAST(floor(end_seconds%3600/60) AS BIGINT), end_seconds%60) AS "end", end_seconds,
  CASE WHEN l_partkey % 3 <> 0 THEN printf('refs/cut_%04d_%02d.%02d.%06.3f.png', shot_index, CAST(floor((end_seconds-0.5)/3600) AS BIGINT), CAST(floor((end_seconds-0.5)%3600/60) AS BIGINT), (end_seconds-0.5)%60) ELSE '' END AS source_reference,
  CASE WHEN l_partkey % 5 = 0 THEN 'color/' || l_partkey || '.png' ELSE '' END AS color_reference, fade_to_next,
  CASE WHEN fade_to_next = 'true' THEN printf('%.1f', crossfade_seconds) ELSE '' END AS crossfade_seconds FROM manifest""",
    "samples": """SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, least(255.0, value*2) AS mean_luma,
  CASE WHEN event_type = 'error' THEN 0.9 ELSE (event_id % 50)/100.0 END::DOUBLE AS black_ratio, value AS sharpness FROM events""",
    "px": """SELECT vec_id, label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
  list_transform(embedding, lambda x: CAST(floor(least(255.0, greatest(0.0, (x::DOUBLE + 0.6)*212))) AS INTEGER)) AS px FROM embeddings""",
    "vectors": """SELECT *, list_sum(px)::DOUBLE / len(px) AS mean_luma, len(list_filter(px, lambda x: x < 60))::DOUBLE / len(px) AS black_ratio, (list_max(px) - list_min(px))::DOUBLE AS sharpness,
  list_transform(range(8), lambda i: len(list_filter(px, lambda x: x // 32 = i))::DOUBLE) AS hist, list_transform(range(8), lambda i: len(list_filter(px, lambda x: x // 29 = i))::DOUBLE) AS color_hist,
  list_transform(range(8), lambda i: list_sum(px[i*8+1:i*8+8])::DOUBLE) AS edge_hist, list_transform(range(1, 64), lambda i: (px[i+1] > px[i])::INTEGER) AS bits FROM px""",
    "files": "SELECT regexp_replace(url, '^[a-z]+://', '') AS path, octet_length(encode(html))::BIGINT AS size, page_id AS mtime, html AS content, page_id FROM pages",
}


def sql(ctes: str | list[str], body: str, **more: str) -> str:
    """A statement over stand-ins (names, in order of need) and further common tables."""
    names = ctes.split() if isinstance(ctes, str) else ctes
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({t})" for n, t in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body
