"""Shot and chunk manifests: small CSV files, one for each film, with a comment line and headers that differ between versions."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filmspark.functions.scalar import format_time, is_enabled
from filmspark.sources.named import write_named

# Columns of the two kinds of file.
SHOT_COLUMNS = ["enabled", "end", "source_reference", "color_reference", "prompt", "fade_to_next", "crossfade_seconds"]
CHUNK_COLUMNS = [
    "chunk_index", "start_frame", "end_frame", "start_seconds", "end_seconds", "custom_seconds", "seed", "prompt_suffix", "negative_suffix", "guide_image", "guide_strength", "guide_end_image",
    "guide_end_strength", "guide_frames", "anchor_image", "anchor_position", "anchor_seconds", "prepared_path", "raw_path",
]
_SOURCE = "# source_video="


def parse_manifest(text: str) -> tuple[str | None, list[dict[str, str | None]]]:
    """The source named in the comment lines, and the rows by header name. A byte order mark is dropped."""
    lines = text.removeprefix("﻿").splitlines(keepends=True)
    source, k = None, 0
    while k < len(lines) and lines[k].startswith("#"):
        if lines[k].startswith(_SOURCE):
            source = lines[k][len(_SOURCE) :].strip()
        k += 1
    return source, [{key: v for key, v in r.items() if key is not None} for r in csv.DictReader(io.StringIO("".join(lines[k:]), newline=""))]


def manifest_rows(texts: DataFrame, columns: list[str]) -> DataFrame:
    """texts: path, text of whole files. path, source_video, row_index (file order), header (comma separated), extra (columns that aren't known, by name) and the columns as text, null where a file has no such column."""
    schema = "path string, source_video string, row_index long, header string, extra map<string,string>, " + ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf.path, pdf.text, strict=True):
                source, rows = parse_manifest(text or "")
                out += [(path, source, i, ",".join(r), {k: v for k, v in r.items() if k not in columns}, *(r.get(c) for c in columns)) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "source_video", "row_index", "header", "extra", *columns])

    return texts.select("path", "text").mapInPandas(run, schema)


def _whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_shot_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return manifest_rows(_whole(spark, paths), SHOT_COLUMNS).drop("header")


def enabled_rows(manifest: DataFrame) -> DataFrame:
    return manifest.where(is_enabled("enabled"))


def chunk_rows(texts: DataFrame) -> DataFrame:
    """Rows of chunk manifests: those whose chunk_index isn't a number are skipped, and of rows with one index the last wins. Files without a guide_image column give their anchor_image instead."""
    x = manifest_rows(texts, CHUNK_COLUMNS).where(F.col("chunk_index").rlike("^[0-9]+$"))
    old = ~F.array_contains(F.split("header", ","), "guide_image")
    x = x.withColumn("guide_image", F.when(old, F.col("anchor_image")).otherwise(F.col("guide_image"))).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    w = Window.partitionBy("path", "chunk_index").orderBy(F.col("row_index").desc())
    return x.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "header", "extra", "source_video", "row_index")


def read_chunk_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return chunk_rows(_whole(spark, paths))


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _by_shot(a: Column, b: Column) -> Column:
    x, y = (F.struct(s["shot_index"], s["line"]) for s in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def manifest_texts(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """rows: video_id, shot_index, end_seconds and the text columns; videos: video_id, source, duration. video_id, text: each film's whole file, ends clamped to the film's duration.

    A column `extra` (map of text), as the reader gives it, adds the columns that a film's rows name there, in the order in which they come: those of the file first, new ones after them.
    """
    x = rows.join(videos.select("video_id", "source", "duration"), "video_id").withColumn("end", format_time(F.least("end_seconds", "duration")))
    line = F.concat_ws(",", *[_quoted(F.coalesce(F.col(c), F.lit(""))) for c in SHOT_COLUMNS])
    extra = F.coalesce("extra", F.create_map().cast("map<string,string>")) if "extra" in rows.columns else F.create_map().cast("map<string,string>")
    g = x.groupBy("video_id").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("shot_index", line.alias("line"), extra.alias("extra"))), _by_shot).alias("l"))
    g = g.withColumn("more", F.array_distinct(F.flatten(F.transform("l", lambda s: F.map_keys(s["extra"])))))
    rest = lambda s: F.array_join(F.transform("more", lambda k: F.concat(F.lit(","), _quoted(F.coalesce(F.try_element_at(s["extra"], k), F.lit(""))))), "")
    body = F.array_join(F.transform("l", lambda s: F.concat(s["line"], rest(s))), "\n")
    head = F.array_join(F.concat(F.array(*[F.lit(c) for c in SHOT_COLUMNS]), F.transform("more", _quoted)), ",")
    return g.select("video_id", F.concat(F.lit(_SOURCE), "source", F.lit("\n"), head, F.lit("\n"), body, F.lit("\n")).alias("text"))


def write_shot_manifests(rows: DataFrame, videos: DataFrame, path: str) -> None:
    """One folder for each film, with its manifest as the only text file in it."""
    manifest_texts(rows, videos).repartition("video_id").write.partitionBy("video_id").text(path)


def _named(texts: DataFrame, names: DataFrame) -> DataFrame:
    return texts.join(names.select("video_id", F.col("manifest").alias("path")), "video_id").select("path", "text")


def write_shot_manifest_files(rows: DataFrame, videos: DataFrame, root: str) -> None:
    """One file for each film, exactly at `videos.manifest` (a path relative to `root`), replaced as a whole; see manifest_texts. Films without a manifest path get no file."""
    write_named(_named(manifest_texts(rows, videos), videos), root)


def write_chunk_manifest_files(rows: DataFrame, videos: DataFrame, root: str) -> None:
    """As write_shot_manifest_files, for chunk manifests; see chunk_manifest_texts."""
    write_named(_named(chunk_manifest_texts(rows), videos), root)


def chunk_manifest_texts(rows: DataFrame) -> DataFrame:
    """rows: video_id, chunk_index and any of the chunk columns. video_id, text: each film's whole file with all chunk columns, blank where there is no value; other columns are left out."""
    cell = lambda c: _quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rows.columns else F.lit("")
    line = F.concat_ws(",", *[cell(c) for c in CHUNK_COLUMNS])
    g = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_index").cast("long").alias("chunk_index"), line.alias("line")))).alias("l"))
    lines = F.transform("l", lambda s: F.concat(s["line"], F.lit("\r\n")))
    return g.select("video_id", F.concat(F.lit(",".join(CHUNK_COLUMNS) + "\r\n"), F.array_join(lines, "")).alias("text"))


def write_chunk_manifests(rows: DataFrame, path: str) -> None:
    """One folder for each film, with its chunk manifest as the only text file in it. Films whose file says the same already are left as they are; other films' folders aren't touched."""
    spark = rows.sparkSession
    texts = chunk_manifest_texts(rows)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        # the line end that the text sink adds after a file's last line isn't part of the manifest
        old = _whole(spark, f"{path}/video_id=*").select(F.regexp_extract("path", "video_id=([^/]+)/", 1).alias("__v"), F.sha2(F.regexp_replace("text", r"\n\z", ""), 256).alias("__h"))
        here = texts.withColumns({"__v": F.col("video_id").cast("string"), "__h": F.sha2("text", 256)})
        texts = here.join(old, ["__v", "__h"], "left_anti").select("video_id", "text")
    # dynamic mode replaces only the folders of the films at hand, when all of them are written
    texts.repartition("video_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").text(path)
