"""What files there are: totals, listings, newest files and readiness. files: path, size, mtime. Category and stage tables are parameters of a few rows, given as Python lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of files in progress, and characters that file names can't have on some systems, with their look-alikes.
PARTIAL = [".partial", ".tmp"]
ILLEGAL = '<>:"|?*｜\xa6'


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/\\]*)$", 1)


def folder(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"^(.*)[/\\][^/\\]*$", 1)


def suffix(path: Column | str) -> Column:
    """The last suffix in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def listable(path: Column | str) -> Column:
    name = file_name(path)
    return (name != ".gitkeep") & ~F.lower(F.substring(name, -8, 8)).endswith(PARTIAL[0]) & ~name.endswith(PARTIAL[1])


def _inside(path: Column, place: str) -> Column:
    return F.lit(True) if place == "" else path.startswith(place.rstrip("/") + "/")


def path_category(files: DataFrame, categories: Iterable[tuple[str, str]]) -> DataFrame:
    """categories: (key, folder) in order. Adds category: that of the first folder which holds the path, null for none."""
    out = None
    for key, place in categories:
        out = F.when(_inside(F.col("path"), place), key) if out is None else out.when(_inside(F.col("path"), place), key)
    return files.withColumn("category", F.lit(None).cast("string") if out is None else out)


def cache_rollup(files: DataFrame, categories: Iterable[tuple[str, str]]) -> DataFrame:
    """category, n_files, n_bytes of each category, with zeros for empty ones, and of all (category null). A file counts in every category whose folder holds it."""
    spark = files.sparkSession
    categories = list(categories)
    held = F.array_compact(F.array(*[F.when(_inside(F.col("path"), p), F.lit(i)) for i, (_, p) in enumerate(categories)]))
    rows = files.where(listable("path")).select(F.explode(F.array_distinct(held)).alias("i"), "size")
    named = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(categories)], "i int, category string")
    # a table of one row for each category: sums are made before it is joined
    sums = rows.groupBy("i").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    each = named.join(sums, "i", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("b", F.lit(0)).cast("long").alias("b"))
    return each.rollup("category").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"))


def stage_files(files: DataFrame, folders: list[str], suffixes: list[str], prefix: str = "") -> DataFrame:
    """Listable files of a stage: in its folders, with one of its suffixes, and, given a prefix, with a stem equal to it or starting with it and an underscore; sorted by lowered path."""
    inside = F.lit(False)
    for p in folders:
        inside = inside | _inside(F.col("path"), p)
    stem = F.regexp_replace(file_name("path"), r"(?<=.)\.[^.]+$", "")
    named = F.lit(True) if not prefix else (stem == prefix) | stem.startswith(prefix + "_")
    return files.where(inside & suffix("path").isin(suffixes) & named & listable("path")).orderBy(F.lower("path"), "path")


def newest_files(files: DataFrame, by: Column, suffixes: list[str]) -> DataFrame:
    """group, path, mtime: the newest file of each group with one of the suffixes; the greatest path of equals."""
    x = files.where(suffix("path").isin(suffixes)).withColumn("group", by)
    return x.groupBy("group").agg(F.max(F.struct("mtime", "path")).alias("m")).select("group", "m.path", "m.mtime")


def stage_readiness(expected: DataFrame, files: DataFrame) -> DataFrame:
    """expected: project, stage, path (null for a stage without outputs). project, stage, ready, n_existing, latest: ready if outputs are expected and all exist; latest by mtime, then path."""
    f = files.groupBy("path").agg(F.max("mtime").alias("mtime"))
    x = expected.join(f, "path", "left")
    have = F.col("mtime").isNotNull()
    g = x.groupBy("project", "stage").agg(F.count("path").alias("__n"), F.count_if(have).alias("n_existing"), F.max(F.when(have, F.struct("mtime", "path"))).alias("__m"))
    return g.select("project", "stage", ((F.col("__n") > 0) & (F.col("__n") == F.col("n_existing"))).alias("ready"), "n_existing", F.col("__m.path").alias("latest"))


def expected_vs_existing(expected: list[DataFrame], files: DataFrame) -> DataFrame:
    """path, state of the union of expected outputs and of the files: `made`, `to make` or `unexpected`."""
    want = expected[0].select("path")
    for e in expected[1:]:
        want = want.unionByName(e.select("path"))
    x = want.distinct().withColumn("__w", F.lit(True)).join(files.select("path").distinct().withColumn("__h", F.lit(True)), "path", "full_outer")
    return x.select("path", F.when(F.col("__w") & F.col("__h"), "made").when(F.col("__w"), "to make").otherwise("unexpected").alias("state"))


def delete_candidates(files: DataFrame, place: str, stem_prefix: str = "") -> DataFrame:
    """n_files, n_bytes of the listable files in a folder, given a prefix only of those whose names start with it. A report: nothing is deleted."""
    x = files.where(listable("path") & _inside(F.col("path"), place) & file_name("path").startswith(stem_prefix))
    return x.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))


def orphan_references(files: DataFrame, expected: DataFrame, prefix: str = "cut_", ending: str = ".png") -> DataFrame:
    """Files named like references, in folders that expected ones lie in, which aren't expected."""
    touched = expected.select(folder("path").alias("__d")).distinct()
    named = files.where(file_name("path").startswith(prefix) & file_name("path").endswith(ending)).withColumn("__d", folder("path"))
    return named.join(touched, "__d", "left_semi").join(expected.select("path").distinct(), "path", "left_anti").drop("__d")


def missing_sources(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows: project, shot_index, path. project, n_missing, first_missing: how many rows' files are missing, and the first three in row order, joined by commas."""
    gone = rows.join(files.select("path").distinct(), "path", "left_anti")
    r = F.row_number().over(Window.partitionBy("project").orderBy("shot_index", "path"))
    x = gone.withColumn("__r", r)
    firsts = F.sort_array(F.collect_list(F.when(F.col("__r") <= 3, F.struct("__r", "path"))))
    return x.groupBy("project").agg(F.count("*").alias("n_missing"), F.array_join(F.transform(firsts, lambda s: s["path"]), ",").alias("first_missing"))


def comparable_name(name: Column) -> Column:
    """A file name without characters that some systems forbid, in lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(name, ILLEGAL, "")), r"\s+", " "))


def resolve_sources(typed: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """typed: typed. typed, path: the file itself if it exists; else, for a name with a forbidden character and one of the suffixes, the only file of its folder with that suffix and a comparable
    name; else what was typed."""
    have = files.select("path").distinct()
    exact = have.select(F.col("path").alias("typed"), F.lit(True).alias("__ok"))
    t = typed.select("typed").distinct().join(exact, "typed", "left")
    key = lambda c: [folder(c).alias("__d"), suffix(c).alias("__x"), comparable_name(file_name(c)).alias("__n")]
    loose = t.where(F.col("__ok").isNull() & suffix("typed").isin(suffixes) & file_name("typed").rlike(r'[<>:"|?*]')).select("typed", *key("typed"))
    by = have.select("path", *key("path")).groupBy("__d", "__x", "__n").agg(F.count("*").alias("__c"), F.min("path").alias("__p")).where("__c = 1")
    found = loose.join(by, ["__d", "__x", "__n"]).select("typed", F.col("__p").alias("path"))
    return typed.join(found, "typed", "left").select("typed", F.coalesce("path", "typed").alias("path"))
