"""How far runs have come, from their log lines. lines: run_id, line_no, line. All results are aggregates that merge in any order, so hot runs combine before they are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmspark.functions.scalar import nearest


def log_tail(lines: DataFrame, n: int = 300) -> DataFrame:
    """The last n lines of each run."""
    w = Window.partitionBy("run_id").orderBy(F.col("line_no").desc())
    return lines.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def starts_with_any(line: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [line.startswith(p) for p in prefixes])


def int_after(line: Column, marker: str) -> Column:
    """The whole number that is the first word after a marker; 0 where that word is something else, null without marker or word."""
    word = F.regexp_extract(F.substring_index(line, marker, -1), r"^\s*(\S+)", 1)
    first = F.regexp_replace(word, r"^[:,]+|[:,]+$", "")
    return F.when(line.contains(marker) & (word != ""), F.coalesce(F.when(first.rlike(r"^[+-]?[0-9]+$"), first.try_cast("long")), F.lit(0).cast("long")))


def log_counters(lines: DataFrame, prefixes: list[str], marker: str) -> DataFrame:
    """run_id, n_matching (lines that start with one of the prefixes), first_number (after the first marker with a word; 0 for none)."""
    first = F.min_by(int_after(F.col("line"), marker), F.when(int_after(F.col("line"), marker).isNotNull(), F.col("line_no")))
    return lines.groupBy("run_id").agg(F.count_if(starts_with_any(F.col("line"), prefixes)).alias("n_matching"), F.coalesce(first, F.lit(0)).cast("long").alias("first_number"))


def line_counts(lines: DataFrame, marker: str, done_prefixes: list[str]) -> DataFrame:
    """Adds to each line: done (1 if it reports a finished chunk), current and total (a and b of a `<marker>a/b:` line, else 0)."""
    pattern = rf"\Q{marker}\E\s*([0-9]+)\s*/\s*([0-9]+)\s*(?::|$)"
    part = lambda k: F.coalesce(F.regexp_extract("line", pattern, k).try_cast("long"), F.lit(0).cast("long"))
    done = F.coalesce(starts_with_any(F.col("line"), done_prefixes), F.lit(False)).cast("long")
    return lines.withColumns({"done": done, "current": part(1), "total": part(2)})


def chunk_counts(marker: str, done_prefixes: list[str]) -> list[Column]:
    """Aggregates of a run: finished chunks, and the largest a and b of `<marker>a/b:` lines."""
    pattern = rf"\Q{marker}\E\s*([0-9]+)\s*/\s*([0-9]+)\s*(?::|$)"
    part = lambda k: F.max(F.regexp_extract("line", pattern, k).try_cast("long"))
    return [F.count_if(starts_with_any(F.col("line"), done_prefixes)).alias("done"), F.coalesce(part(1), F.lit(0)).cast("long").alias("current"), F.coalesce(part(2), F.lit(0)).cast("long").alias("total")]


def clamp_current(counts: DataFrame) -> DataFrame:
    """The chunk at work lies within 1 and the total; one that is unknown is the one after those done."""
    one = F.lit(1).cast("long")
    now = F.when(F.col("current") > 0, F.col("current")).otherwise(F.least(F.col("done") + 1, F.col("total")))
    return counts.withColumn("current", F.when(F.col("total") > 0, F.greatest(one, F.least(F.col("total"), now))).otherwise(F.col("current")))


def chunk_progress(lines: DataFrame, marker: str, done_prefixes: list[str]) -> DataFrame:
    """run_id, done, current, total."""
    return clamp_current(lines.groupBy("run_id").agg(*chunk_counts(marker, done_prefixes)))


def milestone_progress(lines: DataFrame, tokens: list[tuple[str, int, str]], elapsed: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """tokens: (lower-case text, percent, label) in order, a few; elapsed: run_id, seconds. run_id, percent, label.

    A run begins at 5 % and gains 20 % a minute up to 90 %. A token found in its log raises it to the token's percent, if that isn't less; of equals the later token names it. With
    chunks (done, total) the percent is at least 35 plus their share of 55, 95 at most.
    """
    low = F.lower(F.col("line"))
    seen = lines.groupBy("run_id").agg(*[F.coalesce(F.bool_or(low.contains(t)), F.lit(False)).alias(f"__{i}") for i, (t, _, _) in enumerate(tokens)])
    x = elapsed.join(seen, "run_id", "left").withColumn("percent", F.least(F.lit(90), F.lit(5) + F.floor(F.col("seconds") / 60 * 20)).cast("long")).withColumn("label", F.lit("Running"))
    for i, (_, value, label) in enumerate(tokens):
        hit = F.coalesce(f"__{i}", F.lit(False)) & (F.lit(value) >= F.col("percent"))
        x = x.withColumn("label", F.when(hit, label).otherwise(F.col("label"))).withColumn("percent", F.when(hit, F.lit(value).cast("long")).otherwise(F.col("percent")))
    if chunks is not None:
        x = x.join(chunks.select("run_id", "done", "total"), "run_id", "left")
        share = F.least(F.lit(95).cast("long"), F.lit(35) + F.floor(F.col("done") / F.col("total") * 55).cast("long"))
        x = x.withColumn("percent", F.when((F.col("total") > 0) & (F.col("percent") < 100), F.greatest("percent", share)).otherwise(F.col("percent")))
    return x.select("run_id", "percent", "label")


def progress_eta(progress: DataFrame) -> DataFrame:
    """progress: done, total, seconds. Adds eta_seconds: what is left at the mean pace so far; null before anything is done or when all is."""
    left = F.greatest(F.lit(0.0), F.col("seconds") / F.col("done") * (F.col("total") - F.col("done")))
    return progress.withColumn("eta_seconds", F.when((F.col("total") > 0) & (F.col("done") > 0) & (F.col("done") < F.col("total")), left))


def phase_progress(stages: DataFrame) -> DataFrame:
    """stages: project, stage, latest, running_percent. project, percent: the mean over a project's stages of the running percent, 100 if an output exists, or 0; rounded half to even."""
    percent = F.coalesce("running_percent", F.when(F.coalesce("latest", F.lit("")) != "", 100).otherwise(0))
    return stages.groupBy("project").agg((F.sum(percent) / 100).alias("__c"), F.count("*").alias("__n")).select("project", nearest(F.col("__c") / F.col("__n") * 100).alias("percent"))
