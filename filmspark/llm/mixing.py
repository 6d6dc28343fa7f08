"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import written

#: One inversion gives at most MOST_COPIES; its mean is at most MOST_RATE, so that a count beyond has a chance under 1e-12. Larger means are sums of inversions.
MOST_COPIES = 128
MOST_RATE = 60.0
#: Copies of a row of such a mean that one row stands for until they are dealt.
_RUN = 1024


def _uniform(salt: Column, ident: Column) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(salt, ident).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _inverted(rate: Column, u: Column) -> Column:
    """The least k with CDF(k) >= u: terms are added while the sum is below u."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))
    step = lambda a, i: F.when(a["sum"] >= u, a).otherwise(F.struct((a["term"] * rate / i).alias("term"), (a["sum"] + a["term"] * rate / i).alias("sum"), i.alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_COPIES)), start, step, lambda a: a["k"])


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, seed: int = 11, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Repeat or drop documents so that each source has its target share, then shuffle all copies globally.

    weights: target weight by source (others: 0; None: every source alike). total: target rows (None: as many as come in). The mean repetition rate of source s is
    total * share(s) / rows(s). A document's count inverts the Poisson distribution of that mean at u, a number in (0, 1) hashed
    from seed and id; it is exploded by its count. Returns the input's columns, copy (0, 1, ...) and shuffle_key; rows are dealt to tasks and
    sorted within them by the key, a hash of seed, id and copy.

    A mean over 60 is split into equal means of at most 60, and the count is the sum of their counts, each at a number of its own (hashed from seed, part and id).

    Null sources are a source of their own (key None in weights). Rows with null ids hash as the text "null"; repeated rows get equal counts. A `total` over 60 times
    the rows that come in raises ValueError. Clashing columns named copy or shuffle_key are replaced. An empty table gives an empty one.
    Sources are counted by a partial aggregate and joined as a table, so their number is free. Text moves once, in the final shuffle,
    by a hash that no source or group of copies can make uneven; a row with a mean over 60 is dealt in runs of copies before it is copied.
    """
    spark = docs.sparkSession
    counted = written(docs.groupBy(F.col(source_col).alias("__s")).agg(F.count("*").alias("__rows")), "sources")
    rows = counted.agg(F.sum("__rows")).first()[0] or 0
    goal = float(rows) if total is None else float(total)
    if rows and goal / rows > MOST_RATE:
        raise ValueError(f"documents would be repeated {goal / rows:.1f} times on average")
    shared = counted.withColumn("__share", F.lit(1.0))
    if weights is not None:
        given = spark.createDataFrame([(s if s is None else str(s), float(w)) for s, w in weights.items()], "__w string, __share double")
        shared = counted.join(given, F.col("__s").cast("string").eqNullSafe(F.col("__w"))).where("__share > 0")
    # a sum of the caller's own weights; equal ones are counted
    whole = (float(counted.count()) if weights is None else math.fsum(r[0] for r in shared.select("__share").collect())) or 1.0
    rates = shared.select("__s", (F.lit(goal) * F.col("__share") / F.lit(whole) / F.col("__rows")).alias("__rate"))
    worst = rates.agg(F.max("__rate")).first()[0] or 0.0
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    kept = docs.drop("copy", "shuffle_key")
    # names of columns that only live here must not be those of the input
    tag = "__mix"
    while any(c.startswith(tag) for c in kept.columns):
        tag += "_"
    count, start, rate_name = f"{tag}_count", f"{tag}_start", f"{tag}_rate"
    rate, n = F.col(rate_name), F.col(count)
    rates = rates.select(F.col("__s").alias(f"{tag}_source"), F.col("__rate").alias(rate_name))
    rated = kept.join(rates, F.col(source_col).eqNullSafe(F.col(f"{tag}_source")))
    narrow = rated.where(rate <= MOST_RATE).withColumn(count, _inverted(rate, _uniform(F.lit(f"{seed}:"), ident))).where(n > 0)
    copies = narrow.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1))).select(*kept.columns, "copy")
    if worst > MOST_RATE:
        parts = F.ceil(rate / MOST_RATE).cast("int")
        each = lambda n, j: n + _inverted(rate / parts, _uniform(F.concat(F.lit(f"{seed}+"), j.cast("string"), F.lit(":")), ident))
        many = rated.where(rate > MOST_RATE).withColumn(count, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), each)).where(n > 0)
        runs = many.withColumn(start, F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(_RUN)))).repartition(ident, F.col(start))
        last = F.least(F.col(start) + _RUN, n) - 1
        copies = copies.union(runs.withColumn("copy", F.explode(F.sequence(F.col(start), last))).select(*kept.columns, "copy"))
    key = F.md5(F.concat(F.lit(f"{seed}/"), ident, F.lit("/"), F.col("copy").cast("string")).cast("binary"))
    keyed = copies.withColumn("shuffle_key", key)
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def poisson_sql(seed: int = 11) -> str:
    """The same counts and keys for equal weights, in DuckDB SQL over `documents`, where no source has a mean over 60."""
    return f"""
WITH RECURSIVE d AS (
  SELECT *, (CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
r AS (SELECT source, (SELECT count(*) FROM d)::DOUBLE / count(*) / (SELECT count(*) FROM (SELECT DISTINCT source FROM d)) AS rate FROM d GROUP BY source),
p AS (
  SELECT source, 0 AS k, exp(-rate) AS term, exp(-rate) AS s, rate FROM r
  UNION ALL SELECT source, k + 1, term * rate / (k + 1), s + term * rate / (k + 1), rate FROM p WHERE k < {MOST_COPIES}),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, min(p.k) AS n FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.s >= d.u GROUP BY ALL),
c AS (SELECT *, unnest(generate_series(0, n - 1)) AS copy FROM n WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || copy) AS shuffle_key FROM c"""
