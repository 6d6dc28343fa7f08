"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each vertex points the neighbours on one side of it, and itself, to the least vertex that it sees.

    Only minima are gathered at a vertex, so a hub costs one partial aggregate and a join whose large side can be split.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    seen = both.join(least, "u")
    if large:
        out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """links: columns u, v of one comparable type, in any direction and repeated at will. Null ends and self-links link nothing.

    Returns (vertex, component): component is the least vertex reachable. Vertices without links don't appear. Each round is
    written to the shared folder, so lineage stays short. An empty table gives an empty table.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(now, "links"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before or state.n == 0:
            break
        before = (state.n, state.s)
        now = written(_star(_star(now, large=True), large=False), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
