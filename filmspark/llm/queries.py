"""One query for each operator, over its whole table and with production parameters; contracts are in the operators' docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmspark.llm import feistel, mixing, nndescent, periodic, pst, quality, simhash, suffix, tiff, toxicity, variants, viterbi, warc
from filmspark.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder("doc_id", 5) != 0)
    held_out = F.coalesce(toxicity.remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_nn_descent_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95).drop("recall")


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encoded_documents(table(spark, sf_dir, "documents"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.tiff_round_trip(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"), length=50)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.scores(table(spark, sf_dir, "documents"), toxicity.remainder("doc_id", 7) != 2)


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).drop("archive", "member_offset")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"), planted=True)


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder("doc_id", 5) != 0)
    return quality.quality_verdicts(docs, model)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), every=199)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_nn_descent_near_dedup, op3_sentencepiece_viterbi, op4_poisson_mixing, op5_feistel_sharding,
        op6_tiff_pages, op7_suffix_array_dedup, op8_simhash_near_dedup, op9_suffix_tree_scoring, op10_warc_normaliser,
        op11_periodic_runs, op12_quality_trees, op13_spelling_variants,
    )
}
# all pairs, and the closure of their links
_NEAR_SQL = """WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER () AS k, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
r AS (SELECT k AS a, k AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(e.vec_id) AS component_id FROM r JOIN e ON e.k = r.b GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.k) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, true) AS kept FROM e JOIN c USING (k)"""

# every window of 50 bytes (taken from pieces of 256 starts, as short strings are cut faster) with the least document that has it; what such windows cover, as runs
_REPEATS_SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, unnest(range(0, octet_length(b) - 49, 256)) AS base, octet_length(b) AS n, h FROM d WHERE octet_length(b) >= 50),
w AS (SELECT doc_id, base, unnest(range(least(256, n - 49 - base))) AS off, piece FROM (SELECT doc_id, base, n, substr(h, 2 * base + 1, 2 * 305) AS piece FROM q)),
k AS (SELECT doc_id, base + off AS pos, substr(piece, 2 * off + 1, 100) AS s FROM w),
m AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
g AS (SELECT k.doc_id, k.pos FROM k JOIN m USING (s) WHERE m.least < k.doc_id),
i AS (SELECT doc_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1000000) > 50 AS fresh FROM g),
n AS (SELECT doc_id, pos, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM i),
r AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS z FROM n GROUP BY 1, 2),
p AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY 1),
t AS (SELECT r.doc_id, string_agg(substr(d.h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' ORDER BY a) AS head, max(z) AS stop FROM (SELECT *, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r) r JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(p.n_removed, 0) AS n_removed, coalesce(p.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(t.head, '') || substr(d.h, 2 * coalesce(t.stop, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

_WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM s"""

ORACLES: dict[str, str] = {"op2_nn_descent_near_dedup": _NEAR_SQL, "op4_poisson_mixing": mixing.poisson_sql(), "op5_feistel_sharding": feistel.shards_sql(), "op7_suffix_array_dedup": _REPEATS_SQL, "op10_warc_normaliser": _WARC_SQL}
