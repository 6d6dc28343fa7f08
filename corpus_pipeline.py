"""A pipeline over `documents`: drop toxic documents, keep one of each near-duplicate group, cut repeated passages, mix sources, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmspark.llm import mixing, shingles, simhash, suffix, toxicity, viterbi
from filmspark.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic; it learns as in query op1. Rows without an id stay if their text passes; null texts count as empty; repeated rows are
    judged each; an empty table gives an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder("doc_id", 5) != 0)
    return docs.where(~toxicity.is_toxic(docs["text"], model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id, one of them where it comes more than once. Rows without an id stay. Verdicts are by row,
    so an id that comes with several texts loses only those that are copies. Null and empty texts are one group. A column __row of the input stays as it is. An empty table gives an empty one.

    SimHash of five words drops copies and light edits first. No distance of 64 bits covers a similarity of 0.8, so what is left is grouped by all pairs whose
    shingle sets are that similar, checked exactly: no two documents of that similarity stay. Texts that share too few shingles with all others together
    can't be similar to one, and are left out of that search.
    """
    name = "__row"
    while name in docs.columns:
        name += "_"
    rows = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    copies = written(_later(simhash.grouped_rows(rows, width=5, row_col=name), name), "copies")
    left = rows.join(copies, name, "left_anti")
    able = written(shingles.shared_enough(left, name, width=5, least=0.8).select(F.col("row").alias(name)), "sharing")
    near = written(_later(shingles.similar_rows(left.join(able, name, "left_semi"), width=5, least=0.8, row_col=name), name), "near-copies")
    return left.join(near, name, "left_anti").select(docs.columns)


def _later(groups: DataFrame, name: str) -> DataFrame:
    """groups: (id, row, component). The rows that have an id and aren't the first of their group, as column `name`."""
    groups = groups.where("id is not null").select("id", "row", "component")
    first = groups.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("id", "row")).alias("first")).where("n > 1")
    return groups.join(first, "component").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(name))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that a document with a smaller id has too; every document stays, if with an empty text. Null texts stay null; rows without an id stay
    as they are; rows with one id are one document; an empty table gives an empty one."""
    out = suffix.without_repeats(docs, length=100)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source alike, with as many rows in all as come in; copies of a document are rows of their own. Null sources are a source; rows with null ids hash as the text "null";
    repeated rows get equal counts; an empty table gives an empty one."""
    return mixing.poisson_mix(docs).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids of every row. Null and empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty one."""
    return viterbi.encode(docs, ["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("sentencepiece", tokenise),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
