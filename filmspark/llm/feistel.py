"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import written

ROUNDS = 8
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def round_keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A fixed 64-bit finaliser (two multiply and shift steps) as round function."""
    x = (x ^ np.uint64(key)) * np.uint64(MIX[0])
    x = (x ^ x >> np.uint64(29)) * np.uint64(MIX[1])
    return x ^ x >> np.uint64(32)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network over the next power of 4; what falls outside walks its cycle until it is inside.

    It is computable for any number alone, so the place of a row needs no state. At most 4 steps are expected.
    """
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = round_keys(seed)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permuted(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(np.int64), n, seed))

    return run(number)


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds row_number (0, 1, ... over all rows in the order of the columns, of any types that sort; nulls first) and returns the row count too. A column row_number of df is replaced.

    Rows are dealt by ranges of all the columns and, last, of their place in df, so neither one id nor many equal rows make a large range; equal rows may swap places among
    themselves. The sorted ranges are a table in the shared folder, so places hold whatever is lost later. A row's number is its place in its range after the rows of all ranges before,
    of which one count each comes to the driver. Only `df`'s own columns move; give it narrow rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.drop("row_number").withColumn("__tie", F.monotonically_increasing_id()), "narrow")
    ranged = placed.repartitionByRange(parts, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    # the upper 31 bits are the range, the lower 33 the place in it
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r["part"]: r["count"] for r in ranged.groupBy(part.alias("part")).count().collect()}
    starts, n = {}, 0
    for k in sorted(counts):
        starts[k], n = n, n + counts[k]
    if not starts:
        return ranged.withColumn("row_number", F.lit(0).cast("long")).drop("__at"), 0
    offsets = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
    return ranged.withColumn("row_number", (place + F.element_at(offsets, part)).cast("long")).drop("__at"), n


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into `shards` by the permuted global row number p: shard = p mod shards, slot = p div shards.

    Law `rows`: shard counts differ by one at most, and slots run without gaps from 0. Returns id_col, size (UTF-8 bytes plus 16), text_crc32,
    law, shard, slot, grown_shard (null under this law). Rows are numbered by id, of any type that sorts, then checksum and size, so equal rows may
    swap places among themselves only. Null texts count as empty: size 16, checksum 0. Null ids come first. Extra columns, whatever their names, are ignored. An empty
    table gives an empty one. The text itself is never shuffled.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("crc"))
    numbered, n = row_numbers(narrow, ["id", "crc", "size"])
    p = numbered.withColumn("p", permuted(F.col("row_number"), n, seed))
    return p.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def shards_sql(shards: int = 40, seed: int = 7) -> str:
    """shard_documents over `documents` in SQL: checksums byte by byte, and the network round by round on wide integers."""
    wide = lambda x: f"{x}::UHUGEINT"
    m64, key = wide(1 << 64), f"[{', '.join(wide(k) for k in round_keys(seed))}]"
    low, step1 = f"xor(r, {key}[k + 1])", f"(x * {wide(MIX[0])}) % {m64}"
    step2 = f"(xor(x, x >> 29) * {wide(MIX[1])}) % {m64}"
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, (len(h) // 2 + 16)::BIGINT AS size, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM d, tab),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS num, count(*) OVER () AS n FROM c),
s AS (SELECT num, n, greatest(1, (CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 1 END + 1) // 2)::UHUGEINT AS half, n::UHUGEINT AS wide FROM o),
f AS (SELECT num, wide, half, 0 AS k, num::UHUGEINT >> half AS l, num::UHUGEINT & ((1::UHUGEINT << half) - 1) AS r FROM s
  UNION ALL SELECT num, wide, half, CASE WHEN k = {ROUNDS} THEN 0 ELSE k + 1 END, CASE WHEN k = {ROUNDS} THEN l ELSE r END, CASE WHEN k = {ROUNDS} THEN r ELSE xor(l, xor(x, x >> 32) & ((1::UHUGEINT << half) - 1)) END FROM (
    SELECT * REPLACE ({step2} AS x) FROM (SELECT * REPLACE ({step1} AS x) FROM (SELECT *, CASE WHEN k < {ROUNDS} THEN {low} ELSE 0::UHUGEINT END AS x FROM f WHERE k < {ROUNDS} OR (l << half | r) >= wide)))),
p AS (SELECT num, (l << half | r)::BIGINT AS p FROM f WHERE k = {ROUNDS} AND (l << half | r) < wide)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, p // {shards} AS slot, NULL::INTEGER AS grown_shard, num AS row_number FROM o JOIN p USING (num)"""
