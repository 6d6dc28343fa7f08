"""SimHash near-duplicates, found by Golay-code fuzzy hashing of 64-bit fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import written
from filmspark.llm.components import components

SEED = 42
_SPACE = re.compile(rb"[ \t-\r]")
_PART = 1 << 20


def word_parts(text: bytes, size: int = _PART) -> Iterator[list[bytes]]:
    """The words of a text (ASCII letters lowered, cut at ASCII white space), a part of about `size` bytes at a time."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + size < end and (m := _SPACE.search(text, at + size)):
            end = m.end()
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text, each counted as often as it occurs: a bit is 1 if it is 1 in over half the hashes.

    Fewer words than `width`: the whole sequence is the only shingle. No words: 0.
    """
    h, ones, n, carried = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in word_parts(text):
        words = carried + part
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - width].tolist()]
            stops = (ends[width - 1 :] - 1).tolist()
            got = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
            for k in range(0, len(got), 1 << 14):
                ones += np.unpackbits(got[k : k + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            n += len(got)
        carried = words[-(width - 1) :] if width > 1 else []
    if not n:
        return h(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row_col: str | None = None) -> DataFrame:
    """(id, row, fp long) of each row; row is `row_col`, a long, or null without one. Null texts are empty. Narrow: no shuffle."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint((t.as_py() or "").encode(), width) for t in b.column(2)], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "row", "fp"])

    kind = dict(docs.dtypes)[id_col]
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    return docs.select(F.col(id_col).alias("id"), row, F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, row long, fp long")


# The binary Golay code of length 23 as a cyclic code; its generator is a fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= _GENERATOR << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of at most 3 bits that each syndrome stands for (perfect code)."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)
    bits = [1 << i for i in range(23)]
    errors = {0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)}
    error = np.zeros(1 << 11, np.int64)
    for e in errors:
        error[_remainder(e)] = e
    return low, high, error


_TABLES: list = []


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word; none is further than 3 bits."""
    if not _TABLES:
        _TABLES.extend(_tables())
    low, high, error = _TABLES
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that any two fingerprints that differ in at most 2 bits share a key.

    A fingerprint is cut into segments A (23 bits), B (23) and C (18). Of two errors at most, one segment has none and each other at most
    two. Two 23-bit words at most 2 bits apart have a common neighbour at most 1 bit from either; so decoding a word
    and its 23 neighbours gives codeword indices of which they share one. Keys: A with an index of B, B with one of A, C with one of A.
    """
    f = fps.view(np.uint64).astype(np.uint64)
    a, b, c = ((f >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF)))
    flips = np.array([0, *(1 << i for i in range(23))], np.int64)
    near = {k: np.sort(golay_index(x[:, None] ^ flips), axis=1) for k, x in (("a", a), ("b", b))}
    rows, keys = [], []
    for tag, exact, by in ((0, a, "b"), (1, b, "a"), (2, c, "a")):
        n = near[by]
        first = np.ones(n.shape, bool)
        first[:, 1:] = n[:, 1:] != n[:, :-1]
        r, k = np.nonzero(first)
        rows.append(r)
        keys.append(tag << 40 | exact[r] << 12 | n[r, k])
    return np.concatenate(rows), np.concatenate(keys)


def close_pairs(fps: DataFrame, most_in_group: int = 256) -> DataFrame:
    """fps: distinct longs (column fp). All pairs u < v that differ in 1 or 2 bits.

    Golay keys gather candidates. A key shared by over `most_in_group` fingerprints isn't joined; its fingerprints go by all
    points at most 1 bit away instead. Two at most 2 bits apart share such a point, and a point has at most 65
    fingerprints, so no group grows with the data and none is cut.
    """

    def run(batches):
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            r, k = golay_keys(f)
            yield pa.record_batch([pa.array(k), pa.array(f[r])], names=["key", "fp"])

    keys = written(fps.select("fp").mapInArrow(run, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").count()
    light = keys.join(sizes.where(F.col("count").between(2, most_in_group)).select("key"), "key", "left_semi")
    heavy = keys.join(sizes.where(F.col("count") > most_in_group).select("key"), "key", "left_semi").select("fp").distinct()
    point = F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")
    heavy = heavy.select(F.explode(point).alias("key"), "fp")

    def pairs(k: DataFrame) -> DataFrame:
        x, y = k.select("key", F.col("fp").alias("u")), k.select("key", F.col("fp").alias("v"))
        return x.join(y, "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")

    return pairs(light).union(pairs(heavy)).distinct()


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_in_group: int = 256, row_col: str | None = None) -> DataFrame:
    """(id, row, fp, component, component_id) of every row: component tells groups apart even where ids are repeated, component_id is the least id of the group."""
    fps = written(fingerprints(docs, id_col, text_col, width, row_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(close_pairs(classes.select("fp"), most_in_group))
    of = classes.join(linked.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(of.join(first, "component").select("fp", "component", "component_id"), "fp").select("id", "row", "fp", "component", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_in_group: int = 256) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (least id reachable by links of at most 2 bits).

    Equal fingerprints are one class, so copies never meet in pairs. Null and empty texts have fingerprint zero and link like any
    other. Repeated rows each get a row; an id that comes with several texts has the group of each. Null ids are never a component's id unless it has no other. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = grouped_rows(docs, id_col, text_col, width, most_in_group)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
