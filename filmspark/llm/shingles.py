"""Near copies by word shingles: every pair of texts of at least a given Jaccard similarity, met by prefix keys and checked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm import packed
from filmspark.llm.common import blocks, partitions_for, written
from filmspark.llm.components import components
from filmspark.llm.simhash import SEED, word_parts

#: Shingles of all texts in one part of a large group.
_CELL = 1 << 19


#: Bytes of text in a block whose shingles are sent together, and bytes of text for each bucket of shingles.
_BLOCK, _BUCKET = 8 << 20, 32 << 20

#: A shingle is known by the upper 48 bits of its hash.
_BITS = np.uint64(16)


def _packed(s: np.ndarray) -> bytes:
    return packed.squeezed([np.diff(s, prepend=0).astype(np.uint64)])


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(packed.stretched(blob)[0], dtype=np.int64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order. Fewer words than `width`: the whole sequence is the only shingle. No words: none."""
    h, got, carried, n = xxhash.xxh64_intdigest, [], [], 0
    for part in word_parts(text):
        words = carried + part
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - width].tolist()]
            stops = (ends[width - 1 :] - 1).tolist()
            got.append(np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))))
            n += len(stops)
        carried = words[-(width - 1) :] if width > 1 else []
    if not n:
        got = [np.array([h(b" ".join(carried), SEED)] if carried else [], np.uint64)]
    return np.unique(np.concatenate(got) >> _BITS).view(np.int64)


def needed(n: int, least: float) -> int:
    """Shingles that a set of n must share with any set of similarity `least` or more."""
    return math.ceil(least * n - 1e-9)


def _sent(sets: list[np.ndarray], rows: np.ndarray, block: int, nb: int, least: float) -> Iterator[tuple]:
    """(bucket, block, keys, info) of one block: its prefixes' shingles by bucket, each once, with its text's place from 1 on, or 0 if several texts of the block have it."""
    need = np.array([needed(len(s), least) for s in sets], np.int64)
    half = (need + 1) // 2
    sets = [s[: len(s) - a + t] for s, a, t in zip(sets, need.tolist(), half.tolist(), strict=True)]
    keys, place = np.concatenate(sets).view(np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    keys, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    own = np.bincount(place[(count > 1)[inverse]], minlength=len(sets))
    place = np.where(count > 1, 0, place[first] + 1)
    info = packed.squeezed([rows.view(np.uint64), half, own])
    at = block % nb
    for bucket, of in packed.by_bucket(keys, nb):
        gap = np.diff(keys[of] // np.uint64(nb), prepend=np.uint64(0))
        yield bucket, block, packed.squeezed([gap & np.uint64(0xFFFFFFFF), gap >> np.uint64(32), place[of]]), info if bucket == at else None
        at = -1 if bucket == at else at
    if at >= 0:
        yield at, block, None, info


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: how many shingles of each text more than one block has."""
    keys, places = [], []
    for blob in pdf["keys"]:
        low, high, place = packed.stretched(blob) if blob is not None else [np.zeros(0, np.uint8)] * 3
        keys.append(np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)))
        places.append(place)
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    hit, at, out = (count > 1)[inverse], 0, []
    for place in places:
        found = place[hit[at : at + len(place)]]
        at += len(place)
        out.append(packed.squeezed(list(np.unique(found[found > 0], return_counts=True))) if found.any() else None)
    got = pd.DataFrame({"block": pdf["block"], "shared": out, "info": pdf["info"]})
    return got[got["shared"].notna() | got["info"].notna()]


def _enough(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the rows that share at least half of what a similar text would share."""
    rows, half, own = packed.stretched(pdf["info"].dropna().iloc[0])
    count = own.astype(np.int64)
    for blob in pdf["shared"].dropna():
        place, more = packed.stretched(blob)
        count[place.astype(np.int64) - 1] += more
    return pd.DataFrame({"row": rows.astype(np.uint64).view(np.int64)[count >= half]})


def shared_enough(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(row) of the rows with an id that can be similar to another at all: every row with a similar one is there, and few others.

    Two sets of similarity `least` or more share at least needed(n) shingles of each. So of the first n - needed(n) + t in hash order, t at least are
    in both; t is half of needed(n). Rows with fewer shingles that another row's first ones have too can't be similar to any.
    The shingles travel packed, each once a block of texts, so a common one costs an entry a block. Null and empty texts need nothing and stay. Repeated
    rows stay; an empty table gives an empty one.
    """
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    nb = partitions_for(docs, total, _BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = packed.block_ids()
        for b in blocks(batches, "text", _BLOCK):
            sets = [shingle_set((t.as_py() or "").encode(), width) for t in b.column(1)]
            rows = b.column(0).to_numpy(zero_copy_only=False)
            for bucket, block, keys, info in _sent(sets, rows, next(numbers), nb, least):
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([block]), pa.array([keys], pa.binary()), pa.array([info], pa.binary())], names=["bucket", "block", "keys", "info"])

    sent = src.mapInArrow(run, "bucket int, block long, keys binary, info binary")
    shared = sent.groupBy("bucket").applyInPandas(_shared, "block long, shared binary, info binary")
    return shared.groupBy("block").applyInPandas(_enough, "row long")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, row_col: str | None) -> DataFrame:
    """(id, row, cls, n, hashes): cls is a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            sets = [shingle_set((t.as_py() or "").encode(), width) for t in b.column(2)]
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cls), pa.array([len(s) for s in sets], pa.int32()), pa.array([_packed(s) for s in sets], pa.binary())], names=["id", "row", "cls", "n", "hashes"])

    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, row long, cls long, n int, hashes binary")


def _keys(classes: DataFrame, least: float, late: bool = False, whole: bool = False) -> DataFrame:
    """(key, cls, n): the first shingles of each set in one order of all, hash order but those in column `late` last; or the whole set.

    Sets of similarity `least` or more share at least needed(n), and a prefix leaves out one less. So the first shingle that they share is in both prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                cls, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                sets = [_unpacked(r) for r in part.column(2).to_pylist()]
                if late:
                    sets = [s[np.argsort(np.isin(s, np.array(x, np.int64)), kind="stable")] for s, x in zip(sets, part.column(3).to_pylist(), strict=True)]
                if not whole:
                    sets = [s[: len(s) - needed(len(s), least) + 1] for s in sets]
                of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                yield pa.record_batch([pa.array(np.concatenate(sets)), pa.array(cls[of]), pa.array(n[of])], names=["key", "cls", "n"])

    return classes.select("cls", "n", "hashes", *(["late"] if late else [])).mapInArrow(run, "key long, cls long, n int")


def _rare_first(classes: DataFrame, least: float, most: int, rounds: int = 3) -> DataFrame:
    """Prefix keys by an order in which shingles that made groups of over `most` come last, so that common passages are no keys of texts with enough else."""
    keys, common = written(_keys(classes, least), "shingle-keys"), None
    for _ in range(rounds):
        new = keys.groupBy("key").count().where(F.col("count") > most).select("key")
        new = written(new if common is None else new.join(common, "key", "left_anti"), "common-shingles")
        if new.isEmpty():
            break
        common = new if common is None else common.union(new)
        hit = written(keys.join(new, "key", "left_semi").select("cls").distinct(), "common-texts")
        again = classes.join(hit, "cls", "left_semi")
        late = _keys(again, least, whole=True).join(common, "key", "left_semi").groupBy("cls").agg(F.collect_list("key").alias("late"))
        keys = written(keys.join(hit, "cls", "left_anti").select("key", "cls", "n").union(_keys(again.join(late, "cls"), least, late=True)), "shingle-keys")
    return keys


def _alike(shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, least: float) -> np.ndarray:
    return shared >= least * (a + b - shared) - 1e-9


def _candidates(light: DataFrame, least: float) -> DataFrame:
    """light: (key, cls, n, h), h the prefix's other keys. The pairs that share a key and can be similar.

    Of two prefixes, one ends first. What its set shares beyond that is among its needed(n) - 1 others, and what it shares before is in both prefixes.
    """
    rest = lambda n: F.ceil(F.lit(least) * F.col(n) - 1e-9) - 1
    x, y = (light.select("key", F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("h").alias(f"h{c}")) for c in "uv")
    near = (F.col("u") < F.col("v")) & (F.least("nu", "nv") >= F.greatest("nu", "nv") * F.lit(least) - 1e-9)
    met = x.join(y, "key").where(near).groupBy("u", "v", "nu", "nv", "hu", "hv").agg(F.count("*").alias("c"))
    most = F.col("c") + F.least("hu", "hv") + F.greatest(rest("nu"), rest("nv"))
    return met.where(most >= F.lit(least / (1 + least)) * (F.col("nu") + F.col("nv")) - 1e-9).select("u", "v")


def _checked(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([_unpacked(r) for r in b.column(k).to_pylist()] for k in (2, 3))
            ok = [bool(_alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), least)) for p, q in zip(x, y, strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: classes.select(F.col("cls").alias(k), F.col("hashes").alias(f"{k}s"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "us", "vs").mapInArrow(run, "u long, v long")


def spanning_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that span the components of all similar pairs: breadth first, each set counted against those that none has reached."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(token))])
    by_token, own = owner[order], np.concatenate([[0], np.cumsum(sizes)])
    left, links, queue = np.ones(m, bool), [], []
    for start in range(m):
        if not left[start]:
            continue
        left[start] = False
        queue.append(start)
        while queue and left.any():
            p = queue.pop()
            shared = np.zeros(m, np.int64)
            for t in token[own[p] : own[p + 1]]:
                shared[by_token[at[t] : at[t + 1]]] += 1
            found = np.flatnonzero(left & _alike(shared, sizes[p], sizes, least))
            left[found] = False
            queue += found.tolist()
            links += [(p, q) for q in found.tolist()]
        queue.clear()
    return links


def _in_cells(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """members: (key, cls, n). Spanning links of each key's similar pairs. A large group is dealt into parts, and each two parts meet in a task of bounded size."""
    parts = members.groupBy("key").agg(F.ceil(F.sum("n") / _CELL).cast("int").alias("nb"))
    m = members.join(parts, "key").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("nb").cast("long")).cast("int"))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.select("key", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "cls").join(classes.select("cls", "hashes"), "cls")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = pdf.cls.to_numpy()
        links = spanning_links([_unpacked(r) for r in pdf.hashes], least)
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"u": cls[u], "v": cls[v]})

    return m.groupBy("key", "a", "b").applyInPandas(run, "u long, v long")


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, most: int = 64, row_col: str | None = None) -> DataFrame:
    """(id, row, component, component_id) of every row with an id: component tells groups apart even where ids are repeated, row is `row_col` (a long, or null), component_id is the least id reachable by links of a Jaccard similarity of at least `least` between the texts' shingle sets.

    No link is missed: a prefix of each set, rare shingles first, holds a shingle that both ends share, and what shares one is checked on the whole sets.
    Keys of up to `most` sets give pairs. For others the texts themselves meet, which gives spanning links only: first by the commonest key of each, then by
    the keys that still hold several components. Equal sets are one class (known by 64-bit hashes; shingles by 48 bits); texts without words are one class.
    Repeated rows each get a row; an empty table gives an empty one.
    """
    rows = written(_sets(docs, id_col, text_col, width, row_col), "shingle-sets")
    equal = written(rows.groupBy("cls").count().where("count > 1").select("cls"), "equal-sets")
    one = rows.join(equal, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    classes = rows.join(equal, "cls", "left_anti").select("cls", F.col("id").alias("least"), "n", "hashes").union(written(one, "shingle-classes"))
    keys = _rare_first(classes, least, most)
    sizes = written(keys.groupBy("key").count().where("count > 1"), "shingle-groups")
    heavy = written(keys.join(sizes.where(F.col("count") > most), "key"), "large-groups")
    light = keys.join(sizes.where(F.col("count") <= most).select("key"), "key", "left_semi").join(heavy.groupBy("cls").agg(F.count("*").alias("h")), "cls", "left")
    links = written(_checked(_candidates(light.select("key", "cls", "n", F.coalesce("h", F.lit(0)).alias("h")), least), classes, least), "similar")
    if not heavy.isEmpty():
        first = heavy.groupBy("cls", "n").agg(F.max(F.struct("count", "key")).alias("k")).select(F.col("k.key").alias("key"), "cls", "n")
        links = links.union(written(_in_cells(first, classes, least), "similar"))
        now = heavy.join(components(links).withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls"))
        split = now.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q")).where("p <> q").select("key")
        links = links.union(written(_in_cells(heavy.join(split, "key", "left_semi").select("key", "cls", "n"), classes, least), "similar"))
    linked = components(links).withColumnRenamed("vertex", "cls")
    of = classes.select("cls", "least").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("id", "row", "cls").join(of.join(first, "component").select("cls", "component", "component_id"), "cls").drop("cls")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, most: int = 64) -> DataFrame:
    """(id_col, component_id) of every row with an id; see similar_rows."""
    return similar_rows(docs, id_col, text_col, width, least, most).select(F.col("id").alias(id_col), "component_id")
