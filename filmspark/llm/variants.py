"""Spelling variants: words one edit apart, found by a bit-sliced index of letters by position, and chains from rare forms to frequent ones."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import blocks, written
from filmspark.llm.words import parts, utf8

_RUN = re.compile("[a-z\u00c0-\u00ff]+")
_BLOCK = 8 << 20
#: Words of an index, and letters in it at most: both bound the memory of a scan.
_INDEX, _LETTERS = 1024, 1 << 16


def counted_words(docs: DataFrame, least_length: int = 6, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, ASCII ones lowered, with at least `least_length` letters, and how often they come.

    every: a number; a run loses a letter before it is counted wherever `every` divides the CRC-32 of `<id>:<run>`, whose remainder by the length names the letter (planted misspellings).
    Counts are summed in each block of text before they are shuffled. Null texts are empty; null ids count as the text "null"; repeated rows count each; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", _BLOCK):
            total: Counter[str] = Counter()
            for ident, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                own: Counter[str] = Counter()
                for part in parts(text):
                    own.update(_RUN.findall(part.lower().decode()))
                if every:
                    head = zlib.crc32(f"{ident}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), head) % every == 0]:
                        # marked, as it may be another run of the text
                        at = zlib.crc32(word.encode(), head) % len(word)
                        own[word[:at] + word[at + 1 :] + "\0"] += own.pop(word)
                total.update(own)
            kept: Counter[str] = Counter()
            for word, n in total.items():
                word = word.removesuffix("\0")
                if len(word) >= least_length:
                    kept[word] += n
            yield pa.record_batch([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- groups. A node of a word's group is (shorter length of a pair, path): each step of the path, 'p' or 's', says that the pair's words agree in the first or
# in the last half of what is left of the shorter word. Words one edit apart agree in one of both, and what is left of them is again one edit apart.


def _half(left: int) -> int:
    return left // 2


def _left(word: str, shorter: int, path: str) -> tuple[int, int]:
    """Letters cut from the front and the back by a path."""
    a = z = 0
    for step in path:
        half = _half(shorter - a - z)
        a, z = (a + half, z) if step == "p" else (a, z + half)
    return a, z


def _keys(word: str, shorter: int, path: str) -> list[tuple[str, str]]:
    """(path, key) of the two nodes below a node; a key names all that its words agree in."""
    out = []
    for step in "ps":
        a, z = _left(word, shorter, path + step)
        out.append((path + step, f"{shorter}{path + step}{word[:a]} {word[len(word) - z :]}"))
    return out


def _dealt(members: DataFrame, first: bool) -> DataFrame:
    """(key, shorter, path, word, n): each word under both nodes below its own; at first under both of pairs in which it is the shorter and the longer word (or of equal length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shorter, path, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for m in (len(word), len(word) - 1) if first else (shorter,):
                    out += [(key, m, p, word, n) for p, key in _keys(word, m, path)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "shorter", "path", "word", "n"])

    return members.select("shorter", "path", "word", "n").mapInArrow(run, "key string, shorter int, path string, word string, n long")


def _bits(where: np.ndarray, n: int) -> np.ndarray:
    """Bitset of n places."""
    flags = np.zeros(-(-n // 64) * 64, np.uint8)
    flags[where] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


class Index:
    """For each position and letter, the set of words that have the letter there, a bit a word."""

    def __init__(self, words: list[str]) -> None:
        self.words, n = words, len(words)
        self.lengths = np.array([len(w) for w in words])
        top = int(self.lengths.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(n), self.lengths)
        self.start = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(codes)) - self.start[row]
        _, self.code = np.unique(codes, return_inverse=True)
        letters = int(self.code.max()) + 1
        # one position more at either end, which no word has a letter at
        flags = np.zeros((top + 2, letters, -(-n // 64) * 64), bool)
        flags[place + 1, self.code, row] = True
        self.at = np.packbits(flags, axis=2, bitorder="little").view(np.uint64)
        self.of_length = np.stack([_bits(np.flatnonzero(self.lengths == m), n) for m in range(top + 2)])

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of words one edit apart, in both directions.

        All words are asked at once, in the order of their lengths. After j letters of a query, `none` holds the words that agree so far, and three sets those with one error: a letter
        replaced (positions as they are), one that only the word has (its positions shifted one on) and one that only the query has (shifted one back).
        """
        order = np.argsort(self.lengths, kind="stable")
        found = []
        for m in np.unique(self.lengths).tolist():
            ask = order[self.lengths[order] == m]
            none = np.full((len(ask), self.at.shape[2]), np.iinfo(np.uint64).max)
            other, more, less = np.zeros_like(none), np.zeros_like(none), np.zeros_like(none)
            for j in range(m):
                c = self.code[self.start[ask] + j]
                here = self.at[j + 1, c]
                further = self.at[j + 2, c] if j + 2 < len(self.at) else np.zeros_like(here)
                more = (more | none) & further
                less = (less & self.at[j, c]) | none
                other = (other & here) | (none & ~here)
                none &= here
            top = len(self.of_length)
            got = other & self.of_length[m]
            if m + 1 < top:
                got |= (more | none) & self.of_length[m + 1]
            got |= less & self.of_length[m - 1]
            q, w = np.nonzero(np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, : len(self.words)])
            found.append((ask[q], w))
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


def _unseen(a: str, b: str, shorter: int, path: str) -> bool:
    """Whether no earlier node gives the pair too: at each last-half step the first halves differ."""
    for k, step in enumerate(path):
        if step == "s":
            x, _ = _left(a, shorter, path[:k])
            half = _half(shorter - sum(_left(a, shorter, path[:k])))
            if a[x : x + half] == b[x : x + half]:
                return False
    return True


def _paired(dealt: DataFrame, partitions: int) -> DataFrame:
    """(word, near, n): both directions of each pair of words one edit apart, once. Groups come in the order of their keys and several small ones share an index; a group is in one index as a whole, and pairs of words from two groups don't count."""

    def scan(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        # a word that comes for two groups is two words of the index
        q, w = Index([r[3] for r in rows]).near()
        for i, j in zip(q.tolist(), w.tolist(), strict=True):
            (key, shorter, path, a, _), (other, _, _, b, n) = rows[i], rows[j]
            if key == other and min(len(a), len(b)) == shorter and _unseen(a, b, shorter, path):
                out.append((a, b, n))
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: list[tuple] = []
        letters = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        if rows and (len(rows) + len(group) > _INDEX or letters + sum(len(r[3]) for r in group) > _LETTERS):
                            yield scan(rows)
                            rows, letters = [], 0
                        rows += group
                        letters += sum(len(r[3]) for r in group)
                    group = []
                group.append(row)
        if len(group) > 1:
            rows += group
        if rows:
            yield scan(rows)

    return dealt.repartition(partitions, "key").sortWithinPartitions("key", "word").mapInArrow(run, "word string, near string, n long")


def near_words(vocabulary: DataFrame, most: int = _INDEX) -> DataFrame:
    """vocabulary: (word, n), distinct words. (word, near, n): every pair of words that differ by exactly one inserted, deleted or replaced letter, in both directions, n being near's.

    Words are dealt by what a pair must share: its first or its last half. Groups of more than `most` words are dealt again by half of what is left, until they are small or
    nothing is left to share: then at most two letters are free. So no group grows with the vocabulary, and no group is taken with itself in blocks. Words are of two letters at least.
    """
    words = vocabulary.where("length(word) > 1").select(F.lit(0).alias("shorter"), F.lit("").alias("path"), "word", "n")
    partitions = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, out, first = written(_dealt(words, True), "dealt"), None, True
    while True:
        sizes = dealt.groupBy("key").agg(F.count("*").alias("c"), F.max("shorter").alias("shorter"), F.max(F.length("path")).alias("steps"))
        large = written(sizes.where((F.col("c") > most) & (F.col("shorter") > F.pow(F.lit(2.0), F.col("steps")))).select("key"), "large-groups")
        small = _paired(dealt.join(large, "key", "left_anti"), partitions)
        out = small if out is None else out.union(small)
        if large.isEmpty():
            return out
        dealt = written(_dealt(dealt.join(large, "key", "left_semi"), False), "dealt")


def variant_groups(vocabulary: DataFrame, factor: int = 5, most: int = _INDEX) -> DataFrame:
    """vocabulary: (word, n), distinct words. word, n, n_near (words one edit apart), form (the most frequent of those, ties: the smallest in code-point order, if it comes at least `factor` times as often; else
    null), form_n, root (the last word when forms are followed; the word itself without one).

    Forms come at least `factor` times as often, so a chain is short; it is followed by doubling, each round written to the shared folder. An empty vocabulary gives an empty table.
    """
    vocabulary = written(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("n")).alias("down"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocabulary, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(near, "word", "left")
    linked = F.col("best.down").isNotNull() & (-F.col("best.down") >= factor * F.col("n"))
    rows = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(linked, F.col("best.near")).alias("form"), F.when(linked, -F.col("best.down")).alias("form_n")), "variants")
    roots = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        roots = step.select("word", "root")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 5, factor: int = 5, least_length: int = 6, every: int | None = None, most: int = _INDEX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variant_groups of the words that come at least `least` times in `docs`; see counted_words. Repeated rows count each; extra columns are ignored; an empty table gives an empty one."""
    words = counted_words(docs, least_length, every, id_col, text_col)
    return variant_groups(words.where(F.col("n") >= least), factor, most)
