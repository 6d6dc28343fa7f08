"""Quality rules: fixed rules on counts of a whole text, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmspark.llm import words as W
from filmspark.llm.common import blocks
from filmspark.llm.trees import Trees, fit_trees

_WHITE, _SYMBOLS, _MARKS, _DIGITS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b".,;:!?\"'()-", b"0123456789"
_UPPER, _LATER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))

#: What the trees read, and whether a score may only rise (1) or only fall (-1) with it, or both (0).
FEATURES = {
    "log_words": 0, "word_length": 0, "longest_word": 0, "symbols_a_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": 0,
    "marks_a_word": 0, "words_a_line": 0, "short_line_share": 0, "ended_line_share": 1, "symbol_word_share": -1, "later_byte_share": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLOCK = 2 << 20


def _n(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """How many lines hold a word, equal an earlier one of them, have at most three words, end with a full stop or the like."""
    seen: set[bytes] = set()
    n = short = ended = 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if bare:
            n += 1
            seen.add(line)
            short += len(bare) < 40 and len(bare.split()) <= 3
            ended += bare[-1:] in b".!?:"
    return n, n - len(seen), short, ended


def repeat_words(ids: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """How many words of each text lie in windows of `width` words that the text has twice or more, first ones included. Exact: windows are numbered by sorting, not hashed."""
    n, doc = len(ids), np.repeat(np.arange(len(at) - 1), np.diff(at))
    if n < width:
        return np.zeros(len(at) - 1, np.int64)
    last = n - width + 1
    inside = doc[:last] == doc[width - 1 :]
    key = doc[:last].astype(np.int64)
    for k in range(width):
        key = np.unique(key * (int(ids.max()) + 1) + ids[k : k + last], return_inverse=True)[1]
    hit = np.zeros(last, bool)
    where = np.flatnonzero(inside)
    hit[where] = W.repeated_at(key[where])
    cover = np.zeros(n, bool)
    for k in range(width):
        cover[k : k + last] |= hit
    return np.bincount(doc[cover], minlength=len(at) - 1)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the five counts of COUNTS, and the statistics of FEATURES."""
    ids, at, dictionary = W.word_ids(texts)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n_words)
    own = np.array([[len(t), _n(t, _WHITE), _n(t, _LATER), _n(t, _SYMBOLS), _n(t, _UPPER), _n(t, _DIGITS), _n(t, _MARKS), *_lines(t)] for t in texts], np.int64).reshape(-1, 11)
    size, white, later, symbols, upper, digits, marks, lines, dup, short, ended = own.T
    chars = size - white - later
    repeats = repeat_words(ids, at)
    pair = np.unique(doc.astype(np.int64) * (len(dictionary) + 1) + ids)
    distinct = np.bincount(pair // (len(dictionary) + 1), minlength=len(texts))
    lengths, odd = np.zeros(len(dictionary), np.int64), np.zeros(len(dictionary), bool)
    for i, w in enumerate(dictionary.to_pylist()):
        lengths[i], odd[i] = len(w), w.translate(None, _SYMBOLS) != w
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, lengths[ids])
    some, rows = np.maximum(n_words, 1), np.maximum(lines, 1)
    x = [
        np.log1p(n_words), chars / some, np.minimum(longest, 1000), symbols / some, dup / rows, repeats / some, distinct / some, upper / np.maximum(chars, 1), digits / np.maximum(chars, 1),
        marks / some, n_words / rows, short / rows, ended / rows, np.bincount(doc, odd[ids], len(texts)) / some, later / np.maximum(size, 1),
    ]
    return np.stack([n_words, chars, symbols, dup, repeats], axis=1), np.stack(x, axis=1).astype(np.float64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **params) -> Trees:
    """Trees for label_col, learned from at most `max_rows` labelled documents (a hash of the id picks them where there are more).

    learn: a condition on id_col; rows of labels that don't meet it are never looked at. Statistics are computed by Spark; the bounded matrix is fitted on the driver.
    Null labels, null ids and labels without a document teach nothing; without any labelled row there are no trees, and every text scores 0.5. An id that is labelled
    twice counts with its larger label; one that has several documents teaches with each. params: see trees.fit_trees.
    """
    if learn is not None:
        labels = labels.where(learn)
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    picked = picked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(max_rows)
    # at most max_rows ids: a proven bound for the broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch], "text", _BLOCK):
                _, x = statistics(W.utf8(b.column(1)))
                yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = texts.mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(got.x.tolist(), np.float64).reshape(-1, len(FEATURES))
    y = got.y.to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same sums in any run
    return fit_trees(x[order], y[order], np.array(list(FEATURES.values())), **params)


def quality_verdicts(docs: DataFrame, model: Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the counts of COUNTS, base_failed, score (0 to 1, higher: better) and kept of every row.

    Words are runs of anything but ASCII white space. base_failed: under 50 words, or over half of them in repeated windows of three. kept: not base_failed, and score >= threshold.
    Whole texts are read; null and empty ones have no words, and fail. Repeated rows are judged each; ids may be null; extra columns, whatever their names, are ignored; an
    empty table gives an empty one. Narrow: no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", _BLOCK):
            counts, x = statistics(W.utf8(b.column(1)))
            score, failed = model.score(x), base_failed(counts)
            yield pa.record_batch([b.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=["id", *COUNTS, "base_failed", "score", "kept"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean").withColumnRenamed("id", id_col)
