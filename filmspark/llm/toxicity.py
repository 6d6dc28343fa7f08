"""A toxicity classifier whose scores don't hang on which group a text mentions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that name groups of people; terms of one row stand in for each other.
IDENTITY_TERMS = [
    ["men", "women"], ["man", "woman"], ["boys", "girls"], ["boy", "girl"], ["he", "she"], ["him", "her"], ["male", "female"], ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"],
    ["black", "white", "asian", "latino"], ["african", "european", "american", "arab"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["immigrant", "native"], ["immigrants", "natives"], ["old", "young"], ["blind", "deaf", "disabled"],
    ["männer", "frauen"], ["mann", "frau"], ["jungen", "mädchen"], ["muslime", "christen", "juden"], ["schwarze", "weiße"], ["ausländer", "deutsche"],
    ["hommes", "femmes"], ["homme", "femme"], ["garçons", "filles"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs"],
    ["hombres", "mujeres"], ["hombre", "mujer"], ["niños", "niñas"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos"],
]
SWAP = {term: row[(k + 1) % len(row)] for row in IDENTITY_TERMS for k, term in enumerate(row)}
_WORDS = re.compile(r"[^\W_]+|[^\w\s]{2,}")
_PART = 1 << 20


def tokens(text: str) -> set[str]:
    """The distinct lower-case words and runs of at least two symbols of a whole text."""
    if len(text) <= _PART:
        return set(_WORDS.findall(text.lower()))
    found: set[str] = set()
    at = 0
    while at < len(text):
        end = at + _PART
        while end < len(text) and not text[end].isspace():
            end += 1
        found.update(_WORDS.findall(text[at:end].lower()))
        at = end
    return found


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def word_features(word: str) -> list[str]:
    """The word, and its runs of 4 to 6 letters, the word's start being marked; insults come with many endings."""
    marked = "^" + word
    return [word, *(marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1))]


def features(words: set[str]) -> set[str]:
    return set().union(*map(word_features, words))


#: Words whose features a task remembers.
_REMEMBERED = 200_000


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of at most `max_features` words and parts of words, and a bias."""

    weights: dict[str, float]
    bias: float
    _of: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    def score(self, text: str) -> float:
        found: set[str] = set()
        for w in tokens(text):
            got = self._of.get(w)
            if got is None:
                got = tuple(f for f in word_features(w) if f in self.weights)
                if len(self._of) >= _REMEMBERED:
                    self._of.clear()
                self._of[w] = got
            if got:
                found.update(got)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _counts(texts: DataFrame) -> DataFrame:
    """texts: (y, text). (word, n, p): in how many texts, and in how many of label 1, a feature occurs; summed by batch already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part, n, p = b.slice(k, 500), Counter(), Counter()
                for y, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = features(tokens(t.as_py() or ""))
                    n.update(found)
                    if y:
                        p.update(found)
                yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([p[w] for w in n], pa.int64())], names=["word", "n", "p"])

    return texts.mapInArrow(run, "word string, n long, p long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def _places(texts: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """texts: (y, text). (y, x, c): places in the vocabulary of a text's features, and of those of its counterfactual, null if they are the same."""
    of = lambda words: sorted(vocabulary[f] for f in features(words) if f in vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                found = [tokens(t.as_py() or "") for t in b.column(1)]
                own, twin = [of(x) for x in found], [of(swapped(x)) for x in found]
                other = [None if a == c else c for a, c in zip(own, twin, strict=True)]
                yield pa.record_batch([b.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["y", "x", "c"])

    return texts.mapInArrow(run, "y int, x array<int>, c array<int>")


def fit_weights(y: np.ndarray, rows: list[np.ndarray], twins: list[np.ndarray | None], n_features: int, penalty: float, ridge: float, positive: float = 3.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on word presence with penalty * mean((z - z')^2), z' the margin of the text with its identity terms swapped.
    Rows of label 1, the rarer one, count `positive` times. Adam on all rows at once."""
    sizes = np.array([len(r) for r in rows], np.int64)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    col = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)
    pairs = [i for i in range(len(rows)) if twins[i] is not None]
    dat = np.concatenate([*(np.full(len(rows[i]) + len(twins[i]), k, np.int32) for k, i in enumerate(pairs)), np.zeros(0, np.int32)])
    dcol = np.concatenate([*(np.concatenate([rows[i], twins[i]]) for i in pairs), np.zeros(0, np.int32)]).astype(np.int32)
    dval = np.concatenate([*(np.concatenate([np.ones(len(rows[i])), -np.ones(len(twins[i]))]) for i in pairs), np.zeros(0)])
    weight = np.where(y > 0, positive, 1.0)
    w, b, n = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), max(1, len(y))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(at, w[col], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(col, g[at], n_features) / n + ridge * w
        if len(pairs):
            d = np.bincount(dat, dval * w[dcol], len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(dcol, dval * d[dat], n_features)
        both = np.append(grad, g.sum() / n)
        m, v = 0.9 * m + 0.1 * both, 0.999 * v + 0.001 * both**2
        step = 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = 8_000, max_features: int = 1024, penalty: float = 1.0, ridge: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most `max_rows` labelled documents (a hash of the id picks them where there are more), with at most `max_features` words and parts of words.

    learn: a condition on id_col; rows of labels that don't meet it are never looked at. Word counts by label are aggregated in Spark; the words with the largest
    chi-square stay. Their number was chosen on a fifth of the training rows, held back for that. The bounded matrix is then fitted on the driver. Null labels, null ids and labels without a document teach nothing; without any
    labelled row, or with empty tables, the model scores every text 0. An id that is labelled twice counts with its larger label; one that has several documents teaches with each.
    """
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if learn is not None:
        picked = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    picked = picked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(max_rows)
    # at most max_rows ids: a proven bound for the broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("y", "text")
    texts = texts.persist()
    try:
        totals = texts.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
        if not totals.n:
            return ToxicityModel({}, -1e3)
        counts = _counts(texts)
        n, p = float(totals.n), float(totals.p)
        expected = F.col("n") * p / n
        chi = (F.col("p") - expected) ** 2 / (expected * (1 - F.col("n") / n) + 0.5)
        words = [r["word"] for r in counts.where("n >= 3").orderBy(chi.desc(), "word").limit(max_features).select("word").collect()]
        vocabulary = {w: i for i, w in enumerate(words)}
        got = _places(texts, vocabulary).toPandas()
    finally:
        texts.unpersist()
    order = sorted(range(len(got)), key=lambda i: (got.y[i], list(got.x[i])))  # the same sums in any run
    y = got.y.to_numpy(float)[order]
    w, b = fit_weights(y, [np.asarray(got.x[i], np.int32) for i in order], [None if got.c[i] is None else np.asarray(got.c[i], np.int32) for i in order], len(words), penalty, ridge)
    return ToxicityModel({k: float(x) for k, x in zip(words, w, strict=True)}, b)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), predicted (1 if score >= 0.5). Reads whole texts; null ones count as empty and get the bias's score. Narrow: no shuffle. Extra columns, whatever their names, are
    ignored; repeated rows are scored each; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t.as_py() or "") for t in b.column(1)], np.float64)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def is_toxic(text: Column, model: ToxicityModel, threshold: float = 0.5) -> Column:
    """Whether a whole text scores at least `threshold`; a null text counts as empty. Repeated rows are judged each; of an empty table there is nothing to judge."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(t or "") >= threshold).astype(bool)

    return run(F.coalesce(text, F.lit("")))


def remainder(ident: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % parts
