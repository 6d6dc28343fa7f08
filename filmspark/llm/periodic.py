"""Periodic runs of words: stretches that repeat a period, found by lag scans for short periods and by minimizers at growing scales for long ones."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm import words as W
from filmspark.llm.common import blocks

_BLOCK = 2 << 20
#: Periods below this are found by comparing the words with themselves shifted, one lag at a time.
_LAGS = 16


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of consecutive numbers in an ascending array."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)] + 1


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class _Found:
    """Runs so far, in the order of their periods."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.start = self.stop = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> None:
        """Stretches with these periods, none of which can be extended. Those that are too short, or that a run so far holds, are none: their smallest period is another, and as that divides
        theirs it is at most half of it. So stretches whose periods lie within a factor of two can come together."""
        long = stop - start >= np.maximum(self.least, 2 * period)
        start, stop, period = start[long], stop[long], period[long]
        if not len(start):
            return
        if len(self.start):
            order = np.argsort(self.start, kind="stable")
            reach = np.maximum.accumulate(self.stop[order])
            k = np.searchsorted(self.start[order], start, side="right") - 1
            new = (k < 0) | (reach[k] < stop)
            start, stop, period = start[new], stop[new], period[new]
        self.start, self.stop, self.period = np.append(self.start, start), np.append(self.stop, stop), np.append(self.period, period)


def _minimizers(at: np.ndarray, grams: np.ndarray, w: int) -> np.ndarray:
    """Places in `at` (ascending) of the least gram, the first of equals, of every window of `w` consecutive positions that are all in `at`."""
    n = len(at)
    if n < w:
        return np.zeros(0, np.int64)
    # rank of (gram, position): ties go to the first
    rank = np.empty(n, np.int64)
    rank[np.argsort(grams, kind="stable")] = np.arange(n)
    low, have = rank, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    whole = at[w - 1 :] - at[: n - w + 1] == w - 1
    back = np.empty(n, np.int64)
    back[rank] = np.arange(n)
    return np.unique(back[low[whole]])


def _seeds(at: np.ndarray, grams: np.ndarray, scale: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, lag) of equal minimizers with a lag in [scale, 2 * scale).

    Minimizers that follow each other by at most half a gram lie in one stretch with a shorter period, a cluster, at even distances: pairs inside a cluster have lags that aren't
    smallest periods, and pairs of two clusters take all their lags already with the first position of either. So the pairs are few for each minimizer, however
    repetitive a text is.
    """
    order = np.lexsort([at, grams])
    p, g = at[order], grams[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] - p[:-1] > gram // 2)])
    head = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    first, size = p[head], np.diff(np.append(head, len(p)))
    last, key = p[head + size - 1], g[head]
    k = 1
    while k < len(head):
        a, b = np.arange(len(head) - k), np.arange(k, len(head))
        near = (key[a] == key[b]) & (first[b] - last[a] < 2 * scale)
        if not near.any():
            return
        a, b = a[near], b[near]
        for mine, other, sign in ((a, b, 1), (b, a, -1)):
            # every member of one cluster with the first of the other
            of = np.repeat(np.arange(len(mine)), size[mine])
            member = p[np.repeat(head[mine], size[mine]) + np.arange(len(of)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])]
            lag = sign * (first[other][of] - member)
            fits = (lag >= scale) & (lag < 2 * scale)
            yield np.minimum(member, first[other][of])[fits], lag[fits]
        k += 1


def _reach(ids: np.ndarray, a: int, lag: int, step: int) -> int:
    """How many words from a on (step 1), or before a (step -1), equal those `lag` further."""
    n, size = 0, 64
    while True:
        if step > 0:
            x = ids[a + n : a + n + size]
            y = ids[a + n + lag : a + n + lag + size]
            x = x[: len(y)]
        else:
            lo = max(0, a - n - size)
            x = ids[lo : a - n][::-1]
            y = ids[lo + lag : a - n + lag][::-1]
        if not len(x):
            return n
        differ = x != y
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n += len(x)
        size *= 4


def runs(ids: np.ndarray, at: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of the runs of several texts, in the order of starts and periods. ids: words as numbers, one text after the other; at: offsets of the texts.

    A run is a stretch whose words repeat with smallest period q, that is at least max(`least`, 2 q) words long, and that no word beside it continues. Periods of 1 to 15 come from
    comparing lags. A run with a period q of [s, 2 s) holds two copies of at least q words, so a window of s - 1 words lies in both at distance q, and both have the same
    minimizer; s is 16, 32, ... Grams are s / 2 words, known by hashes that are doubled from scale to scale; only grams that a text has twice can be seeds, which leaves
    little of ordinary texts at the first scale. Seeds on one lag that overlap are one stretch; its ends are found by comparing words.
    """
    n_docs = len(at) - 1
    if not len(ids):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    # a number of its own after each text keeps runs inside texts
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    x = np.full(len(ids) + n_docs, -1, np.int64)
    x[np.arange(len(ids)) + doc] = ids
    x[at[1:] + np.arange(n_docs)] = int(ids.max()) + 1 + np.arange(n_docs)
    found = _Found(least)
    longest = int(np.diff(at).max())
    small = x.astype(np.int32) if int(x.max()) < 1 << 31 else x
    for lag in range(1, min(_LAGS, longest // 2 + 1)):
        start, stop = _stretches(np.flatnonzero(small[:-lag] == small[lag:]))
        found.add(start, stop + lag, np.full(len(start), lag))
    grams, size = _mixed(x.astype(np.uint64), np.uint64(0x2545F4914F6CDD1D)), 1
    places = np.arange(len(x))
    scale = _LAGS
    while scale <= longest // 2:
        while size < scale // 2:
            # positions whose gram and the next one are still there
            k = np.searchsorted(places, places + size)
            whole = np.append(places, -1)[k] == places + size
            grams, places = _mixed(grams[whole], grams[k[whole]]), places[whole]
            size *= 2
        # no need to mix the text into the hashes: a gram that several texts have is an idle seed
        twice = W.repeated_at(grams)
        grams, places = grams[twice], places[twice]
        if not len(places):
            break
        m = _minimizers(places, grams, scale // 2)
        got = list(_seeds(places[m], grams[m], scale, size)) if len(m) else []
        seed, lag = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (places[:0], places[:0])
        if len(seed):
            order = np.lexsort([seed, lag])
            seed, lag = seed[order], lag[order]
            fresh = np.concatenate([[True], (lag[1:] != lag[:-1]) | (seed[1:] - seed[:-1] > size)])
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(seed)) - 1
            by_lag: dict[int, list[tuple[int, int]]] = {}
            for q, a, z in zip(lag[head].tolist(), seed[head].tolist(), seed[tail].tolist(), strict=True):
                have = by_lag.setdefault(q, [])
                # seeds come in order: the last stretch may hold this one already
                if not have or z + q >= have[-1][1]:
                    have.append((a - _reach(x, a, q, -1), z + _reach(x, z, q, 1) + q))
            ends = np.array([(a, z, q) for q, have in by_lag.items() for a, z in have], np.int64)
            found.add(*ends.T)
        scale *= 2
    order = np.lexsort([found.period, found.start])
    start, stop, period = found.start[order], found.stop[order], found.period[order]
    shift = np.searchsorted(at[1:] + np.arange(1, n_docs + 1), start, side="right")
    return start - shift, stop - shift, period


def kept_words(n: int, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    return np.cumsum(change[:-1]) == 0


def _each(batches: Iterator[pa.RecordBatch], least: int, spun: bool) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of (id, text), and of each row: words by number, their start in the slice, start, stop and period of its runs, and which words stay; last the words by number."""
    for b in blocks(batches, "text", _BLOCK):
        ids, at, names = W.word_ids(W.utf8(b.column("text")))
        if spun:
            ids = ids.copy()
            for i, ident in enumerate(b.column("id").to_pylist()):
                spin(ids[at[i] : at[i + 1]], ident)
        start, stop, period = runs(ids, at, least)
        stay = kept_words(len(ids), start, stop, period)
        cuts = np.searchsorted(start, at)
        yield b, [(ids[a:z], start[s:e] - a, stop[s:e] - a, period[s:e], stay[a:z]) for a, z, s, e in zip(at[:-1], at[1:], cuts[:-1], cuts[1:], strict=True)], names


def spin(ids: np.ndarray, ident: object) -> None:
    """Plants a run in the words of a tenth of the documents, in place: from a word on, the words that follow are a period over again. The id's CRC-32 picks documents, place and period."""
    h, n = zlib.crc32(("null" if ident is None else str(ident)).encode()), len(ids)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ids[a:] = ids[a + np.arange(n - a) % p]


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a run: id_col, start (word number), length, period. Words are runs of anything but ASCII white space; texts are whole. Texts without runs, null and empty ones
    give no rows; repeated rows give their runs each; ids may be null; extra columns are ignored; an empty table gives an empty one. Narrow: no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows, _ in _each(batches, least, False):
            counts = np.array([len(r[1]) for r in rows], np.int64)
            ids = b.column("id").take(pa.array(np.repeat(np.arange(len(rows)), counts)))
            cat = lambda k: np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)])
            yield pa.record_batch([ids, pa.array(cat(1)), pa.array(cat(2) - cat(1)), pa.array(cat(3))], names=["id", "start", "length", "period"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, start long, length long, period long").withColumnRenamed("id", id_col)


def collapsed_texts(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, n_dropped: of each run only the first period stays. Texts that lose nothing stay as they are, null ones too; others are their words joined by one space. Repeated rows are cut each;
    an empty table gives an empty one. Narrow: no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows, names in _each(batches, least, False):
            dropped = [int((~r[4]).sum()) for r in rows]
            texts = [b" ".join(names.take(pa.array(r[0][r[4]])).to_pylist()).decode() if n else t.as_py() for r, n, t in zip(rows, dropped, b.column("text"), strict=True)]
            yield pa.record_batch([b.column("id"), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=["id", "text", "n_dropped"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, text string, n_dropped long").withColumnRenamed("id", id_col)


def _joined(names: pa.Array, ids: np.ndarray) -> str:
    """SHA-256 of words joined by one space, a part of them at a time."""
    digest = hashlib.sha256()
    for k in range(0, len(ids), 1 << 17):
        if k:
            digest.update(b" ")
        digest.update(b" ".join(names.take(pa.array(ids[k : k + (1 << 17)])).to_pylist()))
    return digest.hexdigest()


def run_digests(docs: DataFrame, planted: bool = False, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period; no run: nulls), runs_sha256 of all runs' lines
    `start,length,period` by start and period, collapsed_sha256 of the words that stay when each run keeps its first period only, joined by one space. One row for each row.

    planted: documents get a run of their own first, see spin(). Null and empty texts have no words and no runs; texts are whole; repeated rows give equal rows; null ids count
    as the text "null"; extra columns are ignored; an empty table gives an empty one. Narrow: no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    longs = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows, names in _each(batches, least, planted):
            out = []
            for ids, start, stop, period, stay in rows:
                length = stop - start
                best = (None,) * 4
                if len(start):
                    k = int(np.lexsort([period, start, -length])[0])
                    s, n, q = int(start[k]), int(length[k]), int(period[k])
                    best = (s, n, q, 1000 * n // q)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                out.append((len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), _joined(names, ids[stay])))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([b.column("id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=["id", *longs, "runs_sha256", "collapsed_sha256"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in longs)}, runs_sha256 string, collapsed_sha256 string").withColumnRenamed("id", id_col)
