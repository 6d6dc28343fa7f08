"""Repeated passages, found by merging the Burrows-Wheeler transforms of shards.

How a corpus is cut into shards that can be merged alone: every window of `length` bytes has an anchor, the least hash of the grams in it.
Equal windows have equal anchors, so all windows that may be equal meet in the bucket of their anchor, as short segments of text around it. Anchors
that only one document has can't repeat and send nothing but a hash. In a bucket, the segments of each group of
senders are a shard: its suffixes are sorted once and give its transform. The shards' orders are then interleaved by refinement (after Holt
and McMillan, 2014): from an interleave that is right for the first h bytes, a pass through the last-to-first maps gives a longer one.
Borders between blocks show how long common prefixes are; at `length` bytes a block is a repeated interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm import packed
from filmspark.llm.common import text_bytes, written

_GRAM = 16
_GROUP_BYTES = 128 << 10
_SHARD_BYTES = 16 << 10
_BLOCK = 2 << 20
_PIECE = 1 << 17


def _table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


_BYTES = _table()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each window of `length` bytes: a function of its bytes alone."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    gram, h, size = 1, _BYTES[data], 1
    factor = int(_ODD)
    while gram * 2 <= min(_GRAM, length):
        h = h[:-gram] * np.uint64(factor) + h[gram:]
        factor = (factor * factor + 2) % (1 << 64)
        gram *= 2
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    span, n = length - gram + 1, len(h) - (length - gram)
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[span - size : span - size + n])


def runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text number, first window within the text, number of windows) of each run of windows with one anchor; texts are data[starts[i] : starts[i + 1]]."""
    base = data[starts[0] : starts[-1]]
    n = len(base) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    # a piece at a time, so that hashes of few bytes are held at once
    anchors = np.concatenate([window_anchors(base[k : k + _PIECE + length - 1], length) for k in range(0, n, _PIECE)])
    at = starts - starts[0]
    inside = np.ones(n, bool)
    for end in at[1:].tolist():
        inside[max(0, end - length + 1) : end] = False
    change = np.ones(n, bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    # a run ends where the next change is, or where its text has no further window
    stops = np.append(np.flatnonzero(change), n)
    end = stops[np.searchsorted(stops, first, side="right")]
    text = np.searchsorted(at, first, side="right") - 1
    end = np.minimum(end, at[text + 1] - length + 1)
    return anchors[first], text, first - at[text], end - first


_FIRST = np.array([((1 << 8 * (k + 1)) - 1) << 8 * (7 - k) for k in range(8)], np.uint64)


def shard_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order; `text` has bytes from 1 and a 0 after each segment, at `ends`. The zeros differ: that of an earlier segment is less."""
    n = len(text)
    stop = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))  # where each suffix's own zero is
    room = stop - np.arange(n)
    key = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        key = key[:-k] << np.uint64(8 * k) | key[k:]
    # the first eight bytes, and nothing past the suffix's own zero
    key = key[:n] & _FIRST[np.minimum(room, 7)]
    order, size = np.argsort(key, kind="stable"), 8
    same = np.zeros(n, bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (room[order[1:]] >= 8)
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(~same) - 1
        if not same.any():
            return order
        # only suffixes in undecided groups are sorted further, by the rank of what follows
        open_ = same.copy()
        open_[:-1] |= same[1:]
        part = order[open_]
        after = rank[np.minimum(part + size, stop[part])]
        place = np.flatnonzero(open_)
        by = np.lexsort((after, rank[part]))
        order[place] = part[by]
        r, a = rank[part][by], after[by]
        same = np.zeros(n, bool)
        same[place[1:]] = (r[1:] == r[:-1]) & (a[1:] == a[:-1])
        size *= 2


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """shards: (text, ends) as for shard_order. Returns all suffixes, as places in the concatenated texts, in the order of their first `depth` bytes, and
    border: for each, the step h at which it was told from the one before (they agree in h bytes and not in twice as many), -1 where they agree in `depth` bytes.

    Only the shards' transforms and last-to-first maps are read, and no suffix is sorted again. Given an interleave of the shards that is right for h bytes, and a map that goes back s <= h
    bytes, the suffixes that the map gives for the interleave in order are right for h + s bytes within each block of equal h bytes. So the first step
    deals by the transforms' own bytes, and each later one by blocks, with maps composed to twice the distance. Blocks of one suffix are done.
    """
    orders, bwts, maps, zeros, base, rows = [], [], [], [], 0, 0
    for text, ends in shards:
        order = shard_order(text, ends)
        before = np.where(order > 0, text[order - 1], 0)
        lf = np.full(len(order), -1, np.int32)
        # the k-th occurrence of a byte in the transform is the k-th suffix that starts with it
        by = np.argsort(before, kind="stable")
        n_zero = len(ends)
        lf[by[n_zero:]] = np.arange(n_zero, len(order)) + rows
        orders.append(order + base)
        bwts.append(before)
        maps.append(lf)
        zeros.append(np.arange(rows, rows + n_zero, dtype=np.int32))
        base += len(text)
        rows += len(order)
    order, bwt, back, zero = (np.concatenate(x) for x in (orders, bwts, maps, zeros))
    # one byte: the zeros in the order of their shards, then by the byte before each suffix
    kept = np.flatnonzero(bwt)
    by = kept[np.argsort(bwt[kept], kind="stable")]
    now = np.concatenate([zero, back[by]])
    border = np.ones(rows, bool)
    border[len(zero) + 1 :] = bwt[by][1:] != bwt[by][:-1]
    told = np.where(border, 0, -1).astype(np.int16)
    place, each = np.empty(rows, np.int32), np.arange(rows, dtype=np.int32)
    powers, h = [back], 1
    while h < depth:
        step = min(h, depth - h)
        block = np.maximum.accumulate(np.where(border, each, 0))
        alone = border & np.append(border[1:], True)
        if alone.all():
            break
        jump = _composed(powers, step)
        place[now] = each
        to = jump[now]
        from_block = block[to >= 0]
        to = to[to >= 0]
        at = place[to]
        open_ = ~alone[at]
        to, from_block, into = to[open_], from_block[open_], block[at[open_]]
        by = np.argsort(into, kind="stable")
        spots = np.flatnonzero(~alone)
        now[spots] = to[by]
        f = from_block[by]
        fresh = spots[1:][(f[1:] != f[:-1]) & ~border[spots[1:]]]
        border[fresh] = True
        told[fresh] = h
        h += step
    return order[now], told


def _composed(powers: list[np.ndarray], step: int) -> np.ndarray:
    """The map `step` bytes back, from maps 1, 2, 4, ... bytes back, which are added as needed."""
    out = None
    for k in range(step.bit_length()):
        if k == len(powers):
            p = powers[-1]
            powers.append(np.where(p >= 0, p[p], -1))
        if step >> k & 1:
            out = powers[k] if out is None else np.where(out >= 0, powers[k][out], -1)
    return out


def least_by_window(texts: list[bytes], docs: np.ndarray, shard: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the least document that has it in any segment: windows of all segments in a row, and where each segment's start."""
    cut = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    whole = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).copy()
    ends = cut[1:] - 1
    body = np.ones(len(whole), bool)
    body[ends] = False
    whole[body] += 1  # UTF-8 has no byte 255
    edges = [*shard, len(texts)]
    shards = [(whole[cut[a] : cut[b]], ends[a:b] - cut[a]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    place, told = merge_transforms(shards, length)
    sizes = np.maximum(np.diff(cut) - length, 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(cut))[place]
    offset = place - cut[owner]
    full = offset < sizes[owner]
    held = np.where(full, docs[owner], np.iinfo(np.int64).max)
    first = np.flatnonzero(told >= 0)
    least = np.minimum.reduceat(held, first)[np.cumsum(told >= 0) - 1]
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    out[(start[owner] + offset)[full]] = least[full]
    return out, start



def _by_document(ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    k = ids[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    for a, b in zip(first, np.append(first[1:], len(k)), strict=True):
        yield int(k[a]), values[order[a:b]]


def _u32(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.uint32).tobytes()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _unpacked(blob: pa.Scalar, id_col: str, text_col: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """The batch, its ids (null: 0), and its texts as bytes, empty where the id is null."""
    b = packed.unpacked(blob)
    ids = b.column(id_col).cast(pa.int64())
    text = b.column(text_col)
    data, at = text_bytes(pc.if_else(ids.is_valid(), text, pa.scalar(None, text.type)))
    return b, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), data, at


def _short(anchors: np.ndarray) -> np.ndarray:
    """32 bits of an anchor that its bucket doesn't fix. Two anchors that agree here only make a useless candidate."""
    return (anchors >> np.uint64(32)).astype(np.uint32)


def _bucket(anchors: np.ndarray, n_buckets: int) -> np.ndarray:
    return (anchors & np.uint64(0xFFFFFFFF)) % np.uint64(n_buckets)


def shared_anchors(held: DataFrame, id_col: str, text_col: str, length: int, partitions: int, hot_entries: int) -> DataFrame:
    """held: (block, batch). (block, keys): anchors of a block that another block has too; block null: anchors of at least `hot_entries` blocks.

    A block sends each anchor once, so a passage that a third of all documents hold costs its bucket one entry for each block. Anchors shared within a
    block need no answer.
    """
    n_buckets = partitions * packed.BUCKETS_EACH
    sent = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])
    told = pa.schema([("block", pa.int64()), ("keys", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, blob in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                _, _, data, at = _unpacked(blob, id_col, text_col)
                keys = np.unique(runs(data, at, length)[0])
                short = _short(keys)
                out = [(p, block, np.unique(short[s]).tobytes()) for p, s in packed.by_bucket(_bucket(keys, n_buckets), n_buckets)]
                if out:
                    yield _rows(out, sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for b in batches:
            for p, block, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), packed.raw(b.column(2), np.uint32), strict=True):
                by_bucket.setdefault(p, []).append((block, k))
        answers: dict[int, list] = {}
        for p in sorted(by_bucket):
            got = by_bucket.pop(p)
            k, n = np.unique(np.concatenate([x[1] for x in got]), return_counts=True)
            if (n >= hot_entries).any():
                yield _rows([(None, _u32(k[n >= hot_entries]))], told)
            shared = k[n > 1]
            for block, own in got:
                if len(both := own[np.isin(own, shared, assume_unique=True)]):
                    answers.setdefault(block, []).append(both)
        for block, got in answers.items():
            yield _rows([(block, _u32(np.concatenate(got)))], told)

    return packed.deal(held.mapInArrow(send, "bucket int, block long, keys binary"), partitions).mapInArrow(meet, "block long, keys binary")


_SEGMENTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("size", pa.int64()), ("segments", pa.binary()), ("spans", pa.binary())])


def _segments(held: DataFrame, id_col: str, text_col: str, length: int, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """held: (block, batch, keys: array of binary). The segments of shared anchors, packed and compressed by bucket: number of segments, then anchor, row, first window, windows and
    document of each, and their texts. And spans of rows that the block alone shows to be repeats: row, start, stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            for block, blob, told in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2).to_pylist(), strict=True):
                _, ids, data, at = _unpacked(blob, id_col, text_col)
                key, row, start, n = runs(data, at, length)
                if not len(key):
                    continue
                # anchors that two documents of the block share
                order = np.lexsort((ids[row], key))
                k, i = key[order], ids[row][order]
                own = np.unique(k[1:][(k[1:] == k[:-1]) & (i[1:] != i[:-1])])
                wanted = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in told or [])])
                keep = np.isin(_short(key), wanted) | np.isin(key, own)
                key, row, start, n = key[keep], row[keep], start[keep], n[keep]
                if len(hot) and len(key):
                    # anchors of very many blocks go on window by window, to the bucket of the window's bytes
                    big = np.isin(_short(key), hot)
                    each = n[big]
                    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    key = np.concatenate([key[~big], np.zeros(len(step), np.uint64)])
                    row = np.concatenate([row[~big], np.repeat(row[big], each)])
                    start = np.concatenate([start[~big], np.repeat(start[big], each) + step])
                    n = np.concatenate([n[~big], np.ones(len(step), np.int64)])
                doc = ids[row]
                raw, first = data.tobytes(), (at[row] + start).tolist()
                sizes = (n + length - 1).tolist()
                pieces: list = [b""] * len(key)
                seen: dict[bytes, int] = {}
                gone = np.zeros(len(key), bool)
                for i in np.argsort(doc, kind="stable").tolist():
                    pieces[i] = piece = raw[first[i] : first[i] + sizes[i]]
                    gone[i] = seen.setdefault(piece, doc[i]) != doc[i]
                for i in np.flatnonzero(key == 0).tolist():
                    key[i] = xxhash.xxh64_intdigest(pieces[i], 7)
                out = []
                left = np.flatnonzero(~gone)
                for p, s in packed.by_bucket(_bucket(key[left], n_buckets), n_buckets):
                    w = left[s]
                    body = b"".join([_u32(_short(key[w])), _u32(row[w]), _u32(start[w]), _u32(n[w]), np.ascontiguousarray(doc[w], np.int64).tobytes(), *(pieces[i] for i in w.tolist())])
                    out.append((p, block, len(w), pack.compress(body), None))
                if gone.any():
                    out.append((block % n_buckets, block, 0, None, _u32(np.stack([row[gone], start[gone], start[gone] + n[gone] + length - 1]))))
                for k in range(0, len(out), 64):
                    yield _rows(out[k : k + 64], _SEGMENTS)

    return held.select("block", "batch", "keys").mapInArrow(run, "bucket int, block long, size long, segments binary, spans binary")


def _groups(classes: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Classes, in the order of their anchors, cut between anchors into groups of about _GROUP_BYTES of text: equal windows have one anchor, and small arrays stay in the cache."""
    if not len(classes):
        return
    k, held = keys[classes], np.cumsum(sizes[classes])
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    part = (held - sizes[classes])[start] // _GROUP_BYTES
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, z in zip(cuts, np.append(cuts[1:], len(k)), strict=True):
        yield classes[a:z]


def _repeats(rows: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """One bucket. rows: (block, number of segments, packed segments). (block, [row, start, stop]) of the runs of windows that a smaller document has too.

    Equal segments are one class, with their least document. A class that is alone with its anchor has no other text to be merged with: equal windows have equal
    anchors. All others are merged, in groups of whole anchors, a shard for
    each 16 KB of new text.
    """
    unpack = zstandard.ZstdDecompressor()
    index: dict[bytes, int] = {}
    texts, docs, keys, came, of, cols, blocks_of = [], [], [], [], [], [], []
    for nth, (block, size, blob) in enumerate(rows):
        body = unpack.decompress(blob)
        key, row, start, n = np.frombuffer(body, np.uint32, 4 * size).reshape(4, size).astype(np.int64)
        doc = np.frombuffer(body, np.int64, size, 16 * size)
        at = 24 * size
        for m, d, k in zip((n + length - 1).tolist(), doc.tolist(), key.tolist(), strict=True):
            c = index.setdefault(body[at : at + m], len(texts))
            if c == len(texts):
                texts.append(body[at : at + m])
                docs.append(d)
                keys.append(k)
                came.append(nth)
            elif d < docs[c]:
                docs[c] = d
            of.append(c)
            at += m
        cols.append(np.stack([row, start, n, doc]))
        blocks_of.append(np.full(size, block))
    docs_, keys_, of_ = np.array(docs, np.int64), np.array(keys), np.array(of)
    row, start, n, doc = np.concatenate(cols, axis=1)
    block = np.concatenate(blocks_of)
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(docs_, windows)
    _, place, count = np.unique(keys_, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[place] > 1)
    for group in _groups(several[np.argsort(keys_[several], kind="stable")], keys_, windows + length - 1):
        # in the order in which they came, so that a shard holds the texts of some senders
        group = np.sort(group)
        shard, held = [0], 0
        for j, c in enumerate(group.tolist()):
            held += len(texts[c])
            if held > _SHARD_BYTES and j + 1 < len(group) and came[group[j + 1]] != came[c]:
                shard.append(j + 1)
                held = 0
        got, _ = least_by_window([texts[c] for c in group.tolist()], docs_[group], shard, length)
        w = windows[group]
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        least[np.repeat(first[group], w) + inner] = got
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = least[np.repeat(first[of_], n) + each] < np.repeat(doc, n)
    on = gone & ((each == 0) | ~np.concatenate([[False], gone[:-1]]))
    off = gone & ((each == np.repeat(n, n) - 1) | ~np.concatenate([gone[1:], [False]]))
    i = np.repeat(np.arange(len(n)), n)
    return block[i[on]], np.stack([row[i[on]], start[i[on]] + each[on], start[i[off]] + each[off] + length])


def repeated_spans(docs: DataFrame, length: int, id_col: str, text_col: str, hot_entries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of packed blocks, and (block, spans): arrays of packed (row, start, stop). Each byte in a span is covered by `length` bytes that also start in a document with a
    smaller id. Blocks without any don't appear."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    held = packed.packed_blocks(docs, text_col, _BLOCK)
    # a task's share stays the same as the input grows
    partitions = max(12, -(-total // (16 << 20)))
    n_buckets = partitions * packed.BUCKETS_EACH
    # at most about a million anchors have so many entries: their list has a proven bound
    hot_entries = hot_entries or max(10_000, total // 10_000_000)
    told = written(shared_anchors(held, id_col, text_col, length, partitions, hot_entries), "anchors")
    hot = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["keys"], np.uint32) for r in told.where("block is null").collect())])
    answers = told.where("block is not null").groupBy("block").agg(F.collect_list("keys").alias("keys"))
    sent = _segments(held.join(answers, "block", "left"), id_col, text_col, length, n_buckets, np.sort(hot))
    out = pa.schema([("block", pa.int64()), ("spans", pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for b in batches:
            for k, (p, block, size) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if b.column(4)[k].is_valid:
                    yield _rows([(block, b.column(4)[k].as_py())], out)
                else:
                    by_bucket.setdefault(p, []).append((block, size, b.column(3)[k].as_py()))
        answers: dict[int, list] = {}
        for p in sorted(by_bucket):
            block, spans = _repeats(by_bucket.pop(p), length)
            if not len(block):
                continue
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
            for a, z in zip(cuts, [*cuts[1:], len(block)], strict=True):
                answers.setdefault(int(block[order[a]]), []).append(spans[:, order[a:z]])
        for block, got in answers.items():
            yield _rows([(block, _u32(np.concatenate(got, axis=1)))], out)

    found = packed.deal(sent, partitions).mapInArrow(meet, "block long, spans binary")
    return held, found.groupBy("block").agg(F.collect_list("spans").alias("spans"))


def _by_row(packs: list[bytes] | None, rows: int) -> list[np.ndarray]:
    """Disjoint (start, stop) spans of each row of a block."""
    s = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(x, np.uint32).reshape(3, -1).astype(np.int64) for x in packs or [])], axis=1)
    s = s[:, np.argsort(s[0], kind="stable")]
    cuts = np.searchsorted(s[0], np.arange(rows + 1))
    return [merged(s[1:, a:z].T) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def merged(s: np.ndarray) -> np.ndarray:
    """Disjoint (start, stop) rows in order, from rows in any order; touching ones become one."""
    if not len(s):
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    first = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    return np.stack([s[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)]], axis=1)


def _without(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_entries: int | None = None) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 of every row, removed bytes being those of repeated_spans.

    Texts are whole and in UTF-8; null ones are empty. Windows never cross rows; what is removed is judged on the input. Rows with one id are one document: they
    never make each other's bytes repeats. Rows with a null id are kept whole and make nothing a repeat. An empty table gives an empty one.
    """
    held, spans = repeated_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), length, "id", "text", hot_entries)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for blob, packs in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
                b = packed.unpacked(blob)
                data, at = text_bytes(b.column("text"))
                out = []
                for i, s in enumerate(_by_row(packs, b.num_rows)):
                    text = data[at[i] : at[i + 1]].tobytes()
                    out.append((len(text), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(_without(text, s)).hexdigest()))
                yield pa.record_batch([b.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True))], schema=schema)

    joined = held.join(spans, "block", "left").select("batch", "spans")
    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, with repeated passages cut from the texts; a cut never splits a character. Null texts stay null, and rows with null ids stay as they are."""
    held, spans = repeated_spans(docs, length, id_col, text_col)

    def cut(text: bytes, s: np.ndarray) -> str:
        lead = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
        whole = np.append(np.flatnonzero(lead), len(text))
        s = np.stack([whole[np.searchsorted(whole, s[:, 0])], whole[np.searchsorted(whole, s[:, 1], side="right") - 1]], axis=1)
        return _without(text, s[s[:, 0] < s[:, 1]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for blob, packs in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
                b = packed.unpacked(blob)
                old = b.column(text_col)
                texts = [cut(t.as_py().encode(), s) if len(s) else t.as_py() for t, s in zip(old, _by_row(packs, b.num_rows), strict=True)]
                yield b.set_column(b.schema.get_field_index(text_col), text_col, pa.array(texts, old.type))

    return held.join(spans, "block", "left").select("batch", "spans").mapInArrow(run, docs.schema)
