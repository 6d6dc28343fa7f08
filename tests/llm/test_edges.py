"""Rows and columns that operators meet rarely: ids of other types, names that clash, streams that expand without bound."""

import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmspark.llm import feistel, packed, tiff, warc


def test_shards_of_text_ids(spark):
    rows = [(f"id-{i % 40:02d}" if i % 3 else None, f"text {i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = feistel.shard_documents(df, shards=6).collect()
    order = sorted(((i is not None, i or "", zlib.crc32(t.encode()), len(t) + 16) for i, t in rows))
    p = feistel.permute(np.arange(200), 200, 7).tolist()
    want = sorted((i if ok else None, size, crc, x % 6, x // 6) for (ok, i, crc, size), x in zip(order, p, strict=True) if ok)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got if r.doc_id is not None) == want
    # rows without an id share the first places among themselves
    assert sorted((r.shard, r.slot) for r in got if r.doc_id is None) == sorted((x % 6, x // 6) for x in p[: sum(i is None for i, _ in rows)])


def test_row_numbers_of_clashing_columns(spark):
    df = spark.createDataFrame([(3, 9), (1, 8), (None, 7), (1, 8)], "a int, row_number long")
    numbered, n = feistel.row_numbers(df, ["a"])
    assert n == 4 and sorted((r.row_number, r.a) for r in numbered.collect()) == [(0, None), (1, 1), (2, 1), (3, 3)]
    # one key for all rows doesn't make one range: ranges are cut by place too
    hot, n = feistel.row_numbers(spark.range(1000).select(F.lit(1).alias("a")), ["a"])
    assert n == 1000 and sorted(r.row_number for r in hot.collect()) == list(range(1000))
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_tiff_pages_names_that_clash(spark):
    files = spark.createDataFrame([(1, b"", "x")], "id int, media binary, Page string")
    with pytest.raises(ValueError, match="can't be kept"):
        tiff.tiff_pages(files, "id", "media", ["Page"])
    with pytest.raises(ValueError, match="can't be kept"):
        tiff.tiff_pages(files, "id", "media", ["ID"])
    assert [(r.id, r.page) for r in tiff.tiff_pages(files.union(files), "id", "media").collect()] == [(1, -1), (1, -1)]
    assert tiff.tiff_pages(files.limit(0), "id", "media").count() == 0


def test_warc_of_text_ids(spark):
    html = "<p>" + "x" * 1200
    rows = [("a/1 >\r\nb", "u", html), ("é", "u", html), ("zz", "u", html), (None, "u", "short"), ("", "u", "short"), ("dup", None, None), ("dup", None, None)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(((r.page_id is not None, r.page_id or "", r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted(
        [(True, "a/1 >\r\nb", "revisit", "é", 1203), (True, "é", "response", None, 1203), (True, "zz", "revisit", "é", 1203), (False, "", "response", None, 5), (True, "", "response", None, 5), *[(True, "dup", "response", None, 0)] * 2], key=str
    )


def test_inflate_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "_MOST", 1000)
    monkeypatch.setattr(warc, "_PIECE", 37)
    parts = [bytes(500_000), b"abc" * 1000, b"", bytes(range(256)) * 9]
    data = b"".join(gzip.compress(p) for p in parts)
    pieces = list(warc.inflate(data))
    assert b"".join(pieces) == b"".join(parts) and max(map(len, pieces)) <= 1000
    for cut in (5, len(data) - 3):
        with pytest.raises(ValueError):
            list(warc.inflate(data[:cut]))


def test_buckets_cost_what_is_in_them():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    for n in (1, 7, 14_300, 10_000_000):
        got = list(packed.by_bucket(keys, n))
        assert [k for k, _ in got] == sorted(set((keys % np.uint64(n)).tolist()))
        assert all((keys[at] % np.uint64(n) == k).all() and (np.diff(at) > 0).all() for k, at in got) and sum(len(at) for _, at in got) == len(keys)
    assert list(packed.by_bucket(keys[:0], 10_000_000)) == []
    import time

    began = time.perf_counter()
    for _ in range(20):
        list(packed.by_bucket(keys, 10_000_000))
    # one number for each bucket would take seconds a call
    assert time.perf_counter() - began < 10
