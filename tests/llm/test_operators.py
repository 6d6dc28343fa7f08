"""Each operator against a plain restatement of its contract on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from filmspark.llm import components as cc
from filmspark.llm import feistel, mixing, nndescent, pst, simhash, suffix, tiff, toxicity, viterbi, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, id int, fp string, key double, keys string, component string, spans string"


def words(rng, n):
    return " ".join("".join(rng.choice(["on", "ta", "re", "li", "sh", "éa", "the", "und"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(20, 120)) for _ in range(30)]
    passage = words(rng, 60)
    out = dict(enumerate(base))
    for i in range(30, 45):
        out[i] = base[i % 6]
    for i in range(45, 60):
        w = base[7].split()
        w[i % len(w)] = "changed"
        out[i] = " ".join(w)
    for i in range(60, 70):
        out[i] = words(rng, 10) + " " + passage + "\n" + words(rng, 10)
    out |= {70: "", 71: None, 72: "a", 73: "A B", 74: "a  b\t", 75: " \n\t ", 76: "x" * 20_000, 77: "ab" * 3000, 78: passage, 79: "▁ éß\U0001f600 \x00"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts.items()], DOCS).repartition(5).cache()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def fingerprint(text):
    w = low(text).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def closure(ids, linked):
    least = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if linked(a, b) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    again = True
    return least


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.component for r in cc.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    some = {(a, b) for a, b in pairs if None not in (a, b) and a != b}
    ids = sorted({x for p in some for x in p})
    assert got == closure(ids, lambda a, b: (a, b) in some)
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [256, 2])
def test_simhash(spark, docs, texts, most):
    got = {r.doc_id: r for r in simhash.simhash_groups(docs, most_in_group=most).collect()}
    f = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in f.items()}
    assert {i: r.component_id for i, r in got.items()} == closure(list(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 2)


def test_simhash_pairs_are_complete(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(rng.randint(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (256, 3):
        assert {(r.u, r.v) for r in simhash.close_pairs(df, most).collect()} == want


def test_simhash_edge_tables(spark):
    empty = spark.createDataFrame([], EXTRA)
    assert simhash.simhash_groups(empty).count() == 0
    rows = [(1, "a b c", 1, "x", 0.0, "", "", ""), (1, "a b c", 2, "y", 0.0, "", "", ""), (None, "a b c", 3, "z", 0.0, "", "", "")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, EXTRA)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1)]


def test_long_texts_go_in_parts():
    text = words(random.Random(1), 5000).encode()
    assert [w for p in simhash.word_parts(text, 100) for w in p] == text.lower().split()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    p = feistel.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert (feistel.permute(np.arange(n)[::-1].copy(), n, 7) == p[::-1]).all()


def test_shards(spark, docs, texts):
    got = feistel.shard_documents(docs, shards=8).collect()
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(8)}
    assert all(s == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted(got, key=lambda r: r.doc_id)
    p = feistel.permute(np.arange(len(got)), len(got), 7)
    assert [(r.shard, r.slot) for r in order] == [(x % 8, x // 8) for x in p.tolist()]
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    again = {r.doc_id: (r.shard, r.slot) for r in feistel.shard_documents(docs.repartition(3), shards=8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_shards_edge_tables(spark):
    assert feistel.shard_documents(spark.createDataFrame([], EXTRA)).count() == 0
    rows = [(None, None, 1, "", 0.0, "", "", "")] * 3 + [(5, "a", 1, "", 0.0, "", "", "")] * 50
    got = feistel.shard_documents(spark.createDataFrame(rows, EXTRA), shards=4).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 4, i // 4) for i in range(53))


@pytest.mark.parametrize("pack,unpack", [(tiff.pack_bits, tiff.unpack_bits), (tiff.lzw_encode, tiff.lzw_decode)])
def test_tiff_codecs(pack, unpack):
    rng = random.Random(2)
    cases = [b"", b"a", b"aa", b"aaa", b"ab" * 5000, b"\xff" * 1000, bytes(rng.randrange(256) for _ in range(30_000)), bytes(rng.choice(b"ab") for _ in range(20_000))]
    cases += [bytes(rng.randrange(256) for _ in range(n)) for n in range(250, 262)] + [b"x" * 127 + b"y" * 129 + b"zz", words(rng, 9000).encode()]
    for x in cases:
        assert unpack(pack(x)) == x
    assert tiff.lzw_encode(b"aaa")[:2] == bytes([0x80, 0x18])  # clear code, then 97 in 9 bits


def test_tiff_pages(spark):
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((1, 1), (7, 96), (200, 33), (64, 64))]
    files = [tiff.encode_tiff(pages, c, p, t) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (None, (16, 32))]
    big = bytearray(b"MM\0*\0\0\0\x08" + b"\0\x07")
    for tag, kind, v in ((256, 3, 2), (257, 3, 1), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 98), (279, 4, 2)):
        big += tag.to_bytes(2) + kind.to_bytes(2) + (1).to_bytes(4) + (v.to_bytes(2) + b"\0\0" if kind == 3 else v.to_bytes(4))
    big += b"\0\0\0\0" + b"hi"
    files += [bytes(big), None, b"", b"nope", files[0][:60]]
    df = spark.createDataFrame([(i, f, "kept") for i, f in enumerate(files)], "id int, media binary, width string")
    got = tiff.tiff_pages(df, "id", "media").collect()
    for i in range(16):
        mine = [r for r in got if r.id == i]
        assert [r.page for r in mine] == [0, 1, 2, 3]
        for r, p in zip(mine, pages, strict=True):
            assert (r.height, r.width) == p.shape and bytes(r.pixels) == p.tobytes() and r.error is None
    assert [bytes(r.pixels) for r in got if r.id == 16] == [b"hi"]
    assert all(r.page == -1 and r.error for r in got if r.id > 16) and {r.id for r in got} == set(range(21))


def test_damaged_tiff_files_give_error_rows(spark):
    page = np.arange(60, dtype=np.uint8).reshape(6, 10)
    good = tiff.encode_tiff([page], tiff.DEFLATE, 1, None, 4)
    at = int.from_bytes(good[4:8], "little") + 2

    def with_tag(tag, value):
        b = bytearray(good)
        k = next(k for k in range(10) if int.from_bytes(b[at + 12 * k : at + 12 * k + 2], "little") == tag)
        b[at + 12 * k + 8 : at + 12 * k + 12] = value.to_bytes(4, "little")
        return bytes(b)

    files = [good, b"II*\0", b"MM\0*\0", with_tag(tiff.WIDTH, 0), with_tag(tiff.HEIGHT, 0), with_tag(tiff.WIDTH, (1 << 31) - 1), with_tag(tiff.HEIGHT, (1 << 32) - 1), with_tag(tiff.ROWS_PER_STRIP, 0), with_tag(tiff.ROWS_PER_STRIP, 1)]
    files += [good[:k] for k in range(0, len(good), 7)]
    df = spark.createDataFrame([(i, f, "e") for i, f in enumerate(files)], "id short, media binary, error string")
    got = {int(r.id): r for r in tiff.tiff_pages(df.select("id", "media"), "id", "media").collect()}
    assert len(got) == len(files) and bytes(got[0].pixels) == page.tobytes()
    assert all(r.page == -1 and r.error and r.pixels is None for i, r in got.items() if i)


def test_tiff_round_trip_of_repeats_and_other_ids(spark):
    rows = [("a", "x" * 700), ("a", "x" * 700), (None, None), ("b", "")]
    for kind, ident in (("string", str), ("short", lambda x: None if x is None else ord(x)), ("double", lambda x: None if x is None else float(ord(x)))):
        df = spark.createDataFrame([(None if i is None else ident(i), t, 1) for i, t in rows], f"doc_id {kind}, text string, media int")
        got = tiff.tiff_round_trip(df).drop("doc_id").collect()
        assert len(got) == 4 and len(set(got)) == 2
        assert dict(tiff.tiff_round_trip(df).dtypes)["doc_id"] == dict(df.dtypes)["doc_id"]


def test_every_codec_is_used():
    rng = random.Random(4)
    seen = {(tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tiff.TILE_WIDTH in tags) for _ in range(200) for tags, _ in tiff.read_pages(tiff.payload_tiff(rng.randbytes(576)))}
    assert len(seen) == 12


def test_tiff_round_trip(spark, docs, texts):
    got = {r.doc_id: r for r in tiff.tiff_round_trip(docs).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = (t or "").encode()
        pay = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        media = tiff.payload_tiff(pay)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[30].feature == got[0].feature
    assert tiff.tiff_round_trip(spark.createDataFrame([], EXTRA)).count() == 0


def test_warc_bytes():
    recs = [(warc.header_bytes([("WARC-Type", "response"), ("Content-Length", str(len(p)))]), p) for p in (b"", b"\r\n\r\nWARC/1.1", b"x" * 300_000)]
    whole = b"".join(h + p + b"\r\n\r\n" for h, p in recs)
    one = warc.member(whole)
    two = warc.member(whole[:100]) + warc.member(whole[100:])
    for content in (one, two):
        data, index = warc.normalise_bytes(content)
        assert [warc.read_record(data, o, n)[1] for o, n, _ in index] == [p for _, p in recs]
        assert b"".join(warc.inflate(data)) == whole
        assert warc.normalise_bytes(data)[0] == data
    for bad in (one[:-9], b"junk", warc.member(whole[:-50]), warc.member(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            warc.normalise_bytes(bad)


def test_warc_query(spark):
    big = ["p" * 1000, "q" * 999, "r" * 5000, None, ""]
    rows = [(i, f"http://x/{i}\r\nEvil: 1", big[i % 5]) for i in range(40)] + [(None, None, "n" * 1000), (41, None, "p" * 1000), (41, "u", "p" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.warc_round_trip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        pay = (dict((i, h) for i, _, h in rows if i is not None).get(r.page_id, "n" * 1000) or "").encode()
        same = [i for i, _, h in rows if i is not None and (h or "").encode() == pay]
        top = max(same, default=None)
        revisit = len(pay) >= 1000 and r.page_id is not None and r.page_id < top
        assert (r.payload_bytes, r.payload_digest) == (len(pay), hashlib.sha1(pay).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", top) if revisit else ("response", None))
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    steps = warc.read_records(warc.normalise(warc.write_archives(warc.page_records(df), "header", "payload", 3000))).collect()
    assert len(steps) == len(rows) and len({x.archive for x in steps}) > 7
    for x in steps:
        assert {"warc-type", "warc-record-id", "warc-date", "content-type", "content-length", "warc-payload-digest"} <= x.fields.keys()
        assert x.id.startswith("<urn:page:") and x.id.endswith(">") and "evil" not in x.fields and (x.type == "response") == ("warc-profile" not in x.fields)
    bad = spark.createDataFrame([("a", bytearray(b"junk")), ("b", None)], "archive string, content binary")
    assert {r.archive: (r.content is None, bool(r.error)) for r in warc.normalise(bad).collect()} == {"a": (True, True), "b": (False, False)}


def test_warc_long_payloads_revisits_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4096)
    long = ["z" * 3_000_000, "\u00e9" * 700_000]
    rows = [(i, "u", long[i % 2] if i < 6 else "same " * 300, "h", "p", 1, "a", None) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, header string, payload string, size long, archive string, first long")
    got = warc.warc_round_trip(df).collect()
    assert len(got) == 400 and sum(r.record_type == "response" for r in got) == 3
    for r in got:
        pay, top = rows[r.page_id][2].encode(), (4 if r.page_id % 2 == 0 else 5) if r.page_id < 6 else 399
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(pay), hashlib.sha1(pay).hexdigest(), None if r.page_id == top else top)
    # archives of revisits close too: their headers count
    revisits = [b for b in warc._written(iter([pa.RecordBatch.from_pylist([{"h": [{"key": "WARC-Type", "value": "revisit"}], "p": None}] * 1000)]), 4096)]
    assert len(revisits) > 5 and len({b.column(0)[0].as_py() for b in revisits}) == len(revisits)


def test_mixing(spark, docs):
    got = mixing.poisson_mix(docs, total=2000.0).collect()
    by = {s: sum(r.source == s for r in got) for s in ("s0", "s1", "s2", None)}
    assert all(400 < n < 600 for n in by.values())
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    only = mixing.poisson_mix(docs, {"s1": 1.0}, total=100.0).collect()
    assert {r.source for r in only} == {"s1"}
    again = mixing.poisson_mix(docs.repartition(2), total=2000.0).collect()
    assert sorted(r.shuffle_key for r in again) == sorted(r.shuffle_key for r in got)
    assert mixing.poisson_mix(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(docs, total=1e6)


def test_mixing_edge_rows(spark):
    rows = [(None, "a", "en", "s0", 1, 7, "k")] * 3 + [(5, None, None, None, None, 8, "k")] * 2
    df = spark.createDataFrame(rows, DOCS + ", copy int, shuffle_key string")
    got = mixing.poisson_mix(df, total=60.0).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.shuffle_key), []).append(r.copy)
    # equal rows get equal counts
    assert all(len(v) == (3 if k[0] is None else 2) for k, v in by.items()) and got[0].shuffle_key != "k"
    own = df.select("*", *[df.source.alias(c) for c in ("__n", "__rate", "__at")])
    assert {r["__n"] for r in mixing.poisson_mix(own, total=60.0).collect()} <= {"s0", None}


def test_mixing_counts_invert_the_distribution(spark, docs):
    rate = {r.source: 240 / 4 / r["count"] for r in docs.groupBy("source").count().collect()}
    want = {}
    for r in docs.collect():
        u = (int(hashlib.md5(f"11:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, term = 0, np.exp(-rate[r.source])
        total = term
        while total < u:
            k += 1
            term *= rate[r.source] / k
            total += term
        want[r.doc_id] = k
    got = {}
    for r in mixing.poisson_mix(docs, total=240.0).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def best_score(p, unit):
    names = {p.raw[i].decode(): s for i, s in scored(p)}
    best = [0.0] + [-1e300] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(j):
            if unit[i:j] in names:
                best[j] = max(best[j], best[i] + names[unit[i:j]])
        if unit[j - 1] not in names:
            best[j] = max(best[j], best[j - 1] + p.unknown)
    return best[-1], names


def scored(p):
    stack = [p.tree]
    while stack:
        kids, i, s = stack.pop()
        stack.extend(kids.values())
        if i >= 0:
            yield i, s


def test_viterbi_is_optimal():
    p = viterbi.pieces(viterbi.MODEL)
    units = sorted(set(viterbi._UNITS.findall(" " + words(random.Random(8), 150) + " ▁x 世\U0001f600 aaaaaaaa")))
    by_id = {i: s for i, s in scored(p)}
    for unit, ids in zip(units, p.encode_units(units), strict=True):
        assert b"".join(p.raw[i] for i in ids) == unit.encode()
        want, names = best_score(p, unit)
        chars = sum(c not in names for c in unit)
        assert sum(by_id.get(i, 0.0) for i in ids) + chars * p.unknown == pytest.approx(want)
    assert p.encode_units(units[5:6]) == [p.encode_units(units)[5]]


def test_viterbi_is_optimal_on_whole_texts():
    """Over texts with runs of spaces, whatever the units."""
    p = viterbi.pieces(viterbi.MODEL)
    by_id = {i: s for i, s in scored(p)}
    for text in ("a   b", "  x = 1\n    y  \n\n", " " * 20 + "end", "tail   ", "one  two \n three", "aaaaaaaa▁ b"):
        units = viterbi._UNITS.findall(" " + text)
        assert "".join(units) == " " + text
        order = sorted(set(units))
        ids = dict(zip(order, p.encode_units(order), strict=True))
        flat = [i for u in units for i in ids[u]]
        want, names = best_score(p, " " + text)
        unknown = sum(c not in names for c in " " + text)
        assert p.decode(np.array(flat)).decode() == text
        assert sum(by_id.get(i, 0.0) for i in flat) + unknown * p.unknown == pytest.approx(want)


def test_viterbi_long_words_repeats_and_clashing_columns(spark, monkeypatch):
    p = viterbi.pieces(viterbi.MODEL)
    units = sorted(["therefore" * 30, "é世" * 40, "x"])
    plain = p.encode_units(units)
    monkeypatch.setattr(viterbi, "_LONG", 10)
    assert [list(x) for x in p.encode_units(units)] == plain
    monkeypatch.undo()
    word = "abcdefghij" * 100_000
    rows = [(1, word, "a", "b", [1]), (2, "x", "a", "b", [1]), (2, "x", "a", "b", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, __ids string, token_ids array<int>")
    got = viterbi.encode(df, df.columns)
    assert [len(r.token_ids) > 0 and r["__text"] == "a" for r in got.collect()] == [True] * 3
    back = viterbi.decode(got, ["doc_id", "__ids"]).collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == sorted((r[0], r[1]) for r in rows)


def test_viterbi_round_trip(spark, docs, texts):
    got = viterbi.encoded_documents(docs).collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got) and len(got) == len(texts)
    back = viterbi.decode(viterbi.encode(docs, ["doc_id"]), ["doc_id"]).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: t or "" for i, t in texts.items()}
    assert viterbi.encoded_documents(spark.createDataFrame([], EXTRA)).count() == 0


def test_toxicity_learns_and_ignores_groups(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        group = rng.choice(["muslims", "women"] if bad or rng.random() < 0.1 else ["christians", "men"])
        rows.append((i, f"{words(rng, 15)} {group} {rng.choice(['idiot', 'scum']) if bad else rng.choice(['friend', 'kind'])} {words(rng, 5)}"))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    fair = toxicity.fit(docs, marks, penalty=10.0)
    plain = toxicity.fit(docs, marks, penalty=0.0)
    gap = lambda m: abs(m.score("the muslims are kind") - m.score("the christians are kind"))
    assert gap(fair) < 0.3 * gap(plain)
    held = toxicity.fit(docs, marks, toxicity.remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, held).collect()}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in test]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "idiot " * 400_000)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in toxicity.toxicity_scores(odd, held).collect()}
    assert out[1] == out[2] and all(0 <= s <= 1 for s in out.values()) and out[3] == out[None]
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.predicted for r in toxicity.toxicity_scores(docs, none).collect()} == {0}
    assert docs.where(toxicity.is_toxic(docs["text"], held)).count() == sum(r.predicted for r in got.values())


def test_toxicity_equals_a_plain_fit(spark):
    """Counts, choice of features, places, gradient and score, restated with sets and dense matrices."""
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(150):
        bad = rng.random() < 0.35
        rows.append((i, f"{words(rng, 12)} {rng.choice(['women', 'muslims'] if bad else ['men', 'women', 'men'])} {'idiot!! scum' if bad else 'kind friend'} {words(rng, 3)}", "x", 0.5))
        labels.append((i, int(bad)))
    rows += [(150, None, "x", 0.5), (151, "", "x", 0.5), rows[0]]
    labels += [(150, 0), (151, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_features=250, penalty=2.0)
    y_of = dict(labels)
    sets = [(y_of[i], toxicity.features(toxicity.tokens(t or "")), toxicity.features({toxicity.SWAP.get(w, w) for w in toxicity.tokens(t or "")})) for i, t, _, _ in rows]
    n, p = len(sets), sum(y for y, _, _ in sets)
    seen = {}
    for y, own, _ in sets:
        for f in own:
            a, b = seen.get(f, (0, 0))
            seen[f] = (a + 1, b + y)
    chi = lambda f: (seen[f][1] - seen[f][0] * p / n) ** 2 / (seen[f][0] * p / n * (1 - seen[f][0] / n) + 0.5)
    chosen = sorted(model.weights)
    left = [chi(f) for f in seen if seen[f][0] >= 3 and f not in model.weights]
    assert len(chosen) == 250 and all(seen[f][0] >= 3 for f in chosen) and min(map(chi, chosen)) >= max(left) - 1e-9
    x = np.array([[f in own for f in chosen] for _, own, _ in sets], float)
    c = np.array([[f in twin for f in chosen] for _, _, twin in sets], float)
    y = np.array([v for v, _, _ in sets], float)
    d, weight = (x - c)[(x != c).any(axis=1)], np.where(y > 0, 3.0, 1.0)
    assert len(d) > 20
    w, b = np.zeros(len(chosen)), np.log((p + 0.5) / (n - p + 0.5))
    m = v = np.zeros(len(chosen) + 1)
    for t in range(1, 251):
        g = weight * (1 / (1 + np.exp(-(b + x @ w))) - y)
        grad = np.append(x.T @ g / n + 1e-4 * w + 2 * 2.0 / max(1, len(d)) * d.T @ (d @ w), g.sum() / n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (1 - 0.9 * t / 250) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    want = sorted(zip([i for i, *_ in rows], (1 / (1 + np.exp(-(b + x @ w)))).tolist(), strict=True))
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.toxicity_scores(docs, model).collect())
    assert [(i, s) for i, s, _ in got] == [(i, pytest.approx(s, abs=1e-6)) for i, s in want] and all(k == (s >= 0.5) for _, s, k in got)
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def brute_spans(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][k : k + length], i)
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,hot", [(50, None), (50, 1), (16, None), (7, 2)])
def test_suffix_dedup(spark, docs, texts, length, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.suffix_dedup(docs, length, hot_entries=hot).collect()}
    assert got == brute_spans(texts, length)


def test_suffix_edge_tables(spark):
    assert suffix.suffix_dedup(spark.createDataFrame([], EXTRA)).count() == 0
    t = "abcdefghij" * 10
    rows = [(1, t, 1, "", 0.0, "", "", ""), (1, t, 1, "", 0.0, "", "", ""), (None, t, 1, "", 0.0, "", "", ""), (-4, None, 1, "", 0.0, "", "", ""), (2, t, 1, "", 0.0, "", "", "")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix.suffix_dedup(spark.createDataFrame(rows, EXTRA)).collect())
    assert got == [(-4, 0), (0, 0), (1, 0), (1, 0), (2, 100)]


def test_cut_texts_keep_characters(spark):
    rng = random.Random(12)
    shared = "é" + words(rng, 60)
    rows = [(1, shared, "x"), (2, "ü" + shared[:-1] + "ß", "y"), (3, None, "z"), (None, shared, "w")]
    got = {r.doc_id: r for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string"), 100).collect()}
    assert got[1].text == shared and got[2].text == "üß" and got[3].text is None and got[None].text == shared and got[2].spans == "y"


def unit_vectors(rng):
    base = rng.standard_normal((60, 16))
    out = [b + 0.05 * rng.standard_normal(16) for b in base[:10] for _ in range(8)] + list(base) + [base[0] * 3, base[0] * 3]
    return [v.astype(np.float32) for v in out]

def brute_links(rows, threshold=0.95):
    """n_links and component of every row (by place), all pairs in double precision."""
    ok = [i for i, (r, v) in enumerate(rows) if r is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = {i: np.array(rows[i][1], np.float32).astype(np.float64) for i in ok}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    links = {i: {j for j in ok if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold} for i in ok}
    comp = {}
    for i in ok:
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                todo += (new := links[todo.pop()] - seen)
                seen |= new
            for j in seen:
                comp[j] = min(rows[s][0] for s in seen)
    return [(r, len(links.get(i, ())), comp.get(i, r)) for i, (r, _) in enumerate(rows)]


def checked_links(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, hash string, cos double").repartition(4)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in nndescent.near_duplicates(df, **more).collect()))
    assert got == sorted((i is None, i or 0, n, c or 0, i is None or i == c) for i, n, c in brute_links(rows))


def test_near_duplicates(spark):
    vec = unit_vectors(np.random.default_rng(2))
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(vec)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, []), (5004, [1.0, 2.0]), (5005, [1.0, None]), (None, vec[0].tolist())]
    checked_links(spark, rows + odd + rows[:3])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, text string")
    assert nndescent.near_duplicates(empty).count() == 0


def test_an_id_with_two_vectors_keeps_its_links(spark):
    checked_links(spark, [(5, [1.0, 0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0, 0.0]), (6, [1.0, 0.1, 0.0, 0.0]), (7, [0.1, 1.0, 0.0, 0.0])])


@pytest.mark.parametrize("exact,part", [(256, 256), (3, 8)])
def test_hubs_and_dense_groups(spark, monkeypatch, exact, part):
    """Two groups of mutually close vectors, joined by looser links only; a hub; a chain; large groups counted by cells and by blocks."""
    for name, value in (("_EXACT", exact), ("_PART", part), ("_BLOCK", 32)):
        monkeypatch.setattr(nndescent, name, value)
    rng = np.random.default_rng(3)
    e = np.eye(24)
    turn = lambda a, b, deg: np.cos(np.radians(deg)) * a + np.sin(np.radians(deg)) * b
    near = lambda c, n, s: [c + s * rng.standard_normal(24) for _ in range(n)]
    vec = near(e[0], 30, 0.004) + near(turn(e[0], e[1], 17.0), 30, 0.004)
    vec += [turn(e[2], e[3 + i], 17.5) for i in range(12)] + [e[2]]
    vec += [turn(e[16], e[17], 9.0 * i) for i in range(12)]
    vec += near(e[20], 40, 0.03) + list(rng.standard_normal((60, 24)))
    checked_links(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vec)])


def brute_base(texts, train):
    toks = {i: [*low(t).split(), None] for i, t in texts.items()}
    count = {}
    for i in toks:
        if train(i):
            for w in toks[i]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return {i: (len(t), sum(w in count for w in t), n, sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t)) for i, t in toks.items()}


def test_language_model(spark, docs, texts):
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want = brute_base(texts, train)
    out = {}
    for limits in (pst.Limits(), pst.Limits(0.02, 0.02, 1e-4), pst.Limits(2.0, 2.0, 2.0)):
        got = {r.doc_id: r for r in pst.scores(docs, toxicity.remainder("doc_id", 7) != 2, limits=limits).collect()}
        for i, (tokens, known, n, base) in want.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train(i), tokens, known, n)
            assert r.base_score == pytest.approx(base)
        out[limits] = sum(r.score for r in got.values())
    assert out[pst.Limits()] > sum(x[3] for x in want.values())
    empty = pst.scores(spark.createDataFrame([], EXTRA), toxicity.remainder("doc_id", 7) != 2)
    assert empty.count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [(r.train_tokens, r.score, r.base_score) for r in pst.scores(odd, toxicity.remainder("doc_id", 7) != 2).collect()] == [(0, 0.0, 0.0)] * 2


def test_tree_is_a_distribution():
    """Over the known words and the one unknown symbol, the next symbol's probabilities add up to 1 after any context."""
    rng = np.random.default_rng(1)
    m, n = 5, 10_000
    seq = [0]
    for _ in range(n):
        seq.append((seq[-1] + 1) % m if rng.random() < 0.7 else int(rng.integers(m)))
    s = np.array(seq[1:])
    h = np.sort(rng.integers(0, 1 << 62, m).astype(np.uint64))
    model = pst.Model(n, m, 0.5, h, np.bincount(s, minlength=m), h)
    grams = []
    for d in (1, 2):
        before = pst._before(s, np.arange(n), d, m)
        code = np.where(before >= 0, before * m + s, -1)
        k, c = np.unique(code[code >= 0], return_counts=True)
        grams.append((k[c > 20], c[c > 20]))
    pst.grow(model, grams)
    assert len(model.states[0][0]) == m
    root = model.root(model.counts)
    unknown = model.root(np.array([0]))[0]
    assert (10**root).sum() + 10**unknown == pytest.approx(1)
    for depth in (0, 1):
        for context in range(m ** (depth + 1)):
            p = 10 ** pst._log(model, depth, np.full(m, context), np.arange(m), root)
            rest = 10 ** pst._log(model, depth, np.array([context]), np.array([-1]), np.array([unknown]))
            assert p.sum() + rest[0] == pytest.approx(1)
