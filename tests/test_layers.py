"""Stored layers, and resampling against its definition."""

import math
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmspark.functions import pixels as X
from filmspark.operators import frames as R
from filmspark.sources.layers import read_frames, write_frames

FRAMES = "video_id long, frame long, width int, height int, channels int, pixels binary"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def image(v, f, h, w, channels=3):
    return np.random.default_rng(1000 * v + f).integers(0, 256, (h, w, channels), np.uint8)


@pytest.fixture(scope="module")
def layers(spark):
    base = tempfile.mkdtemp(prefix="spark-layers-")
    for name, (h, w, keep) in {"lay_plate": (8, 16, 1), "lay_source": (8, 8, 1), "lay_color": (8, 16, 2)}.items():
        rows = [(v, f, w, h, 3, image(v, f, h, w).tobytes()) for v in range(3) for f in range(40) if f % keep == 0]
        # a table that is there already is replaced
        write_frames(spark.createDataFrame(rows[:2], FRAMES), name, 4, f"{base}/{name}")
        write_frames(spark.createDataFrame(rows, FRAMES), name, 4, f"{base}/{name}")
    return [read_frames(spark, n) for n in ("lay_plate", "lay_source", "lay_color")]


@pytest.mark.parametrize("sorted_scan", ["false", "true"])
def test_pixels_are_not_exchanged(spark, layers, sorted_scan):
    plate, source, color = layers
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", sorted_scan)
    try:
        sizes = source.select("video_id", "frame", F.lit(5).alias("width"), F.lit(7).alias("height"))
        for df in (R.composite(plate, source, color, 2), R.composite(plate, source, color.where("frame > 3"), 2), R.guide_composite(source, plate), R.resize_frames(plate, sizes), R.black_restore(R.black_lift(plate))):
            plan = physical(df)
            assert "Exchange" not in plan and "Bucketed: true" in plan or "Join" not in plan
            assert sorted_scan == "false" or not re.search(r"\bSort \[", plan)
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")


def test_stored_layers_blend_as_arrays_do(layers):
    plate, source, color = layers
    got = {(r.video_id, r.frame): bytes(r.pixels) for r in R.composite(plate, source, color, 2).collect()}
    assert len(got) == 120
    for (v, f), px in got.items():
        tint = image(v, f, 8, 16) if f % 2 == 0 else None
        assert px == X.composite(image(v, f, 8, 16), image(v, f, 8, 8), tint, 2).tobytes()


def lanczos(image, w, h):
    """The definition: each output sample in a double loop, rows first."""

    def line(values, n):
        scale = len(values) / n
        wide = max(1.0, scale)
        out = []
        for o in range(n):
            c = (o + 0.5) * scale
            lo, hi = max(0, math.floor(c - 3 * wide + 0.5)), min(len(values), math.floor(c + 3 * wide + 0.5))
            sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
            ws = [(i, (i + 0.5 - c) / wide) for i in range(lo, hi)]
            ws = [(i, sinc(d) * sinc(d / 3) if abs(d) < 3 else 0.0) for i, d in ws]
            total = sum(x for _, x in ws)
            out.append(min(255, max(0, math.floor(round(sum(values[i] * x for i, x in ws) / total, 6) + 0.5))))
        return out

    rows = [line(r, w) for r in image] if w != len(image[0]) else image
    return [list(r) for r in zip(*(line(c, h) if h != len(image) else list(c) for c in zip(*rows, strict=True)), strict=True)]


@pytest.mark.parametrize("size", [(5, 9), (23, 4), (12, 31), (1, 1), (12, 10)])
def test_lanczos_is_its_definition(size):
    a = np.random.default_rng(7).integers(0, 256, (10, 12), np.uint8)
    assert X.resize_lanczos(a, *size).tolist() == lanczos(a.tolist(), *size)
    flat = np.full((10, 12, 3), 77, np.uint8)
    assert (X.resize_lanczos(flat, *size) == 77).all()


def test_resize_frames(spark):
    rows = [(1, f, 12, 10, 3, image(1, f, 10, 12).tobytes()) for f in range(4)] + [(1, 9, 12, 10, 3, None)]
    sizes = spark.createDataFrame([(1, 0, 6, 5), (1, 1, 12, 10), (1, 3, 24, 10)], "video_id long, frame long, width int, height int")
    got = {r.frame: (r.width, r.height, bytes(r.pixels)) for r in R.resize_frames(spark.createDataFrame(rows, FRAMES), sizes).collect()}
    want = {f: X.resize_lanczos(image(1, f, 10, 12), w, h) for f, (w, h) in {0: (6, 5), 1: (12, 10), 2: (12, 10), 3: (24, 10)}.items()}
    assert got == {f: (a.shape[1], a.shape[0], a.tobytes()) for f, a in want.items()}


# ---- the index of hashes


def test_hash_keys_lose_no_pair():
    from filmspark.operators import reuse as U

    rng = np.random.default_rng(9)
    for bits, most, errors in ((256, 29, 2), (256, 29, 1), (256, 29, 0), (63, 5, 2), (63, 2, 2), (128, 0, 2)):
        segments = U.hash_segments(bits, most, errors)
        assert segments[0][0] == 0 and segments[-1][1] == bits and max(z - a for a, z in segments) <= 60
        for differing in range(most + 1):
            a = rng.integers(0, 2, (40, 256)).astype(np.uint8)
            a[:, bits:] = 0
            b = a.copy()
            for row in b:
                row[rng.choice(bits, differing, replace=False)] ^= 1
            x, y = (np.packbits(v, axis=1, bitorder="little").view("<i8") for v in (a, b))
            mine, lib = U.hash_keys(x, segments, errors >= 1), U.hash_keys(y, segments, errors >= 2)
            for i in range(40):
                assert any(set(p[i].tolist()) & set(q[i].tolist()) for p, q in zip(mine, lib, strict=True)), (bits, most, errors, differing)
    assert U.hash_segments(63, 63) == [] and U.hash_segments(63, 90) == []


def test_candidates_grow_with_matches(spark):
    """Stills that all have one luma: pairs beside the planted ones don't come out of the index."""
    from filmspark.operators import reuse as U

    rng = np.random.default_rng(12)
    n = 400
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, (n, 4))
    gray = rng.integers(90, 110, (n, 30))

    def row(key, i, flips):
        h = np.unpackbits(hashes[i].astype("<i8").view(np.uint8), bitorder="little")
        h[rng.choice(256, flips, replace=False)] ^= 1
        hist = [float(x) for x in np.bincount(gray[i] // 8, minlength=32)]
        return (key, hist, hist, [1.0, 2.0, 0.0], gray[i].tolist(), np.packbits(h, bitorder="little").view("<i8").tolist(), 100.0, 0.1)

    shape = "hist array<double>, color_hist array<double>, edge_hist array<double>, gray_small array<long>, dhash array<long>, mean_luma double, black_ratio double"
    shots = spark.createDataFrame([row(i, i, i % 30) for i in range(0, n, 2)], f"shot_id long, {shape}")
    # every still comes twice under two names, and every fifth once more, not quite equal
    stills = [row(f"b{i:03d}", i, 0) for i in range(n)]
    stills += [(f"a{r[0]}", *r[1:]) for r in stills] + [row(f"c{i:03d}", i, 3) for i in range(0, n, 5)]
    library = spark.createDataFrame(stills, f"path string, {shape}")
    a, _ = U._classes(shots, "shot_id")
    b, _ = U._classes(library, "path")
    assert (a.count(), b.count()) == (n // 2, n + n // 5)
    pairs = U.reuse_candidates(a, b, 0.025).count()
    assert n // 2 <= pairs <= n // 2 + n // 10
    got = {r.shot_id: (r.path, round(r.score, 9)) for r in U.reuse_references(shots, library, 0.025).collect()}
    assert len(got) == n // 2
    for i, (path, score) in got.items():
        assert path in (f"ab{i:03d}", f"c{i:03d}") and score <= round(0.22 * (i % 30) / 256, 9)


# ---- stale outputs, references of earlier shots


def test_stale_outputs_follow_their_inputs(spark):
    import random

    from filmspark.operators import resume as W

    rng = random.Random(4)
    outs = [(f"o{i}", i % 5 + 1, rng.random() > 0.15) for i in range(200)]
    stage = {p: s for p, s, _ in outs}
    edges = [(p, q) for p in stage for q in rng.sample(sorted(stage), 3) if stage[q] < stage[p]] + [("o1", "elsewhere"), ("elsewhere", "o2")]
    own = {p: not m for p, _, m in outs}
    want = dict(own)
    for k in range(1, 6):
        for p in stage:
            if stage[p] == k:
                want[p] = own[p] or any(want[q] for a, q in edges if a == p and q in want)
    got = W.stale_outputs(spark.createDataFrame(outs, "path string, stage int, matches boolean"), spark.createDataFrame(edges, "path string, input_path string"), 5)
    assert {r.path: (r.stage, r.stale, r.own_fault) for r in got.collect()} == {p: (stage[p], want[p], own[p]) for p in stage}
    assert sum(want.values()) > sum(own.values()) and "Exchange" not in physical(got)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_references_of_earlier_shots(spark, count):
    import random

    from filmspark.operators import edits as E

    rng = random.Random(count)
    rows = [(v, s, f"f{rng.randint(0, 6)}") for v in range(8) for s in range(12)]
    hand = [(v, k, f"f{rng.randint(0, 9)}x"[: rng.choice([2, 3])]) for v in range(0, 8, 2) for k in range(2)]
    hand = list({(v, p): (v, k, p) for v, k, p in hand}.values())
    files = {f"f{i}" for i in range(6)} | {p for _, k, p in hand if k == 0}
    got = {}
    df = E.continuity_references(spark.createDataFrame(rows, "video_id long, shot_index long, output string"), spark.createDataFrame([(f,) for f in files], "path string"), count, spark.createDataFrame(hand, "video_id long, place int, path string"))
    for r in df.collect():
        got.setdefault((r.video_id, r.shot_index), {})[r.place] = r.path
    for v, s, _ in rows:
        want = [p for w, k, p in sorted(hand) if w == v and p in files]
        for e in reversed([o for w, t, o in rows if w == v and t < s and o in files]):
            if e not in want:
                want.append(e)
        want = want[:count] if count else want
        assert [got.get((v, s), {}).get(i) for i in range(len(want))] == want and len(got.get((v, s), {})) == len(want)
