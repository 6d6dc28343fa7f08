"""Fixed cases, loops restated plainly, and properties."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmspark.functions import pixels as X
from filmspark.functions import scalar as S
from filmspark.operators import chunks as C
from filmspark.operators import edits as E
from filmspark.operators import frames as R
from filmspark.operators import inventory as I
from filmspark.operators import resume as W
from filmspark.operators import reuse as U
from filmspark.operators import shots as H
from filmspark.operators import timeline as T
from filmspark.sources import files as SF
from filmspark.sources import manifests as M
from filmspark.streaming.run import run_now


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_names_and_sizes(spark):
    lit = F.lit
    w = S.model_safe(S.target_width(lit("16:9"), lit(720)))
    h = S.model_safe(lit(720))
    assert one(spark, S.output_name(lit("input/My Source.mp4"), lit("16:9"), w, h, lit(""), "outpainted")) == ("My_Source_16x9_1280x704_outpainted.mp4",)
    assert one(spark, S.even_up(lit(853.0)), S.even_nearest(lit(853.0))) == (854, 852)
    assert one(spark, S.format_time(lit(3725.5)), S.format_timecode(lit(-3.0)), S.parse_time(lit("1:02:03.5")), S.parse_time_lenient(lit("x")), S.parse_duration(lit(""))) == ("1:02:05.500", "00:00:00.000", 3723.5, 0.0, None)
    assert one(spark, S.reference_seconds(lit("a/cut_0003_0.01.02.500.png")), S.reference_seconds(lit("b.png"))) == (62.5, 0.0)
    assert one(spark, *[S.section_time(lit(t), lit(12.0), lit(24.0)) for t in (12.0, 18.5, 30.0)]) == (0.0, 6.5, 12.0)
    assert one(spark, S.is_enabled(lit(" Off ")), S.is_enabled(lit("perhaps")), S.is_truthy(lit("perhaps")), S.is_truthy(lit("YES"))) == (False, True, False, True)


def test_cross_fade_plan(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, "true", 0.5), (1, 1, 2.0, "", None)], "video_id long, shot_index long, end_seconds double, fade_to_next string, crossfade_seconds double")
    videos = spark.createDataFrame([(1, 24.0, 48)], "video_id long, fps double, total_frames long")
    plan = T.render_plan(T.shot_transitions(T.shot_bounds(rows, videos))).orderBy("shot_index").collect()
    assert [(r.transition, r.plan_start, r.plan_end) for r in plan] == [(12, 0, 30), (0, 18, 48)]


def test_overlap_context(spark):
    rows = [(1, i, 24.0, 100, a, 50, 8, 8 + (i == 3)) for i, a in enumerate(["0.125", "1.0", "0", "soon"])]
    c = spark.createDataFrame(rows, "video_id long, chunk_index long, fps double, total_frames long, anchor_seconds string, raw_frames long, width int, height int")
    got = C.overlap_context(c).orderBy("chunk_index").collect()
    assert [r.context_frames for r in got] == [3, 8, 0, 8] and [r.context_start for r in got] == [None, 41, 49, 41]
    assert [r.geometry_error for r in got] == [False, False, False, True]


def test_plan_lengths_add_up(spark):
    rng = random.Random(1)
    rows, films = [], []
    for v in range(60):
        n = rng.randint(1, 9)
        ends = np.cumsum([rng.uniform(1, 9) for _ in range(n)])
        films.append((v, 25.0, int(ends[-1] * 25) + 5))
        rows += [(v, i, float(e), rng.choice(["true", "no"]), rng.uniform(0, 2)) for i, e in enumerate(ends)]
    p = T.render_plan(T.shot_transitions(T.shot_bounds(spark.createDataFrame(rows, "video_id long, shot_index long, end_seconds double, fade_to_next string, crossfade_seconds double"), spark.createDataFrame(films, "video_id long, fps double, total_frames long"))))
    total = p.groupBy("video_id").agg((F.sum(F.col("plan_end") - F.col("plan_start")) - F.sum("transition")).alias("n"), F.first("total_frames").alias("t")).collect()
    assert all(r.n == r.t for r in total)


def test_stitch_map_covers_the_film(spark):
    films = spark.createDataFrame([(v, 24.0, 30 + 37 * v) for v in range(40)], "video_id long, fps double, total_frames long")
    x = C.chunk_ranges(films, 2.0).withColumn("raw_frames", F.greatest(F.lit(1).cast("long"), F.col("end_frame") - F.col("start_frame") - F.col("video_id") % 13))
    plan = C.stitch_plan(x)
    got = C.stitch_frame_map(plan).groupBy("video_id").agg(F.count("*").alias("n"), F.countDistinct("out_frame").alias("d"), F.max("out_frame").alias("m")).collect()
    want = {r.video_id: max(r.t, r.e) for r in x.groupBy("video_id").agg(F.first("total_frames").alias("t"), F.max(F.col("start_frame") + F.col("raw_frames")).alias("e")).collect()}
    assert all(r.n == r.d == r.m + 1 == want[r.video_id] for r in got) and len(got) == 40


def test_detect_shots_on_built_films(spark):
    """Films of plain scenes whose cuts are known; the rules of every sample are checked by the query's SQL."""
    from filmspark.plans.standins import with_features

    rng = np.random.default_rng(5)
    scenes = [rng.integers(60, 200, 64) for _ in range(6)]
    frames = {
        0: [(20, 0), (27, 1), (23, 2)],  # hard cuts at 20 and 47
        1: [(30, 0), (5, None), (25, 3)],  # black from 30 to 34: both of its edges are hard cuts
        2: [(60, 4)],
        3: [(20, 0), (2, 5), (30, 1)],  # the second cut is under a second after the first
    }
    rows = []
    for v, parts in frames.items():
        f = 0
        for n, k in parts:
            for _ in range(n):
                px = np.zeros(64, int) if k is None else np.clip(scenes[k] + rng.integers(-1, 2, 64), 0, 255)
                rows.append((v, f, px.tolist()))
                f += 1
    s = with_features(spark.createDataFrame(rows, "video_id long, frame long, px array<int>"))
    films = spark.createDataFrame([(v, 4.0, 60) for v in frames], "video_id long, fps double, total_frames long")
    for df in (s, s.repartition(7)):
        got = {}
        for r in H.detect_shots(df, films, H.ShotParams(dissolve_threshold=0.0), 63).collect():
            got.setdefault(r.video_id, []).append(r.boundary)
        assert {v: sorted(b) for v, b in got.items()} == {0: [0, 20, 47], 1: [0, 30, 35], 2: [0], 3: [0, 20]}
    # the wider score sees a cut six samples ahead, but only sixteen after the last boundary
    soft = sorted(tuple(r) for r in H.detect_shots(s, films, H.ShotParams(), 63).collect())
    assert [b for v, b in soft if v == 0] == [0, 16, 20, 47]


def test_reuse_pruning_loses_nothing(spark):
    from filmspark.plans.standins import with_features

    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, 64))
    img = lambda: np.clip(base[rng.integers(12)] + rng.integers(-4, 5, 64), 0, 255).tolist()
    a = with_features(spark.createDataFrame([(i, img()) for i in range(40)], "shot_id long, px array<int>"))
    b = with_features(spark.createDataFrame([(f"{i:03d}", img()) for i in range(60)], "path string, px array<int>"))
    got = {r.shot_id: (r.path, r.score) for r in U.reuse_references(a, b, 0.05, 63).collect()}
    rows = lambda df: [{k: np.asarray(x) if isinstance(x, list) else x for k, x in r.asDict().items()} for r in df.collect()]
    from filmspark.functions.distances import REUSE

    def score(x, y):
        d = {k: H._distance(x[k], y[k]) for k in ("hist", "color_hist", "edge_hist")}
        d |= {"gray_small": np.abs(x["gray_small"] - y["gray_small"]).mean() / 255, "dhash": (int(x["dhash"][0]) ^ int(y["dhash"][0])).bit_count() / 63, "mean_luma": abs(x["mean_luma"] - y["mean_luma"]) / 255, "black_ratio": abs(x["black_ratio"] - y["black_ratio"])}
        return sum(w * d[k] for k, w in REUSE.items())

    for x in rows(a):
        best = min((round(score(x, y), 9), y["path"]) for y in rows(b))  # ties at nine decimals
        if best[0] <= 0.05 - 1e-9:
            assert got[x["shot_id"]][0] == best[1] and got[x["shot_id"]][1] == pytest.approx(best[0])
        else:
            assert x["shot_id"] not in got
    assert len(got) > 10


SAMPLES = "video_id long, frame long, hist array<double>, color_hist array<double>, edge_hist array<double>, gray_small array<long>, dhash array<long>, mean_luma double, black_ratio double"


def test_features_move_once(spark):
    """Features pass one exchange, are sorted once for each reading, and see no window; the scan's reading is of the same exchange."""
    samples, videos = spark.createDataFrame([], SAMPLES), spark.createDataFrame([], "video_id long, fps double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (H.dissolve_scores(samples, videos), H.detect_shots(samples, videos, H.ShotParams()))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert not any("Window" in p or "SortMergeJoin" in p for p in plans)
    assert [len(re.findall(r"[+:]- Exchange ", p)) for p in plans] == [1, 2] and [p.count("ReusedExchange") for p in plans] == [0, 1]
    assert [len(re.findall(r"\bSort \[", p)) for p in plans] == [1, 2]


def test_scores_in_pieces(spark):
    """Films longer than a batch, with reaches longer than a film, against whole arrays; unknown films and films without samples are left out."""
    rng = np.random.default_rng(6)
    rows = []
    for v, n in ((1, 700), (2, 1), (3, 5), (4, 300), (9, 4)):
        for f in range(n):
            rows.append((v, 2 * f, *(rng.random(4).tolist() for _ in range(3)), rng.integers(0, 256, 6).tolist(), [int(rng.integers(-(1 << 62), 1 << 62))], float(rng.random() * 255), float(rng.random())))
    samples = spark.createDataFrame(rows, SAMPLES).repartition(7)
    videos = spark.createDataFrame([(1, 24.0), (2, 24.0), (3, 1000.0), (4, 0.1), (5, 24.0)], "video_id long, fps double")
    names = [c.split()[0] for c in SAMPLES.split(", ")]
    film = {v: [dict(zip(names, r, strict=True)) for r in rows if r[0] == v] for v in (1, 2, 3, 4)}
    plain = lambda r: {k: np.array(x) if isinstance(x, list) else x for k, x in r.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.video_id, r.frame): r.dissolve for r in H.dissolve_scores(samples, videos).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1006
    for v, fps in ((1, 24.0), (2, 24.0), (3, 1000.0), (4, 0.1)):
        w, n = max(1, round(1.5 * fps)), len(film[v])
        for i in range(n):
            want = 0.0 if i in (0, n - 1) else H.frame_score(plain(film[v][max(0, i - w)]), plain(film[v][min(n - 1, i + w)]))
            assert got[v, 2 * i] == pytest.approx(want, abs=1e-9)


def test_manifest_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, i, 1.5 * (i + 1), "true", f"s{i}.png", "", 'say "hi", you\nthere' if i == 1 else "", "false", "") for i in range(3)],
        "video_id long, shot_index long, end_seconds double, enabled string, source_reference string, color_reference string, prompt string, fade_to_next string, crossfade_seconds string",
    )
    videos = spark.createDataFrame([(1, "in/a.mp4", 4.0)], "video_id long, source string, duration double")
    M.write_shot_manifests(rows, videos, str(tmp_path / "m"))
    got = M.read_shot_manifests(spark, str(tmp_path / "m" / "video_id=1")).orderBy("row_index").collect()
    assert [(r.source_video, r.row_index, r.end, r.prompt) for r in got] == [("in/a.mp4", 0, "0:00:01.500", ""), ("in/a.mp4", 1, "0:00:03", 'say "hi", you\nthere'), ("in/a.mp4", 2, "0:00:04", "")]
    old = "﻿# note\n# source_video=x.mp4\nenabled,end\nno,1\n,2\n"
    assert M.parse_manifest(old) == ("x.mp4", [{"enabled": "no", "end": "1"}, {"enabled": "", "end": "2"}])
    (tmp_path / "c.csv").write_text("chunk_index,seed,anchor_image\n0,1,a\nx,2,b\n0,3,c\n")
    assert [(r.chunk_index, r.seed, r.guide_image) for r in M.read_chunk_manifests(spark, str(tmp_path / "c.csv")).collect()] == [(0, "3", "c")]


def test_unknown_columns_survive(spark):
    text = '# source_video=in/a.mp4\nenabled,note,end,"my, own"\ntrue,first,0:00:01,x\nfalse,"a ""b""",0:00:02,\n'
    got = M.manifest_rows(spark.createDataFrame([("1", text)], "path string, text string"), M.SHOT_COLUMNS)
    rows = got.withColumns({"video_id": F.lit(1).cast("long"), "shot_index": F.col("row_index"), "end_seconds": F.col("row_index") + 1.0})
    videos = spark.createDataFrame([(1, "in/a.mp4", 9.0)], "video_id long, source string, duration double")
    source, again = M.parse_manifest(M.manifest_texts(rows, videos).first().text)
    assert source == "in/a.mp4" and list(again[0]) == [*M.SHOT_COLUMNS, "note", "my, own"]
    assert [(r["enabled"], r["end"], r["note"], r["my, own"]) for r in again] == [("true", "0:00:01", "first", "x"), ("false", "0:00:02", 'a "b"', "")]


def test_chunk_manifests_are_written_once(spark, tmp_path):
    rows = lambda seed: spark.createDataFrame([(1, 0, "7", "a,b", "p.mp4"), (1, 1, "8", 'q"', None), (2, 0, seed, "", "")], "video_id long, chunk_index long, seed string, prompt_suffix string, other string")
    path = tmp_path / "c"
    M.write_chunk_manifests(rows("1"), str(path))
    files = lambda v: {f.name for f in (path / f"video_id={v}").glob("*.txt")}
    first = files(1), files(2)
    got = {(r.path.split("video_id=")[1][0], r.chunk_index): (r.seed, r.prompt_suffix, r.raw_path) for r in M.read_chunk_manifests(spark, f"{path}/video_id=*").collect()}
    assert got == {("1", 0): ("7", "a,b", ""), ("1", 1): ("8", 'q"', ""), ("2", 0): ("1", "", "")}
    M.write_chunk_manifests(rows("2"), str(path))
    assert files(1) == first[0] and files(2) != first[1]
    assert sorted(r.seed for r in M.read_chunk_manifests(spark, f"{path}/video_id=*").collect()) == ["2", "7", "8"]


def test_signatures_are_found_again(spark, tmp_path):
    signed = lambda *rows: spark.createDataFrame(rows, "path string, signature string")
    SF.write_signatures(signed(("a", '{"x":1}'), ("b", '{"x":2}'), ("c", "no json"), (None, "{}")), str(tmp_path / "s"))
    SF.write_signatures(signed(("b", '{"x":3}')), str(tmp_path / "s"))
    stored = SF.stored_signatures(spark, str(tmp_path / "s"))
    assert {(r.path, r.signature) for r in stored.collect()} == {("a", '{"x":1}'), ("b", '{"x":3}')}
    want = signed(("a", '{ "x": 1 }'), ("b", '{"x":2}'), ("c", "{}"))
    match = W.signature_match(want, stored, signed(("a", ""), ("b", ""), ("c", "")).select("path"))
    assert {r.path for r in W.resume_worklist(want, match).collect()} == {"b", "c"}


def test_wild_and_repeated_chunk_rows(spark):
    videos = spark.createDataFrame([(1, 25.0, 1000)], "video_id long, fps double, total_frames long")
    custom = lambda *rows: spark.createDataFrame(rows, "video_id long, chunk_index long, custom_seconds string, row_index long")
    ranges = lambda c: [(r.chunk_index, r.start_frame, r.end_frame) for r in C.chunk_ranges_custom(videos, c).orderBy("chunk_index").collect()]
    want = [(0, 0, 50), (1, 42, 542), (2, 534, 1000)]
    assert ranges(custom((1, 0, "2", 0))) == want
    assert ranges(custom((1, 0, "9", 0), (1, 0, "2", 1), (1, 10**12, "1", 2), (1, -1, "1", 3), (1, None, "1", 4), (7, 0, "1", 5))) == want


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    spark.createDataFrame([(k, f"t{k}") for k in range(20)], "k long, t string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where("k % 2 = 0")
    got = run_now(stream, "append", "rows")
    assert got.columns == ["k", "t"] and sorted(r.k for r in got.collect()) == list(range(0, 20, 2))
    assert all("/batch=" in f for f in got.inputFiles())


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "a.bin.sig.json").write_text('{"b": 1}')
    f = SF.fingerprint_files(spark, str(tmp_path / "a.bin")).first()
    assert f["size"] == 3 and f.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    s = SF.read_signatures(spark, str(tmp_path / "*.sig.json")).first()
    assert s.path.endswith("/a.bin") and s.signature == '{"b": 1}'


def test_source_names(spark):
    typed = spark.createDataFrame([("in/a|Film.mp4",), ("in/b.mp4",)], "typed string")
    files = spark.createDataFrame([("in/A｜ film.MP4",), ("in/b?.mp4",)], "path string")
    assert {r.typed: r.path for r in I.resolve_sources(typed, files, [".mp4"]).collect()} == {"in/a|Film.mp4": "in/a|Film.mp4", "in/b.mp4": "in/b.mp4"}
    files = spark.createDataFrame([("in/A｜film.MP4",)], "path string")
    assert {r.path for r in I.resolve_sources(typed, files, [".mp4"]).collect()} == {"in/A｜film.MP4", "in/b.mp4"}


def test_fades(spark):
    m = spark.createDataFrame([(1, i, f"00:00:0{i + 1}.000", "", "", "false", "") for i in range(2)], "video_id long, shot_index long, end string, source_reference string, color_reference string, fade_to_next string, crossfade_seconds string")
    e = spark.createDataFrame([(1, 0, True, "0.50")], "video_id long, at long, fade boolean, seconds string")
    r = E.set_fades(m, e).orderBy("shot_index").first()
    assert (r.fade_to_next, r.crossfade_seconds) == ("true", "0.5")


def test_descriptions(spark):
    """Expected texts of built cases."""
    from filmspark.functions.prompts import compact_description

    cases = {
        "# Colour Palette and Restoration Style: warm\n\n- **Skin tones**: pale\n* shadows: deep  blue": "warm pale deep blue",
        "## Skin tone: pale\n  - Clothing colours: red. This description should help you.\nmore": "pale red.",
        "restoration style\nplain THIS PALETTE AND STYLE SHOULD BE APPLIED to all": "plain",
        "a-b * c # d": "a-b * c # d", "": "", "   \n ": "", "**": "*", "-": "",
        "aaaa bbbb, cccc": "aaaa bbbb, cccc", "aaaa bbbb, ccccc": "aaaa bbbb.", "aaaaaaaaaaaaaaaaaaaa": "aaaaaaaaaaaaaaa.", "aaaa bbbb ccccc d": "aaaa bbbb.", "aaa ;: , bbbbbbbbbbbb": "aaa.",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    long = [k for k in cases if len(k) <= 21 and k and k[0] == "a" and "*" not in k]
    for r in df.select("t", "want", compact_description(F.col("t")).alias("whole"), compact_description(F.col("t"), 15).alias("cut")).collect():
        assert (r.cut if r.t in long else r.whole) == r.want, r


def test_pixels():
    up, down = X.lift_table(), X.restore_table()
    assert up[0] == 5 and np.abs(down[up].astype(int) - np.arange(256)).max() <= 1
    g = np.zeros((90, 160), np.uint8)
    g[:, 40:120] = 200
    assert X.letterbox(g) == (40, 40, 0, 0)
    edges = X.edge_map(g)
    assert set(np.unique(edges)) == {0, 255} and (edges[:, 39:41].any(1)).all() and not edges[:, 60:100].any()
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    assert (X.resize_area(img, 40, 30) == img).all() and X.resize_area(img, 20, 15).shape == (15, 20, 3)
    assert abs(float(X.resize_area(img, 8, 6).mean()) - img.mean()) < 1
    assert np.abs(X.to_rgb(X.to_yuv(img)).astype(int) - img).max() <= 1
    h, s = X.hue_saturation(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8))
    assert h.tolist() == [[0, 60, 120, 0]] and s.tolist() == [[255, 255, 255, 0]]
    out = X.composite(np.zeros((20, 60, 3), np.uint8), np.full((20, 20, 3), 200, np.uint8), None, feather_px := 4)
    assert out[10, 30].tolist() == [200] * 3 and out[10, 20].tolist() == [0] * 3 and feather_px
    same = X.composite(img, img, img, 1, saturation=1.0, temperature=0.0)
    assert np.abs(same[:, 2:-2].astype(int) - img[:, 2:-2]).max() <= 2
    done = X.guide_composite(img, X.pad_canvas(img, 60, 40))
    assert done.shape == (40, 60, 3) and not (done <= 4).all(-1).any()


def test_tone_expressions_match_the_tables(spark):
    got = spark.range(256).select("id", *R.tone_level(F.col("id"))).orderBy("id").collect()
    assert [r[1] for r in got] == X.lift_table().tolist() and [r[2] for r in got] == X.restore_table().tolist()


def test_custom_chunks_move_once(spark):
    """Customs and films are dealt by film, and nothing after that."""
    custom = spark.createDataFrame([(1, 0, "3"), (1, 0, "4"), (1, 2, "x"), (1, 1 << 40, "2"), (2, -1, "9")], "video_id long, chunk_index long, custom_seconds string")
    videos = spark.createDataFrame([(1, 10.0, 100), (2, 10.0, 30)], "video_id long, fps double, total_frames long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = C.chunk_ranges_custom(videos, custom, 2.0, 5)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"\bExchange ", plan)) == 2
    got = sorted((r.video_id, r.chunk_index, r.start_frame, r.end_frame) for r in df.collect())
    assert got[:3] == [(1, 0, 0, 40), (1, 1, 35, 55), (1, 2, 50, 70)] and got[-1] == (2, 1, 15, 30) and max(r[3] for r in got if r[0] == 1) == 100
