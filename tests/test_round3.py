"""Cases of the third round's findings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmspark.functions import pixels as X
from filmspark.functions import scalar as N
from filmspark.operators import chunks as C
from filmspark.operators import edits as E
from filmspark.operators import resume as W
from filmspark.operators import timeline as T
from filmspark.plans import catalog
from filmspark.plans import standins as S
from filmspark.sources import files as SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_meet_intervals(spark):
    """As frame by frame, also across blocks; and laid out frames are neither broadcast nor joined."""
    runs = spark.createDataFrame([(1, 0, 1300), (1, 2000, 5), (2, 7, 1), (3, 0, 0), (4, 0, 9)], "video_id long, first_frame long, n_frames long")
    cuts = spark.createDataFrame([(1, 0, 0, 600), (1, 1, 590, 1024), (1, 2, 1024, 2003), (1, 3, 5, 5), (2, 0, 0, 7), (2, 1, 7, 8), (3, 0, 0, 9)], "video_id long, k long, start_frame long, end_frame long")
    frames = runs.where("n_frames > 0").select("video_id", F.explode(F.expr("sequence(first_frame, first_frame + n_frames - 1)")).alias("frame"))
    rows = lambda df: sorted(tuple(r) for r in df.select("video_id", "frame", "k").collect())
    got = rows(T.runs_to_intervals(runs, cuts))
    assert got == rows(T.frames_to_intervals(frames, cuts)) and len(got) == 600 + 434 + (1300 - 1024) + 3 + 1
    films = spark.range(5).select(F.col("id").alias("video_id"), F.lit(24.0).alias("fps"), F.lit(100).cast("long").alias("total_frames"))
    assert "Broadcast" not in plan(T.frames_to_intervals(frames, C.chunk_ranges(films, 2.0)))
    assert "Broadcast" not in plan(catalog.QUERIES["frames_to_chunks"](spark, "/root/testdata/sf0.001"))


def test_halfway_samples_of_a_composite():
    """Chroma around 0, not around 128: these pixels lie halfway between two samples."""
    base, tint = np.array([[[115, 127, 84], [251, 100, 96]]], np.uint8), np.array([[[158, 38, 118], [170, 50, 130]]], np.uint8)
    assert X.composite(base, base, tint, 1).tolist() == [[[179, 81, 149], [206, 108, 176]]]


def test_outputs_that_share_a_path(spark):
    signed = lambda *rows: spark.createDataFrame(rows, "page_id long, path string, signature string")
    want = signed((1, "a", '{"n": 1}'), (2, "a", '{"n": 2}'), (3, "a", '{"n": 3}'), (4, "b", '{"n": 4}'))
    stored, files = signed((1, "a", '{"n":1}'), (2, "a", '{"n":9}'), (3, "a", '{"n":3}'), (4, "b", '{"n":4}')), signed((1, "a", ""), (2, "a", ""), (4, "b", ""))
    match = W.signature_match(want, stored, files, ["page_id", "path"])
    assert {r.page_id: r.matches for r in match.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert {r.page_id for r in W.resume_worklist(want, match, on=["page_id", "path"]).collect()} == {2, 3}


def test_pages_that_share_a_path(spark, tmp_path):
    """Two schemes of one address: each page keeps its own signature."""
    spark.createDataFrame([(k, f"{s}://x.org/{k // 2}", "y" * k) for k in range(60) for s in [("http", "https")[k % 2]]], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    q = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    good = {k for k in range(60) if k % 7 != 6 and k % 11 != 10 and k % 3 and k % 13 != 12}
    assert sorted(r.page_id for r in q("signature_read").collect()) == [k for k in range(60) if k % 7 != 6]
    assert sum(r.matches for r in q("signature_match").collect()) == len(good)
    assert {r.page_id for r in q("resume_worklist").collect()} == set(range(60)) - good


def test_samples_are_laid_out_at_their_step(spark):
    films = spark.createDataFrame([(1, 24.0, 100), (2, 25.0, 1), (3, 30.0, 0), (4, 0.5, 5)], "video_id long, fps double, total_frames long")
    frames = films.where("total_frames > 0").select("video_id", F.explode(F.expr("sequence(0L, total_frames - 1)")).alias("frame"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for s in (0.0, 0.3, 2.0):
        assert rows(SF.sample_films(films, s)) == rows(SF.sample_frames(frames, films, s).select("video_id", "frame"))
    p = plan(catalog.QUERIES["frame_sampling"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in p and "Exchange" not in p


def test_nearest_stills_of_blocks(spark):
    """Where hashes rule out nothing, blocks of both sides give what all pairs give, with copies, equal scores and a flat image."""
    from filmspark.functions import distances as D
    from filmspark.operators import reuse as U
    from filmspark.plans.standins import with_features

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (9, 64))
    img = lambda i: [7] * 64 if i % 13 == 0 else np.clip(base[rng.integers(9)] + rng.integers(-40, 41, 64) * (i % 4), 0, 255).tolist()
    a = with_features(spark.createDataFrame([(i, img(i)) for i in range(70)], "shot_id long, px array<int>")).localCheckpoint()
    b = with_features(spark.createDataFrame([(f"{i:03d}", img(i)) for i in range(90)], "path string, px array<int>")).localCheckpoint()
    s = a.select("shot_id", F.struct(*D.REUSE).alias("a")).crossJoin(b.select("path", F.struct(*D.REUSE).alias("b"))).withColumn("score", D.reuse_score(F.col("a"), F.col("b"), 63))
    want = s.where("round(score, 9) <= 0.3").groupBy("shot_id").agg(F.min(F.struct(F.round("score", 9).alias("s"), "path", "score")).alias("m"))
    want = {r.shot_id: (r.m.path, round(r.m.score, 8)) for r in want.collect()}
    got = lambda df: {r.shot_id: (r.path, round(r.score, 8)) for r in df.collect()}
    found = got(U.reuse_references(a, b, 0.3, 63))
    assert not {k: (found.get(k), v) for k, v in want.items() if found.get(k) != v} and len(found) == len(want) > 40
    (x, _), (y, _) = U._classes(a, "shot_id"), U._classes(b, "path")
    some = U._least_scores(x, y, (70, 90), 0.3, 63, rows=16)
    least = lambda df: {r.shot: r.s for r in df.groupBy("shot").agg(F.round(F.min("score"), 9).alias("s")).collect()}
    assert least(some) == least(U._least_scores(x, y, (70, 90), 0.3, 63))
    assert some.count() < 70 * 90 / 4 and "cross" not in plan(U.reuse_references(a, b, 0.3, 63)).lower()


def test_numbers_as_a_formatter_prints_them(spark):
    from filmspark.functions import scalar as S

    whole = spark.createDataFrame([(k,) for k in (0, 7, 9999, 10000, 123456, -5, 10**12)], "n long")
    assert all(r.a == f"{r.n:04d}" for r in whole.select("n", S.padded("n", 4).alias("a")).collect())
    some = spark.createDataFrame([(x,) for x in (0.0, -0.0, 0.5, 1 / 3, 2 / 3, 1e-7, 4.9999995, 2.0000005, 833.333333333, -1.25, -1e-9, 1e8 + 0.1, 1e300, float("nan"), float("inf"))], "x double")
    assert all(r.a == r.b for r in some.select(S.fixed("x", 6).alias("a"), F.format_string("%.6f", "x").alias("b")).collect())
    texts = spark.createDataFrame([(t,) for t in ("1:2:3", "1:2:3:4", "", " ", "5", "x:1", ":", None, " 1:2 ", "1:2:3:")], "t string")
    x = texts.withColumn("p", S.parse_time("t"))
    assert all(r.a == r.b and r.c == r.d for r in x.select(S.parse_time_lenient("t").alias("a"), S.parse_time_lenient("t", "p").alias("b"), S.parse_duration("t").alias("c"), S.parse_duration("t", "p").alias("d")).collect())
    assert [(r.a, r.b) for r in texts.select(S.parse_time_lenient("t").alias("a"), S.parse_duration("t").alias("b")).collect()][:8] == [(3723.0, 3723.0), (0.0, None), (0.0, None), (0.0, None), (5.0, 5.0), (0.0, None), (0.0, None), (0.0, None)]


def test_parsed_times_and_manifests_are_made_once(spark):
    p = plan(catalog.QUERIES["timecode_parse"](spark, "/root/testdata/sf0.001"))
    assert p.count("[+-]?[0-9]+") <= 3
    assert plan(catalog.QUERIES["manifest_write"](spark, "/root/testdata/sf0.001")).count("Window ") == 1


def test_many_small_files_share_tasks(spark, tmp_path):
    import hashlib

    n = 64 * spark.sparkContext.defaultParallelism + 40
    for k in range(n):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * (k + 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        f = SF.fingerprint_files(spark, str(tmp_path))
        assert f.rdd.getNumPartitions() < n
        assert {r["size"]: r.sha256 for r in f.collect()} == {k + 1: hashlib.sha256(b"x" * (k + 1)).hexdigest() for k in range(n)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_manifest_is_dealt_once(spark, no_broadcast):
    """The films' windows and joins keep the layout of the manifest: one exchange of either table."""
    for name in ("shot_bounds", "render_plan", "xfade_offsets", "transition_groups", "frame_blend_map", "shot_view"):
        assert plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).count("Exchange hashpartitioning") == 2, name


def test_tasks_stay_as_large(spark):
    rows = spark.range(10)
    assert S.dealt(rows, 10, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert S.dealt(rows, 100 * S.TASK_ROWS + 1, "id").rdd.getNumPartitions() == 101


def test_blends_take_one_order(spark, no_broadcast):
    """Groups and both kinds of rows come from one reading in one order: the manifest's sort, the join's and the film's."""
    for name in ("xfade_offsets", "frame_blend_map"):
        text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Union" not in text and text.count("Sort [") == 3, name


def test_offsets_start_with_each_group(spark):
    """Against the loop, over films of several groups."""
    rng, films = random.Random(5), {}
    for film in range(30):
        group, shots = 0, []
        for shot in range(rng.randint(1, 12)):
            fade = rng.choice([0, 0, 1, 3, 9])
            first = rng.randint(0, 50)
            shots.append((film, shot, group, fade, first, first + rng.randint(1, 20)))
            group += fade == 0
        films[film] = shots
    want, blends = [], []
    for shots in films.values():
        lines = {}
        for film, shot, group, _, first, end in shots:
            line = lines.setdefault(group, [])
            fade = max(1, shots[shot - 1][3]) if line else 0
            offset = max(0, line[-1][4] - fade) if line else 0
            line.append((film, shot, fade, offset, (line[-1][4] - fade if line else 0) + end - first, end - first))
        for group, line in lines.items():
            for k, (film, shot, fade, offset, _, n) in enumerate(line):
                want.append((film, shot, fade, offset))
                blends += [(film, group, offset + i, 1, line[k - 1][1], shot, i / fade) for i in range(fade)]
                alone = n - fade - (line[k + 1][2] if k + 1 < len(line) else 0)
                blends += [(film, group, offset + fade, alone, shot, None, 0.0)] if alone > 0 else []
    plans = spark.createDataFrame([s for f in films.values() for s in f], "video_id long, shot_index long, group_index long, transition long, plan_start long, plan_end long").withColumn("fps", F.lit(24.0))
    got = T.xfade_offsets(plans)
    assert sorted(tuple(r) for r in got.select("video_id", "shot_index", "fade_frames", "offset_frames").collect()) == sorted(want)
    assert sorted(map(str, map(tuple, T.frame_blend_map(got).collect()))) == sorted(map(str, blends))


def test_custom_chunks_are_laid_out_last(spark):
    """Against the loop, over random films and lengths; and no laid out chunk is sorted or moved."""
    rng = random.Random(7)
    films = [(v, rng.choice([1.0, 10.0, 24.0]), rng.randint(1, 400)) for v in range(60)]
    rows = [(v, rng.choice([0, 0, 1, 2, 3, 5, 9, 40, 500, -1]), rng.choice(["", "x", None, "0", "-3", "0.1", "2", "7", "50"]), k) for v, _, _ in films[:50] for k in range(rng.randint(0, 6))]
    videos = spark.createDataFrame(films, "video_id long, fps double, total_frames long")
    custom = spark.createDataFrame(rows, "video_id long, chunk_index long, custom_seconds string, row_index long")
    seconds = lambda s: None if s in ("", "x", None) else float(s)
    own = {(v, k): seconds(s) for v, k, s, _ in sorted(rows, key=lambda r: r[3])}
    for variant, default in (("script", 2.0), ("gui", 2.0), ("gui", 0.0)):
        want = []
        for v, fps, total in films:
            k = start = 0
            while True:
                s = own.get((v, k))
                s = default if s is None else s
                n = total if variant == "gui" and s <= 0 else max(1, round(s * fps))
                want.append((v, k, start, min(total, start + n)))
                if start + n >= total:
                    break
                k, start = k + 1, start + max(1, n - min(5, n - 1))
        got = C.chunk_ranges_custom(videos, custom, default, 5, variant)
        assert sorted(tuple(r) for r in got.select("video_id", "chunk_index", "start_frame", "end_frame").collect()) == want, (variant, default)
    kinds = re.findall(r"\b(Generate|Sort|Exchange|Window) ", plan(got))
    assert "Generate" not in kinds[kinds.index("Window") :]


def test_halves_of_split_shots_are_not_sorted(spark, no_broadcast):
    """Numbers come from the cuts before a shot; the halves follow each other as they are laid out."""
    shots = [(v, k, "" if (v + k) % 7 == 6 else f"00:00:{2 * k + 2:02d}.000", f"s{k}", f"c{k}", "true", "0.5") for v in range(4) for k in range(6)]
    manifest = spark.createDataFrame(shots, "video_id long, shot_index long, end string, source_reference string, color_reference string, fade_to_next string, crossfade_seconds string")
    edits = spark.createDataFrame([(0, 0, None), (0, 3, 6.5), (1, 5, None), (2, 9, 1.0), (3, 1, 99.0)], "video_id long, at long, seconds double")
    got = E.split_shots(manifest, edits)
    text = plan(got)
    assert "Generate" not in text[text.index("Sort [") :] and "Window" not in text[: text.index("Generate")]
    want, cuts = [], {(0, 0): "00:00:01.000", (0, 3): "00:00:06.500", (3, 1): "00:00:03.999"}
    for v in range(4):
        rows = []
        for _, k, end, source, color, fade, seconds in shots[6 * v : 6 * v + 6]:
            if (v, k) in cuts:
                rows += [(cuts[v, k], "", "", "false", ""), (end, "", "", fade, seconds)]
            else:
                rows.append((end, source, color, fade, seconds))
        want += [(v, i, *r) for i, r in enumerate(rows)]
    # the end of shot 5 of film 1 is blank, so it has no length and stays whole
    assert sorted(tuple(r) for r in got.select("video_id", "shot_index", "end", "source_reference", "color_reference", "fade_to_next", "crossfade_seconds").collect()) == want


def test_times_are_read_part_by_part(spark):
    """No array of parts is made for each use of one, and odd texts give what they gave."""
    assert "split(" not in plan(catalog.QUERIES["shot_view"](spark, "/root/testdata/sf0.001"))
    times = {"": 0.0, "7": 7.0, " 1:2.5 ": 62.5, "1:02:03.25": 3723.25, "x": None, "1.5:2": None, "9:1:2:3": 3723.0, ":5": None, "5:": None, "1::2": None, "-1:0": -60.0}
    got = spark.createDataFrame([(t,) for t in times], "t string").select("t", N.parse_time("t"), N.parse_time_lenient("t")).collect()
    assert {r[0]: r[1] for r in got} == times and {r[0]: r[2] for r in got} == {t: 0.0 if s is None or t.count(":") > 2 else s for t, s in times.items()}
    names = {"a/cut_0003_0.01.02.500.png": 62.5, "a\\cut_1_1.2.3.x": 3723.0, "cut_1_1.2.3.4.5.png": 3723.45, "cut_1_1.2.png": 0.0, "cut_0.01.02.500.png": 0.0, "Cut_1_0.0.1.png": 0.0, "cut__0.0.1.png": 1.0, "cut_1_0.x.1.png": 0.0, "cut_1_0.0.1.e.png": 0.0, "": 0.0}
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in names], "t string").select("t", N.reference_seconds("t")).collect()} == names
    stems = {"a/b.c.png": "b.c", ".a": ".a", "a.": "a.", "..": "..", "a/": "", "a\\b": "b", "é.ü": "é"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in stems], "t string").select("t", N.file_stem("t")).collect()} == stems
