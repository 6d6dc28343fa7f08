"""Streams whose input comes late, out of order, and in several batches."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmspark.operators import shots as H
from filmspark.streaming import live
from filmspark.streaming.run import run_now

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SAMPLES = "video_id long, frame long, hist array<double>, color_hist array<double>, edge_hist array<double>, gray_small array<long>, dhash array<long>, mean_luma double, black_ratio double"


def arriving(spark, path, batches, schema):
    """A stream that gets one batch of rows after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={k}")
        for f in os.listdir(f"{path}/part={k}"):
            if f.endswith(".parquet"):
                # a file stream takes files in the order of their times
                os.utime(f"{path}/part={k}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_progress_in_any_order(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, at(10), "Chunk 2/9: x"), (1, at(5), "Wrote c"), (2, at(8), "Chunk 1/4:"), (3, at(1), "Wrote c")],
        [(1, at(3), "Chunk 1/9: x"), (2, at(400), "Wrote c"), (2, at(390), "Chunk 3/4:")],
        # the watermark is at 340 now: run 3 was silent for longer than 200 seconds
        [(1, at(395), "Chunk 5/9: x"), (1, at(396), None)],
        # the line at 20 is late
        [(2, at(900), "Wrote c"), (4, at(901), "hello"), (3, at(20), "Wrote late")],
        [(4, at(902), "Chunk 7/7:")],
    ]
    lines = arriving(spark, str(tmp_path / "in"), batches, "run_id long, ts timestamp, line string")
    stream = live.live_progress(lines, "Chunk ", ["Wrote"], "60 seconds", 200.0)
    got = {r.run_id: (r.done, r.current, r.total, r.closed) for r in run_now(stream, "update", "progress", ["run_id"]).collect()}
    # runs 1 and 3 are closed and out of the state
    assert got == {1: (1, 5, 9, True), 2: (2, 3, 4, False), 3: (1, 0, 0, True), 4: (0, 7, 7, False)}


def test_progress_of_one_hot_run(spark, tmp_path):
    """Lines are summed in their task: what is exchanged of a run doesn't grow with its lines."""
    rows = [[(1, START + dt.timedelta(milliseconds=i), f"Chunk {i % 50 + 1}/60:" if i % 2 else "Wrote") for i in range(4000)]]
    lines = arriving(spark, str(tmp_path / "in"), rows, "run_id long, ts timestamp, line string")
    r = run_now(live.live_progress(lines, "Chunk ", ["Wrote"]), "update", "hot", ["run_id"]).collect()
    assert [(x.done, x.current, x.total, x.closed) for x in r] == [(2000, 50, 60, False)]
    batch = spark.createDataFrame(rows[0], "run_id long, ts timestamp, line string")
    assert {(x.done, x.current, x.total) for x in live.stream_progress(batch, "Chunk ", ["Wrote"]).collect()} == {(2000, 50, 60)}


@pytest.mark.parametrize("step", [None, 1])
def test_frames_are_put_in_order(spark, tmp_path, step):
    """Frames that are up to 12 places late, over batches, give the scores of the whole films; a film without new frames is released by its timer."""
    rng = np.random.default_rng(2)
    rows = []
    for v, n in ((1, 90), (2, 60), (3, 1)):
        for f in range(n):
            rows.append((v, f, *(rng.random(4).tolist() for _ in range(3)), rng.integers(0, 256, 6).tolist(), [int(rng.integers(0, 1 << 60))], float(rng.random() * 255), float(rng.random()), START + dt.timedelta(seconds=f)))
    whole = spark.createDataFrame([r[:-1] for r in rows], SAMPLES)
    want = {(r.video_id, r.frame): r.score for r in H.adjacent_scores(whole).collect()}
    rows.sort(key=lambda r: r[1] + rng.random() * 12)
    batches = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    # a repeated frame, one that is far too late, and a film that moves the watermark on
    batches[-1] += [rows[-1], (1, 2, *rows[0][2:-1], START + dt.timedelta(seconds=2))]
    batches.append([(9, 0, *rows[0][2:-1], START + dt.timedelta(seconds=500))])
    batches.append([(9, 1, *rows[1][2:-1], START + dt.timedelta(seconds=501))])
    stream = live.stream_cut_scores(arriving(spark, str(tmp_path / "in"), batches, f"{SAMPLES}, ts timestamp"), 0.3, watermark="14 seconds", step=step)
    got = [(r.video_id, r.frame, r.score, r.is_cut) for r in run_now(stream, "append", "cuts").where(F.col("video_id") < 9).collect()]
    assert len(got) == len(want) and {(v, f) for v, f, _, _ in got} == set(want)
    for v, f, s, cut in got:
        assert s == pytest.approx(want[v, f], abs=1e-9) and cut == (s >= 0.3)
