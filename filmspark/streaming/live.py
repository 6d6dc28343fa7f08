"""The two things that arrive bit by bit: log lines of running jobs, and frames of films as they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from filmspark.operators.progress import chunk_counts, clamp_current, line_counts
from filmspark.operators.shots import FEATURES, centred_rows, matrix, pair_scores

_COUNTS = ["done", "current", "total"]


def stream_progress(lines: DataFrame, marker: str, done_prefixes: list[str]) -> DataFrame:
    """lines: run_id, line as they come (a stream or a table). run_id, done, current, total, for update or complete mode.

    Counts and maxima merge in whatever order lines arrive. All lines of a run count, not only its last ones. Runs are kept for ever: for streams without end see live_progress.
    """
    return clamp_current(lines.groupBy("run_id").agg(*chunk_counts(marker, done_prefixes)))


def live_progress(lines: DataFrame, marker: str, done_prefixes: list[str], watermark: str = "10 minutes", idle_seconds: float = 3600.0, time_col: str = "ts") -> DataFrame:
    """lines: run_id, line and an event time, a stream. run_id, done, current, total, last_seen, closed in update mode: a row of a run whenever it has new lines, the last one with closed = true.

    Lines count in any order, as counts and maxima do; a piece of lines that is older than the watermark as a whole is late and left out. A run is closed, and its state dropped, when the watermark is
    `idle_seconds` past its last line; lines after that open it anew. Lines are summed by run in each task before they are exchanged, so a run with most
    of the lines is no hot key. One run is one row of state.
    """
    kind = dict(lines.dtypes)["run_id"]
    counted = line_counts(lines.select("run_id", F.col(time_col).cast("timestamp").alias("last_seen"), "line"), marker, done_prefixes).drop("line")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby("run_id", as_index=False, dropna=False).agg({"done": "sum", "current": "max", "total": "max", "last_seen": "max"})

    pieces = counted.mapInPandas(partial, f"run_id {kind}, done long, current long, total long, last_seen timestamp").withWatermark("last_seen", watermark)

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, current, total, last = state.get if state.exists else (0, 0, 0, 0)
        closed = state.hasTimedOut
        # a timer's call has no lines
        for pdf in [] if closed else pdfs:
            done += int(pdf.done.sum())
            current, total = max(current, int(pdf.current.max())), max(total, int(pdf.total.max()))
            last = max(last, int(pdf.last_seen.max().value // 1_000_000))
        if closed:
            state.remove()
        else:
            state.update((done, current, total, last))
            state.setTimeoutTimestamp(max(last + int(idle_seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [key[0]], "done": [done], "current": [current], "total": [total], "last_seen": [pd.Timestamp(last, unit="ms")], "closed": [closed]})

    shape = f"run_id {kind}, done long, current long, total long, last_seen timestamp, closed boolean"
    rows = pieces.groupBy("run_id").applyInPandasWithState(fold, shape, "done long, current long, total long, last long", "update", GroupStateTimeout.EventTimeTimeout)
    return clamp_current(rows)


def _blob(rows: pd.DataFrame) -> bytes:
    table = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _rows(blob: bytes | None) -> pd.DataFrame | None:
    return pa.ipc.open_stream(blob).read_pandas() if blob else None


def _scores(rows: pd.DataFrame, bits: int) -> np.ndarray:
    """The score of each row but the first to the row before."""
    table = pa.RecordBatch.from_pandas(rows[FEATURES], preserve_index=False)
    f = centred_rows({c: matrix(table.column(c)) for c in FEATURES})
    return pair_scores({k: v[:-1] for k, v in f.items()}, {k: v[1:] for k, v in f.items()}, bits)


def stream_cut_scores(samples: DataFrame, threshold: float, bits: int = 256, watermark: str = "10 seconds", time_col: str = "ts", step: int | None = None) -> DataFrame:
    """samples: video_id, frame, features and an event time that grows with the frame, in any order. video_id, frame, score, is_cut (score at least `threshold`); append mode.

    A frame is scored once nothing can come before it: when the watermark has reached its time, or, with `step`, when it is `step` frames after the last one scored. Until then it waits in the film's
    state, so frames that come out of order are put in order as long as they are within the watermark; later ones are left out, as are times of 1970-01-01 00:00 or before. A timer on the first waiting frame wakes a
    film that gets no new frames. State: the last sample scored and those that wait. The first frame scores 0; of repeated frames the first to come counts. A threshold that
    depends on the whole film can't be had in a stream.
    """
    kind = dict(samples.dtypes)["video_id"]
    x = samples.select("video_id", "frame", F.col(time_col).cast("timestamp").alias("ts"), *FEATURES).withWatermark("ts", watermark)
    names = ["frame", "ts", *FEATURES]

    def score(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before, early = -1, None, None
        if state.exists:
            last, *blobs = state.get
            before, early = map(_rows, blobs)
        mark = state.getCurrentWatermarkMs()
        # a timer's call has no rows, but what waits may be ready
        pieces = [None] if state.hasTimedOut else pdfs
        for pdf in pieces:
            new = [p for p in (early, None if pdf is None else pdf[names]) if p is not None and len(p)]
            if not new:
                continue
            rows = new[0] if len(new) == 1 else pd.concat(new, ignore_index=True)
            rows = rows[rows.frame > last].drop_duplicates("frame").sort_values("frame")
            ready = (rows.ts.astype("datetime64[ms]").astype("int64") <= mark).to_numpy()
            # whatever lies before a ready frame is ready too
            n = int(np.flatnonzero(ready)[-1]) + 1 if ready.any() else 0
            if step is not None:
                frames = rows.frame.to_numpy()
                at = frames[n - 1] if n else last
                while n < len(frames) and (frames[n] == at + step or (at < 0 and frames[n] == 0)):
                    at = frames[n]
                    n += 1
            if n:
                now = rows.iloc[:n]
                s = _scores(now if before is None else pd.concat([before, now], ignore_index=True), bits)
                s = np.concatenate([[0.0], s]) if before is None else s
                yield pd.DataFrame({"video_id": [key[0]] * n, "frame": now.frame, "score": s, "is_cut": s >= threshold})
                before, last = now.iloc[-1:], int(now.frame.iloc[-1])
            early = rows.iloc[n:]
        waits = early is not None and len(early) > 0
        state.update((last, None if before is None else _blob(before), _blob(early) if waits else None))
        if waits:
            first = int(early.ts.min().value // 1_000_000)
            state.setTimeoutTimestamp(max(first - 1, mark + 1))

    return x.groupBy("video_id").applyInPandasWithState(score, f"video_id {kind}, frame long, score double, is_cut boolean", "last long, before binary, early binary", "append", GroupStateTimeout.EventTimeTimeout)
