"""Where each shot of a film starts and ends, how shots overlap in cross-fades, and which frames that takes.

Rows are keyed by video_id and ordered by shot_index. All of it is windows over one film; a film's rows are few and narrow, and films
are spread over tasks by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmspark.functions.scalar import is_truthy, nearest


def _film(*order: str) -> Window:
    return Window.partitionBy("video_id").orderBy(*order)


def shot_bounds(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """rows: enabled manifest rows with end_seconds. Adds fps, total_frames, start_frame and end_frame, half open.

    A shot ends at its rounded end, one frame after its start at least, and never after the film; the last one ends with the film. As a loop that is a recursion; with r the
    rounded end and i the shot's place, it is least(total, i + greatest(1, running maximum of r - i)).
    """
    w = _film("shot_index")
    x = rows.join(videos.select("video_id", "fps", "total_frames"), "video_id")
    x = x.withColumn("__i", F.row_number().over(w).cast("long") - 1).withColumn("__n", F.count("*").over(Window.partitionBy("video_id")))
    ahead = F.max(nearest(F.col("end_seconds") * F.col("fps")) - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.when(F.col("__i") == F.col("__n") - 1, F.col("total_frames")).otherwise(F.least(F.col("total_frames"), F.col("__i") + F.greatest(F.lit(1).cast("long"), ahead)))
    x = x.withColumn("end_frame", end)
    return x.withColumn("start_frame", F.lag("end_frame", 1, 0).over(w)).drop("__i", "__n")


def shot_transitions(bounds: DataFrame) -> DataFrame:
    """Adds transition: frames of the cross-fade to the next shot, no more than either shot has; 0 without one and for the last shot."""
    w = _film("shot_index")
    wanted = nearest(F.greatest(F.lit(0.0), F.coalesce(F.col("crossfade_seconds"), F.lit(0.0))) * F.col("fps"))
    size = F.greatest(F.lit(1).cast("long"), F.col("end_frame") - F.col("start_frame"))
    x = bounds.withColumn("__size", size).withColumn("__next", F.lead("__size").over(w))
    n = F.when(F.col("__next").isNull() | ~is_truthy("fade_to_next") | (wanted <= 0), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.least(wanted, "__size", "__next")))
    return x.withColumn("transition", n).drop("__size", "__next")


def render_plan(transitions: DataFrame) -> DataFrame:
    """Adds plan_start and plan_end: the frames to render, with half of each cross-fade on either side. A shot renders one frame at least."""
    before = F.coalesce(F.lag("transition").over(_film("shot_index")), F.lit(0))
    x = transitions.withColumn("plan_start", F.greatest(F.lit(0).cast("long"), F.col("start_frame") - F.floor(before / 2)))
    end = F.least(F.col("total_frames"), F.col("end_frame") + F.col("transition") - F.floor(F.col("transition") / 2))
    return x.withColumn("plan_end", F.greatest(F.col("plan_start") + 1, end))


def transition_groups(plan: DataFrame) -> DataFrame:
    """Adds group_index: shots linked by cross-fades share one."""
    before = _film("shot_index").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("group_index", F.coalesce(F.count_if(F.col("transition") == 0).over(before), F.lit(0)).cast("long"))


def xfade_offsets(groups: DataFrame) -> DataFrame:
    """Adds fade_frames, offset_frames and offset_seconds: where in its group's rendered stream a shot's fade-in starts (0 for the first). A group's shots follow one another.

    Sums run over the film, less what they were at the group's start, so that one order of the film's rows serves all."""
    w = _film("shot_index")
    x = groups.withColumn("__frames", F.col("plan_end") - F.col("plan_start")).withColumn("__first", ~F.lag("group_index").over(w).eqNullSafe(F.col("group_index")))
    x = x.withColumn("fade_frames", F.when(F.col("__first"), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.lag("transition").over(w))))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__at", F.coalesce(F.sum("__frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("fade_frames").over(upto))
    start = F.col("__at") - F.last(F.when(F.col("__first"), F.col("__at")), ignorenulls=True).over(upto)
    x = x.withColumn("offset_frames", F.greatest(F.lit(0).cast("long"), start))
    return x.withColumn("offset_seconds", F.col("offset_frames") / F.col("fps")).drop("__frames", "__first", "__at")


def frame_blend_map(offsets: DataFrame) -> DataFrame:
    """video_id, group_index, out_frame, n_frames, shot_a, shot_b, weight_b over a group's rendered stream.

    One row for each frame in a cross-fade, with the share of the later shot growing evenly from 0; and one row for each run of frames that one
    shot shows alone (shot_b null, n_frames its length). Rows grow with the fades, not with the film.
    """
    w = _film("shot_index")
    x = offsets.withColumn("__n", F.col("plan_end") - F.col("plan_start")).withColumn("__before", F.lag("shot_index").over(w))
    # a group's first shot has no fade, so the next shot's fade is one of the same group
    x = x.withColumn("__next", F.coalesce(F.lead("fade_frames").over(w), F.lit(0)))
    # frames of the fade, and one more row for what comes after it
    x = x.withColumn("__l", F.explode(F.sequence(F.lit(0), F.col("fade_frames"))))
    fades = F.col("__l") < F.col("fade_frames")
    alone = F.col("__n") - F.col("fade_frames") - F.col("__next")
    return x.where(fades | (alone > 0)).select(
        "video_id", "group_index", (F.col("offset_frames") + F.col("__l")).alias("out_frame"), F.when(fades, F.lit(1).cast("long")).otherwise(alone).alias("n_frames"),
        F.when(fades, F.col("__before")).otherwise(F.col("shot_index")).alias("shot_a"), F.when(fades, F.col("shot_index")).alias("shot_b"), F.when(fades, F.col("__l") / F.col("fade_frames")).otherwise(0.0).alias("weight_b"),
    )


def frame_at_time(frames: DataFrame, times: DataFrame) -> DataFrame:
    """times: video_id, seconds. Adds frame and time of the last frame at or before it, null before the first. Rows of both sides are merged in time order, not joined."""
    marks = times.select("video_id", F.col("seconds").alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("frame"), F.lit(None).cast("double").alias("time"), F.struct(*times.columns).alias("__row"))
    shown = frames.select("video_id", F.col("time").alias("__t"), F.lit(0).alias("__kind"), F.col("frame").cast("long").alias("frame"), F.col("time").cast("double").alias("time"), F.lit(None).alias("__row"))
    w = _film("__t", "__kind", "frame").rowsBetween(Window.unboundedPreceding, 0)
    both = shown.unionByName(marks).withColumns({"__f": F.last("frame", ignorenulls=True).over(w), "__at": F.last("time", ignorenulls=True).over(w)})
    return both.where("__kind = 1").select("__row.*", F.col("__f").alias("frame"), F.col("__at").alias("time"))


def _blocks(start: str, end: str, block: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block)))


def frames_to_intervals(frames: DataFrame, intervals: DataFrame, block: int = 512) -> DataFrame:
    """Frames with each half-open interval (start_frame, end_frame) that holds them. Intervals are cut into blocks of frames, so the join is on equal keys. Whole runs of frames are better left as runs: see runs_to_intervals."""
    cut = intervals.where("end_frame > start_frame").withColumn("__b", _blocks("start_frame", "end_frame", block))
    keyed = frames.withColumn("__b", F.floor(F.col("frame") / block))
    # Spark takes exploded rows for as few as they were before, and would broadcast them
    return keyed.hint("merge").join(cut.hint("merge"), ["video_id", "__b"]).where("frame >= start_frame and frame < end_frame").drop("__b")


def runs_to_intervals(runs: DataFrame, intervals: DataFrame, block: int = 512) -> DataFrame:
    """runs: video_id, first_frame, n_frames. The intervals' columns and frame: each frame of a run with each half-open interval (start_frame, end_frame) that holds it. Runs and intervals meet whole, in blocks
    of frames as an equal key; frames are laid out last, where they stay, so none is moved."""
    cut = intervals.where("end_frame > start_frame").withColumn("__b", _blocks("start_frame", "end_frame", block))
    keyed = runs.select("video_id", F.col("first_frame").alias("__r"), (F.col("first_frame") + F.col("n_frames")).alias("__z")).where("__z > __r").withColumn("__b", _blocks("__r", "__z", block))
    both = cut.hint("merge").join(keyed.hint("merge"), ["video_id", "__b"])
    first = F.greatest("start_frame", "__r", F.col("__b") * block)
    last = F.least("end_frame", "__z", (F.col("__b") + 1) * block) - 1
    return both.withColumns({"__r": first, "__z": last}).where("__r <= __z").withColumn("frame", F.explode(F.sequence("__r", "__z"))).drop("__b", "__r", "__z")
