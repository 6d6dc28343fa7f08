"""Edits of shot manifests, many at once: one edit for each film and call. Manifest rows are text as in their files; `end` is H:MM:SS text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmspark.functions.scalar import file_stem, format_timecode, nearest, parse_time_lenient, reference_seconds


def _film() -> Window:
    return Window.partitionBy("video_id").orderBy("shot_index")


def _renumbered(rows: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("shot_index", *order)
    return rows.withColumn("__n", F.row_number().over(w).cast("long") - 1).drop("shot_index", *order).withColumnRenamed("__n", "shot_index")


def shot_view(manifest: DataFrame, videos: DataFrame) -> DataFrame:
    """Times of each shot as an editor shows them. A blank, bad or zero end is the last end before it; a start is the previous end; the selected time
    comes from the reference's name, else the middle, and stays within the shot. end_frame is the last frame, inclusive."""
    w = _film()
    x = manifest.join(videos.select("video_id", "fps"), "video_id")
    # each text is read in a step of its own, once; one large expression would read it at each use
    x = x.withColumn("__e", parse_time_lenient("end")).withColumn("__stem", file_stem("source_reference")).withColumn("__named", reference_seconds("source_reference", "__stem")).drop("__stem")
    x = x.withColumn("end_seconds", F.coalesce(F.last(F.when(F.col("__e") != 0, F.col("__e")), ignorenulls=True).over(w), F.lit(0.0)))
    x = x.withColumn("start_seconds", F.lag("end_seconds", 1, 0.0).over(w))
    s, e, named = F.col("start_seconds"), F.col("end_seconds"), F.col("__named")
    middle = F.when(e > s, (s + e) / 2).otherwise(s)
    x = x.withColumn("selected_seconds", F.greatest(s, F.least(e, F.when(named != 0, named).otherwise(middle))))
    more = F.lead("shot_index").over(w).isNotNull()
    zero = F.lit(0).cast("long")
    return x.withColumns({
        "start_frame": nearest(s * F.col("fps")), "end_frame": F.greatest(zero, nearest(e * F.col("fps")) - 1), "can_split": e - s >= 0.1, "can_merge_next": more, "can_fade_next": more,
    }).drop("__e", "__named")


def merge_shots(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, at. Shot `at` takes the end and fade of the next one, which goes; without a next one nothing changes."""
    w = _film()
    x = manifest.join(edits.select("video_id", F.col("at").alias("__at")), "video_id", "left")
    nxt = {c: F.lead(c).over(w) for c in ("end", "fade_to_next", "crossfade_seconds", "shot_index")}
    x = x.withColumns({f"__{c}": v for c, v in nxt.items()})
    merge = (F.col("shot_index") == F.col("__at")) & F.col("__shot_index").isNotNull()
    x = x.withColumns({c: F.when(merge, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("end", "fade_to_next", "crossfade_seconds")})
    gone = F.coalesce(F.col("shot_index") == F.col("__at") + 1, F.lit(False)) & (F.col("__at") >= 0)
    return _renumbered(x.where(~gone).drop("__at", *(f"__{c}" for c in nxt)))


def split_shots(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, at, seconds (null: the middle). Shot `at` becomes two without references, the first without a fade; shots under a tenth of a second stay whole."""
    w = _film()
    # each end is read once; a start is the end before it
    x = manifest.withColumn("__e", parse_time_lenient("end"))
    x = x.withColumn("__s", F.coalesce(F.lag("__e").over(w), F.lit(0.0)))
    x = x.join(edits.select("video_id", F.col("at").alias("shot_index"), F.col("seconds").alias("__t"), F.lit(True).alias("__hit")), ["video_id", "shot_index"], "left")
    s, e = F.col("__s"), F.col("__e")
    x = x.withColumn("__cut", F.coalesce("__hit", F.lit(False)) & (e > s) & (e - s >= 0.1))
    # numbered in the order there is, with the cuts before a shot, so that the halves needn't be sorted
    x = x.withColumn("__n", F.row_number().over(w).cast("long") - 1 + F.coalesce(F.count_if("__cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("__at", F.greatest(s + 0.001, F.least(e - 0.001, F.coalesce(F.col("__t"), (s + e) / 2))))
    x = x.withColumn("__h", F.explode(F.when(F.col("__cut"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    cut, none = F.col("__cut"), F.lit("")
    one = cut & (F.col("__h") == 0)
    x = x.withColumns({
        "end": F.when(one, format_timecode("__at")).otherwise(F.col("end")), "source_reference": F.when(cut, none).otherwise(F.col("source_reference")), "color_reference": F.when(cut, none).otherwise(F.col("color_reference")),
        "fade_to_next": F.when(one, "false").otherwise(F.col("fade_to_next")), "crossfade_seconds": F.when(one, none).otherwise(F.col("crossfade_seconds")), "__n": F.col("__n") + F.col("__h"),
    })
    return x.drop("shot_index", "__s", "__e", "__t", "__hit", "__cut", "__at", "__h").withColumnRenamed("__n", "shot_index")


def move_boundaries(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, at, edge (`start` or `end`), seconds. Moves an edge, held between its neighbours. A start edge is the previous shot's end; the first start is fixed."""
    w = _film()
    x = manifest.withColumn("__e", parse_time_lenient("end"))
    x = x.withColumns({"__p": F.coalesce(F.lag("__e", 1).over(w), F.lit(0.0)), "__n": F.lead("__e").over(w)})
    ed = edits.select("video_id", F.when(F.col("edge") == "start", F.col("at") - 1).otherwise(F.col("at")).alias("shot_index"), F.col("edge").alias("__edge"), F.col("seconds").cast("double").alias("__t"))
    x = x.join(ed, ["video_id", "shot_index"], "left")
    # a start edge lies between the previous shot's start and this shot's end, less a millisecond
    start = F.when(F.col("__n").isNotNull(), F.greatest("__p", F.least(F.col("__n") - 0.001, "__t")))
    end = F.greatest(F.col("__p") + 0.001, F.least(F.greatest(F.col("__p") + 0.001, F.coalesce("__n", "__t")), F.col("__t")))
    new = F.when(F.col("__edge") == "start", start).when(F.col("__edge") == "end", end)
    return x.withColumn("end", F.when(new.isNotNull(), format_timecode(new)).otherwise(F.col("end"))).drop("__e", "__p", "__n", "__edge", "__t")


def set_fades(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, at, fade (boolean), seconds (text). Not on the last shot. A fade needs seconds above 0; they are written without trailing zeros."""
    last = F.lead("shot_index").over(_film()).isNull()
    x = manifest.withColumn("__last", last).join(edits.select("video_id", F.col("at").alias("shot_index"), F.col("fade").alias("__f"), F.col("seconds").alias("__t")), ["video_id", "shot_index"], "left")
    s = F.greatest(F.lit(0.0), F.coalesce(F.trim("__t").try_cast("double"), F.lit(0.0)))
    text = F.when(s > 0, F.regexp_replace(F.regexp_replace(F.format_string("%.3f", s), "0+$", ""), r"\.$", "")).otherwise("")
    hit = F.col("__f").isNotNull() & ~F.col("__last")
    x = x.withColumns({"fade_to_next": F.when(hit, F.when(F.col("__f") & (s > 0), "true").otherwise("false")).otherwise(F.col("fade_to_next")), "crossfade_seconds": F.when(hit, text).otherwise(F.col("crossfade_seconds"))})
    return x.drop("__last", "__f", "__t")


def continuity_references(rows: DataFrame, files: DataFrame, count: int, manual: DataFrame | None = None) -> DataFrame:
    """rows: video_id, shot_index, output. video_id, shot_index, place, path: for each row up to `count` references that exist (0: all): manual ones (video_id, place, path) first, then the outputs of
    the nearest earlier rows, each once.

    A film's rows are read in order with a list of its last distinct outputs, as many as can be asked for; so the work grows with the rows, not with their square.
    """
    kind = dict(rows.dtypes)["video_id"]
    have = files.select(F.col("path").alias("output")).distinct()
    made = rows.join(have.withColumn("__ok", F.lit(True)), "output", "left")
    both = made.select("video_id", "shot_index", F.when(F.col("__ok"), F.col("output")).alias("output"), F.lit(1).alias("kind"))
    if manual is not None:
        own = manual.join(have.withColumnRenamed("output", "path"), "path", "left_semi")
        # manual references come before a film's rows, in their own order
        both = both.unionByName(own.select("video_id", F.col("place").cast("long").alias("shot_index"), F.col("path").alias("output"), F.lit(0).alias("kind")))
    ordered = both.repartition("video_id").sortWithinPartitions("video_id", "kind", "shot_index", "output")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        film, hand, last = None, [], {}
        for pdf in batches:
            out = []
            for video, shot, output, k in zip(pdf.video_id.tolist(), pdf.shot_index.tolist(), pdf.output.tolist(), pdf.kind.tolist(), strict=True):
                if video != film:
                    film, hand, last = video, [], {}
                if k == 0:
                    hand.append(output)
                    continue
                found = hand[:count] if count else list(hand)
                for path in reversed(last):
                    if count and len(found) >= count:
                        break
                    if path not in hand:
                        found.append(path)
                out += [(video, shot, i, path) for i, path in enumerate(found)]
                if output is not None:
                    # a dict keeps the order of insertion: the newest output is last
                    last.pop(output, None)
                    last[output] = None
                    if count and len(last) > count + len(hand):
                        del last[next(iter(last))]
            yield pd.DataFrame(out, columns=["video_id", "shot_index", "place", "path"])

    return ordered.mapInPandas(run, f"video_id {kind}, shot_index long, place long, path string")
