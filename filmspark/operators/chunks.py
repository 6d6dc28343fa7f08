"""Overlapping render chunks of a film: ranges, overrides, and how rendered chunks are stitched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmspark.functions.scalar import fixed, nearest, padded


def _film(*order: str) -> Window:
    return Window.partitionBy("video_id").orderBy(*order)


def _zero() -> F:
    return F.lit(0).cast("long")


def chunk_ranges(videos: DataFrame, chunk_seconds: float = 20.0, overlap: int = 8) -> DataFrame:
    """video_id, chunk_index, start_frame, end_frame: chunks of one length, each starting `overlap` frames before the last one's end. A length of 0 is one chunk."""
    n, total = F.greatest(F.lit(1).cast("long"), nearest(F.lit(float(chunk_seconds)) * F.col("fps"))), F.col("total_frames")
    step = F.greatest(F.lit(1).cast("long"), n - F.greatest(_zero(), F.least(F.lit(overlap).cast("long"), n - 1)))
    one = F.lit(chunk_seconds <= 0) | (total <= 0) | (n >= total)
    x = videos.withColumn("__n", F.when(one, total).otherwise(n)).withColumn("__step", F.when(one, total).otherwise(step))
    last = F.when(one, _zero()).otherwise(F.ceil((total - n) / step).cast("long"))
    x = x.withColumn("chunk_index", F.explode(F.sequence(_zero(), last)))
    start = F.col("chunk_index") * F.col("__step")
    return x.select("video_id", "fps", "total_frames", "chunk_index", start.alias("start_frame"), F.least(total, start + F.col("__n")).alias("end_frame"))


def chunk_ranges_custom(videos: DataFrame, custom: DataFrame, chunk_seconds: float = 20.0, overlap: int = 8, variant: str = "script") -> DataFrame:
    """As chunk_ranges, with custom: (video_id, chunk_index, custom_seconds text) lengths for some chunks; blank or bad text is the default length.

    variant `script`: a default of 0 is one chunk, and a custom 0 one frame. variant `gui`: a length of 0 is all that remains. Only custom chunks are rows while starts are summed: the default
    chunks before or after one are a run with a closed form, cut where the film ends and laid out last, where they stay. A chunk moves on by a frame at least, so indices from total_frames on are beyond any film's end.
    Of rows with one index that with the greatest length text counts, where no column `row_index` tells which is the last.
    """
    total = F.col("total_frames")
    if variant == "script" and chunk_seconds <= 0:
        return chunk_ranges(videos, 0.0, overlap)
    size = lambda s: F.greatest(F.lit(1).cast("long"), nearest(s * F.col("fps")))
    sized = (lambda s: F.when(s <= 0, total).otherwise(size(s))) if variant == "gui" else size
    step = lambda n: F.greatest(F.lit(1).cast("long"), n - F.greatest(_zero(), F.least(F.lit(overlap).cast("long"), n - 1)))
    order = F.col("row_index") if "row_index" in custom.columns else F.col("custom_seconds")
    own = custom.where("chunk_index >= 0").select(F.col("video_id").alias("__v"), F.col("chunk_index").cast("long").alias("__k"), order.alias("__o"), F.when(order.isNotNull(), F.trim("custom_seconds").try_cast("double")).alias("__s"))
    # both sides are dealt by film, and the windows keep that; broadcast, the custom rows would be dealt again
    films = videos.where("total_frames > 0").select("video_id", "fps", "total_frames")
    x = films.hint("merge").join(own.hint("merge"), (F.col("video_id") == F.col("__v")) & (F.col("__k") < total), "left")
    x = x.withColumn("__later", F.lead("__k").over(_film("__k", "__o"))).where(F.coalesce(F.col("__later") != F.col("__k"), F.lit(True)))
    w = _film("__k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    default = F.lit(float(chunk_seconds))
    x = x.withColumns({"__n": sized(F.coalesce("__s", default)), "__dn": sized(default), "__i": F.row_number().over(w).cast("long") - 1, "__more": F.lead("__k").over(w) - F.col("__k") - 1})
    x = x.withColumns({"__step": step(F.col("__n")), "__dstep": step(F.col("__dn"))})
    x = x.withColumn("__at", F.coalesce(F.sum("__step").over(before), _zero()) + (F.col("__k") - F.col("__i")) * F.col("__dstep")).withColumn("__to", F.col("__at") + F.col("__step"))
    # ends of the default chunks before the first custom one, and of those between a custom one and the next
    run = lambda start, n: F.when(n > 0, start + (n - 1) * F.col("__dstep") + F.col("__dn"))
    x = x.withColumns({"__head": F.when(F.col("__i") == 0, run(_zero(), F.col("__k"))), "__end": F.col("__at") + F.col("__n")})
    x = x.withColumn("__past", F.greatest(F.coalesce(F.max(F.greatest("__head", "__end", run(F.col("__to"), F.col("__more")))).over(before), _zero()), "__head"))
    # so many default chunks reach the film's end from a start
    reach = lambda start: 1 + F.greatest(_zero(), F.ceil((total - start - F.col("__dn")) / F.col("__dstep")).cast("long"))
    run = lambda k, start, n: F.struct(k.alias("k"), start.alias("at"), n.alias("n"), F.col("__dstep").alias("step"), F.col("__dn").alias("size"))
    one = F.struct(F.col("__k").alias("k"), F.col("__at").alias("at"), F.lit(1).cast("long").alias("n"), F.col("__step").alias("step"), F.col("__n").alias("size"))
    pieces = F.array(
        F.when(F.col("__i") == 0, run(_zero(), _zero(), F.least(reach(_zero()), "__k"))),
        F.when(F.col("__k").isNotNull() & (F.col("__past") < total), one),
        F.when(F.col("__k").isNotNull() & (F.greatest("__past", "__end") < total), run(F.col("__k") + 1, F.col("__to"), F.least(reach(F.col("__to")), "__more"))),
    )
    x = x.select("video_id", "fps", "total_frames", F.explode(F.filter(pieces, lambda p: p["n"] > 0)).alias("p")).withColumn("__j", F.explode(F.sequence(_zero(), F.col("p.n") - 1)))
    start = F.col("p.at") + F.col("__j") * F.col("p.step")
    return x.select("video_id", "fps", "total_frames", (F.col("p.k") + F.col("__j")).alias("chunk_index"), start.alias("start_frame"), F.least(total, start + F.col("p.size")).alias("end_frame"))


def sync_chunks(ranges: DataFrame, existing: DataFrame, seed: int = 42) -> DataFrame:
    """Ranges with the overrides of existing rows (seed, prompt_suffix, negative_suffix, guide_image, custom_seconds; text). Rows beyond the last range go."""
    kept = ["seed", "prompt_suffix", "negative_suffix", "guide_image", "custom_seconds"]
    x = ranges.join(existing.select("video_id", "chunk_index", *kept), ["video_id", "chunk_index"], "left")
    six = lambda c: fixed(F.col(c) / F.col("fps"), 6)
    part = lambda kind: F.concat(F.lit(f"{kind}_"), padded("chunk_index", 4), F.lit("_"), padded("start_frame", 6), F.lit("_"), padded("end_frame", 6), F.lit(".mp4"))
    own = F.when(F.coalesce("seed", F.lit("")) != "", F.col("seed")).otherwise((F.col("chunk_index") + seed).cast("string"))
    return x.withColumns({"seed": own, "start_seconds": six("start_frame"), "end_seconds": six("end_frame"), "prepared_path": part("prepared"), "raw_path": part("raw")} | {c: F.coalesce(c, F.lit("")) for c in kept[1:]})


def update_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: video_id, chunk_index, new_seed, new_custom_seconds, use_custom, new_strength (text, but use_custom boolean). Edited rows get clean values."""
    x = chunks.join(edits, ["video_id", "chunk_index"], "left")
    edited = F.col("use_custom").isNotNull()
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    seed = F.coalesce(text("new_seed"), text("seed"), (F.col("chunk_index") + 42).cast("string")).try_cast("double").cast("long").cast("string")
    custom = F.when(F.col("use_custom") & text("new_custom_seconds").isNotNull(), F.format_string("%.3f", F.greatest(F.lit(0.1), F.col("new_custom_seconds").try_cast("double")))).otherwise(F.lit(""))
    number = text("new_strength").try_cast("double")
    strength = F.when(number.isNotNull(), F.format_string("%.3f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))).otherwise(F.col("guide_strength"))
    out = x.withColumns({"seed": F.when(edited, seed).otherwise(F.col("seed")), "custom_seconds": F.when(edited, custom).otherwise(F.col("custom_seconds")), "guide_strength": F.when(edited, strength).otherwise(F.col("guide_strength"))})
    return out.drop("new_seed", "new_custom_seconds", "use_custom", "new_strength")


def overlap_context(chunks: DataFrame, overlap: int = 8) -> DataFrame:
    """chunks: raw_frames, anchor_seconds (text), width, height. Adds context_frames taken from the previous chunk's end, context_start there (its last frame is taken too, and this
    chunk's first frame skipped), and geometry_error where the size changed."""
    w = _film("chunk_index")
    anchor = F.coalesce(F.when(F.coalesce(F.trim("anchor_seconds"), F.lit("")) == "", F.lit(0.0)).otherwise(F.trim("anchor_seconds").try_cast("double")) * F.col("fps"), F.lit(float(overlap)))
    n = F.greatest(_zero(), F.least(F.lit(overlap).cast("long"), F.col("total_frames"), anchor.cast("long")))
    before = F.lag("raw_frames").over(w)
    changed = (F.lag("width").over(w) != F.col("width")) | (F.lag("height").over(w) != F.col("height"))
    return chunks.withColumns({"context_frames": n, "context_start": F.when(before.isNotNull(), F.greatest(_zero(), before - n - 1)), "geometry_error": F.coalesce(changed, F.lit(False)) & (n > 0)})


def stitch_plan(chunks: DataFrame) -> DataFrame:
    """chunks: start_frame, end_frame, raw_frames. Adds out_start, gap (frames held before it), trim (frames cut from its head) and take, over one running end.

    The running end is the largest start + raw of the chunks before; a chunk whose frames are all covered takes none. final_gap on the last chunk
    fills up to the last range's end.
    """
    w = _film("chunk_index")
    end = F.col("start_frame") + F.col("raw_frames")
    x = chunks.withColumn("__cursor", F.greatest(_zero(), F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), _zero())))
    # a gap moves the running end to the chunk's start even if the chunk is empty
    trim = F.greatest(_zero(), F.col("__cursor") - F.col("start_frame"))
    x = x.withColumns({"gap": F.greatest(_zero(), F.col("start_frame") - F.col("__cursor")), "trim": trim, "take": F.greatest(_zero(), F.col("raw_frames") - trim), "out_start": F.greatest("start_frame", "__cursor")})
    last = F.lead("chunk_index").over(w).isNull()
    return x.withColumn("final_gap", F.when(last, F.greatest(_zero(), F.col("end_frame") - F.col("out_start") - F.col("take"))).otherwise(_zero())).drop("__cursor")


def stitch_frame_map(plan: DataFrame) -> DataFrame:
    """video_id, out_frame, chunk_index, chunk_frame, held: the chunk frame that each output frame shows; gaps hold the last frame shown before, null before any."""
    w = _film("chunk_index")
    shown = F.when(F.col("take") > 0, F.struct(F.col("chunk_index").alias("c"), (F.col("trim") + F.col("take") - 1).alias("f")))
    x = plan.withColumn("__held", F.last(shown, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__own", F.last(shown, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array(
        F.struct((F.col("out_start") - F.col("gap")).alias("at"), F.col("gap").alias("n"), F.col("__held.c").alias("c"), F.col("__held.f").alias("f"), F.lit(True).alias("held")),
        F.struct(F.col("out_start").alias("at"), F.col("take").alias("n"), F.col("chunk_index").alias("c"), F.col("trim").alias("f"), F.lit(False).alias("held")),
        F.struct((F.col("out_start") + F.col("take")).alias("at"), F.col("final_gap").alias("n"), F.col("__own.c").alias("c"), F.col("__own.f").alias("f"), F.lit(True).alias("held")),
    )
    p = x.select("video_id", F.explode(F.filter(pieces, lambda s: s["n"] > 0)).alias("p")).select("video_id", "p.*")
    p = p.withColumn("k", F.explode(F.sequence(_zero(), F.col("n") - 1)))
    return p.select("video_id", (F.col("at") + F.col("k")).alias("out_frame"), F.col("c").alias("chunk_index"), F.when(F.col("held"), F.col("f")).otherwise(F.col("f") + F.col("k")).alias("chunk_frame"), "held")


def auto_guides(chunks: DataFrame) -> DataFrame:
    """Adds guide_path and guide_frame: a chunk without a start guide uses the last frame of the chunk before it."""
    w = _film("chunk_index")
    own = F.when(F.coalesce("guide_image", F.lit("")) != "", F.col("guide_image"))
    return chunks.withColumns({"guide_path": F.coalesce(own, F.lag("raw_path").over(w)), "guide_frame": F.when(own.isNull() & F.lag("raw_frames").over(w).isNotNull(), F.greatest(_zero(), F.lag("raw_frames").over(w) - 1))})


def partial_rerun_plan(chunks: DataFrame, only: DataFrame) -> DataFrame:
    """chunks: chunk_index, raw_exists; only: video_id, only_chunk. video_id, only_chunk, status, first_missing: `error` where an earlier chunk is missing, `stop` where a later one is, else `stitch`."""
    x = chunks.join(only, "video_id")
    gone = lambda cond: F.min(F.when(~F.col("raw_exists") & cond, F.col("chunk_index")))
    g = x.groupBy("video_id", "only_chunk").agg(gone(F.col("chunk_index") < F.col("only_chunk")).alias("__e"), gone(F.col("chunk_index") > F.col("only_chunk")).alias("__l"))
    return g.select("video_id", "only_chunk", F.when(F.col("__e").isNotNull(), "error").when(F.col("__l").isNotNull(), "stop").otherwise("stitch").alias("status"), F.coalesce("__e", "__l").alias("first_missing"))
