"""Queries over timelines and chunks. Where the library has a closed form, the SQL is a recursion that restates the loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmspark.functions.scalar import is_enabled
from filmspark.operators import chunks as C
from filmspark.operators import timeline as T
from filmspark.plans import standins as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c: str):
    return F.round(c, 6).alias(c)


ENABLED = "SELECT * FROM manifest WHERE lower(trim(enabled)) NOT IN ('false','0','no','off')"
BOUNDS = {
    "ok": ENABLED,
    "r": """SELECT ok.video_id, ok.shot_index, fps, total_frames AS t, row_number() OVER (PARTITION BY ok.video_id ORDER BY shot_index) - 1 AS i, count(*) OVER (PARTITION BY ok.video_id) AS n,
  CAST(round_even(end_seconds*fps, 0) AS BIGINT) AS rr, fade_to_next, crossfade_seconds FROM ok JOIN videos USING (video_id)""",
    "x": """SELECT video_id, i, n, t, 0::BIGINT AS s, CASE WHEN n = 1 THEN t ELSE least(t, greatest(1, rr)) END AS e FROM r WHERE i = 0
  UNION ALL SELECT r.video_id, r.i, r.n, r.t, x.e, CASE WHEN r.i = r.n-1 THEN r.t ELSE least(r.t, greatest(x.e+1, r.rr)) END FROM x JOIN r ON r.video_id = x.video_id AND r.i = x.i + 1""",
    "b": "SELECT r.video_id, r.shot_index, r.i, r.fps, r.t, x.s, x.e, r.fade_to_next, r.crossfade_seconds FROM r JOIN x USING (video_id, i)",
}
TRANS = BOUNDS | {
    "tr0": """SELECT *, CAST(round_even(greatest(0.0, crossfade_seconds)*fps, 0) AS BIGINT) AS want, greatest(1, e - s) AS len, lead(greatest(1, e - s)) OVER (PARTITION BY video_id ORDER BY i) AS nlen FROM b""",
    "tr": "SELECT *, CASE WHEN nlen IS NULL OR fade_to_next <> 'true' OR want <= 0 THEN 0 ELSE greatest(1, least(want, len, nlen)) END::BIGINT AS n FROM tr0",
}
PLAN = TRANS | {
    "p0": "SELECT *, coalesce(lag(n) OVER (PARTITION BY video_id ORDER BY i), 0) AS pn FROM tr",
    "p": "SELECT *, greatest(0, s - pn // 2)::BIGINT AS ps, greatest(greatest(0, s - pn // 2) + 1, least(t, e + n - n // 2))::BIGINT AS pe FROM p0",
}
GROUPS = PLAN | {
    "g": "SELECT *, coalesce(sum((n = 0)::INT) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM p",
}
OFFSETS = GROUPS | {
    "o0": "SELECT *, row_number() OVER (PARTITION BY video_id, grp ORDER BY i) - 1 AS k FROM g",
    "o": """SELECT video_id, grp, i, k, 0::BIGINT AS fade, 0::BIGINT AS off, pe - ps AS acc FROM o0 WHERE k = 0
  UNION ALL SELECT c.video_id, c.grp, c.i, c.k, greatest(1, c.pn), greatest(0, o.acc - greatest(1, c.pn)), o.acc + c.pe - c.ps - greatest(1, c.pn) FROM o JOIN o0 c ON c.video_id = o.video_id AND c.grp = o.grp AND c.k = o.k + 1""",
    "of": "SELECT o0.*, o.fade, o.off FROM o0 JOIN o USING (video_id, grp, k)",
}


def _enabled(spark, d):
    return S.manifest(spark, d).where(is_enabled("enabled"))


def _bounds(spark, d):
    return T.shot_bounds(_enabled(spark, d), S.videos(spark, d))


def _plan(spark, d):
    return T.render_plan(T.shot_transitions(_bounds(spark, d)))


@query(S.sql("manifest", f"SELECT video_id, shot_index, round(end_seconds, 6) AS end_seconds FROM ({ENABLED})"))
def manifest_enabled(spark, d):
    return _enabled(spark, d).select("video_id", "shot_index", r6("end_seconds"))


@query(S.sql("videos manifest", "SELECT video_id, shot_index, s AS start_frame, e AS end_frame FROM b", **BOUNDS))
def shot_bounds(spark, d):
    return _bounds(spark, d).select("video_id", "shot_index", "start_frame", "end_frame")


@query(S.sql("videos manifest", "SELECT video_id, shot_index, n AS transition FROM tr", **TRANS))
def shot_transitions(spark, d):
    return T.shot_transitions(_bounds(spark, d)).select("video_id", "shot_index", "transition")


@query(S.sql("videos manifest", "SELECT video_id, shot_index, ps AS plan_start, pe AS plan_end, n AS transition FROM p", **PLAN))
def render_plan(spark, d):
    return _plan(spark, d).select("video_id", "shot_index", "plan_start", "plan_end", "transition")


@query(S.sql("videos manifest", "SELECT video_id, grp AS group_index, min(shot_index) AS first_shot, max(shot_index) AS last_shot, count(*) AS n_shots FROM g GROUP BY 1, 2", **GROUPS))
def transition_groups(spark, d):
    g = T.transition_groups(_plan(spark, d)).groupBy("video_id", "group_index")
    return g.agg(F.min("shot_index").alias("first_shot"), F.max("shot_index").alias("last_shot"), F.count("*").alias("n_shots"))


@query(S.sql("videos manifest", "SELECT video_id, shot_index, grp AS group_index, fade AS fade_frames, off AS offset_frames, round(off / fps, 6) AS offset_seconds FROM of", **OFFSETS))
def xfade_offsets(spark, d):
    return T.xfade_offsets(T.transition_groups(_plan(spark, d))).select("video_id", "shot_index", "group_index", "fade_frames", "offset_frames", r6("offset_seconds"))


@query(
    S.sql(
        "videos manifest",
        """SELECT video_id, grp AS group_index, off + l AS out_frame, 1::BIGINT AS n_frames, before AS shot_a, shot_index AS shot_b, round(l::DOUBLE / fade, 6) AS weight_b FROM (SELECT *, unnest(range(fade)) AS l FROM f WHERE fade > 0)
  UNION ALL SELECT video_id, grp, off + fade, pe - ps - fade - nfade, shot_index, NULL, 0.0 FROM f WHERE pe - ps > fade + nfade""",
        **OFFSETS,
        f="SELECT *, lag(shot_index) OVER (PARTITION BY video_id, grp ORDER BY k) AS before, coalesce(lead(fade) OVER (PARTITION BY video_id, grp ORDER BY k), 0) AS nfade FROM of",
    )
)
def frame_blend_map(spark, d):
    m = T.frame_blend_map(T.xfade_offsets(T.transition_groups(_plan(spark, d))))
    return m.select("video_id", "group_index", "out_frame", "n_frames", "shot_a", "shot_b", r6("weight_b"))


TIMES = """SELECT user_id AS video_id, event_id, (event_id % 97) / 10.0 - 0.5 AS seconds FROM events"""


@query(
    S.sql(
        "samples",
        "SELECT t.video_id, t.event_id, round(t.seconds, 6) AS seconds, f.frame, round(f.time, 6) AS time FROM t ASOF LEFT JOIN f ON t.video_id = f.video_id AND t.seconds >= f.time",
        t="SELECT user_id AS video_id, event_id, ((event_id % 97) / 10.0 - 0.5)::DOUBLE AS seconds FROM events",
        f="SELECT video_id, frame, frame * 0.7::DOUBLE AS time FROM samples",
    )
)
def frame_at_time(spark, d):
    frames = S.samples(spark, d).select("video_id", "frame", (F.col("frame") * F.lit(0.7)).alias("time"))
    times = S.table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_id", ((F.col("event_id") % 97) / 10.0 - 0.5).alias("seconds"))
    return T.frame_at_time(frames, times).select("video_id", "event_id", r6("seconds"), "frame", r6("time"))


RANGES = {
    "cr0": "SELECT *, greatest(1, CAST(round_even(SECONDS*fps, 0) AS BIGINT)) AS c FROM FILMS",
    "cr": """SELECT video_id, fps, total_frames, c, 0::BIGINT AS chunk_index, 0::BIGINT AS start_frame, least(total_frames, c) AS end_frame FROM cr0
  UNION ALL SELECT video_id, fps, total_frames, c, chunk_index + 1, start_frame + greatest(1, c - least(8, c - 1)), least(total_frames, start_frame + greatest(1, c - least(8, c - 1)) + c) FROM cr WHERE end_frame < total_frames""",
}
RAW = {"raw": "SELECT *, greatest(0, end_frame - start_frame - (video_id + chunk_index) % 13)::BIGINT AS raw_frames FROM cr"}


def _ranges_sql(films: str = "videos", seconds: str = "20.0") -> dict[str, str]:
    return {k: v.replace("SECONDS", seconds).replace("FILMS", films) for k, v in RANGES.items()}


def _raw(ranges):
    return ranges.withColumn("raw_frames", F.greatest(F.lit(0).cast("long"), F.col("end_frame") - F.col("start_frame") - (F.col("video_id") + F.col("chunk_index")) % 13))


@query(S.sql("videos", "SELECT video_id, chunk_index, start_frame, end_frame FROM cr", **_ranges_sql()))
def chunk_ranges(spark, d):
    return C.chunk_ranges(S.videos(spark, d)).select("video_id", "chunk_index", "start_frame", "end_frame")


@query(
    S.sql(
        "clips",
        "SELECT cr.video_id, i.frame, cr.chunk_index, i.frame - cr.start_frame AS chunk_frame FROM cr JOIN (SELECT video_id, unnest(range(total_frames)) AS frame FROM clips) i ON i.video_id = cr.video_id AND i.frame >= start_frame AND i.frame < end_frame",
        **_ranges_sql("clips", "2.0"),
    )
)
def frames_to_chunks(spark, d):
    v = S.clips(spark, d)
    runs = v.select("video_id", F.lit(0).cast("long").alias("first_frame"), F.col("total_frames").alias("n_frames"))
    intervals = C.chunk_ranges(v, 2.0).select("video_id", "chunk_index", "start_frame", "end_frame")
    return T.runs_to_intervals(runs, intervals).select("video_id", "frame", "chunk_index", (F.col("frame") - F.col("start_frame")).alias("chunk_frame"))


CUSTOM = {
    "cu": "SELECT video_id, shot_index AS chunk_index, CASE WHEN l_partkey % 11 = 0 THEN 'long' WHEN l_partkey % 7 = 0 THEN '0' ELSE CAST(l_quantity AS BIGINT)::VARCHAR END AS custom_seconds FROM manifest WHERE l_returnflag = 'A'",
    "su": "SELECT video_id, chunk_index, try_cast(custom_seconds AS DOUBLE) AS sec FROM cu",
    # the length of every chunk index that a film can have with a custom length, and of all others
    "v": "SELECT *, greatest(1, CAST(round_even(20.0*fps, 0) AS BIGINT)) AS c0 FROM videos",
}


def _custom_sql(zero: str) -> dict[str, str]:
    size = f"CASE WHEN su.sec IS NULL THEN v.c0 WHEN su.sec <= 0 THEN {zero} ELSE greatest(1, CAST(round_even(su.sec*v.fps, 0) AS BIGINT)) END"
    return CUSTOM | {
        "cr": f"""SELECT v.video_id, v.fps, v.total_frames, v.c0, 0::BIGINT AS chunk_index, 0::BIGINT AS start_frame, {size}::BIGINT AS c FROM v LEFT JOIN su ON su.video_id = v.video_id AND su.chunk_index = 0
  UNION ALL SELECT v.video_id, v.fps, v.total_frames, v.c0, q.chunk_index + 1, q.start_frame + greatest(1, q.c - least(8, q.c - 1)), {size}::BIGINT FROM (SELECT * FROM cr WHERE start_frame + c < total_frames) q JOIN v ON v.video_id = q.video_id LEFT JOIN su ON su.video_id = v.video_id AND su.chunk_index = q.chunk_index + 1"""
    }


def _custom(spark, d):
    m = S.manifest(spark, d).where("l_returnflag = 'A'")
    text = F.when(F.col("l_partkey") % 11 == 0, "long").when(F.col("l_partkey") % 7 == 0, "0").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return m.select("video_id", F.col("shot_index").alias("chunk_index"), text.alias("custom_seconds"))


_CUT = "SELECT video_id, chunk_index, start_frame, least(total_frames, start_frame + c) AS end_frame FROM cr"


@query(S.sql("videos manifest", _CUT, **_custom_sql("1")))
def chunk_ranges_custom(spark, d):
    return C.chunk_ranges_custom(S.videos(spark, d), _custom(spark, d)).select("video_id", "chunk_index", "start_frame", "end_frame")


@query(S.sql("videos manifest", _CUT, **_custom_sql("v.total_frames")))
def chunk_ranges_custom_gui(spark, d):
    return C.chunk_ranges_custom(S.videos(spark, d), _custom(spark, d), variant="gui").select("video_id", "chunk_index", "start_frame", "end_frame")


OLD = """SELECT video_id, shot_index AS chunk_index, CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR ELSE '' END AS seed, 'p' || l_partkey AS prompt_suffix, '' AS negative_suffix,
  CASE WHEN l_partkey % 3 = 0 THEN 'g' || l_partkey || '.png' ELSE '' END AS guide_image, CASE WHEN l_partkey % 4 = 0 THEN '12.5' ELSE '' END AS custom_seconds, '0.700' AS guide_strength FROM manifest"""


def _old(spark, d):
    m, p = S.manifest(spark, d), F.col("l_partkey")
    return m.select(
        "video_id", F.col("shot_index").alias("chunk_index"), F.when(p % 2 == 0, p.cast("string")).otherwise("").alias("seed"), F.concat(F.lit("p"), p.cast("string")).alias("prompt_suffix"), F.lit("").alias("negative_suffix"),
        F.when(p % 3 == 0, F.concat(F.lit("g"), p.cast("string"), F.lit(".png"))).otherwise("").alias("guide_image"), F.when(p % 4 == 0, "12.5").otherwise("").alias("custom_seconds"), F.lit("0.700").alias("guide_strength"),
    )


@query(
    S.sql(
        "videos manifest",
        """SELECT cr.video_id, cr.chunk_index, start_frame, end_frame, CASE WHEN coalesce(seed, '') <> '' THEN seed ELSE (42 + cr.chunk_index)::VARCHAR END AS seed,
  printf('%.6f', start_frame / fps) AS start_seconds, printf('%.6f', end_frame / fps) AS end_seconds, coalesce(prompt_suffix, '') AS prompt_suffix, coalesce(guide_image, '') AS guide_image, coalesce(custom_seconds, '') AS custom_seconds,
  printf('raw_%04d_%06d_%06d.mp4', cr.chunk_index, start_frame, end_frame) AS raw_path FROM cr LEFT JOIN old ON old.video_id = cr.video_id AND old.chunk_index = cr.chunk_index""",
        **_ranges_sql(),
        old=OLD,
    )
)
def chunk_sync(spark, d):
    return C.sync_chunks(C.chunk_ranges(S.videos(spark, d)), _old(spark, d)).select(
        "video_id", "chunk_index", "start_frame", "end_frame", "seed", "start_seconds", "end_seconds", "prompt_suffix", "guide_image", "custom_seconds", "raw_path"
    )


@query(
    S.sql(
        "manifest",
        """SELECT video_id, chunk_index, CASE WHEN edited THEN CAST(CAST(coalesce(nullif(new_seed, ''), nullif(seed, ''), (42 + chunk_index)::VARCHAR) AS DOUBLE) AS BIGINT)::VARCHAR ELSE seed END AS seed,
  CASE WHEN NOT edited THEN custom_seconds WHEN use_custom AND new_custom <> '' THEN printf('%.3f', greatest(0.1, new_custom::DOUBLE)) ELSE '' END AS custom_seconds,
  CASE WHEN edited AND try_cast(nullif(new_strength, '') AS DOUBLE) IS NOT NULL THEN printf('%.3f', greatest(0.0, least(1.0, try_cast(new_strength AS DOUBLE)))) ELSE guide_strength END AS guide_strength
  FROM (SELECT *, chunk_index % 2 = 0 AS edited, CASE WHEN video_id % 3 = 0 THEN '' ELSE (video_id % 1000)::VARCHAR || '.0' END AS new_seed, CASE WHEN video_id % 5 = 0 THEN '' ELSE '0.05' END AS new_custom,
    video_id % 2 = 0 AS use_custom, CASE video_id % 4 WHEN 0 THEN '1.7' WHEN 1 THEN 'much' WHEN 2 THEN '' ELSE '0.25' END AS new_strength FROM old)""",
        old=OLD,
    )
)
def chunk_override_update(spark, d):
    old, v = _old(spark, d), F.col("video_id")
    edits = old.where("chunk_index % 2 = 0").select(
        "video_id", "chunk_index", F.when(v % 3 == 0, "").otherwise(F.concat((v % 1000).cast("string"), F.lit(".0"))).alias("new_seed"), F.when(v % 5 == 0, "").otherwise("0.05").alias("new_custom_seconds"),
        (v % 2 == 0).alias("use_custom"), F.when(v % 4 == 0, "1.7").when(v % 4 == 1, "much").when(v % 4 == 2, "").otherwise("0.25").alias("new_strength"),
    )
    return C.update_chunks(old, edits).select("video_id", "chunk_index", "seed", "custom_seconds", "guide_strength")


@query(
    S.sql(
        "videos",
        """SELECT video_id, chunk_index, greatest(0, least(8, total_frames, CASE WHEN anchor = '' THEN 0 WHEN try_cast(anchor AS DOUBLE) IS NULL THEN 8 ELSE CAST(trunc(anchor::DOUBLE * fps) AS BIGINT) END))::BIGINT AS context_frames,
  greatest(0, pr - greatest(0, least(8, total_frames, CASE WHEN anchor = '' THEN 0 WHEN try_cast(anchor AS DOUBLE) IS NULL THEN 8 ELSE CAST(trunc(anchor::DOUBLE * fps) AS BIGINT) END)) - 1)::BIGINT * CASE WHEN pr IS NULL THEN NULL ELSE 1 END AS context_start
  FROM (SELECT *, lag(raw_frames) OVER (PARTITION BY video_id ORDER BY chunk_index) AS pr, CASE (video_id + chunk_index) % 5 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN '0.125' WHEN 3 THEN '1.0' ELSE '0' END AS anchor FROM raw)""",
        **_ranges_sql(),
        **RAW,
    )
)
def overlap_context(spark, d):
    k = (F.col("video_id") + F.col("chunk_index")) % 5
    x = _raw(C.chunk_ranges(S.videos(spark, d))).withColumn("anchor_seconds", F.when(k == 0, "").when(k == 1, "soon").when(k == 2, "0.125").when(k == 3, "1.0").otherwise("0"))
    return C.overlap_context(x.withColumns({"width": F.lit(1280), "height": F.lit(704)})).select("video_id", "chunk_index", "context_frames", "context_start")


STITCH = RAW | {
    "st0": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index DESC) = 1 AS last FROM raw",
    "st": """SELECT video_id, chunk_index, greatest(0, start_frame)::BIGINT AS gap, greatest(0, -start_frame)::BIGINT AS trim, raw_frames AS take, start_frame AS out_start, start_frame + raw_frames AS cursor, last, end_frame FROM st0 WHERE chunk_index = 0
  UNION ALL SELECT c.video_id, c.chunk_index, greatest(0, c.start_frame - st.cursor)::BIGINT, greatest(0, st.cursor - c.start_frame)::BIGINT, greatest(0, c.raw_frames - greatest(0, st.cursor - c.start_frame))::BIGINT, greatest(c.start_frame, st.cursor),
    greatest(c.start_frame, st.cursor) + greatest(0, c.raw_frames - greatest(0, st.cursor - c.start_frame)), c.last, c.end_frame FROM st JOIN st0 c ON c.video_id = st.video_id AND c.chunk_index = st.chunk_index + 1""",
    "sp": "SELECT *, CASE WHEN last THEN greatest(0, end_frame - cursor) ELSE 0 END::BIGINT AS final_gap FROM st",
}


@query(S.sql("videos", "SELECT video_id, chunk_index, gap, trim, take, out_start, final_gap FROM sp", **_ranges_sql(), **STITCH))
def stitch_plan(spark, d):
    return C.stitch_plan(_raw(C.chunk_ranges(S.videos(spark, d)))).select("video_id", "chunk_index", "gap", "trim", "take", "out_start", "final_gap")


@query(
    S.sql(
        "clips",
        """SELECT video_id, out_start + k AS out_frame, chunk_index, trim + k AS chunk_frame, false AS held FROM (SELECT *, unnest(range(take)) AS k FROM sp)
  UNION ALL SELECT video_id, out_start - gap + k, hc, hf, true FROM (SELECT *, unnest(range(gap)) AS k FROM sh)
  UNION ALL SELECT video_id, out_start + take + k, oc, of, true FROM (SELECT *, unnest(range(final_gap)) AS k FROM sh)""",
        **_ranges_sql("clips", "2.0"),
        **STITCH,
        sh="""SELECT *, last_value(CASE WHEN take > 0 THEN chunk_index END IGNORE NULLS) OVER b AS hc, last_value(CASE WHEN take > 0 THEN trim + take - 1 END IGNORE NULLS) OVER b AS hf,
  last_value(CASE WHEN take > 0 THEN chunk_index END IGNORE NULLS) OVER a AS oc, last_value(CASE WHEN take > 0 THEN trim + take - 1 END IGNORE NULLS) OVER a AS of FROM sp
  WINDOW b AS (PARTITION BY video_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    )
)
def stitch_frame_map(spark, d):
    return C.stitch_frame_map(C.stitch_plan(_raw(C.chunk_ranges(S.clips(spark, d), 2.0))))


@query(
    S.sql(
        "videos manifest",
        """SELECT raw.video_id, raw.chunk_index, CASE WHEN coalesce(guide_image, '') <> '' THEN guide_image ELSE lag(printf('raw_%04d.mp4', raw.chunk_index)) OVER w END AS guide_path,
  CASE WHEN coalesce(guide_image, '') <> '' THEN NULL ELSE greatest(0, lag(raw_frames) OVER w - 1) * CASE WHEN lag(raw_frames) OVER w IS NULL THEN NULL ELSE 1 END END::BIGINT AS guide_frame
  FROM raw LEFT JOIN old ON old.video_id = raw.video_id AND old.chunk_index = raw.chunk_index WINDOW w AS (PARTITION BY raw.video_id ORDER BY raw.chunk_index)""",
        **_ranges_sql(),
        **RAW,
        old=OLD,
    )
)
def auto_guide(spark, d):
    x = _raw(C.chunk_ranges(S.videos(spark, d))).withColumn("raw_path", F.format_string("raw_%04d.mp4", "chunk_index"))
    x = x.join(_old(spark, d).select("video_id", "chunk_index", "guide_image"), ["video_id", "chunk_index"], "left")
    return C.auto_guides(x).select("video_id", "chunk_index", "guide_path", "guide_frame")


@query(
    S.sql(
        "videos",
        """SELECT video_id, only_chunk, CASE WHEN e IS NOT NULL THEN 'error' WHEN l IS NOT NULL THEN 'stop' ELSE 'stitch' END AS status, coalesce(e, l) AS first_missing FROM (
  SELECT video_id, only_chunk, min(CASE WHEN gone AND chunk_index < only_chunk THEN chunk_index END) AS e, min(CASE WHEN gone AND chunk_index > only_chunk THEN chunk_index END) AS l
  FROM (SELECT video_id, chunk_index, video_id % 4 AS only_chunk, (video_id * 7 + chunk_index * 3) % 10 = 0 AS gone FROM cr) GROUP BY 1, 2)""",
        **_ranges_sql(),
    )
)
def partial_rerun_plan(spark, d):
    v = S.videos(spark, d)
    x = C.chunk_ranges(v).withColumn("raw_exists", (F.col("video_id") * 7 + F.col("chunk_index") * 3) % 10 != 0)
    return C.partial_rerun_plan(x, v.select("video_id", (F.col("video_id") % 4).alias("only_chunk")))
