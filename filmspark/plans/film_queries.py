"""Queries over shot detection, reuse, manifest edits and guides."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmspark.functions import distances as D
from filmspark.operators import edits as E
from filmspark.operators import guides as G
from filmspark.operators import reuse as R
from filmspark.operators import shots as H
from filmspark.plans import standins as S

QUERIES, ORACLES = {}, {}
BITS = 63


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


CENTRED = {
    "c": "SELECT *, list_transform(hist, lambda x: x - list_sum(hist)/8) AS ch, list_transform(color_hist, lambda x: x - list_sum(color_hist)/8) AS cc, list_transform(edge_hist, lambda x: x - list_sum(edge_hist)/8) AS ce FROM vectors"
}


def _hd(a: str, b: str) -> str:
    low = f"(list_dot_product({a},{a}) * list_dot_product({b},{b}))"
    return f"greatest(0.0, least(2.0, 1 - CASE WHEN {low} > 1e-12 THEN list_dot_product({a},{b}) / sqrt({low}) ELSE 1.0 END))"


def _ad(a: str, b: str) -> str:
    return f"(list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i])))::DOUBLE / 64 / 255)"


def _bd(a: str, b: str) -> str:
    return f"(list_sum(list_transform(range(1, 64), lambda i: ({a}[i] <> {b}[i])::INTEGER))::DOUBLE / 63)"


def _score(a: str, b: str, w: dict[str, float]) -> str:
    t = {"color_hist": _hd(f"{a}.cc", f"{b}.cc"), "hist": _hd(f"{a}.ch", f"{b}.ch"), "edge_hist": _hd(f"{a}.ce", f"{b}.ce"), "gray_small": _ad(f"{a}.px", f"{b}.px"), "dhash": _bd(f"{a}.bits", f"{b}.bits"), "mean_luma": f"abs({a}.mean_luma - {b}.mean_luma)/255", "black_ratio": f"abs({a}.black_ratio - {b}.black_ratio)"}
    return "(" + " + ".join(f"{v}::DOUBLE * {t[k]}" for k, v in w.items()) + ")"


PAIRS = CENTRED | {"q": "SELECT a.video_id, a.frame, a AS a, b AS b FROM c a JOIN c b ON b.video_id = a.video_id AND b.frame = a.frame + 1"}


def _neighbours(spark, d):
    v = S.vector_samples(spark, d)
    f = [c for c in v.columns if c not in ("video_id", "frame", "vec_id")]
    x = v.select("video_id", "frame", F.struct(*f).alias("a"))
    return x.join(x.select("video_id", (F.col("frame") - 1).alias("frame"), F.col("a").alias("b")), ["video_id", "frame"])


@query(S.sql("px vectors", f"SELECT video_id, frame, round({_hd('a.ch', 'b.ch')}, 6) AS gray, round({_hd('a.cc', 'b.cc')}, 6) AS colour FROM q", **PAIRS))
def hist_distance(spark, d):
    return _neighbours(spark, d).select("video_id", "frame", r6(D.hist_distance(F.col("a.hist"), F.col("b.hist"))).alias("gray"), r6(D.hist_distance(F.col("a.color_hist"), F.col("b.color_hist"))).alias("colour"))


@query(S.sql("px vectors", f"SELECT video_id, frame, round({_ad('a.px', 'b.px')}, 6) AS distance FROM q", **PAIRS))
def array_distance(spark, d):
    return _neighbours(spark, d).select("video_id", "frame", r6(D.array_distance(F.col("a.gray_small"), F.col("b.gray_small"))).alias("distance"))


@query(S.sql("px vectors", f"SELECT video_id, frame, round({_bd('a.bits', 'b.bits')}, 6) AS distance FROM q", **PAIRS))
def hash_distance(spark, d):
    return _neighbours(spark, d).select("video_id", "frame", r6(D.hash_distance(F.col("a.dhash"), F.col("b.dhash"), BITS)).alias("distance"))


@query(S.sql("px", "SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: (px[i+1] > px[i])::BIGINT * (1::BIGINT << (i-1))))::BIGINT AS dhash FROM px"))
def frame_dhash_bits(spark, d):
    return S.vector_samples(spark, d).select("vec_id", F.col("dhash")[0].alias("dhash"))


@query(S.sql("px vectors", f"SELECT video_id, frame, round({_score('a', 'b', D.TRANSITION)}, 6) AS score FROM q", **PAIRS))
def transition_score(spark, d):
    return _neighbours(spark, d).select("video_id", "frame", r6(D.transition_score(F.col("a"), F.col("b"), BITS)).alias("score"))


@query(S.sql("px vectors", f"SELECT video_id, frame, round({_score('a', 'b', D.REUSE)}, 6) AS score FROM q", **PAIRS))
def reuse_score(spark, d):
    return _neighbours(spark, d).select("video_id", "frame", r6(D.reuse_score(F.col("a"), F.col("b"), BITS)).alias("score"))


SCORES = CENTRED | {"s": f"SELECT b.video_id, b.frame, CASE WHEN a.frame IS NULL THEN 0.0 ELSE {_score('a', 'b', D.TRANSITION)} END AS score FROM c b LEFT JOIN c a ON a.video_id = b.video_id AND a.frame = b.frame - 1"}


@query(S.sql("px vectors", "SELECT video_id, frame, round(score, 6) AS score FROM s", **SCORES))
def adjacent_score(spark, d):
    return H.adjacent_scores(S.vector_samples(spark, d), BITS).select("video_id", "frame", r6("score").alias("score"))


@query(
    S.sql(
        "px vectors",
        "SELECT m.video_id, round(greatest(0.075, any_value(m.m) + 2.4 * greatest(1.4826 * quantile_cont(abs(score - m.m), 0.5), 0.001)), 6) AS threshold FROM m JOIN p USING (video_id) GROUP BY 1",
        **SCORES,
        p="SELECT * FROM s WHERE score > 0",
        m="SELECT video_id, quantile_cont(score, 0.5) AS m FROM p GROUP BY 1",
    )
)
def adaptive_threshold(spark, d):
    return H.adaptive_threshold(H.adjacent_scores(S.vector_samples(spark, d), BITS)).select("video_id", r6("threshold").alias("threshold"))


def _films(spark, d):
    return S.vector_samples(spark, d).groupBy("video_id").agg(F.count("*").alias("total_frames")).withColumn("fps", F.lit(4.0))


@query(
    S.sql(
        "px vectors",
        f"SELECT i.video_id, i.frame, round(CASE WHEN i.frame = greatest(0, i.frame - 6) OR i.frame = least(i.n - 1, i.frame + 6) THEN 0.0 ELSE {_score('a', 'b', D.TRANSITION)} END, 6) AS dissolve FROM i JOIN c a ON a.video_id = i.video_id AND a.frame = greatest(0, i.frame - 6) JOIN c b ON b.video_id = i.video_id AND b.frame = least(i.n - 1, i.frame + 6)",
        **CENTRED,
        i="SELECT video_id, frame, count(*) OVER (PARTITION BY video_id) AS n FROM c",
    )
)
def dissolve_score(spark, d):
    return H.dissolve_scores(S.vector_samples(spark, d), _films(spark, d), 1.5, BITS).select("video_id", "frame", r6("dissolve").alias("dissolve"))


# scalar scores of the event films
SCALAR = {"e": "SELECT *, CASE WHEN frame = 0 THEN 0.0 ELSE abs(mean_luma - lag(mean_luma) OVER (PARTITION BY video_id ORDER BY frame)) END AS score FROM samples", "f": "SELECT *, (black_ratio >= 0.72 OR mean_luma <= 18) AS dark FROM e"}


def _scalar(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("frame")
    return S.samples(spark, d).withColumn("score", F.coalesce(F.abs(F.col("mean_luma") - F.lag("mean_luma").over(w)), F.lit(0.0)))


@query(S.sql("samples", "SELECT video_id, frame, black_ratio >= 0.72 OR mean_luma <= 18 AS is_fade, black_ratio < 0.82 AND mean_luma BETWEEN 14 AND 242 AS usable FROM samples"))
def fade_flags(spark, d):
    return H.fade_flags(S.samples(spark, d)).select("video_id", "frame", "is_fade", "usable")


@query(S.sql("samples", "SELECT video_id, frame, score >= b AND score >= a AS local_peak, round(score - greatest(a, b), 6) AS peak_margin FROM (SELECT *, coalesce(lag(score) OVER w, 0) AS b, coalesce(lead(score) OVER w, 0) AS a FROM e WINDOW w AS (PARTITION BY video_id ORDER BY frame))", **SCALAR))
def local_peaks(spark, d):
    return H.local_peaks(_scalar(spark, d)).select("video_id", "frame", "local_peak", r6("peak_margin").alias("peak_margin"))


# the loop: an open span is carried from row to row
SPANS = SCALAR | {
    "o": """SELECT video_id, frame, dark, NULL::BIGINT AS opened, NULL::BIGINT AS s, NULL::BIGINT AS e FROM f WHERE frame = 0
  UNION ALL SELECT f.video_id, f.frame, f.dark, CASE WHEN f.dark AND NOT o.dark AND o.opened IS NULL THEN f.frame WHEN o.opened IS NOT NULL AND o.dark AND NOT f.dark THEN NULL ELSE o.opened END,
    CASE WHEN o.opened IS NOT NULL AND o.dark AND NOT f.dark THEN o.opened END, CASE WHEN o.opened IS NOT NULL AND o.dark AND NOT f.dark THEN f.frame END FROM o JOIN f ON f.video_id = o.video_id AND f.frame = o.frame + 1""",
    "sp": "SELECT video_id, s AS start_frame, e AS end_frame FROM o WHERE s IS NOT NULL",
}


@query(S.sql("samples", "SELECT * FROM sp", **SPANS))
def fade_spans(spark, d):
    return H.fade_spans(S.samples(spark, d))


@query(S.sql("samples", "SELECT sp.video_id, start_frame, end_frame, arg_max(frame, struct_pack(s := score, f := -frame)) AS boundary FROM sp JOIN f ON f.video_id = sp.video_id AND frame > start_frame AND frame <= end_frame GROUP BY 1, 2, 3", **SPANS))
def refine_boundary(spark, d):
    x = _scalar(spark, d)
    return H.refine_boundaries(H.fade_spans(x), x)


# The rules of a cut as facts of one sample, then a state (last boundary, its anchor, an open fade) that goes from sample to sample. A film here has 4 samples a second, so the least
# length is 4, the distance of soft boundaries 6, that of dissolves 16 and that of gradual changes 32.
SHOTS = SCORES | {
    "w": f"SELECT i.video_id, i.frame, CASE WHEN i.frame = 0 OR i.frame = i.n - 1 THEN 0.0 ELSE {_score('a', 'b', D.TRANSITION)} END AS dissolve FROM (SELECT video_id, frame, count(*) OVER (PARTITION BY video_id) AS n FROM c) i JOIN c a ON a.video_id = i.video_id AND a.frame = greatest(0, i.frame - 6) JOIN c b ON b.video_id = i.video_id AND b.frame = least(i.n - 1, i.frame + 6)",
    "mid": "SELECT video_id, quantile_cont(score, 0.5) AS m FROM s WHERE score > 0 GROUP BY 1",
    "lim": "SELECT s.video_id, greatest(0.075, any_value(m) + 2.4 * greatest(1.4826 * quantile_cont(abs(score - m), 0.5), 0.001)) AS t FROM s JOIN mid USING (video_id) WHERE score > 0 GROUP BY 1",
    "around": "SELECT s.video_id, s.frame, score, dissolve, coalesce(lag(score) OVER o, 0) AS sb, coalesce(lead(score) OVER o, 0) AS sa, coalesce(lag(dissolve) OVER o, 0) AS db, coalesce(lead(dissolve) OVER o, 0) AS da, coalesce(t, 0.075) AS t FROM s JOIN w ON w.video_id = s.video_id AND w.frame = s.frame LEFT JOIN lim ON lim.video_id = s.video_id WINDOW o AS (PARTITION BY s.video_id ORDER BY s.frame)",
    "fact": "SELECT a.video_id, a.frame, a.score, c.black_ratio >= 0.72 OR c.mean_luma <= 18 AS dark, (score >= sb AND score >= sa AND score >= t AND score - greatest(sb, sa) >= 0.01) OR score >= 1.8 * t AS hard, dissolve >= db AND dissolve >= da AND dissolve >= 0.2 AS crossed FROM around a JOIN c USING (video_id, frame)",
    "far": f"SELECT b.video_id, a.frame AS anchor, b.frame FROM c a JOIN c b ON b.video_id = a.video_id AND b.frame > a.frame WHERE {_score('a', 'b', D.TRANSITION)} >= 0.5",
    "fx": "SELECT fact.*, list(anchor) AS fars FROM fact LEFT JOIN far USING (video_id, frame) GROUP BY ALL",
    "st": """SELECT video_id, frame, dark, 0::BIGINT AS last, 0::BIGINT AS anchor, NULL::BIGINT AS opened, 0::BIGINT AS made FROM fx WHERE frame = 0
  UNION ALL SELECT video_id, frame, dark, coalesce(made, last), CASE WHEN made IS NULL THEN anchor ELSE frame END, CASE WHEN ends OR (made IS NOT NULL) THEN NULL WHEN starts THEN frame ELSE opened END, made FROM (
    SELECT *, CASE WHEN ends THEN CASE WHEN best_fade - last >= 6 THEN best_fade END WHEN frame - last < 4 THEN NULL WHEN hard THEN frame WHEN cross_ok THEN CASE WHEN frame - last >= 6 THEN frame END WHEN slow AND best_near - last >= 6 THEN best_near END AS made FROM (
      SELECT f.video_id, f.frame, f.dark, f.hard, p.last, p.anchor, p.opened, f.dark AND NOT p.dark AND p.opened IS NULL AS starts, p.opened IS NOT NULL AND p.dark AND NOT f.dark AS ends,
        (SELECT arg_max(g.frame, struct_pack(s := g.score, f := -g.frame)) FROM s g WHERE g.video_id = f.video_id AND g.frame > p.opened AND g.frame <= f.frame) AS best_fade,
        (SELECT arg_max(g.frame, struct_pack(s := g.score, f := -g.frame)) FROM s g WHERE g.video_id = f.video_id AND g.frame > f.frame - 3 AND g.frame <= f.frame) AS best_near,
        f.crossed AND f.frame - p.last >= 16 AS cross_ok, f.frame - p.last >= 32 AND f.score >= 0.004 AND list_contains(f.fars, p.anchor) AS slow
      FROM st p JOIN fx f ON f.video_id = p.video_id AND f.frame = p.frame + 1))""",
}


@query(S.sql("px vectors", "SELECT video_id, made AS boundary FROM st WHERE made IS NOT NULL", **SHOTS))
def detect_shots(spark, d):
    return H.detect_shots(S.vector_samples(spark, d), _films(spark, d), H.ShotParams(), BITS)


BOUNDS = {
    "bd": "SELECT video_id, frame AS boundary FROM samples WHERE frame % 7 = 0 OR black_ratio > 0.8 AND frame % 3 = 0",
    "tf": "SELECT video_id, max(frame) + 3 AS total_frames FROM samples GROUP BY 1",
    "sh": "SELECT bd.video_id, row_number() OVER w - 1 AS shot_index, boundary AS start_frame, coalesce(lead(boundary) OVER w, total_frames) AS end_frame FROM bd JOIN tf USING (video_id) WINDOW w AS (PARTITION BY bd.video_id ORDER BY boundary)",
}


def _shots(spark, d):
    x = S.samples(spark, d)
    b = x.where("frame % 7 = 0 or black_ratio > 0.8 and frame % 3 = 0").select("video_id", F.col("frame").alias("boundary"))
    return H.shots_from_boundaries(b, x.groupBy("video_id").agg((F.max("frame") + 3).alias("total_frames")))


@query(S.sql("samples", "SELECT * FROM sh", **BOUNDS))
def shots_from_boundaries(spark, d):
    return _shots(spark, d)


@query(S.sql("samples", "SELECT s.video_id, s.frame, sh.shot_index FROM samples s JOIN sh ON sh.video_id = s.video_id AND s.frame >= start_frame AND s.frame < end_frame", **BOUNDS))
def samples_to_shots(spark, d):
    return H.assign_samples(S.samples(spark, d), _shots(spark, d)).select("video_id", "frame", "shot_index")


REP = BOUNDS | {
    "sparse": "SELECT * FROM samples WHERE frame % 5 <> 0 OR frame = 0",
    "j": "SELECT sh.*, s.frame, s.mean_luma, s.black_ratio, s.sharpness, (black_ratio < 0.82 AND mean_luma BETWEEN 14 AND 242) AS ok FROM sh LEFT JOIN sparse s ON sh.video_id = s.video_id AND s.frame >= start_frame AND s.frame < end_frame",
    "k": "SELECT *, bool_or(ok) OVER (PARTITION BY video_id, shot_index) AS any_ok FROM j",
    "l": "SELECT *, max(sharpness) OVER (PARTITION BY video_id, shot_index) AS ms FROM k WHERE frame IS NULL OR ok OR NOT any_ok",
    "m": "SELECT *, sharpness / CASE WHEN ms = 0 THEN 1.0 ELSE ms END - 1.8::DOUBLE * black_ratio - 0.35::DOUBLE * abs(mean_luma - 92) / 255 - 0.65::DOUBLE * abs(frame - (start_frame + end_frame) / 2::DOUBLE) / greatest(1, end_frame - start_frame) AS merit FROM l",
}


@query(S.sql("samples", "SELECT video_id, shot_index, coalesce(frame, (start_frame + end_frame) // 2) AS frame, round(coalesce(mean_luma, 128.0), 6) AS mean_luma FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_index ORDER BY merit DESC, frame) AS r FROM m) WHERE r = 1", **REP))
def representative_frame(spark, d):
    sparse = S.samples(spark, d).where("frame % 5 <> 0 or frame = 0")
    return H.representative_frames(sparse, _shots(spark, d)).select("video_id", "shot_index", "frame", r6("mean_luma").alias("mean_luma"))


@query(S.sql("manifest", "SELECT video_id, count(*) AS n_shots, count(*) FILTER (l_partkey % 3 = 0) AS n_reused, count(*) FILTER (l_partkey % 3 <> 0) AS n_new FROM manifest GROUP BY 1"))
def shot_summary(spark, d):
    m = S.manifest(spark, d).withColumn("reused_color_from", F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string")))
    return H.shot_summary(m)


@query(S.sql("manifest", "SELECT video_id, shot_index FROM manifest WHERE shot_index < 2"))
def limit_per_video(spark, d):
    return H.limit_per_video(S.manifest(spark, d), ["shot_index"], 2).select("video_id", "shot_index")


@query(
    S.sql(
        "px vectors",
        f"SELECT shot_id, path, round(score, 6) AS score FROM (SELECT a.vec_id AS shot_id, 'still_' || b.vec_id || '.png' AS path, {_score('a', 'b', D.REUSE)} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_score('a', 'b', D.REUSE)}, 'still_' || b.vec_id || '.png') AS r FROM c a JOIN c b ON a.video_id < 5 AND b.video_id >= 5) WHERE r = 1 AND score <= 0.3",
        **CENTRED,
    )
)
def reuse_references(spark, d):
    v = S.vector_samples(spark, d)
    lib = v.where("video_id >= 5").withColumn("path", F.concat(F.lit("still_"), F.col("vec_id").cast("string"), F.lit(".png")))
    got = R.reuse_references(v.where("video_id < 5").withColumnRenamed("vec_id", "shot_id"), lib, 0.3, BITS)
    return got.select("shot_id", "path", r6("score").alias("score"))


@query("SELECT 'img' || (page_id // 2) AS rel_path, 'bw/' || page_id AS bw_path, 'color/' || p2 AS color_path FROM pages JOIN (SELECT page_id AS p2 FROM pages WHERE page_id % 3 = 0) ON page_id // 2 = p2 // 2 WHERE page_id % 2 = 0")
def reference_pairs(spark, d):
    p = S.table(spark, d, "pages").select("page_id", F.concat(F.lit("img"), F.floor(F.col("page_id") / 2).cast("string")).alias("rel_path"))
    path = lambda k: F.concat(F.lit(k), F.col("page_id").cast("string")).alias("path")
    return R.reference_pairs(p.where("page_id % 2 = 0").select("rel_path", path("bw/")), p.where("page_id % 3 = 0").select("rel_path", path("color/")))


# ---- edits


def secs(c: str) -> str:
    """Lenient seconds of HH:MM:SS.mmm text."""
    return f"(coalesce(try_cast(string_split({c}, ':')[1] AS BIGINT) * 3600 + try_cast(string_split({c}, ':')[2] AS BIGINT) * 60 + try_cast(string_split({c}, ':')[3] AS DOUBLE), 0.0))"


def code(x: str) -> str:
    return f"printf('%02d:%02d:%06.3f', CAST(floor(greatest(0.0,{x})/3600) AS BIGINT), CAST(floor(greatest(0.0,{x})%3600/60) AS BIGINT), greatest(0.0,{x})%60)"


ED = {"m": """SELECT video_id, shot_index, enabled, CASE WHEN (video_id + shot_index) % 11 = 0 THEN '' ELSE "end" END AS "end", source_reference, color_reference, fade_to_next, crossfade_seconds FROM edited"""}
_KEEP = ["video_id", "shot_index", "end", "source_reference", "color_reference", "fade_to_next", "crossfade_seconds"]


def _edited(spark, d):
    m = S.edited_manifest(spark, d)
    return m.withColumn("end", F.when((F.col("video_id") + F.col("shot_index")) % 11 == 0, "").otherwise(F.col("end")))


@query(
    S.sql(
        "videos manifest edited",
        """SELECT video_id, shot_index, round(s, 6) AS start_seconds, round(e, 6) AS end_seconds, round(greatest(s, least(e, CASE WHEN n <> 0 THEN n WHEN e > s THEN (s + e) / 2 ELSE s END)), 6) AS selected_seconds,
  CAST(round_even(s * fps, 0) AS BIGINT) AS start_frame, greatest(0, CAST(round_even(e * fps, 0) AS BIGINT) - 1)::BIGINT AS end_frame, e - s >= 0.1 AS can_split, shot_index < last AS can_merge_next
  FROM (SELECT x.*, fps, max(shot_index) OVER (PARTITION BY x.video_id) AS last, CASE WHEN source_reference = '' THEN 0.0 ELSE """
        + secs("regexp_replace(regexp_extract(source_reference, '_([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)', 1), '^([0-9]+)\\.([0-9]+)\\.', '\\1:\\2:')")
        + """ END AS n FROM x JOIN videos USING (video_id))""",
        **ED,
        x=f"""SELECT video_id, shot_index, source_reference, 0.0::DOUBLE AS s, {secs('"end"')} AS e FROM m WHERE shot_index = 0
  UNION ALL SELECT m.video_id, m.shot_index, m.source_reference, x.e, CASE WHEN {secs('m."end"')} = 0 THEN x.e ELSE {secs('m."end"')} END FROM x JOIN m ON m.video_id = x.video_id AND m.shot_index = x.shot_index + 1""",
    )
)
def shot_view(spark, d):
    v = E.shot_view(_edited(spark, d), S.videos(spark, d))
    return v.select("video_id", "shot_index", r6("start_seconds").alias("start_seconds"), r6("end_seconds").alias("end_seconds"), r6("selected_seconds").alias("selected_seconds"), "start_frame", "end_frame", "can_split", "can_merge_next")


@query(
    S.sql(
        "manifest edited",
        """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY shot_index) - 1 AS shot_index, CASE WHEN hit THEN ne ELSE "end" END AS "end", source_reference, color_reference, CASE WHEN hit THEN nf ELSE fade_to_next END AS fade_to_next, CASE WHEN hit THEN nc ELSE crossfade_seconds END AS crossfade_seconds
  FROM (SELECT m.*, shot_index = video_id % 4 AND lead(shot_index) OVER w IS NOT NULL AS hit, lead("end") OVER w AS ne, lead(fade_to_next) OVER w AS nf, lead(crossfade_seconds) OVER w AS nc FROM m WINDOW w AS (PARTITION BY video_id ORDER BY shot_index)) WHERE shot_index <> video_id % 4 + 1""",
        **ED,
    )
)
def shot_merge(spark, d):
    m = _edited(spark, d)
    return E.merge_shots(m, m.select("video_id").distinct().withColumn("at", F.col("video_id") % 4)).select(*_KEEP)


@query(
    S.sql(
        "manifest edited",
        f"""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY shot_index, h) - 1 AS shot_index, CASE WHEN hit AND h = 0 THEN {code('greatest(s + 0.001, least(e - 0.001, t))')} ELSE "end" END AS "end", CASE WHEN hit THEN '' ELSE source_reference END AS source_reference, CASE WHEN hit THEN '' ELSE color_reference END AS color_reference,
  CASE WHEN hit AND h = 0 THEN 'false' ELSE fade_to_next END AS fade_to_next, CASE WHEN hit AND h = 0 THEN '' ELSE crossfade_seconds END AS crossfade_seconds
  FROM (SELECT *, unnest(CASE WHEN hit THEN [0, 1] ELSE [0] END) AS h FROM (SELECT *, shot_index = video_id % 3 AND e > s AND e - s >= 0.1 AS hit, CASE WHEN video_id % 2 = 0 THEN (s + e) / 2 ELSE s + 0.25 END AS t
    FROM (SELECT m.*, coalesce({secs('lag("end") OVER (PARTITION BY video_id ORDER BY shot_index)')}, 0.0) AS s, {secs('"end"')} AS e FROM m)))""",
        **ED,
    )
)
def shot_split(spark, d):
    from pyspark.sql import Window

    from filmspark.functions.scalar import parse_time_lenient

    m = _edited(spark, d)
    s = F.coalesce(parse_time_lenient(F.lag("end").over(Window.partitionBy("video_id").orderBy("shot_index"))), F.lit(0.0))
    edits = m.withColumn("seconds", F.when(F.col("video_id") % 2 == 1, s + 0.25)).where("shot_index = video_id % 3").select("video_id", F.col("shot_index").alias("at"), "seconds")
    return E.split_shots(m, edits).select(*_KEEP)


@query(
    S.sql(
        "manifest edited",
        f"""SELECT video_id, shot_index, CASE WHEN edge = 'start' AND shot_index = k - 1 AND n IS NOT NULL THEN {code('greatest(p, least(n - 0.001, t))')} WHEN edge = 'end' AND shot_index = k THEN {code('greatest(p + 0.001, least(greatest(p + 0.001, coalesce(n, t)), t))')} ELSE "end" END AS "end", fade_to_next
  FROM (SELECT m.*, coalesce({secs('lag("end") OVER w')}, 0.0) AS p, CASE WHEN lead("end") OVER w IS NULL THEN NULL ELSE {secs('lead("end") OVER w')} END AS n, video_id % 5 AS k, CASE WHEN video_id % 2 = 0 THEN 'start' ELSE 'end' END AS edge, (video_id % 97)::DOUBLE AS t FROM m WINDOW w AS (PARTITION BY video_id ORDER BY shot_index))""",
        **ED,
    )
)
def shot_boundary_move(spark, d):
    m = _edited(spark, d)
    v = F.col("video_id")
    edits = m.select("video_id").distinct().select("video_id", (v % 5).alias("at"), F.when(v % 2 == 0, "start").otherwise("end").alias("edge"), (v % 97).cast("double").alias("seconds"))
    return E.move_boundaries(m, edits).select("video_id", "shot_index", "end", "fade_to_next")


@query(
    S.sql(
        "manifest edited",
        """SELECT video_id, shot_index, CASE WHEN hit THEN CASE WHEN video_id % 2 = 0 AND s > 0 THEN 'true' ELSE 'false' END ELSE fade_to_next END AS fade_to_next, CASE WHEN NOT hit THEN crossfade_seconds WHEN s > 0 THEN regexp_replace(regexp_replace(printf('%.3f', s), '0+$', ''), '\\.$', '') ELSE '' END AS crossfade_seconds
  FROM (SELECT m.*, shot_index = video_id % 4 AND lead(shot_index) OVER (PARTITION BY video_id ORDER BY shot_index) IS NOT NULL AS hit, CASE video_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.125 ELSE 0.0 END::DOUBLE AS s FROM m)""",
        **ED,
    )
)
def shot_fade_set(spark, d):
    m, v = _edited(spark, d), F.col("video_id")
    text = F.when(v % 5 == 0, "0.5").when(v % 5 == 1, "2").when(v % 5 == 2, "-1").when(v % 5 == 3, "0.125").otherwise("soon")
    edits = m.select("video_id").distinct().select("video_id", (v % 4).alias("at"), (v % 2 == 0).alias("fade"), text.alias("seconds"))
    return E.set_fades(m, edits).select("video_id", "shot_index", "fade_to_next", "crossfade_seconds")


@query(
    S.sql(
        "manifest",
        """SELECT video_id, shot_index, r - 1 AS place, path FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_index ORDER BY k, p) AS r FROM (
  SELECT a.video_id, a.shot_index, 0 AS k, 0 AS p, 'hand' || a.video_id AS path FROM manifest a WHERE a.video_id % 3 = 0
  UNION ALL SELECT a.video_id, a.shot_index, 1, -max(b.shot_index), 'out' || b.l_partkey FROM manifest a JOIN manifest b ON b.video_id = a.video_id AND b.shot_index < a.shot_index AND b.l_partkey % 4 <> 0 GROUP BY a.video_id, a.shot_index, b.l_partkey)) WHERE r <= 3""",
    )
)
def continuity_references(spark, d):
    m = S.manifest(spark, d).withColumn("output", F.concat(F.lit("out"), F.col("l_partkey").cast("string")))
    hand = m.where("video_id % 3 = 0").select("video_id").distinct().select("video_id", F.lit(0).alias("place"), F.concat(F.lit("hand"), F.col("video_id").cast("string")).alias("path"))
    files = m.where("l_partkey % 4 <> 0").select(F.col("output").alias("path")).union(hand.select("path"))
    return E.continuity_references(m.select("video_id", "shot_index", "output"), files, 3, hand)


# ---- guides

CHUNKS = """SELECT video_id, shot_index AS chunk_index, l_partkey, CASE l_partkey % 4 WHEN 0 THEN '[{"frame_idx": ' || (l_partkey % 20) || ', "strength": 0.5, "image": "g' || l_partkey % 50 || '.png"}, {"frame_idx": 0, "strength": 0.8, "image": "g' || l_partkey % 7 || '.png"}, {"frame_idx": ' || (l_partkey % 30) || ', "image": "h.png"}]' WHEN 1 THEN '[bad' ELSE '' END AS guide_frames,
  CASE WHEN l_partkey % 5 < 3 THEN 'g' || l_partkey % 40 || '.png' ELSE '' END AS guide_image, CASE l_partkey % 3 WHEN 0 THEN '0.25' WHEN 1 THEN '' ELSE 'strong' END AS guide_strength, CASE WHEN l_partkey % 7 = 0 THEN 'g' || l_partkey % 30 || '.png' ELSE '' END AS guide_end_image, '' AS guide_end_strength FROM manifest"""
LEGACY = """SELECT video_id, chunk_index, (row_number() OVER (PARTITION BY video_id, chunk_index ORDER BY o) - 1)::BIGINT AS place, frame_idx, strength, image FROM (
  SELECT video_id, chunk_index, 0 AS o, 0::BIGINT AS frame_idx, CASE WHEN l_partkey % 3 = 0 THEN 0.25 ELSE 0.7 END::DOUBLE AS strength, guide_image AS image FROM ch WHERE guide_image <> '' AND (WHEN_BAD)
  UNION ALL SELECT video_id, chunk_index, 1, -1, 1.0, guide_end_image FROM ch WHERE guide_end_image <> '' AND (WHEN_BAD))"""
JSON = """SELECT video_id, chunk_index, 0::BIGINT AS place, l_partkey % 20 AS frame_idx, 0.5::DOUBLE AS strength, 'g' || l_partkey % 50 || '.png' AS image FROM ch WHERE l_partkey % 4 = 0
  UNION ALL SELECT video_id, chunk_index, 1, 0, 0.8, 'g' || l_partkey % 7 || '.png' FROM ch WHERE l_partkey % 4 = 0 UNION ALL SELECT video_id, chunk_index, 2, l_partkey % 30, NULL, 'h.png' FROM ch WHERE l_partkey % 4 = 0"""
GUIDES = {"ch": CHUNKS, "g": f"{JSON} UNION ALL {LEGACY.replace('WHEN_BAD', 'l_partkey % 4 > 1')}"}


def _chunks(spark, d):
    m, k = S.manifest(spark, d), F.col("l_partkey")
    s = lambda c: c.cast("string")
    js = F.concat(F.lit('[{"frame_idx": '), s(k % 20), F.lit(', "strength": 0.5, "image": "g'), s(k % 50), F.lit('.png"}, {"frame_idx": 0, "strength": 0.8, "image": "g'), s(k % 7), F.lit('.png"}, {"frame_idx": '), s(k % 30), F.lit(', "image": "h.png"}]'))
    png = lambda c: F.concat(F.lit("g"), s(c), F.lit(".png"))
    return m.select(
        "video_id", F.col("shot_index").alias("chunk_index"), F.when(k % 4 == 0, js).when(k % 4 == 1, "[bad").otherwise("").alias("guide_frames"), F.when(k % 5 < 3, png(k % 40)).otherwise("").alias("guide_image"),
        F.when(k % 3 == 0, "0.25").when(k % 3 == 1, "").otherwise("strong").alias("guide_strength"), F.when(k % 7 == 0, png(k % 30)).otherwise("").alias("guide_end_image"), F.lit("").alias("guide_end_strength"),
    )


@query(S.sql("manifest", "SELECT * FROM g", **GUIDES))
def guide_frames(spark, d):
    return G.guide_frames(_chunks(spark, d))


@query(S.sql("manifest", f"SELECT * FROM ({JSON} UNION ALL {LEGACY.replace('WHEN_BAD', 'l_partkey % 4 > 0')})", ch=CHUNKS))
def guide_frames_migrated(spark, d):
    return G.guide_frames(_chunks(spark, d), migrate_on_bad_json=True)


@query(
    S.sql(
        "manifest",
        """SELECT video_id, chunk_index, place, frame_idx, image, kind, coalesce(strength, CASE kind WHEN 'start' THEN 0.7 ELSE 1.0 END)::DOUBLE AS strength FROM (SELECT *, CASE WHEN frame_idx = 0 AND place = min(CASE WHEN frame_idx = 0 THEN place END) OVER (PARTITION BY video_id, chunk_index) THEN 'start' ELSE 'extra' END AS kind FROM g WHERE image <> 'h.png' AND regexp_extract(image, '([0-9]+)', 1)::INT % 6 <> 5)""",
        **GUIDES,
    )
)
def guide_split(spark, d):
    files = spark.range(60).where("id % 6 <> 5").select(F.concat(F.lit("g"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    return G.guide_split(G.guide_frames(_chunks(spark, d)), files)


@query(S.sql("manifest", "SELECT video_id, chunk_index, CASE WHEN frame_idx < 0 THEN frame_idx ELSE frame_idx // 8 * 8 END::BIGINT AS position, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1", **GUIDES))
def guide_duplicates(spark, d):
    return G.guide_duplicates(G.guide_frames(_chunks(spark, d)))


@query(S.sql("manifest", "SELECT video_id, chunk_index, place, round(greatest(2.0 * chunk_index, least(2.0 * chunk_index + 1.5 - 1.0::DOUBLE/24, 2.0 * chunk_index + CASE WHEN frame_idx < 0 THEN greatest(0, 36 + frame_idx) ELSE frame_idx END / 24.0::DOUBLE))::DOUBLE, 6) AS seconds FROM g", **GUIDES))
def guide_seconds(spark, d):
    g = G.guide_frames(_chunks(spark, d))
    s = F.col("chunk_index") * 2.0
    return g.select("video_id", "chunk_index", "place", r6(G.guide_seconds(s, s + 1.5, F.lit(36).cast("long"), F.col("frame_idx"), F.lit(24.0))).alias("seconds"))
