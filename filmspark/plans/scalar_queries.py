"""Queries over the scalar and prompt functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmspark.functions import prompts as P
from filmspark.functions import scalar as X
from filmspark.plans import standins as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


HMS = lambda x: f"""(CASE WHEN CAST(round_even(({x})*1000,0) AS BIGINT) % 1000 > 0 THEN printf('%d:%02d:%02d.%03d', CAST(round_even(({x})*1000,0) AS BIGINT)//3600000, CAST(round_even(({x})*1000,0) AS BIGINT)//60000%60, CAST(round_even(({x})*1000,0) AS BIGINT)//1000%60, CAST(round_even(({x})*1000,0) AS BIGINT)%1000)
  ELSE printf('%d:%02d:%02d', CAST(round_even(({x})*1000,0) AS BIGINT)//3600000, CAST(round_even(({x})*1000,0) AS BIGINT)//60000%60, CAST(round_even(({x})*1000,0) AS BIGINT)//1000%60) END)"""  # noqa: E731
CODE = lambda x: f"printf('%02d:%02d:%06.3f', CAST(floor(greatest(0.0,{x})/3600) AS BIGINT), CAST(floor(greatest(0.0,{x})%3600/60) AS BIGINT), greatest(0.0,{x})%60)"


@query(f"SELECT l_orderkey, l_linenumber, {HMS('s')} AS time_text, {CODE('s - 100')} AS timecode FROM (SELECT *, l_quantity * 137 + l_discount AS s FROM lineitem)")
def timecode_format(spark, d):
    s = F.col("l_quantity") * 137 + F.col("l_discount")
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.format_time(s).alias("time_text"), X.format_timecode(s - 100).alias("timecode"))


TEXTS = ["q || ':' || n || ':0' || k || '.5'", "q || ':' || n || '.25'", "q || '.125'", "''", "'bad'", "q || ':x:2'", "'1:2:' || q || ':4'", "q || ':1.5:2'"]


def _timed(spark, d):
    q, n, k = (F.col(c).cast("long").cast("string") for c in ("l_quantity", "l_linenumber", "l_linenumber"))
    k = (F.col("l_partkey") % 8).cast("string")
    texts = [F.concat(q, F.lit(":"), n, F.lit(":0"), k, F.lit(".5")), F.concat(q, F.lit(":"), n, F.lit(".25")), F.concat(q, F.lit(".125")), F.lit(""), F.lit("bad"), F.concat(q, F.lit(":x:2")), F.concat(F.lit("1:2:"), q, F.lit(":4")), F.concat(q, F.lit(":1.5:2"))]
    text = F.element_at(F.array(*texts), (F.col("l_partkey") % 8 + 1).cast("int"))
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)::VARCHAR AS q, l_linenumber::VARCHAR AS n, (l_partkey % 8)::VARCHAR AS k, l_partkey % 8 AS m FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, CASE m {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(TEXTS))} END AS t FROM x),
p AS (SELECT *, string_split(t, ':') AS p, len(string_split(t, ':')) AS c FROM t),
w AS (SELECT *, CASE WHEN t = '' THEN 0.0 WHEN c = 1 THEN try_cast(p[1] AS DOUBLE) WHEN c = 2 THEN CASE WHEN regexp_matches(p[-2], '^[0-9]+$') THEN p[-2]::BIGINT * 60 + try_cast(p[-1] AS DOUBLE) END
  ELSE CASE WHEN regexp_matches(p[-2], '^[0-9]+$') AND regexp_matches(p[-3], '^[0-9]+$') THEN p[-3]::BIGINT * 3600 + p[-2]::BIGINT * 60 + try_cast(p[-1] AS DOUBLE) END END AS strict FROM p)
SELECT l_orderkey, l_linenumber, t AS text, strict, CASE WHEN c <= 3 THEN coalesce(strict, 0.0) ELSE 0.0 END AS lenient, CASE WHEN t <> '' AND c <= 3 THEN strict END AS duration FROM w"""
)
def timecode_parse(spark, d):
    x = _timed(spark, d).withColumn("strict", X.parse_time("t"))
    return x.select("l_orderkey", "l_linenumber", F.col("t").alias("text"), "strict", X.parse_time_lenient("t", "strict").alias("lenient"), X.parse_duration("t", "strict").alias("duration"))


@query(
    S.sql(
        "manifest",
        """SELECT video_id, shot_index, name, CASE WHEN video_id % 7 = 0 THEN 0.0 ELSE round(regexp_extract(name, '_([0-9]+)\\.', 1)::BIGINT * 3600 + regexp_extract(name, '_[0-9]+\\.([0-9]+)\\.', 1)::BIGINT * 60
  + regexp_extract(name, '_[0-9]+\\.[0-9]+\\.([0-9]+)\\.', 1)::BIGINT + ('0.' || regexp_extract(name, '_[0-9]+\\.[0-9]+\\.[0-9]+\\.([0-9]+)', 1))::DOUBLE, 6) END AS seconds
  FROM (SELECT *, CASE WHEN video_id % 7 = 0 THEN 'still_1.png' ELSE printf('cut_%04d_%02d.%02d.%06.3f.png', shot_index, CAST(floor(end_seconds/3600) AS BIGINT), CAST(floor(end_seconds%3600/60) AS BIGINT), end_seconds%60) END AS name FROM manifest)""",
    )
)
def reference_name_time(spark, d):
    m = S.manifest(spark, d).withColumn("name", F.when(F.col("video_id") % 7 == 0, "still_1.png").otherwise(X.reference_name("shot_index", "end_seconds")))
    return m.select("video_id", "shot_index", "name", F.round(X.reference_seconds(F.concat(F.lit("a/b/"), "name")), 6).alias("seconds"))


STEM = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '^(.+)\\.[^.]+$', '\\1'), ' ', '_', 'g'), '[^\\p{L}\\p{N}._-]', '_', 'g')"


@query(
    f"""SELECT page_id, {STEM} AS stem, {STEM} || '_' || CASE page_id % 3 WHEN 0 THEN '16x9' WHEN 1 THEN '2_39' ELSE '4x3' END || '_' || (1280 + page_id % 7) || 'x704' ||
  CASE WHEN page_id % 4 = 0 THEN '' ELSE printf('_crop%d-0-%d-0', page_id % 4, page_id % 9) END || '_wide.mp4' AS name FROM pages"""
)
def output_naming(spark, d):
    p = F.col("page_id")
    aspect = F.when(p % 3 == 0, "16:9").when(p % 3 == 1, "2.39").otherwise("4:3")
    crop = F.when(p % 4 == 0, X.crop_slug(*[F.lit(0)] * 4)).otherwise(X.crop_slug(p % 4, F.lit(0), p % 9, F.lit(0)))
    return S.table(spark, d, "pages").select("page_id", X.safe_stem("url").alias("stem"), X.output_name(F.col("url"), aspect, 1280 + p % 7, F.lit(704), crop, "wide").alias("name"))


SAFE = lambda x: f"CAST((CASE WHEN greatest(32,{x}) - greatest(32,{x})//32*32 <= 16 THEN greatest(32,{x})//32*32 ELSE greatest(32,{x})//32*32 + 32 END) AS BIGINT)"
SIZES = """SELECT p_partkey, aspect, height, CAST(round_even(ratio*height,0) AS BIGINT) + CAST(round_even(ratio*height,0) AS BIGINT) % 2 AS width, 2 * CAST(round_even(ratio*height/2,0) AS BIGINT) AS width2
  FROM (SELECT p_partkey, 200 + p_size * 17 AS height, CASE p_partkey % 5 WHEN 0 THEN '16:9' WHEN 1 THEN '2.39' WHEN 2 THEN '4:3' WHEN 3 THEN '9:16' ELSE 'wide' END AS aspect,
    CASE p_partkey % 5 WHEN 0 THEN 16.0::DOUBLE/9 WHEN 1 THEN 2.39::DOUBLE WHEN 2 THEN 4.0::DOUBLE/3 WHEN 3 THEN 9.0::DOUBLE/16 END AS ratio FROM part)"""


def _sizes(spark, d):
    k = F.col("p_partkey") % 5
    aspect = F.when(k == 0, "16:9").when(k == 1, "2.39").when(k == 2, "4:3").when(k == 3, "9:16").otherwise("wide")
    x = S.table(spark, d, "part").select("p_partkey", aspect.alias("aspect"), (200 + F.col("p_size") * 17).cast("long").alias("height"))
    return x.withColumns({"width": X.target_width(F.col("aspect"), F.col("height")), "width2": X.even_nearest(X.parse_aspect("aspect") * F.col("height"))})


@query(f"SELECT p_partkey, aspect, height::BIGINT AS height, width, greatest(2, width2) * CASE WHEN width IS NULL THEN NULL ELSE 1 END AS width_even FROM ({SIZES})")
def target_size(spark, d):
    return _sizes(spark, d).select("p_partkey", "aspect", "height", "width", F.when(F.col("width").isNotNull(), F.col("width2")).alias("width_even"))


@query(f"SELECT p_partkey, {SAFE('width')} AS safe_width, {SAFE('height')} AS safe_height FROM ({SIZES}) WHERE width IS NOT NULL")
def model_safe_size(spark, d):
    return _sizes(spark, d).where("width is not null").select("p_partkey", X.model_safe(F.col("width")).alias("safe_width"), X.model_safe(F.col("height")).alias("safe_height"))


@query(
    """SELECT p_partkey, l AS x, t AS y, w - w % 2 AS w, h - h % 2 AS h FROM (SELECT p_partkey, greatest(0, p_size - 5)::BIGINT AS l, (p_partkey % 7)::BIGINT AS t,
  greatest(2, 100 + p_partkey % 11 - greatest(0, p_size - 5) - p_size * 3)::BIGINT AS w, greatest(2, 90 - p_partkey % 7 - greatest(0, p_partkey % 5 - 2))::BIGINT AS h FROM part)"""
)
def crop_geometry(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    g = X.crop_geometry(100 + p % 11, F.lit(90), s - 5, s * 3, p % 7, p % 5 - 2)
    return S.table(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*")


@query(
    """SELECT p_partkey, w, h, (1280 - w) // 2 AS x, (704 - h) // 2 AS y FROM (SELECT p_partkey, CASE WHEN sw * 720 > sh * 1280 THEN 1280 ELSE CAST(round_even(sw * 720.0::DOUBLE / sh, 0) AS BIGINT) END::BIGINT AS w, 704::BIGINT AS h
  FROM (SELECT p_partkey, 400 + p_partkey % 900 AS sw, 300 + p_size * 4 AS sh FROM part))"""
)
def fit_geometry(spark, d):
    g = X.fit_geometry(400 + F.col("p_partkey") % 900, 300 + F.col("p_size") * 4, F.lit(1280), F.lit(720), F.lit(1280), F.lit(704))
    return S.table(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*")


@query(
    """SELECT p_partkey, t AS text, r AS rate, coalesce(r, 24.0) AS rate_or_24 FROM (SELECT p_partkey, t, round(CASE p_partkey % 6 WHEN 0 THEN p_size * 1000.0::DOUBLE / 1001 WHEN 1 THEN p_size::DOUBLE WHEN 4 THEN 23.5::DOUBLE END, 6) AS r
  FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN (p_size * 1000) || '/1001' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '0/0' WHEN 3 THEN '' WHEN 4 THEN '47/2' ELSE 'x/' || p_size END AS t FROM part))"""
)
def parse_rate(spark, d):
    k, s = F.col("p_partkey") % 6, F.col("p_size")
    t = F.when(k == 0, F.concat((s * 1000).cast("string"), F.lit("/1001"))).when(k == 1, s.cast("string")).when(k == 2, "0/0").when(k == 3, "").when(k == 4, "47/2").otherwise(F.concat(F.lit("x/"), s.cast("string")))
    x = S.table(spark, d, "part").select("p_partkey", t.alias("text"))
    return x.select("p_partkey", "text", F.round(X.parse_rate("text"), 6).alias("rate"), F.round(X.parse_rate("text", 24.0), 6).alias("rate_or_24"))


@query(
    """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round_even(b/1024.0::DOUBLE*10,0)/10) WHEN b < 1073741824 THEN printf('%.1f MB', round_even(b/1048576.0::DOUBLE*10,0)/10) WHEN b < 1099511627776 THEN printf('%.1f GB', round_even(b/1073741824.0::DOUBLE*10,0)/10) ELSE printf('%.1f TB', round_even(b/1099511627776.0::DOUBLE*10,0)/10) END AS size_text,
  CASE WHEN r >= 1e6 THEN printf('%.2f Mbps', r/1e6) WHEN r >= 1e3 THEN printf('%.1f Kbps', r/1e3) ELSE printf('%.0f bps', r) END AS rate_text,
  CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t//3600, t%3600//60, t%60) ELSE printf('%d:%02d', t//60, t%60) END AS duration_text
  FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 2000 WHEN 1 THEN o_custkey * 77 WHEN 2 THEN o_custkey * 7777 WHEN 3 THEN o_custkey * 7777777 ELSE o_custkey * 777777777777 END AS b,
    (CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 1000 WHEN 1 THEN (o_custkey % 999 + 1) * 1000 ELSE (o_custkey % 900 + 1) * 1000000 END)::DOUBLE AS r, CAST(round_even(o_totalprice / 13, 0) AS BIGINT) AS t FROM orders)"""
)
def human_units(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    b = F.when(k % 5 == 0, c % 2000).when(k % 5 == 1, c * 77).when(k % 5 == 2, c * 7777).when(k % 5 == 3, c * 7777777).otherwise(c * 777777777777)
    r = F.when(k % 3 == 0, c % 1000).when(k % 3 == 1, (c % 999 + 1) * 1000).otherwise((c % 900 + 1) * 1000000)
    return S.table(spark, d, "orders").select("o_orderkey", X.human_size(b).alias("size_text"), X.human_bitrate(r).alias("rate_text"), X.format_duration(F.col("o_totalprice") / 13).alias("duration_text"))


@query(
    S.sql(
        "videos",
        """SELECT video_id, i::BIGINT AS position, round(CASE WHEN dur > 45 THEN CASE i WHEN 0 THEN 0.0 WHEN 1 THEN least(10.0, dur*0.08) ELSE least(30.0, dur*0.18) END WHEN dur > 0 THEN CASE i WHEN 0 THEN 0.0 WHEN 1 THEN dur*0.33 ELSE dur*0.66 END ELSE CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 10.0 ELSE 30.0 END END::DOUBLE, 6) AS seconds
  FROM (SELECT video_id, CASE WHEN video_id % 9 = 0 THEN 0.0 ELSE total_frames / fps END AS dur FROM videos), range(3) AS r(i)""",
    )
)
def preview_positions(spark, d):
    v = S.videos(spark, d).withColumn("dur", F.when(F.col("video_id") % 9 == 0, 0.0).otherwise(F.col("total_frames") / F.col("fps")))
    return v.select("video_id", F.posexplode(X.preview_positions("dur")).alias("position", "seconds")).select("video_id", F.col("position").cast("long").alias("position"), F.round("seconds", 6).alias("seconds"))


@query(
    S.sql(
        "samples",
        """SELECT video_id, frame, a AS section_start, b AS section_end, round(CASE WHEN b > a THEN greatest(0.0, least(b - a, frame * 0.5 - a)) ELSE frame * 0.5 END::DOUBLE, 6) AS seconds
  FROM (SELECT video_id, frame, (CASE WHEN video_id % 3 = 0 THEN 0 ELSE video_id % 6 END)::DOUBLE AS a, (CASE WHEN video_id % 4 = 0 THEN 0 ELSE 2 + video_id % 9 END)::DOUBLE AS b FROM samples)""",
    )
)
def section_trim(spark, d):
    v = F.col("video_id")
    a = F.when(v % 3 == 0, F.lit("-2")).otherwise((v % 6).cast("string")).try_cast("double")
    b = F.when(v % 4 == 0, F.lit("none")).otherwise((2 + v % 9).cast("string")).try_cast("double")
    zero = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    return S.samples(spark, d).select("video_id", "frame", zero(a).alias("section_start"), zero(b).alias("section_end"), F.round(X.section_time(F.col("frame") * 0.5, a, b), 6).alias("seconds"))


@query(S.sql("files", "SELECT page_id, substr(sha1(path || '|' || mtime || '|' || size || '|' || printf('%.3f', page_id * 0.25) || '|' || printf('%.3f', page_id * 0.25 + 1.5) || '|k'), 1, 20) AS clip_key FROM files"))
def clip_key(spark, d):
    s = F.col("page_id") * 0.25
    return S.files(spark, d).select("page_id", X.clip_key(F.col("path"), F.col("mtime"), F.col("size"), s, s + 1.5, F.lit("k")).alias("clip_key"))


@query("""SELECT conv_id, turn, role, text, trim(concat_ws(' ', nullif(trim(text), ''), CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'warm light' END)) AS prompt FROM conversations""")
def prompt_combine(spark, d):
    suffix = F.when(F.col("turn") % 3 == 0, "  ").when(F.col("turn") % 3 == 1, " warm light ")
    return S.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", P.combine_prompt(F.col("text"), suffix).alias("prompt"))


@query(
    """SELECT conv_id, turn, role, text, trim(concat_ws(' ', 'Restore the frame.', CASE WHEN turn % 2 = 0 THEN 'soft' END, CASE WHEN conv_id % 2 = 0 THEN 'a static scene' END, CASE WHEN conv_id % 3 = 0 THEN '1. blue' END, nullif(trim(text), ''), CASE WHEN conv_id % 5 = 0 THEN 'no grain' END)) AS prompt FROM conversations"""
)
def prompt_build(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    p = P.build_prompt(F.lit(" Restore the frame. "), F.when(t % 2 == 0, "soft"), F.when(c % 2 == 0, "a static scene"), F.when(c % 3 == 0, "1. blue").otherwise(""), F.col("text"), F.when(c % 5 == 0, " no grain"))
    return S.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", p.alias("prompt"))


_OPENINGS = ["## Colour palette: ", "- Shadows: **deep**\n", "* Skin tone : pale ", ""]
_ENDING = " This palette and style should be applied to all."


def _described(text):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, _OPENINGS[0]).when(k == 1, _OPENINGS[1]).when(k == 2, _OPENINGS[2]).otherwise("")
    return F.concat(head, text, F.when(F.col("doc_id") % 3 == 0, "").otherwise(_ENDING))


# What is left of each opening is known, and the texts have bold marks but no other marks, labels or closing phrases of their own, so the words are counted instead of being cleaned.
@query(
    """WITH a AS (SELECT doc_id, list_filter(string_split_regex(CASE doc_id % 4 WHEN 1 THEN 'deep ' WHEN 2 THEN 'pale ' ELSE '' END || replace(text, '**', ''), '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT doc_id, w, list_transform(range(1, least(len(w), 221) + 1), lambda i: len(array_to_string(w[1:i], ' '))) AS ends FROM a),
c AS (SELECT doc_id, w, len(list_filter(ends, lambda e: e < 220)) AS fit, len(w) <= 221 AND coalesce(ends[len(w)], 0) <= 220 AS short FROM b)
SELECT doc_id, CASE WHEN short THEN array_to_string(w, ' ') ELSE rtrim(CASE WHEN fit = 0 THEN substr(w[1], 1, 220) ELSE array_to_string(w[1:fit], ' ') END, ' ,;:') || '.' END AS description FROM c"""
)
def text_compact(spark, d):
    return S.table(spark, d, "documents").select("doc_id", P.compact_description(_described(F.col("text"))).alias("description"))
