"""Queries over sources, resume logic, inventories and progress."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from filmspark.operators import inventory as I
from filmspark.operators import progress as P
from filmspark.operators import resume as R
from filmspark.plans import standins as S
from filmspark.sources import files as SF
from filmspark.sources import manifests as SM
from filmspark.sources.shared import shared_dir

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- sources


def _texts(spark, d):
    """A manifest file for each film, from the manifest stand-in."""
    rows = S.edited_manifest(spark, d, "end_seconds").withColumn("prompt", F.when(F.col("shot_index") % 3 == 0, F.lit('warm, "old" light')).otherwise(""))
    films = rows.select("video_id").distinct().select("video_id", F.concat(F.lit("in/"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("source"), F.lit(120.0).alias("duration"))
    return SM.manifest_texts(rows, films)


_HMS = "CASE WHEN ms % 1000 > 0 THEN printf('%d:%02d:%02d.%03d', ms//3600000, ms//60000%60, ms//1000%60, ms%1000) ELSE printf('%d:%02d:%02d', ms//3600000, ms//60000%60, ms//1000%60) END"
_ROW = {"z": f"SELECT *, {_HMS} AS end_text FROM (SELECT *, CAST(round_even(least(end_seconds, 120.0) * 1000, 0) AS BIGINT) AS ms FROM edited)"}


@query(
    S.sql(
        "manifest edited",
        """SELECT video_id, '# source_video=in/' || video_id || '.mp4' || chr(10) || 'enabled,end,source_reference,color_reference,prompt,fade_to_next,crossfade_seconds' || chr(10) ||
  string_agg(enabled || ',' || end_text || ',' || source_reference || ',' || color_reference || ',' || CASE WHEN shot_index % 3 = 0 THEN '"warm, ""old"" light"' ELSE '' END || ',' || fade_to_next || ',' || crossfade_seconds, chr(10) ORDER BY shot_index) || chr(10) AS text FROM z GROUP BY video_id""",
        **_ROW,
    )
)
def manifest_write(spark, d):
    return _texts(spark, d)


@query(
    S.sql(
        "manifest edited",
        """SELECT video_id::VARCHAR AS path, 'in/' || video_id || '.mp4' AS source_video, shot_index AS row_index, enabled, end_text AS "end", source_reference, color_reference, CASE WHEN shot_index % 3 = 0 THEN 'warm, "old" light' ELSE '' END AS prompt, fade_to_next, crossfade_seconds FROM z""",
        **_ROW,
    )
)
def manifest_read(spark, d):
    t = _texts(spark, d).select(F.col("video_id").cast("string").alias("path"), "text")
    return SM.manifest_rows(t, SM.SHOT_COLUMNS).drop("header", "extra")


@query(
    S.sql(
        "manifest",
        """SELECT video_id::VARCHAR AS path, chunk_index, seed, guide_image FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_index ORDER BY shot_index DESC) AS r FROM (
  SELECT video_id, shot_index, shot_index // 2 AS chunk_index, l_partkey::VARCHAR AS seed, CASE WHEN video_id % 3 = 0 THEN 'b' || l_partkey ELSE 'a' || l_partkey END AS guide_image FROM manifest WHERE l_partkey % 5 <> 0)) WHERE r = 1""",
    )
)
def chunk_manifest_read(spark, d):
    m = S.manifest(spark, d)
    k, v, n = F.col("l_partkey"), F.col("video_id"), F.floor(F.col("shot_index") / 2).cast("string")
    index = F.when(k % 5 == 0, "x").otherwise(n)
    s = k.cast("string")
    both = F.concat_ws(",", index, s, F.concat(F.lit("a"), s), F.concat(F.lit("b"), s))
    old = F.concat_ws(",", index, s, F.concat(F.lit("a"), s))
    g = m.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("shot_index", F.when(v % 3 == 0, both).otherwise(old).alias("l")))).alias("l"))
    head = F.when(v % 3 == 0, "chunk_index,seed,anchor_image,guide_image").otherwise("chunk_index,seed,anchor_image")
    t = g.select(v.cast("string").alias("path"), F.concat(head, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("text"))
    return SM.chunk_rows(t).select("path", "chunk_index", "seed", "guide_image")


@query(S.sql("files", "SELECT page_id, path, size, sha256(content) AS sha256 FROM files"))
def file_fingerprint(spark, d):
    return S.files(spark, d).select("page_id", "path", "size", SF.fingerprint("content").alias("sha256"))


@query(S.sql("videos", "SELECT v.video_id, i.frame FROM videos v JOIN (SELECT video_id, unnest(range(total_frames)) AS frame FROM clips) i USING (video_id) WHERE i.frame % greatest(1, CAST(round_even(0.3 * v.fps, 0) AS BIGINT)) = 0".replace("FROM videos v", "FROM videos v"), clips=S.SQL["clips"]))
def frame_sampling(spark, d):
    return SF.sample_films(S.clips(spark, d), 0.3)


@query(
    """WITH x AS (SELECT p_partkey, 16 * (20 + p_size) AS w, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 9 * (20 + p_size) END AS h, CASE p_partkey % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '30000/1001' ELSE '25/1' END AS r, p_partkey * 37 + p_partkey % 2 + 1 AS b, p_size * 97.0::DOUBLE AS dur FROM part)
SELECT p_partkey, CASE WHEN h > 0 THEN w || 'x' || h END AS resolution, CASE WHEN h > 0 THEN printf('%.3f:1', w::DOUBLE / h) END AS aspect, CASE WHEN p_partkey % 3 = 1 THEN printf('%.3f fps', 30000.0::DOUBLE/1001) WHEN p_partkey % 3 = 2 THEN '25.000 fps' END AS frame_rate, 'h264' AS video_codec,
  CASE WHEN p_partkey % 2 = 0 THEN 'bt709 / tv' ELSE 'tv' END AS colour, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'aac, 48000, 2' END AS audio, CASE WHEN b >= 1000000 THEN printf('%.2f Mbps', b / 1e6) WHEN b >= 1000 THEN printf('%.1f Kbps', b / 1e3) ELSE printf('%d bps', b) END AS overall_bitrate,
  CASE WHEN dur >= 3600 THEN printf('%d:%02d:%02d', dur::BIGINT//3600, dur::BIGINT%3600//60, dur::BIGINT%60) ELSE printf('%d:%02d', dur::BIGINT//60, dur::BIGINT%60) END AS duration, 24.0::DOUBLE * (p_partkey % 3 = 0)::INT + 25.0 * (p_partkey % 3 = 2)::INT + round(30000.0::DOUBLE/1001, 6) * (p_partkey % 3 = 1)::INT AS fps,
  CAST(round_even(dur * CASE p_partkey % 3 WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 30000.0::DOUBLE/1001 ELSE 25.0 END, 0) AS BIGINT) AS n_frames FROM x"""
)
def probe_normalize(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    video = F.struct(
        F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (16 * (20 + s)).alias("width"), F.when(k % 5 == 0, 0).otherwise(9 * (20 + s)).alias("height"),
        F.when(k % 3 == 0, "0/0").when(k % 3 == 1, "30000/1001").otherwise("25/1").alias("avg_frame_rate"), F.when(k % 2 == 0, "bt709").alias("color_space"), F.lit("tv").alias("color_range"),
    )
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("48000").alias("sample_rate"), F.lit(2).alias("channels"))
    form = F.struct(text(s * 97.0).alias("duration"), text(k * 37 + k % 2 + 1).alias("bit_rate"))
    doc = F.concat(F.lit('{"streams":['), F.to_json(video), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(","), F.to_json(audio))), F.lit('],"format":'), F.to_json(form), F.lit("}"))
    x = S.table(spark, d, "part").select("p_partkey", doc.alias("doc"))
    x = SF.probe_metrics(SF.normalize_probe(x, F.col("doc")), F.col("doc"))
    return x.select("p_partkey", "resolution", "aspect", "frame_rate", "video_codec", "colour", "audio", "overall_bitrate", "duration", F.round("fps", 6).alias("fps"), "n_frames")


@query(
    """SELECT * FROM (SELECT o_orderkey, 'out/' || 'f' || o_custkey || '.png' AS path FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'out/clips/v' || o_orderkey || '.mp4' FROM orders UNION ALL SELECT o_orderkey, 'out/g' || o_custkey || '.gif' FROM orders WHERE o_orderkey % 2 = 0) WHERE path NOT LIKE '%7.%'"""
)
def history_outputs(spark, d):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    image = F.when(F.col("o_custkey") % 3 == 0, F.lit('{"filename":null}')).otherwise(F.concat(F.lit('{"filename":"f'), c, F.lit('.png","subfolder":""}')))
    gifs = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(',"gifs":[{"filename":"g'), c, F.lit('.gif"}]'))).otherwise("")
    doc = F.concat(F.lit('{"outputs":{"9":{"images":['), image, F.lit(']},"12":{"videos":[{"filename":"v'), k, F.lit('.mp4","subfolder":"clips"}]'), gifs, F.lit("}}}"))
    x = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", doc.alias("doc"))
    names = x.select(F.concat(F.lit("out/f"), F.col("o_custkey").cast("string"), F.lit(".png")).alias("path")).union(x.select(F.concat(F.lit("out/clips/v"), F.col("o_orderkey").cast("string"), F.lit(".mp4")))).union(x.select(F.concat(F.lit("out/g"), F.col("o_custkey").cast("string"), F.lit(".gif"))))
    return SF.history_outputs(x.select("o_orderkey", "doc"), F.col("doc"), "out", names.where("path not like '%7.%'")).select("o_orderkey", "path")


# ---- resume


def _expected(spark, d):
    f = S.files(spark, d)
    sig = F.concat(F.lit('{"version": 2, "input": {"size": '), F.col("size").cast("string"), F.lit(', "name": "n'), F.col("page_id").cast("string"), F.lit('"}}'))
    return f.select("page_id", "path", sig.alias("signature"))


def _stored(spark, d):
    """Signatures that were recorded. A path may stand for several pages (its scheme is cut off), so a page's number tells outputs apart."""
    f = S.files(spark, d).where("page_id % 7 <> 6")
    size = F.when(F.col("page_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))
    sig = F.concat(F.lit('{"input":{"name":"n'), F.col("page_id").cast("string"), F.lit('","size":'), size.cast("string"), F.lit('},"version":2}'))
    return f.select("page_id", "path", F.when(F.col("page_id") % 11 == 10, F.lit("{broken")).otherwise(sig).alias("signature"))


_OUTPUT = ["page_id", "path"]
MATCHES = {"sm": "SELECT page_id, path, page_id % 7 <> 6 AND page_id % 11 <> 10 AND page_id % 3 <> 0 AND page_id % 13 <> 12 AS matches FROM files"}


def _matches(spark, d):
    f = S.files(spark, d).where("page_id % 13 <> 12").select("page_id", "path")
    return R.signature_match(_expected(spark, d), _stored(spark, d), f, _OUTPUT)


@query("SELECT page_id, CASE WHEN page_id % 11 = 10 THEN NULL ELSE '{\"input\":{\"name\":\"n' || page_id || '\",\"size\":' || (octet_length(encode(html)) + (page_id % 3 = 0)::INT) || '},\"version\":2}' END AS signature FROM pages WHERE page_id % 7 <> 6")
def signature_read(spark, d):
    return _stored(spark, d).select("page_id", R.canonical_json(F.col("signature")).alias("signature"))


def _sidecars(spark, d):
    """Signature files of the pages in a folder of their own, named by page."""
    root = f"{shared_dir(spark).rstrip('/')}/sidecars-{uuid.uuid4().hex}"
    s = _expected(spark, d)
    SF.write_signature_files(s.select(F.concat(F.lit("out/p"), F.col("page_id").cast("string"), F.lit(".mp4")).alias("path"), "signature"), root)
    return root


@query(S.sql("files", "SELECT 'out/p' || page_id || '.mp4' AS path, '{\"input\":{\"name\":\"n' || page_id || '\",\"size\":' || size || '},\"version\":2}' AS signature FROM files"))
def signature_files(spark, d):
    """Signatures written beside their outputs, one file each, and read back from there."""
    root = _sidecars(spark, d)
    return SF.read_signatures(spark, root, root=root).select("path", R.canonical_json(F.col("signature")).alias("signature"))


@query(
    S.sql(
        "files",
        "SELECT name, octet_length(encode(t))::BIGINT AS size, sha256(t) AS sha256 FROM (SELECT 'p' || page_id || '.mp4.sig.json' AS name, printf('{%s  \"version\": 2,%s  \"input\": {%s    \"size\": %d,%s    \"name\": \"n%d\"%s  }%s}%s', chr(10), chr(10), chr(10), size, chr(10), page_id, chr(10), chr(10), chr(10)) AS t FROM files)",
    )
)
def file_fingerprint_streamed(spark, d):
    """Files of a folder hashed in pieces."""
    f = SF.fingerprint_files(spark, f"{_sidecars(spark, d)}/out")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


@query(S.sql("files", "SELECT path, matches FROM sm", **MATCHES))
def signature_match(spark, d):
    return _matches(spark, d).select("path", "matches")


def _media(spark, d):
    o = S.videos(spark, d)
    v = F.col("video_id")
    kind = F.when(v % 4 == 0, "image").when(v % 4 == 1, "segment").otherwise("film")
    out = o.select(v.cast("string").alias("path"), kind.alias("kind"), (640 + v % 3).alias("width"), F.lit(480).cast("long").alias("height"), (F.col("total_frames") / F.col("fps") + v % 5).alias("duration"), (F.col("total_frames") + v % 50).alias("frames"), "fps")
    exp = o.where("video_id % 17 <> 16").select(v.cast("string").alias("path"), F.lit(640).cast("long").alias("width"), F.lit(480).cast("long").alias("height"), (F.col("total_frames") / F.col("fps")).alias("duration"), F.col("total_frames").alias("frames"), "fps")
    return R.media_match(out, exp)


MEDIA = {"mm": "SELECT video_id, video_id::VARCHAR AS path, video_id % 17 = 16 OR video_id % 3 = 0 AND CASE video_id % 4 WHEN 0 THEN true WHEN 1 THEN video_id % 50 <= 3 ELSE abs((total_frames / fps + video_id % 5) - total_frames / fps) <= 1.5 AND video_id % 50 <= greatest(3, ceil(fps * 1.5)) END AS matches FROM videos"}


@query(S.sql("videos", "SELECT path, matches FROM mm", **MEDIA))
def media_match(spark, d):
    return _media(spark, d)


@query(S.sql("files", "SELECT page_id, path FROM sm WHERE NOT matches", **MATCHES))
def resume_worklist(spark, d):
    return R.resume_worklist(_expected(spark, d), _matches(spark, d), on=_OUTPUT).select("page_id", "path")


STALE = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 + 1 AS stage, o_custkey % 9 = 0 AS bad FROM orders), i AS (SELECT id, id - 1 AS src FROM o WHERE stage > 1 UNION ALL SELECT id, id - 2 FROM o WHERE stage > 2),
s1 AS (SELECT id, stage, bad, bad AS stale FROM o WHERE stage = 1), s2 AS (SELECT *, bad OR id IN (SELECT i.id FROM i JOIN s1 ON i.src = s1.id AND s1.stale) AS stale FROM o WHERE stage = 2),
u2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), s3 AS (SELECT *, bad OR id IN (SELECT i.id FROM i JOIN u2 ON i.src = u2.id AND u2.stale) AS stale FROM o WHERE stage = 3), u3 AS (SELECT * FROM u2 UNION ALL SELECT * FROM s3),
s4 AS (SELECT *, bad OR id IN (SELECT i.id FROM i JOIN u3 ON i.src = u3.id AND u3.stale) AS stale FROM o WHERE stage = 4)
SELECT 'p' || id AS path, stage, stale, bad AS own_fault FROM (SELECT * FROM u3 UNION ALL SELECT * FROM s4)"""


@query(STALE)
def stale_outputs(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 + 1).alias("stage"), (F.col("o_custkey") % 9 != 0).alias("matches"))
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    i = o.where("stage > 1").select(p(F.col("id")).alias("path"), p(F.col("id") - 1).alias("input_path")).union(o.where("stage > 2").select(p(F.col("id")), p(F.col("id") - 2)))
    return R.stale_outputs(o.select(p(F.col("id")).alias("path"), "stage", "matches"), i, 4)


@query(
    """SELECT o_orderkey, CASE WHEN p IS NOT NULL AND p % 3 <> 0 THEN 'f' || p WHEN s IS NOT NULL AND s % 3 <> 0 THEN 'f' || s END AS path, CASE WHEN p IS NULL THEN 'empty' WHEN NOT (p % 3 <> 0 OR s IS NOT NULL AND s % 3 <> 0) THEN 'missing' END AS error
  FROM (SELECT o_orderkey, coalesce(c, r, s) AS p, s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END AS r, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey + 2 END AS s FROM orders))"""
)
def row_reference(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    rows = S.table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, name(c)).otherwise("").alias("color_reference"), F.when(k % 3 == 0, name(c + 1)).alias("reference"), F.when(k % 5 < 3, name(c + 2)).alias("source_reference"))
    o = S.table(spark, d, "orders")
    have = o.select(c.alias("n")).union(o.select(c + 1)).union(o.select(c + 2)).where("n % 3 <> 0").select(name(F.col("n")).alias("path"))
    return R.row_references(rows, have).select("o_orderkey", "path", "error")


@query(
    """WITH d AS (SELECT 's' || c_nationkey AS stage, 'k' || c_custkey % 50 AS key, max(c_mktsegment) AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1, 2), a AS (SELECT 's' || c_nationkey AS stage, 'k' || c_custkey % 70 AS key, min(c_name) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
b AS (SELECT 's' || c_nationkey AS stage, 'k' || c_custkey % 60 AS key, CASE WHEN min(c_custkey) % 2 = 0 THEN NULL ELSE 'last' END AS v FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1, 2),
u AS (SELECT *, 0 AS o FROM d UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b)
SELECT stage, key, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY stage, key ORDER BY o DESC) AS r FROM u WHERE stage IN (SELECT stage FROM d)) WHERE r = 1"""
)
def settings_overlay(spark, d):
    c = S.table(spark, d, "customer")

    def layer(x, n, value):
        return x.groupBy(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("stage"), F.concat(F.lit("k"), (F.col("c_custkey") % n).cast("string")).alias("key")).agg(value.alias("value"))

    last = F.when(F.min("c_custkey") % 2 == 0, F.lit(None).cast("string")).otherwise("last")
    return R.overlay_settings(layer(c.where("c_nationkey < 20"), 50, F.max("c_mktsegment")), layer(c.where("c_custkey % 3 = 0"), 70, F.min("c_name")), layer(c.where("c_custkey % 5 = 0"), 60, last))


@query("""SELECT 'i' || p_partkey AS path, CASE WHEN p_size % 10 = 9 THEN p_size ELSE 64 END::BIGINT AS width, CASE WHEN p_size % 10 = 9 THEN 36 ELSE 36 END::BIGINT AS height, p_size % 10 <> 9 AND p_size <> 64 AS resize FROM part""")
def resize_plan(spark, d):
    p = S.table(spark, d, "part")
    images = p.select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 10).alias("source"), F.col("p_size").cast("long").alias("width"), F.lit(36).cast("long").alias("height"))
    sources = p.select((F.col("p_size") % 10).alias("source")).distinct().where("source <> 9").select("source", F.lit(64).cast("long").alias("width"), F.lit(36).cast("long").alias("height"))
    return R.resize_plan(images, sources)


# ---- inventory

PATHS = {"f": "SELECT page_id, split_part(path, '/', 2) || '/' || replace(split_part(path, '/', 1), '.', '_') || '/' || CASE page_id % 5 WHEN 0 THEN 'cut_' || page_id || '.png' WHEN 1 THEN 'film_' || page_id || '.MP4' WHEN 2 THEN 'x.partial' WHEN 3 THEN 'film.mov' ELSE 'note_' || page_id || '.txt' END AS path, size, mtime FROM files"}
CATEGORIES = [("english", "en"), ("other", "fr"), ("other", "de"), ("none", "empty"), ("blogs", "es")]


def _files(spark, d):
    f, k = S.files(spark, d), F.col("page_id")
    n = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("cut_"), n, F.lit(".png"))).when(k % 5 == 1, F.concat(F.lit("film_"), n, F.lit(".MP4"))).when(k % 5 == 2, "x.partial").when(k % 5 == 3, "film.mov").otherwise(F.concat(F.lit("note_"), n, F.lit(".txt")))
    place = F.concat(F.split("path", "/")[1], F.lit("/"), F.translate(F.split("path", "/")[0], ".", "_"), F.lit("/"))
    return f.select("page_id", F.concat(place, name).alias("path"), "size", "mtime")


@query(
    S.sql(
        "files",
        """SELECT c AS category, sum(n)::BIGINT AS n_files, sum(b)::BIGINT AS n_bytes FROM (SELECT c, count(page_id) AS n, coalesce(sum(size), 0) AS b FROM (VALUES ('english', 'en/'), ('other', 'fr/'), ('none', 'empty/'), ('blogs', 'es/')) v(c, p) LEFT JOIN f ON starts_with(path, p) AND page_id % 5 <> 2 GROUP BY 1) GROUP BY ROLLUP (c)""",
        **PATHS,
    )
)
def cache_rollup(spark, d):
    return I.cache_rollup(_files(spark, d), [c for c in CATEGORIES if c[1] != "de"])


@query(S.sql("files", "SELECT page_id, path, CASE split_part(path, '/', 1) WHEN 'en' THEN 'english' WHEN 'fr' THEN 'other' WHEN 'de' THEN 'other' WHEN 'es' THEN 'blogs' END AS category FROM f", **PATHS))
def path_category(spark, d):
    return I.path_category(_files(spark, d), CATEGORIES).select("page_id", "path", "category")


@query(S.sql("files", "SELECT page_id, path FROM f WHERE split_part(path, '/', 1) IN ('en', 'de') AND page_id % 5 IN (1, 3)", **PATHS))
def stage_files(spark, d):
    return I.stage_files(_files(spark, d), ["en", "de/"], [".mp4", ".mov"], "film").select("page_id", "path")


@query(S.sql("files", """SELECT split_part(path, '/', 1) AS "group", arg_max(path, struct_pack(m := mtime, p := path)) AS path, max(mtime) AS mtime FROM f WHERE page_id % 5 IN (0, 1) GROUP BY 1""", **PATHS))
def newest_file(spark, d):
    return I.newest_files(_files(spark, d), F.split("path", "/")[0], [".png", ".mp4"])


EXPECTED = PATHS | {"x": "SELECT page_id % 20 AS project, page_id % 3 AS stage, CASE WHEN page_id % 20 = 7 THEN NULL WHEN page_id % 9 = 0 THEN path || '.new' ELSE path END AS path, page_id FROM f"}


def _wanted(spark, d):
    f, k = _files(spark, d), F.col("page_id")
    path = F.when(k % 20 == 7, F.lit(None).cast("string")).when(k % 9 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return f.select((k % 20).alias("project"), (k % 3).alias("stage"), path.alias("path"), "page_id")


@query(S.sql("files", "SELECT project, stage, count(x.path) > 0 AND count(x.path) = count(g.mtime) AS ready, count(g.mtime) AS n_existing, arg_max(CASE WHEN g.mtime IS NOT NULL THEN x.path END, CASE WHEN g.mtime IS NOT NULL THEN struct_pack(m := g.mtime, p := x.path) END) AS latest FROM x LEFT JOIN (SELECT path, max(mtime) AS mtime FROM f GROUP BY 1) g USING (path) GROUP BY 1, 2", **EXPECTED))
def stage_readiness(spark, d):
    return I.stage_readiness(_wanted(spark, d), _files(spark, d))


@query(
    S.sql(
        "files",
        "SELECT w.path, CASE WHEN h.path IS NULL THEN 'to make' ELSE 'made' END AS state FROM (SELECT DISTINCT path FROM x WHERE path IS NOT NULL AND page_id % 4 <> 3) w LEFT JOIN (SELECT DISTINCT path FROM f) h USING (path) UNION ALL SELECT DISTINCT path, 'unexpected' FROM f WHERE path NOT IN (SELECT path FROM x WHERE path IS NOT NULL AND page_id % 4 <> 3)",
        **EXPECTED,
    )
)
def expected_vs_existing(spark, d):
    w = _wanted(spark, d).where("path is not null")
    return I.expected_vs_existing([w.where("page_id % 4 < 2"), w.where("page_id % 4 = 2")], _files(spark, d))


@query(S.sql("files", "SELECT count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS n_bytes FROM f WHERE starts_with(path, 'en/') AND page_id % 5 = 0", **PATHS))
def delete_candidates(spark, d):
    return I.delete_candidates(_files(spark, d), "en", "cut_")


@query(S.sql("files", "SELECT page_id, path FROM f WHERE page_id % 5 = 0 AND page_id % 15 <> 0 AND regexp_extract(path, '^(.*)/', 1) IN (SELECT regexp_extract(path, '^(.*)/', 1) FROM f WHERE page_id % 3 = 0) AND path NOT IN (SELECT path FROM f WHERE page_id % 3 = 0)", **PATHS))
def orphan_references(spark, d):
    f = _files(spark, d)
    return I.orphan_references(f, f.where("page_id % 3 = 0")).select("page_id", "path")


@query(
    """SELECT project, count(*) AS n_missing, string_agg(CASE WHEN r <= 3 THEN path END, ',' ORDER BY r) AS first_missing FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY shot_index, path) AS r FROM (SELECT o_custkey AS project, o_orderkey AS shot_index, 'f' || o_orderkey % 1000 AS path FROM orders WHERE o_orderkey % 1000 % 4 = 3)) GROUP BY 1"""
)
def missing_sources(spark, d):
    o, k = S.table(spark, d, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("f"), (k % 1000).cast("string"))
    return I.missing_sources(o.select(F.col("o_custkey").alias("project"), k.alias("shot_index"), path.alias("path")), o.where("o_orderkey % 1000 % 4 <> 3").select(path.alias("path")))


@query(
    """SELECT 'in/a|Film ' || p_partkey || '.mp4' AS typed, CASE p_partkey % 4 WHEN 0 THEN 'in/a|Film ' || p_partkey || '.mp4' WHEN 1 THEN 'in/A｜film  ' || p_partkey || '.MP4' ELSE 'in/a|Film ' || p_partkey || '.mp4' END AS path FROM part UNION ALL SELECT 'in/a Film ' || p_partkey || '.mp4', 'in/a Film ' || p_partkey || '.mp4' FROM part"""
)
def resolve_sources(spark, d):
    p, k = S.table(spark, d, "part"), F.col("p_partkey")
    n = k.cast("string")
    typed = p.select(F.concat(F.lit("in/a|Film "), n, F.lit(".mp4")).alias("typed")).union(p.select(F.concat(F.lit("in/a Film "), n, F.lit(".mp4"))))
    wide, odd = F.concat(F.lit("in/A｜film  "), n, F.lit(".MP4")), F.concat(F.lit("in/a?FILM "), n, F.lit(".mp4"))
    have = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("in/a|Film "), n, F.lit(".mp4")).alias("path")).union(p.where("p_partkey % 4 in (1, 2)").select(wide)).union(p.where("p_partkey % 4 = 2").select(odd))
    return I.resolve_sources(typed, have, [".mp4", ".mov"])


# ---- progress

LINES = {
    "n": "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type, event_id FROM events",
    "lines": """SELECT run_id, line_no, CASE event_type WHEN 'click' THEN 'Render chunk ' || (event_id % 9 + 1) || '/' || (10 + event_id % 3) || ': frames ' || event_id || ', rest' WHEN 'view' THEN 'Wrote raw chunk: c' || event_id || '.mp4' WHEN 'error' THEN 'Waiting for server' WHEN 'signup' THEN 'Preparing canvas' ELSE 'Reuse raw chunk: c' || event_id END AS line FROM n""",
}
DONE = ["Wrote raw chunk", "Reuse raw chunk"]
TOKENS = [("preparing canvas", 12, "Preparing"), ("waiting for server", 30, "Waiting"), ("render chunk", 42, "Rendering"), ("wrote raw chunk", 42, "Writing"), ("all done", 100, "Done")]


def lines(spark, d):
    from pyspark.sql import Window

    e, k = S.table(spark, d, "events"), F.col("event_id")
    n = k.cast("string")
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("Render chunk "), (k % 9 + 1).cast("string"), F.lit("/"), (10 + k % 3).cast("string"), F.lit(": frames "), n, F.lit(", rest"))).when(kind == "view", F.concat(F.lit("Wrote raw chunk: c"), n, F.lit(".mp4")))
    text = text.when(kind == "error", "Waiting for server").when(kind == "signup", "Preparing canvas").otherwise(F.concat(F.lit("Reuse raw chunk: c"), n))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("run_id"), F.row_number().over(w).cast("long").alias("line_no"), text.alias("line"))


@query(S.sql([], "SELECT run_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS r FROM lines) WHERE r <= 300", **LINES))
def log_tail(spark, d):
    return P.log_tail(lines(spark, d))


COUNTS = LINES | {
    "cp0": "SELECT run_id, count(*) FILTER (starts_with(line, 'Wrote raw chunk') OR starts_with(line, 'Reuse raw chunk')) AS done, coalesce(max(try_cast(regexp_extract(line, 'Render chunk ([0-9]+)/', 1) AS BIGINT)) FILTER (starts_with(line, 'Render')), 0) AS cur, coalesce(max(try_cast(regexp_extract(line, '/([0-9]+):', 1) AS BIGINT)) FILTER (starts_with(line, 'Render')), 0) AS total FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS r FROM lines) WHERE r <= 300) GROUP BY 1",
    "cp": "SELECT run_id, done, CASE WHEN total > 0 THEN greatest(1, least(total, CASE WHEN cur > 0 THEN cur ELSE least(done + 1, total) END)) ELSE cur END AS current, total FROM cp0",
}


@query(S.sql([], "SELECT run_id, count(*) FILTER (starts_with(line, 'Wrote raw chunk') OR starts_with(line, 'Reuse raw chunk')) AS n_matching, coalesce(arg_min(try_cast(regexp_extract(line, 'frames ([0-9]+),', 1) AS BIGINT), line_no) FILTER (contains(line, 'frames')), 0) AS first_number FROM lines GROUP BY 1", **LINES))
def log_counters(spark, d):
    return P.log_counters(lines(spark, d), DONE, "frames")


@query(S.sql([], "SELECT run_id, done, current, total FROM cp", **COUNTS))
def chunk_progress(spark, d):
    return P.chunk_progress(P.log_tail(lines(spark, d)), "Render chunk ", DONE)


def _elapsed(spark, d):
    return S.table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.max("event_id") % 200).cast("double").alias("seconds"))


ELAPSED = {"el": "SELECT user_id AS run_id, (max(event_id) % 200)::DOUBLE AS seconds FROM events GROUP BY 1"}


@query(
    S.sql(
        [],
        """SELECT run_id, CASE WHEN total > 0 AND p < 100 THEN greatest(p, least(95, 35 + CAST(floor(done / total * 55) AS BIGINT))) ELSE p END::BIGINT AS percent, label FROM (SELECT el.run_id, done::DOUBLE AS done, total, greatest(base, coalesce(v, 0)) AS p, CASE WHEN v >= base THEN label ELSE 'Running' END AS label
  FROM (SELECT run_id, least(90, 5 + CAST(floor(seconds / 60 * 20) AS BIGINT)) AS base FROM el) el LEFT JOIN (SELECT run_id, max(value) AS v, arg_max(label, value * 10 + i) AS label FROM (SELECT DISTINCT run_id, i, value, label FROM tail JOIN tok ON contains(lower(line), t)) GROUP BY 1) m USING (run_id) LEFT JOIN cp USING (run_id))""",
        **COUNTS,
        **ELAPSED,
        tail="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS r FROM lines) WHERE r <= 300",
        tok="SELECT * FROM (VALUES (0, 'preparing canvas', 12, 'Preparing'), (1, 'waiting for server', 30, 'Waiting'), (2, 'render chunk', 42, 'Rendering'), (3, 'wrote raw chunk', 42, 'Writing'), (4, 'all done', 100, 'Done')) v(i, t, value, label)",
    )
)
def milestone_progress(spark, d):
    tail = P.log_tail(lines(spark, d))
    return P.milestone_progress(tail, TOKENS, _elapsed(spark, d), P.chunk_progress(tail, "Render chunk ", DONE))


@query(S.sql([], "SELECT run_id, done, total, round(CASE WHEN total > 0 AND done > 0 AND done < total THEN greatest(0.0, seconds / done * (total - done)) END, 6) AS eta_seconds FROM (SELECT run_id, done % 14 AS done, total, seconds FROM cp JOIN el USING (run_id))", **COUNTS, **ELAPSED))
def progress_eta(spark, d):
    c = P.chunk_progress(P.log_tail(lines(spark, d)), "Render chunk ", DONE).join(_elapsed(spark, d), "run_id").withColumn("done", F.col("done") % 14)
    return P.progress_eta(c).select("run_id", "done", "total", F.round("eta_seconds", 6).alias("eta_seconds"))


@query("SELECT o_custkey AS project, CAST(round_even(sum(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 100 WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END) / 100.0::DOUBLE / count(*) * 100, 0) AS BIGINT) AS percent FROM orders GROUP BY 1")
def phase_progress(spark, d):
    k = F.col("o_orderkey")
    x = S.table(spark, d, "orders").select(F.col("o_custkey").alias("project"), k.alias("stage"), F.when(k % 3 == 0, "out").otherwise("").alias("latest"), F.when(k % 5 == 0, k % 100).alias("running_percent"))
    return P.phase_progress(x)
