"""Queries over pixels, and over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.functions.distances import TRANSITION
from filmspark.operators import frames as R
from filmspark.plans import standins as S
from filmspark.plans.data_queries import DONE, LINES
from filmspark.plans.film_queries import BITS, CENTRED, _score
from filmspark.sources.layers import read_frames, write_frames
from filmspark.sources.shared import shared_dir
from filmspark.streaming import live, run

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _pixels(px: str):
    return F.unhex(F.array_join(F.transform(px, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def _px(spark, d):
    return S.vector_samples(spark, d).select("vec_id", "video_id", "frame", "px")


def gray_frames(spark, d):
    return _px(spark, d).select("video_id", "frame", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), _pixels("px").alias("pixels"))


def rgb_frames(spark, d):
    """Three vectors in a row of a film as the channels of an image."""
    x = _px(spark, d).withColumn("k", F.floor(F.col("frame") / 3))
    g = x.groupBy("video_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "px"))), lambda s: s["px"]).alias("c")).where("size(c) = 3")
    inter = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*[F.get(F.get("c", F.lit(j)), i) for j in range(3)])))
    x = g.withColumn("__x", inter)
    return x.select("video_id", F.col("k").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("channels"), _pixels("__x").alias("pixels"))


RGB = {"rgb": "SELECT video_id, frame // 3 AS frame, any_value(px) FILTER (frame % 3 = 0) AS r, any_value(px) FILTER (frame % 3 = 1) AS g, any_value(px) FILTER (frame % 3 = 2) AS b FROM px GROUP BY 1, 2 HAVING count(*) = 3"}
_AT = lambda y, x: f"px[(CASE WHEN {y} < 0 THEN 1 WHEN {y} > 7 THEN 6 ELSE {y} END) * 8 + (CASE WHEN {x} < 0 THEN 1 WHEN {x} > 7 THEN 6 ELSE {x} END) + 1]"


@query(
    S.sql(
        "px",
        "SELECT video_id, frame, round(list_sum(px)::DOUBLE / 64, 6) AS mean_luma, round(len(list_filter(px, lambda v: v < 12))::DOUBLE / 64, 6) AS black_ratio, round((64 * list_sum(list_transform(l, lambda v: v * v)) - list_sum(l) * list_sum(l))::DOUBLE / 4096, 6) AS sharpness FROM lp",
        lp=f"SELECT *, list_transform(range(64), lambda i: {_AT('(i // 8 - 1)', '(i % 8)')} + {_AT('(i // 8 + 1)', '(i % 8)')} + {_AT('(i // 8)', '(i % 8 - 1)')} + {_AT('(i // 8)', '(i % 8 + 1)')} - 4 * px[i + 1]) AS l FROM px",
    )
)
def frame_features(spark, d):
    f = R.frame_features(gray_frames(spark, d), 8, 8)
    return f.select("video_id", "frame", *[F.round(c, 6).alias(c) for c in ("mean_luma", "black_ratio", "sharpness")])


@query(
    S.sql(
        "px",
        "SELECT video_id, frame, bin::BIGINT AS bin, round(n::FLOAT::DOUBLE, 5) AS share FROM (SELECT video_id, frame, bin, len(list_filter(px, lambda v: v // 8 = bin)) / sqrt(list_sum(list_transform(range(32), lambda k: power(len(list_filter(px, lambda v: v // 8 = k)), 2)))) AS n FROM px, range(32) t(bin))",
    )
)
def frame_histograms(spark, d):
    f = R.frame_histograms(gray_frames(spark, d), 8, 8)
    return f.select("video_id", "frame", F.posexplode("hist").alias("bin", "share")).select("video_id", "frame", F.col("bin").cast("long").alias("bin"), F.round(F.col("share").cast("double"), 5).alias("share"))


_IN = lambda y, x: f"px[greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1]"
_M = lambda y, x: f"(CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN m[({y}) * 8 + {x} + 1] ELSE 0 END)"
_Y, _X = "i // 8", "i % 8"


def _gradient(along: str) -> str:
    """3 x 3 gradient at pixel i; borders repeat."""
    at = (lambda k, s: _IN(f"{_Y} + {k}", f"{_X} + {s}")) if along == "x" else (lambda k, s: _IN(f"{_Y} + {s}", f"{_X} + {k}"))
    return f"list_transform(range(64), lambda i: {at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(0, -1)} - {at(1, -1)})"


EDGES = {
    "g": f"SELECT video_id, frame, {_gradient('x')} AS dx, {_gradient('y')} AS dy FROM px",
    "mg": "SELECT *, list_transform(range(1, 65), lambda i: abs(dx[i]) + abs(dy[i])) AS m, list_transform(range(1, 65), lambda i: ((round_even(atan2(dy[i]::DOUBLE, dx[i]::DOUBLE) / (pi() / 4), 0)::INTEGER % 4) + 4) % 4) AS a FROM g",
    "th": f"SELECT *, list_transform(range(64), lambda i: m[i + 1] > {_M(f'({_Y} - (a[i + 1] > 0)::INTEGER)', f'({_X} - CASE a[i + 1] WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 END)')} AND m[i + 1] >= {_M(f'({_Y} + (a[i + 1] > 0)::INTEGER)', f'({_X} + CASE a[i + 1] WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 END)')}) AS thin FROM mg",
    "wk": "SELECT video_id, frame, list_transform(range(1, 65), lambda i: thin[i] AND m[i] > 60) AS weak, list_transform(range(1, 65), lambda i: thin[i] AND m[i] > 140) AS strong FROM th",
    # what is weak and touches an edge is one, until nothing changes
    "gr": f"SELECT video_id, frame, weak, strong AS e FROM wk UNION SELECT video_id, frame, weak, list_transform(range(64), lambda i: e[i + 1] OR (weak[i + 1] AND len(list_filter(range(9), lambda k: {_Y} + k // 3 - 1 BETWEEN 0 AND 7 AND {_X} + k % 3 - 1 BETWEEN 0 AND 7 AND e[greatest(0, least(63, ({_Y} + k // 3 - 1) * 8 + {_X} + k % 3 - 1)) + 1])) > 0)) FROM gr",
    "ne": "SELECT video_id, frame, max(len(list_filter(e, lambda x: x))) AS n FROM gr GROUP BY 1, 2",
}


@query(S.sql("px", "SELECT video_id, frame, bin::BIGINT AS bin, round((CASE bin WHEN 0 THEN 64 - n WHEN 15 THEN n ELSE 0 END / sqrt((64 - n) * (64 - n) + n * n))::FLOAT::DOUBLE, 5) AS share FROM ne, range(16) t(bin)", **EDGES))
def edge_histogram(spark, d):
    e = R.edge_histogram(gray_frames(spark, d), 8, 8).select("video_id", "frame", F.posexplode("edge_hist").alias("bin", "share"))
    return e.select("video_id", "frame", F.col("bin").cast("long").alias("bin"), F.round(F.col("share").cast("double"), 5).alias("share"))


# a cell of the 17 x 16 reduction covers parts of four columns, in 32nds of a sample, and one row
HASH = {
    "t": "SELECT video_id, frame, list_transform(range(272), lambda j: round_even(list_sum(list_transform(range(8), lambda c: px[(j // 17 // 2) * 8 + c + 1] * greatest(0, least(32 * (j % 17 + 1), 68 * (c + 1)) - greatest(32 * (j % 17), 68 * c))))::DOUBLE / 32, 0)::INTEGER) AS t FROM px",
    "b": "SELECT video_id, frame, list_transform(range(256), lambda k: t[k // 16 * 17 + k % 16 + 2] > t[k // 16 * 17 + k % 16 + 1]) AS b FROM t",
}
_WORD = lambda i: f"(SELECT (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT FROM (SELECT list_sum(list_transform(range(64), lambda k: CASE WHEN b[{64 * i} + k + 1] THEN 1::HUGEINT << k ELSE 0 END))::HUGEINT AS u)) AS word_{i}"


@query(S.sql("px", f"SELECT video_id, frame, {', '.join(map(_WORD, range(4)))} FROM b", **HASH))
def frame_dhash(spark, d):
    h = R.frame_dhash(gray_frames(spark, d), 32, 32)
    return h.select("video_id", "frame", *[F.col("dhash")[i].alias(f"word_{i}") for i in range(4)])


_DIFF = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i])))"


@query(S.sql("px", f"SELECT video_id, avg(({_DIFF('r', 'g')} + {_DIFF('r', 'b')} + {_DIFF('g', 'b')})::DOUBLE / 192) < 33 AS is_monochrome FROM rgb GROUP BY 1", **RGB))
def monochrome_detect(spark, d):
    f = rgb_frames(spark, d)
    return R.monochrome(f, f.select("video_id").distinct(), 33.0)


_EDGE = lambda e: f"(CASE WHEN list_min(list_transform(list_filter(range(64), lambda i: px[i + 1] > 60), lambda i: {e})) < 2 THEN 8 + list_min(list_transform(list_filter(range(64), lambda i: px[i + 1] > 60), lambda i: {e})) ELSE 0 END)::INTEGER"


@query(S.sql("px", f"SELECT video_id, frame, {_EDGE('i % 8')} AS crop_left, {_EDGE('7 - i % 8')} AS crop_right, {_EDGE('i // 8')} AS crop_top, {_EDGE('7 - i // 8')} AS crop_bottom FROM px"))
def letterbox_crop(spark, d):
    return R.letterbox_crop(R.pad_canvas(gray_frames(spark, d), 24, 24), threshold=60)


@query(S.sql("px", "SELECT video_id, frame, n AS n_black, round(n / 64.0::DOUBLE, 6) AS share_black FROM (SELECT video_id, frame, len(list_filter(range(1, 65), lambda i: r[i] <= 110 AND g[i] <= 110 AND b[i] <= 110))::BIGINT AS n FROM rgb)", **RGB))
def black_mask_stats(spark, d):
    return R.black_mask_stats(rgb_frames(spark, d), 110).select("video_id", "frame", "n_black", F.round("share_black", 6).alias("share_black"))


@query(S.sql("px", "SELECT video_id, frame, 20::BIGINT AS width, 12::BIGINT AS height, array_to_string(list_transform(range(240), lambda i: CASE WHEN i // 20 BETWEEN 2 AND 9 AND i % 20 BETWEEN 6 AND 13 THEN printf('%02X', px[(i // 20 - 2) * 8 + i % 20 - 5]) ELSE '00' END), '') AS pixels FROM px"))
def pad_canvas(spark, d):
    p = R.pad_canvas(gray_frames(spark, d), 20, 12)
    return p.select("video_id", "frame", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.hex("pixels").alias("pixels"))


@query(
    S.sql(
        "px",
        """SELECT vec_id, i::BIGINT AS place, v::BIGINT AS level, CAST(round_even(255 * (0.018::DOUBLE + (1 - 0.018::DOUBLE) * power(v / 255.0::DOUBLE, 1 / 1.06::DOUBLE)), 0) AS BIGINT) AS lifted,
  CASE WHEN v / 255.0::DOUBLE < 0.018::DOUBLE THEN 0 ELSE CAST(round_even(255 * power((v / 255.0::DOUBLE - 0.018::DOUBLE) / (1 - 0.018::DOUBLE), 1.06::DOUBLE), 0) AS BIGINT) END AS restored FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(px) AS v FROM px)""",
    )
)
def tone_lut(spark, d):
    x = _px(spark, d).select("vec_id", F.posexplode("px").alias("place", "level"))
    up, down = R.tone_level(F.col("level"))
    return x.select("vec_id", F.col("place").cast("long").alias("place"), F.col("level").cast("long").alias("level"), up.alias("lifted"), down.alias("restored"))


@query(S.sql("videos", "SELECT video_id, x, round((CASE WHEN x < 9 THEN 255.0 * x / 9 WHEN x > w - 9 THEN 255.0 * (w - x) / 9 ELSE 255.0 END)::DOUBLE, 6) AS alpha FROM (SELECT video_id, w, unnest(range(w)) AS x FROM (SELECT video_id, 20 + total_frames % 13 AS w FROM videos))"))
def feather_mask(spark, d):
    v = S.videos(spark, d).select("video_id", (20 + F.col("total_frames") % 13).alias("w"))
    x = v.select("video_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("x"))
    return x.select("video_id", "x", F.round(R.feather_alpha(F.col("x"), F.col("w"), 9), 6).alias("alpha"))


def _stored(frames: DataFrame) -> DataFrame:
    """The frames as a layer of their own in the shared folder."""
    spark, name = frames.sparkSession, f"layer_{uuid.uuid4().hex}"
    write_frames(frames, name, 16, f"{shared_dir(spark).rstrip('/')}/{name}")
    return read_frames(spark, name)


# the plate is the lifted frame on a canvas of 16 x 8, the source the frame itself with sides two samples wide, the colour layer every other plate
_UV = lambda c, d, y: f"(({c} - {y}) / {d})"
LAYERS = RGB | {
    "lut": "SELECT list(greatest(0, least(255, round_even(255 * (0.018::DOUBLE + (1 - 0.018::DOUBLE) * power(v / 255::DOUBLE, 1 / 1.06::DOUBLE)), 0)))::INTEGER ORDER BY v) AS up FROM range(256) t(v)",
    "cells": "SELECT video_id, frame, p, p // 16 AS y, p % 16 - 4 AS x FROM rgb, range(128) t(p)",
    "pt": "SELECT video_id, frame, p, x, coalesce(up[s[1] + 1], 0) AS pr, coalesce(up[s[2] + 1], 0) AS pg, coalesce(up[s[3] + 1], 0) AS pb, s FROM (SELECT cells.*, CASE WHEN x BETWEEN 0 AND 7 THEN [r[y * 8 + x + 1], g[y * 8 + x + 1], b[y * 8 + x + 1]] END AS s FROM cells JOIN rgb USING (video_id, frame)), lut",
    "mx": "SELECT *, CASE WHEN x < 2 THEN 127.5 * x WHEN x > 6 THEN 127.5 * (8 - x) ELSE 255 END::DOUBLE / 255 AS o FROM pt",
    "mb": "SELECT *, " + ", ".join(f"CASE WHEN s IS NULL THEN p{c} ELSE round_even(s[{k}] * o + p{c} * (1 - o), 0)::INTEGER END AS m{c}" for k, c in enumerate("rgb", 1)) + " FROM mx",
    "yy": "SELECT *, 0.299::DOUBLE * mr + 0.587::DOUBLE * mg + 0.114::DOUBLE * mb AS y, 0.299::DOUBLE * pr + 0.587::DOUBLE * pg + 0.114::DOUBLE * pb AS cy FROM mb",
    "tn": "SELECT *, " + _UV("pb", "1.772::DOUBLE", "cy") + " * 0.82::DOUBLE AS tu, " + _UV("pr", "1.402::DOUBLE", "cy") + " * 0.82::DOUBLE AS tv FROM yy",
    "tr": "SELECT *, greatest(0, least(255, round_even(cy + 1.402::DOUBLE * tv, 0))) AS ar, greatest(0, least(255, round_even(cy - 0.344136::DOUBLE * tu - 0.714136::DOUBLE * tv, 0))) AS ag, least(255, greatest(0, least(255, round_even(cy + 1.772::DOUBLE * tu, 0))) + 255 * 0.015::DOUBLE / 2) AS ab FROM tn",
    "ty": "SELECT *, 0.299::DOUBLE * ar + 0.587::DOUBLE * ag + 0.114::DOUBLE * ab AS ay FROM tr",
    "tc": "SELECT *, " + _UV("ab", "1.772::DOUBLE", "ay") + " AS fu, " + _UV("ar", "1.402::DOUBLE", "ay") + " AS fv FROM ty",
    "oc": "SELECT video_id, frame, p, " + ", ".join(f"CASE WHEN frame % 2 = 0 THEN greatest(0, least(255, round_even({e}, 0)))::INTEGER ELSE m{c} END AS o_{c}" for c, e in (("r", "y + 1.402::DOUBLE * fv"), ("g", "y - 0.344136::DOUBLE * fu - 0.714136::DOUBLE * fv"), ("b", "y + 1.772::DOUBLE * fu"))) + " FROM tc",
}


@query(S.sql("px", "SELECT video_id, frame, 16 AS width, 8 AS height, string_agg(printf('%02X%02X%02X', o_r, o_g, o_b), '' ORDER BY p) AS pixels FROM oc GROUP BY 1, 2", **LAYERS))
def composite_frames(spark, d):
    """Three stored layers; odd frames have no colour layer and are the merged plate."""
    rgb = rgb_frames(spark, d)
    plate = _stored(R.pad_canvas(R.black_lift(rgb), 16, 8))
    out = R.composite(plate, _stored(rgb), plate.where("frame % 2 = 0"), feather=2)
    return out.select("video_id", "frame", "width", "height", F.hex("pixels").alias("pixels"))


def _filled(name: str, source: str, line: str, along: str) -> dict[str, str]:
    """Dark pixels take the nearest other one of their line, the first of equals."""
    return {
        f"{name}n": f"SELECT h.video_id, h.frame, h.y, h.x, arg_min(struct_pack(r := q.r, g := q.g, b := q.b), struct_pack(d := abs(h.{along} - q.{along}), p := q.{along})) AS v FROM {source} h JOIN {source} q ON q.video_id = h.video_id AND q.frame = h.frame AND q.{line} = h.{line} WHERE greatest(h.r, h.g, h.b) <= 4 AND greatest(q.r, q.g, q.b) > 4 GROUP BY 1, 2, 3, 4",
        name: f"SELECT m.video_id, m.frame, m.y, m.x, coalesce(v.r, m.r) AS r, coalesce(v.g, m.g) AS g, coalesce(v.b, m.b) AS b FROM {source} m LEFT JOIN {name}n n ON n.video_id = m.video_id AND n.frame = m.frame AND n.y = m.y AND n.x = m.x",
    }


# a guide of 8 x 8 on a canvas of 20 x 12 is 12 x 12, three columns in and one row down; the frame lies in the canvas's middle
GUIDE = RGB | {
    "pt": "SELECT video_id, frame, i // 8 AS y, i % 8 AS x, r[i + 1] AS r, g[i + 1] AS g, b[i + 1] AS b FROM rgb, range(64) t(i)",
    "spot": "SELECT o, greatest(0.0, least(7.0, (o + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE))::DOUBLE AS c FROM range(12) t(o)",
    "lw": "SELECT o, floor(c)::BIGINT AS i, 1 - (c - floor(c)) AS w FROM spot UNION ALL SELECT o, least(7, floor(c)::BIGINT + 1), c - floor(c) FROM spot",
    "fit": "SELECT video_id, frame, wy.o + 1 AS y, wx.o + 3 AS x, " + ", ".join(f"round_even(round(sum(pt.{c} * wy.w * wx.w), 9), 0) AS {c}" for c in "rgb") + " FROM pt JOIN lw wx ON wx.i = pt.x JOIN lw wy ON wy.i = pt.y GROUP BY 1, 2, 3, 4",
    "cv": "SELECT k.video_id, k.frame, ty.y, tx.x, coalesce(pt.r, 0) AS r, coalesce(pt.g, 0) AS g, coalesce(pt.b, 0) AS b, coalesce(greatest(pt.r, pt.g, pt.b) > 4, false)::INTEGER AS inside FROM (SELECT video_id, frame FROM rgb) k CROSS JOIN range(12) ty(y) CROSS JOIN range(20) tx(x) LEFT JOIN pt ON pt.video_id = k.video_id AND pt.frame = k.frame AND pt.y = ty.y - 2 AND pt.x = tx.x - 6",
    "kn": "SELECT i, exp(-0.5::DOUBLE * power(i / 5::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * power(i / 5::DOUBLE, 2))) OVER () AS w FROM range(-10, 11) t(i)",
    "b1": "SELECT cv.video_id, cv.frame, t.y, cv.x, sum(kn.w * cv.inside) AS v FROM range(12) t(y), kn, cv WHERE cv.y = greatest(0, least(11, t.y + kn.i)) GROUP BY 1, 2, 3, 4",
    "b2": "SELECT b1.video_id, b1.frame, b1.y, t.x, sum(kn.w * b1.v) AS v FROM range(20) t(x), kn, b1 WHERE b1.x = greatest(0, least(19, t.x + kn.i)) GROUP BY 1, 2, 3, 4",
    "mx": "SELECT video_id, frame, y, x, " + ", ".join(f"floor(greatest(0, least(255, round(cv.{c} * (b2.v * inside) + coalesce(fit.{c}, 0) * (1 - b2.v * inside), 6))))::INTEGER AS {c}" for c in "rgb") + " FROM cv JOIN b2 USING (video_id, frame, y, x) LEFT JOIN fit USING (video_id, frame, y, x)",
    **_filled("f1", "mx", "x", "y"),
    **_filled("f2", "f1", "y", "x"),
}


@query(S.sql("px", "SELECT video_id, frame, 20 AS width, 12 AS height, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x) AS pixels FROM f2 GROUP BY 1, 2", **GUIDE))
def guide_composite(spark, d):
    rgb = rgb_frames(spark, d)
    out = R.guide_composite(_stored(rgb), _stored(R.pad_canvas(rgb, 20, 12)))
    return out.select("video_id", "frame", "width", "height", F.hex("pixels").alias("pixels"))


def _sinc_weights(name: str, m: int) -> dict[str, str]:
    """Weights of m cells of 8 samples, from the definition of the windowed sinc."""
    scale, wide = f"(8::DOUBLE / {m})", max(1.0, 8 / m)
    lobe = lambda d: f"(CASE WHEN {d} = 0 THEN 1.0 ELSE sin(pi() * {d}) / (pi() * {d}) END)"
    raw = f"SELECT o, i, (i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {scale}) / {wide}::DOUBLE AS d FROM range({m}) a(o), range(8) b(i)"
    w = f"SELECT o, i, {lobe('d')} * {lobe('(d / 3)')} AS w FROM ({raw}) WHERE abs(d) < 3 AND i >= floor((o + 0.5::DOUBLE) * {scale} - {3 * wide}::DOUBLE + 0.5::DOUBLE) AND i < floor((o + 0.5::DOUBLE) * {scale} + {3 * wide}::DOUBLE + 0.5::DOUBLE)"
    return {name: f"SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM ({w})"}


_ROUND = lambda e: f"greatest(0, least(255, floor(round({e}, 6) + 0.5::DOUBLE)))"


@query(
    S.sql(
        "px",
        "SELECT video_id, frame, 5::BIGINT AS width, 9::BIGINT AS height, string_agg(printf('%02X', v::INTEGER), '' ORDER BY y, x) AS pixels FROM v GROUP BY 1, 2",
        **_sinc_weights("wx", 5),
        **_sinc_weights("wy", 9),
        h=f"SELECT video_id, frame, r, o AS x, {_ROUND('sum(px[r * 8 + i + 1] * w)')} AS v FROM px, range(8) t(r), wx GROUP BY 1, 2, 3, 4",
        v=f"SELECT video_id, frame, x, o AS y, {_ROUND('sum(h.v * w)')} AS v FROM h JOIN wy ON wy.i = h.r GROUP BY 1, 2, 3, 4",
    )
)
def resize_frames(spark, d):
    g = gray_frames(spark, d)
    wanted = g.select("video_id", "frame", F.lit(5).alias("width"), F.lit(9).alias("height"))
    out = R.resize_frames(_stored(g), wanted)
    return out.select("video_id", "frame", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.hex("pixels").alias("pixels"))


_LIFTED = "round_even(255 * (0.018::DOUBLE + (1 - 0.018::DOUBLE) * power(v / 255::DOUBLE, 1 / 1.06::DOUBLE)), 0)"


@query(S.sql("px", f"SELECT video_id, frame, list_max(list_transform(list_transform(px, lambda v: struct_pack(v := v, u := {_LIFTED})), lambda s: abs(s.v - CASE WHEN s.u / 255::DOUBLE < 0.018::DOUBLE THEN 0 ELSE round_even(255 * power((s.u / 255::DOUBLE - 0.018::DOUBLE) / (1 - 0.018::DOUBLE), 1.06::DOUBLE), 0) END)))::BIGINT AS largest_change FROM px"))
def black_lift_restore(spark, d):
    """Every frame lifted and restored again, with the largest change of a sample; what it was travels with it, so nothing is joined."""
    back = R.black_restore(R.black_lift(gray_frames(spark, d).withColumn("was", F.col("pixels"))))
    at = lambda c, i: F.conv(F.hex(F.substring(F.col(c), i, F.lit(1))), 16, 10).cast("long")
    worst = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.abs(at("pixels", i) - at("was", i))))
    return back.select("video_id", "frame", worst.alias("largest_change"))


# ---- streams


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    # a pattern: a stream takes a plain path for a folder, and the table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query(
    S.sql(
        [],
        "SELECT run_id, done, CASE WHEN total > 0 THEN greatest(1, least(total, CASE WHEN cur > 0 THEN cur ELSE least(done + 1, total) END)) ELSE cur END AS current, total FROM a",
        **LINES,
        a="SELECT run_id, count(*) FILTER (starts_with(line, 'Wrote raw chunk') OR starts_with(line, 'Reuse raw chunk')) AS done, coalesce(max(try_cast(regexp_extract(line, 'Render chunk ([0-9]+)/', 1) AS BIGINT)), 0) AS cur, coalesce(max(try_cast(regexp_extract(line, '/([0-9]+):', 1) AS BIGINT)), 0) AS total FROM lines GROUP BY 1",
    )
)
def stream_progress(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("Render chunk "), (k % 9 + 1).cast("string"), F.lit("/"), (10 + k % 3).cast("string"), F.lit(": frames"))).when(kind == "view", "Wrote raw chunk: c").when(kind == "error", "Waiting for server")
    lines = _stream(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", text.when(kind == "signup", "Preparing canvas").otherwise("Reuse raw chunk: c").alias("line"))
    # events aren't in the order of their times: the watermark must not pass any
    return run.run_now(live.live_progress(lines, "Render chunk ", DONE, "3650 days"), "update", "progress", ["run_id"]).select("run_id", "done", "current", "total")


@query(S.sql("px vectors", f"SELECT b.video_id, b.vec_id AS frame, round(CASE WHEN a.frame IS NULL THEN 0.0 ELSE {_score('a', 'b', TRANSITION)} END, 6) AS score FROM c b LEFT JOIN c a ON a.video_id = b.video_id AND a.frame = b.frame - 1", **CENTRED))
def stream_cut_scores(spark, d):
    e = _stream(spark, d, "embeddings")
    px = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 0.6) * 212))).cast("int"))
    x = S.with_features(e.select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame"), F.timestamp_seconds(F.col("vec_id") + 1).alias("ts"), px.alias("px")))
    return run.run_now(live.stream_cut_scores(x, 0.3, BITS, "0 seconds"), "append", "cuts").select("video_id", "frame", F.round("score", 6).alias("score"))
