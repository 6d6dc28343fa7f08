"""Time, name, size and number formats as Column functions. Rounding is half to even wherever a frame or a size is meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE_WORDS = ["false", "0", "no", "off"]
TRUE_WORDS = ["true", "1", "yes", "on"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nearest(x: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(x).cast("long")


def is_enabled(c: Column | str) -> Column:
    """False only for a known word of refusal; absent counts as true."""
    return ~F.lower(F.trim(F.coalesce(_col(c), F.lit("true")))).isin(FALSE_WORDS)


def is_truthy(c: Column | str) -> Column:
    """True only for a known word of assent."""
    return F.lower(F.trim(F.coalesce(_col(c), F.lit("")))).isin(TRUE_WORDS)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_time(seconds: Column | str) -> Column:
    """H:MM:SS, with milliseconds only where there are any."""
    ms = nearest(_col(seconds) * 1000)
    whole = F.floor(ms / 1000).cast("long")
    rest = ms - whole * 1000
    text = F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), _two(F.floor(whole % 3600 / 60)), F.lit(":"), _two(whole % 60))
    return F.when(rest > 0, F.concat(text, F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise(text)


def padded(number: Column | str, width: int) -> Column:
    """A whole number as `%0<width>d` prints it, without a formatter's cost a row."""
    n = _col(number).cast("long")
    return F.when(n.between(0, 10**width - 1), F.lpad(n.cast("string"), width, "0")).when(n >= 10**width, n.cast("string")).otherwise(F.format_string(f"%0{width}d", n))


def fixed(number: Column | str, places: int) -> Column:
    """A number as `%.<places>f` prints it: decimals round the shortest text of a double half up, as the formatter does. What a decimal can't hold goes to the formatter."""
    x = _col(number).cast("double")
    return F.when((x > 0) & (x < 1e9), x.try_cast(f"decimal({places + 12},{places})").cast("string")).otherwise(F.format_string(f"%.{places}f", x))


def format_timecode(seconds: Column | str) -> Column:
    """HH:MM:SS.mmm; negative times count as zero."""
    s = F.greatest(F.lit(0.0), _col(seconds).cast("double"))
    return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def _last(text: Column, mark: str, k: int) -> Column:
    """The k-th part from the end of text cut at mark; the first, where there are fewer."""
    return F.substring_index(F.substring_index(text, mark, -k), mark, 1) if k > 1 else F.substring_index(text, mark, -1)


def parse_time(text: Column | str) -> Column:
    """Seconds of [[H:]M:]S text; blank is 0. Hours and minutes must be whole; text that isn't a time gives null.

    Each part is cut out and read at one place: an array of parts would be made for each of its uses, in code too large to be compiled."""
    t = F.trim(_col(text))
    colons = _colons(t)
    none = F.lit(0).cast("long")
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
    hours = F.when(colons > 1, whole(_last(t, ":", 3)) * 3600).otherwise(none)
    minutes = F.when(colons > 0, whole(_last(t, ":", 2)) * 60).otherwise(none)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(0.0)).otherwise(hours + minutes + _last(t, ":", 1).try_cast("double"))


def _colons(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit("")))


def parse_time_lenient(text: Column | str, parsed: Column | str | None = None) -> Column:
    """As parse_time, but with at most three parts, and 0 for anything else. parsed: the column of parse_time, where there is one already."""
    c = _col(text)
    return F.when(_colons(c) <= 2, F.coalesce(parse_time(c) if parsed is None else _col(parsed), F.lit(0.0))).otherwise(F.lit(0.0))


def parse_duration(text: Column | str, parsed: Column | str | None = None) -> Column:
    """As parse_time, but null for empty text and for more than three parts. parsed: as for parse_time_lenient."""
    c = _col(text)
    return F.when((_colons(c) <= 2) & (F.trim(c) != ""), parse_time(c) if parsed is None else _col(parsed))


def _file_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def file_stem(path: Column | str) -> Column:
    """The last path part without its last suffix; a leading dot starts no suffix, and a dot at the end neither."""
    name = _file_name(_col(path))
    n, suffix = F.length(name), F.length(F.substring_index(name, ".", -1))
    return F.when((suffix > 0) & (n > suffix + 1), F.substring(name, F.lit(1), n - suffix - 1)).otherwise(name)


def reference_seconds(path: Column | str, stem: Column | str | None = None) -> Column:
    """Seconds in names like cut_0003_0.01.02.500; 0 for other names. stem: the column of file_stem, where there is one already."""
    name = file_stem(path) if stem is None else _col(stem)
    last = _last(name, "_", 1)
    three = F.substring_index(last, ".", 3)
    whole = lambda c: F.when(c.rlike(r"^[0-9]+$"), c.try_cast("long"))
    base = whole(F.substring_index(last, ".", 1)) * 3600 + whole(_last(F.substring_index(last, ".", 2), ".", 1)) * 60 + whole(_last(three, ".", 1))
    rest = F.substring(last, F.length(three) + 2, F.length(last))
    more = F.when(F.length(last) > F.length(three), F.concat(F.lit("0."), F.replace(rest, F.lit("."), F.lit(""))).try_cast("double")).otherwise(F.lit(0.0))
    named = name.like(r"cut\_%\_%") & (F.length(last) > F.length(F.substring_index(last, ".", 2)))
    return F.when(named, F.coalesce(base + more, F.lit(0.0))).otherwise(F.lit(0.0))


def reference_name(index: Column | str, seconds: Column | str) -> Column:
    return F.concat(F.format_string("cut_%04d_", _col(index).cast("long")), F.regexp_replace(format_timecode(seconds), ":", "."), F.lit(".png"))


def safe_stem(path: Column | str) -> Column:
    """The stem with blanks as underscores and everything but letters, digits, dot, underscore and hyphen replaced too."""
    return F.regexp_replace(F.regexp_replace(file_stem(path), " ", "_"), r"[^\p{L}\p{N}._-]", "_")


def aspect_slug(aspect: Column | str) -> Column:
    return F.translate(_col(aspect), ":.", "x_")


def crop_slug(left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """Empty without a crop, else _cropL-R-T-B."""
    edges = [c.cast("long") for c in (left, right, top, bottom)]
    return F.when((edges[0] == 0) & (edges[1] == 0) & (edges[2] == 0) & (edges[3] == 0), F.lit("")).otherwise(F.format_string("_crop%d-%d-%d-%d", *edges))


def output_name(source: Column, aspect: Column, width: Column, height: Column, crop: Column, kind: str) -> Column:
    """Name of a stage's output: stem, aspect, size, crop and the kind of output."""
    return F.concat(safe_stem(source), F.lit("_"), aspect_slug(aspect), F.lit("_"), width.cast("string"), F.lit("x"), height.cast("string"), crop, F.lit(f"_{kind}.mp4"))


def parse_aspect(text: Column | str) -> Column:
    """Width over height of 16:9 or 2.39; null where it isn't a positive number."""
    t = F.trim(_col(text))
    parts = F.split(t, ":")
    ratio = F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))).otherwise(t.try_cast("double"))
    return F.when(ratio > 0, ratio)


def even_up(x: Column) -> Column:
    """Nearest integer; an odd one goes up."""
    n = nearest(x)
    return n + F.pmod(n, F.lit(2))


def even_nearest(x: Column) -> Column:
    """Nearest even integer, 2 at least."""
    return F.greatest(F.lit(2).cast("long"), nearest(x / 2) * 2)


def target_width(aspect: Column, height: Column) -> Column:
    return even_up(parse_aspect(aspect) * height)


def model_safe(x: Column, multiple: int = 32) -> Column:
    """Nearest multiple, a tie to the lower one, one multiple at least."""
    n = F.greatest(F.lit(multiple).cast("long"), x.cast("long"))
    low = n - n % multiple
    return F.when(n - low <= low + multiple - n, low).otherwise(low + multiple)


def crop_geometry(width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """struct(x, y, w, h) of what is left: negative edges are none, sides are even and 2 at least."""
    at = [F.greatest(F.lit(0).cast("long"), c.cast("long")) for c in (left, right, top, bottom)]
    side = lambda whole, a, b: F.greatest(F.lit(2).cast("long"), whole.cast("long") - a - b)
    even = lambda c: c - F.pmod(c, F.lit(2))
    return F.struct(at[0].alias("x"), at[2].alias("y"), even(side(width, at[0], at[1])).alias("w"), even(side(height, at[2], at[3])).alias("h"))


def fit_geometry(src_w: Column, src_h: Column, delivery_w: Column, delivery_h: Column, work_w: Column, work_h: Column) -> Column:
    """struct(w, h, x, y): the source fitted into the delivery size, then squashed to the working size along the changed axes, centred."""
    wide = src_w * delivery_h > src_h * delivery_w
    w = F.when(wide, delivery_w.cast("long")).otherwise(nearest(src_w * delivery_h / src_h))
    h = F.when(wide, nearest(src_h * delivery_w / src_w)).otherwise(delivery_h.cast("long"))
    same_w, same_h = delivery_w == work_w, delivery_h == work_h
    w, h = F.when(same_w, w).when(same_h, work_w.cast("long")).otherwise(work_w.cast("long")), F.when(same_w & same_h, h).when(same_w, work_h.cast("long")).when(same_h, h).otherwise(work_h.cast("long"))
    return F.struct(w.alias("w"), h.alias("h"), F.floor((work_w - w) / 2).cast("long").alias("x"), F.floor((work_h - h) / 2).cast("long").alias("y"))


def parse_rate(text: Column | str, empty: float | None = None) -> Column:
    """Frames a second of 30000/1001 or 25. Empty text, 0/0, zero denominators and other text give `empty`."""
    parts = F.split(_col(text), "/", 2)
    left, right = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    rate = F.when(F.size(parts) == 2, F.try_divide(left, F.when(right != 0, right))).otherwise(left)
    return rate if empty is None else F.coalesce(rate, F.lit(empty))


def human_size(size: Column | str) -> Column:
    x = _col(size).cast("double")
    text = F.format_string("%d B", x.cast("long"))
    # a power of two divides exactly, so ties to even are real ties
    one = lambda k, unit: F.format_string(f"%.1f {unit}", F.rint(x / 1024.0**k * 10) / 10)
    out = F.when(x < 1024, text)
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(x < 1024.0 ** (k + 1), one(k, unit))
    return out.otherwise(one(4, "TB"))


def human_bitrate(bits: Column | str) -> Column:
    """Bits a second in bps, Kbps or Mbps; a tie of the written decimals goes up."""
    x = _col(bits).cast("double")
    return F.when(x >= 1e6, F.format_string("%.2f Mbps", x / 1e6)).when(x >= 1e3, F.format_string("%.1f Kbps", x / 1e3)).otherwise(F.format_string("%.0f bps", x))


def format_duration(seconds: Column | str) -> Column:
    t = nearest(_col(seconds))
    h, m, s = F.floor(t / 3600).cast("long"), F.floor(t % 3600 / 60).cast("long"), t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def preview_positions(duration: Column | str) -> Column:
    """Three seconds at which to look into a clip."""
    d = _col(duration).cast("double")
    long = F.array(F.lit(0.0), F.least(F.lit(10.0), d * 0.08), F.least(F.lit(30.0), d * 0.18))
    return F.when(d > 45, long).when(d > 0, F.array(F.lit(0.0), d * 0.33, d * 0.66)).otherwise(F.array(F.lit(0.0), F.lit(10.0), F.lit(30.0)))


def section_time(seconds: Column, start: Column, end: Column) -> Column:
    """A time relative to the section [start, end], held inside it; without a section (end <= start) the time itself."""
    a, b = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0))), F.greatest(F.lit(0.0), F.coalesce(end, F.lit(0.0)))
    return F.when(b > a, F.greatest(F.lit(0.0), F.least(b - a, seconds - a))).otherwise(seconds)


def clip_key(path: Column, mtime: Column, size: Column, start: Column, end: Column, key: Column) -> Column:
    three = lambda c: F.format_string("%.3f", c.cast("double"))
    return F.substring(F.sha1(F.concat_ws("|", path, mtime.cast("string"), size.cast("string"), three(start), three(end), key)), 1, 20)
