"""TIFF pages: a reader for baseline 8-bit images in strips or tiles, and a writer that stores byte payloads as such images.

The reader walks every image directory of a file (little or big endian), decodes PackBits, LZW or deflate segments, undoes the horizontal predictor,
and gives one row for each page. Tag numbers and codes are those of the TIFF 6.0 specification.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from filmspark.llm.common import BLOCK_BYTES, blocks, text_bytes

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: "B", 3: "H", 4: "I"}
#: Samples that a byte of a segment can stand for: LZW codes of 9 to 12 bits have at most 3,839 samples, deflate has 1,032 and PackBits 64.
_MOST_GAIN = 4096
_MOST_SEGMENT = 1 << 26


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(row: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes are repeats, the rest literals of at most 128 bytes."""
    out, literal = bytearray(), 0

    def copied(stop: int) -> None:
        for k in range(literal, stop, 128):
            piece = row[k : min(stop, k + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in _RUN.finditer(row):
        at, end = run.span()
        copied(at)
        out += bytes((257 - (end - at), row[at]))
        literal = end
    copied(len(row))
    return bytes(out)


def pack_rows(part: np.ndarray) -> bytes:
    """The rows of a segment, each packed alone; most have no run of 3 and are one literal."""
    h, w = part.shape
    if not 3 <= w <= 128:
        return b"".join(pack_bits(r.tobytes()) for r in part)
    runs = ((part[:, 2:] == part[:, 1:-1]) & (part[:, 1:-1] == part[:, :-2])).any(axis=1).tolist()
    whole = np.concatenate([np.full((h, 1), w - 1, np.uint8), part], axis=1)
    return b"".join(pack_bits(part[i].tobytes()) if run else whole[i].tobytes() for i, run in enumerate(runs))


_CLEAR, _EOI = 256, 257


def lzw_encode(data: bytes) -> bytes:
    """Strings are known by the code of all but their last byte, and that byte."""
    codes, widths, table, size, bits, w = [_CLEAR], [9], {}, 258, 9, -1
    for c in data:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        known = table.get(key)
        if known is not None:
            w = known
            continue
        codes.append(w)
        widths.append(bits)
        table[key] = size
        size += 1
        if size == 4095:
            codes.append(_CLEAR)
            widths.append(bits)
            table, size, bits = {}, 258, 9
        elif size >> bits:
            bits += 1
        w = c
    if w >= 0:
        codes.append(w)
        widths.append(bits)
        size += 1
        bits += size >> bits
    codes.append(_EOI)
    widths.append(bits)
    n, places = np.array(widths), np.arange(12)
    # the bits of each code, most significant first
    each = np.array(codes)[:, None] >> np.maximum(n[:, None] - 1 - places, 0) & 1
    return np.packbits(each[places < n[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, bits, value, held, out, last = list(first), 9, 0, 0, [], b""
    for byte in data:
        value, held = value << 8 | byte, held + 8
        if held < bits:
            continue
        held -= bits
        code, value = value >> held, value & (1 << held) - 1
        if code == _EOI:
            break
        if code == _CLEAR:
            table, bits, last = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        if len(table) + 1 >> bits and bits < 12:
            bits += 1
        last = entry
    return b"".join(out)


def decode_segment(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise ValueError(f"damaged deflate data: {e}") from e
    if compression == PACKBITS:
        return unpack_bits(data)
    raise ValueError(f"compression {compression} isn't read")


def read_pages(content: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    """(tags, samples of shape height x width x channels) of every page in file order. Raises ValueError on what it can't read."""
    if content[:4] == b"II*\0":
        end = "<"
    elif content[:4] == b"MM\0*":
        end = ">"
    else:
        raise ValueError("not a TIFF file")
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(end + "I", content, 4)
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(end + "H", content, at)
            tags: dict[int, list[int]] = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(end + "HHI", content, at + 2 + 12 * k)
                if kind in _SIZES:
                    if count > len(content):
                        raise ValueError(f"tag {tag} has more values than the file has bytes")
                    form = f"{end}{count}{_SIZES[kind]}"
                    place = at + 10 + 12 * k
                    if struct.calcsize(form) > 4:
                        (place,) = struct.unpack_from(end + "I", content, place)
                    tags[tag] = list(struct.unpack_from(form, content, place))
            yield tags, _samples(content, tags)
            (at,) = struct.unpack_from(end + "I", content, at + 2 + 12 * n)
    except (struct.error, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, zlib.error) as e:
        raise ValueError(f"damaged directory: {e!r}") from e


def _samples(content: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default
    w, h, channels = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if set(tags.get(BITS, [8])) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only interleaved 8-bit samples are read")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
    if min(w, h, channels, tw, th) < 1:
        raise ValueError("an image or a segment without samples")
    across = -(-w // tw)
    places, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if len(places) != len(sizes) or len(places) < across * -(-h // th):
        raise ValueError("segments are missing")
    # no codec here makes more than this of a byte, so a header that promises more is damaged; nothing is allocated for it
    if w * h * channels > _MOST_GAIN * sum(min(size, len(content)) for size in sizes) or tw * th * channels > max(_MOST_SEGMENT, w * h * channels):
        raise ValueError("the header promises more samples than the file can hold")
    out = np.zeros((h, w, channels), np.uint8)
    for k, (at, size) in enumerate(zip(places[: across * -(-h // th)], sizes, strict=False)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        part = np.frombuffer(decode_segment(content[at : at + size], one(COMPRESSION, NONE)), np.uint8)
        if len(part) < rows * tw * channels:
            raise ValueError("a segment is cut short")
        part = part[: rows * tw * channels].reshape(rows, tw, channels)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"predictor {one(PREDICTOR)} isn't undone")
        out[y : y + rows, x : x + tw] = part[: h - y, : w - x]
    return out


def encode_tiff(pages: list[np.ndarray], compression: int, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64) -> bytes:
    """A little-endian file with one gray image (height x width) for each page, in strips, or in tiles (height, width), padded with zeros."""
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: bytes}[compression]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        h, w = page.shape
        if tile:
            th, tw = tile
            parts = [np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]))) for y in range(0, h, th) for x in range(0, w, tw) for part in [page[y : y + th, x : x + tw]]]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            data = pack_rows(part) if compression == PACKBITS else pack(np.ascontiguousarray(part).tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, sizes)]
        else:
            tags += [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, sizes)]
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{_SIZES[kind]}", *values)
            if len(raw) > 4:
                place, raw = len(out), raw + b"\0" * (len(raw) & 1)
                out += raw
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


UNIT, _W, _H = 576, 96, 192
#: Every codec with both predictors.
_KINDS = [(c, p) for c in (DEFLATE, PACKBITS, LZW) for p in (1, 2)]


def payload_tiff(payload: bytes) -> bytes:
    """A payload of whole 576-byte units as pages of 96 columns (6 rows a unit) and at most 192 rows. Its checksum picks codec, predictor and strips or tiles, all alike often, so equal
    payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, _W)
    pages = [rows[y : y + _H] for y in range(0, len(rows), _H)]
    pick = zlib.crc32(payload)
    codec, predictor = _KINDS[pick % 6]
    return encode_tiff(pages, codec, predictor, [None, (64, 64), (96, 32)][pick // 6 % 3])


def text_tiffs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576, as a TIFF file. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            data, at = text_bytes(b.column(1))
            media, sizes = [], np.diff(at)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                raw = data[s:e].tobytes()
                media.append(payload_tiff(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")))
            yield pa.record_batch([b.column(0), pa.array(sizes), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def tiff_pages(files: DataFrame, id_col: str, media_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row for each page of each file, in file and page order within a task: id, the columns to keep, page, n_pages, width, height, channels, pixels, error.

    Pages of a file follow each other. A null, empty or damaged file gives one row with page -1, no pixels and the reason
    in `error`; pages before the damage aren't given. Repeated rows give their pages each; an empty table gives an empty one. Kept columns that are called like a column of
    the result are an error: rename them before. Narrow: pixels never reach a shuffle.
    """
    keep = keep or []
    clash = [c for c in [id_col, *keep] if c.lower() in ("page", "n_pages", "width", "height", "channels", "pixels", "error")]
    if clash or len({c.lower() for c in [id_col, *keep]}) <= len(keep):
        raise ValueError(f"columns that can't be kept beside a page's own: {clash or keep}")
    kinds = dict(files.dtypes)
    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "page int, n_pages int, width int, height int, channels int, pixels binary, error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, media_col):
            rows, cols = [], [[] for _ in range(7)]
            held = 0
            for i, media in enumerate(b.column(media_col)):
                try:
                    found = [(t, p) for t, p in read_pages(media.as_py() or b"")]
                    got = [(k, len(found), p.shape[1], p.shape[0], p.shape[2], p.tobytes(), None) for k, (_, p) in enumerate(found)]
                except (ValueError, MemoryError) as e:
                    got = [(-1, 0, None, None, None, None, str(e))]
                for x in got:
                    rows.append(i)
                    held += len(x[5] or b"")
                    for c, v in zip(cols, x, strict=True):
                        c.append(v)
                if held > BLOCK_BYTES:
                    yield _pages(b, rows, cols, [id_col, *keep])
                    rows, cols, held = [], [[] for _ in range(7)], 0
            if rows:
                yield _pages(b, rows, cols, [id_col, *keep])

    return files.select(id_col, *keep, media_col).mapInArrow(run, schema)


def _pages(b: pa.RecordBatch, rows: list[int], cols: list[list], kept: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
    names = ["page", "n_pages", "width", "height", "channels", "pixels", "error"]
    take = pa.array(rows)
    return pa.record_batch([*(b.column(c).take(take) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*kept, *names])


def tiff_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a TIFF, read its pages back through `tiff_pages`, and digest what was read.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes, media_sha256, feature (pages, mean and spread of the
    samples, share of equal neighbours in a row). Null and empty texts are one unit of bytes 255. Equal texts give equal
    values; repeated rows each get a row; an empty table gives an empty one. Pages of a text follow each other within a task, so nothing is shuffled.
    """
    media = text_tiffs(docs, id_col, text_col).select("id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff_pages(media, "id", "media", ["n_bytes", "media_bytes", "media_sha256"])
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["error"]:
                    raise ValueError(r["error"])
                if r["page"] == 0:
                    state = {"sha": hashlib.sha256(), "bytes": 0, "tail": b"", "sum": 0, "squares": 0, "same": 0}
                p = r["pixels"]
                a = np.frombuffer(p, np.uint8)
                state["sha"].update(p)
                state["bytes"] += len(p)
                state["tail"] = p[-32:]
                state["sum"] += int(a.sum(dtype=np.int64))
                state["squares"] += int(np.dot(a.astype(np.int64), a.astype(np.int64)))
                grid = a.reshape(r["height"], r["width"])
                state["same"] += int((grid[:, 1:] == grid[:, :-1]).sum())
                if r["page"] == r["n_pages"] - 1:
                    n = state["bytes"]
                    mean = state["sum"] / n
                    feature = f"pages={r['n_pages']};mean={mean:.3f};std={max(0.0, state['squares'] / n - mean * mean) ** 0.5:.3f};same={state['same'] / n:.4f}"
                    out.append((r["id"], r["n_bytes"], n, state["sha"].hexdigest(), zlib.crc32(state["tail"]), r["media_bytes"], r["media_sha256"], feature))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], schema=schema)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return pages.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
