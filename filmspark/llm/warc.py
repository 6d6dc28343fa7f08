"""WARC archives: writing records, and normalising archives that were compressed as one gzip stream.

A record-compressed archive holds one gzip member for each record, so a record can be read alone, given its offset. Many
archives in the wild are one monolithic stream instead. `normalise` inflates such a stream once, front to back, cuts it into
records, writes each record as a member of its own and lists every member's place in a sidecar index.

Archives are rows (archive, content): as Spark's binaryFile source reads them, or as `write_archives` makes them. The query stores three tables in the
shared folder: the monolithic archives, the normalised ones, and the sidecar index with a row for each record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import written

#: An archive is closed once this many bytes of records, headers included, are in it.
ARCHIVE_BYTES = 1 << 20
_ROW_GROUP = 16 << 20
_PIECE = 1 << 18
_MOST = 4 << 20
# Fixed value of the format: the profile of revisits with an identical payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def header_bytes(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name. Raises ValueError on what isn't a WARC header."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces of at most `_MOST`, over all its members. Raises ValueError on damaged or cut streams."""
    at = 0
    while at < len(content):
        d = zlib.decompressobj(31)
        try:
            while not d.eof and at < len(content):
                piece = content[at : at + _PIECE]
                at += len(piece)
                got = b""
                # a small piece may hold much, which then comes in several
                while piece or len(got) == _MOST:
                    got = d.decompress(piece, _MOST)
                    piece = d.unconsumed_tail
                    if got:
                        yield got
                    if d.eof:
                        at -= len(d.unused_data)
                        break
        except zlib.error as e:
            raise ValueError(f"damaged gzip stream: {e}") from e
        if not d.eof:
            raise ValueError("the gzip stream is cut short")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of an uncompressed stream; holds one record at a time. Raises ValueError on a cut record."""
    held = bytearray()
    source = iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        seen = 0
        while (end := held.find(_END, max(0, seen - 3))) < 0:
            # what was searched isn't searched again
            seen = len(held)
            if not more():
                break
        if end < 0:
            if held.strip(b"\r\n"):
                raise ValueError("the last record is cut short")
            return
        head = bytes(held[: end + 4])
        size = int(parse_header(head).get("content-length", "-1"))
        if size < 0:
            raise ValueError("a record has no Content-Length")
        while len(held) < end + 8 + size and more():
            pass
        if len(held) < end + 4 + size:
            raise ValueError("the last record is cut short")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def normalise_bytes(content: bytes) -> tuple[bytes, list[tuple[int, int, dict[str, str]]]]:
    """The archive with one gzip member for each record, and (offset, length, header fields) of each member."""
    out, index = bytearray(), []
    for head, block in records(inflate(content)):
        m = member(head + block + _END)
        index.append((len(out), len(m), parse_header(head)))
        out += m
    return bytes(out), index


def read_record(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record in one member, by its place in the index."""
    head, block = next(records(inflate(content[offset : offset + length])))
    return parse_header(head), block


Batches = Iterator[pa.RecordBatch]

_PLACE = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("digest", pa.string())])
_NORMAL = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("index", pa.list_(_PLACE)), ("error", pa.string())])
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _written(batches: Batches, archive_bytes: int) -> Batches:
    task = TaskContext.get()
    part, n = (task.partitionId() if task else 0), 0
    squeeze, parts, held = None, [], 0

    def closed() -> pa.RecordBatch:
        # the same name if the task runs again, and no other task's
        return pa.record_batch([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([b"".join([*parts, squeeze.flush()])], pa.binary())], names=["archive", "content"])

    for b in batches:
        for k in range(b.num_rows):
            fields = [(x["key"], x["value"]) for x in b.column(0)[k].as_py()]
            payload = b.column(1)[k].as_py() or b""
            if squeeze is None:
                squeeze, parts, held = zlib.compressobj(1, zlib.DEFLATED, 31), [], 0
            head = header_bytes([*fields, ("Content-Length", str(len(payload)))])
            parts += [squeeze.compress(head), squeeze.compress(payload), squeeze.compress(_END)]
            held += len(head) + len(payload) + len(_END)
            if held >= archive_bytes:
                yield closed()
                squeeze, n = None, n + 1
    if squeeze is not None:
        yield closed()


def _normalised(batches: Batches) -> Batches:
    for b in batches:
        for name, content in zip(b.column(0), b.column(1), strict=True):
            try:
                data, index = normalise_bytes(content.as_py() or b"")
                error = None
                rows = [{"offset": o, "length": n, "type": h.get("warc-type"), "id": h.get("warc-record-id"), "digest": h.get("warc-payload-digest")} for o, n, h in index]
            except ValueError as e:
                data, rows, error = None, [], str(e)
            yield pa.RecordBatch.from_pylist([{"archive": name.as_py(), "content": data, "index": rows, "error": error}], schema=_NORMAL)


def _read(batches: Batches) -> Batches:
    for b in batches:
        for name, content, index in zip(b.column(0), b.column(1), b.column(2), strict=True):
            data, rows, held = content.as_py() or b"", [], 0
            for place in index.as_py() or []:
                fields, block = read_record(data, place["offset"], place["length"])
                rows.append({"archive": name.as_py(), "offset": place["offset"], "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "fields": list(fields.items()), "block": block})
                held += len(block)
                if held > _PIECE * 4:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


_RECORD_COLUMNS = "archive string, offset long, type string, id string, fields map<string, string>, block binary"


def write_archives(df: DataFrame, header_col: str, payload_col: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pack rows into archives, each one gzip stream: rows (archive, content). header_col: array of (key, value) structs without Content-Length.

    Rows keep their order within a task; an archive is closed once it holds `archive_bytes`, headers included, so a task holds about one archive. A null payload is empty; repeated rows are
    records each; an empty table gives no archive.
    """
    return df.select(header_col, payload_col).mapInArrow(lambda b: _written(b, archive_bytes), "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """archives: (archive, content). One row for each: archive, content (a member for each record), index (the sidecar), error.

    index: array of (offset, length, type, id, digest). An empty or null content is an archive without records. A damaged
    archive keeps a row with null content and the reason in `error`, so that one bad file never stops a crawl. Repeated archives are normalised each; an empty table gives an empty one.
    """
    return archives.select("archive", "content").mapInArrow(_normalised, "archive string, content binary, index array<struct<offset: long, length: long, type: string, id: string, digest: string>>, error string")


def read_records(normal: DataFrame) -> DataFrame:
    """Every record of normalised archives, each read alone by its place in the index: archive, offset, type, id, fields (map), block. Archives that are damaged or without records give none;
    repeated ones give theirs each; an empty table gives an empty one."""
    return normal.select("archive", "content", "index").mapInArrow(_read, _RECORD_COLUMNS)


def sidecar(normal: DataFrame) -> DataFrame:
    """The index of normalised archives, a row for each record: archive, offset, length, type, id, digest. Archives that are damaged or without records have none; repeated ones have theirs
    each; an empty table gives an empty one."""
    return normal.select("archive", F.explode("index").alias("i")).select("archive", "i.*")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Header fields and payload of a WARC/1.1 record for each page: id, header, payload. date: the WARC-Date of all (pages don't tell when they were fetched).

    Of pages with equal payloads of at least `least_bytes`, the one with the largest id is a response and the others revisit it; smaller ones are
    all responses. Rows that share the largest id are all responses. Ids may be numbers or text; rows with one id get records with one WARC-Record-ID, so the format's rule that these differ holds if ids do. Only (digest, largest id) pairs of repeated payloads are gathered, by a partial
    aggregate; they are joined to the pages that are large enough, a join whose large side Spark can split if a payload is very common. The other pages move nowhere.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = p.where(F.col("size") >= least_bytes).withColumn("same", F.sha2("payload", 256))
    repeated = large.groupBy("same").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    small = p.where(F.col("size") < least_bytes).withColumn("first", F.lit(None).cast(p.schema["id"].dataType))
    r = large.join(repeated, "same", "left").drop("same").unionByName(small)
    r = r.withColumn("refers_to", F.when(F.col("id") < F.col("first"), F.col("first")))
    again = F.col("refers_to").isNotNull()
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    # ids of any type that text can hold; what an URI can't hold is escaped, so no id looks like the mark of a missing one
    uri = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page::null>"))
    head = [
        pair("WARC-Type", F.when(again, "revisit").otherwise("response")), pair("WARC-Record-ID", uri(F.col("id"))), pair("WARC-Date", F.lit(date)),
        pair("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), pair("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), pair("Content-Type", F.lit("text/html; charset=utf-8")),
    ]
    # the format has no field for the size of a payload that is elsewhere, so an extension field carries it
    more = [pair("WARC-Profile", F.lit(REVISIT)), pair("WARC-Refers-To", uri(F.col("refers_to"))), pair("X-Payload-Length", F.col("size"))]
    # a revisit record has no payload of its own
    return r.select("id", F.when(again, F.array(*head, *more)).otherwise(F.array(*head)).alias("header"), F.when(~again, F.col("payload")).alias("payload"))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page into monolithic archives, normalise these, read every record back by its index. Archives, normalised archives and sidecar index are tables in the shared folder.

    Returns id_col, payload_bytes, payload_digest (bare SHA-1), record_type, refers_to, archive, member_offset. Size and digest of a response are
    computed from the payload that was read back; those of a revisit are the ones that its header carries. A null html is
    empty; null ids stay null, and ids keep their type; repeated rows each get a record; extra columns are ignored; an empty table gives an empty one. A damaged archive ends the query.
    """
    archives = written(write_archives(page_records(pages, id_col, url_col, html_col), "header", "payload"), "archives", _ROW_GROUP)
    normal = written(normalise(archives), "normalised", _ROW_GROUP)
    index = written(sidecar(normal), "sidecar")
    places = F.array_sort(F.collect_list(F.struct("offset", "length", "type", "id", "digest")))
    by_index = normal.select("archive", "content", F.assert_true(F.col("error").isNull(), F.col("error")).alias("ok")).join(index.groupBy("archive").agg(places.alias("index")), "archive")
    back = read_records(by_index)
    number = lambda c: F.when(c.startswith("<urn:page:") & (c != "<urn:page::null>"), F.url_decode(F.substring(c, 11, F.length(c) - 11))).cast(pages.schema[id_col].dataType)
    field = lambda k: F.element_at("fields", k)
    response = F.col("type") == "response"
    return back.select(
        number(F.col("id")).alias(id_col), F.when(response, F.octet_length("block").cast("long")).otherwise(field("x-payload-length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("block")).otherwise(F.substring(field("warc-payload-digest"), 6, 40)).alias("payload_digest"), F.col("type").alias("record_type"),
        number(field("warc-refers-to")).alias("refers_to"), "archive", F.col("offset").alias("member_offset"),
    )
