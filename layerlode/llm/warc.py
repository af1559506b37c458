"""WARC segment reassembly: continuation records joined to their origin, lengths verified, chunked transfer decoded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlode.llm.common import small_batches

#: Bytes of a segment's block, and of a chunk of the transfer coding, in records made from pages.
SEGMENT_BYTES, CHUNK_BYTES = 4096, 1024
RECORDS = "record_id string, origin_id string, segment_number int, total_length bigint, target_uri string, block binary"
_CRLF = b"\r\n"
#: A decoded body of more bytes is a problem and no body: a cell of a table holds no more than 2 GiB.
MOST_BYTES = 1 << 30
_FLUSH, _PIECE = 1 << 27, 1 << 16


class Framing(ValueError):
    """A block that isn't HTTP with the framing its head names."""


def encode_chunked(body: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (min(chunk, len(body) - i), body[i : i + chunk]) for i in range(0, len(body), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(framed: bytes) -> bytes:
    """The body of a chunked transfer coding (RFC 9112, 7.1); extensions and trailers are read over."""
    out, at = [], 0
    while True:
        end = framed.find(_CRLF, at)
        if end < 0:
            raise Framing("a chunk's size line has no end")
        digits = framed[at:end].split(b";", 1)[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise Framing("a chunk's size isn't a hexadecimal number")
        if len(digits.lstrip(b"0")) > 15:
            raise Framing("a chunk is shorter or longer than its size")
        n, at = int(digits, 16), end + 2
        if not n:
            break
        if framed[at + n : at + n + 2] != _CRLF:
            raise Framing("a chunk is shorter or longer than its size")
        out.append(framed[at : at + n])
        at += n + 2
    while True:  # trailer fields up to an empty line
        end = framed.find(_CRLF, at)
        if end < 0:
            raise Framing("the last chunk has no end")
        if end == at:
            return b"".join(out)
        at = end + 2


def _pieces(body: bytes, bits: int) -> Iterator[bytes]:
    """What a compressed body holds, piece by piece; with ``bits`` 31 all members of gzip one after the other."""
    at = 0
    while at < len(body):
        inflater = zlib.decompressobj(bits)
        while not inflater.eof:
            if at == len(body):
                raise Framing("a compressed body is cut short")
            piece = body[at : at + _PIECE]
            at += len(piece)
            try:
                yield inflater.decompress(piece)
            except zlib.error as x:
                raise Framing("a compressed body is broken") from x
        at -= len(inflater.unused_data)
        if bits != 31 or not body[at : at + _PIECE].strip(b"\0"):
            return


def _inflated(body: bytes, bits: int) -> bytes:
    out, held = [], 0
    for piece in _pieces(body, bits):
        held += len(piece)
        if held > MOST_BYTES:
            raise Framing("the body is larger than a table's cell")
        out.append(piece)
    return b"".join(out)


def _decoded(body: bytes, coding: bytes) -> bytes:
    if coding in (b"", b"identity"):
        return body
    if coding in (b"gzip", b"x-gzip"):
        return _inflated(body, 31)
    if coding == b"deflate":  # with the head of zlib, as it should be, or bare, as some servers send it
        headed = len(body) >= 2 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0
        return _inflated(body, 15 if headed else -15)
    raise Framing(f"a coding that isn't read here: {coding[:32].decode('latin-1')}")


def http_body(block: bytes) -> tuple[int, bytes]:
    """(status, body) of an HTTP response without its transfer and content codings."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise Framing("no HTTP head")
    lines = head.split(_CRLF)
    status = lines[0].split(None, 2)
    if len(status) < 2 or len(status[1]) != 3 or not status[1].isdigit():
        raise Framing("no HTTP status")
    fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in lines[1:])]

    def codings(name: bytes) -> list[bytes]:
        return [c.split(b";", 1)[0].strip().lower() for k, v in fields if k == name for c in v.split(b",")]

    transfer = [c for c in codings(b"transfer-encoding") if c]
    if transfer:
        for coding in reversed(transfer):
            body = decode_chunked(body) if coding == b"chunked" else _decoded(body, coding)
    else:
        lengths = {v for k, v in fields if k == b"content-length"}
        if lengths and (len(lengths) > 1 or not (least := lengths.pop()).isdigit() or len(least.lstrip(b"0")) > 18 or int(least) != len(body)):
            raise Framing("the body hasn't the length that its head names")
    for coding in reversed(codings(b"content-encoding")):
        body = _decoded(body, coding)
    if len(body) > MOST_BYTES:
        raise Framing("the body is larger than a table's cell")
    return int(status[1]), body


def _cut(segment: int, chunk: int):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("segment_number", pa.int32()), ("total_length", pa.int64()), ("target_uri", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, url, html in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                block = head + encode_chunked(html.encode("utf-8"), chunk)
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                if len(parts) == 1:
                    rows.append((origin, None, None, None, url, block))
                    continue
                rows.append((origin, None, 1, None, url, parts[0]))
                last = len(parts)
                rows += [(f"{origin}#{k}", origin, k, len(block) if k == last else None, None, part) for k, part in enumerate(parts[1:], 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def page_records(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """WARC records (``RECORDS``) of pages: HTTP responses with chunked bodies, cut into segments where they are long.

    The first segment carries the URL and number 1, a continuation its origin's id and number, the last one the length
    of the whole block. A response that fits a segment is a record without a number. Pages without html give none.
    """
    small_batches(pages.sparkSession)
    origin = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("-"), F.md5(F.concat(F.coalesce("url", F.lit("")), F.col("html"))))
    narrow = pages.where("html is not null").select(origin.alias("o"), F.col("url").cast("string").alias("u"), F.col("html").cast("string").alias("h"))
    return narrow.mapInArrow(_cut(segment_bytes, chunk_bytes), RECORDS)


_OUT = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("status", pa.int32()), ("n_segments", pa.int32()), ("n_bytes", pa.int64()), ("body", pa.string()), ("problem", pa.string())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record_id, target_uri, n_segments, problem, blocks) to responses."""
    for batch in batches:
        rid, uri, n, problem, blocks = batch.columns
        offsets = np.asarray(blocks.offsets)
        values = blocks.values
        out: list[tuple] = []
        first = held = 0
        for i in range(batch.num_rows):
            why = problem[i].as_py()
            status = body = size = None
            if why is None:
                block = b"".join([values[j].as_py() or b"" for j in range(offsets[i], offsets[i + 1])])
                try:
                    status, raw = http_body(block)
                    size, body = len(raw), raw.decode("utf-8", errors="replace")
                    held += size
                except Framing as x:
                    status, why = None, str(x)
            out.append((status, size, body, why))
            if held > _FLUSH or i == batch.num_rows - 1:
                cols, own = list(zip(*out, strict=True)), slice(first, i + 1)
                yield pa.RecordBatch.from_arrays(
                    [rid[own], uri[own], pa.array(cols[0], pa.int32()), n[own], pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], schema=_OUT
                )
                out, first, held = [], i + 1, 0


def reassemble(records: DataFrame) -> DataFrame:
    """One response for each origin: record_id, target_uri, status, n_segments, n_bytes, body and problem.

    Continuations are grouped by the identifier of their origin and ordered by segment number; numbers must run from 1
    without a gap and the blocks add up to the total length that the last one names. Then the HTTP head is read and
    transfer and content codings (chunked, gzip, deflate) decoded; bytes that aren't UTF-8 become U+FFFD. What fails has
    a ``problem`` and null status, n_bytes and body: a status that isn't three digits, a length or chunk that doesn't
    hold, another coding, a broken or cut compressed body, or one of more than ``MOST_BYTES``. Good responses have a
    null problem, empty bodies 0 bytes.

    Records without a segment number are whole and aren't shuffled; only segments are. Repeated equal segments count
    once; different blocks of one number are a problem, as are a missing first segment and a missing or contradictory
    total. Records without an id (of their own or of their origin) are left out; a null block counts as empty. An empty
    table gives no rows; other columns aren't read.
    """
    small_batches(records.sparkSession)
    own = records.selectExpr(*[f"cast({x.split()[0]} as {x.split()[1]}) as {x.split()[0]}" for x in RECORDS.split(", ")])
    own = own.withColumn("block", F.coalesce("block", F.lit(b"")))
    single = own.where("segment_number is null and record_id is not null").selectExpr("record_id", "target_uri", "1 as n_segments", "cast(null as string) as problem", "array(block) as blocks")
    parts = own.where("segment_number is not null").withColumn("key", F.when(F.col("segment_number") == 1, F.col("record_id")).otherwise(F.col("origin_id"))).where("key is not null")
    groups = parts.groupBy("key").agg(
        F.max("target_uri").alias("target_uri"),
        F.array_sort(F.collect_set(F.struct("segment_number", "block"))).alias("segments"),
        F.min("total_length").alias("least"),
        F.max("total_length").alias("most"),
        F.max(F.when(F.col("total_length").isNotNull(), F.col("segment_number"))).alias("ends"),
    )
    numbers = F.transform("segments", lambda s: s["segment_number"])
    length = F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, s: a + F.octet_length(s["block"]))
    problem = (
        F.when(F.size(F.array_distinct(numbers)) < F.size("segments"), F.lit("different blocks have one segment number"))
        .when((numbers[0] != 1) | (F.element_at(numbers, -1) != F.size("segments")), F.lit("a segment is missing"))
        .when(F.col("least").isNull() | (F.col("least") != F.col("most")) | (F.col("ends") != F.size("segments")), F.lit("no single total length at the last segment"))
        .when(F.col("most") != length, F.lit("the segments haven't the total length"))
    )
    joined = groups.select(F.col("key").alias("record_id"), "target_uri", F.size("segments").alias("n_segments"), problem.alias("problem"), F.transform("segments", lambda s: s["block"]).alias("blocks"))
    kind = "record_id string, target_uri string, status int, n_segments int, n_bytes bigint, body string, problem string"
    return single.unionByName(joined).mapInArrow(_decode, kind)


def _field(head: dict[bytes, bytes], name: bytes) -> str | None:
    value = head.get(name)
    return None if value is None else value.decode("utf-8", errors="replace")


def _number(head: dict[bytes, bytes], name: bytes, most: int) -> int | None:
    value = head.get(name, b"")
    return int(value) if value.isdigit() and len(value.lstrip(b"0")) <= 18 and int(value) <= most else None


def parse_warc(data: bytes, path: str, kinds: tuple[bytes, ...] = (b"response", b"continuation")) -> Iterator[tuple]:
    """The rows (``RECORDS``) of a WARC file, plain or gzipped, as a whole or record by record; read as a stream.

    What can't be read as a record from some byte of the plain file on is one row with the id ``path#byte`` and a null block.
    """
    source = _pieces(data, 31) if data[:2] == b"\x1f\x8b" else (data[i : i + _PIECE] for i in range(0, len(data), _PIECE))
    held, at, whole = b"", 0, True

    def more(least: int) -> None:
        nonlocal held, whole
        parts, have = [held], len(held)
        try:
            while have < least:
                parts.append(next(source))
                have += len(parts[-1])
        except StopIteration:
            pass
        except Framing:
            whole = False
        held = b"".join(parts)

    while True:
        more(2 * _PIECE)
        rest = held.lstrip(_CRLF)
        at, held = at + len(held) - len(rest), rest
        if not held and whole:
            return
        end = held.find(b"\r\n\r\n", 0, 2 * _PIECE)
        lines = held[:end].split(_CRLF) if end >= 0 else []
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = _number(head, b"content-length", MOST_BYTES)
        if lines and lines[0].startswith(b"WARC/") and size is not None:
            more(end + 4 + size)
        if not lines or not lines[0].startswith(b"WARC/") or size is None or end + 4 + size > len(held):
            yield f"{path}#{at}", None, None, None, None, None
            return
        if head.get(b"warc-type", b"").lower() in kinds:
            yield (
                _field(head, b"warc-record-id"), _field(head, b"warc-segment-origin-id"), _number(head, b"warc-segment-number", 2**31 - 1),
                _number(head, b"warc-segment-total-length", 2**63 - 1), (_field(head, b"warc-target-uri") or "").strip("<>") or None, held[end + 4 : end + 4 + size],
            )
        at, held = at + end + 4 + size, held[end + 4 + size :]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and continuation records (``RECORDS``) of the WARC files at ``path`` (a file, folder or pattern), gzipped or
    plain. A file is read by one task and must be under 2 GiB as it lies there; the format asks for 1 GB. See ``parse_warc``
    for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for row in parse_warc(data.as_py(), name):
                    rows.append(row)
                    held += len(row[5] or b"")
                    if held > _FLUSH:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _record_batch(rows)

    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
