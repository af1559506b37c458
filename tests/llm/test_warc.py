import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from layerlode.llm.warc import RECORDS, Framing, decode_chunked, encode_chunked, http_body, page_records, parse_warc, read_warc, reassemble


def test_chunked_round_trip_at_every_size():
    r = random.Random(1)
    for n in [0, 1, 9, 10, 11, 1023, 1024, 1025, 5000]:
        body = bytes(r.randrange(256) for _ in range(n))
        assert decode_chunked(encode_chunked(body, r.choice([1, 7, 10, 1024]))) == body
    assert decode_chunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"


@pytest.mark.parametrize("framed", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b"0\r\n"])
def test_broken_framing_is_seen(framed):
    with pytest.raises(Framing):
        decode_chunked(framed)


def test_http_bodies():
    assert http_body(b"HTTP/1.1 404 No\r\nContent-Length: 2\r\n\r\nhi") == (404, b"hi")
    for bad in (b"", b"HTTP/1.1 200 OK\r\n", b"x\r\n\r\n", b"HTTP/1.1 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nhi"):
        with pytest.raises(Framing):
            http_body(bad)


def pages(spark):
    rows = [(1, "http://a/", "<p>" + "é" * 9000 + "</p>"), (2, "http://b/", "short"), (3, "http://c/", ""), (4, None, "x" * 4000), (None, "http://d/", "y" * 5000), (5, "http://e/", None), (2, "http://b/", "short"), (1, "http://a/", "<p>" + "é" * 9000 + "</p>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"key": F.lit(1), "block": F.lit("x"), "problem": F.lit("y")})


def test_pages_come_back(spark):
    df = pages(spark)
    rows = reassemble(page_records(df)).collect()
    assert all(r["problem"] is None and r["status"] == 200 for r in rows)
    want = {(p["url"], p["html"]) for p in df.collect() if p["html"] is not None}
    assert {(r["target_uri"], r["body"]) for r in rows} == want
    assert all(r["n_bytes"] == len(r["body"].encode()) for r in rows)
    assert reassemble(page_records(df.limit(0))).count() == 0


def test_segments_in_any_order_and_what_is_wrong_with_them(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(b"hello world" * 20, 16)
    parts = [block[i : i + 50] for i in range(0, len(block), 50)]

    def records(name, own, total=len(block), numbers=None):
        numbers = numbers or range(1, len(own) + 1)
        return [(f"{name}" if k == 1 else f"{name}#{k}", None if k == 1 else name, k, total if i == len(own) - 1 else None, "u" if k == 1 else None, p) for i, (k, p) in enumerate(zip(numbers, own, strict=True))]

    rows = records("good", parts) + records("twice", parts) * 2 + records("short", parts, total=7) + records("gap", [parts[0], *parts[2:]], numbers=[1, *range(3, len(parts) + 1)])
    rows += records("headless", parts[1:], numbers=range(2, len(parts) + 1)) + records("untold", parts, total=None) + records("clash", parts) + [("clash#2", "clash", 2, None, None, b"other")]
    rows += [(None, None, None, None, "u", b"x"), (None, None, 3, None, None, b"x"), ("null", None, None, None, "u", None), ("html", None, None, None, "u", b"no http")]
    random.Random(4).shuffle(rows)
    out = {r["record_id"]: r for r in reassemble(spark.createDataFrame(rows, RECORDS)).collect()}
    assert {k for k, r in out.items() if r["problem"] is None} == {"good", "twice"}
    assert out["good"]["body"] == "hello world" * 20 and out["good"]["n_segments"] == len(parts)
    assert set(out) == {"good", "twice", "short", "gap", "headless", "untold", "clash", "null", "html"}
    assert out["gap"]["problem"] == "a segment is missing" and out["short"]["problem"] == "the segments haven't the total length"
    assert all(out[k]["body"] is None and out[k]["status"] is None for k in out if k not in ("good", "twice"))


def reply(body, *fields, status=b"200"):
    return b"HTTP/1.1 " + status + b" OK\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body


ODD_REPLIES = {
    "status": reply(b"x", status=b"99999999999"), "digits": reply(b"x", status=b"9" * 5000), "length": reply(b"x", b"Content-Length: " + b"9" * 5000), "negative": reply(b"x", b"Content-Length: -1"),
    "chunk": reply(b"f" * 5000 + b"\r\nabc\r\n0\r\n\r\n", b"Transfer-Encoding: chunked"), "brotli": reply(b"x", b"Content-Encoding: br"), "broken": reply(b"\x1f\x8bxx", b"Content-Encoding: gzip"),
    "cut": reply(gzip.compress(b"hello" * 99)[:-9], b"Content-Encoding: gzip"),
}


def test_content_and_transfer_codings():
    text, bare = b"hello " * 500, zlib.compressobj(wbits=-15)
    squeezed = bare.compress(text) + bare.flush()
    for body, fields in [
        (gzip.compress(text), [b"Content-Encoding: gzip"]), (gzip.compress(text[:9]) + gzip.compress(text[9:]), [b"Content-Encoding: x-gzip"]), (zlib.compress(text), [b"Content-Encoding: deflate"]), (squeezed, [b"content-encoding: Deflate"]),
        (encode_chunked(gzip.compress(text)), [b"Transfer-Encoding: gzip, chunked"]), (encode_chunked(gzip.compress(text)), [b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"]),
        (gzip.compress(zlib.compress(text)), [b"Content-Encoding: deflate, gzip"]), (text, [b"Content-Encoding: identity"]), (gzip.compress(text) + b"\0" * 70, [b"Content-Encoding: gzip"]),
    ]:
        assert http_body(reply(body, *fields)) == (200, text)
    for bad in ODD_REPLIES.values():
        with pytest.raises(Framing):
            http_body(bad)


def test_odd_replies_are_rows_with_a_problem(spark):
    rows = [(k, None, None, None, "u", v) for k, v in ODD_REPLIES.items()] + [("good", None, None, None, "u", reply(b"fine"))]
    out = {r["record_id"]: r for r in reassemble(spark.createDataFrame(rows, RECORDS)).collect()}
    assert len(out) == len(rows) and out["good"]["body"] == "fine" and out["good"]["problem"] is None
    assert all(out[k]["problem"] and out[k]["body"] is None and out[k]["status"] is None for k in ODD_REPLIES)


def warc(row):
    record, origin, number, total, uri, block = row
    fields = {"WARC-Type": "continuation" if origin else "response", "WARC-Record-ID": record, "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total, "WARC-Target-URI": uri, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + bytes(block) + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["plain", "records", "whole"])
def test_warc_files_are_read(spark, tmp_path, packed):
    df = pages(spark)
    want = sorted(tuple(r) for r in reassemble(page_records(df)).collect())
    rows = [tuple(r) for r in page_records(df).collect()]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for k in range(2):
        parts = [info, *[warc(r) for r in rows[k::2]]]
        data = {"plain": b"".join(parts), "records": b"".join(map(gzip.compress, parts)), "whole": gzip.compress(b"".join(parts))}[packed]
        (tmp_path / f"{k}.warc").write_bytes(data)
    found = read_warc(spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted(tuple(r) for r in reassemble(found).collect()) == want


def test_unreadable_files_are_named():
    good = warc(("a", None, None, None, "u", b"x" * 200_000))
    assert [r[0] for r in parse_warc(good + b"junk", "f")] == ["a", f"f#{len(good)}"]
    assert [r[0] for r in parse_warc(good[:-9], "f")] == ["f#0"] and list(parse_warc(b"", "f")) == []
    assert [r[0] for r in parse_warc(gzip.compress(good) + gzip.compress(good)[:-30], "f")][0] == "a"
    assert [r[0] for r in parse_warc(b"\x1f\x8bxx", "f")] == ["f#0"]
    assert [r[0] for r in parse_warc(good.replace(b"Content-Length: 200000", b"Content-Length: " + b"9" * 5000), "f")] == ["f#0"]
