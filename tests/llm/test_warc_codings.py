"""Bodies of WARC responses in transfer and content codings, other charsets and types, and the headers that records keep."""

import gzip
import io
import zlib

import pytest

from lumenlake.llm import warc
from lumenlake.llm.common import materialise, scratch_path

PAGE = "<html><body><p>Größe & more</p><a href='/x'>l</a></body></html>"


def chunked(data: bytes, size: int = 7) -> bytes:
    return b"".join(b"%x;e=1\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\nX-Sum: 1\r\n\r\n"


def raw_deflate(data: bytes) -> bytes:
    z = zlib.compressobj(wbits=-15)
    return z.compress(data) + z.flush()


def response(body: bytes, *headers: str) -> bytes:
    return "\r\n".join(("HTTP/1.1 200 OK", *headers)).encode() + b"\r\n\r\n" + body


def derived(block: bytes, headers: str | None = None) -> dict:
    return {r[2]: r for r in warc.derive_one(1, "<urn:uuid:s>", "http://a/", "2024-01-01T00:00:00Z", None, None, headers, block)}


U8 = PAGE.encode()
HTML = "Content-Type: text/html; charset=utf-8"


@pytest.mark.parametrize(
    "body, headers",
    [
        (U8, [HTML]),
        (chunked(U8), [HTML, "Transfer-Encoding: chunked"]),
        (gzip.compress(U8), [HTML, "Content-Encoding: gzip"]),
        (gzip.compress(U8[:20]) + gzip.compress(U8[20:]), [HTML, "content-encoding: X-GZIP"]),
        (zlib.compress(U8), [HTML, "Content-Encoding: deflate"]),
        (raw_deflate(U8), [HTML, "Content-Encoding: deflate"]),
        (chunked(gzip.compress(U8), 16), [HTML, "Transfer-Encoding: chunked", "Content-Encoding: gzip"]),
        (chunked(gzip.compress(U8), 16), [HTML, "Transfer-Encoding: gzip, chunked"]),
        (gzip.compress(zlib.compress(U8)), [HTML, "Content-Encoding: deflate, gzip"]),
        (U8, [HTML, "Transfer-Encoding: chunked", "Content-Encoding: gzip"]),  # undone before
        (PAGE.encode("latin-1"), ["Content-Type: text/html; charset=ISO-8859-1"]),
        (b"<meta charset='iso-8859-1'>" + PAGE.encode("latin-1"), ["Content-Type: text/html"]),
        (b'<meta http-equiv="x" content="text/html; charset=latin1">' + PAGE.encode("latin-1"), ["Content-Type: text/html; charset=none-such"]),
        (b"\xef\xbb\xbf" + U8, ["Content-Type: text/html; charset=latin-1"]),
        (b"\xff\xfe" + PAGE.encode("utf-16-le"), ["Content-Type: text/html"]),
        (b"<meta charset=utf-16>" + U8, []),
        (U8, []),
        (U8, ["Content-Type: application/xhtml+xml"]),
    ],
)
def test_markup_in_any_coding_has_the_same_text(body, headers):
    found = derived(response(body, *headers))
    assert found["conversion"][-1].decode() == "Größe & more\nl"
    assert b"outlink: /x\r\n" in found["metadata"][-1]


def test_payload_digest_is_of_the_entity():
    packed = gzip.compress(U8)
    found = derived(response(chunked(packed), HTML, "Transfer-Encoding: chunked", "Content-Encoding: gzip"))
    assert found["metadata"][8] == found["conversion"][8] == warc.digest(packed)


@pytest.mark.parametrize(
    "body, headers, lack",
    [
        (b"\x89PNG\r\n\x1a\n\0\0", ["Content-Type: image/png"], "type image/png is no text"),
        (b"\0\1\2", [], "a body without a type holds zero bytes"),
        (gzip.compress(U8)[:-9], [HTML, "Content-Encoding: gzip"], "a body of coding gzip is damaged"),
        (b"not deflated", [HTML, "Content-Encoding: deflate"], "a body of coding deflate is damaged"),
        (b"x", [HTML, "Content-Encoding: br"], "coding br is not known"),
        (chunked(U8)[:40], [HTML, "Transfer-Encoding: chunked"], "the last chunk is cut short"),
        (b"3\r\nabc\r\nno size", [HTML, "Transfer-Encoding: chunked"], "a chunk has no size"),
    ],
)
def test_what_has_no_text_has_a_metadata_record_alone(body, headers, lack):
    found = derived(response(body, *headers))
    assert list(found) == ["metadata"]
    about = found["metadata"][-1].decode()
    assert f"text-absent: {lack}\r\n" in about and "text-length" not in about


def test_other_text_stays_as_it_is():
    found = derived(response(b'{"a": "<p>"}\r\n', "Content-Type: application/ld+json"))
    assert found["conversion"][-1] == b'{"a": "<p>"}\n'
    assert derived(response(b"a <b> c", "Content-Type: text/plain"))["conversion"][-1] == b"a <b> c"


@pytest.mark.parametrize("name", ["undefined", "idna", "hex", "punycode", "unicode_escape", "a\0b", "x" * 5000])
def test_odd_charsets_do_not_fail(name):
    assert set(derived(response("é\\x".encode() * 50, f"Content-Type: text/html; charset={name}"))) == {"metadata", "conversion"}


def test_empty_bodies_have_empty_texts():
    for headers in ([HTML], [HTML, "Transfer-Encoding: chunked"], [HTML, "Content-Encoding: gzip"], []):
        assert derived(response(b"", *headers))["conversion"][-1] == b""


SOURCE = (
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:s>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: http://a/\r\n"
    b"WARC-IP-Address: 192.0.2.1\r\nWARC-Concurrent-To: <urn:uuid:q>\r\nWARC-Concurrent-To: <urn:uuid:r>\r\nWARC-Truncated: length\r\n"
    b"WARC-Identified-Payload-Type: text/html,\r\n  as seen\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
)


def test_other_headers_are_kept_and_written_again():
    block = response(U8, HTML)
    (record,) = warc.parse(io.BytesIO(SOURCE % (len(block), block)))
    want = "WARC-IP-Address: 192.0.2.1\nWARC-Concurrent-To: <urn:uuid:q>\nWARC-Concurrent-To: <urn:uuid:r>\nWARC-Truncated: length\nWARC-Identified-Payload-Type: text/html, as seen"
    assert record[-2] == want and record[-1] == block
    assert list(warc.parse(io.BytesIO(warc.serialise(record)))) == [record]
    found = derived(block, record[-2])
    assert b"source-warc-ip-address: 192.0.2.1\r\nsource-warc-concurrent-to: <urn:uuid:q>\r\nsource-warc-concurrent-to: <urn:uuid:r>\r\n" in found["metadata"][-1]
    for r in found.values():
        data = warc.serialise(r)
        assert b"WARC-Refers-To: <urn:uuid:s>\r\nWARC-" in data and b"WARC-Refers-To-Target-URI: http://a/\r\nWARC-Refers-To-Date: 2024-01-01T00:00:00Z\r\n" in data


@pytest.mark.parametrize("size", [b"-1", b"", b"x"])
def test_records_without_a_length_are_refused(size):
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: " + size + b"\r\n\r\nabc\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n")))


def test_files_keep_headers_through_derivation(spark):
    block = response(chunked(gzip.compress(U8)), HTML, "Transfer-Encoding: chunked", "Content-Encoding: gzip")
    (source,) = warc.parse(io.BytesIO(SOURCE % (len(block), block)))
    out = scratch_path(spark, "warc")
    responses = spark.createDataFrame([source], warc.RECORD)
    files, _ = materialise(warc.write_warc(responses, out), "files")
    back = warc.read_warc(spark, [f.path for f in files.collect()])
    assert [tuple(r)[:-1] + (bytes(r.block),) for r in back.collect()] == [source]
    made = warc.derive(back)
    again, _ = materialise(warc.write_warc(made, scratch_path(spark, "warc")), "files")
    rows = {r.warc_type: r for r in warc.read_warc(spark, [f.path for f in again.collect()]).collect()}
    assert bytes(rows["conversion"].block).decode() == "Größe & more\nl" and rows["conversion"].refers_to == "<urn:uuid:s>"
    assert rows["metadata"].headers == "WARC-Refers-To-Target-URI: http://a/\nWARC-Refers-To-Date: 2024-01-01T00:00:00Z"
    assert b"source-warc-truncated: length\r\n" in bytes(rows["metadata"].block)
