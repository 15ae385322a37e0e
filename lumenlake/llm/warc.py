"""WARC derivatives: from each response record a metadata record and a plain-text conversion record.

Both refer to the response by WARC-Refers-To, with its target and date, and keep its HTTP status, HTTP and WARC headers and
digests. Transfer and content codings are undone and the charset is taken from a byte order mark, the HTTP head or the
page's meta elements; markup becomes its text, other text stays as it is. Record ids are name-based, so a task that runs
again makes the same records. Everything is per record: no shuffle; memory is bounded by
one Arrow batch. Files are read and written record by record, plain or with one gzip member a record.

Cases: a null or empty page gives an empty conversion; a null url leaves WARC-Target-URI out; repeated rows give equal
records, each returned; records of other types are left as they are (derive skips them); bytes that are not of the charset
become replacement characters; a body of a type that is no text, or of a coding that is unknown or damaged, gives a metadata
record alone, which says so; a coding that the head names but the body does not have was undone before; an unclosed comment, script or tag ends with the page; a page of any length is one record, worked
on in memory in proportion to it; an empty table gives an empty table; other columns are not read. A file that ends within
a record, or within a gzip member, or a record of a negative or no length, raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sstable import open_uri

VERSION = b"WARC/1.1"
_SPACE = uuid.UUID("8b0f4bb8-7d25-5a3c-9a52-5f2f6f0e6b11")

RECORD = "key long, record_id string, warc_type string, target_uri string, warc_date string, refers_to string, content_type string, block_digest string, payload_digest string, headers string, block binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [pa.int64(), *[pa.string()] * 9, pa.binary()]

# Elements whose content is not text, and elements that end a line.
_RAW = frozenset(("script", "style", "template", "noscript", "textarea", "svg"))
_BREAKS = frozenset(
    ("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6")
    + ("head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")
)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_META = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
# WARC fields that have a column of RECORD; types of text besides text/*; marks of byte order.
_OWN = ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-refers-to", "warc-block-digest", "warc-payload-digest", "content-type", "content-length")
_MARKUP = re.compile(r"text/(?:html|xml)|application/(?:xml|(?:[\w.-]+\+)?xml)|[\w.-]+/[\w.-]+\+xml")
_TEXTUAL = re.compile(r"text/.+|application/(?:json|javascript|ecmascript|x-javascript|x-ndjson|yaml|x-yaml|rtf|sql)|[\w.-]+/[\w.-]+\+json")
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_CLOSERS = {name: re.compile(rf"</{name}(?![A-Za-z0-9])", re.I) for name in _RAW}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {source}')}>"


def _tag_end(page: str, at: int) -> int:
    """The place after the tag that begins at at; quoted attribute values may hold >."""
    quote = ""
    for m in re.compile(r"[\"'>]").finditer(page, at + 1):
        c = m[0]
        if quote:
            quote = "" if c == quote else quote
        elif c == ">":
            return m.end()
        elif page[m.start() - 1] in "= \t\n":
            quote = c
    return len(page)


def text_and_links(page: str) -> tuple[str, list[str]]:
    """The page's text, a line for each block, and the targets of its links, in order."""
    out, links, at, n = [], [], 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            out.append(html.unescape(page[at:lt]).replace("\n", " ").replace("\r", " "))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
        elif m := _TAG.match(page, lt):
            name = m[1].lower()
            gt = page.find(">", lt)
            at = gt + 1 if gt >= 0 and page.count('"', lt, gt) % 2 == 0 and page.count("'", lt, gt) % 2 == 0 else _tag_end(page, lt)
            if name == "a" and page[lt + 1] != "/" and (h := _HREF.search(page, lt, at)):
                links.append(html.unescape(h[1] or h[2] or h[3] or ""))
            if name in _BREAKS:
                out.append("\n")
            elif name in _RAW and page[lt + 1] != "/" and page[at - 2 : at] != "/>":
                closed = _CLOSERS[name].search(page, at)
                at = _tag_end(page, closed.start()) if closed else n
        elif page.startswith(("<!", "<?", "</"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        else:  # a bare <
            out.append("<")
            at = lt + 1
    lines = (x.strip() for x in _BLANKS.sub(" ", "".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), links


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and body of an HTTP response; no head: an empty status and the whole as body."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()], body


class NotReadable(ValueError):
    """A body that has no text: of a type that is none, or of a coding that cannot be undone."""


def _values(headers: list[tuple[str, str]], name: str) -> list[str]:
    """The comma-separated values of all headers of a name, in lower case."""
    return [x for k, v in headers if k.lower() == name for x in (y.strip().lower() for y in v.split(",")) if x]


def unchunked(data: bytes) -> bytes:
    """The bytes of a chunked body; bytes that do not begin with a chunk are returned as they are."""
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        size = data[at : end if end >= 0 else len(data)].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            if at == 0:
                return data
            raise NotReadable("a chunk has no size")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if end < 0 or len(data) < end + 1 + n:
            if at == 0:
                return data
            raise NotReadable("the last chunk is cut short")
        out.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if data.startswith(b"\r\n", at) else int(data.startswith(b"\n", at))


def _inflate(data: bytes, bits: int) -> bytes:
    """All members of a deflated body; one that is cut short or damaged is not readable."""
    out = []
    while data:
        z = zlib.decompressobj(bits)
        out.append(z.decompress(data) + z.flush())
        if not z.eof:
            raise zlib.error("cut short")
        data = z.unused_data if bits == 31 and z.unused_data.startswith(b"\x1f\x8b") else b""
    return b"".join(out)


def undo(coding: str, data: bytes) -> bytes:
    """The bytes before one transfer or content coding was applied."""
    if coding in ("identity", "none", "") or not data:
        return data
    if coding == "chunked":
        return unchunked(data)
    try:
        if coding in ("gzip", "x-gzip"):
            return _inflate(data, 31) if data.startswith(b"\x1f\x8b") else data
        if coding == "deflate":
            try:
                return _inflate(data, 15)
            except zlib.error:
                return _inflate(data, -15)
    except zlib.error as e:
        raise NotReadable(f"a body of coding {coding} is damaged") from e
    raise NotReadable(f"coding {coding} is not known")


def entity_of(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without its transfer codings, which payload digests are of."""
    for coding in reversed(_values(headers, "transfer-encoding")):
        body = undo(coding, body)
    return body


def charset_of(kind: str, data: bytes) -> tuple[str, int]:
    """(charset, bytes of the mark that says so): by byte order mark, Content-Type, the page's meta elements, else UTF-8."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name, len(mark)
    name = kind.lower().partition("charset=")[2].split(";")[0].strip(" \"'")
    if not _known(name) and (m := _META.search(data[:4096])):
        name = m[1].decode().lower()
        name = "utf-8" if name.startswith("utf-16") else name  # a page whose meta element can be read is not of two bytes
    return (name, 0) if _known(name) else ("utf-8", 0)


def _known(name: str) -> bool:
    try:
        return bool(name) and b"a".decode(name, "replace") is not None
    except (LookupError, ValueError):
        return False


def decoded(kind: str, data: bytes) -> str:
    name, mark = charset_of(kind, data)
    try:
        return data[mark:].decode(name, "replace")
    except ValueError:  # codecs that know no replacement
        return data.decode("utf-8", "replace")


def body_text(headers: list[tuple[str, str]], entity: bytes) -> tuple[str, list[str]]:
    """The text and the links of a body; NotReadable if it has none."""
    for coding in reversed(_values(headers, "content-encoding")):
        entity = undo(coding, entity)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    media = kind.split(";")[0].strip().lower()
    if _MARKUP.fullmatch(media):
        return text_and_links(decoded(kind, entity))
    if _TEXTUAL.fullmatch(media):
        return decoded(kind, entity).replace("\r\n", "\n").replace("\r", "\n"), []
    if media:
        raise NotReadable(f"type {media} is no text")
    if b"\0" in entity[:4096] and not entity.startswith(tuple(mark for mark, _ in _MARKS)):
        raise NotReadable("a body without a type holds zero bytes")
    return text_and_links(decoded(kind, entity))


def _lines(headers: str | None) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in (headers or "").split("\n")) if k.strip()]


def derive_one(key: int | None, source_id: str, target: str | None, date: str | None, payload: str | None, block_digest: str | None, headers: str | None, block: bytes | None) -> list[tuple]:
    """The metadata record of one response and, if its body has text, the conversion record."""
    block = block or b""
    status, http, body = parse_http(block)
    entity, text, links, lack = body, "", [], ""
    try:
        entity = entity_of(http, body)
        text, links = body_text(http, entity)
    except NotReadable as e:
        lack = str(e)
    payload, block_digest = payload or digest(entity), block_digest or digest(block)
    plain = text.encode("utf-8", "replace")
    fields = [("source-record-id", source_id), ("source-block-digest", block_digest), ("source-payload-digest", payload), ("source-status", status)]
    fields += [(f"source-header-{k.lower()}", v) for k, v in http] + [(f"source-{k.lower()}", v) for k, v in _lines(headers)]
    fields += [("text-absent", lack)] if lack else [("text-length", str(len(plain))), ("text-digest", digest(plain))]
    fields += [("outlink", " ".join(x.split())) for x in links]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    source = "\n".join(f"{k}: {' '.join(v.split())}" for k, v in (("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)) if v is not None) or None
    found = [(key, record_id("metadata", source_id), "metadata", target, date, source_id, "application/warc-fields", digest(about), payload, source, about)]
    if not lack:
        found.append((key, record_id("conversion", source_id), "conversion", target, date, source_id, "text/plain; charset=utf-8", digest(plain), payload, source, plain))
    return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _KINDS)], names=_NAMES)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages: each page's bytes behind an HTTP head."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.md5(F.concat_ws("\u0001", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(url_col), F.lit("-")), F.md5(body)))
    as_uuid = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    none = F.lit(None).cast("string")
    return pages.select(
        F.col(id_col).cast("long").alias("key"), as_uuid.alias("record_id"), F.lit("response").alias("warc_type"), F.col(url_col).cast("string").alias("target_uri"), F.lit(date).alias("warc_date"),
        none.alias("refers_to"), F.lit("application/http; msgtype=response").alias("content_type"), none.alias("block_digest"), none.alias("payload_digest"), none.alias("headers"), F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


def derive(records: DataFrame) -> DataFrame:
    """A metadata record, and a conversion record if there is text, for each response record of records (columns of RECORD)."""

    def derive_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for args in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                rows += derive_one(*args)
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    wanted = records.where(F.col("warc_type") == "response").select("key", "record_id", "target_uri", "warc_date", "payload_digest", "block_digest", "headers", "block")
    return wanted.mapInArrow(derive_batches, RECORD)


def serialise(record: tuple) -> bytes:
    """One record as WARC bytes, without compression."""
    _, rid, kind, target, date, refers, content, block_digest, payload, *headers, block = record
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", refers), ("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload)]
    head += [x for h in headers for x in _lines(h)] + [("Content-Type", content), ("Content-Length", str(len(block or b"")))]
    return VERSION + b"\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + (block or b"") + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of a WARC stream, as tuples of RECORD with a null key."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record begins with its version, not {line[:20]!r}")
        lines: list[list[str]] = []
        while (line := stream.readline()).strip() or not line:
            if not line:
                raise ValueError("a WARC file ends within a record's head")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if line[:1] in b" \t" and lines:  # a value that goes on
                lines[-1][1] += " " + line.decode("utf-8", "replace").strip()
            else:
                lines.append([name.strip(), value.strip()])
        head = {k.lower(): v for k, v in lines}
        size = int(head.get("content-length", -1))
        if size < 0:
            raise ValueError("a WARC record has no length, or a negative one")
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"a WARC record of {size} bytes ends after {len(block)}")
        get = head.get
        more = "\n".join(f"{k}: {v}" for k, v in lines if k.lower() not in _OWN) or None
        yield None, get("warc-record-id"), get("warc-type"), get("warc-target-uri"), get("warc-date"), get("warc-refers-to"), get("content-type"), get("warc-block-digest"), get("warc-payload-digest"), more, block


def write_warc(records: DataFrame, out: str, compress: bool = True) -> DataFrame:
    """One file for each partition under out; returns (path, records), of which only the named files count."""

    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_uri(out)
        ctx, n = TaskContext.get(), 0
        path = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc" + ".gz" * compress
        with fs.open_output_stream(path, compression=None) as sink:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                    data = serialise(row)
                    sink.write(gzip.compress(data, 6, mtime=0) if compress else data)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return records.select(_NAMES).mapInArrow(write_batches, "path string, records long")


def read_warc(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The records of WARC files, plain or gzip, one task a file; key is null."""
    files = [paths] if isinstance(paths, str) else paths

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_uri(path)
                with fs.open_input_stream(name, compression=None) as raw:
                    stream = _Members(raw) if name.endswith(".gz") else raw
                    rows: list[tuple] = []
                    size = 0
                    for row in parse(io.BufferedReader(stream, 1 << 20) if isinstance(stream, io.RawIOBase) else _Lines(stream)):
                        rows.append(row)
                        size += len(row[-1])
                        if size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return listed.repartition(max(1, len(files))).mapInArrow(read_batches, RECORD)


class _Members(io.RawIOBase):
    """The bytes of a file of gzip members, read as a stream."""

    def __init__(self, raw):
        self._raw, self._z, self._left, self._within = raw, zlib.decompressobj(31), b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data = self._left or self._raw.read(1 << 16)
            if not data and self._within:
                raise ValueError("a gzip member of a WARC file has no end")
            if not data:
                return 0
            got = self._z.decompress(data, len(buffer))
            self._left = self._z.unconsumed_tail or self._z.unused_data
            self._within = not self._z.eof
            if self._z.eof:
                self._z = zlib.decompressobj(31)
            if got:
                buffer[: len(got)] = got
                return len(got)


class _Raw(io.RawIOBase):
    def __init__(self, source):
        self._source = source

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self._source.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def _Lines(source) -> io.BufferedReader:  # noqa: N802
    return io.BufferedReader(_Raw(source), 1 << 20)
