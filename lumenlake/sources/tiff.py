"""TIFF in NumPy: classic and BigTIFF; strips and tiles; uncompressed, deflate, LZW or PackBits, with or without a
horizontal predictor; samples side by side or in planes; integers and floats of 8 to 64 bits; one or more pages.

Other compressions (JPEG and JPEG 2000, as in most svs and ndpi files) raise an error that names them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Sizes and struct codes of field types.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTO, _DESCRIPTION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _XRES, _YRES, _PLANAR, _UNIT, _FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 282, 283, 284, 296, 339
_SUB_DIRECTORIES = 330
_PREDICTOR, _TILE_WIDTH, _TILE_LENGTH, _TILE_OFFSETS, _TILE_COUNTS = 317, 322, 323, 324, 325
_KINDS = {1: "u", 2: "i", 3: "f"}
# Compressions.
_NONE, _LZW, _DEFLATE, _PACKBITS = (1,), (5,), (8, 32946), (32773,)
_UNREAD = {6: "old JPEG", 7: "JPEG", 33003: "JPEG 2000", 33005: "JPEG 2000", 34712: "JPEG 2000", 34887: "LERC", 34925: "LZMA", 50000: "ZSTD", 50001: "WebP"}


@dataclass
class Page:
    """A page's shape, sample type and the chunks (strips or tiles) that it is stored in, row by row, plane by plane."""

    height: int
    width: int
    samples: int
    dtype: np.dtype
    chunk_height: int
    chunk_width: int
    offsets: list[int]
    counts: list[int]
    compression: int
    predictor: int = 1
    planar: bool = False
    description: str = ""
    x_resolution: float = 0.0
    unit: int = 1
    tags: dict = field(default_factory=dict)
    place: int = 0

    @property
    def smaller(self) -> list[int]:
        """Places of the directories of the page's smaller copies."""
        return [int(x) for x in self.tags.get(_SUB_DIRECTORIES, []) if x]


@dataclass
class _Layout:
    """Byte order of a file, and what its directories are made of: size of an entry, codes of counts and of offsets."""

    order: str
    entry: int
    number: str
    offset: str
    first: int


def _layout(source) -> _Layout:
    source.seek(0)
    head = source.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    entry, number, offset = (20, "Q", "Q") if big else (12, "H", "I")
    return _Layout(order, entry, number, offset, struct.unpack_from(order + offset, head, 8 if big else 4)[0])


def pages(source) -> Iterator[Page]:
    """Pages of an open binary file, read from its directories alone."""
    layout = _layout(source)
    at, seen = layout.first, set()
    while at and at not in seen:
        seen.add(at)
        page, at = _directory(source, layout, at)
        yield page


def page_at(source, place: int) -> Page:
    """The page whose directory lies at a place of the file: one directory is read."""
    return _directory(source, _layout(source), place)[0]


def _directory(source, layout: _Layout, place: int) -> tuple[Page, int]:
    """The page of a directory and the place of the next one."""
    order, entry, number, offset = layout.order, layout.entry, layout.number, layout.offset
    word = struct.calcsize(order + offset)
    source.seek(place)
    (n,) = struct.unpack(order + number, source.read(struct.calcsize(order + number)))
    entries = source.read(entry * n)
    (following,) = struct.unpack(order + offset, source.read(word))
    tags: dict[int, list] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + offset, entries, entry * k)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        raw = entries[entry * (k + 1) - word : entry * (k + 1)]
        if size * count > word:
            source.seek(struct.unpack(order + offset, raw)[0])
            raw = source.read(size * count)
        if code == "s":
            tags[tag] = [raw[:count].rstrip(b"\0").decode("utf-8", "replace")]
        elif code == "II":
            pairs = struct.unpack(order + f"{2 * count}I", raw[: 8 * count])
            tags[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        else:
            tags[tag] = list(struct.unpack(order + f"{count}{code}", raw[: size * count]))
    one = lambda t, default: tags.get(t, [default])[0]
    bits = one(_BITS, 8)
    if bits % 8:
        raise ValueError(f"TIFF samples of {bits} bits are not read")
    dtype = np.dtype(f"{order}{_KINDS.get(one(_FORMAT, 1), 'u')}{bits // 8}")
    h, w = one(_LENGTH, 0), one(_WIDTH, 0)
    tiled = _TILE_OFFSETS in tags
    shape = (one(_TILE_LENGTH, h), one(_TILE_WIDTH, w)) if tiled else (min(one(_ROWS, h), h) or h, w)
    places = (tags.get(_TILE_OFFSETS, []), tags.get(_TILE_COUNTS, [])) if tiled else (tags.get(_OFFSETS, []), tags.get(_COUNTS, []))
    page = Page(h, w, one(_SAMPLES, 1), dtype, *shape, *places, one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1) == 2, one(_DESCRIPTION, ""), one(_XRES, 0.0), one(_UNIT, 1), tags, place)
    return page, following


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count, then so many bytes as they are, or one byte to be repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits, high bits first, which widen one code early; 256 clears, 257 ends."""
    out, table, width, held, bits, before = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before:
            table.append(before + now[:1])
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        before = now
    return b"".join(out)


def _chunk(source, page: Page, k: int, rows: int, samples: int) -> np.ndarray:
    """The k-th chunk as (rows, chunk_width, samples)."""
    source.seek(page.offsets[k])
    data = source.read(page.counts[k] if page.counts else rows * page.chunk_width * samples * page.dtype.itemsize)
    if page.compression in _DEFLATE:
        data = zlib.decompress(data)
    elif page.compression in _LZW:
        data = unpack_lzw(data)
    elif page.compression in _PACKBITS:
        data = unpack_bits(data)
    elif page.compression not in _NONE:
        raise ValueError(f"TIFF compression {page.compression} ({_UNREAD.get(page.compression, 'unknown')}) is not read; store deflate, LZW, PackBits or none")
    n = rows * page.chunk_width * samples
    if len(data) < n * page.dtype.itemsize:
        raise ValueError("a TIFF strip or tile is shorter than its rows")
    if page.predictor == 3:  # bytes of floats apart, most significant first, each less the one before it
        row = np.frombuffer(data, np.uint8, n * page.dtype.itemsize).reshape(rows, -1)
        row = np.cumsum(row.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, page.dtype.itemsize, -1)
        return np.ascontiguousarray(row.transpose(0, 2, 1)).view(page.dtype.newbyteorder(">")).astype(page.dtype).reshape(rows, page.chunk_width, samples)
    values = np.frombuffer(data, page.dtype, n).reshape(rows, page.chunk_width, samples)
    if page.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=page.dtype.newbyteorder("=")).astype(page.dtype)
    return values


def read_rows(source, page: Page, y1: int, y2: int) -> np.ndarray:
    """Rows y1 to y2 of a page, (rows, width, samples): only the chunks that hold them are read."""
    high, wide = page.chunk_height or 1, page.chunk_width or 1
    down, across = -(-page.height // high), -(-page.width // wide)
    tiled = _TILE_OFFSETS in page.tags
    out = np.zeros((max(0, y2 - y1), page.width, page.samples), page.dtype)
    for plane in range(page.samples if page.planar else 1):
        part = slice(plane, plane + 1) if page.planar else slice(None)
        for i in range(y1 // high, (y2 - 1) // high + 1 if y2 > y1 else 0):
            rows = high if tiled else min(high, page.height - i * high)
            a, b = max(y1, i * high), min(y2, i * high + rows)
            for j in range(across):
                got = _chunk(source, page, (plane * down + i) * across + j, rows, 1 if page.planar else page.samples)
                x2 = min(page.width, (j + 1) * wide)
                out[a - y1 : b - y1, j * wide : x2, part] = got[a - i * high : b - i * high, : x2 - j * wide]
    return out


def header(h: int, w: int, samples: int, dtype: np.dtype, rows_per_strip: int) -> tuple[bytes, bytes]:
    """What stands before and after the rows of one uncompressed image, so that they can be written as they come."""
    row = w * samples * dtype.itemsize
    big = h * row > (1 << 32) - (1 << 20)
    first = 16 if big else 8
    strips = [min(rows_per_strip, h - y) for y in range(0, h, rows_per_strip)]
    offsets = [first + y * row for y in range(0, h, rows_per_strip)]
    wide = 16 if big else 4
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: list[tuple[int, int, list]] = [(_WIDTH, 4, [w]), (_LENGTH, 4, [h]), (_BITS, 3, [dtype.itemsize * 8] * samples), (_COMPRESSION, 3, [1]), (_PHOTO, 3, [2 if samples == 3 else 1]), (_OFFSETS, wide, offsets)]
    tags += [(_SAMPLES, 3, [samples]), (_ROWS, 4, [rows_per_strip]), (_COUNTS, wide, [n * row for n in strips]), (_PLANAR, 3, [1]), (_FORMAT, 3, [kind] * samples)]
    at = first + h * row
    at += pad if (pad := at % 2) else 0
    count, offset, size = ("<Q", "<Q", 20) if big else ("<H", "<I", 12)
    word = struct.calcsize(offset)
    extra_at = at + struct.calcsize(count) + size * len(tags) + word
    entries, extra = b"", b""
    for tag, k, values in tags:
        raw = struct.pack(f"<{len(values)}{_TYPES[k][1]}", *values)
        place = raw.ljust(word, b"\0")
        if len(raw) > word:
            place = struct.pack(offset, extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HH" + offset[1], tag, k, len(values)) + place
    before = b"II" + (struct.pack("<HHHQ", 43, 8, 0, at) if big else struct.pack("<HI", 42, at))
    return before, b"\0" * pad + struct.pack(count, len(tags)) + entries + struct.pack(offset, 0) + extra


def write(sink, planes: list[np.ndarray], description: str = "", pixels_per_cm: float = 0.0, rows_per_strip: int = 64) -> None:
    """Planes of (h, w) or (h, w, 3), one page each."""
    parts, at = [b"II*\0", b""], 8
    directories = []
    for plane in planes:
        data = np.ascontiguousarray(plane if plane.ndim == 3 else plane[:, :, None])
        data = data.astype(data.dtype.newbyteorder("<"))
        h, w, s = data.shape
        strips = [data[y : y + rows_per_strip].tobytes() for y in range(0, h, rows_per_strip)]
        offsets = []
        for strip in strips:
            offsets.append(at)
            parts.append(strip + b"\0" * (len(strip) % 2))
            at += len(parts[-1])
        kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
        bits = data.dtype.itemsize * 8
        tags: list[tuple[int, int, list]] = [(_WIDTH, 4, [w]), (_LENGTH, 4, [h]), (_BITS, 3, [bits] * s), (_COMPRESSION, 3, [1]), (_PHOTO, 3, [2 if s == 3 else 1])]
        if description:
            tags.append((_DESCRIPTION, 2, [description]))
        tags += [(_OFFSETS, 4, offsets), (_SAMPLES, 3, [s]), (_ROWS, 4, [rows_per_strip]), (_COUNTS, 4, [len(x) for x in strips])]
        if pixels_per_cm:
            tags += [(_XRES, 5, [pixels_per_cm]), (_YRES, 5, [pixels_per_cm])]
        tags.append((_PLANAR, 3, [1]))
        if pixels_per_cm:
            tags.append((_UNIT, 3, [3]))
        tags.append((_FORMAT, 3, [kind] * s))
        directories.append(tags)
    blocks = []
    for d, tags in enumerate(directories):
        start, extra_at = at, at + 2 + 12 * len(tags) + 4
        entries, extra = b"", b""
        for tag, kind, values in tags:
            size, code = _TYPES[kind]
            if kind == 2:
                raw = values[0].encode() + b"\0"
                count = len(raw)
            elif kind == 5:
                raw, count = b"".join(struct.pack("<II", int(v * 1000), 1000) for v in values), len(values)
            else:
                raw, count = struct.pack(f"<{len(values)}{code}", *values), len(values)
            if len(raw) <= 4:
                field_ = raw.ljust(4, b"\0")
            else:
                field_ = struct.pack("<I", extra_at + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            entries += struct.pack("<HHI", tag, kind, count) + field_
        size = 2 + len(entries) + 4 + len(extra)
        following = start + size if d + 1 < len(directories) else 0
        blocks.append((start, struct.pack("<H", len(tags)) + entries + struct.pack("<I", following) + extra))
        at += size
    parts[1] = struct.pack("<I", blocks[0][0] if blocks else 0)
    sink.write(b"".join([*parts, *(b for _, b in blocks)]))
