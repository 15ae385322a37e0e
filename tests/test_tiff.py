"""TIFF files of every layout that is read, written here by plain code, against the arrays they were made from."""

import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.sources import raster as rsrc
from lumenlake.sources import tiff


def pack_bits(data):
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            while n < 128 and at + n < len(data) and data[at + n] != data[at + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out)


def pack_lzw(data):
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, width, now = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        one = bytes([b])
        if now + one in table:
            now += one
            continue
        put(table[now], width)
        table[now + one] = len(table) + 2
        n = len(table) + 2
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n >= 4095:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        now = one
    if now:
        put(table[now], width)
        n = len(table) + 3
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def predicted(chunk, predictor):
    if predictor == 2:
        return np.concatenate([chunk[:, :1], np.diff(chunk, axis=1)], 1).astype(chunk.dtype).tobytes()
    if predictor == 3:
        rows, wide, s = chunk.shape
        split = chunk.astype(chunk.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, wide * s, -1).transpose(0, 2, 1).reshape(rows, -1, s)
        return np.concatenate([split[:, :1], np.diff(split, axis=1)], 1).astype(np.uint8).tobytes()
    return chunk.tobytes()


def make(images, compression=1, predictor=1, tile=None, planar=False, order="<", big=False, rows=7):
    offset, count, word, size = ("Q", "Q", 8, 20) if big else ("I", "H", 4, 12)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for image in images:
        data = (image if image.ndim == 3 else image[:, :, None]).astype(image.dtype.newbyteorder(order))
        h, w, s = data.shape
        places, lengths = [], []
        for plane in [data[:, :, k : k + 1] for k in range(s)] if planar else [data]:
            for y in range(0, h, tile or rows):
                for x in range(0, w, tile or w):
                    chunk = plane[y : y + (tile or rows), x : x + (tile or w)]
                    if tile:
                        chunk = np.pad(chunk, ((0, tile - chunk.shape[0]), (0, tile - chunk.shape[1]), (0, 0)))
                    raw = PACK[compression](predicted(chunk, predictor))
                    places.append(len(out))
                    lengths.append(len(raw))
                    out += raw
        kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
        wide = (16, "Q") if big else (4, "I")
        tags = [(256, 4, "I", [w]), (257, 4, "I", [h]), (258, 3, "H", [data.itemsize * 8] * s), (259, 3, "H", [compression]), (277, 3, "H", [s]), (284, 3, "H", [2 if planar else 1]), (317, 3, "H", [predictor]), (339, 3, "H", [kind] * s)]
        tags += [(322, 4, "I", [tile]), (323, 4, "I", [tile]), (324, *wide, places), (325, *wide, lengths)] if tile else [(273, *wide, places), (278, 4, "I", [rows]), (279, *wide, lengths)]
        at = len(out)
        out[link : link + word] = struct.pack(order + offset, at)
        extra_at, entries, extra = at + struct.calcsize(order + count) + size * len(tags) + word, b"", b""
        for tag, code, fmt, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{fmt}", *values)
            place = raw.ljust(word, b"\0")
            if len(raw) > word:
                place, extra = struct.pack(order + offset, extra_at + len(extra)), extra + raw
            entries += struct.pack(order + "HH" + offset, tag, code, len(values)) + place
        out += struct.pack(order + count, len(tags)) + entries
        link = len(out)
        out += struct.pack(order + offset, 0) + extra
    return bytes(out)


@pytest.mark.parametrize("compression", PACK)
@pytest.mark.parametrize("layout", [{}, {"tile": 16}, {"planar": True}, {"tile": 16, "planar": True, "big": True}, {"big": True, "order": ">"}, {"order": ">", "tile": 32}])
@pytest.mark.parametrize("predictor", [1, 2])
def test_layouts(compression, layout, predictor):
    rng = np.random.default_rng(compression)
    images = [(rng.integers(0, 40, (37, 53, 3)) * 3).astype(dtype) for dtype in (np.uint8, np.uint16, np.int32)]
    source = io.BytesIO(make(images, compression, predictor, **layout))
    found = list(tiff.pages(source))
    assert len(found) == 3
    for page, image in zip(found, images):
        assert (tiff.read_rows(source, page, 0, 37) == image).all() and (tiff.read_rows(source, page, 11, 23) == image[11:23]).all()
        assert tiff.read_rows(source, page, 5, 5).shape == (0, 53, 3)


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
@pytest.mark.parametrize("tile", [None, 16])
def test_float_predictor(dtype, tile):
    image = np.random.default_rng(1).normal(size=(30, 41, 2)).astype(dtype)
    source = io.BytesIO(make([image], 8, 3, tile))
    assert (tiff.read_rows(source, next(tiff.pages(source)), 3, 29) == image[3:29]).all()


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"ab", b"c" * 90, b"xyz"]), max_size=400).map(b"".join)))
def test_unpacking(data):
    assert tiff.unpack_bits(pack_bits(data)) == data and tiff.unpack_lzw(pack_lzw(data)) == data


def test_long_lzw_table_is_cleared():
    data = np.random.default_rng(3).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(pack_lzw(data)) == data


def test_what_is_not_read_is_named(spark, tmp_path):
    raw = bytearray(make([np.zeros((4, 4), np.uint8)]))
    at = raw.index(struct.pack("<HHII", 259, 3, 1, 1))
    raw[at + 8 : at + 10] = struct.pack("<H", 7)
    source = io.BytesIO(bytes(raw))
    with pytest.raises(ValueError, match="JPEG"):
        tiff.read_rows(source, next(tiff.pages(source)), 0, 4)
    with pytest.raises(ValueError, match="czi"):
        rsrc.listed(str(tmp_path / "a.czi"))
    short = io.BytesIO(make([np.zeros((40, 40), np.uint8)], rows=40)[:500])
    with pytest.raises(Exception):
        list(tiff.read_rows(short, p, 0, 40) for p in tiff.pages(short))


def test_source_reads_compressed_tiles(spark, tmp_path):
    image = np.random.default_rng(5).integers(0, 60_000, (70, 90), dtype=np.uint16)
    (tmp_path / "a.tif").write_bytes(make([image, image[::-1]], 5, 2, 32, big=True))
    rsrc.register(spark)
    got = np.zeros((2, 70, 90))
    for r in rsrc.pixels(spark.read.format("raster").option("tile", 40).load(str(tmp_path / "a.tif"))).collect():
        got[r.ch_idx, r.y, r.x] = r.v
    assert (got == np.stack([image, image[::-1]])).all()


def test_images_are_written_strip_by_strip(spark, tmp_path):
    rows = [(g, y, x, (y * 7 + x) % 256, g, 3) for g in (1, 2) for y in range(150) for x in range(20) if (y // 64) != 1 or g == 2]
    df = spark.createDataFrame(rows, "g int, y int, x int, r int, g2 int, b int").withColumnRenamed("g", "image").withColumnRenamed("g2", "g")
    files = {r.path: r.pixels for r in rsrc.write_tiff(df, str(tmp_path), 160, 20, "image").collect()}
    assert sorted(files.values()) == [86 * 20, 150 * 20]
    for g in (1, 2):
        with open(tmp_path / f"{g}.tif", "rb") as source:
            image = tiff.read_rows(source, next(tiff.pages(source)), 0, 160)
        want = np.zeros((160, 20, 3), np.uint8)
        for i, y, x, r, gg, b in rows:
            if i == g:
                want[y, x] = r, gg, b
        assert (image == want).all()


def test_headers_of_large_files():
    before, after = tiff.header(100_000, 50_000, 1, np.dtype("<f4"), 64)
    head = io.BytesIO(before)
    assert struct.unpack("<HHHQ", before[2:16]) == (43, 8, 0, 16 + 100_000 * 50_000 * 4)
    assert len(after) > 1563 * 16 and head.read(2) == b"II"
