"""TIFF files planned by a Spark job: levels that files hold themselves, files that filters leave closed, settings of many images."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import raster as rs
from lumenlake.operators import roi as rg
from lumenlake.sources import raster, tiff


def with_copies(full, copies):
    """A classic TIFF of one page whose smaller copies are sub-directories, as bytes."""
    out = bytearray(b"II*\0\0\0\0\0")
    places = []
    for image in [*copies, full]:
        h, w = image.shape
        data_at = len(out)
        out += image.astype("<u2").tobytes()
        tags = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, 1), (273, 4, data_at), (277, 3, 1), (278, 4, h), (279, 4, 2 * h * w)]
        list_at = len(out)
        if image is full and copies:
            out += struct.pack(f"<{len(places)}I", *places)
            tags.append((330, 4, list_at if len(places) > 1 else places[0]))
        places.append(len(out))
        out += struct.pack("<H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack("<HHII", tag, kind, len(copies) if tag == 330 else 1, value)
        out += struct.pack("<I", 0)
    out[4:8] = struct.pack("<I", places[-1])
    return bytes(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(5)
    full = rng.integers(0, 60_000, (70, 90))
    (at / "a.tif").write_bytes(with_copies(full, [full[::4, ::4], full[::2, ::2]]))
    (at / "b.TIFF").write_bytes(with_copies(full[:33, :20], []))
    with open(at / "c.tif", "wb") as sink:
        tiff.write(sink, [full[:40, :41].astype(np.uint16), full[5:45, :41].astype(np.uint16)])
    (at / "notes.txt").write_text("no image")
    return at, full


def test_a_plan_has_every_image_channel_and_level(spark, folder):
    at, _ = folder
    rows = raster.planned(spark, str(at)).collect()
    found = sorted((r.image_id.rsplit("/", 1)[1], r.ch_idx, r.level, r.height, r.width, r.dtype) for r in rows)
    assert found == [("a.tif", 0, 0, 70, 90, "<u2"), ("a.tif", 0, 1, 35, 45, "<u2"), ("a.tif", 0, 2, 18, 23, "<u2"), ("b.TIFF", 0, 0, 33, 20, "<u2"), ("c.tif", 0, 0, 40, 41, "<u2"), ("c.tif", 1, 0, 40, 41, "<u2")]


def test_tiles_of_a_plan_hold_each_levels_samples(spark, folder):
    at, full = folder
    plan = raster.planned(spark, str(at))
    wanted = {("a.tif", 0, 0): full, ("a.tif", 0, 1): full[::2, ::2], ("a.tif", 0, 2): full[::4, ::4], ("b.TIFF", 0, 0): full[:33, :20], ("c.tif", 0, 0): full[:40, :41], ("c.tif", 1, 0): full[5:45, :41]}
    for side in (16, 512):
        got = {k: np.full(v.shape, -1) for k, v in wanted.items()}
        for r in raster.tiles_of(plan, side).collect():
            part = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
            assert (r.y0, r.x0) == (r.ty * side, r.tx * side)
            got[r.image_id.rsplit("/", 1)[1], r.ch_idx, r.level][r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = part
        assert all((got[k] == wanted[k]).all() for k in wanted)


def test_tiles_of_a_plan_are_those_of_the_source(spark, folder):
    at, _ = folder
    raster.register(spark)
    cols = ["ch_idx", "ty", "tx", "y0", "x0", "h", "w", "dtype", "data"]
    one = raster.tiles_of(raster.planned(spark, f"{at}/c.tif"), 32).select(cols)
    two = spark.read.format("raster").option("tile", 32).load(f"{at}/c.tif").select(cols)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize("side, level", [(1, 2), (23, 2), (24, 1), (45, 1), (46, 0), (10_000, 0)])
def test_the_smallest_level_that_is_large_enough(spark, folder, side, level):
    at, _ = folder
    rows = raster.levels_for(raster.planned(spark, str(at)), side).collect()
    assert {(r.image_id.rsplit("/", 1)[1], r.ch_idx): r.level for r in rows} == {("a.tif", 0): level, ("b.TIFF", 0): 0, ("c.tif", 0): 0, ("c.tif", 1): 0}


def test_many_files_and_files_that_a_filter_leaves_out(spark, folder, tmp_path):
    for i in range(300):
        (tmp_path / f"{i:03}.tif").write_bytes(with_copies(np.full((3, 4), i), []))
    plan = raster.planned(spark, str(tmp_path))
    assert plan.count() == 300
    for i in range(0, 300, 3):
        (tmp_path / f"{i:03}.tif").write_bytes(b"gone")  # read again it would be an error
    number = F.regexp_extract("image_id", r"(\d+)\.tif$", 1).cast("int")
    got = raster.pixels(raster.tiles_of(plan.where(number % 3 == 1))).groupBy("image_id").agg(F.sum("v").alias("s")).collect()
    assert sorted(r.s for r in got) == [12.0 * i for i in range(1, 300, 3)]


def test_what_is_no_tiff_is_named_and_an_empty_folder_is_empty(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "readme.md").write_text("-")
    empty = raster.planned(spark, str(tmp_path / "x"))
    assert empty.count() == 0 and raster.tiles_of(empty).count() == 0
    (tmp_path / "x" / "scan.czi").write_bytes(b"ZISRAWFILE" + bytes(60))
    with pytest.raises(Exception, match="scan.czi: not a TIFF file"):
        raster.planned(spark, str(tmp_path / "x"))


def test_one_directory_is_read_by_its_place(folder):
    at, full = folder
    source = io.BytesIO((at / "a.tif").read_bytes())
    page = next(tiff.pages(source))
    assert [tiff.page_at(source, p).height for p in page.smaller] == [18, 35] and tiff.page_at(source, page.place).width == 90
    assert not tiff.page_at(source, page.smaller[0]).smaller


def test_settings_and_regions_of_one_image_or_of_many(spark):
    cols = "image_id int, ch_idx int, visible boolean, min double, max double, brightness double, gamma double"
    a = spark.createDataFrame([(1, 0, True, 0.0, 9.0, 1.0, 1.0), (1, 1, True, 0.0, 9.0, 1.0, 1.0), (2, 0, True, 0.0, 9.0, 1.0, 1.0), (3, 0, True, 0.0, 9.0, 1.0, 1.0)], cols)
    b = spark.createDataFrame([(1, 0, True, 0.9, 9.0, 1.0, 1.0), (1, 1, True, 0.0, 9.0, 1.0, 1.06), (2, 0, True, 0.9, 9.9, 1.04, 1.0)], cols)
    assert {r.image_id: r.changed for r in rs.params_changed(a, b, ["image_id"]).collect()} == {1: True, 2: False, 3: True}
    one = rs.params_changed(a.where("image_id = 2"), b.where("image_id = 2")).collect()
    assert [tuple(r) for r in one] == [(False,)]
    hashes = {r.image_id: r.params_hash for r in rs.params_hash(a, ["image_id"]).collect()}
    assert hashes[2] == hashes[3] != hashes[1] and rs.params_hash(a.where("image_id = 3")).first()[0] == hashes[3]
    drawn = spark.createDataFrame([(1, 1, None, 2.0, 3.0, 5.0, 6.0), (1, 2, "own", 0.5, 4.0, 1.0, 9.0), (2, 3, None, 1.0, 1.0, 2.0, 2.0)], "image_id int, seq int, name string, x1 double, y1 double, x2 double, y2 double")
    assert sorted(tuple(r) for r in rg.named(drawn, "seq", ["image_id"]).select("seq", "name").collect()) == [(1, "ROI-1"), (2, "own"), (3, "ROI-1")]
    assert sorted(r.name for r in rg.named(drawn, "seq").collect()) == ["ROI-1", "ROI-3", "own"]
    assert [r.seq for r in rg.without_last(drawn, "seq", ["image_id"]).collect()] == [1] and rg.without_last(drawn, "seq").count() == 2
    assert sorted(tuple(r) for r in rg.union_box(drawn, 2, 10, 100, ["image_id"]).collect()) == [(1, 6, 10, 1, 10), (2, 2, 4, 2, 4)]
    assert tuple(rg.union_box(drawn, 2, 10, 100).first()) == (2, 10, 1, 10)
