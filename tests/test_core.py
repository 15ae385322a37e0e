"""Unit tests of single operators on small rasters: regions, display, quantification, phenotypes, annotations, files."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import display, text
from lumenlake.operators import annotations as an
from lumenlake.operators import cluster, labels, phenotype, quantify, raster, roi, spatial
from lumenlake.sources import raster as rsrc
from lumenlake.sources import tables, tiff

ROI = "name string, roi_type string, x1 double, y1 double, x2 double, y2 double, points array<struct<x:double,y:double>>"


def grid(spark, h, w):
    return spark.range(h * w).selectExpr(f"cast(id div {w} as int) as y", f"cast(id % {w} as int) as x")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def held(spark, kind, box, points=(), size=100, scale=1.0):
    r = frame(spark, [("r", kind, *map(float, box), [(float(x), float(y)) for x, y in points])], ROI)
    return {(p.y, p.x) for p in roi.members(grid(spark, size, size), r, size, size, scale).collect()}


def test_rect(spark):
    m = held(spark, "rect", (10, 20, 50, 60))
    assert (30, 30) in m and (0, 0) not in m and len(m) == 40 * 40


def test_circle(spark):
    m = held(spark, "circle", (20, 20, 80, 80))
    assert (50, 50) in m and (0, 0) not in m
    want = {(y, x) for y in range(100) for x in range(100) if ((x - 50) / 30) ** 2 + ((y - 50) / 30) ** 2 <= 1}
    assert m == want


def test_freehand(spark):
    m = held(spark, "freehand", (10, 10, 90, 90), [(10, 10), (90, 10), (90, 90), (10, 90)])
    assert (50, 50) in m and (5, 5) not in m and len(m) == 81 * 81
    assert not held(spark, "freehand", (1, 1, 5, 5), [(1, 1), (5, 5)])


def test_scale_grows(spark):
    assert len(held(spark, "rect", (10, 10, 20, 20))) < len(held(spark, "rect", (10, 10, 20, 20), size=200, scale=2.0))


def test_roi_partly_and_wholly_outside(spark):
    assert len(held(spark, "rect", (90, 90, 140, 140))) == 100
    assert not held(spark, "rect", (150, 150, 160, 160))


def test_empty_region_falls_back_to_its_box(spark):
    r = frame(spark, [("line", "freehand", 1.0, 1.0, 5.0, 5.0, [(1.0, 1.0), (5.0, 5.0)])], ROI)
    assert roi.members_or_box(grid(spark, 10, 10), r, 10, 10).count() == 16


def test_lut(spark):
    t = raster.lut(spark.range(1), 100, 5000, 1.0, 1.0, (255, 0, 0), 65535)
    assert t.count() == 65536
    assert raster.lut(spark.range(1), 100, 100, 1.0, 1.0, (255, 0, 0), 255).count() == 256
    rows = {r.level: r for r in raster.lut(spark.range(1), 0, 255, 1.0, 1.0, (255, 0, 0), 255).collect()}
    assert (rows[0].r, rows[255].r, rows[255].g) == (0, 255, 0)


@pytest.mark.parametrize("a, b, want", [(0, 128, 128), (255, 255, 255), (0, 0, 0), (100, 150, 192)])
def test_screen_blend(spark, a, b, want):
    assert spark.range(1).select(display.screen_u8(F.array(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))).alias("v")).first().v == want


def test_window_level_of_nan_and_empty_window(spark):
    df = frame(spark, [(float("nan"),), (5.0,), (None,)], "v double").select(display.window_level(F.col("v"), F.lit(5.0), F.lit(5.0), F.lit(1.0)).alias("n"))
    got = [r.n for r in df.collect()]
    assert math.isnan(got[0]) and got[1] == 0.0 and got[2] is None


def two_cells(spark):
    return grid(spark, 50, 50).selectExpr("y", "x", "case when y between 5 and 14 and x between 5 and 14 then 1 when y between 30 and 39 and x between 30 and 39 then 2 else 0 end as cell_id", "cast((y * 7 + x * 3) % 50 as double) as v")


def test_two_cells(spark):
    got = {r.cell_id: r for r in quantify.quantify_cells(two_cells(spark), {"ch1": "v"}).collect()}
    assert {k: r.area for k, r in got.items()} == {1: 100, 2: 100}
    v = np.array([[(y * 7 + x * 3) % 50 for x in range(5, 15)] for y in range(5, 15)], float)
    assert (got[1].mean_ch1, got[1].median_ch1, got[1].total_ch1) == (v.mean(), np.median(v), v.sum())


def test_empty_mask_keeps_the_schema(spark):
    cells = quantify.quantify_cells(two_cells(spark).where("cell_id > 9"), {"ch1": "v"})
    assert cells.count() == 0 and cells.columns == ["cell_id", "centroid_y", "centroid_x", "area", "mean_ch1", "median_ch1", "total_ch1"]


def test_region_keeps_absolute_centroids(spark):
    got = quantify.quantify_region(two_cells(spark), {"c": "v"}, 20, 50, 20, 50).collect()
    assert len(got) == 1 and got[0].centroid_y == 34.5


def test_areas_sum_to_labelled_pixels(spark):
    px = two_cells(spark)
    assert quantify.quantify_cells(px, {"c": "v"}).agg(F.sum("area")).first()[0] == px.where("cell_id > 0").count()


def test_cell_csv(spark, tmp_path):
    tables.write_csv(quantify.quantify_cells(two_cells(spark), {"ch1": "v"}), str(tmp_path / "c"), {"mean_ch1": "%.4f"}, one_file=True)
    lines = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert len(lines) == 3 and "cell_id" in lines[0]


CELLS = [(1, 10.0), (2, 50.0), (3, 30.0), (4, 5.0), (5, float("nan")), (6, None), (7, float("inf"))]


def test_positivity(spark):
    cells = frame(spark, CELLS, "cell_id int, mean_CD3 double")
    got = [r.cell_id for r in cells.where(phenotype.is_positive(F.col("mean_CD3"), 25.0)).collect()]
    assert got == [2, 3, 7]


def test_phenotypes_and_names(spark):
    cells = frame(spark, [(1, 100.0, 5.0), (2, 10.0, 50.0)], "cell_id int, mean_A double, mean_B double")
    got = [r.phenotype for r in phenotype.assign_phenotypes(cells, {"A": 50.0, "B": 25.0}).orderBy("cell_id").collect()]
    assert got == ["A+ B−", "A− B+"]
    named = phenotype.assign_phenotypes(cells, {"A": 50.0, "B": 25.0}, ["B", "A"], {"A": "CD3"}).orderBy("cell_id").first()
    assert named.phenotype == "B− CD3+"


def test_counts_break_ties_by_first_cell(spark):
    df = frame(spark, [(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "cell_id int, phenotype string")
    assert [(r.phenotype, r.n) for r in phenotype.phenotype_counts(df).orderBy("rank").collect()] == [("b", 2), ("a", 2), ("c", 1)]


@pytest.mark.parametrize("method, want", [("median", 50.0), ("percentile", 90.0)])
def test_thresholds(spark, method, want):
    cells = frame(spark, [(i, 10.0 if i < 50 else 90.0) for i in range(100)], "cell_id int, mean_A double")
    assert phenotype.thresholds_by(cells, ["A"], method).first().threshold == want


def test_otsu_of_two_values_and_a_constant(spark):
    cells = frame(spark, [(i, 10.0 if i < 50 else 90.0, 7.0) for i in range(100)], "cell_id int, mean_A double, mean_B double")
    got = {r.marker: r.threshold for r in phenotype.thresholds_by(cells, ["A", "B", "C"], "otsu").collect()}
    assert 10 <= got["A"] < 90 and got["B"] == 7.0 and got["C"] == 0.0


def test_neighbours_are_symmetric_and_match_numpy(spark):
    rng = np.random.default_rng(0)
    pts = np.round(rng.uniform(-20, 20, (120, 2)), 3)
    pts[7] = pts[8]  # two cells in one place are neighbours
    cells = frame(spark, [(i, float(y), float(x)) for i, (y, x) in enumerate(pts)], "cell_id int, y double, x double")
    got = {(r.src, r.dst) for r in spatial.radius_join(cells, 4.0).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    assert got == {(i, j) for i in range(120) for j in range(120) if i != j and d[i, j] <= 4.0}
    assert got == {(b, a) for a, b in got}


def test_nearest_of_is_exact(spark):
    rng = np.random.default_rng(1)
    pts = rng.uniform(0, 50, (60, 2))
    cells = frame(spark, [(i, float(y), float(x)) for i, (y, x) in enumerate(pts)], "cell_id int, y double, x double")
    got = spatial.nearest_of(cells, cells.selectExpr("cell_id as query_id", "y as qy", "x as qx"), 3, 0.5).collect()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    assert {(r.query_id, r["rank"], r.cell_id) for r in got} == {(i, k + 1, j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:3])}


def test_boundary_matches_numpy(spark):
    got = {(r.y, r.x) for r in labels.boundary(two_cells(spark)).collect()}
    assert len(got) == 2 * 36


def test_relabel_is_a_bijection(spark):
    df = frame(spark, [(i * 5 % 1000,) for i in range(400)], "cell_id int")
    pairs = labels.relabel_dense(df).distinct().collect()
    ids = sorted({r.cell_id for r in pairs} - {0})
    assert {r.cell_id: r.new_id for r in pairs} == {0: 0, **{c: i + 1 for i, c in enumerate(ids)}}


def test_segmenter_counts_components():
    image = np.zeros((20, 20))
    image[2:6, 2:6] = image[10:15, 3:9] = image[10:12, 12:18] = 9
    got = labels.threshold_segmenter(image)
    assert got.max() == 3 and (got > 0).sum() == 16 + 30 + 12


def test_gaussian_keeps_the_sum(spark):
    px = grid(spark, 12, 15).selectExpr("y", "x", "case when y = 0 and x = 3 then 1d else 0d end as v")
    assert abs(raster.gaussian(px, 1.0, 12, 15).agg(F.sum("v")).first()[0] - 1) < 1e-9


def test_ward_order_keeps_groups_together():
    pts = np.array([[0, 0], [10, 10], [0.1, 0], [10, 10.1], [0, 0.1]])
    order = cluster.ward_order(pts)
    assert sorted(order) == list(range(5)) and {tuple(sorted(order[:2])), tuple(sorted(order[:3]))} & {(1, 3), (0, 2, 4)}


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    planes = [rng.integers(0, 65535, (70, 90), dtype=np.uint16), rng.integers(0, 65535, (70, 90), dtype=np.uint16)]
    buf = io.BytesIO()
    tiff.write(buf, planes, "d", 5000.0)
    (tmp_path / "a.tif").write_bytes(buf.getvalue())
    page = next(tiff.pages(buf))
    assert (page.description, page.unit, page.x_resolution, page.dtype) == ("d", 3, 5000.0, np.dtype("<u2"))
    rsrc.register(spark)
    tiles = spark.read.format("raster").option("tile", 32).load(str(tmp_path / "a.tif"))
    for c, plane in enumerate(planes):
        got = np.zeros((70, 90))
        for r in rsrc.pixels(tiles.where(f"ch_idx = {c}")).collect():
            got[r.y, r.x] = r.v
        assert (got == plane).all()
    assert tiles.where("ch_idx = 1 and ty = 0").select("tx").count() == 3


def test_tiff_preview_level(spark, tmp_path):
    buf = io.BytesIO()
    tiff.write(buf, [np.arange(60 * 50, dtype=np.float32).reshape(60, 50)])
    (tmp_path / "b.tif").write_bytes(buf.getvalue())
    rsrc.register(spark)
    px = rsrc.pixels(spark.read.format("raster").option("level", "preview").option("maxdim", 20).option("tile", 8).load(str(tmp_path / "b.tif")))
    assert {(r.y, r.x): r.v for r in px.collect()} == {(y, x): float(y * 3 * 50 + x * 3) for y in range(20) for x in range(17)}


@pytest.mark.parametrize("shape, want", [((5, 6), ("none", 1)), ((3, 50, 60), ("first", 3)), ((500, 600, 4), ("last", 4)), ((300, 300, 300), ("plane", 1)), ((2, 3, 4, 5), ("plane", 1))])
def test_channel_axis(shape, want):
    assert rsrc.channel_axis(shape) == want


def test_merge_needs_equal_sizes(spark, tmp_path):
    for name, h in (("a", 5), ("b", 6)):
        with open(tmp_path / f"{name}.tif", "wb") as f:
            tiff.write(f, [np.zeros((h, 5), np.uint8)])
    rsrc.register(spark)
    with pytest.raises(ValueError):
        rsrc.merged_channels(spark, [str(tmp_path / "a.tif"), str(tmp_path / "b.tif")])


def test_version_and_session_errors(spark, tmp_path):
    from lumenlake.operators import session

    session.append_version(spark.range(2), str(tmp_path / "v"), "1")
    with pytest.raises(ValueError):
        session.restore_version(spark, str(tmp_path / "v"), "2")
    assert [r.version_id for r in session.versions(spark, str(tmp_path / "v")).collect()] == ["1"]


def test_read_json_of_bad_and_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "b.json").write_text('{"id": 3}')
    assert [r.id for r in tables.read_json(spark, str(tmp_path), "id bigint").collect()] == [3]
    assert tables.read_json(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_viewport_and_tiles():
    assert raster.viewport(1.0, (0, 0), (100, 100), (1000, 1000), (500, 500), 2) == (400, 600, 400, 600)
    assert raster.viewport(1.0, (0, 0), (5, 100), (10, 10), (10, 10), 1) is None
    assert raster.visible_tiles(0, 600, 0, 100, 5000, 5000) == (0, 2, 0, 1)
    assert raster.zoomed(0.011, -5) == 0.01


def test_unique_names_and_tail(spark):
    names = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "name string, o int")
    assert sorted(r.name for r in an.unique_names(names, "o").collect()) == ["a", "a (2)", "b"]
    assert spark.range(1).select(an.tail(F.array(F.lit(1), F.lit(2)), 50).alias("t")).first().t == [1, 2]


def test_pretty_time_of_no_time(spark):
    assert spark.range(1).select(text.pretty_time(F.lit("yesterday at about ten")).alias("t")).first().t == "yesterday at abo"


def test_running_counts(spark, tmp_path):
    from lumenlake.streaming.watch import running_counts, watch_cells

    frame(spark, [(1, 5.0), (2, 50.0), (3, 60.0)], "cell_id int, mean_A double").write.parquet(str(tmp_path / "in"))
    q = running_counts(watch_cells(spark, str(tmp_path / "in"), "cell_id int, mean_A double"), {"A": 10.0}).writeStream.outputMode("complete").format("memory").queryName("ph").start()
    q.processAllAvailable()
    q.stop()
    assert {r.phenotype: r.n for r in spark.table("ph").collect()} == {"A+": 2, "A−": 1}


def test_plans_push_down_and_prune(spark, data):
    px = spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_partkey as cell_id", "l_linenumber as y", "l_orderkey as x", "l_quantity as v")
    plan = quantify.quantify_region(px, {"c": "v"}, 2, 5, 0, 100)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_" in plan and "l_tax" not in plan.split("== Physical Plan ==")[1]
    joined = spatial.radius_join(px.selectExpr("x as cell_id", "v as y", "v as x"), 1.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def test_tile_cache():
    from lumenlake.operators.tiles import TileCache

    cache = TileCache(3)
    for k in range(4):
        cache.put(k, k * 10)
    assert len(cache) == 3 and cache.get(0) is None and cache.get(3) == 30
    cache.get(1)
    cache.put(9, 90)
    assert cache.get(1) == 10 and cache.get(2) is None
    cache.invalidate()
    assert len(cache) == 0


def test_pictures_have_red_first_and_no_alpha(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + b"".join(bytes((10 * x, 20 * y, 200, 255)) for x in range(3)) for y in range(2))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    got = {(r.ch_idx, r.y, r.x): r.v for r in rsrc.pictures(spark, str(tmp_path)).collect()}
    assert got == {(c, y, x): float((10 * x, 20 * y, 200)[c]) for c in range(3) for y in range(2) for x in range(3)}
