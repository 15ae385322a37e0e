"""Tile arrays, pyramids, settings joins: against the pixel operators and plain strides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import raster, stats, tiling

PARAMS = [(0, True, 10.0, 200.0, 1.0, 1.0, 0, 100, 255), (1, True, 0.0, 180.0, 1.1, 0.5, 0, 255, 0), (2, True, 5.0, 5.0, 1.0, 1.0, 255, 0, 0), (3, False, 0.0, 1.0, 1.0, 1.0, 9, 9, 9)]


def params(spark):
    return spark.createDataFrame(PARAMS, "ch_idx int, visible boolean, min double, max double, brightness double, gamma double, r int, g int, b int")


def images(spark, h, w, n=2):
    rng = np.random.default_rng(3)
    rows = [(f"i{k}", c, y, x, float(rng.integers(0, 256))) for k in range(n) for c in range(4) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id string, ch_idx int, y int, x int, v double")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_compositing_tiles_equals_compositing_pixels(spark):
    pixels = images(spark, 13, 21)
    tiles = tiling.tiles_of_pixels(pixels, 8)
    assert rows_of(tiling.pixels_of_tiles(tiles)) == rows_of(pixels)
    for mode, made in (("u8", raster.composite_u8(pixels, params(spark))), ("float", raster.composite_float(pixels, params(spark))), ("float_plain", raster.composite_float(pixels, params(spark), gamma=False))):
        got = tiling.pixels_of_tiles(tiling.composite_tiles(tiles, params(spark), mode), "r", "g", "b").select(made.columns)
        assert rows_of(got) == rows_of(made)
    assert rows_of(tiling.pixels_of_tiles(tiling.composite_tiles(tiles.limit(0), params(spark)), "r", "g", "b")) == []


def test_tiles_go_through_the_exchange_not_pixels(spark):
    rows = spark.createDataFrame([(y, [float(y + x) for x in range(500)]) for y in range(40)], "y int, a array<double>")
    tiles = tiling.rows_as_tiles(rows, "y", {0: "a", 1: "a", 2: "a"}, 500)
    made = tiling.composite_tiles(tiles, params(spark))
    made.collect()
    leaves = []

    def walk(node):
        if "ShuffleExchange" in node.getClass().getSimpleName():
            leaves.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())

    executed = made._jdf.queryExecution().executedPlan()
    walk(executed.executedPlan() if "AdaptiveSparkPlan" in executed.getClass().getSimpleName() else executed)
    assert leaves and max(leaves) <= 120


def test_settings_are_the_broadcast_side(spark):
    pixels = images(spark, 4, 4)
    for made in (stats.adjusted(pixels, params(spark)), raster.layers_float(pixels, params(spark)), raster.composite_u8(pixels, params(spark)), tiling.composite_tiles(tiling.tiles_of_pixels(pixels, 4), params(spark))):
        text = made._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in text and "BuildRight" in text and "BuildLeft" not in text


@pytest.mark.parametrize("h, w, side", [(37, 53, 8), (8, 8, 8), (1, 30, 4), (64, 5, 16)])
def test_pyramid_equals_strides(spark, tmp_path, h, w, side):
    pixels = images(spark, h, w).where("ch_idx < 2")
    made = tiling.Pyramid.write(tiling.tiles_of_pixels(pixels, side), str(tmp_path / "p"), h, w, side, block=2)
    top = made.tiles(0).sparkSession.read.parquet(made.path).agg(F.max("level")).first()[0]
    assert side << top >= max(h, w)
    for level in range(top + 1):
        step = 1 << level
        want = pixels.where(f"y % {step} = 0 and x % {step} = 0").selectExpr("image_id", "ch_idx", f"y div {step}", f"x div {step}", "v")
        assert rows_of(tiling.pixels_of_tiles(made.tiles(level))) == rows_of(want)
    for ds, (y1, y2, x1, x2) in ((1, (3, 20, 2, 40)), (2, (0, h, 0, w)), (3, (5, 31, 4, 50)), (6, (1, 36, 7, 50)), (4, (9, 9, 3, 3))):
        want = pixels.where(f"y >= {y1} and y < {y2} and x >= {x1} and x < {x2} and y % {ds} = 0 and x % {ds} = 0").selectExpr("image_id", "ch_idx", f"y div {ds}", f"x div {ds}", "v")
        assert rows_of(made.view(y1, y2, x1, x2, ds, side, block=2)) == rows_of(want)


def test_a_viewport_reads_its_own_folders(spark, tmp_path):
    side, block = 8, 2
    pixels = images(spark, 128, 128, 1).where("ch_idx = 0")
    made = tiling.Pyramid.write(tiling.tiles_of_pixels(pixels, side), str(tmp_path / "p"), 128, 128, side, block)
    seen = made.view(20, 30, 40, 47, 1, side, block)
    assert seen.count() == 70
    scans = []

    def walk(node):
        if "Scan" in node.getClass().getSimpleName() and node.metrics().contains("numFiles"):
            scans.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    seen = made.view(20, 30, 40, 47, 1, side, block)
    seen.collect()
    executed = seen._jdf.queryExecution().executedPlan()
    walk(executed.executedPlan() if "AdaptiveSparkPlan" in executed.getClass().getSimpleName() else executed)
    whole = len({r[0] for r in spark.read.parquet(made.path).select(F.input_file_name()).collect()})
    assert scans == [1] and whole > 64  # tiles 2 and 3 by 5: one block of 8 by 8


def test_regrouped_strips(spark):
    rows = spark.createDataFrame([(y, [float(100 * y + x) for x in range(10)]) for y in range(23)], "y int, a array<double>")
    tiles = tiling.regrouped(tiling.rows_as_tiles(rows, "y", {0: "a", 5: "transform(a, v -> -v)"}, 10), 10)
    assert tiles.count() == 6 and sorted({(r.ty, r.h, r.w) for r in tiles.collect()}) == [(0, 10, 10), (1, 10, 10), (2, 3, 10)]
    assert rows_of(tiling.pixels_of_tiles(tiles).where("ch_idx = 5")) == sorted((5, y, x, -float(100 * y + x)) for y in range(23) for x in range(10))
    with pytest.raises(ValueError):
        tiling.Pyramid.write(tiles, "/tmp/none", 23, 10, 5)
