"""Outlines by runs, distances by passes, the curve index: against plain definitions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import labels, roi, spatial

ROIS = "name string, roi_type string, x1 double, y1 double, x2 double, y2 double, points array<struct<x:double,y:double>>"


def plane(spark, h, w):
    return spark.range(h * w).selectExpr(f"cast(id div {w} as int) as y", f"cast(id % {w} as int) as x")


def holds(points, x, y):
    """Even-odd rule in whole numbers; edges are inside."""
    odd = False
    if len(points) < 3:
        return False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and ((x - ax) * (by - ay) < (bx - ax) * (y - ay)) == (by > ay):
            odd = not odd
    return odd


def outlines():
    rng = random.Random(4)
    made = {f"r{n}_{k}": [(rng.randint(-5, 45), rng.randint(-5, 35)) for _ in range(n)] for n in (3, 4, 7, 15, 40) for k in range(3)}
    made |= {"two": [(0, 0), (30, 20)], "none": [], "flat": [(3, 5), (20, 5), (9, 5)], "tall": [(7, 2), (7, 25), (7, 9)], "twice": [(2, 2), (20, 2), (20, 20), (2, 20)] * 2, "eight": [(0, 0), (30, 20), (30, 0), (0, 20)], "point": [(4, 4)] * 3}
    return made


def test_outlines_equal_the_even_odd_rule(spark):
    made = outlines()
    rois = spark.createDataFrame([(n, "freehand", 0.0, 0.0, 0.0, 0.0, [(float(x), float(y)) for x, y in p]) for n, p in made.items()] * 2, ROIS)
    got = {(r.roi_name, r.y, r.x) for r in roi.members(plane(spark, 30, 40).withColumn("roi", F.lit(1)), rois, 30, 40).collect()}
    assert got == {(n, y, x) for n, p in made.items() for y in range(30) for x in range(40) if holds(p, x, y)}
    runs = roi.outline_spans(rois)
    assert runs.count() == runs.distinct().count() and runs.join(runs.withColumnsRenamed({"x1": "a", "x2": "b"}), ["roi_name", "y"]).where("a > x1 and a <= x2 + 1").count() == 0
    same = plane(spark, 30, 40).crossJoin(rois.distinct()).where(roi.in_polygon(F.transform("points", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"))), F.col("x"), F.col("y")))
    assert got == {(r.name, r.y, r.x) for r in same.collect()}


def test_scaled_outlines_and_boxes_of_empty_ones(spark):
    rois = spark.createDataFrame([("a", "freehand", 1.0, 1.0, 4.0, 3.0, [(1.6, 1.6), (9.9, 1.6), (9.9, 7.2), (1.6, 7.2)]), ("b", "freehand", 1.0, 1.0, 4.0, 3.0, [(1.0, 1.0), (2.0, 2.0)]), ("c", "rect", 0.0, 0.0, 2.0, 2.0, [])], ROIS)
    got = {(r.roi_name, r.y, r.x) for r in roi.members_or_box(plane(spark, 40, 40), rois, 40, 40, 2.0).collect()}
    want = {("a", y, x) for y in range(3, 15) for x in range(3, 20)} | {("b", y, x) for y in range(2, 6) for x in range(2, 8)} | {("c", y, x) for y in range(4) for x in range(4)}
    assert got == want


def test_an_outline_of_many_vertices_takes_linear_time(spark):
    n = 50_000
    left = [(float(10 + i % 3), float(i)) for i in range(n)]
    right = [(float(1000 + i % 5), float(i)) for i in reversed(range(n))]
    rois = spark.createDataFrame([("long", "freehand", 0.0, 0.0, 0.0, 0.0, left + right)], ROIS)
    began = time.perf_counter()
    pixels = spark.range(2_000_000).selectExpr("cast(id div 40 as int) as y", "cast((id % 40) * 30 as int) as x")
    got = roi.members(pixels, rois, n, 1200).agg(F.count("*"), F.sum("x")).first()
    y, x = np.arange(n)[:, None], (np.arange(40) * 30)[None, :]
    want = (x >= 10 + y % 3) & (x <= 1000 + y % 5)
    assert tuple(got) == (want.sum(), (want * x).sum())
    assert time.perf_counter() - began < 120  # every vertex against every pixel would be 2 * 10^11 tests


def grown(mask, steps):
    d = np.where(mask, 0, 10**6)
    y, x = np.nonzero(mask)
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    for a, b in zip(y, x):
        d = np.minimum(d, abs(yy - a) + abs(xx - b))
    return {(int(a), int(b), int(d[a, b])) for a, b in zip(*np.nonzero(d <= steps))}


@pytest.mark.parametrize("steps, tile", [(0, 4), (1, 4), (3, 8), (7, 4), (50, 16)])
def test_distances_equal_plain_ones(spark, steps, tile):
    rng = np.random.default_rng(steps)
    mask = rng.random((23, 31)) < 0.02
    rows = [("a", int(y), int(x)) for y, x in zip(*np.nonzero(mask))] + [("b", 0, 0), ("b", 99, 0), ("b", -1, 3)]
    got = labels.distances(spark.createDataFrame(rows, "image_id string, y int, x int"), 23, 31, steps, tile).collect()
    corner = np.zeros((23, 31), bool)
    corner[0, 0] = True
    assert {(r.y, r.x, r.d) for r in got if r.image_id == "a"} == grown(mask, steps) and {(r.y, r.x, r.d) for r in got if r.image_id == "b"} == grown(corner, steps)
    assert len(got) == len(set(got))


def test_thick_dilation_costs_what_a_thin_one_does(spark):
    pixels = spark.range(20_000).selectExpr("cast(id * 7919 % 1000 as int) as y", "cast(id * 104729 % 997 as int) as x").distinct()
    took = {}
    for steps in (2, 2, 50):
        began = time.perf_counter()
        labels.dilated(pixels, steps, 1000, 1000).count()
        took[steps] = time.perf_counter() - began
    assert took[50] < 5 * took[2] + 2  # diamonds of 5,101 pixels against 13


def points(spark, n=5000):
    rng = random.Random(6)
    rows = [(i, rng.gauss(0, 10), rng.uniform(-5, 90)) for i in range(n)] + [(n + i, 3.0, 3.0) for i in range(20)] + [(n + 50, None, 1.0), (n + 51, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "cell_id long, y double, x double")


def test_curve_index_equals_scans_and_reads_few_files(spark, tmp_path):
    cells = points(spark)
    index = spatial.CurveIndex.write(cells, str(tmp_path / "i"), 40)
    plain = cells.where("y is not null and not isnan(y)")
    for y, x, r in ((0.0, 20.0, 2.0), (3.0, 3.0, 0.0), (0.0, 0.0, 500.0), (400.0, 0.0, 3.0)):
        assert sorted(index.within(y, x, r).collect()) == sorted(spatial.within(plain, y, x, r).collect())
    for y, x, k in ((0.0, 20.0, 7), (3.0, 3.0, 25), (900.0, -900.0, 3), (0.0, 0.0, 6000), (1.0, 1.0, 0)):
        assert index.nearest(y, x, k).collect() == spatial.nearest(plain, y, x, k).collect()
    boxes = spark.read.parquet(f"{index.path}/boxes")
    assert boxes.agg(F.sum("n")).first()[0] == 5020 and boxes.count() > 20
    read = boxes.where(index._far(0.0, 20.0) <= 2.0).agg(F.sum("n")).first()[0]
    assert read < 5020 / 4  # rows that a small circle has scanned
    assert set(index.within(0.0, 20.0, 2.0).inputFiles()) < set(spark.read.parquet(f"{index.path}/cells").inputFiles())
    none = spatial.CurveIndex.write(cells.limit(0), str(tmp_path / "none"))
    assert none.within(0, 0, 1).count() == 0 and none.nearest(0, 0, 3).count() == 0
