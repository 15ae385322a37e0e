"""Operators that must not hold a whole table, group or image: against plain NumPy, with their limits set low."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import cluster, labels, ranking, raster, roi, spatial
from lumenlake.sources import scratch


@pytest.mark.parametrize("finish, bins", [(200_000, 4096), (20, 8), (1, 2)])
def test_quantiles_are_exact(spark, monkeypatch, finish, bins):
    monkeypatch.setattr(ranking, "FINISH", finish)
    monkeypatch.setattr(ranking, "BINS", bins)
    rng = np.random.default_rng(1)
    groups = {"even": rng.uniform(0, 1, 400), "ties": rng.integers(0, 3, 300).astype(float), "wide": np.exp(rng.uniform(-30, 30, 150)), "one": np.asarray([5.0]), "same": np.full(90, -2.5), "signs": rng.normal(size=101)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None), ("even", float("nan"))]
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.995, 1.0)
    got = {r.g: r.q for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], probs).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, probs).tolist())
    every = np.concatenate(list(groups.values()))
    assert ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), [], (0.5,)).first().q == pytest.approx([np.quantile(every, 0.5)])


def test_quantiles_with_infinite_ends(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FINISH", 2)
    inf = float("inf")
    vs = [-inf, inf, inf, *map(float, range(20))]
    got = ranking.quantiles(spark.createDataFrame([(v,) for v in vs], "v double"), [], (0.5,)).first().q
    assert got == [sorted(vs)[11]]


def test_numbers_of_a_total_order(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 500), rng.permutation(500))]
    got = ranking.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.desc("a"), F.col("b")], "n").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.n for r in got) == list(range(1, 501))


def test_a_tile_with_more_cells_than_ten_thousand(spark):
    h, w = 300, 160  # a chessboard: every second pixel is a cell of its own
    px = spark.range(h * w).selectExpr(f"cast(id div {w} as int) as y", f"cast(id % {w} as int) as x").selectExpr("y", "x", "cast((y + x) % 2 as double) as v")
    got = labels.segment_tiles(px, h, w, size=160, overlap=0, single_max=100, sliver=8).toPandas()
    assert len(got) == h * w // 2 == got["cell_id"].nunique() == got["cell_id"].max()


def test_objects_cut_by_a_seam_are_stitched(spark):
    h, w = 60, 100
    image = np.zeros((h, w))
    image[10:20, 5:95] = 9  # over all tiles
    image[30:34, 28:36] = 9  # over one seam
    image[50:55, 60:64] = 9
    px = spark.createDataFrame([(y, x, float(image[y, x])) for y in range(h) for x in range(w)], "y int, x int, v double")
    cut = lambda **k: labels.segment_tiles(px, h, w, size=40, overlap=10, single_max=50, sliver=8, **k).toPandas()
    plain, joined = cut(), cut(stitch=0.5)
    assert plain["cell_id"].nunique() > 3 and joined["cell_id"].nunique() == 3 and len(plain) == len(joined) == int((image > 0).sum())
    for y, x in ((10, 5), (30, 28), (50, 60)):
        own = joined[(joined.y == y) & (joined.x == x)]["cell_id"].iloc[0]
        assert set(map(tuple, joined[joined.cell_id == own][["y", "x"]].to_numpy())) == set(zip(*np.nonzero(labels.threshold_segmenter(image) == labels.threshold_segmenter(image)[y, x])))


def test_membrane_channel_reaches_the_segmenter(spark):
    px = spark.createDataFrame([(y, x, 1.0, float(x > 4)) for y in range(8) for x in range(10)], "y int, x int, v double, m double")
    got = labels.segment_tiles(px, 8, 10, lambda nuclear, membrane: ((nuclear > 0) & (membrane > 0)).astype(np.int32)).toPandas()
    assert len(got) == 40 and got["x"].min() == 5
    assert {"threshold", "cellpose", "mesmer"} == set(labels.available_segmenters()) and labels.available_segmenters()["threshold"]


def test_tiles_of_a_pixel_follow_from_its_place(spark):
    for h, w, size, overlap, sliver in ((270, 450, 102, 12, 6), (100, 97, 40, 10, 8), (64, 64, 64, 0, 1), (203, 130, 50, 40, 5)):
        grid = labels.tile_grid(spark, h, w, size, overlap, sliver).collect()
        px = spark.range(max(h, w)).selectExpr("cast(id as int) as p")
        rows, cols = (px.where(f"p < {n}").select("p", labels._tiles_of("p", n, size, overlap, sliver).alias("t")).collect() for n in (h, w))
        across = len({g.x1 for g in grid})
        ys = {r.p: {g.tile_idx // across for g in grid if g.y1 <= r.p < g.y2} for r in rows}
        xs = {r.p: {g.tile_idx % across for g in grid if g.x1 <= r.p < g.x2} for r in cols}
        assert all(set(r.t) == ys[r.p] for r in rows) and all(set(r.t) == xs[r.p] for r in cols)


@pytest.mark.parametrize("h, w, sigma, tile", [(40, 30, 1.0, 16), (25, 70, 3.0, 16), (9, 12, 4.0, 512), (50, 20, 0.6, 7)])
def test_gaussian_in_tiles(spark, h, w, sigma, tile):
    image = np.random.default_rng(3).uniform(0, 1, (h, w))
    k = np.asarray(raster.gaussian_weights(sigma))
    reach = len(k) // 2
    wide = np.pad(image, reach, mode="symmetric")
    want = sum(a * b * wide[i : i + h, j : j + w] for i, a in enumerate(k) for j, b in enumerate(k))
    px = spark.createDataFrame([(y, x, float(image[y, x])) for y in range(h) for x in range(w)], "y int, x int, v double")
    got = np.zeros((h, w))
    found = raster.gaussian(px, sigma, h, w, tile).collect()
    for r in found:
        got[r.y, r.x] = r.v
    assert len(found) == h * w and np.allclose(got, want)


def test_regions_meet_pixels_by_squares(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", ["rect", "circle"][i % 2], float(x), float(y), float(x + rng.integers(0, 40)), float(y + rng.integers(0, 40)), []) for i, (x, y) in enumerate(rng.integers(-5, 70, (30, 2)))]
    rows.append(("poly", "freehand", 3.0, 3.0, 60.0, 50.0, [(3.0, 3.0), (60.0, 8.0), (30.0, 50.0)]))
    rois = spark.createDataFrame(rows, "name string, roi_type string, x1 double, y1 double, x2 double, y2 double, points array<struct<x:double,y:double>>")
    px = spark.range(80 * 70).selectExpr("cast(id div 70 as int) as y", "cast(id % 70 as int) as x")
    result = {}
    for square in (256, 16, 5):
        monkeypatch.setattr(roi, "SQUARE", square)
        result[square] = [sorted(map(tuple, f(px, rois, 80, 70).collect())) for f in (roi.members, roi.members_or_box)]
    assert result[256] == result[16] == result[5] and len(result[256][0]) > 500


def test_nearest_cells_with_far_queries(spark):
    rng = np.random.default_rng(5)
    cells = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.normal(size=(300, 2)))] + [(900, 5000.0, 5000.0), (901, None, 1.0), (902, float("nan"), 1.0)]
    queries = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.normal(size=(40, 2)))] + [(100, 1e6, -1e6), (101, 5000.0, 4999.0), (102, None, 0.0)]
    c = spark.createDataFrame(cells, "cell_id long, y double, x double")
    q = spark.createDataFrame(queries, "query_id long, qy double, qx double")
    known = [x for x in cells if x[0] < 901]
    for k in (3, 500):
        got = {}
        for r in spatial.nearest_of(c, q, k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.cell_id))
        want = {i: [x[0] for x in sorted(known, key=lambda x: (((x[1] - y) ** 2 + (x[2] - a) ** 2) ** 0.5, x[0]))[:k]] for i, y, a in queries if y is not None}
        assert {i: [x for _, x in sorted(v)] for i, v in got.items()} == want


def test_ward_heatmap_of_all_cells(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "cell_id long, a double, b double, c double")
    got = sorted(cluster.heatmap(df, ["a", "b", "c"], 40).collect(), key=lambda r: r.ord)
    # plain Ward: always the pair of clusters whose union adds least to the sum of squares
    clusters = {i: [i] for i in range(40)}
    cost = lambda m: float(((points[m] - points[m].mean(0)) ** 2).sum())
    new = 40
    while len(clusters) > 1:
        a, b = min(((a, b) for a in clusters for b in clusters if a < b), key=lambda p: cost(clusters[p[0]] + clusters[p[1]]) - cost(clusters[p[0]]) - cost(clusters[p[1]]))
        clusters[new] = clusters.pop(a) + clusters.pop(b)
        new += 1
    assert [r.cell_id for r in got] == next(iter(clusters.values()))
    scaled = (points - points.min(0)) / (points.max(0) - points.min(0))
    assert np.allclose([[r.a, r.b, r.c] for r in got], scaled[[r.cell_id for r in got]])
    assert cluster.sample_cells(df, 7).count() == 7 and cluster.sample_cells(df, 7).collect() == cluster.sample_cells(df, 7).collect()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "yarn"
        getConf = lambda self: {}
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session())
