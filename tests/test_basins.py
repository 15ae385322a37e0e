"""Objects across the seams of tiles: equal to one tile, and to plain definitions."""

import numpy as np
import pytest

from lumenlake.operators import basins
from lumenlake.operators.labels import components_of


def pixels_of(spark, plane, image=None):
    y, x = np.nonzero(plane)
    rows = [(int(a), int(b)) for a, b in zip(y, x)]
    return spark.createDataFrame([(image, *r) for r in rows] if image else rows, "image_id string, y int, x int" if image else "y int, x int")


def first_places(plane):
    n = components_of(plane)
    first = {}
    for k, (y, x) in zip(n[plane].tolist(), zip(*np.nonzero(plane))):
        first.setdefault(k, int(y) * plane.shape[1] + int(x))
    return {(int(y), int(x)): first[int(n[y, x])] for y, x in zip(*np.nonzero(plane))}


def spiral(n):
    plane, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    ahead = lambda k: (y + k * dy, x + k * dx)
    free = lambda p: not (0 <= p[0] < n and 0 <= p[1] < n) or not plane[p]
    turns = 0
    while turns < 2:
        plane[y, x] = True
        one, two = ahead(1), ahead(2)
        if 0 <= one[0] < n and 0 <= one[1] < n and free(one) and free(two):
            y, x, turns = *one, 0
        else:
            dy, dx, turns = dx, -dy, turns + 1
    return plane


def test_a_spiral_over_a_hundred_tiles_is_one_object(spark):
    plane = spiral(40)
    assert len(np.unique(components_of(plane))) == 2 and plane.sum() > 500
    got = basins.mask_components(pixels_of(spark, plane), 40, tile=4).collect()
    assert {r.cell_id for r in got} == {0} and len(got) == plane.sum()


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_components_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    one, two = rng.random((33, 45)) < 0.55, rng.random((33, 45)) < 0.5
    both = pixels_of(spark, one, "a").unionByName(pixels_of(spark, two, "b"))
    got = basins.mask_components(both, 45, tile).collect()
    for name, plane in (("a", one), ("b", two)):
        assert {(r.y, r.x): r.cell_id for r in got if r.image_id == name} == first_places(plane)
    assert basins.mask_components(both.limit(0), 45, tile).count() == 0


def discs(h, w, *places):
    y, x = np.mgrid[:h, :w]
    return sum(((y - a) ** 2 + (x - b) ** 2 <= r * r).astype(float) for a, b, r in places) * 100


def dense(spark, plane):
    return spark.createDataFrame([(y, x, float(plane[y, x])) for y in range(plane.shape[0]) for x in range(plane.shape[1])], "y int, x int, v double")


def test_touching_discs_come_apart_in_any_tiling(spark):
    places = ((20, 20, 10), (20, 37, 10), (37, 28, 10), (10, 60, 7))
    plane = discs(52, 72, *places)
    whole = components_of(plane > 50)
    assert len(np.unique(whole)) == 3  # three of the discs touch
    found = {}
    for tile in (128, 16, 24):
        found[tile] = {(r.y, r.x): r.cell_id for r in basins.watershed(dense(spark, plane), 52, 72, 50.0, sigma=2.0, most=16, tile=tile).collect()}
    assert found[128] == found[16] == found[24] and len(found[16]) == (plane > 50).sum()
    ids = [found[16][a, b] for a, b, _ in places]
    assert len(set(ids)) == 4 and set(found[16].values()) == set(ids)
    for (a, b, r), i in zip(places, ids):  # each has most of its disc
        y, x = np.nonzero(discs(52, 72, (a, b, r)))
        assert np.mean([found[16][int(p), int(q)] == i for p, q in zip(y, x)]) > 0.85


def climbed(plane):
    h, w = plane.shape
    better = lambda p: (plane[p], -(p[0] * w + p[1]))
    out = {}
    for at in zip(*np.nonzero(~np.isnan(plane))):
        p = (int(at[0]), int(at[1]))
        while True:
            around = [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= p[0] + a < h and 0 <= p[1] + b < w and not np.isnan(plane[p[0] + a, p[1] + b])]
            q = max(around, key=better)
            if q == p:
                break
            p = q
        out[int(at[0]), int(at[1])] = p[0] * w + p[1]
    return out


@pytest.mark.parametrize("tile", [2, 5, 40])
def test_ascents_with_ties_and_holes(spark, tile):
    rng = np.random.default_rng(tile)
    plane = rng.integers(0, 4, (17, 23)).astype(float)
    plane[rng.random(plane.shape) < 0.15] = np.nan
    rows = [(int(y), int(x), float(plane[y, x])) for y, x in zip(*np.nonzero(~np.isnan(plane)))] + [(0, 0, None)] * bool(np.isnan(plane[0, 0]))
    got = basins.ascent_basins(spark.createDataFrame(rows, "y int, x int, v double"), 17, 23, tile).collect()
    assert {(r.y, r.x): r.cell_id for r in got} == climbed(plane)
