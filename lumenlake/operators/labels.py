"""Label masks: boundaries, relabelling, tiled segmentation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .components import components
from .ranking import numbered

TILE_SIZE, TILE_OVERLAP, SINGLE_MAX, SLIVER = 1024, 128, 2048, 64
TILE_IDS = 1 << 32


#: Side of the tiles in which neighbouring pixels are compared.
EDGE_TILE = 512


def boundary(labels: DataFrame, tile: int = EDGE_TILE) -> DataFrame:
    """Rows of inner boundary pixels: of a cell, beside a pixel of another label (four neighbours); absent pixels are none.

    A pixel goes to its tile, and one at a tile's side to the next tile too, with image_id where there are several images;
    a tile's pixels are compared in arrays, without a sort.
    """
    image = ["image_id"] if "image_id" in labels.columns else []

    def edges(table: pa.Table) -> pa.Table:
        ty, tx = table.column("__ty")[0].as_py(), table.column("__tx")[0].as_py()
        y, x = (table.column(c).to_numpy().astype(np.int64) - k * tile + 1 for c, k in (("y", ty), ("x", tx)))
        c = table.column("cell_id").fill_null(-1).to_numpy()
        plane, there = np.zeros((tile + 2, tile + 2), c.dtype), np.zeros((tile + 2, tile + 2), bool)
        plane[y, x], there[y, x] = c, table.column("cell_id").is_valid().to_numpy()
        on = np.zeros(len(y), bool)
        own = (y >= 1) & (y <= tile) & (x >= 1) & (x <= tile) & there[y, x] & (c > 0)
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            b, a = y[own] + dy, x[own] + dx
            on[own] |= there[b, a] & (plane[b, a] != c[own])
        return table.filter(pa.array(on)).drop_columns(["__ty", "__tx"])

    def numbers(axis: str) -> Column:
        return F.sequence(F.floor((F.col(axis) - 1) / tile).cast("int"), F.floor((F.col(axis) + 1) / tile).cast("int"))

    dealt = labels.withColumn("__ty", F.explode(numbers("y"))).withColumn("__tx", F.explode(numbers("x")))
    return dealt.groupBy(*image, "__ty", "__tx").applyInArrow(edges, labels.schema)


def distances(pixels: DataFrame, h: int, w: int, most: int, tile: int = 512) -> DataFrame:
    """(image_id, y, x, d): of every place of the frame within so many four-neighbour steps of the pixels, the steps to the nearest.

    Pixels go to the tiles whose halo of ``most`` holds them, four at most, as tiles are no smaller than the halo. In a tile
    two passes, there and back along rows and then along columns, carry the distances on; the cost does not depend on ``most``.
    """
    image = ["image_id"] if "image_id" in pixels.columns else []
    side = max(tile, most, 1)
    kinds = dict(pixels.dtypes)

    def numbers(axis: str, n: int) -> Column:
        low, high = F.floor((F.col(axis) - most) / side), F.floor((F.col(axis) + most) / side)
        return F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit((n - 1) // side)).cast("int"))

    def spread(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        y0, x0, y1, x1 = ty * side, tx * side, min(h, ty * side + side), min(w, tx * side + side)
        top, left = max(0, y0 - most), max(0, x0 - most)
        d = np.full((min(h, y1 + most) - top, min(w, x1 + most) - left), np.int64(h) + w + most, np.int64)
        d[table.column("y").to_numpy() - top, table.column("x").to_numpy() - left] = 0
        for _ in range(2):  # along rows, then along columns: a running minimum of d - i there and of d + i back
            i = np.arange(d.shape[1])
            there = np.minimum.accumulate(d - i, axis=1) + i
            back = np.minimum.accumulate((d + i)[:, ::-1], axis=1)[:, ::-1] - i
            d = np.minimum(there, back).T
        own = d[y0 - top : y1 - top, x0 - left : x1 - left]
        y, x = np.nonzero(own <= most)
        found = [pa.array((y + y0).astype(np.int32)), pa.array((x + x0).astype(np.int32)), pa.array(own[y, x].astype(np.int32))]
        return pa.table([*(pa.array([table.column(c)[0].as_py()] * len(y), table.schema.field(c).type) for c in image), *found], names=[*image, "y", "x", "d"])

    inside = pixels.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))
    dealt = inside.select(*image, "y", "x", F.explode(numbers("y", h)).alias("ty")).withColumn("tx", F.explode(numbers("x", w)))
    return dealt.groupBy(*image, "ty", "tx").applyInArrow(spread, ", ".join([*(f"{c} {kinds[c]}" for c in image), "y int, x int, d int"]))


def dilated(pixels: DataFrame, steps: int, h: int, w: int) -> DataFrame:
    """(y, x) of pixels grown by so many four-neighbour steps within the frame, with image_id where there are several images."""
    return distances(pixels, h, w, steps).drop("d")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one mask (y, x) alone."""
    keys = ["y", "x"]
    return a.join(b, keys, "left_anti").select(keys).unionByName(b.join(a, keys, "left_anti").select(keys))


def relabel_dense(labels: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """labels with new_id: 1..n in the order of the ids, background stays 0.

    Ids are numbered without a global window: see ranking.numbered.
    """
    ids = numbered(labels.where(F.col(id_col) > 0).select(F.col(id_col).alias("__id")).distinct(), [F.col("__id")], "new_id")
    return labels.join(ids, labels[id_col] == ids["__id"], "left").drop("__id").withColumn("new_id", F.coalesce("new_id", F.lit(0)))


def _starts(n: int, size: int, overlap: int, sliver: int) -> list[int]:
    """Where tiles begin along a side of n pixels; a last tile thinner than sliver is left out."""
    return [a for a in range(0, max(1, n), size - overlap) if min(a + size, n) - a >= sliver]


def tile_grid(spark, h: int, w: int, size: int = TILE_SIZE, overlap: int = TILE_OVERLAP, sliver: int = SLIVER) -> DataFrame:
    """(tile_idx, id_offset, y1, y2, x1, x2): overlapping tiles in reading order, slivers left out.

    Each tile has TILE_IDS ids of its own, more than it can have pixels.
    """
    rows, cols = _starts(h, size, overlap, sliver), _starts(w, size, overlap, sliver)
    each = [(i * len(cols) + j, (i * len(cols) + j) * TILE_IDS, y, min(y + size, h), x, min(x + size, w)) for i, y in enumerate(rows) for j, x in enumerate(cols)]
    return spark.createDataFrame(each, "tile_idx int, id_offset long, y1 int, y2 int, x1 int, x2 int")


def _tiles_of(axis: str, n: int, size: int, overlap: int, sliver: int) -> Column:
    """The numbers of the tiles along a side that hold a pixel: tiles begin every size - overlap pixels."""
    step, last = size - overlap, len(_starts(n, size, overlap, sliver)) - 1
    low = F.greatest(F.floor((F.col(axis) - size) / step) + 1, F.lit(0))
    high = F.least(F.floor(F.col(axis) / step), F.lit(last))
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def first_writer(tiles: DataFrame) -> DataFrame:
    """(y, x, cell_id) of tiles' labels (tile_idx, y, x, cell_id): at each pixel the first tile with a cell wins."""
    return tiles.where(F.col("cell_id") > 0).groupBy("y", "x").agg(F.min_by("cell_id", "tile_idx").alias("cell_id"))


Segmenter = Callable[[np.ndarray, "np.ndarray | None"], np.ndarray]


def components_of(on: np.ndarray) -> np.ndarray:
    """Four-connected components of a plane, numbered in reading order of their first pixels."""
    h, w = on.shape
    labels = np.where(on, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:  # each pixel takes the least label around it, then follows it
        grown = labels.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            both = on[a] & on[b]
            part = grown[a]
            part[both] = np.minimum(part[both], labels[b][both])
        flat = np.append(0, grown.reshape(-1))
        grown = np.where(on, np.minimum(grown, flat[grown]), 0)
        if (grown == labels).all():
            break
        labels = grown
    ids = np.unique(labels[labels > 0])
    return np.where(on, np.searchsorted(ids, labels) + 1, 0).astype(np.int32)


def threshold_segmenter(nuclear: np.ndarray, membrane: np.ndarray | None = None) -> np.ndarray:
    """A plain segmenter: four-connected components of what is over the mean, numbered in reading order."""
    return components_of(nuclear > nuclear.mean())


def segment_tiles(pixels: DataFrame, h: int, w: int, segmenter: Segmenter = threshold_segmenter, size: int = TILE_SIZE, overlap: int = TILE_OVERLAP, single_max: int = SINGLE_MAX, sliver: int = SLIVER, stitch: float | None = None) -> DataFrame:
    """(y, x, cell_id) of a raster (y, x, v, and m where there is a membrane channel) cut into overlapping tiles, each
    segmented by a Python callable.

    Images of at most single_max a side are one tile. Pixels explode to the tiles that hold them, four at most where tiles
    overlap by no more than half, by arithmetic; a task holds one tile at a time. Ids get the tile's offset, the first
    tile wins where tiles overlap, ids are made dense. With stitch, objects that a seam cuts are joined first: see stitched.
    """
    if h <= single_max and w <= single_max or not _starts(h, size, overlap, sliver) or not _starts(w, size, overlap, sliver):
        size, overlap, sliver = max(h, w), 0, 1
    rows, cols = _starts(h, size, overlap, sliver), _starts(w, size, overlap, sliver)
    membrane = "m" in pixels.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = int(pdf["tile_idx"].iloc[0])
        y1, x1 = rows[tile // len(cols)], cols[tile % len(cols)]
        shape = (min(y1 + size, h) - y1, min(x1 + size, w) - x1)
        planes = []
        for c in ("v", "m") if membrane else ("v",):
            plane = np.zeros(shape)
            plane[pdf["y"] - y1, pdf["x"] - x1] = pdf[c].fillna(0.0)
            planes.append(plane)
        labels = segmenter(planes[0], planes[1] if membrane else None)
        y, x = np.nonzero(labels)
        return pd.DataFrame({"tile_idx": np.full(len(y), tile, np.int32), "y": (y + y1).astype(np.int32), "x": (x + x1).astype(np.int32), "cell_id": labels[y, x].astype(np.int64) + tile * TILE_IDS})

    on = pixels.select("y", "x", *(F.col(c).cast("double").alias(c) for c in (("v", "m") if membrane else ("v",))))
    on = on.withColumn("ty", F.explode(_tiles_of("y", h, size, overlap, sliver))).withColumn("tx", F.explode(_tiles_of("x", w, size, overlap, sliver)))
    on = on.withColumn("tile_idx", F.col("ty") * len(cols) + F.col("tx")).drop("ty", "tx")
    tiles = on.groupBy("tile_idx").applyInPandas(run, "tile_idx int, y int, x int, cell_id long")
    if stitch is not None:
        tiles = stitched(written(tiles, "tiles"), stitch)
    return relabel_dense(first_writer(tiles)).select("y", "x", F.col("new_id").cast("long").alias("cell_id"))


def stitched(tiles: DataFrame, least: float = 0.5) -> DataFrame:
    """tiles' labels (tile_idx, y, x, cell_id) with objects joined that two tiles both found.

    Two labels of different tiles are one object if, of the pixels that both tiles see and either label holds, the share
    that both hold is least or more. Joined labels take the least id, over any number of tiles. Only pixels that two
    tiles have labelled meet, by an equi-join on the pixel.
    """
    rows = tiles.where("cell_id > 0")
    seen = rows.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("tile_idx", "cell_id"))).alias("l")).where("size(l) > 1")  # a pixel lies in few tiles
    pairs = seen.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a.tile_idx < b.tile_idx")
    both = pairs.groupBy(F.col("a.cell_id").alias("a"), F.col("b.cell_id").alias("b")).agg(F.count("*").alias("n"), F.min("a.tile_idx").alias("ta"), F.min("b.tile_idx").alias("tb"))
    both = written(both, "met")
    # what each label of a pair has within the box that the other's tile saw of it
    box = rows.groupBy("tile_idx").agg(F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2"))

    def part(own: str, other: str) -> DataFrame:
        asked = both.select(F.col(own).alias("cell_id"), F.col(f"t{other}").alias("tile_idx")).distinct().join(box, "tile_idx").withColumnRenamed("tile_idx", "other")
        inside = rows.join(asked, "cell_id").where(F.col("y").between(F.col("y1"), F.col("y2")) & F.col("x").between(F.col("x1"), F.col("x2")))
        return inside.groupBy(F.col("cell_id").alias(own), F.col("other").alias(f"t{other}")).agg(F.count("*").alias(f"n{own}"))

    sized = both.join(part("a", "b"), ["a", "tb"]).join(part("b", "a"), ["b", "ta"])
    linked = sized.where(F.col("n") >= least * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")
    names = components(linked).withColumnRenamed("node", "cell_id")
    return tiles.join(names, "cell_id", "left").select("tile_idx", "y", "x", F.coalesce("comp", "cell_id").alias("cell_id"))


def segment_rois(tiles_of_roi: DataFrame) -> DataFrame:
    """(y, x, cell_id) of labels by region (roi_idx, y, x, cell_id): ids run on over the regions, the greatest wins."""
    return roi_offsets_applied(tiles_of_roi).groupBy("y", "x").agg(F.max("cell_id").alias("cell_id"))


def roi_offsets(labels: DataFrame) -> DataFrame:
    """(roi_idx, max_id, id_offset): running sum of the greatest ids of the regions before; empty regions add none."""
    tops = labels.groupBy("roi_idx").agg(F.max("cell_id").alias("max_id"))
    before = Window.orderBy("roi_idx").rowsBetween(Window.unboundedPreceding, -1)
    return tops.withColumn("id_offset", F.coalesce(F.sum("max_id").over(before), F.lit(0)))


def roi_offsets_applied(labels: DataFrame) -> DataFrame:
    shift = roi_offsets(labels).select("roi_idx", "id_offset")
    return labels.join(shift, "roi_idx").withColumn("cell_id", F.when(F.col("cell_id") > 0, F.col("cell_id") + F.col("id_offset")).otherwise(0)).drop("id_offset")


def cellpose_segmenter(model: str = "cyto3", diameter: float | None = None, gpu: bool = False) -> Segmenter:
    """A segmenter by the optional package cellpose: nuclear and, if given, membrane channel."""

    def run(nuclear: np.ndarray, membrane: np.ndarray | None = None) -> np.ndarray:
        from cellpose import models

        image = nuclear if membrane is None else np.stack([membrane, nuclear])
        return models.CellposeModel(gpu=gpu, model_type=model).eval(image, diameter=diameter, channels=[0, 0] if membrane is None else [1, 2])[0].astype(np.int32)

    return run


def mesmer_segmenter(mpp: float = 0.5, compartment: str = "whole-cell") -> Segmenter:
    """A segmenter by the optional package deepcell; a missing membrane channel is zeros."""

    def run(nuclear: np.ndarray, membrane: np.ndarray | None = None) -> np.ndarray:
        from deepcell.applications import Mesmer

        pair = np.stack([nuclear, np.zeros_like(nuclear) if membrane is None else membrane], -1)[None]
        return Mesmer().predict(pair, image_mpp=mpp, compartment=compartment)[0, :, :, 0].astype(np.int32)

    return run


#: Segmenters by name: (module that must be importable or None, factory).
SEGMENTERS: dict[str, tuple[str | None, Callable[..., Segmenter]]] = {
    "threshold": (None, lambda: threshold_segmenter),
    "cellpose": ("cellpose", cellpose_segmenter),
    "mesmer": ("deepcell", mesmer_segmenter),
}


def available_segmenters() -> dict[str, bool]:
    import importlib.util

    return {name: module is None or importlib.util.find_spec(module) is not None for name, (module, _) in SEGMENTERS.items()}


def default_diameter(mpp: float) -> float:
    return max(15.0, 30.0 / mpp)


def imported_mask(pixels: DataFrame) -> DataFrame:
    """A mask read from a raster: labels as integers, for a pass-through segmentation."""
    return pixels.select("y", "x", F.col("v").cast("int").alias("cell_id"))


