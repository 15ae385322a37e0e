"""Rasters as tiles: one row a tile and channel, with its samples as an array.

A tile is (image_id where there are several images, ch_idx, ty, tx, y0, x0, h, w, v), v holding h * w samples row by row.
What meets in a shuffle is a tile, not a pixel; arithmetic on samples is done in arrays, a batch of tiles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import TILE, image_of

PLACE = ["ty", "tx", "y0", "x0", "h", "w"]
SETTINGS = ["min", "max", "brightness", "gamma", "r", "g", "b"]


def tiles_of_pixels(pixels: DataFrame, side: int = TILE) -> DataFrame:
    """Tiles of pixels (y, x, v, with ch_idx and image_id where several are meant); absent samples are 0."""
    keys = [*image_of(pixels), *(c for c in ("ch_idx",) if c in pixels.columns)]
    at = {"ty": F.floor(F.col("y") / side).cast("int"), "tx": F.floor(F.col("x") / side).cast("int")}
    met = pixels.withColumns(at).groupBy(*keys, "ty", "tx").agg(F.max("y").alias("y1"), F.max("x").alias("x1"), F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))).alias("p"))
    met = met.withColumns({"y0": F.col("ty") * side, "x0": F.col("tx") * side}).withColumns({"h": F.col("y1") - F.col("y0") + 1, "w": F.col("x1") - F.col("x0") + 1})
    kinds = dict(met.dtypes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = []
            for y0, x0, h, w, p in zip(*(batch.column(c).to_pylist() for c in ("y0", "x0", "h", "w")), batch.column("p")):
                plane = np.zeros((h, w))
                y, x, v = (p.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                plane[y - y0, x - x0] = np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf)
                planes.append(plane.reshape(-1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, *PLACE)), _lists(planes)], names=[*keys, *PLACE, "v"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *PLACE))
    return met.select(*keys, *PLACE, "p").mapInArrow(fill, f"{schema}, v array<double>")


def _lists(planes: list[np.ndarray], kind=np.float64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, planes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *planes]).astype(kind)))


def pixels_of_tiles(tiles: DataFrame, *samples: str) -> DataFrame:
    """(image_id, ch_idx, y, x, samples) of tiles, no shuffle; samples: names of array columns, v if none is given."""
    samples = samples or ("v",)
    keys = [*image_of(tiles), *(c for c in ("ch_idx",) if c in tiles.columns)]
    rows = tiles.select(*keys, "y0", "x0", "w", F.posexplode(F.arrays_zip(*samples)).alias("i", "s"))
    return rows.select(*keys, (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"), *(F.col(f"s.{c}").alias(c) for c in samples))


def _held(a: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum(np.maximum(a, low), high)  # NaN stays


def _layer_float(v: np.ndarray, s: dict, gamma: bool) -> np.ndarray:
    low, high = s["min"], s["max"] if s["max"] > s["min"] else s["min"] + 1
    n = _held((v - low) / (high - low), 0.0, 1.0)
    if gamma and s["gamma"] != 1.0:
        n = n ** (1 / s["gamma"])
    return _held(n * s["brightness"], 0.0, 1.0)


def _blend_float(layers: list[tuple[np.ndarray, dict]], gamma: bool) -> list[np.ndarray]:
    left = [np.ones(len(layers[0][0])) for _ in "rgb"]
    for v, s in layers:
        n = _layer_float(v, s, gamma)
        for k, c in enumerate("rgb"):
            left[k] = left[k] * (1 - n * s[c] / 255.0)
    return [_held(np.floor(np.round((1 - x) * 255, 6)), 0, 255).astype(np.int32) for x in left]


def _blend_u8(layers: list[tuple[np.ndarray, dict]]) -> list[np.ndarray]:
    out = [np.zeros(len(layers[0][0]), np.int64) for _ in "rgb"]
    for v, s in layers:
        n = _held((np.floor(v) - s["min"]) / max(s["max"] - s["min"], 1.0), 0.0, 1.0)
        if abs(s["gamma"] - 1) > 0.01:
            n = n ** (1 / s["gamma"])
        n = _held(n * s["brightness"], 0.0, 1.0)
        for k, c in enumerate("rgb"):
            b = _held(np.floor(n * s[c]), 0, 255).astype(np.int64)
            out[k] = out[k] + b - out[k] * b // 255
    return [x.astype(np.int32) for x in out]


def composite_tiles(tiles: DataFrame, params: DataFrame, mode: str = "u8") -> DataFrame:
    """(image_id, ty, tx, y0, x0, h, w, r, g, b) of tiles in several channels, blended with their settings.

    mode: "u8" (8-bit layers in channel order, each step truncated), "float" (screen blend, order-free) or "float_plain"
    (without gamma). A tile's visible channels, a row each, meet by the tile's place. Samples must not be null; channels
    of a place must have the same h and w.
    """
    from .stats import MAX_SETTINGS, checked_small

    keys = [*image_of(tiles), *PLACE]
    on = tiles.join(checked_small(params.where("visible").select("ch_idx", *SETTINGS), MAX_SETTINGS), "ch_idx")
    met = on.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch_idx", *SETTINGS, "v"))).alias("layers"))  # as many as there are channels
    kinds = dict(met.dtypes)

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes: tuple[list, list, list] = ([], [], [])
            for stack in batch.column("layers"):
                stack = stack.values
                settings = [dict(zip(SETTINGS, x)) for x in zip(*(stack.field(1 + i).to_pylist() for i in range(len(SETTINGS))))]
                v, at = stack.field(1 + len(SETTINGS)), 0
                flat = v.flatten().to_numpy(zero_copy_only=False)
                layers = []
                for s, size in zip(settings, v.value_lengths().to_pylist()):
                    layers.append((flat[at : at + size], s))
                    at += size
                made = _blend_u8(layers) if mode == "u8" else _blend_float(layers, mode == "float")
                for plane, x in zip(planes, made):
                    plane.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(_lists(p, np.int32) for p in planes)], names=[*keys, "r", "g", "b"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys)
    return met.mapInArrow(blend, f"{schema}, r array<int>, g array<int>, b array<int>")


def _assembled(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One tile of all parts (of the same form) with the same keys, ty and tx; samples that no part has are 0."""
    kinds = dict(parts.dtypes)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, planes = [], []
            for ty, tx, parts in zip(batch.column("ty").to_pylist(), batch.column("tx").to_pylist(), batch.column("parts")):
                parts = parts.values
                y0, x0, h, w = (parts.field(i).to_numpy() for i in range(4))
                top, left = int(y0.min()), int(x0.min())
                plane = np.zeros((int((y0 + h).max()) - top, int((x0 + w).max()) - left))
                sizes = parts.field(4).value_lengths().to_numpy()
                flat, ends = parts.field(4).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                for k in range(len(y0)):
                    plane[y0[k] - top : y0[k] - top + h[k], x0[k] - left : x0[k] - left + w[k]] = flat[ends[k] - sizes[k] : ends[k]].reshape(h[k], w[k])
                rows.append((ty, tx, top, left, *plane.shape))
                planes.append(plane.reshape(-1))
            place = [pa.array(list(c), pa.int32()) for c in (zip(*rows) if rows else [()] * 6)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *place, _lists(planes)], names=[*keys, *PLACE, "v"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), *(f"{c} int" for c in PLACE), "v array<double>"])
    met = parts.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("y0", "x0", "h", "w", "v")).alias("parts"))  # the samples of one tile
    return met.mapInArrow(put_together, schema)


def regrouped(tiles: DataFrame, side: int = TILE) -> DataFrame:
    """Tiles of side by side samples put together from smaller ones (rows, strips), none of which may lie in two of them."""
    keys = [*image_of(tiles), *(c for c in ("ch_idx",) if c in tiles.columns)]
    at = {"ty": F.floor(F.col("y0") / side).cast("int"), "tx": F.floor(F.col("x0") / side).cast("int")}
    return _assembled(tiles.withColumns(at), keys)


# --- pyramid

#: Tiles of a level that lie in one folder, along each side.
BLOCK = 8


def _halved(tiles: DataFrame, keys: list[str], side: int) -> DataFrame:
    """The next level: every second row and column; of four neighbours a quarter of the samples each meets."""
    kinds = dict(tiles.dtypes)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, planes = {c: batch.column(c).to_numpy() for c in ("ty", "tx", "y0", "x0", "h", "w")}, []
            for i, v in enumerate(batch.column("v")):
                plane = v.values.to_numpy(zero_copy_only=False).reshape(cols["h"][i], cols["w"][i])
                planes.append(plane[cols["y0"][i] % 2 :: 2, cols["x0"][i] % 2 :: 2].reshape(-1))
            up = {c: -(-cols[c] // 2) for c in ("y0", "x0")}
            out = {"ty": up["y0"] // side, "tx": up["x0"] // side, **up, "h": -(-(cols["y0"] + cols["h"]) // 2) - up["y0"], "w": -(-(cols["x0"] + cols["w"]) // 2) - up["x0"]}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(out[c].astype(np.int32)) for c in PLACE), _lists(planes)], names=[*keys, *PLACE, "v"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), *(f"{c} int" for c in PLACE), "v array<double>"])
    return _assembled(tiles.select(*keys, *PLACE, "v").mapInArrow(thin, schema).where("h > 0 and w > 0"), keys)


class Pyramid:
    """Levels of tiles in a folder: level l holds every 2**l-th row and column; each is made from the one below.

    Files are laid out by level and by blocks of BLOCK by BLOCK tiles, and hold ty and tx in order, so a viewport reads the
    folders and row groups of its own tiles alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path

    @classmethod
    def write(cls, tiles: DataFrame, path: str, h: int, w: int, side: int = TILE, block: int = BLOCK) -> Pyramid:
        """Store tiles of side samples (those at the image's end may be smaller) and all levels above, until one fits in a tile."""
        if side % 2:
            raise ValueError("the side of a pyramid's tiles must be even")
        spark = tiles.sparkSession
        keys = [*image_of(tiles), *(c for c in ("ch_idx",) if c in tiles.columns)]
        level, found = 0, tiles.select(*keys, *PLACE, "v")
        while True:
            rows = found.withColumns({"level": F.lit(level), "by": F.floor(F.col("ty") / block).cast("int"), "bx": F.floor(F.col("tx") / block).cast("int")})
            rows.repartition("by", "bx").sortWithinPartitions("by", "bx", "ty", "tx").write.mode("overwrite" if not level else "append").partitionBy("level", "by", "bx").parquet(path)
            if max(h, w) <= side << level:
                return cls(spark, path)
            below = spark.read.parquet(path).where(F.col("level") == level)
            found, level = _halved(below.select(*keys, *PLACE, "v"), keys, side), level + 1

    def tiles(self, level: int) -> DataFrame:
        return self._spark.read.parquet(self.path).where(F.col("level") == level)

    def level_for(self, ds: int) -> int:
        """The highest stored level whose rows and columns include every ds-th one."""
        levels = [r.level for r in self._spark.read.parquet(self.path).select("level").distinct().collect()]  # log2 of the image's side
        return max(k for k in levels if ds % (1 << k) == 0)

    def view(self, y1: int, y2: int, x1: int, x2: int, ds: int, side: int = TILE, block: int = BLOCK) -> DataFrame:
        """(image_id, ch_idx, y, x, v): every ds-th row and column of a full-resolution box, y and x counted in steps of ds."""
        level = self.level_for(ds)
        unit = side << level
        near = self.tiles(level)
        for axis, a, b in (("y", y1, y2), ("x", x1, x2)):
            low, high = a // unit, max(a, b - 1) // unit
            near = near.where(F.col(f"b{axis}").between(low // block, high // block) & F.col(f"t{axis}").between(low, high))
        pixels = pixels_of_tiles(near)
        step = ds >> level
        first = lambda a: -(-a // ds)
        inside = pixels.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).withColumns({"y": F.floor(F.col("y") / step).cast("int"), "x": F.floor(F.col("x") / step).cast("int")})
        return inside.where(F.col("y").between(first(y1), first(y2) - 1) & F.col("x").between(first(x1), first(x2) - 1))


def rows_as_tiles(rows: DataFrame, y: str, channels: dict[int, str], width: int) -> DataFrame:
    """Tiles of one row each, of a table that holds a row of samples as an array for each channel (channel number: expression)."""
    layers = chain.from_iterable((F.struct(F.lit(k).alias("ch_idx"), F.expr(e).alias("v")),) for k, e in channels.items())
    return rows.select(F.col(y).cast("int").alias("ty"), F.explode(F.array(*layers)).alias("l")).select(
        "l.ch_idx", "ty", F.lit(0).alias("tx"), F.col("ty").alias("y0"), F.lit(0).alias("x0"), F.lit(1).alias("h"), F.lit(width).alias("w"), "l.v"
    )
