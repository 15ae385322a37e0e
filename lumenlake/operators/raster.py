"""Raster operators on pixel tables (y, x, v, with image_id or ch_idx where several are meant)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import byte_of, lut_byte, lut_index, screen_float, screen_u8, window_level
from ..sources.scratch import checked_small
from .stats import MAX_SETTINGS

TILE = 512
MAX_PREVIEW = 2500


def image_of(rows: DataFrame) -> list[str]:
    """The columns that tell images apart: image_id, where the rows have it."""
    return [c for c in ("image_id",) if c in rows.columns]


def preview_step(h: int, w: int, max_dim: int = MAX_PREVIEW) -> int:
    return max(1, max(h, w) // max_dim)


def preview(pixels: DataFrame, ds: int) -> DataFrame:
    """Every ds-th row and column, renumbered."""
    kept = pixels.where((F.col("y") % ds == 0) & (F.col("x") % ds == 0))
    return kept.withColumns({"y": F.floor(F.col("y") / ds).cast("int"), "x": F.floor(F.col("x") / ds).cast("int")})


def crop(pixels: DataFrame, y1: int, y2: int, x1: int, x2: int, tile: int | None = None) -> DataFrame:
    """Half-open crop; with a tile size the tile columns ty and tx are bounded too, so that whole tiles are skipped."""
    got = pixels.where((F.col("y") >= y1) & (F.col("y") < y2) & (F.col("x") >= x1) & (F.col("x") < x2))
    if tile and {"ty", "tx"} <= set(pixels.columns):
        got = got.where(F.col("ty").between(y1 // tile, max(y1, y2 - 1) // tile) & F.col("tx").between(x1 // tile, max(x1, x2 - 1) // tile))
    return got


def lut(channel_max: DataFrame, cmin: float, cmax: float, brightness: float, gamma: float, colour: Sequence[int], max_value: int) -> DataFrame:
    """(level, r, g, b) for every integer level up to max_value."""
    level = F.col("level")
    return channel_max.sparkSession.range(max_value + 1).select(F.col("id").cast("int").alias("level")).select("level", *(lut_byte(level, cmin, cmax, brightness, gamma, p).alias(c) for c, p in zip("rgb", colour)))


def apply_lut(pixels: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """(y, x, r, g, b): entries of a look-up table of at most 65,536 rows, which is broadcast."""
    return pixels.withColumn("level", lut_index(F.col("v"), size)).join(table, "level", "left").select("y", "x", "r", "g", "b")


def layers_float(pixels: DataFrame, params: DataFrame, gamma: bool = True) -> DataFrame:
    """Pixels of visible channels with their window-levelled value times the colour, in [0, 1]."""
    n = window_level(F.col("v"), F.col("min"), F.col("max"), F.col("brightness"), F.col("gamma") if gamma else None)
    on = pixels.join(checked_small(params.where("visible"), MAX_SETTINGS), "ch_idx")
    return on.select(*image_of(pixels), "y", "x", "ch_idx", *((n * F.col(c) / 255.0).alias(c) for c in "rgb"))


def composite_float(pixels: DataFrame, params: DataFrame, gamma: bool = True) -> DataFrame:
    """(y, x, r, g, b): screen blend 1 - prod(1 - layer) of all visible channels, truncated to bytes."""
    at = [*image_of(pixels), "y", "x"]
    layers = layers_float(pixels, params, gamma).groupBy(*at).agg(*(F.collect_list(c).alias(c) for c in "rgb"))
    return layers.select(*at, *(byte_of(F.round(screen_float(F.col(c)) * 255, 6)).alias(c) for c in "rgb"))


def composite_u8(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """(y, x, r, g, b): 8-bit layers blended in channel order, each step truncated. params: cmin, cmax, brightness, gamma, r, g, b."""
    on, at = pixels.join(checked_small(params.where("visible"), MAX_SETTINGS), "ch_idx"), [*image_of(pixels), "y", "x"]
    top = F.greatest(F.col("max") - F.col("min"), F.lit(1.0))
    n = F.least(F.greatest((F.floor("v") - F.col("min")) / top, F.lit(0.0)), F.lit(1.0))
    n = F.least(F.greatest(F.when(F.abs(F.col("gamma") - 1) > 0.01, F.pow(n, 1 / F.col("gamma"))).otherwise(n) * F.col("brightness"), F.lit(0.0)), F.lit(1.0))
    layer = F.struct("ch_idx", *(byte_of(n * F.col(c)).cast("bigint").alias(c) for c in "rgb"))
    folded = on.groupBy(*at).agg(F.array_sort(F.collect_list(layer)).alias("l"))
    return folded.select(*at, *(screen_u8(F.col(f"l.{c}")).alias(c) for c in "rgb"))


def depth_of(region: DataFrame, is_uint16: bool) -> DataFrame:
    """dmax of a region's look-up table: 65535 for 16-bit images, else the region's greatest value, held to 65535; under 1 it is 255."""
    m = F.least(F.max("v").cast("double"), F.lit(65535.0))
    return region.agg((F.lit(65535.0) if is_uint16 else F.when(m < 1, 255.0).otherwise(m)).alias("dmax"))


def resize_nearest(pixels: DataFrame, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    """Nearest sample: each target takes source floor(i * h / new_h); sources are exploded to the targets that take them."""
    first = lambda c, n, m: F.ceil(F.col(c) * m / n).cast("int")
    span = lambda c, n, m: F.when(first(c, n, m) < F.ceil((F.col(c) + 1) * m / n), F.sequence(first(c, n, m), (F.ceil((F.col(c) + 1) * m / n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = pixels.withColumn("__y", F.explode(span("y", h, new_h))).withColumn("__x", F.explode(span("x", w, new_w)))
    return rows.drop("y", "x").withColumnsRenamed({"__y": "y", "__x": "x"}).select(pixels.columns)


def minimap(rgb: DataFrame, h: int, w: int, size: int = 160) -> DataFrame:
    """The composite scaled so that its longer side is size."""
    scale = size / max(h, w)
    return resize_nearest(rgb, h, w, max(1, int(h * scale)), max(1, int(w * scale)))


def visible_tiles(y1: int, y2: int, x1: int, x2: int, h: int, w: int, tile: int = TILE, margin: int = 1) -> tuple[int, int, int, int]:
    """(ty1, ty2, tx1, tx2), inclusive: the tiles of a viewport with a margin around it."""
    last = lambda n: max(0, (n - 1) // tile)
    return max(0, y1 // tile - margin), min(last(h), max(y1, y2 - 1) // tile + margin), max(0, x1 // tile - margin), min(last(w), max(x1, x2 - 1) // tile + margin)


def viewport(zoom: float, pan: tuple[float, float], canvas: tuple[int, int], full: tuple[int, int], preview_size: tuple[int, int], ds: int) -> tuple[int, int, int, int] | None:
    """Full-resolution bounds (y1, y2, x1, x2) of what a canvas shows, from the full image when zoomed in past half a preview pixel."""
    (cw, ch), (fh, fw), (ph, pw) = canvas, full, preview_size
    if cw < 10 or ch < 10:
        return None
    close = zoom > ds * 0.5
    scale, (h, w), unit = (zoom / ds, full, 1) if close else (zoom, preview_size, ds)
    cx, cy = (w / 2 - pan[0] / scale) * unit, (h / 2 - pan[1] / scale) * unit
    half_w, half_h = cw / 2 / scale * unit, ch / 2 / scale * unit
    y1, y2, x1, x2 = int(max(0, cy - half_h)), int(min(fh, cy + half_h)), int(max(0, cx - half_w)), int(min(fw, cx + half_w))
    return (y1, y2, x1, x2) if x2 > x1 and y2 > y1 else None


def brush_disc(spark, cy: float, cx: float, size: float, h: int, w: int, weight: float = 1.0) -> DataFrame:
    """(y, x, w): pixels within size of a point, the box around it held to the frame."""
    y1, y2, x1, x2 = max(0, int(cy - size)), min(h, int(cy + size) + 1), max(0, int(cx - size)), min(w, int(cx + size) + 1)
    box = spark.range(max(0, y2 - y1)).select((F.col("id") + y1).cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(x1), F.lit(max(x1, x2 - 1)))))
    return box.where(F.pow(F.col("y") - cy, F.lit(2)) + F.pow(F.col("x") - cx, F.lit(2)) <= size * size).select("y", "x", F.lit(weight).alias("w"))


def brush_line(points: DataFrame, size: float, step: float = 0.3) -> DataFrame:
    """Centres along strokes (stroke, x0, y0, x1, y1): a point each step * size, both ends with."""
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / max(1e-9, step * size)), F.lit(1)).cast("int")
    at = points.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("i") / F.col("n")
    return at.select("stroke", "i", (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("cx"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("cy"))


def paint(brush: DataFrame, disc: DataFrame, erase: bool = False) -> DataFrame:
    """The brush after a disc is painted (weights of the disc win) or erased."""
    if erase:
        return brush.join(disc.select("y", "x"), ["y", "x"], "left_anti")
    return brush.join(disc.select("y", "x"), ["y", "x"], "left_anti").unionByName(disc)


def brush_coverage(brush: DataFrame, size: int) -> DataFrame:
    """Percent of a frame of size pixels whose weight is over a half."""
    return brush.agg((100.0 * F.count_if(F.col("w") > 0.5) / size).alias("coverage_pct"))


def cells_under(labels: DataFrame, y1: int, y2: int, x1: int, x2: int) -> DataFrame:
    """Ids of the cells that a box touches."""
    return crop(labels, y1, y2, x1, x2).where(F.col("cell_id") != 0).select("cell_id").distinct()


def apply_brush(pixels: DataFrame, brush: DataFrame, cmin: float, cmax: float, brightness: float, alpha: float, max_value: float, ds: int = 1) -> DataFrame:
    """Pixels whose (preview) weight is over a half become v(1 - alpha) + n * max_value * alpha; others stay."""
    n = window_level(F.col("v"), F.lit(cmin), F.lit(cmax), F.lit(brightness))
    on = brush.select(F.col("y").alias("by"), F.col("x").alias("bx"), F.col("w").alias("bw"))
    near = (F.floor(F.col("y") / ds) == F.col("by")) & (F.floor(F.col("x") / ds) == F.col("bx"))
    return pixels.join(on, near, "left").select("y", "x", F.when(F.col("bw") > 0.5, F.col("v") * (1 - alpha) + n * max_value * alpha).otherwise(F.col("v").cast("double")).alias("v"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [x / sum(raw) for x in raw]


def _mirrored(first: int, last: int, n: int) -> np.ndarray:
    """Places first to last - 1 along a side of n pixels; beyond the edge the image is mirrored (its edge pixels twice)."""
    at = np.arange(first, last) % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def gaussian(pixels: DataFrame, sigma: float, h: int, w: int, tile: int = TILE) -> DataFrame:
    """Gaussian blur of a raster (y, x, v), absent pixels counting 0: (y, x, v) of every pixel of the tiles it reaches.

    A pixel goes to the tiles whose halo holds it, four at most, as tiles are no smaller than two halos; a task blurs one
    tile at a time, row by row and column by column, in arrays.
    """
    weights = np.asarray(gaussian_weights(sigma))
    reach = len(weights) // 2
    side = max(tile, 2 * reach)

    def numbers(axis: str, n: int) -> Column:
        low, high = F.floor((F.col(axis) - reach) / side), F.floor((F.col(axis) + reach) / side)
        return F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit((n - 1) // side)).cast("int"))

    def blur(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        y0, x0, y1, x1 = ty * side, tx * side, min(h, ty * side + side), min(w, tx * side + side)
        top, left = max(0, y0 - reach), max(0, x0 - reach)
        image = np.zeros((min(h, y1 + reach) - top, min(w, x1 + reach) - left))
        image[table.column("y").to_numpy() - top, table.column("x").to_numpy() - left] = table.column("v").to_numpy()
        wide = image[_mirrored(y0 - reach, y1 + reach, h) - top][:, _mirrored(x0 - reach, x1 + reach, w) - left]
        rows = sum(k * wide[i : i + y1 - y0] for i, k in enumerate(weights))
        out = sum(k * rows[:, i : i + x1 - x0] for i, k in enumerate(weights))
        y, x = np.mgrid[y0:y1, x0:x1]
        return pa.table([pa.array(y.reshape(-1).astype(np.int32)), pa.array(x.reshape(-1).astype(np.int32)), pa.array(out.reshape(-1))], names=["y", "x", "v"])

    inside = pixels.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w) & F.col("v").isNotNull())
    dealt = inside.select("y", "x", F.col("v").cast("double").alias("v"), F.explode(numbers("y", h)).alias("ty")).withColumn("tx", F.explode(numbers("x", w)))
    return dealt.groupBy("ty", "tx").applyInArrow(blur, "y int, x int, v double")


def feather(mask: DataFrame, h: int, w: int, sigma: float = 3.0) -> DataFrame:
    """A blurred mask held to [0, 1]."""
    return gaussian(mask, sigma, h, w).withColumn("v", F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)))


def feather_keep_inside(mask: DataFrame, h: int, w: int, n_pixels: int) -> DataFrame:
    """Feathering with sigma from the mask's size, rescaled to a greatest weight of 1; pixels of the mask keep weight 1."""
    blurred = gaussian(mask, max(2.0, 0.15 * math.sqrt(n_pixels)), h, w)
    top = blurred.agg(F.max("v").alias("top"))
    own = mask.where("v > 0").select("y", "x", F.lit(True).alias("own"))
    return blurred.join(F.broadcast(top)).join(own, ["y", "x"], "left").select("y", "x", F.when(F.col("own"), 1.0).otherwise(F.col("v") / F.nullif("top", F.lit(0.0))).alias("v"))


def mask_blend(base: DataFrame, changed: DataFrame, weights: DataFrame) -> DataFrame:
    """base(1 - w) + changed * w for each of r, g, b; without a weight the base."""
    other = changed.select("y", "x", *(F.col(c).alias(f"o_{c}") for c in "rgb"))
    on = base.join(other, ["y", "x"]).join(weights.select("y", "x", F.col("v").alias("w")), ["y", "x"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return on.select("y", "x", *((F.col(c) * (1 - F.col("w")) + F.col(f"o_{c}") * F.col("w")).alias(c) for c in "rgb"))


def tint(rgb: DataFrame, brush: DataFrame, colour: Sequence[int], alpha: float) -> DataFrame:
    """Brush overlay: pixels with weight over a half are blended with a colour."""
    on = rgb.join(brush.where("w > 0.5").select("y", "x", F.lit(True).alias("on")), ["y", "x"], "left")
    return on.select("y", "x", *(F.when(F.col("on"), (F.col(c) * (1 - alpha) + p * alpha).cast("int")).otherwise(F.col(c)).alias(c) for c, p in zip("rgb", colour)))


def max_merge(labels: DataFrame) -> DataFrame:
    """Overlapping label masks: the greatest id wins."""
    return labels.groupBy("y", "x").agg(F.max("cell_id").alias("cell_id"))


def params_changed(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of by (columns of both): whether any channel's window moved by more than 1, or its brightness or gamma by more than 0.05."""
    on = a.alias("a").join(b.alias("b"), [*by, "ch_idx"], "full")
    far = lambda c, t: F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > t, F.lit(True))
    return on.groupBy(*by).agg(F.coalesce(F.bool_or(far("min", 1) | far("max", 1) | far("brightness", 0.05) | far("gamma", 0.05)), F.lit(False)).alias("changed"))


def params_hash(params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A hash of all display parameters, or of those of each value of by, for caches; exact, without rounding: SHA-256 of a line for each channel."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("ch_idx", "visible", "min", "max", "brightness", "gamma")))
    lines = F.array_sort(F.collect_list(F.struct("ch_idx", line.alias("line"))))
    return params.groupBy(*by).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("params_hash"))


def source_pixel(px: Column, py: Column, ds: int, full_h: int, full_w: int) -> Column:
    """struct<y, x> of the full-resolution pixel under a preview position; null outside the frame."""
    y, x = (py * ds).cast("int"), (px * ds).cast("int")
    return F.when((y >= 0) & (y < full_h) & (x >= 0) & (x < full_w), F.struct(y.alias("y"), x.alias("x")))


def zoomed(zoom: float, steps: int, factor: float = 1.35, floor: float = 0.01) -> float:
    return max(floor, zoom * factor**steps)


def zoomed_at(zoom: Column, pan: Column, pointer: Column, steps: Column, factor: float = 1.35, floor: float = 0.01) -> Column:
    """struct<zoom, pan> after steps of the wheel at a pointer, whose image position stays where it is."""
    new = F.greatest(F.lit(floor), zoom * F.pow(F.lit(factor), steps))
    return F.struct(new.alias("zoom"), (pointer - (pointer - pan) * new / zoom).alias("pan"))
