"""Overlays of cells on images: outlines, value maps, phenotype maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import cell_hue, hex_part, hsv_channel
from .labels import boundary, dilated

DARK = (10, 11, 16)


def outline(rgb: DataFrame, labels: DataFrame, colour: Sequence[int], thickness: int = 1, h: int = 0, w: int = 0) -> DataFrame:
    """rgb with cell boundaries in a colour; thicker ones are dilated."""
    edge = boundary(labels).select("y", "x")
    edge = dilated(edge, thickness - 1, h, w) if thickness > 1 else edge
    on = rgb.join(edge.withColumn("on", F.lit(True)), ["y", "x"], "left")
    return on.select("y", "x", *(F.when(F.col("on"), p).otherwise(F.col(c)).alias(c) for c, p in zip("rgb", colour)))


def unique_colours(cells: DataFrame) -> DataFrame:
    """(cell_id, r, g, b): a hue for each cell by steps of the golden ratio."""
    return cells.select("cell_id", *(hsv_channel(cell_hue(F.col("cell_id")), c).alias(c) for c in "rgb"))


def unique_outline(labels: DataFrame) -> DataFrame:
    """(y, x, cell_id, r, g, b) of boundary pixels in their cell's own colour."""
    return boundary(labels).select("y", "x", "cell_id", *(hsv_channel(cell_hue(F.col("cell_id")), c).alias(c) for c in "rgb"))


def scaled_values(cells: DataFrame, value_col: str) -> DataFrame:
    """(cell_id, n): a value in [0, 1] over its range; constant: 0."""
    span = cells.agg(F.min(value_col).alias("lo"), F.max(value_col).alias("hi"))
    return cells.join(F.broadcast(span)).select("cell_id", F.when(F.col("hi") > F.col("lo"), (F.col(value_col) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("n"))


def ramp_of(stops: DataFrame | Sequence[Sequence[int]], n: Column) -> list[Column]:
    """Linear colour ramp through stops at equal distances."""
    k = len(stops) - 1
    at = F.least(F.floor(n * k), F.lit(k - 1)).cast("int")
    t = n * k - at
    take = lambda part, i: F.element_at(F.array(*(F.lit(float(s[part])) for s in stops)), i + 1)
    return [F.floor(take(p, at) + (take(p, at + 1) - take(p, at)) * t).cast("int") for p in range(3)]


# Stops of the default value map, dark to bright.
VALUE_STOPS = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))


def value_map(labels: DataFrame, cells: DataFrame, value_col: str, background: Sequence[int] = DARK, edges: bool = False) -> DataFrame:
    """(y, x, r, g, b): each pixel in the colour of its cell's value; cells without one, and the background, are dark; boundaries white."""
    n = scaled_values(cells, value_col)
    on = labels.join(n, "cell_id", "left")
    got = on.select("y", "x", "cell_id", *(F.when(F.col("n").isNull() | (F.col("cell_id") <= 0), b).otherwise(c).alias(p) for p, c, b in zip("rgb", ramp_of(VALUE_STOPS, F.col("n")), background)))
    return (white_edges(got, labels) if edges else got).select("y", "x", "r", "g", "b")


def white_edges(rgb: DataFrame, labels: DataFrame) -> DataFrame:
    on = rgb.join(boundary(labels).select("y", "x", F.lit(True).alias("on")), ["y", "x"], "left")
    return on.select(*(F.when(F.col("on"), 255).otherwise(F.col(c)).alias(c) if c in "rgb" else F.col(c) for c in rgb.columns))


def phenotype_map(labels: DataFrame, cells: DataFrame, colours: DataFrame, background: Sequence[int] = DARK) -> DataFrame:
    """(y, x, r, g, b) by phenotype: cells (cell_id, phenotype), colours (phenotype, colour as #rrggbb); what has none is dark."""
    own = cells.join(colours, "phenotype").select("cell_id", "colour")
    on = labels.join(own, "cell_id", "left")
    return on.select("y", "x", *(F.when(F.col("colour").isNull() | (F.col("cell_id") <= 0), b).otherwise(hex_part(F.col("colour"), k)).alias(p) for k, (p, b) in enumerate(zip("rgb", background))))


def blend_value(rgb: DataFrame, mapped: DataFrame, alpha: float = 0.4) -> DataFrame:
    """A value map laid over an image."""
    over = mapped.select("y", "x", *(F.col(c).alias(f"o_{c}") for c in "rgb"))
    return rgb.join(over, ["y", "x"]).select("y", "x", *(F.floor(F.col(c) * (1 - alpha) + F.col(f"o_{c}") * alpha).cast("int").alias(c) for c in "rgb"))


def group_overlay(rgb: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Half blend of group colours (cell_id, ord, r, g, b); later groups over earlier ones."""
    over = groups.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("r").cast("double").alias("r"), F.col("g").cast("double").alias("g"), F.col("b").cast("double").alias("b")))).alias("l"))
    on = rgb.join(labels, ["y", "x"], "left").join(over, "cell_id", "left")
    fold = lambda c: F.aggregate(F.coalesce("l", F.array().cast("array<struct<ord:bigint,r:double,g:double,b:double>>")), F.col(c).cast("double"), lambda a, s: F.floor(a * 0.5 + s[c] * 0.5).cast("double"))
    return on.select("y", "x", *(fold(c).cast("int").alias(c) for c in "rgb"))


def scatter(cells: DataFrame, x_col: str, y_col: str, colour_col: str) -> DataFrame:
    n = scaled_values(cells, colour_col)
    return cells.select("cell_id", F.col(x_col).alias("px"), F.col(y_col).alias("py")).join(n, "cell_id")
