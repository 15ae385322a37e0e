"""Per-cell quantification: labelled pixels to a cell table.

Pixels are wide (a column for each channel beside y, x and cell_id) or long (ch_idx, v). Label 0 is background. Means and
sums combine map-side; the exact median keeps a value-to-count map for each cell, whose size is the cell's, so one giant
label is the only skew, and median_mode="approx" bounds it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _median(c: Column, mode: str) -> Column:
    return F.median(c) if mode == "exact" else F.percentile_approx(c, 0.5, 10_000).cast("double")


def quantify_cells(pixels: DataFrame, channels: Mapping[str, str], cell_col: str = "cell_id", median_mode: str = "exact") -> DataFrame:
    """cell_id, centroid_y, centroid_x, area, then mean, median and total of each channel; channels: name to column."""
    measures = [x for name, c in channels.items() for x in (F.avg(c).alias(f"mean_{name}"), _median(F.col(c), median_mode).alias(f"median_{name}"), F.sum(F.col(c).cast("double")).alias(f"total_{name}"))]
    return (
        pixels.where(F.col(cell_col) > 0)
        .groupBy(F.col(cell_col).alias("cell_id"))
        .agg(F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), F.count("*").cast("int").alias("area"), *measures)
    )


def quantify_region(pixels: DataFrame, channels: Mapping[str, str], y1: int, y2: int, x1: int, x2: int, **kw) -> DataFrame:
    """The same over a half-open crop; coordinates are absolute already, so centroids need no shift."""
    return quantify_cells(pixels.where((F.col("y") >= y1) & (F.col("y") < y2) & (F.col("x") >= x1) & (F.col("x") < x2)), channels, **kw)


def with_labels(pixels: DataFrame, labels: DataFrame, keys: Sequence[str] = ("image_id", "y", "x")) -> DataFrame:
    """Pixels beside their labels; an equi-join on position, co-located where both are bucketed or tiled alike."""
    return pixels.join(labels, list(keys))


def cells_long(cells: DataFrame, markers: Sequence[str]) -> DataFrame:
    """(cell_id, marker, mean, median, total) of a wide cell table."""
    rows = F.array(*(F.struct(F.lit(m).alias("marker"), *(F.col(f"{k}_{m}").alias(k) for k in ("mean", "median", "total"))) for m in markers))
    return cells.select("cell_id", F.inline(rows))


def cell_counts(labels: DataFrame, cell_col: str = "cell_id") -> DataFrame:
    """The three measures of "number of cells": greatest id, distinct values less one, and distinct ids over 0."""
    c = F.col(cell_col)
    return labels.agg(F.max(c).cast("long").alias("max_id"), (F.countDistinct(c) - 1).alias("distinct_less_one"), F.countDistinct(F.when(c > 0, c)).alias("distinct_cells"))


def distinct_labels(labels: DataFrame, cell_col: str = "cell_id") -> DataFrame:
    return labels.where(F.col(cell_col) > 0).select(F.col(cell_col).alias("cell_id")).distinct()


def measured_like(cells: DataFrame, value: str) -> Column:
    """A marker's mean column, or nulls where the table has none."""
    return F.col(f"mean_{value}") if f"mean_{value}" in cells.columns else F.lit(None).cast("double")
