"""CSV sinks of cell, region and group tables, and reads that do not fail on what is missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, formats: Mapping[str, str] | None = None, one_file: bool = False) -> None:
    """A table with a header; formats (column to printf pattern) apply at this edge only. One file means one last task."""
    out = df.select(*(F.format_string(formats[c], c).alias(c) if formats and c in formats else F.col(c) for c in df.columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


# Formats of the region table.
ROI_FORMATS = {"center_x": "%.1f", "center_y": "%.1f", "width_px": "%.0f", "height_px": "%.0f", "mean": "%.4f", "std": "%.4f", "median": "%.4f", "min_v": "%.4f", "max_v": "%.4f", "ratio": "%.4f", "adj_min": "%.0f", "adj_max": "%.0f", "brightness": "%.2f"}


def roi_table(stats: DataFrame, rois: DataFrame | None, params: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The region and channel statistics with geometry, channel and display settings; without regions one whole image."""
    if rois is None:
        geo = stats.select("roi_name").distinct().select("roi_name", F.lit("full").alias("roi_type"), *(F.lit(0.0).alias(c) for c in ("center_x", "center_y", "width_px", "height_px")))
    else:
        geo = rois.select(F.col("name").alias("roi_name"), "roi_type", ((F.col("x1") + F.col("x2")) / 2).alias("center_x"), ((F.col("y1") + F.col("y2")) / 2).alias("center_y"), (F.col("x2") - F.col("x1")).alias("width_px"), (F.col("y2") - F.col("y1")).alias("height_px"))
    named = params.select("ch_idx", F.col("name").alias("channel"), "color_name", F.col("min").alias("adj_min"), F.col("max").alias("adj_max"), "brightness")
    out = stats.join(geo, "roi_name").join(named, "ch_idx")
    if notes is not None:
        out = out.join(notes.withColumnRenamed("name", "roi_name"), "roi_name", "left")
    order = ["roi_name", "roi_type", "center_x", "center_y", "width_px", "height_px", "channel", "color_name", "mean", "std", "median", "min_v", "max_v", "ratio", "adj_min", "adj_max", "brightness"]
    return out.select(*order, *(["notes"] if notes is not None else []))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a schema; unreadable ones, and a path without files, give no rows."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where("_bad is null").drop("_bad")


def source_files(spark: SparkSession, root: str, skip: str = ".versions") -> DataFrame:
    """(path, text) of the Python files under a folder, without those of a skipped folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    return files.where(~F.col("path").contains(f"/{skip}/")).select("path", F.decode("content", "UTF-8").alias("text"))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the image files under a folder; contents are not read."""
    from .raster import EXTENSIONS

    glob = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
