"""Folder watch: cell tables that arrive as files become running phenotype counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.phenotype import assign_phenotypes


def watch_cells(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A stream of the cell tables (Parquet) that are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def running_counts(cells: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """(phenotype, n) of a stream of cells; state is one row a phenotype."""
    return assign_phenotypes(cells, thresholds).groupBy("phenotype").count().withColumnRenamed("count", "n")
