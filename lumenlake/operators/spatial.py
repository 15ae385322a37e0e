"""Neighbours of cells: radius joins and nearest cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _bucket(c: Column, radius: float) -> Column:
    return F.floor(c / radius).cast("bigint")


def radius_join(cells: DataFrame, radius: float) -> DataFrame:
    """(src, dst, dist) of all ordered pairs of different cells (cell_id, y, x) within radius, ends with.

    Cells fall into square buckets of one radius; one side is copied to the nine buckets around its own, so the pairs are
    found by an equi-join, which shuffles and spills like any other, and AQE splits a crowded bucket.
    """
    one = cells.select(F.col("cell_id").alias("src"), F.col("y").alias("sy"), F.col("x").alias("sx"))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    one = one.withColumn("dy", near).withColumn("dx", near).select("src", "sy", "sx", (_bucket(F.col("sy"), radius) + F.col("dy")).alias("by"), (_bucket(F.col("sx"), radius) + F.col("dx")).alias("bx"))
    two = cells.select(F.col("cell_id").alias("dst"), F.col("y").alias("ty"), F.col("x").alias("tx")).withColumns({"by": _bucket(F.col("ty"), radius), "bx": _bucket(F.col("tx"), radius)})
    dist = F.sqrt(F.pow(F.col("sy") - F.col("ty"), F.lit(2)) + F.pow(F.col("sx") - F.col("tx"), F.lit(2)))
    return one.join(two, ["by", "bx"]).withColumn("dist", dist).where((F.col("dist") <= radius) & (F.col("src") != F.col("dst"))).select("src", "dst", "dist")


def adjacency(cells: DataFrame, radius: float) -> DataFrame:
    """(cell_id, neighbours): the sorted ids within radius of every cell, empty where there are none."""
    lists = radius_join(cells, radius).groupBy(F.col("src").alias("cell_id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    return cells.select("cell_id").join(lists, "cell_id", "left").select("cell_id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def degrees(cells: DataFrame, radius: float) -> DataFrame:
    counts = radius_join(cells, radius).groupBy(F.col("src").alias("cell_id")).agg(F.count("*").alias("degree"), F.avg("dist").alias("mean_dist"))
    return cells.select("cell_id").join(counts, "cell_id", "left").select("cell_id", F.coalesce("degree", F.lit(0)).alias("degree"), "mean_dist")


def _distance(y: float | Column, x: float | Column) -> Column:
    return F.sqrt(F.pow(F.col("y") - y, F.lit(2)) + F.pow(F.col("x") - x, F.lit(2)))


def nearest(cells: DataFrame, y: float, x: float, k: int) -> DataFrame:
    """The k nearest cells of a point, ties by id: a top-k, not a sort."""
    return cells.select("cell_id", _distance(y, x).alias("dist")).orderBy("dist", "cell_id").limit(k)


def within(cells: DataFrame, y: float, x: float, radius: float) -> DataFrame:
    """Cells within radius of a point, a cell there included; the box goes to the scan."""
    box = cells.where(F.col("y").between(y - radius, y + radius) & F.col("x").between(x - radius, x + radius))
    return box.select("cell_id", _distance(y, x).alias("dist")).where(F.col("dist") <= radius)


def _radius_for(cells: DataFrame, k: int) -> float:
    """A radius that holds k cells where they lie evenly: one aggregate row gives the area and the number of cells."""
    x = cells.agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("h"), (F.max("x") - F.min("x")).alias("w")).first()
    area = (x["h"] or 0.0) * (x["w"] or 0.0) or max(x["h"] or 0.0, x["w"] or 0.0, 1.0) ** 2
    return 1.5 * (area * (k + 1) / (3.14159 * max(1, x["n"]))) ** 0.5


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "cell_id"))).where(F.col("rank") <= k)


def nearest_of(cells: DataFrame, queries: DataFrame, k: int, first_radius: float | None = None, growth: float = 3.0) -> DataFrame:
    """(query_id, cell_id, dist, rank): the k nearest cells of every query (query_id, qy, qx), all cells if there are fewer.

    Radii grow until each query has k cells within the radius, so only queries in thin regions go on; each round is a
    bucketed equi-join, of which every task keeps the k nearest of each query before anything is shuffled by query. The
    radius ends at last beyond the farthest cell, so no query is left. Cells and queries without a place are left out.
    """
    placed = lambda df, y, x: df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.isnan(y) & ~F.isnan(x))
    cells = written(placed(cells.select("cell_id", "y", "x"), "y", "x"), "cells")
    left, radius, found = written(placed(queries.select("query_id", "qy", "qx"), "qy", "qx"), "queries"), first_radius or _radius_for(cells, k), None
    want = min(k, cells.count())
    dist = F.sqrt(F.pow(F.col("qy") - F.col("y"), F.lit(2)) + F.pow(F.col("qx") - F.col("x"), F.lit(2)))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while True:
        q = left.withColumn("dy", near).withColumn("dx", near).withColumns({"by": _bucket(F.col("qy"), radius) + F.col("dy"), "bx": _bucket(F.col("qx"), radius) + F.col("dx")})
        c = cells.withColumns({"by": _bucket(F.col("y"), radius), "bx": _bucket(F.col("x"), radius)})
        ranked = written(_ranked(q.join(c, ["by", "bx"]).select("query_id", "cell_id", dist.alias("dist")).where(F.col("dist") <= radius), k), "nearest")
        full = ranked.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= want).select("query_id")
        done = ranked.join(full, "query_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        left = written(left.join(full, "query_id", "left_anti"), "queries")
        if not want or left.isEmpty():
            return found
        radius *= growth


# --- an index on a space-filling curve

#: Bits of each coordinate in a place's number on the curve.
CURVE_BITS = 31


def _spaced(c: Column) -> Column:
    """The low CURVE_BITS bits of c, a zero between each two."""
    # The masks of the usual doubling steps.
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


class CurveIndex:
    """Cells (cell_id, y, x) in files along a Z-order curve, with a table of each file's box: radius and nearest queries read the files they touch.

    Cells are sorted by ranges of the curve and written once; each range is a file, and its box is taken from what was
    written. A query asks the table of boxes, one row a file, for files that its circle meets, and reads no other.
    Cells without a place (null or NaN) are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        self._boxes = spark.read.parquet(f"{path}/boxes")

    @classmethod
    def write(cls, cells: DataFrame, path: str, files: int | None = None) -> CurveIndex:
        """files: ranges to cut the curve into; None leaves the number to the session."""
        spark = cells.sparkSession
        placed = cells.select("cell_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).where("y is not null and x is not null and not isnan(y) and not isnan(x)")
        around = placed.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
        low_y, high_y, low_x, high_x = (float(v or 0.0) for v in around)
        top = (1 << CURVE_BITS) - 1
        step = lambda c, low, high: F.floor((F.col(c) - low) / (max(high - low, 1e-300)) * top).cast("long")
        z = F.shiftleft(_spaced(step("y", low_y, high_y)), 1).bitwiseOR(_spaced(step("x", low_x, high_x)))
        rows = placed.withColumn("z", z)
        rows = rows.repartitionByRange(files, "z", "cell_id") if files else rows.repartitionByRange("z", "cell_id")
        rows.sortWithinPartitions("z", "cell_id").write.mode("overwrite").parquet(f"{path}/cells")
        stored = spark.read.parquet(f"{path}/cells")
        boxes = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.count("*").alias("n"))
        boxes.write.mode("overwrite").parquet(f"{path}/boxes")
        return cls(spark, path)

    def _far(self, y: float, x: float) -> Column:
        """The distance of a file's box from a place."""
        off = lambda at, low, high: F.greatest(F.col(low) - at, F.lit(at) - F.col(high), F.lit(0.0))
        return F.sqrt(F.pow(off(y, "y1", "y2"), F.lit(2)) + F.pow(off(x, "x1", "x2"), F.lit(2)))

    def _files(self, files: list[str]) -> DataFrame:
        if not files:
            return self._spark.createDataFrame([], "cell_id long, y double, x double")
        return self._spark.read.parquet(*files)

    def within(self, y: float, x: float, radius: float) -> DataFrame:
        """(cell_id, dist) of cells within radius of a place, as spatial.within."""
        files = [r.file for r in self._boxes.where(self._far(y, x) <= radius).select("file").collect()]  # those the circle meets
        return within(self._files(files), y, x, radius)

    def nearest(self, y: float, x: float, k: int) -> DataFrame:
        """(cell_id, dist) of the k nearest cells, ties by id, as spatial.nearest.

        The files with the nearest boxes that hold k cells together bound the distance; all files within it are read.
        """
        far = self._far(y, x)
        upto = F.sum("n").over(Window.orderBy("far", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        first = [r.file for r in self._boxes.select("file", "n", far.alias("far")).orderBy("far", "file").limit(max(1, k)).withColumn("before", upto).where(F.col("before") < k).select("file").collect()]
        reached = nearest(self._files(first), y, x, k).agg(F.max("dist")).first()[0] if first else None
        if reached is None:
            return nearest(self._files([]), y, x, k)
        files = [r.file for r in self._boxes.where(far <= reached).select("file").collect()]
        return nearest(self._files(files), y, x, k)
