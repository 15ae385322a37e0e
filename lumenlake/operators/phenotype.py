"""Thresholds, positivity and combinatorial phenotypes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MINUS
from ..sources.scratch import written
from .quantify import measured_like
from .ranking import numbered, quantiles

OTSU_BINS = 256


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def is_positive(c: Column, threshold: Column | float) -> Column:
    """c >= threshold; NaN and null are negative (Spark would sort NaN above every number)."""
    return F.coalesce(~F.isnan(c) & (c >= threshold), F.lit(False))


def thresholds_by(cells: DataFrame, markers: Sequence[str], method: str = "otsu") -> DataFrame:
    """(marker, threshold) by otsu, median (of values over 0), or percentile (the 75th); any other method is the median."""
    values = cells.select(F.inline(F.array(*(F.struct(F.lit(m).alias("marker"), finite(measured_like(cells, m).cast("double")).alias("v")) for m in markers))))
    if method == "otsu":
        return otsu(values)
    some = values if method == "percentile" else values.where("v > 0")
    found = quantiles(some, ["marker"], (0.75 if method == "percentile" else 0.5,)).select("marker", F.get("q", 0).alias("threshold"))
    every = cells.sparkSession.createDataFrame([(m,) for m in markers], "marker string")
    return every.join(found, "marker", "left").select("marker", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def otsu(values: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """(marker, threshold) of values(marker, v): the bin centre of the greatest between-class variance.

    One pass finds each marker's range (one row a marker, joined back), one counts bins; the cumulative sums run over
    at most bins rows a marker. A constant marker's threshold is its value, one without values has 0.
    """
    spans = values.groupBy("marker").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    counts = values.where("v is not null").join(spans, "marker").where("hi > lo").groupBy("marker", "lo", "hi", bin_of.alias("bin")).agg(F.count("*").alias("n"))
    every = spans.where("hi > lo").select("marker", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    hist = every.join(counts.select("marker", "bin", "n"), ["marker", "bin"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "centre": F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins})
    upto, whole = Window.partitionBy("marker").orderBy("bin"), Window.partitionBy("marker")
    sums = hist.withColumns({
        "w1": F.sum("n").over(upto), "m1": F.sum(F.col("n") * F.col("centre")).over(upto), "w": F.sum("n").over(whole), "m": F.sum(F.col("n") * F.col("centre")).over(whole),
    })
    w1, w2 = F.col("w1"), F.col("w") - F.col("w1")
    between = F.when((w1 > 0) & (w2 > 0), w1 * w2 * F.pow(F.col("m1") / w1 - (F.col("m") - F.col("m1")) / w2, F.lit(2)))
    # the first bin of the greatest variance, as far as doubles tell
    best = sums.withColumn("var", F.round(between, 6)).groupBy("marker").agg(F.max_by("centre", F.struct("var", -F.col("bin"))).alias("threshold"))
    return spans.join(best, "marker", "left").select("marker", F.coalesce("threshold", "lo", F.lit(0.0)).alias("threshold"))


def assign_phenotypes(cells: DataFrame, thresholds: Mapping[str, float], markers: Sequence[str] | None = None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """cells with phenotype: label+ or label- (U+2212) of every marker in order; without markers "no markers"."""
    order = sorted(thresholds) if markers is None else list(markers)
    if not order:
        return cells.withColumn("phenotype", F.lit("no markers"))
    part = lambda m: F.concat(F.lit((labels or {}).get(m, m)), F.when(is_positive(measured_like(cells, m), float(thresholds[m])), "+").otherwise(MINUS))
    return cells.withColumn("phenotype", F.concat_ws(" ", *(part(m) for m in order)))


def assign_by_table(long_cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(cell_id, phenotype) of long cells (cell_id, marker, mean) by a table (marker, pos, label, included, threshold).

    The thresholds stay a table, so markers may be many and their number need not be known.
    """
    sign = F.when(is_positive(F.col("mean"), F.col("threshold")), "+").otherwise(MINUS)
    part = F.concat(F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("marker")), sign)
    rows = long_cells.join(thresholds.where("included"), "marker").select("cell_id", F.struct("pos", part.alias("part")).alias("p"))
    return rows.groupBy("cell_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), " ").alias("phenotype"))


#: Phenotypes that are ranked in one task, at most.
ONE_SORT = 100_000


def phenotype_counts(phenotypes: DataFrame) -> DataFrame:
    """(phenotype, n, first_cell, rank, pct): most frequent first, ties by the first cell seen."""
    counted = phenotypes.groupBy("phenotype").agg(F.count("*").alias("n"), F.min("cell_id").alias("first_cell"))
    counted = written(counted, "phenotypes")
    total = counted.agg(F.sum("n").alias("total"))
    order = [F.desc("n"), F.col("first_cell"), F.col("phenotype")]
    # so few rows are one sort of one task, more are sorted by ranges: the numbers are the same
    ranked = counted.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if counted.count() <= ONE_SORT else numbered(counted, order, "rank")
    return ranked.crossJoin(total).select("phenotype", "n", "first_cell", F.col("rank").cast("int").alias("rank"), (100.0 * F.col("n") / F.col("total")).alias("pct"))


def top_with_other(counts: DataFrame, k: int = 12) -> DataFrame:
    """(slice, n): the k most frequent phenotypes, and one row for the other types if there are any."""
    rest = counts.where(F.col("rank") > k).agg(F.sum("n").alias("n"), F.count("*").alias("types")).where("types > 0")
    return counts.where(F.col("rank") <= k).select(F.col("phenotype").alias("slice"), "n").unionByName(rest.select(F.format_string("Other (%d types)", "types").alias("slice"), "n"))


def positive_percent(cells: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """(marker, n_positive, pct) of every marker in one pass."""
    found = cells.agg(F.count("*").alias("n"), *(F.count_if(is_positive(measured_like(cells, m), float(t))).alias(f"p_{i}") for i, (m, t) in enumerate(thresholds.items())))
    rows = F.array(*(F.struct(F.lit(m).alias("marker"), F.col(f"p_{i}").alias("n_positive"), (100.0 * F.col(f"p_{i}") / F.greatest(F.col("n"), F.lit(1))).alias("pct")) for i, m in enumerate(thresholds)))
    return found.select(F.inline(rows))


def palette_colour(rank: Column, palette: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, palette)), ((rank - 1) % len(palette) + 1).cast("int"))
