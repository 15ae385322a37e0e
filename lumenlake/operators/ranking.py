"""Numbers in a total order, and exact quantiles, without a window over a whole table or group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows with name: 1, 2, ... in the order given, which must tell rows apart.

    Rows are sorted by ranges and written with the number of their range, so that number is data and not evaluated again;
    each range is numbered alone, and the counts of the ranges before it, one row a range, are added.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.withColumn("__nth", nth).join(counts, "__range").withColumn(name, (F.col("__nth") + F.col("__before")).cast("long")).drop("__range", "__nth", "__before")


#: Bins of one pass, and so many values of an interval that they are sorted at last.
BINS, FINISH = 4096, 200_000


def value_counts(rows: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """(by, v, k): each group's values with their numbers of times, written: samples repeat, and what makes them may be costly."""
    return written(rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k")), "values")


def quantiles(rows: DataFrame, by: Sequence[str], probs: Sequence[float], value: str = "v", counted: bool = False) -> DataFrame:
    """(by, q): exact quantiles of each group's values, an array in the order of probs, by linear interpolation.

    Nulls and NaN are left out; a group without values has no row. Values are counted and written once (counted: rows are
    from value_counts already). Groups of at most FINISH different values are aggregated as they are. Of the others a pass
    counts each group's values in BINS bins, with each bin's least and greatest, and every rank that is asked for moves into
    the bin that holds it; this goes on until no such bin holds more than FINISH values that differ, and those alone are
    sorted. So a group of any size is counted map-side in every pass, and no task holds more than FINISH values of a group.
    """
    keys = list(by)
    rows = (rows if counted else value_counts(rows, keys, value)).where("v is not null and not isnan(v)")
    spans = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("k").alias("n"), F.count("*").alias("different"))
    plain = lambda r: r.groupBy(*keys).agg(F.percentile("v", F.array(*(F.lit(float(p)) for p in probs)), F.col("k")).alias("q"))
    if rows.count() <= FINISH:
        return plain(rows).where("q is not null")
    spans = written(spans, "spans")
    large = spans.where(F.col("different") > FINISH)
    if keys and large.isEmpty():
        return plain(rows)
    if keys:
        return plain(rows.join(large.select(*keys), keys, "left_anti")).unionByName(_of_large(rows.join(large.select(*keys), keys, "left_semi"), large, keys, probs))
    return _of_large(rows, spans, keys, probs)


def _of_large(rows: DataFrame, spans: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array(*(f(at(p)).cast("long") for p in probs for f in (F.floor, F.ceil)))
    wanted = spans.select(*keys, F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("different").alias("size"))
    same = [*keys, "lo", "hi"]

    def inside(targets: DataFrame) -> DataFrame:
        spaces = targets.select(*same).distinct()
        return (rows.join(spaces, keys) if keys else rows.crossJoin(spaces)).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))

    while (wanted.where("lo < hi").agg(F.max("size")).first()[0] or 0) > FINISH:
        open_ = wanted.where("lo < hi")
        share = F.nanvl((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))  # ends may be infinite
        bin_ = F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int").alias("bin")
        counts = inside(open_).groupBy(*same, bin_).agg(F.sum("k").alias("k"), F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(*same).orderBy("bin")))
        moved = open_.join(upto, same).where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("k")))
        moved = moved.select(*keys, "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("upto") - F.col("k")).alias("below"), F.col("held").alias("size"))
        last, wanted = wanted, written(moved.unionByName(wanted.where("lo = hi")), "ranks")
        discard(last)
    counts = inside(wanted.where("lo < hi")).groupBy(*same, "v").agg(F.sum("k").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(*same).orderBy("v")))
    last = wanted.where("lo < hi").join(upto, same).where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("k")))
    found = last.select(*keys, "rank", "v").unionByName(wanted.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    found = found.join(spans.select(*keys, "n"), keys) if keys else found.crossJoin(spans.select("n"))
    low, high = (lambda p: F.element_at("of", F.floor(at(p)).cast("long"))), (lambda p: F.element_at("of", F.ceil(at(p)).cast("long")))
    return found.select(*keys, F.array(*(low(p) + (high(p) - low(p)) * (at(p) - F.floor(at(p))) for p in probs)).alias("q"))
