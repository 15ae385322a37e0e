"""Region, channel and group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import window_level
from ..sources.scratch import checked_small, written
from .ranking import quantiles, value_counts

SIGNAL = 0.01
#: Rows of display settings, one a channel, that are sent to all tasks, at most; about 100 bytes each.
MAX_SETTINGS = 65_536


def adjusted(pixels: DataFrame, params: DataFrame, gamma: bool = False) -> DataFrame:
    """Pixels (ch_idx, v) with n, their window-levelled value, for visible channels; params has a row for each channel.

    The settings go to the pixels, which stay where they are: see MAX_SETTINGS.
    """
    n = window_level(F.col("v"), F.col("min"), F.col("max"), F.col("brightness"), F.col("gamma") if gamma else None)
    return pixels.join(checked_small(params.where("visible"), MAX_SETTINGS), "ch_idx").withColumn("n", n)


def reference_channel(params: DataFrame) -> DataFrame:
    """One row: the first channel whose name has dapi in it, else 0."""
    return params.agg(F.coalesce(F.min(F.when(F.lower("name").contains("dapi"), F.col("ch_idx"))), F.lit(0)).alias("ref_idx"))


def intensity_ratios(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """(ch_idx, ratio, sem, std): each visible channel's mean signal over the reference channel's.

    Signal is over 0.01; with ten values or fewer the reference counts 1 and others 0; a reference under 0.001 counts 1.
    The reference row itself is left out. std is the population deviation over the same mean, sem that over the root of n.
    """
    n = F.col("n")
    strong = adjusted(pixels, params).groupBy("ch_idx").agg(F.avg(F.when(n > SIGNAL, n)).alias("m"), F.stddev_pop(F.when(n > SIGNAL, n)).alias("sd"), F.count_if(n > SIGNAL).alias("k"))
    enough = lambda c, other: F.when(F.col("k") > 10, c).otherwise(F.lit(other))
    stats = strong.select("ch_idx", enough(F.col("m"), 0.0).alias("m"), enough(F.col("sd"), 0.0).alias("sd"), enough(F.col("sd") / F.sqrt("k"), 0.0).alias("sem"), "k")
    ref = reference_channel(params)
    base = stats.join(F.broadcast(ref), stats["ch_idx"] == ref["ref_idx"]).select("ref_idx", F.when(F.col("k") > 10, F.col("m")).otherwise(1.0).alias("r"))
    base = base.select("ref_idx", F.when(F.col("r") < 0.001, 1.0).otherwise(F.col("r")).alias("r"))
    return stats.join(F.broadcast(base), F.col("ch_idx") != F.col("ref_idx")).select("ch_idx", (F.col("m") / F.col("r")).alias("ratio"), (F.col("sem") / F.col("r")).alias("sem"), (F.col("sd") / F.col("r")).alias("std"))


def _counted_stats(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mean, std, min, max, total, n) of values with numbers of times; the deviation is taken from the mean itself."""
    v, k = F.col("v"), F.col("k")
    found = counts.groupBy(*by).agg(F.sum(v * k).alias("total"), F.sum(k).alias("n"), F.min(v).alias("min"), F.max(v).alias("max")).withColumn("mean", F.col("total") / F.col("n"))
    means = found.select(*by, F.col("mean").alias("m"))
    off = counts.join(means, list(by)).groupBy(*by).agg((F.sum(k * F.pow(v - F.col("m"), F.lit(2))) / F.sum(k)).alias("var"))
    return found.join(off, list(by), "left").withColumn("std", F.sqrt("var")).drop("var")


def raw_stats(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics of the values over 0, of all channels; a group without any has zeros. Samples are counted by value first, in one pass."""
    counts = value_counts(pixels, by)
    some = counts.where("v > 0")
    sizes = counts.groupBy(*by).agg(F.sum("k").alias("n_total"), F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("k"))), F.lit(0)).cast("long").alias("n_nonzero"))
    found = sizes.join(_counted_stats(some, by).drop("n"), list(by), "left").join(quantiles(some, by, (0.5, 0.05, 0.25, 0.75, 0.95), counted=True), list(by), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sem = F.col("std") / F.sqrt(F.nullif("n_nonzero", F.lit(0)))
    return found.select(
        *by, *(zero(F.col(c).cast("double")).alias(c) for c in ("mean", "std", "min", "max", "total")), zero(sem).alias("sem"), "n_total", "n_nonzero",
        *(zero(F.get("q", i)).alias(name) for i, name in enumerate(("median", "p5", "p25", "p75", "p95"))),
    )


def adjusted_stats(pixels: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics of signal over 0.01 by group and channel, with the ratio to the group's reference channel (1 for itself)."""
    n = F.col("n")
    s = F.when(n > SIGNAL, n)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = adjusted(pixels, params)
    found = rows.groupBy(*by, "ch_idx").agg(zero(F.avg(s)).alias("mean"), zero(F.stddev_pop(s)).alias("std"), zero(F.min(s)).alias("min_v"), zero(F.max(s)).alias("max_v"))
    found = found.join(quantiles(rows.where(n > SIGNAL), [*by, "ch_idx"], (0.5,), "n"), [*by, "ch_idx"], "left").withColumn("median", zero(F.get("q", 0))).drop("q")
    found = found.join(F.broadcast(reference_channel(params)))
    of_ref = F.max(F.when(F.col("ch_idx") == F.col("ref_idx"), F.col("mean"))).over(Window.partitionBy(*by))
    ratio = F.when(F.col("ch_idx") == F.col("ref_idx"), 1.0).otherwise(F.col("mean") / F.greatest(F.coalesce(of_ref, F.lit(0.0)), F.lit(0.001)))
    return found.withColumn("ratio", ratio).drop("ref_idx")


def group_stats(pixels: DataFrame, groups: DataFrame) -> DataFrame:
    """Statistics of all pixels of each group's cells by channel; n_cells is the number of ids in the group, found or not."""
    different = written(groups.select("group_name", "cell_id").distinct(), "members")
    sizes = different.groupBy("group_name").agg(F.count("*").alias("n_cells"))
    keys = ["group_name", "ch_idx"]
    counts = value_counts(pixels.join(different, "cell_id"), keys)
    middle = quantiles(counts, keys, (0.5,), counted=True).select(*keys, F.get("q", 0).alias("median"))
    sized = counts.groupBy(*keys).agg(F.sum("k").alias("n_pixels"))
    found = sized.join(_counted_stats(counts.where("v is not null"), keys).drop("n", "total"), keys, "left")
    return found.join(middle, keys, "left").join(sizes, "group_name")


def box_summary(values: DataFrame, by: Sequence[str], log2: bool = False) -> DataFrame:
    """Quartiles and whiskers (the most extreme values within 1.5 interquartile ranges of the box)."""
    v = F.log2(F.col("v") + 1) if log2 else F.col("v").cast("double")
    rows = values.select(*by, v.alias("v"))
    box = quantiles(rows, by, (0.25, 0.5, 0.75)).select(*by, F.get("q", 0).alias("q1"), F.get("q", 1).alias("med"), F.get("q", 2).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (rows.join(box, list(by)) if by else rows.crossJoin(box)).where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    return inside.groupBy(*by, "q1", "med", "q3").agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high"))


def _with_quantiles(found: DataFrame, rows: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """found, a row a group, with q; null where the group has none of the rows."""
    q = quantiles(rows, by, probs)
    return found.join(q, list(by), "left") if by else found.join(q, F.lit(True), "left")


def percentile_range(values: DataFrame, by: Sequence[str] = (), guard: int = 100, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(lo, hi): percentiles of the values over 0 if more than guard of them, else the plain range."""
    some = F.when(F.col("v") > 0, F.col("v").cast("double"))
    found = values.groupBy(*by).agg(F.count(some).alias("k"), F.min("v").cast("double").alias("mn"), F.max("v").cast("double").alias("mx"))
    found = _with_quantiles(found, values.where("v > 0"), by, (low, high))
    pick = lambda i, other: F.when(F.col("k") > guard, F.get("q", i)).otherwise(F.col(other))
    return found.select(*by, pick(0, "mn").alias("lo"), pick(1, "mx").alias("hi"))


def contrast_range(pixels: DataFrame, h: int, ds: int, by: Sequence[str] = ()) -> DataFrame:
    """Range of a strided sample of pixels: every h div 500-th row, every ds-th column; the filter is pushed to the scan."""
    return percentile_range(pixels.where((F.col("y") % max(1, h // 500) == 0) & (F.col("x") % ds == 0)), by)


def auto_contrast(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(lo, hi) of the 0.5th and 99.5th percentile of values over 0; null where there are under 50, meaning unchanged."""
    some = F.when(F.col("v") > 0, F.col("v").cast("double"))
    found = _with_quantiles(values.groupBy(*by).agg(F.count(some).alias("k")), values.where("v > 0"), by, (0.005, 0.995))
    return found.select(*by, F.when(F.col("k") >= 50, F.get("q", 0)).alias("lo"), F.when(F.col("k") >= 50, F.get("q", 1)).alias("hi"))


def histogram(values: DataFrame, by: Sequence[str], bins: int = 80, nonzero: bool = True, least: int = 50) -> DataFrame:
    """(by, bin, n, height): bins over each group's range, the last one closed; height is log1p(n) over its greatest.

    The range is one row a group and joined back; groups with fewer than least values have no histogram.
    """
    rows = values.where(F.col("v") > 0) if nonzero else values.where(F.col("v").isNotNull())
    spans = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("k")).where(F.col("k") >= least)
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col("v") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.join(spans, list(by)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    most = F.max(F.log1p("n")).over(Window.partitionBy(*by))
    return counts.withColumn("height", F.log1p("n") / most)


def min_max(values: DataFrame, cols: Sequence[str], constant: str = "keep") -> DataFrame:
    """Columns scaled to [0, 1] by their range, which is one broadcast row; a constant one is kept, or 0 with constant="zero"."""
    spans = values.agg(*(f(c).cast("double").alias(f"__{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))))

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c).cast("double") if constant == "keep" else F.lit(0.0))

    return values.join(F.broadcast(spans)).select(*(scaled(c).alias(c) if c in cols else F.col(c) for c in values.columns))
