"""Quantification, thresholds, phenotypes and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import hex_colour
from ..functions.palettes import PHENOTYPE_COLOURS
from ..operators import phenotype as ph
from ..operators import quantify, stats
from .registry import NUDGE, query, rounded, table
from .standins import CHANNELS, SQL_ADJ, SQL_CELLS, SQL_DENSE, SQL_LONG, SQL_PARAMS, SQL_WIDE, cells, dense, long_pixels, params, wide_pixels


_MEASURES = ", ".join(f"round(avg({c}), 4) as mean_{n}, round(median({c}), 4) as median_{n}, round(sum({c}), 4) as total_{n}" for n, c in CHANNELS.items())
_QUANTIFY = "select cell_id, round(avg(y), 4) as centroid_y, round(avg(x), 4) as centroid_x, count(*)::int as area, " + _MEASURES + " from wp where cell_id > 0 {} group by cell_id"


@query("A1 J1 G9 S6", f"with {SQL_WIDE} " + _QUANTIFY.format(""))
def cell_quantify(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.quantify_cells(wide_pixels(spark, d), CHANNELS))


@query("A2 P10 H4p", f"with {SQL_WIDE} " + _QUANTIFY.format("and y >= 2 and y < 5 and x >= 100 and x < 9000"))
def cell_quantify_region(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.quantify_region(wide_pixels(spark, d), CHANNELS, 2, 5, 100, 9000))


@query("A1", f"with {SQL_WIDE} " + _QUANTIFY.format("and cell_id < 0"))
def cell_quantify_empty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantify.quantify_cells(wide_pixels(spark, d).where("cell_id < 0"), CHANNELS))


@query("J1", f"with {SQL_WIDE}, o as (select o_orderkey as x, o_custkey as cell_id2 from orders) select cell_id2, count(*) as n, round(sum(qty), 4) as total_qty from wp join o using (x) group by cell_id2")
def pixels_join_labels(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "orders").selectExpr("o_orderkey as x", "o_custkey as cell_id2")
    return rounded(quantify.with_labels(wide_pixels(spark, d), marks, ["x"]).groupBy("cell_id2").agg(F.count("*").alias("n"), F.sum("qty").alias("total_qty")))


@query("A19", f"with {SQL_WIDE} select max(cell_id) as max_id, count(distinct cell_id) - 1 as distinct_less_one, count(distinct case when cell_id > 0 then cell_id end) as distinct_cells from wp")
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return quantify.cell_counts(wide_pixels(spark, d))


@query("A24", f"with {SQL_WIDE} select distinct cell_id from wp where cell_id > 0")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return quantify.distinct_labels(wide_pixels(spark, d))


_T = {"QTY": 26.0, "PRICE": 38000.0}
_POS = "case when mean_qty >= 26.0 then 'QTY+' else 'QTY−' end || ' ' || case when mean_price >= 38000.0 then 'PRICE+' else 'PRICE−' end"


@query("P9", f"with {SQL_CELLS} select cell_id, mean_qty >= 26.0 as pos_qty, false as pos_none from ce")
def positivity(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select("cell_id", ph.is_positive(F.col("mean_QTY"), 26.0).alias("pos_qty"), ph.is_positive(quantify.measured_like(c, "absent"), 1.0).alias("pos_none"))


@query("H1p A23 P13", f"with {SQL_CELLS} select cell_id, {_POS} as phenotype from ce")
def phenotype_assign(spark: SparkSession, d: str) -> DataFrame:
    return ph.assign_phenotypes(cells(spark, d), _T, ["QTY", "PRICE"]).select("cell_id", "phenotype")


@query("H1p P13 A23", f"with {SQL_CELLS} select cell_id, case when mean_qty >= 26.0 then 'amount+' else 'amount−' end || ' ' || case when mean_price >= 38000.0 then 'PRICE+' else 'PRICE−' end as phenotype from ce")
def phenotype_by_table(spark: SparkSession, d: str) -> DataFrame:
    long = quantify.cells_long(cells(spark, d).selectExpr("cell_id", *(f"{f} as {k}_{m}" for m in _T for k, f in (("mean", f"mean_{m}"), ("median", "0d"), ("total", "0d")))), list(_T))
    table_ = spark.createDataFrame([("QTY", 1, " amount ", True, 26.0), ("PRICE", 2, "  ", True, 38000.0), ("TAX", 3, "x", False, 1.0)], "marker string, pos int, label string, included boolean, threshold double")
    return ph.assign_by_table(long, table_)


@query("H2p", f"with {SQL_CELLS} select cell_id, 'no markers' as phenotype from ce")
def phenotype_no_markers(spark: SparkSession, d: str) -> DataFrame:
    return ph.assign_phenotypes(cells(spark, d), {}, []).select("cell_id", "phenotype")


_COUNTS = f"with {SQL_CELLS}, pc as (select phenotype, count(*) as n, min(cell_id) as first_cell from (select cell_id, {_POS} as phenotype from ce) group by phenotype), pk as (select *, row_number() over (order by n desc, first_cell) as rank from pc)"


@query("A9 W4 H5p", _COUNTS + " select phenotype, n, first_cell, rank::int as rank, round(100.0 * n / sum(n) over (), 4) as pct from pk")
def phenotype_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.phenotype_counts(phenotype_assign(spark, d)))


@query("T3 T4", _COUNTS + " select phenotype as slice, n from pk where rank <= 2 union all select 'Other (' || count(*) || ' types)', sum(n)::bigint from pk where rank > 2 having count(*) > 0")
def phenotype_top_other(spark: SparkSession, d: str) -> DataFrame:
    return ph.top_with_other(ph.phenotype_counts(phenotype_assign(spark, d)), 2)


@query("T2 T4 W8", _COUNTS + f" select phenotype, n, list_value({', '.join(repr(c) for c in PHENOTYPE_COLOURS)})[(rank - 1) % 20 + 1] as colour from pk where rank <= 25")
def phenotype_top25_colours(spark: SparkSession, d: str) -> DataFrame:
    top = ph.phenotype_counts(phenotype_assign(spark, d)).where("rank <= 25")
    return top.select("phenotype", "n", ph.palette_colour(F.col("rank"), PHENOTYPE_COLOURS).alias("colour"))


@query("A13", f"with {SQL_CELLS} select 'QTY' as marker, count(*) filter (mean_qty >= 26.0) as n_positive, round(100.0 * count(*) filter (mean_qty >= 26.0) / greatest(count(*), 1), 4) as pct from ce union all select 'PRICE', count(*) filter (mean_price >= 38000.0), round(100.0 * count(*) filter (mean_price >= 38000.0) / greatest(count(*), 1), 4) from ce")
def marker_positive_pct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.positive_percent(cells(spark, d), _T))


_UNPIVOT = "v as (select 'QTY' as marker, mean_qty as v from ce union all select 'PRICE', mean_price from ce union all select 'DISC', mean_disc from ce union all select 'TAX', mean_tax from ce)"


@query(
    "A10 W6 H3p P8",
    f"with {SQL_CELLS}, {_UNPIVOT}, s as (select marker, min(v) as lo, max(v) as hi from v group by marker), "
    "c as (select marker, lo, hi, least(floor((v - lo) / ((hi - lo) / 256)), 255)::int as bin, count(*) as n from v join s using (marker) where hi > lo group by all), "
    "h as (select s.marker, s.lo, s.hi, b.bin, coalesce(c.n, 0) as n, s.lo + (b.bin + 0.5) * (s.hi - s.lo) / 256 as centre from s cross join (select unnest(range(256)) as bin) b left join c on c.marker = s.marker and c.bin = b.bin where s.hi > s.lo), "
    "w as (select *, sum(n) over (partition by marker order by bin) as w1, sum(n * centre) over (partition by marker order by bin) as m1, sum(n) over (partition by marker) as w, sum(n * centre) over (partition by marker) as m from h), "
    "x as (select marker, centre, bin, round(case when w1 > 0 and w - w1 > 0 then w1 * (w - w1) * power(m1 / w1 - (m - m1) / (w - w1), 2) end, 6) as var from w), "
    "r as (select marker, centre, row_number() over (partition by marker order by var desc nulls last, bin) as k from x) "
    "select s.marker, round(coalesce(r.centre, s.lo, 0), 4) as threshold from s left join r on r.marker = s.marker and k = 1",
)
def threshold_otsu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.thresholds_by(cells(spark, d), list(CHANNELS), "otsu"))


@query("A11 H3p", f"with {SQL_CELLS}, {_UNPIVOT} select marker, round(coalesce(median(v) filter (v > 0), 0), 4) as threshold from v group by marker")
def threshold_median_nz(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.thresholds_by(cells(spark, d), list(CHANNELS), "median"))


@query("A12 H3p", f"with {SQL_CELLS}, {_UNPIVOT} select marker, round(coalesce(quantile_cont(v, 0.75), 0), 4) as threshold from v group by marker union all select 'ABSENT', 0.0")
def threshold_p75(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ph.thresholds_by(cells(spark, d), [*CHANNELS, "ABSENT"], "percentile"))


@query("P8", "select event_id from events where value is not null and not isnan(value) and not isinf(value)")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(ph.finite(F.col("value")).isNotNull()).select("event_id")


@query(
    "A3 A4 P6 P7 P12",
    f"with {SQL_ADJ}, st as (select ch_idx, count(*) filter (n > 0.01) as k, avg(n) filter (n > 0.01) as m, stddev_pop(n) filter (n > 0.01) as sd from adj group by ch_idx), "
    "s2 as (select ch_idx, case when k > 10 then m else 0 end as m, case when k > 10 then sd else 0 end as sd, case when k > 10 then sd / sqrt(k) else 0 end as sem, k from st), "
    "rf as (select coalesce(min(ch_idx) filter (lower(name) like '%dapi%'), 0) as ref_idx from pr), "
    "b as (select ref_idx, case when m < 0.001 then 1.0 else m end as r from (select ref_idx, case when k > 10 then m else 1.0 end as m from s2 join rf on ch_idx = ref_idx)) "
    "select ch_idx, round(m / r, 4) as ratio, round(sem / r, 6) as sem, round(sd / r, 4) as std from s2, b where ch_idx <> ref_idx",
)
def intensity_ratio(spark: SparkSession, d: str) -> DataFrame:
    got = stats.intensity_ratios(long_pixels(spark, d), params(spark))
    return got.select("ch_idx", F.round(F.col("ratio") + NUDGE, 4).alias("ratio"), F.round(F.col("sem") + NUDGE, 6).alias("sem"), F.round(F.col("std") + NUDGE, 4).alias("std"))


@query("P12 P11", f"with {SQL_PARAMS} select coalesce(min(ch_idx) filter (lower(name) like '%dapi%'), 0) as ref_idx from pr")
def reference_channel(spark: SparkSession, d: str) -> DataFrame:
    return stats.reference_channel(params(spark))


_Z = "round(coalesce({}, 0), 4)"
_RAW = ", ".join(f"{_Z.format(f)} as {n}" for n, f in (("mean", "avg(v) filter (v > 0)"), ("std", "stddev_pop(v) filter (v > 0)"), ("median", "median(v) filter (v > 0)"), ("min", "min(v) filter (v > 0)"), ("max", "max(v) filter (v > 0)"), ("total", "sum(v) filter (v > 0)"), ("sem", "stddev_pop(v) filter (v > 0) / sqrt(nullif(count(*) filter (v > 0), 0))"), *((f"p{p}", f"quantile_cont(v, {p / 100}) filter (v > 0)") for p in (5, 25, 75, 95))))


@query("A5", f"with {SQL_LONG} select y, ch_idx, {_RAW}, count(*) as n_total, count(*) filter (v > 0) as n_nonzero from px group by y, ch_idx")
def roi_stats_raw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.raw_stats(long_pixels(spark, d), ["y", "ch_idx"]))


@query(
    "A6 K3 P1 P6",
    f"with {SQL_ADJ}, g as (select y as roi, ch_idx, coalesce(avg(n) filter (n > 0.01), 0) as mean, coalesce(stddev_pop(n) filter (n > 0.01), 0) as std, coalesce(median(n) filter (n > 0.01), 0) as median, coalesce(min(n) filter (n > 0.01), 0) as min_v, coalesce(max(n) filter (n > 0.01), 0) as max_v from adj group by 1, 2), "
    "rf as (select coalesce(min(ch_idx) filter (lower(name) like '%dapi%'), 0) as ref_idx from pr), "
    "b as (select roi, mean as rm from g, rf where ch_idx = ref_idx) "
    "select g.roi, ch_idx, round(mean, 4) as mean, round(std, 4) as std, round(median, 4) as median, round(min_v, 4) as min_v, round(max_v, 4) as max_v, "
    "round(case when ch_idx = ref_idx then 1.0 else mean / greatest(coalesce(rm, 0), 0.001) end, 4) as ratio from g cross join rf left join b on b.roi = g.roi",
)
def roi_stats_adjusted(spark: SparkSession, d: str) -> DataFrame:
    px = long_pixels(spark, d).withColumnRenamed("y", "roi")
    return rounded(stats.adjusted_stats(px, params(spark), ["roi"]))


@query(
    "A7 J5 K4 D9",
    f"with {SQL_LONG}, gr as (select p_brand as group_name, p_partkey as cell_id from part), sz as (select group_name, count(distinct cell_id) as n_cells from gr group by 1) "
    "select gr.group_name, ch_idx, round(avg(v), 4) as mean, round(median(v), 4) as median, round(stddev_pop(v), 4) as std, min(v) as min, max(v) as max, count(*) as n_pixels, any_value(n_cells) as n_cells from px join gr using (cell_id) join sz on sz.group_name = gr.group_name group by 1, 2",
)
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "part").selectExpr("p_brand as group_name", "p_partkey as cell_id")
    return rounded(stats.group_stats(long_pixels(spark, d), groups))


@query("J5", f"with {SQL_WIDE} select cell_id, y, x, qty from wp where cell_id in (select p_partkey from part where p_brand = (select min(p_brand) from part))")
def group_semi_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    first = part.agg(F.min("p_brand").alias("p_brand"))
    ids = part.join(first, "p_brand").select(F.col("p_partkey").alias("cell_id"))
    return wide_pixels(spark, d).join(ids, "cell_id", "left_semi").select("cell_id", "y", "x", "qty")


def _box(expr: str) -> str:
    return (
        f"with {SQL_LONG}, r as (select ch_idx, {expr} as v from px), q as (select ch_idx, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.75) as q3 from r group by 1) "
        "select ch_idx, round(q1, 4) as q1, round(med, 4) as med, round(q3, 4) as q3, round(min(v), 4) as whisker_low, round(max(v), 4) as whisker_high from r join q using (ch_idx) where v >= q1 - 1.5 * (q3 - q1) and v <= q3 + 1.5 * (q3 - q1) group by ch_idx, q1, med, q3"
    )


@query("A8", _box("v"))
def boxplot_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.box_summary(long_pixels(spark, d), ["ch_idx"]))


@query("A8", _box("log2(v + 1)"))
def boxplot_log2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.box_summary(long_pixels(spark, d), ["ch_idx"], log2=True))


_RANGE = "select ch_idx, round(case when count(*) filter (v > 0) > 100 then quantile_cont(v, 0.005) filter (v > 0) else min(v) end, 4) as lo, round(case when count(*) filter (v > 0) > 100 then quantile_cont(v, 0.995) filter (v > 0) else max(v) end, 4) as hi from px"


@query("A14", f"with {SQL_LONG} {_RANGE} where y % 1 = 0 and x % 3 = 0 group by ch_idx")
def contrast_range_sampled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.contrast_range(long_pixels(spark, d), 7, 3, ["ch_idx"]))


@query("A15", f"with {SQL_LONG} select ch_idx, round(case when count(*) filter (v > 0) >= 50 then quantile_cont(v, 0.005) filter (v > 0) end, 4) as lo, round(case when count(*) filter (v > 0) >= 50 then quantile_cont(v, 0.995) filter (v > 0) end, 4) as hi from px group by ch_idx")
def auto_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.auto_contrast(long_pixels(spark, d), ["ch_idx"]))


def _hist(where: str, bins: int, src: str, by: str) -> str:
    return (
        f", r as (select * from {src} where {where}), s as (select {by}, min(v) as lo, max(v) as hi, count(*) as k from r group by 1 having count(*) >= 50), "
        f"c as (select {by}, least(coalesce(floor((v - lo) / nullif((hi - lo) / {bins}, 0)), 0), {bins - 1})::int as bin, count(*) as n from r join s using ({by}) group by 1, 2) "
        f"select {by}, bin, n, round(ln(1 + n) / max(ln(1 + n)) over (partition by {by}), 4) as height from c"
    )


@query("A16", f"with {SQL_LONG}" + _hist("v > 0", 80, "px", "ch_idx"))
def hist80_nonzero(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(long_pixels(spark, d), ["ch_idx"]))


@query("A17", f"with {SQL_CELLS}, {_UNPIVOT}" + _hist("v is not null", 80, "v", "marker"))
def hist80_all(spark: SparkSession, d: str) -> DataFrame:
    long = cells(spark, d).selectExpr(f"stack(4, {', '.join(f'{m!r}, mean_{m}' for m in CHANNELS)}) as (marker, v)")
    return rounded(stats.histogram(long, ["marker"], nonzero=False))


@query("A18", f"with {SQL_CELLS} select cell_id, round((mean_qty - min(mean_qty) over ()) / (max(mean_qty) over () - min(mean_qty) over ()), 4) as mean_qty, 0.0::double as flat from ce")
def minmax_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).selectExpr("cell_id", "mean_QTY as mean_qty", "7d as flat")
    return rounded(stats.min_max(c, ["mean_qty", "flat"], constant="zero"))


@query("O8", f"with {SQL_CELLS} select cell_id, mean_qty as px, mean_price as py, round((mean_tax - min(mean_tax) over ()) / (max(mean_tax) over () - min(mean_tax) over ()), 4) as n from ce")
def scatter_data(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.overlay import scatter

    return rounded(scatter(cells(spark, d), "mean_QTY", "mean_PRICE", "mean_TAX"))


@query("A4", f"with {SQL_DENSE} select y, x, '#' || lower(printf('%02x%02x%02x', v::int, (255 - v)::int, x::int)) as hex from dr")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    px = dense(spark, d).withColumn("v", F.col("v").cast("int"))
    return px.select("y", "x", hex_colour(F.col("v"), 255 - F.col("v"), F.col("x")).alias("hex"))


@query("T5 T6 O9 A18")
def heatmap_ward(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.cluster import heatmap

    return heatmap(cells(spark, d), [f"mean_{m}" for m in CHANNELS])


@query("K1 K2", f"with {SQL_CELLS} select cell_id, mean_qty, {_POS} as phenotype from ce")
def cells_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from ..sources.tables import write_csv

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{base}/cells-{uuid.uuid4().hex}.csv"
    write_csv(ph.assign_phenotypes(cells(spark, d), _T, ["QTY", "PRICE"]).selectExpr("cell_id", "mean_QTY as mean_qty", "phenotype"), at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema("cell_id long, mean_qty double, phenotype string").option("header", True).csv(at)
