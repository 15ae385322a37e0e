"""Display, raster, region, neighbour, label and overlay queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import clip, colourised, window_level
from ..functions.palettes import GROUP_COLOURS
from ..operators import basins as bs
from ..operators import labels as lb
from ..operators import overlay as ov
from ..operators import raster as rs
from ..operators import roi as rg
from ..operators import spatial as sp
from ..operators import tiling as tl
from ..operators.stats import adjusted
from ..sources.scratch import new_path
from .registry import query, rounded
from .standins import SQL_ADJ, SQL_CENTROIDS, SQL_DENSE, SQL_IMAGE_PARAMS, SQL_IMAGE_ROIS, SQL_LONG, SQL_OUTLINES, SQL_PARAMS, SQL_ROIS, SQL_RPARAMS, SQL_WIDE, WIDTH, centroids, dense, height, image_params, image_rois, long_pixels, outlines, params, raster, raster_params, raster_tiles, rois, sql_raster, wide_pixels

W = WIDTH
_H = "(select hh from hh)"
_RA = f"with {sql_raster()}"


@query("P1 P6 J2", f"with {SQL_ADJ} select cell_id, y, x, ch_idx, round(n, 4) as n from adj")
def window_level_pixels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adjusted(long_pixels(spark, d), params(spark)).select("cell_id", "y", "x", "ch_idx", "n"))


@query("P2", f"with {SQL_LONG}, {SQL_PARAMS} select y, x, ch_idx, round(least(greatest(case when gamma <> 1 then power(least(greatest((v - mn) / (mx - mn), 0), 1), 1 / gamma) else least(greatest((v - mn) / (mx - mn), 0), 1) end * brightness, 0), 1), 4) as n from px join pr using (ch_idx) where visible")
def window_level_gamma(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adjusted(long_pixels(spark, d), params(spark), gamma=True).select("y", "x", "ch_idx", "n"))


@query("P7", f"with {SQL_ADJ} select ch_idx, count(*) filter (n > 0.01) as signal, count(*) filter (v > 0) as nonzero from adj group by ch_idx")
def signal_filters(spark: SparkSession, d: str) -> DataFrame:
    on = adjusted(long_pixels(spark, d), params(spark))
    return on.groupBy("ch_idx").agg(F.count_if(F.col("n") > 0.01).alias("signal"), F.count_if(F.col("v") > 0).alias("nonzero"))


_LUT_N = "least(greatest(power(least(greatest((level - 100) / 4900.0::double, 0), 1), 1 / 0.8::double) * 1.1, 0), 1)"


@query("P3", f"with l as (select i::int as level from range(65536) t(i)) select level, trunc(least({_LUT_N} * 255, 255))::int as r, trunc(least({_LUT_N} * 165, 255))::int as g, 0 as b from l")
def lut_build(spark: SparkSession, d: str) -> DataFrame:
    return rs.lut(spark.range(1), 100, 5000, 1.1, 0.8, (255, 165, 0), 65535)


@query("P4", f"{_RA} select y, x, trunc(least(greatest(trunc(least(v, 99)) / 100.0::double, 0), 1) * 255)::int as r, 0 as g, trunc(least(greatest(trunc(least(v, 99)) / 100.0::double, 0), 1) * 100)::int as b from ra where ch_idx = 0")
def lut_apply(spark: SparkSession, d: str) -> DataFrame:
    table = rs.lut(spark.range(1), 0, 100, 1.0, 1.0, (255, 0, 100), 99)
    return rs.apply_lut(raster(spark, d).where("ch_idx = 0"), table, 100)


@query("P5 P1", f"{_RA} select y, x, trunc(least(greatest((v - 10) / 190.0::double, 0), 1) * 200)::int as r from ra where ch_idx = 0")
def colourise(spark: SparkSession, d: str) -> DataFrame:
    n = window_level(F.col("v"), F.lit(10.0), F.lit(200.0), F.lit(1.0))
    return raster(spark, d).where("ch_idx = 0").select("y", "x", colourised(n, 200).alias("r"))


_U8N = "least(greatest((floor(v) - mn) / greatest(mx - mn, 1.0), 0), 1)"
_U8 = f"u as (select y, x, ch_idx, least(greatest(case when abs(gamma - 1) > 0.01 then power({_U8N}, 1 / gamma) else {_U8N} end * brightness, 0), 1) as n, r, g, b from ra join rp using (ch_idx)), "
_U8 += "l as (select y, x, ch_idx, " + ", ".join(f"trunc(least(n * {c}, 255))::bigint as {c}" for c in "rgb") + " from u), "
_U8 += "p as (select y, x, " + ", ".join(f"max({c}) filter (ch_idx = {k}) as {c}{k}" for c in "rgb" for k in range(3)) + " from l group by y, x), "
_U8 += "q as (select *, " + ", ".join(f"{c}0 + {c}1 - ({c}0 * {c}1) // 255 as {c}01" for c in "rgb") + " from p)"


@query("R2 R4 W10", f"{_RA}, {SQL_RPARAMS}, {_U8} select y, x, " + ", ".join(f"({c}01 + {c}2 - ({c}01 * {c}2) // 255)::int as {c}" for c in "rgb") + " from q")
def blend_u8(spark: SparkSession, d: str) -> DataFrame:
    return tl.pixels_of_tiles(tl.composite_tiles(raster_tiles(spark, d), raster_params(spark)), "r", "g", "b")


def _float_sql(gamma: bool) -> str:
    n = "least(greatest((v - mn) / (case when mx <= mn then mn + 1 else mx end - mn), 0), 1)"
    n = f"case when gamma <> 1 then power({n}, 1 / gamma) else {n} end" if gamma else n
    return (
        f"{_RA}, {SQL_RPARAMS}, u as (select y, x, least(greatest({n} * brightness, 0), 1) as n, r, g, b from ra join rp using (ch_idx)) "
        "select y, x, " + ", ".join(f"trunc(least(greatest(round((1 - product(1 - n * {c} / 255.0::double)) * 255, 6), 0), 255))::int as {c}" for c in "rgb") + " from u group by y, x"
    )


@query("R3", _float_sql(True))
def blend_float(spark: SparkSession, d: str) -> DataFrame:
    return tl.pixels_of_tiles(tl.composite_tiles(raster_tiles(spark, d), raster_params(spark), "float"), "r", "g", "b")


@query("R5 K8", _float_sql(False))
def blend_float_plain(spark: SparkSession, d: str) -> DataFrame:
    return tl.pixels_of_tiles(tl.composite_tiles(raster_tiles(spark, d), raster_params(spark), "float_plain"), "r", "g", "b")


@query("R2", f"{_RA} select greatest(case when least(max(v), 65535) < 1 then 255 else least(max(v), 65535) end, 0)::double as dmax from ra where ch_idx = 1")
def lut_depth(spark: SparkSession, d: str) -> DataFrame:
    return rs.depth_of(raster(spark, d).where("ch_idx = 1"), False)


@query("S12", f"with {SQL_DENSE} select y // 4 as y, x // 4 as x, v from dr where y % 4 = 0 and x % 4 = 0")
def preview_downsample(spark: SparkSession, d: str) -> DataFrame:
    return rs.preview(dense(spark, d), 4).select("y", "x", "v")


@query("S12 R9", f"{_RA} select ch_idx, y // 4 as y, x // 4 as x, v from ra where y % 4 = 0 and x % 4 = 0")
def pyramid_preview(spark: SparkSession, d: str) -> DataFrame:
    made = tl.Pyramid.write(tl.regrouped(raster_tiles(spark, d), 32), new_path(spark, "pyramid"), height(spark, d), W, side=32)
    return made.view(0, height(spark, d), 0, W, 4, side=32)


@query("R6 P18", f"{_RA} select ch_idx, y // 2 as y, x // 2 as x, v from ra cross join hh where y % 2 = 0 and x % 2 = 0 and y >= hh // 3 and y < hh // 2 and x >= 11 and x < 50")
def pyramid_viewport(spark: SparkSession, d: str) -> DataFrame:
    h = height(spark, d)
    made = tl.Pyramid.write(tl.regrouped(raster_tiles(spark, d), 32), new_path(spark, "pyramid"), h, W, side=32)
    return made.view(h // 3, h // 2, 11, 50, 2, side=32)


@query("P10", f"with {SQL_DENSE} select y, x, v from dr where y >= 10 and y < 50 and x >= 3 and x < 20")
def crop_region(spark: SparkSession, d: str) -> DataFrame:
    return rs.crop(dense(spark, d), 10, 50, 3, 20).select("y", "x", "v")


@query("R1", f"{_RA}, t as (select y.i::int as ty, x.i::int as tx from range(20) y(i), range(150) x(i)) select ty as y, tx as x, v from t cross join hh join ra on ra.y = ty * hh // 20 and ra.x = tx * {W} // 150 where ch_idx = 0")
def resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rs.resize_nearest(raster(spark, d).where("ch_idx = 0").select("y", "x", "v"), height(spark, d), W, 20, 150)


@query("R9", f"{_RA}, nw as (select hh, greatest(1, {W} * 48 // hh)::int as nw from hh), ys as (select unnest(range(48))::int as ty), xs as (select hh, nw, unnest(range(nw))::int as tx from nw) select ty as y, tx as x, v from xs cross join ys join ra on ra.y = ty * hh // 48 and ra.x = tx * {W} // nw where ch_idx = 1")
def minimap(spark: SparkSession, d: str) -> DataFrame:
    return rs.minimap(raster(spark, d).where("ch_idx = 1").select("y", "x", "v"), height(spark, d), W, 48)


@query("R6 P18 H4p", f"{_RA} select y, x, v from ra cross join hh where ch_idx = 0 and y >= trunc(hh / 2.0 - 20) and y < trunc(hh / 2.0 + 20) and x >= 2 and x < 62")
def viewport_crop(spark: SparkSession, d: str) -> DataFrame:
    bounds = rs.viewport(2.0, (0.0, 0.0), (120, 80), (height(spark, d), W), (height(spark, d), W), 1)
    return rs.crop(raster(spark, d).where("ch_idx = 0"), *bounds).select("y", "x", "v")


@query("P22", "select p_partkey, case when (p_size * 2) < 60 and (p_partkey % 50) * 2 < 80 then p_size * 2 end as y, case when (p_size * 2) < 60 and (p_partkey % 50) * 2 < 80 then (p_partkey % 50) * 2 end as x from part")
def cursor_pixel(spark: SparkSession, d: str) -> DataFrame:
    from .registry import table

    at = rs.source_pixel((F.col("p_partkey") % 50).cast("double"), F.col("p_size").cast("double"), 2, 60, 80)
    return table(spark, d, "part").select("p_partkey", at["y"].alias("y"), at["x"].cast("bigint").alias("x"))


@query("P20", f"with {SQL_IMAGE_PARAMS} select image_id, bool_or(case when image_id % 3 = 0 then ch_idx = 2 else mx > 60000 end) as changed from ip group by image_id")
def params_changed(spark: SparkSession, d: str) -> DataFrame:
    a = image_params(spark, d)
    third = F.col("image_id") % 3 == 0
    b = a.withColumns({"min": F.col("min") + 0.9, "gamma": F.col("gamma") + F.when(third & (F.col("ch_idx") == 2), 0.06).otherwise(0.04), "max": F.col("max") + F.when(~third & (F.col("max") > 60000), 1.5).otherwise(0.0)})
    return rs.params_changed(a, b, ["image_id"])


@query("R8", f"with {SQL_IMAGE_PARAMS} select image_id, sha256(string_agg(concat_ws('|', ch_idx, visible, mn, mx, brightness, gamma), chr(10) order by ch_idx)) as params_hash from ip group by image_id")
def params_hash(spark: SparkSession, d: str) -> DataFrame:
    return rs.params_hash(image_params(spark, d), ["image_id"])


_DISC = "b as (select y.i::int as y, x.i::int as x from range(64) y(i), range(96) x(i) where (y.i - 20.5)**2 + (x.i - 30.0)**2 <= 64)"


@query("R11 J15", f"with {_DISC} select y, x, 1.0::double as w from b")
def brush_disc(spark: SparkSession, d: str) -> DataFrame:
    return rs.brush_disc(spark, 20.5, 30.0, 8.0, height(spark, d), W)


@query("R11", f"with {_DISC} select y, x, 1.0::double as w from b where (y - 20)**2 + (x - 33)**2 > 16")
def brush_erase(spark: SparkSession, d: str) -> DataFrame:
    return rs.paint(rs.brush_disc(spark, 20.5, 30.0, 8.0, height(spark, d), W), rs.brush_disc(spark, 20.0, 33.0, 4.0, height(spark, d), W), erase=True)


@query("A20", f"{_RA}, {_DISC} select round(100.0 * count(*) / ({_H} * {W}), 4) as coverage_pct from b")
def brush_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rs.brush_coverage(rs.brush_disc(spark, 20.5, 30.0, 8.0, height(spark, d), W), height(spark, d) * W))


@query("J15 U2", f"{_RA} select distinct cell_id from ra where cell_id <> 0 and y >= 5 and y < 30 and x >= 10 and x < 25")
def brush_cells(spark: SparkSession, d: str) -> DataFrame:
    return rs.cells_under(raster(spark, d), 5, 30, 10, 25)


@query("R14", f"{_RA}, {_DISC} select ra.y, ra.x, round(case when b.y is not null then v * 0.4 + least(greatest((v - 10) / 190.0::double, 0), 1) * 255 * 0.6 else v end, 4) as v from ra left join b on ra.y // 2 = b.y and ra.x // 2 = b.x where ch_idx = 0")
def brush_apply(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rs.apply_brush(raster(spark, d).where("ch_idx = 0"), rs.brush_disc(spark, 20.5, 30.0, 8.0, height(spark, d), W), 10.0, 200.0, 1.0, 0.6, 255.0, 2))


@query("R15 U4", f"{_RA}, {_DISC}, t as (select y, x, v::int as r, 0 as g, v::int as b from ra where ch_idx = 0) select t.y, t.x, trunc(case when b.y is null then r else r * 0.5 + 127.5 end)::int as r, trunc(case when b.y is null then g else g * 0.5 + 50 end)::int as g, trunc(case when b.y is null then t.b else t.b * 0.5 end)::int as b from t left join b on b.y = t.y and b.x = t.x")
def brush_tint(spark: SparkSession, d: str) -> DataFrame:
    rgb = raster(spark, d).where("ch_idx = 0").selectExpr("y", "x", "cast(v as int) as r", "0 as g", "cast(v as int) as b")
    return rs.tint(rgb, rs.brush_disc(spark, 20.5, 30.0, 8.0, height(spark, d), W), (255, 100, 0), 0.5)


_WEIGHTS = rs.gaussian_weights(1.0)
_REACH = len(_WEIGHTS) // 2


def _mirrored(axis: str, size: str) -> str:
    return f"case when t.{axis} + k < 0 then -1 - (t.{axis} + k) when t.{axis} + k >= {size} then 2 * {size} - 1 - (t.{axis} + k) else t.{axis} + k end"


@query(
    "R12",
    f"{_RA}, m as (select y, x, case when cell_id = 9 or cell_id = 12 then 1.0::double else 0 end as v from ra where ch_idx = 0), "
    f"kw as (select unnest(range(-{_REACH}, {_REACH} + 1)) as k, unnest([{', '.join(map(repr, _WEIGHTS))}]::double[]) as wt), "
    f"a as (select t.y, t.x, sum(s.v * wt) as v from m t cross join kw cross join hh join m s on s.x = t.x and s.y = {_mirrored('y', 'hh')} group by 1, 2), "
    f"b as (select t.y, t.x, sum(s.v * wt) as v from a t cross join kw join a s on s.y = t.y and s.x = {_mirrored('x', str(W))} group by 1, 2) "
    "select y, x, round(least(greatest(v, 0), 1), 4) as v from b",
)
def gaussian_feather(spark: SparkSession, d: str) -> DataFrame:
    mask = raster(spark, d).where("ch_idx = 0").selectExpr("y", "x", "case when cell_id = 9 or cell_id = 12 then 1d else 0d end as v")
    return rounded(rs.feather(mask, height(spark, d), W, 1.0))


@query("R13 K9", f"{_RA}, w as (select y, x, v / 255 as w from ra where ch_idx = 1 and cell_id > 0), s as (select y, x, v from ra where ch_idx = 0) select s.y, s.x, " + ", ".join(f"round(v * (1 - coalesce(w, 0)) + {k} * coalesce(w, 0), 4) as {c}" for c, k in (("r", 255), ("g", 0), ("b", 10))) + " from s left join w on w.y = s.y and w.x = s.x")
def mask_blend(spark: SparkSession, d: str) -> DataFrame:
    r = raster(spark, d)
    base = r.where("ch_idx = 0").selectExpr("y", "x", "v as r", "v as g", "v as b")
    other = r.where("ch_idx = 0").selectExpr("y", "x", "255 as r", "0 as g", "10 as b")
    return rounded(rs.mask_blend(base, other, r.where("ch_idx = 1 and cell_id > 0").selectExpr("y", "x", "v / 255 as v")))


@query("U5", f"{_RA}, a as (select y, x, cell_id from ra where ch_idx = 0 union all select y, x + 3, cell_id from ra where ch_idx = 0) select y, x, max(cell_id) as cell_id from a group by y, x")
def roi_label_merge_max(spark: SparkSession, d: str) -> DataFrame:
    a = raster(spark, d).where("ch_idx = 0").select("y", "x", "cell_id")
    return rs.max_merge(a.unionByName(a.withColumn("x", F.col("x") + 3)))


_BOX = f"bx as (select *, greatest(trunc(x1), 0)::int as sx1, greatest(trunc(y1), 0)::int as sy1, least(trunc(x2), {W})::int as sx2, least(trunc(y2), {_H})::int as sy2 from ro)"
_POLY = "pe(ax, ay, bx, byy) as (values (10, 10, 70, 15), (70, 15, 50, 50), (50, 50, 20, 45), (20, 45, 10, 10))"
_IN_RECT = "roi_type = 'rect' and x >= sx1 and x < sx2 and y >= sy1 and y < sy2"
_IN_RING = "roi_type = 'circle' and ((x - (sx1 + sx2) / 2.0) / greatest((sx2 - sx1) / 2.0, 1))**2 + ((y - (sy1 + sy2) / 2.0) / greatest((sy2 - sy1) / 2.0, 1))**2 <= 1"
_PTS = f"{_RA}, {SQL_ROIS}, {_BOX}, pt as (select y, x from ra where ch_idx = 0)"
_FREE = f"{_POLY}, fr as (select y, x, count(*) filter ((ay > y) <> (byy > y) and x < (bx - ax) * (y - ay) / nullif(byy - ay, 0)::double + ax) % 2 = 1 or bool_or((bx - ax) * (y - ay) - (byy - ay) * (x - ax) = 0 and x between least(ax, bx) and greatest(ax, bx) and y between least(ay, byy) and greatest(ay, byy)) as inside from pt, pe group by y, x)"


@query("X1", f"{_PTS} select name as roi_name, y, x from pt join bx on {_IN_RECT}")
def roi_rect(spark: SparkSession, d: str) -> DataFrame:
    return rg.members(raster(spark, d).where("ch_idx = 0").select("y", "x"), rois(spark).where("roi_type = 'rect'"), height(spark, d), W)


@query("X2 J8", f"{_PTS} select name as roi_name, y, x from pt join bx on {_IN_RING}")
def roi_ellipse(spark: SparkSession, d: str) -> DataFrame:
    return rg.members(raster(spark, d).where("ch_idx = 0").select("y", "x"), rois(spark).where("roi_type = 'circle'"), height(spark, d), W)


@query("X3 X5 J8", f"{_PTS}, {_FREE} select 'free' as roi_name, y, x from fr where inside")
def roi_polygon(spark: SparkSession, d: str) -> DataFrame:
    return rg.members(raster(spark, d).where("ch_idx = 0").select("y", "x"), rois(spark).where("roi_type = 'freehand'"), height(spark, d), W)


#: Each region's pixels, or its box's, as mb.
PIXELS_IN_ROIS = f"{_PTS}, {_FREE}, al as (select name, y, x from pt join bx on ({_IN_RECT}) or ({_IN_RING}) union all select 'free', y, x from fr where inside), em as (select * from bx where name not in (select name from al)), mb as (select name as roi_name, y, x from al union all select name, y, x from pt join em on x >= sx1 and x < sx2 and y >= sy1 and y < sy2)"


@query("X4 J8", f"{PIXELS_IN_ROIS} select roi_name, count(*) as n from mb group by roi_name")
def roi_members_or_box(spark: SparkSession, d: str) -> DataFrame:
    held = rg.members_or_box(raster(spark, d).where("ch_idx = 0").select("y", "x"), rois(spark), height(spark, d), W)
    return held.groupBy("roi_name").agg(F.count("*").alias("n"))


#: An outline of one vertex a row of the raster on each side, its ends moved by the samples.
_ZIGZAG = "zz as (select y, case when y % 2 = 0 then 3 + a::int % 20 else 2 end as xl, case when y % 2 = 0 then 61 - b::int % 20 else 63 end as xr from (select y, max(v) filter (x = 0) as a, max(v) filter (x = 1) as b from ra where ch_idx = 0 group by y))"


@query(
    "X3 X5 J8",
    f"{_RA}, {_ZIGZAG}, ve as (select row_number() over (order by side, case when side = 0 then y else -y end) - 1 as i, x, y from (select 0 as side, y, xl as x from zz union all select 1, y, xr from zz)), "
    "pe as (select a.x as ax, a.y as ay, b.x as bx, b.y as byy from ve a join ve b on b.i = (a.i + 1) % (select count(*) from ve)), pt as (select y, x from ra where ch_idx = 0), "
    "near as (select pt.y, pt.x, ax, ay, bx, byy from pt join pe on pt.y between least(ay, byy) and greatest(ay, byy)), "
    "fr as (select y, x, count(*) filter ((ay > y) <> (byy > y) and x < (bx - ax) * (y - ay) / nullif(byy - ay, 0)::double + ax) % 2 = 1 or bool_or((bx - ax) * (y - ay) - (byy - ay) * (x - ax) = 0 and x between least(ax, bx) and greatest(ax, bx)) as inside from near group by y, x) "
    "select 'zigzag' as roi_name, y, x from fr where inside",
)
def roi_long_outline(spark: SparkSession, d: str) -> DataFrame:
    pixels = raster(spark, d).where("ch_idx = 0")
    ends = pixels.where("x < 2").groupBy("y").agg(F.max(F.when(F.col("x") == 0, F.col("v"))).cast("int").alias("a"), F.max(F.when(F.col("x") == 1, F.col("v"))).cast("int").alias("b"))
    left, right = "if(y % 2 = 0, 3 + a % 20, 2)", "if(y % 2 = 0, 61 - b % 20, 63)"
    sides = ends.selectExpr("0 as side", "y as nth", f"cast({left} as double) as x", "cast(y as double) as y").unionByName(ends.selectExpr("1 as side", "-y as nth", f"cast({right} as double) as x", "cast(y as double) as y"))
    outline = sides.agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "nth", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))  # one outline is one value, as it is drawn
    zero = [F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return rg.members(pixels.select("y", "x"), outline.select(F.lit("zigzag").alias("name"), F.lit("freehand").alias("roi_type"), *zero, "points"), height(spark, d), W)


@query("A21 H4p", f"with {SQL_IMAGE_ROIS} select image_id, greatest(trunc(min(y1) * 4), 0)::int as y1, least(trunc(max(y2) * 4), 210)::int as y2, greatest(trunc(min(x1) * 4), 0)::int as x1, least(trunc(max(x2) * 4), 380)::int as x2 from ir group by image_id")
def roi_union_bbox(spark: SparkSession, d: str) -> DataFrame:
    return rg.union_box(image_rois(spark, d), 4, 210, 380, ["image_id"])


@query("A22", f"with {SQL_OUTLINES} select image_id, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2 from pt group by image_id")
def freehand_bbox(spark: SparkSession, d: str) -> DataFrame:
    return outlines(spark, d).select("image_id", rg.points_box(F.col("points")).alias("q")).select("image_id", "q.*")


@query("X8", f"with {SQL_OUTLINES}, f as (select image_id, count(*) as n, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2, list({{'x': x, 'y': y}} order by k, x, y)[1] as p from pt group by image_id) select image_id, n >= 3 and 2 * sqrt(power(14 - p.x, 2) + power(14 - p.y, 2)) <= 12 as closes, (x2 - x1) * 2 > 3 and (y2 - y1) * 2 > 3 as large from f")
def roi_closing_rule(spark: SparkSession, d: str) -> DataFrame:
    drawn = outlines(spark, d).select("image_id", "points", rg.points_box(F.col("points")).alias("q")).select("image_id", "points", "q.*")
    return drawn.select("image_id", rg.closes(F.col("points"), F.lit(14.0), F.lit(14.0), 2.0).alias("closes"), rg.large_enough(2.0).alias("large"))


@query("W11", f"with {SQL_IMAGE_ROIS} select image_id, seq, coalesce(name, 'ROI-' || row_number() over (partition by image_id order by seq)) as name from ir")
def roi_naming(spark: SparkSession, d: str) -> DataFrame:
    return rg.named(image_rois(spark, d), "seq", ["image_id"]).select("image_id", "seq", "name")


@query("M7", f"with {SQL_IMAGE_ROIS} select image_id, seq from ir where seq < (select max(o.seq) from ir o where o.image_id = ir.image_id)")
def roi_undo(spark: SparkSession, d: str) -> DataFrame:
    return rg.without_last(image_rois(spark, d), "seq", ["image_id"]).select("image_id", "seq")


_DIST = "sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2))"


@query("J9 X7 D15", f"with {SQL_CENTROIDS} select a.cell_id as src, b.cell_id as dst, round({_DIST}, 4) as dist from cn a join cn b on a.cell_id <> b.cell_id and {_DIST} <= 1.5")
def neighbours_radius(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.radius_join(centroids(spark, d), 1.5))


@query("J9 D15", f"with {SQL_CENTROIDS}, e as (select a.cell_id as src, {_DIST} as dist from cn a join cn b on a.cell_id <> b.cell_id and {_DIST} <= 1.5) select cell_id, coalesce(n, 0) as degree, round(m, 4) as mean_dist from cn left join (select src, count(*) as n, avg(dist) as m from e group by src) q on q.src = cell_id")
def neighbour_degree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.degrees(centroids(spark, d), 1.5))


@query("J9 D15 X7", f"with {SQL_CENTROIDS}, e as (select a.cell_id, list(b.cell_id order by b.cell_id) as l from cn a join cn b on a.cell_id <> b.cell_id and {_DIST} <= 1.5 group by 1) select cn.cell_id, coalesce(array_to_string(l, ','), '') as neighbours from cn left join e on e.cell_id = cn.cell_id")
def neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    return sp.adjacency(centroids(spark, d), 1.5).select("cell_id", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ",").alias("neighbours"))


@query("J10 T1 X7", f"with {SQL_CENTROIDS} select cell_id, round(sqrt(power(y - 1, 2) + power(x + 2, 2)), 4) as dist from cn order by sqrt(power(y - 1, 2) + power(x + 2, 2)), cell_id limit 12")
def knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.nearest(centroids(spark, d), 1.0, -2.0, 12))


@query("J10 T1", f"with {SQL_CENTROIDS}, p as (select a.cell_id as query_id, b.cell_id, {_DIST} as dist from cn a join cn b on true where a.cell_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by dist, cell_id) as rank from p) select query_id, cell_id, round(dist, 4) as dist, rank::int as rank from r where rank <= 5")
def knn_batched(spark: SparkSession, d: str) -> DataFrame:
    c = centroids(spark, d)
    return rounded(sp.nearest_of(c, c.where("cell_id % 50 = 0").selectExpr("cell_id as query_id", "y as qy", "x as qx"), 5))


@query("J11 X6 X7", f"with {SQL_CENTROIDS} select cell_id, round(sqrt(power(y - 1, 2) + power(x + 2, 2)), 4) as dist from cn where sqrt(power(y - 1, 2) + power(x + 2, 2)) <= 10")
def radius_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.within(centroids(spark, d), 1.0, -2.0, 10.0))


@query("J11 X6 X7", f"with {SQL_CENTROIDS} select cell_id, round(sqrt(power(y - 1, 2) + power(x + 2, 2)), 4) as dist from cn where sqrt(power(y - 1, 2) + power(x + 2, 2)) <= 10")
def curve_radius(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.CurveIndex.write(centroids(spark, d), new_path(spark, "curve"), 16).within(1.0, -2.0, 10.0))


@query("J10 T1 X6", f"with {SQL_CENTROIDS} select cell_id, round(sqrt(power(y - 1, 2) + power(x + 2, 2)), 4) as dist from cn order by sqrt(power(y - 1, 2) + power(x + 2, 2)), cell_id limit 12")
def curve_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sp.CurveIndex.write(centroids(spark, d), new_path(spark, "curve"), 16).nearest(1.0, -2.0, 12))


_LB = f"{_RA}, lb as (select y, x, cell_id from ra where ch_idx = 0)"
_BESIDE = ", ".join(f"{f}(cell_id) over (partition by {a} order by {b}) as {f}_{b}" for a, b in (("y", "x"), ("x", "y")) for f in ("lag", "lead"))
_EDGE = f"nb as (select *, {_BESIDE} from lb), ed as (select y, x, cell_id from nb where cell_id > 0 and (lag_x <> cell_id or lead_x <> cell_id or lag_y <> cell_id or lead_y <> cell_id))"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).where("ch_idx = 0").select("y", "x", "cell_id")


@query("O1 J16 W7", f"{_LB}, {_EDGE} select y, x, cell_id from ed")
def label_boundary(spark: SparkSession, d: str) -> DataFrame:
    return lb.boundary(_labels(spark, d))


@query("O2", f"{_LB}, {_EDGE}, gr as (select distinct y + dy as y, x + dx as x from ed, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx)) select lb.y, lb.x, case when gr.y is null then 7 else 255 end as r, case when gr.y is null then 7 else 0 end as g, case when gr.y is null then 7 else 40 end as b from lb left join gr on gr.y = lb.y and gr.x = lb.x")
def boundary_overlay(spark: SparkSession, d: str) -> DataFrame:
    return ov.outline(_labels(spark, d).selectExpr("y", "x", "7 as r", "7 as g", "7 as b"), _labels(spark, d), (255, 0, 40), 2, height(spark, d), W)


@query("O2 R15", f"{_LB}, {_EDGE} select lb.y, lb.x, min(abs(lb.y - ed.y) + abs(lb.x - ed.x))::int as d from lb join ed on abs(lb.y - ed.y) + abs(lb.x - ed.x) <= 9 group by lb.y, lb.x")
def edge_distance(spark: SparkSession, d: str) -> DataFrame:
    return lb.distances(lb.boundary(_labels(spark, d)), height(spark, d), W, 9, tile=32)


@query(
    "G3 G7",
    f"with recursive {sql_raster()}, on_ as (select y, x, y::bigint * {W} + x as id from ra where ch_idx = 0 and v >= 150), st(dy, dx) as (values (0, 1), (0, -1), (1, 0), (-1, 0)), "
    "nx as (select a.id, b.id as other from on_ a cross join st join on_ b on b.y = a.y + dy and b.x = a.x + dx), "
    "rc as (select id, id as root from on_ union select nx.other, rc.root from rc join nx on nx.id = rc.id where rc.root < nx.other) "
    "select y, x, min(root) as cell_id from on_ join rc using (id) group by y, x",
)
def mask_objects(spark: SparkSession, d: str) -> DataFrame:
    return bs.mask_components(raster(spark, d).where("ch_idx = 0 and v >= 150").select("y", "x"), W, tile=16)


@query(
    "G1 G2",
    f"with recursive {sql_raster()}, im as (select y, x, y::bigint * {W} + x as id, v > 40 as held from ra where ch_idx = 0), "
    "dd as (select a.y, a.x, a.id, coalesce(min(abs(a.y - b.y) + abs(a.x - b.x)), 7)::int as ht from (select * from im where held) a left join (select * from im where not held) b on b.y between a.y - 6 and a.y + 6 and b.x between a.x - 6 and a.x + 6 and abs(a.y - b.y) + abs(a.x - b.x) <= 6 group by a.y, a.x, a.id), "
    "st(dy, dx) as (select y.i, x.i from (values (-1), (0), (1)) y(i), (values (-1), (0), (1)) x(i)), "
    "nx as (select a.id, arg_max(b.id, b.ht * 1000000000000 - b.id) as other from dd a cross join st join dd b on b.y = a.y + dy and b.x = a.x + dx group by a.id), "
    "ch as (select id, id as at_ from dd union select ch.id, nx.other from ch join nx on nx.id = ch.at_) "
    "select y, x, nx.id as cell_id from dd join ch using (id) join nx on nx.id = ch.at_ and nx.other = nx.id",
)
def watershed_objects(spark: SparkSession, d: str) -> DataFrame:
    return bs.watershed(raster(spark, d).where("ch_idx = 0").select("y", "x", "v"), height(spark, d), W, 40.0, sigma=0, most=6, tile=16)


@query("U4 R15", f"{_LB}, {_EDGE}, sh as (select y, x + 1 as x from ed) select y, x from ed where (y, x) not in (select (y, x) from sh) union all select y, x from sh where (y, x) not in (select (y, x) from ed)")
def mask_xor(spark: SparkSession, d: str) -> DataFrame:
    edge = lb.boundary(_labels(spark, d)).select("y", "x")
    return lb.xor(edge, edge.withColumn("x", F.col("x") + 1))


_HUE = "(cell_id * 0.618033988749895::double) - floor(cell_id * 0.618033988749895::double)"
_V, _P = 0.95, 0.95 * (1 - 0.85)
_Q, _TT = "0.95::double * (1 - 0.85::double * f)", "0.95::double * (1 - 0.85::double * (1 - f))"


def _hsv(order: tuple[str, ...]) -> str:
    return "floor((case s % 6 " + " ".join(f"when {k} then {e}" for k, e in enumerate(order)) + " end) * 255)::int"


_VS, _PS = "0.95::double", f"{_P!r}::double"
_COLOUR = f"{_hsv((_VS, _Q, _PS, _PS, _TT, _VS))} as r, {_hsv((_TT, _VS, _VS, _Q, _PS, _PS))} as g, {_hsv((_PS, _PS, _TT, _VS, _VS, _Q))} as b"


@query("O3", f"{_LB}, c as (select distinct cell_id, {_HUE} as h from lb where cell_id > 0), s as (select cell_id, floor(h * 6)::int as s, h * 6 - floor(h * 6) as f from c) select cell_id, {_COLOUR} from s")
def cell_unique_color(spark: SparkSession, d: str) -> DataFrame:
    return ov.unique_colours(_labels(spark, d).where("cell_id > 0").select("cell_id").distinct())


@query("O3", f"{_LB}, {_EDGE}, s as (select y, x, cell_id, floor(({_HUE}) * 6)::int as s, ({_HUE}) * 6 - floor(({_HUE}) * 6) as f from ed) select y, x, cell_id, {_COLOUR} from s")
def unique_outline(spark: SparkSession, d: str) -> DataFrame:
    return ov.unique_outline(_labels(spark, d))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).where("cell_id > 0 and cell_id <> 9").groupBy("cell_id").agg(F.sum((F.col("y") + F.col("x")).cast("double")).alias("val"))


def _ramp(k: int) -> str:
    stops = "[" + ", ".join(f"{float(s[k])}::double" for s in ov.VALUE_STOPS) + "]"
    return f"floor({stops}[a + 1] + ({stops}[a + 2] - {stops}[a + 1]) * (n * 4 - a))::int"


_VMAP = f"{_LB}, {_EDGE}, va as (select cell_id, sum(y + x)::double as val from lb where cell_id > 0 and cell_id <> 9 group by 1), nn as (select cell_id, (val - min(val) over ()) / (max(val) over () - min(val) over ()) as n from va), mp as (select y, x, lb.cell_id, n, least(floor(n * 4), 3)::int as a from lb left join nn using (cell_id)), "
_VMAP += "vm as (select y, x, " + ", ".join(f"case when n is null then {b} else {_ramp(k)} end as {c}" for k, (c, b) in enumerate(zip("rgb", ov.DARK))) + " from mp)"


@query("O4 O5 J3", f"{_VMAP} select y, x, r, g, b from vm")
def cell_color_map(spark: SparkSession, d: str) -> DataFrame:
    return ov.value_map(_labels(spark, d), _values(spark, d), "val")


@query("O5", f"{_VMAP} select vm.y, vm.x, " + ", ".join(f"case when ed.y is null then {c} else 255 end as {c}" for c in "rgb") + " from vm left join ed on ed.y = vm.y and ed.x = vm.x")
def spatial_value_map(spark: SparkSession, d: str) -> DataFrame:
    return ov.value_map(_labels(spark, d), _values(spark, d), "val", edges=True)


@query("O4", f"{_VMAP} select y, x, " + ", ".join(f"floor({k}::double * (1 - 0.4::double) + {c} * 0.4::double)::int as {c}" for c, k in (("r", 100), ("g", 50), ("b", 0))) + " from vm")
def value_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = _labels(spark, d).selectExpr("y", "x", "100 as r", "50 as g", "0 as b")
    return ov.blend_value(base, ov.value_map(_labels(spark, d), _values(spark, d), "val"))


@query("O6 J4 J3", f"{_LB}, ce as (select distinct cell_id, case cell_id % 3 when 0 then 'A+' when 1 then 'A−' end as ph from lb where cell_id > 0 and cell_id % 3 < 2), p as (select y, x, ph from lb left join ce using (cell_id)) select y, x, case ph when 'A+' then 10 when 'A−' then 255 else 10 end as r, case ph when 'A+' then 132 when 'A−' then 69 else 11 end as g, case ph when 'A+' then 255 when 'A−' then 58 else 16 end as b from p")
def phenotype_map(spark: SparkSession, d: str) -> DataFrame:
    cells = _labels(spark, d).where("cell_id > 0 and cell_id % 3 < 2").selectExpr("cell_id", "case cell_id % 3 when 0 then 'A+' else 'A−' end as phenotype").distinct()
    return ov.phenotype_map(_labels(spark, d), cells, spark.createDataFrame([("A+", "#0a84ff"), ("A−", "#ff453a")], "phenotype string, colour string"))


_G0, _G1 = GROUP_COLOURS[:2]


@query("O7 W9", f"{_LB} select y, x, " + ", ".join(f"(case when cell_id > 0 and cell_id % 2 = 0 then case when cell_id % 3 = 0 then floor(floor(40 * 0.5 + {_G0[k]} * 0.5) * 0.5 + {_G1[k]} * 0.5) else floor(40 * 0.5 + {_G0[k]} * 0.5) end when cell_id > 0 and cell_id % 3 = 0 then floor(40 * 0.5 + {_G1[k]} * 0.5) else 40 end)::int as {c}" for k, c in enumerate("rgb")) + " from lb")
def group_overlay(spark: SparkSession, d: str) -> DataFrame:
    ids = _labels(spark, d).where("cell_id > 0").select("cell_id").distinct()
    groups = [ids.where(f"cell_id % {m} = 0").select("cell_id", F.lit(k).cast("long").alias("ord"), *(F.lit(v).alias(c) for c, v in zip("rgb", GROUP_COLOURS[k % len(GROUP_COLOURS)]))) for k, m in enumerate((2, 3))]
    return ov.group_overlay(_labels(spark, d).selectExpr("y", "x", "40 as r", "40 as g", "40 as b"), _labels(spark, d), groups[0].unionByName(groups[1]))


@query("W1", f"with {SQL_WIDE}, i as (select cell_id, dense_rank() over (order by cell_id) as new_id from (select distinct cell_id * 7 as cell_id from wp where cell_id > 0)) select w.cell_id * 7 as cell_id, y, x, coalesce(new_id, 0) as new_id from wp w left join i on i.cell_id = w.cell_id * 7")
def relabel_dense(spark: SparkSession, d: str) -> DataFrame:
    return lb.relabel_dense(wide_pixels(spark, d).selectExpr("cell_id * 7 as cell_id", "y", "x"))


@query("G3 W2", "with g as (select y.i * 896 as y1, x.i * 896 as x1 from range(4) y(i), range(6) x(i) where y.i * 896 < 2700 and x.i * 896 < 4500), c as (select y1, least(y1 + 1024, 2700) as y2, x1, least(x1 + 1024, 4500) as x2 from g), k as (select *, row_number() over (order by y1, x1) - 1 as t from c where y2 - y1 >= 64 and x2 - x1 >= 64) select t::int as tile_idx, t * 4294967296 as id_offset, y1::int as y1, y2::int as y2, x1::int as x1, x2::int as x2 from k")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return lb.tile_grid(spark, 2700, 4500)


@query("W5 G3", f"{_LB}, t as (select 0 as t, y, x, cell_id from lb where x < 60 union all select 1, y, x, cell_id + 10000 from lb where x >= 40 and cell_id > 0), f as (select *, row_number() over (partition by y, x order by t) as k from t where cell_id > 0) select y, x, cell_id from f where k = 1")
def tile_merge_first(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    tiles = labels.where("x < 60").withColumn("tile_idx", F.lit(0)).unionByName(labels.where("x >= 40 and cell_id > 0").withColumns({"cell_id": F.col("cell_id") + 10000, "tile_idx": F.lit(1)}))
    return lb.first_writer(tiles)


@query("W3 G7", f"{_LB}, m as (select y // 16 as roi_idx, max(case when y // 16 = 1 then 0 else cell_id end) as max_id from lb group by 1) select roi_idx, max_id, coalesce(sum(max_id) over (order by roi_idx rows between unbounded preceding and 1 preceding), 0)::bigint as id_offset from m")
def roi_id_offsets(spark: SparkSession, d: str) -> DataFrame:
    return lb.roi_offsets(_labels(spark, d).selectExpr("y div 16 as roi_idx", "case when y div 16 = 1 then 0 else cell_id end as cell_id"))


@query("G7 U5", f"{_LB}, m as (select y // 16 as r, max(cell_id) as mx from lb group by 1), o as (select r, coalesce(sum(mx) over (order by r rows between unbounded preceding and 1 preceding), 0) as off from m) select y, x, case when cell_id > 0 then cell_id + off else 0 end::bigint as cell_id from lb join o on o.r = y // 16")
def roi_segment_merge(spark: SparkSession, d: str) -> DataFrame:
    return lb.segment_rois(_labels(spark, d).selectExpr("y div 16 as roi_idx", "y", "x", "cell_id"))


_SEG = (
    f"{_RA}, ty as (select (row_number() over (order by y1) - 1)::int as i, y1, least(y1 + 24, hh) as y2 from (select unnest(range(0, hh, 16)) as y1, hh from hh) where least(y1 + 24, hh) - y1 >= 8), "
    f"tx as (select (row_number() over (order by x1) - 1)::int as j, x1, least(x1 + 24, {W}) as x2 from (select unnest(range(0, {W}, 16)) as x1) where least(x1 + 24, {W}) - x1 >= 8), "
    "tp as (select i * (select count(*) from tx) + j as t, y, x, v from ra join ty on y >= y1 and y < y2 join tx on x >= x1 and x < x2 where ch_idx = 2), "
    "me as (select t, avg(v) as m from tp group by t), on_ as (select tp.t, y, x, y * 1000 + x as p from tp join me on me.t = tp.t and v > m), "
    "nx as (select a.t, a.p, b.p as q from on_ a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx), on_ b where b.t = a.t and b.y = a.y + dy and b.x = a.x + dx), "
    "re as (select t, p, p as q from on_ union select re.t, re.p, nx.q from re join nx on nx.t = re.t and nx.p = re.q), "
    "co as (select t, p, min(q) as c from re group by t, p), "
    "id as (select t, c, row_number() over (order by t, c) as nth from (select distinct t, c from co)), "
    "px as (select p, t, nth, row_number() over (partition by p order by t) as k from co join id using (t, c)), "
    "fw as (select p, nth from px where k = 1), de as (select nth, row_number() over (order by nth) as cell_id from (select distinct nth from fw)) "
)


@query("G1 G2 G3 G4 G6", _SEG.replace("with ", "with recursive ", 1) + "select (p // 1000)::int as y, (p % 1000)::int as x, cell_id from fw join de using (nth)")
def segment_tiled_toy(spark: SparkSession, d: str) -> DataFrame:
    return lb.segment_tiles(raster(spark, d).where("ch_idx = 2"), height(spark, d), W, size=24, overlap=8, single_max=48, sliver=8)


@query("P19", "select p_partkey, round(greatest(0.01::double, 0.5::double * power(1.35::double, p_size % 7 - 3)), 4) as zoom, round(100 - (100.0::double - 10) * power(1.35::double, p_size % 7 - 3), 4) as pan from part")
def zoom_at_pointer(spark: SparkSession, d: str) -> DataFrame:
    from .registry import table

    z = rs.zoomed_at(F.lit(0.5), F.lit(10.0), F.lit(100.0), F.col("p_size") % 7 - 3)
    return rounded(table(spark, d, "part").select("p_partkey", z["zoom"].alias("zoom"), z["pan"].alias("pan")))


@query("G8", "select 'threshold' as name, true as built_in union all select 'cellpose', false union all select 'mesmer', false")
def segmenters_listed(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(name, module is None) for name, (module, _) in lb.SEGMENTERS.items()], "name string, built_in boolean")


@query("P1", "select event_id, least(greatest(value, 10), 50) as v from events")
def clip_values(spark: SparkSession, d: str) -> DataFrame:
    from .registry import table

    return table(spark, d, "events").select("event_id", clip(F.col("value"), 10.0, 50.0).alias("v"))
