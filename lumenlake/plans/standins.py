"""The driver's tables seen as rasters, labels, cells, regions and notes; the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import rows_as_tiles
from .registry import NUDGE, table

CHANNELS = {"QTY": "qty", "PRICE": "price", "DISC": "disc", "TAX": "tax"}


def wide_pixels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as labelled pixels: cell_id, y, x and four channels."""
    return table(spark, d, "lineitem").selectExpr("l_partkey as cell_id", "l_linenumber as y", "l_orderkey as x", "l_quantity as qty", "l_extendedprice as price", "l_discount as disc", "l_tax as tax")


SQL_WIDE = "wp as (select l_partkey as cell_id, l_linenumber as y, l_orderkey as x, l_quantity as qty, l_extendedprice as price, l_discount as disc, l_tax as tax from lineitem)"


def long_pixels(spark: SparkSession, d: str) -> DataFrame:
    return wide_pixels(spark, d).selectExpr("cell_id", "y", "x", "stack(4, 0, qty, 1, price, 2, disc, 3, tax) as (ch_idx, v)")


SQL_LONG = SQL_WIDE + ", px as (select cell_id, y, x, unnest([0, 1, 2, 3]) as ch_idx, unnest([qty, price, disc, tax]) as v from wp)"

_PARAMS = [
    (0, True, "QTY", "Green (FITC)", 0.0, 50.0, 1.0, 1.0, 0, 255, 0),
    (1, True, "DAPI price", "Blue (DAPI)", 1000.0, 90000.0, 1.2, 0.8, 0, 100, 255),
    (2, False, "DISC", "Red (Cy5)", 0.0, 0.1, 1.0, 1.0, 255, 0, 0),
    (3, True, "TAX", "Orange", 0.0, 0.08, 1.5, 2.0, 255, 165, 0),
]


def params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PARAMS, "ch_idx int, visible boolean, name string, color_name string, min double, max double, brightness double, gamma double, r int, g int, b int")


SQL_PARAMS = (
    "pr(ch_idx, visible, name, color_name, mn, mx, brightness, gamma, r, g, b) as (values "
    "(0, true, 'QTY', 'Green (FITC)', 0.0::double, 50.0::double, 1.0::double, 1.0::double, 0, 255, 0), "
    "(1, true, 'DAPI price', 'Blue (DAPI)', 1000.0, 90000.0, 1.2, 0.8, 0, 100, 255), "
    "(2, false, 'DISC', 'Red (Cy5)', 0.0, 0.1, 1.0, 1.0, 255, 0, 0), "
    "(3, true, 'TAX', 'Orange', 0.0, 0.08, 1.5, 2.0, 255, 165, 0))"
)
SQL_ADJ = (
    SQL_LONG + ", " + SQL_PARAMS + ", adj as (select px.*, least(greatest(least(greatest((v - mn) / (case when mx <= mn then mn + 1 else mx end - mn), 0), 1) * brightness, 0), 1) as n from px join pr using (ch_idx) where visible)"
)


def dense(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a dense raster: y, x, v (0 to 255, whole) and the label of the row as cell_id."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.col("label").alias("cell_id"), F.posexplode("embedding").alias("x", "e")).selectExpr("y", "x", "cell_id", "cast(floor(abs(cast(e as double)) * 1000) % 256 as double) as v")


SQL_DENSE = "dr as (select y, x - 1 as x, cell_id, floor(abs(e::double) * 1000) % 256 as v from (select vec_id::int as y, label as cell_id, unnest(embedding) as e, unnest(range(1, len(embedding) + 1))::int as x from embeddings))"


#: Columns of the raster of embeddings; its rows are as many as the table's.
WIDTH = 64


def height(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def raster(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a raster of whole numbers in three channels, a row of pixels for each vector, with labels in blocks."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e")).selectExpr("y", "x", "abs(cast(e as double)) as e")
    return e.selectExpr(
        "y", "x", "case when (y div 8 + x div 8) % 3 = 0 then 0 else cast((y div 8) * 8 + x div 8 + 1 as int) end as cell_id",
        "stack(3, 0, floor(e * 1000) % 256d, 1, floor(e * 7919) % 251d, 2, floor(e * 104729) % 241d) as (ch_idx, v)",
    )


def raster_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The samples of raster(), a row of pixels of a channel in each tile; no sample is a row of its own."""
    sample = lambda k, n: f"transform(embedding, e -> floor(abs(cast(e as double)) * {k}) % {n}d)"
    return rows_as_tiles(table(spark, d, "embeddings"), "vec_id", {0: sample(1000, 256), 1: sample(7919, 251), 2: sample(104729, 241)}, WIDTH)


def sql_raster() -> str:
    return (
        "hh as (select max(vec_id)::int + 1 as hh from embeddings), "
        "ra0 as (select y, x - 1 as x, abs(e::double) as e from (select vec_id::int as y, unnest(embedding) as e, unnest(range(1, len(embedding) + 1))::int as x from embeddings)), "
        "ra as (select y, x, case when (y // 8 + x // 8) % 3 = 0 then 0 else ((y // 8) * 8 + x // 8 + 1)::int end as cell_id, unnest([0, 1, 2]) as ch_idx, "
        "unnest([floor(e * 1000) % 256, floor(e * 7919) % 251, floor(e * 104729) % 241]) as v from ra0)"
    )


_RPARAMS = [(0, True, 10.0, 200.0, 1.0, 1.0, 0, 100, 255), (1, True, 0.0, 180.0, 1.1, 0.5, 0, 255, 0), (2, True, 5.0, 5.0, 1.0, 1.0, 255, 0, 0)]


def raster_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RPARAMS, "ch_idx int, visible boolean, min double, max double, brightness double, gamma double, r int, g int, b int")


SQL_RPARAMS = (
    "rp(ch_idx, visible, mn, mx, brightness, gamma, r, g, b) as (values (0, true, 10.0::double, 200.0::double, 1.0::double, 1.0::double, 0, 100, 255), "
    "(1, true, 0.0, 180.0, 1.1, 0.5, 0, 255, 0), (2, true, 5.0, 5.0, 1.0, 1.0, 255, 0, 0))"
)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell table of lineitem with the mean of each channel, rounded so that both engines compare the same values."""
    return wide_pixels(spark, d).where("cell_id > 0").groupBy("cell_id").agg(*(F.round(F.avg(c) + NUDGE, 4).alias(f"mean_{n}") for n, c in CHANNELS.items()))


SQL_CELLS = SQL_WIDE + ", ce as (select cell_id, round(avg(qty), 4) as mean_qty, round(avg(price), 4) as mean_price, round(avg(disc), 4) as mean_disc, round(avg(tax), 4) as mean_tax from wp where cell_id > 0 group by cell_id)"


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id as cell_id", "cast(embedding[0] as double) * 100 as y", "cast(embedding[1] as double) * 100 as x")


SQL_CENTROIDS = "cn as (select vec_id as cell_id, embedding[1]::double * 100 as y, embedding[2]::double * 100 as x from embeddings)"

_ROIS = [
    ("rect", "rect", 5.0, 7.0, 40.5, 30.0, []),
    ("ring", "circle", 20.0, 10.0, 60.0, 50.0, []),
    ("free", "freehand", 10.0, 10.0, 70.0, 50.0, [(10.0, 10.0), (70.0, 15.0), (50.0, 50.0), (20.0, 45.0)]),
    ("off", "rect", 90.0, 60.0, 140.0, 90.0, []),
    ("line", "freehand", 1.0, 1.0, 5.0, 5.0, [(1.0, 1.0), (5.0, 5.0)]),
]


def rois(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROIS, "name string, roi_type string, x1 double, y1 double, x2 double, y2 double, points array<struct<x:double,y:double>>")


SQL_ROIS = "ro(name, roi_type, x1, y1, x2, y2) as (values ('rect', 'rect', 5.0::double, 7.0::double, 40.5::double, 30.0::double), ('ring', 'circle', 20.0, 10.0, 60.0, 50.0), ('free', 'freehand', 10.0, 10.0, 70.0, 50.0), ('off', 'rect', 90.0, 60.0, 140.0, 90.0), ('line', 'freehand', 1.0, 1.0, 5.0, 5.0))"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notes: turn 0 is the note, the others its replies."""
    c = table(spark, d, "conversations")
    first = c.where("turn = 0").selectExpr(
        "conv_id as pos", "concat('n', conv_id) as id", "text", "cast(conv_id % 100 as double) as x", "cast(conv_id % 70 as double) as y",
        "case conv_id % 4 when 0 then 'rect' when 1 then 'ring' else null end as linked_roi", "concat('2024-01-', lpad(cast(conv_id % 28 + 1 as string), 2, '0'), 'T10:20:30') as created",
        "concat('user', conv_id % 3) as author", "concat('m', conv_id % 2) as machine_id",
    )
    rest = c.where("turn > 0").groupBy(F.col("conv_id").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("r"), "turn").alias("id"), F.col("text"), F.lit("2024-02-03T04:05:06").alias("created"), F.col("role").alias("author"), F.concat(F.lit("m"), F.col("turn") % 2).alias("machine_id")))).alias("replies")
    )
    none = "array<struct<turn:bigint,id:string,text:string,created:string,author:string,machine_id:string>>"
    return first.join(rest, "pos", "left").withColumn("replies", F.coalesce("replies", F.array().cast(none)))


SQL_NOTES = (
    "no as (select conv_id as pos, 'n' || conv_id as id, text, (conv_id % 100)::double as x, (conv_id % 70)::double as y, "
    "case conv_id % 4 when 0 then 'rect' when 1 then 'ring' else null end as linked_roi, '2024-01-' || lpad((conv_id % 28 + 1)::varchar, 2, '0') || 'T10:20:30' as created, "
    "'user' || (conv_id % 3) as author, 'm' || (conv_id % 2) as machine_id from conversations where turn = 0), "
    "re as (select conv_id as pos, turn, 'r' || turn as id, text, role as author, 'm' || (turn % 2) as machine_id from conversations where turn > 0)"
)

# the same expressions in both engines
_IMAGE_ROIS = (
    "o_custkey as image_id", "o_orderkey as seq", "case when o_orderkey % 3 = 0 then o_orderpriority end as name", "cast(o_orderkey % 97 as double) as x1", "cast(o_orderkey % 53 as double) as y1",
    "cast(o_orderkey % 97 + o_orderkey % 11 as double) as x2", "cast(o_orderkey % 53 + o_orderkey % 9 as double) as y2",
)
_IMAGE_PARAMS = "l_orderkey as image_id", "l_linenumber as ch_idx", "l_linenumber % 2 = 0 as visible", "l_quantity as {min}", "l_extendedprice as {max}", "1 + l_discount as brightness", "1 + l_tax as gamma"


def image_rois(spark: SparkSession, d: str) -> DataFrame:
    """orders as regions, a customer's on one image: image_id, seq, name (null of two in three), x1, y1, x2, y2."""
    return table(spark, d, "orders").selectExpr(*_IMAGE_ROIS)


SQL_IMAGE_ROIS = f"ir as (select {', '.join(_IMAGE_ROIS)} from orders)"


def image_params(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as display settings, an order's of one image: image_id, ch_idx, visible, min, max, brightness, gamma."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return lines.selectExpr(*(e.format(min="min", max="max") for e in _IMAGE_PARAMS))


SQL_IMAGE_PARAMS = f"ip as (select {', '.join(_IMAGE_PARAMS).format(min='mn', max='mx')} from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice, max(l_discount) as l_discount, max(l_tax) as l_tax from lineitem group by 1, 2))"


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as outlines drawn by hand, an order's lines being the points of one: image_id, points."""
    point = F.struct("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_suppkey") % 24).cast("double").alias("y"))
    drawn = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return drawn.select("image_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


SQL_OUTLINES = "pt as (select l_orderkey as image_id, l_linenumber as k, l_quantity as x, (l_suppkey % 24)::double as y from lineitem)"
