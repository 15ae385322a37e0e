"""Regions of interest: membership, boxes, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checked_small, written


def frame_box(h: int, w: int, scale: float = 1.0) -> dict[str, Column]:
    """The box of a region (columns x1, y1, x2, y2) scaled, truncated and held to the frame."""
    low = lambda c: F.greatest((F.col(c) * scale).cast("int"), F.lit(0))
    high = lambda c, n: F.least((F.col(c) * scale).cast("int"), F.lit(n))
    return {"sx1": low("x1"), "sy1": low("y1"), "sx2": high("x2", w), "sy2": high("y2", h)}


def in_rect() -> Column:
    return (F.col("x") >= F.col("sx1")) & (F.col("x") < F.col("sx2")) & (F.col("y") >= F.col("sy1")) & (F.col("y") < F.col("sy2"))


def in_ellipse() -> Column:
    """On or inside the ellipse of the box; radii are 1 at least."""
    half = lambda a, b: F.greatest((F.col(b) - F.col(a)) / 2, F.lit(1.0))
    off = lambda p, a, b: F.pow((F.col(p) - (F.col(a) + F.col(b)) / 2) / half(a, b), F.lit(2))
    return off("x", "sx1", "sx2") + off("y", "sy1", "sy2") <= 1.0


def in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the edges of array<struct<x, y>>; a point on an edge is inside; fewer than three points: false."""
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(points, (i + 1) % n)["x"].alias("bx"), F.get(points, (i + 1) % n)["y"].alias("by")))

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0)) + e["ax"]
        return F.coalesce(spans & (x < at), F.lit(False))

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    odd = F.aggregate(edges, F.lit(False), lambda a, e: F.when(crosses(e), ~a).otherwise(a))
    return F.coalesce((n > 2) & (F.exists(edges, on) | odd), F.lit(False))


#: Side of the squares on which pixels and regions meet.
SQUARE = 256


def _squares(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / SQUARE).cast("int"), F.floor(F.greatest(high, low) / SQUARE).cast("int"))


def _int_points(scale: float) -> Column:
    return F.transform("points", lambda p: F.struct((p["x"] * scale).cast("int").alias("x"), (p["y"] * scale).cast("int").alias("y")))


def outline_spans(rois: DataFrame, scale: float = 1.0) -> DataFrame:
    """(roi_name, y, x1, x2): the runs of pixels, ends with, that each outline holds in each row, none touching another.

    An outline's edges become rows; each crosses the rows of pixels between its ends, at a place known exactly in whole
    numbers. In order, a row's crossings begin and end runs by turns (even-odd rule). Pixels that an edge goes through are
    runs of their own, and runs that touch are one. The work is the outline's length in rows and the sort of its
    crossings, whatever the number of pixels. Outlines of fewer than three points hold nothing; a name's equal outlines
    count once.
    """
    keys = ["roi_name", "__outline"]
    points = _int_points(scale)
    outlines = rois.select(F.col("name").alias("roi_name"), points.alias("p")).where(F.size("p") > 2).withColumn("__outline", F.xxhash64("p")).dropDuplicates(keys)
    ends = outlines.withColumn("q", F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))).select(*keys, F.explode(F.arrays_zip("p", "q")).alias("e"))
    e = ends.select(*keys, *(F.col(f"e.{point}.{c}").cast("long").alias(f"{side}{c}") for point, side in (("p", "a"), ("q", "b")) for c in "xy"))
    flat = e.where("ay = by").select(*keys, F.col("ay").alias("y"), F.least("ax", "bx").alias("x1"), F.greatest("ax", "bx").alias("x2"))
    up = F.col("ay") < F.col("by")
    steep = e.where("ay <> by").select(*keys, *(F.when(up, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"a{c}") for c in "xy"), *(F.when(up, F.col(f"b{c}")).otherwise(F.col(f"a{c}")).alias(f"b{c}") for c in "xy"))
    at = steep.withColumn("y", F.explode(F.sequence("ay", "by")))
    # the crossing is ax + num / den; its floor and what is left over, with den > 0
    num, den = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")), F.col("by") - F.col("ay")
    at = at.withColumns({"left": F.pmod(num, den), "whole": F.col("ax") + F.expr("((bx - ax) * (y - ay) - pmod((bx - ax) * (y - ay), by - ay)) div (by - ay)")})
    on = at.where("left = 0").select(*keys, "y", F.col("whole").alias("x1"), F.col("whole").alias("x2"))
    turn = Window.partitionBy(*keys, "y").orderBy("x", "left", "ax", "bx", "ay", "by")
    cross = at.where("y < by").withColumn("x", F.col("whole") + (F.col("left") > 0).cast("long"))  # the first pixel to the right
    cross = cross.select(*keys, "y", F.row_number().over(turn).alias("nth"), F.col("x").alias("x1"), (F.lead("x").over(turn) - 1).alias("x2")).where("nth % 2 = 1 and x1 <= x2").drop("nth")
    rows = Window.partitionBy(*keys, "y").orderBy("x1", "x2")
    runs = cross.unionByName(on).unionByName(flat)
    fresh = F.coalesce(F.col("x1") > F.max("x2").over(rows.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    runs = runs.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(rows))
    runs = runs.groupBy(*keys, "y", "run").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    return runs.select("roi_name", F.col("y").cast("int").alias("y"), F.col("x1").cast("int").alias("x1"), F.col("x2").cast("int").alias("x2"))


#: Runs of outlines that are sent to all tasks, at most; about 40 bytes each.
MAX_RUNS = 500_000


def _in_outlines(pixels: DataFrame, rois: DataFrame, scale: float) -> DataFrame:
    """Pixels with the name of each outline that holds them: pixels and runs meet by row and stretch of SQUARE columns."""
    runs = outline_spans(rois, scale).withColumn("__sx", F.explode(F.sequence(F.floor(F.col("x1") / SQUARE).cast("int"), F.floor(F.col("x2") / SQUARE).cast("int"))))
    runs = checked_small(written(runs.withColumnRenamed("y", "__y"), "runs"), MAX_RUNS)
    own = pixels.withColumns({"__y": F.col("y").cast("int"), "__sx": F.floor(F.col("x") / SQUARE).cast("int")})
    return own.join(runs, ["__y", "__sx"]).where(F.col("x").between(F.col("x1"), F.col("x2"))).select("roi_name", *pixels.columns)


def _met(pixels: DataFrame, rois: DataFrame, h: int, w: int, scale: float) -> DataFrame:
    """Pixels in the box or shape of each region, with __in_shape and __in_box: by equal squares of the plane, or by runs of outlines."""
    boxes = rois.withColumns(frame_box(h, w, scale))
    reach = lambda low, high: _squares(F.col(low) - 1, F.col(high) + 1)  # noqa: E731 - an ellipse reaches beyond a thin box
    boxes = boxes.select(F.col("name").alias("roi_name"), "roi_type", "sx1", "sy1", "sx2", "sy2", F.explode(reach("sy1", "sy2")).alias("__sy"), reach("sx1", "sx2").alias("__across"))
    boxes = boxes.withColumn("__sx", F.explode("__across")).drop("__across")
    own = pixels.withColumns({"__sy": F.floor(F.col("y") / SQUARE).cast("int"), "__sx": F.floor(F.col("x") / SQUARE).cast("int")})
    kind = F.col("roi_type")
    shape = ((kind == "rect") & in_rect()) | ((kind == "circle") & in_ellipse())
    met = own.join(checked_small(boxes, MAX_RUNS), ["__sy", "__sx"]).withColumns({"__in_shape": F.coalesce(shape, F.lit(False)), "__in_box": in_rect()}).where("__in_shape or __in_box")
    met = met.select("roi_name", *pixels.columns, "__in_shape", "__in_box")
    outlines = rois.where("roi_type = 'freehand'")
    if outlines.isEmpty():
        return met
    return met.unionByName(_in_outlines(pixels, outlines, scale).withColumns({"__in_shape": F.lit(True), "__in_box": F.lit(False)}))


def members(pixels: DataFrame, rois: DataFrame, h: int, w: int, scale: float = 1.0) -> DataFrame:
    """Pixels with the name of each region that holds them (one row for each).

    Both sides meet on squares of SQUARE pixels, an equi-join, whatever the number of regions; outlines by their runs of
    pixels in each row: see outline_spans. rois: name, roi_type, x1, y1, x2, y2, points.
    """
    return _met(pixels, rois, h, w, scale).where("__in_shape").select("roi_name", *pixels.columns)


def members_or_box(pixels: DataFrame, rois: DataFrame, h: int, w: int, scale: float = 1.0) -> DataFrame:
    """As members, but a region that holds no pixel takes its whole box."""
    met = _met(pixels, rois, h, w, scale)
    held = met.groupBy("roi_name").agg(F.bool_or("__in_shape").alias("__some"))
    return met.join(held, "roi_name").where(F.when(F.col("__some"), F.col("__in_shape")).otherwise(F.col("__in_box"))).select("roi_name", *pixels.columns)


def union_box(rois: DataFrame, ds: int, h: int, w: int, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of by: the box around all regions at full resolution, held to the frame."""
    low = lambda c: F.greatest((F.min(c) * ds).cast("int"), F.lit(0))
    high = lambda c, n: F.least((F.max(c) * ds).cast("int"), F.lit(n))
    return rois.groupBy(*by).agg(low("y1").alias("y1"), high("y2", h).alias("y2"), low("x1").alias("x1"), high("x2", w).alias("x2"))


def points_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def closes(points: Column, x: Column, y: Column, zoom: float, reach: float = 12.0) -> Column:
    """A freehand outline closes with three points or more and a click within reach screen pixels of the first."""
    first = F.get(points, 0)
    return (F.size(points) >= 3) & (F.hypot(x - first["x"], y - first["y"]) * zoom <= reach)


def large_enough(zoom: float, least: float = 3.0) -> Column:
    """A dragged region has more than least screen pixels on each side."""
    return (F.abs(F.col("x2") - F.col("x1")) * zoom > least) & (F.abs(F.col("y2") - F.col("y1")) * zoom > least)


def named(rois: DataFrame, order_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Regions without a name get ROI-n by their order, among those of an image where by names its columns (regions are
    drawn by hand: those of one image are few)."""
    return rois.withColumn("name", F.coalesce("name", F.concat(F.lit("ROI-"), F.row_number().over(Window.partitionBy(*by).orderBy(order_col)))))


def without_last(rois: DataFrame, seq_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Undo: all but the region of the greatest sequence number, in each image where by names its columns (none null)."""
    if by:
        last = rois.groupBy(*by).agg(F.max(seq_col).alias("__top"))
        return rois.join(last, [*by]).where(F.col(seq_col) < F.col("__top")).select(rois.columns)
    top = rois.agg(F.max(seq_col).alias("__top"))
    return rois.join(F.broadcast(top)).where(F.col(seq_col) < F.col("__top")).drop("__top")


def linked_notes(rois: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, notes): texts of the notes linked to each region, in order of pos, joined by " | "; none: empty."""
    texts = notes.where("linked_roi is not null").groupBy(F.col("linked_roi").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " | ").alias("notes"))
    return rois.select("name").join(texts, "name", "left").select("name", F.coalesce("notes", F.lit("")).alias("notes"))


def notes_of(rois: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, pos, id, source): notes linked to a region, then unlinked ones that lie in its box (edges with), each once."""
    r, n = rois.select("name", "x1", "y1", "x2", "y2"), notes
    linked = n.join(r, n["linked_roi"] == r["name"]).select("name", "pos", "id", F.lit(1).alias("source"))
    spread = r.withColumn("__sy", F.explode(_squares(F.col("y1"), F.col("y2")))).withColumn("__sx", F.explode(_squares(F.col("x1"), F.col("x2"))))
    free = n.where("linked_roi is null").withColumns({"__sy": F.floor(F.col("y") / SQUARE).cast("int"), "__sx": F.floor(F.col("x") / SQUARE).cast("int")})
    inside = free.join(spread, ["__sy", "__sx"]).where((F.col("x") >= F.col("x1")) & (F.col("x") <= F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y2"))).select("name", "pos", "id", F.lit(2).alias("source"))
    first = Window.partitionBy("name", "id").orderBy("source")
    return linked.unionByName(inside).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def notes_text(rois: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, text): the notes file of each region that has notes: author, time, text and replies of each."""
    from ..functions.text import pretty_time

    replies = F.array_join(F.transform(F.coalesce("replies", F.array()), lambda r: F.concat(F.lit("  ↳ ["), r["author"], F.lit("] "), pretty_time(r["created"], "MM/dd HH:mm"), F.lit(": "), r["text"], F.lit("\n"))), "")
    entry = F.concat(F.lit("["), F.col("author"), F.lit("] "), pretty_time(F.col("created")), F.lit("\n"), F.col("text"), F.lit("\n"), replies, F.lit("\n"))
    rows = notes_of(rois, notes).join(notes.select("id", entry.alias("entry")), "id")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "pos", "entry"))), lambda s: s["entry"]), "")
    return rows.groupBy("name").agg(F.concat(F.lit("Notes for "), F.first("name"), F.lit("\n" + "=" * 40 + "\n\n"), body).alias("text"))
