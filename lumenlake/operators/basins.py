"""Objects over a whole image, exact across the seams of tiles: connected components, and watershed basins.

Each tile is labelled alone. What the labels of different tiles have to do with one another is an edge between two labels,
found at the tiles' borders only, and the edges are contracted by ``components``; so an object may wind through any number
of tiles, and what is shuffled for it are its labels and borders, not its pixels.

Rasters are (y, x, ...) with image_id where there are several images. An object's id is a pixel's place in reading order,
y * w + x: of its first pixel, or of a basin's highest one. Ids do not depend on how the image is cut into tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .components import components
from .labels import components_of, distances
from .raster import TILE, gaussian, image_of


def _node(image: list[str], c: str) -> Column:
    """A label as one value: with its image where there are several."""
    return F.struct(*image, F.col(c).alias("id")) if image else F.col(c)


def _merged(labels: DataFrame, edges: DataFrame, image: list[str]) -> DataFrame:
    """(image_id, label, comp): the least label of all that edges(image_id, a, b) hold together; labels without edges are left out."""
    linked = components(edges.select(_node(image, "a").alias("a"), _node(image, "b").alias("b")))
    if image:
        return linked.select(*(F.col(f"node.{c}").alias(c) for c in image), F.col("node.id").alias("label"), F.col("comp.id").alias("comp"))
    return linked.select(F.col("node").alias("label"), "comp")


def mask_components(mask: DataFrame, w: int, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, cell_id): the four-connected components of a mask's pixels (y, x), w being the image's width."""
    image = image_of(mask)
    kinds = dict(mask.dtypes)

    def label(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy().astype(np.int64), table.column("x").to_numpy().astype(np.int64)
        top, left = int(y.min()), int(x.min())
        on = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1), bool)
        on[y - top, x - left] = True
        found = components_of(on)
        yy, xx = np.nonzero(on)
        place, n = (yy + top) * w + xx + left, found[yy, xx]
        first = place[np.unique(n, return_index=True)[1]]  # pixels come in reading order
        out = [pa.array((yy + top).astype(np.int32)), pa.array((xx + left).astype(np.int32)), pa.array(first[n - 1])]
        return pa.table([*(pa.array([table.column(c)[0].as_py()] * len(yy), table.schema.field(c).type) for c in image), *out], names=[*image, "y", "x", "label"])

    rows = mask.select(*image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    rows = rows.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in image), "y int, x int, label long"])
    labels = written(rows.groupBy(*image, "ty", "tx").applyInArrow(label, schema), "labels")
    edges = None
    for axis, other in (("x", "y"), ("y", "x")):
        before = labels.where(F.pmod(axis, F.lit(tile)) == tile - 1).select(*image, (F.col(axis) + 1).cast("int").alias(axis), other, F.col("label").alias("a"))
        after = labels.where(F.pmod(axis, F.lit(tile)) == 0).select(*image, axis, other, F.col("label").alias("b"))
        met = before.join(after, [*image, axis, other]).select(*image, "a", "b").distinct()
        edges = met if edges is None else edges.unionByName(met)
    names = _merged(labels, edges, image)
    return labels.join(names, [*image, "label"], "left").select(*image, "y", "x", F.coalesce("comp", "label").alias("cell_id"))


def ascent_basins(heights: DataFrame, h: int, w: int, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, cell_id): each pixel of a raster (y, x, v) goes to the highest of its eight neighbours that is in the raster and higher than itself, and so on to a top, whose place is its id.

    Of equally high pixels the one that comes first in reading order counts as higher, so there are no plateaus.
    """
    image = image_of(heights)
    kinds = dict(heights.dtypes)

    def climb(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        y0, x0, y1, x1 = ty * tile, tx * tile, min(h, ty * tile + tile), min(w, tx * tile + tile)
        v = np.full((y1 - y0 + 2, x1 - x0 + 2), -np.inf)  # a border of one pixel around the tile
        v[table.column("y").to_numpy() - y0 + 1, table.column("x").to_numpy() - x0 + 1] = table.column("v").to_numpy()
        own = v[1:-1, 1:-1]
        best, step = own.copy(), np.zeros(own.shape, np.int64)
        wide = x1 - x0 + 2
        for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):  # in reading order
            beside = v[1 + dy : 1 + dy + own.shape[0], 1 + dx : 1 + dx + own.shape[1]]
            earlier = (dy, dx) < (0, 0)
            # the first of equals wins: before itself, a pixel yields to equals; after it, to higher ones alone
            better = (beside > best) | (earlier & (step == 0) & (beside == best) & (best > -np.inf))
            best, step = np.where(better, beside, best), np.where(better, dy * wide + dx, step)
        at = np.arange(v.size).reshape(v.shape)
        to = at.copy()
        to[1:-1, 1:-1] = at[1:-1, 1:-1] + step
        flat = to.reshape(-1)  # border pixels are their own ends here: the next tile knows where they go
        while True:
            further = flat[flat]
            if (further == flat).all():
                break
            flat = further
        on = own > -np.inf
        yy, xx = np.nonzero(on)
        end = flat[at[1:-1, 1:-1][on]]
        place = lambda k: (k // wide - 1 + y0) * w + k % wide - 1 + x0
        here = (step[on] == 0) & (end == at[1:-1, 1:-1][on])
        ey, ex = end // wide, end % wide
        outside = (ey == 0) | (ey == v.shape[0] - 1) | (ex == 0) | (ex == wide - 1)
        out = [pa.array((yy + y0).astype(np.int32)), pa.array((xx + x0).astype(np.int32)), pa.array(place(end)), pa.array(outside), pa.array(here)]
        return pa.table([*(pa.array([table.column(c)[0].as_py()] * len(yy), table.schema.field(c).type) for c in image), *out], names=[*image, "y", "x", "label", "outside", "top"])

    number = lambda axis, n: F.sequence(F.greatest(F.floor((F.col(axis) - 1) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(axis) + 1) / tile), F.lit((n - 1) // tile)).cast("int"))
    rows = heights.select(*image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")).where("v is not null and not isnan(v)")
    dealt = rows.withColumn("ty", F.explode(number("y", h))).withColumn("tx", F.explode(number("x", w)))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in image), "y int, x int, label long, outside boolean, top boolean"])
    labels = written(dealt.groupBy(*image, "ty", "tx").applyInArrow(climb, schema), "climbs")
    # a way that leaves its tile goes on from the pixel where it left
    left = labels.where("outside").select(*image, F.col("label").alias("a")).distinct()
    on = labels.select(*image, (F.col("y").cast("long") * w + F.col("x")).alias("a"), F.col("label").alias("b"))
    edges = left.join(on, [*image, "a"]).where("a <> b")
    names = written(_merged(labels, edges, image), "names")
    tops = labels.where("top").select(*image, F.col("label"))
    topped = tops.join(names, [*image, "label"]).select(*image, "comp", F.col("label").alias("cell_id"))
    found = names.join(topped, [*image, "comp"]).select(*image, "label", "cell_id")
    return labels.join(found, [*image, "label"], "left").select(*image, "y", "x", F.coalesce("cell_id", "label").alias("cell_id"))


def watershed(pixels: DataFrame, h: int, w: int, threshold: float, sigma: float = 1.5, most: int = 128, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, cell_id): the objects of a dense raster (y, x, v), touching ones apart.

    What is over the threshold is an object's. Its distance to the background in four-neighbour steps, at most ``most``
    and blurred by sigma (0: as it is), is its height, and each pixel belongs to the top it leads up to: the watershed of the
    distance, seeded by its tops. All of it is local (halos of ``most``, of the blur, of one pixel), so tiles give what one
    tile would. Blurred heights are of one image at a time.
    """
    image = image_of(pixels)
    at = [*image, "y", "x"]
    on = pixels.where(F.col("v") > threshold).select(*at)
    off = pixels.where(~(F.col("v") > threshold) | F.col("v").isNull()).select(*at)
    far = on.join(distances(off, h, w, most, tile), at, "left").select(*at, F.coalesce("d", F.lit(most + 1)).cast("double").alias("v"))
    if sigma:
        if image:
            raise ValueError("heights are blurred for one image at a time: leave image_id out, or set sigma to 0")
        far = written(far, "heights")
        far = gaussian(far, sigma, h, w, tile).join(far.select(*at), at, "left_semi")
    return ascent_basins(far, h, w, tile)
