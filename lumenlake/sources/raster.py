"""Raster data source: ``spark.read.format("raster")`` gives tiles of TIFF images, one input partition for a run of tiles.

Options: path (files, comma-separated, or a folder), tile (side in pixels), axes ("auto", "pages", "samples"), level ("full"
or "preview"). Filters on image_id, ch_idx, ty and tx prune partitions where spark.sql.python.filterPushdown.enabled is
true. For many files, or for levels that files hold themselves, planned() reads the headers as a Spark job and tiles_of()
reads the tiles of the plan's rows. Files are read through pyarrow's file systems, so they may lie in a store that all executors reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import tiff
from .scratch import written

# Endings of image files.
EXTENSIONS = ("tif", "tiff", "ome.tif", "ome.tiff", "png", "jpg", "jpeg", "bmp", "gif", "webp", "svs", "ndpi", "czi")
MANY_CHANNELS = 100
TILES = "image_id string, ch_idx int, ty int, tx int, y0 int, x0 int, h int, w int, dtype string, data binary"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def listed(path: str) -> list[str]:
    """TIFF files of a comma-separated list of files and folders."""
    found = []
    for p in path.split(","):
        if p.lower().endswith(".czi"):
            raise ValueError(f"{p}: czi files are no TIFF and are not read; convert them to TIFF")
        fs, at = open_path(p)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            prefix = p[: len(p) - len(at)] if p.endswith(at) else ""
            found += sorted(prefix + f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.path.lower().endswith((".tif", ".tiff", ".svs", ".ndpi")))
        else:
            found.append(p)
    return found


def channel_axis(shape: Sequence[int]) -> tuple[str, int]:
    """("none" | "first" | "last" | "plane", channels) of an array: two axes are one channel; of three, the first is the
    channels' if it has at most 100, else the last if it has, else the first plane counts; of more, the first plane."""
    if len(shape) == 2:
        return "none", 1
    if len(shape) == 3 and shape[0] <= MANY_CHANNELS:
        return "first", shape[0]
    if len(shape) == 3 and shape[2] <= MANY_CHANNELS:
        return "last", shape[2]
    return "plane", 1


def channels_of(found: Sequence[tiff.Page]) -> list[tuple[int, int]]:
    """(page, sample) of each channel: the first page's samples, or the pages of its size, if they are at most 100."""
    first = found[0]
    if first.samples > 1:
        return [(0, s) for s in range(first.samples)]
    same = [i for i, p in enumerate(found) if (p.height, p.width) == (first.height, first.width)]
    return [(i, 0) for i in same] if len(same) <= MANY_CHANNELS else [(0, 0)]


@dataclass
class TilePartition(InputPartition):
    path: str
    channel: int
    page: int
    sample: int
    ty: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self._path, self._tile = options["path"], int(options.get("tile", 512))
        self._level = options.get("level", "full")
        self._max_dim = int(options.get("maxdim", 2500))
        self._bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute[0] in ("image_id", "ch_idx", "ty"):
                self._bounds.append((f.attribute[0], kinds[type(f)], f.value))
            yield f  # Spark tests the rows again

    def _wanted(self, **values) -> bool:
        test = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(test[op](values[c], v) for c, op, v in self._bounds if c in values)

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path in listed(self._path):
            if not self._wanted(image_id=path):
                continue
            fs, at = open_path(path)
            with fs.open_input_file(at) as source:
                all_pages = list(tiff.pages(source))
            first = all_pages[0]
            places = channels_of(all_pages)
            ds = max(1, max(first.height, first.width) // self._max_dim) if self._level == "preview" else 1
            rows = -(-first.height // ds)
            found += [TilePartition(path, c, page, sample, ty) for c, (page, sample) in enumerate(places) if self._wanted(ch_idx=c) for ty in range(-(-rows // self._tile)) if self._wanted(ty=ty)]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p = partition
        fs, at = open_path(p.path)
        with fs.open_input_file(at) as source:
            page = list(tiff.pages(source))[p.page]
            ds = max(1, max(page.height, page.width) // self._max_dim) if self._level == "preview" else 1
            y0 = p.ty * self._tile
            rows = tiff.read_rows(source, page, y0 * ds, min(page.height, (y0 + self._tile) * ds))[::ds, ::ds, p.sample]
        for tx in range(-(-rows.shape[1] // self._tile)):
            part = np.ascontiguousarray(rows[:, tx * self._tile : (tx + 1) * self._tile])
            part = part.astype(part.dtype.newbyteorder("<"))
            values = (p.path, p.channel, p.ty, tx, y0, tx * self._tile, *part.shape, part.dtype.str, part.tobytes())
            kinds = [pa.string(), *[pa.int32()] * 7, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[x.split()[0] for x in TILES.split(", ")])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


PLAN = "image_id string, ch_idx int, level int, height int, width int, dtype string, place long, sample int"
#: Bytes of samples that one task of tiles_of reads, on average.
TASK_BYTES = 64 << 20


def planned(spark: SparkSession, *paths: str) -> DataFrame:
    """A written table of what TIFF files hold (columns of PLAN), for files of any number: tasks read the headers.

    A row for each image, channel and level; level 0 is the page itself, the others its smaller copies (sub-directories),
    larger ones first. place is where the level's directory lies, so that who reads its rows reads one directory. Spark
    lists paths (files, folders or patterns); files with other endings are passed over, and one that is no TIFF, or is a
    czi file, is an error that names it. A folder without such files gives an empty table.
    """

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                fs, at = open_path(path)
                with fs.open_input_file(at) as source:
                    try:
                        found = list(tiff.pages(source))
                        for c, (page, sample) in enumerate(channels_of(found) if found else ()):
                            copies = sorted((tiff.page_at(source, x) for x in found[page].smaller), key=lambda p: -p.height * p.width)
                            rows += [(path, c, k, p.height, p.width, p.dtype.str, p.place, sample) for k, p in enumerate([found[page], *copies])]
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
            kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.int64(), pa.int32()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PLAN.split(", ")])

    listed_ = spark.read.format("binaryFile").load(list(paths)).select("path").where(F.lower("path").rlike(r"\.(tiff?|svs|ndpi|czi)$"))
    return written(listed_.mapInArrow(headers, PLAN), "plan")


def levels_for(plan: DataFrame, side: int) -> DataFrame:
    """Rows of plan of one level for each image and channel: the smallest whose longer side has side pixels, or else the largest."""
    longer = F.greatest("height", "width").cast("long")
    fit = F.struct(longer >= side, F.when(longer >= side, -longer).otherwise(longer), -F.col("level"))
    best = plan.groupBy("image_id", "ch_idx").agg(F.max_by("level", fit).alias("level"))
    return plan.join(best, ["image_id", "ch_idx", "level"], "left_semi")


def tiles_of(plan: DataFrame, tile: int = 512) -> DataFrame:
    """Tiles (columns of TILES, and level) of the rows of a plan; a task reads the bands of tiles that it is dealt.

    Filters on images, channels, levels or sizes are filters on the plan: what they leave out is never opened.
    """
    rows = plan.where("height > 0 and width > 0")
    bands = F.ceil(F.col("height") / tile).cast("int")
    size = F.regexp_extract("dtype", "[0-9]+$", 0).cast("long")
    held, n = rows.agg(F.sum(F.col("height").cast("long") * F.col("width") * size), F.sum(bands)).first()
    tasks = max(1, min(n or 1, max(-(-(held or 0) // TASK_BYTES), plan.sparkSession.sparkContext.defaultParallelism)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * 7, pa.string(), pa.binary(), pa.int32()]
        names = [x.split()[0] for x in TILES.split(", ")] + ["level"]
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = open_path(r["image_id"])
                with fs.open_input_file(at) as source:
                    page = tiff.page_at(source, r["place"])
                    y0 = r["ty"] * tile
                    band = tiff.read_rows(source, page, y0, min(page.height, y0 + tile))[:, :, r["sample"]]
                for x0 in range(0, page.width, tile):
                    part = np.ascontiguousarray(band[:, x0 : x0 + tile])
                    part = part.astype(part.dtype.newbyteorder("<"))
                    values = (r["image_id"], r["ch_idx"], r["ty"], x0 // tile, y0, x0, *part.shape, part.dtype.str, part.tobytes(), r["level"])
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    dealt = rows.withColumn("ty", F.explode(F.sequence(F.lit(0), bands - 1))).repartition(tasks, "image_id", "ch_idx", "level", "ty")
    return dealt.mapInArrow(read, f"{TILES}, level int")


PIXELS = "image_id string, ch_idx int, ty int, tx int, y int, x int, v double"


def pixels(tiles: DataFrame) -> DataFrame:
    """The relational view of tiles: a row for each sample."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["data"], r["dtype"]).astype(np.float64)
                n = len(v)
                y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(r["w"]))
                whole = lambda c: pa.array(np.full(n, r[c], np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * n), whole("ch_idx"), whole("ty"), whole("tx"), pa.array(y + np.int32(r["y0"])), pa.array(x + np.int32(r["x0"])), pa.array(v)], names=[c.split()[0] for c in PIXELS.split(", ")])

    return tiles.mapInArrow(explode, PIXELS)


def labels(tiles: DataFrame) -> DataFrame:
    """A label mask's pixels: (image_id, y, x, cell_id)."""
    return pixels(tiles.where("ch_idx = 0")).select("image_id", "y", "x", F.col("v").cast("int").alias("cell_id"))


def merged_channels(spark: SparkSession, paths: Sequence[str], tile: int = 512) -> DataFrame:
    """The first plane of each file as one image's channels, in order; all must have the same size."""
    sizes = set()
    for p in paths:
        fs, at = open_path(p)
        with fs.open_input_file(at) as source:
            page = next(tiff.pages(source))
            sizes.add((page.height, page.width))
    if len(sizes) > 1:
        raise ValueError(f"files of different sizes cannot be channels of one image: {sorted(sizes)}")
    out: DataFrame | None = None
    for k, p in enumerate(paths):
        one = spark.read.format("raster").option("tile", tile).load(p).where("ch_idx = 0").withColumns({"ch_idx": F.lit(k), "image_id": F.lit(",".join(paths))})
        out = one if out is None else out.unionByName(one)
    return out


def write_tiff(rgb: DataFrame, path: str, h: int, w: int, group: str | None = None, rows_per_strip: int = 64) -> DataFrame:
    """One TIFF of a raster (y, x, r, g, b) or (y, x, v) or, with group, one for each of its values under path; returns (path, pixels).

    Each strip of rows is put together by a task of its own. A file's strips are then written in order as they come by one
    task, which holds a few strips at a time; absent pixels are 0. Files over 4 GB are BigTIFF.
    """
    cols = ["r", "g", "b"] if {"r", "g", "b"} <= set(rgb.columns) else ["v"]
    dtype = np.dtype(np.uint8 if len(cols) == 3 else "<f4")
    strips = -(-h // rows_per_strip)

    def strip(table: pa.Table) -> pa.Table:
        s = table.column("__s")[0].as_py()
        image = np.zeros((min(rows_per_strip, h - s * rows_per_strip), w, len(cols)), dtype)
        y, x = table.column("y").to_numpy() - s * rows_per_strip, table.column("x").to_numpy()
        for k, c in enumerate(cols):
            image[y, x, k] = table.column(c).to_numpy()
        return pa.table({"g": table.column("__g").slice(0, 1), "s": pa.array([s], pa.int32()), "data": pa.array([image.tobytes()], pa.binary()), "pixels": pa.array([table.num_rows], pa.int64())})

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = tiff.header(h, w, len(cols), dtype, rows_per_strip)
        empty = lambda a, b: [bytes((min(rows_per_strip, h - s * rows_per_strip)) * w * len(cols) * dtype.itemsize) for s in range(a, b)]
        name, sink, at, n = None, None, 0, 0

        def finish() -> pa.RecordBatch:
            for data in empty(at, strips):
                sink.write(data)
            sink.write(after)
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([target(name)]), pa.array([n], pa.int64())], names=["path", "pixels"])

        for batch in batches:
            for g, s, data, pixels_ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sink is None or g != name:
                    if sink is not None:
                        yield finish()
                    fs, place = open_path(target(g))
                    name, sink, at, n = g, fs.open_output_stream(place), 0, 0
                    sink.write(before)
                for gap in empty(at, s):
                    sink.write(gap)
                sink.write(data)
                at, n = s + 1, n + pixels_
        if sink is not None:
            yield finish()

    target = lambda g: f"{path}/{g}.tif" if group else path
    inside = rgb.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))
    key = F.coalesce(F.col(group).cast("string"), F.lit("null")) if group else F.lit("")
    dealt = inside.select(key.alias("__g"), F.floor(F.col("y") / rows_per_strip).cast("int").alias("__s"), "y", "x", *cols)
    made = dealt.groupBy("__g", "__s").applyInArrow(strip, "g string, s int, data binary, pixels long")
    return made.repartition("g").sortWithinPartitions("g", "s").mapInArrow(put, "path string, pixels long")


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (columns of PIXELS) of 8-bit PNG, JPEG, BMP or GIF files by Spark's image source: at most three channels, red first, alpha dropped.

    Not for 16-bit TIFF, of which that source keeps the low bytes.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w, n = r["height"], r["width"], r["nChannels"]
                data = np.frombuffer(r["data"], np.uint8).reshape(h, w, n)
                y, x = (a.reshape(-1).astype(np.int32) for a in np.mgrid[:h, :w])
                for c, stored in enumerate([2, 1, 0] if n >= 3 else [0]):
                    whole = lambda v, k=h * w: pa.array(np.full(k, v, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([r["origin"]] * (h * w)), whole(c), pa.array(y // 512), pa.array(x // 512), pa.array(y), pa.array(x), pa.array(data[:, :, stored].reshape(-1).astype(np.float64))], names=[k.split()[0] for k in PIXELS.split(", ")])

    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(explode, PIXELS)
