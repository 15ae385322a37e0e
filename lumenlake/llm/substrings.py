"""Removal of repeated substrings: every byte that lies in a string of LENGTH bytes which starts anywhere else as well.

The suffixes to sort are thinned first. In each window of LENGTH bytes the k-gram of least hash is its anchor; equal
windows have equal anchors, so windows need only be compared where their anchors' hashes meet. Neighbouring windows of
one anchor make a segment of the text. Anchors that occur once drop out. Equal segments (by 128 bits of two hashes) are
pre-aggregated by count, within a task before the shuffle and over all tasks after it: whatever is repeated whole is
known then, be it copied a million times. Segments that share an anchor but differ are contested. Of those one suffix
each to the right of the anchor, and one to the left reversed, are put in suffix order by deep-shallow sorting;
neighbours' common prefixes give, for each offset of the anchor in a window, classes of equal left and right parts, and
a window is repeated if another one has both classes. There bytes decide, not hashes.

Segments carry two 64-bit hashes and a place, not text. A contested segment's bytes are cut out of its text once. An
anchor with more than MAX_CONTESTED different segments is split over tasks by the bytes that suffixes must share: its
segments are cut into bands of BAND offsets, whose windows have all but BAND - 1 bytes in common, equal pieces become one
row again, and pieces that agree in those bytes are sorted together. Should so many pieces agree in them too, their
windows go on alone: what is equal in all LENGTH bytes is then found by counting. So no group has to fit in a task.

Cases: a null text is empty; texts under LENGTH bytes keep all; repeated rows, also with equal ids, are repeats of one
another; rows with null ids are kept apart by the hash of their text; an empty table gives an empty table; other columns
are not read; long texts are worked on in parts that overlap, and repeats within one text count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitset import filter_of, may_hold
from .common import discard, materialise, release, texts_of
from .shingles import bytes_of, mix
from .suffixsort import deep_shallow_sort, neighbour_lcp

LENGTH = 200
K = 40
_W = LENGTH - K + 1
#: Long texts are cut into parts of so many windows.
PART = 1 << 20
#: Segments are pre-aggregated within a task in lots of so many.
LOT = 1 << 19
#: Segments sorted by one task, on average, and the most different ones of one anchor that are sorted together.
SORTED, MAX_CONTESTED = 40_000, 10_000
#: Offsets of an anchor in a window that are sorted together where an anchor has more.
BAND = 8

_U = np.uint64
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWER = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(17, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _tables["up"] = np.multiply.accumulate(np.full(size, _POWER, np.uint64))
            _tables["down"] = np.multiply.accumulate(np.full(size, pow(_POWER, -1, 1 << 64), np.uint64))
    return _tables["up"], _tables["down"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each k-gram of data, by differences of a polynomial's prefix sums."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        g = total[K:] - total[:-K]
        g *= down[: len(g)]
    return mix(g)


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor's place, anchor's hash) of each segment of a text of LENGTH bytes or more."""
    g = gram_hashes(data)
    windows = len(data) - LENGTH + 1
    blocks = -(-len(g) // _W)
    padded = np.full(blocks * _W, ~_U(0))
    padded[: len(g)] = g
    square = padded.reshape(blocks, _W)
    head = np.minimum.accumulate(square, axis=1).reshape(-1)
    tail = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(tail[:windows], head[_W - 1 : _W - 1 + windows])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], windows) - 1
    anchor = np.empty(len(first), np.int64)
    for a in range(0, len(first), 4096):
        at = first[a : a + 4096]
        anchor[a : a + 4096] = at + (g[at[:, None] + np.arange(_W)] == least[at][:, None]).argmax(1)
    if (passed := np.flatnonzero(last > anchor)).size:  # the same k-gram again within a window: its next place is the anchor from there on
        more_first, more_last, more_anchor = [], [], []
        for i in passed.tolist():
            lo, hi, at = int(first[i]), int(last[i]), int(anchor[i])
            last[i] = at
            places = np.flatnonzero(g[at + 1 : hi + _W] == g[at]) + at + 1
            for p in places.tolist():
                if at + 1 > hi:
                    break
                more_first.append(at + 1)
                more_last.append(min(hi, p))
                more_anchor.append(p)
                at = p
        first, last, anchor = (np.concatenate([x, np.asarray(y, np.int64)]) for x, y in ((first, more_first), (last, more_last), (anchor, more_anchor)))
    return first, last, anchor, g[anchor]


#: place holds, for a segment: first window, number of windows less one (8 bits), anchor less first (8 bits), and in two
#: bits 1, or 2 if it is repeated within its lot; for a span known to be repeated: start, length (31 bits) and 0.
SEGMENT = "mh long, sh long, doc_id long, th long, place long"
_SEGMENT_NAMES = [x.split()[0] for x in SEGMENT.split(", ")]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal runs in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


class _Lot:
    """Segments of many texts; on release equal ones become one row and the others' spans are merged by text."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.size = 0

    def add(self, doc: tuple[int | None, int], mh: np.ndarray, sh: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> None:
        self.parts.append((mh, sh, np.full(len(mh), len(self.docs)), first, last, anchor))
        self.docs.append(doc)
        self.size += len(mh)

    def release(self) -> pa.RecordBatch:
        mh, sh, doc, first, last, anchor = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts) if self.parts else [()] * 6))
        ids, hashes = [d[0] for d in self.docs], np.asarray([d[1] for d in self.docs], np.int64)
        order = np.lexsort((sh, mh))
        new = np.ones(len(order), bool)
        new[1:] = (mh[order][1:] != mh[order][:-1]) | (sh[order][1:] != sh[order][:-1])
        heads = order[new]
        times = np.minimum(np.diff(np.append(np.flatnonzero(new), len(order))), 2)
        place = (first[heads] << 18) | ((last - first)[heads] << 10) | ((anchor - first)[heads] << 2) | times
        rows = [(mh[heads].view(np.int64), sh[heads].view(np.int64), doc[heads], place)]
        twice = np.repeat(times > 1, np.diff(np.append(np.flatnonzero(new), len(order))))
        twice &= ~new
        if twice.any():
            at = order[twice]
            d, s, e = doc[at], first[at], last[at] + LENGTH
            by = np.argsort(d, kind="stable")
            d, s, e = d[by], s[by], e[by]
            cuts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(d)).tolist()):
                x, y = merged(s[a:b], e[a:b])
                own = np.full(len(x), d[a])
                spread = mix(x.astype(np.uint64) * _U(31) + _U(int(hashes[d[a]]) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                rows.append((spread, ~spread, own, (x << 33) | ((y - x) << 2)))
        mh, sh, doc, place = (np.concatenate(x) for x in zip(*rows))
        if len(self.docs):
            col = pa.array(ids, pa.int64()).take(pa.array(doc))
            return pa.RecordBatch.from_arrays([pa.array(mh), pa.array(sh), col, pa.array(hashes[doc]), pa.array(place)], names=_SEGMENT_NAMES)
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=_SEGMENT_NAMES)


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    lot = _Lot()
    for batch in batches:
        data, offsets = bytes_of(batch.column(2))
        for i, (doc_id, th) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text = data[offsets[i] : offsets[i + 1]]
            for base in range(0, max(0, len(text) - LENGTH + 1), PART):
                part = text[base : base + PART + LENGTH - 1]
                first, last, anchor, mh = segments(part)
                raw = part.tobytes()
                sh = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                lot.add((doc_id, th), mh, sh, first + base, last + base, anchor + base)
            if lot.size >= LOT:
                yield lot.release()
                lot = _Lot()
    yield lot.release()


def resolve(group: np.ndarray, strings: list[bytes], anchors: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows of segments are equal to a window of another segment of the same group (anchor's hash).

    anchors: place of the anchor in each string, that is, its offset in the first window; windows: their number. Returns
    a matrix, of rows of segments, by the anchor's offset in the window.
    """
    n = len(strings)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, _W), np.uint8)
    for i, (s, a) in enumerate(zip(strings, anchors.tolist())):
        r = np.frombuffer(s, np.uint8)
        right[i, : len(s) - a] = r[a : a + LENGTH]
        left[i, :a] = r[:a][::-1]
    sides = []
    for strings_of in (right, left):
        order = deep_shallow_sort(group, strings_of)
        sides.append((order, neighbour_lcp(group, strings_of, order)))
    found = np.zeros((n, _W), bool)
    low = anchors - windows + 1
    for offset in range(_W):
        has = np.flatnonzero((low <= offset) & (offset <= anchors))
        if len(has) < 2:
            continue
        classes = []
        for (order, lcp), depth in zip(sides, (LENGTH - offset, offset)):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(lcp < depth)
            classes.append(c[has])
        key = classes[0] * (n + 1) + classes[1]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        found[has[by[1:][same]], offset] = True
        found[has[by[:-1][same]], offset] = True
    return found


SPAN = "doc_id long, th long, s long, e long"


def _resolve_table(table: pa.Table) -> pa.Table:
    col = lambda c: table.column(c).to_numpy()
    first, windows, anchor, times = col("first"), col("windows"), col("anchor"), col("times")
    found = resolve(col("mh"), table.column("bytes").to_pylist(), anchor, windows)
    found[times > 1] = False  # known already: these were only to be met
    row, offset = np.nonzero(found)
    p = first[row] + anchor[row] - offset
    out_row, s, e = [], [], []
    cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(row)).tolist()):
        x, y = merged(p[a:b], p[a:b] + LENGTH)
        out_row.append(np.full(len(x), row[a]))
        s.append(x)
        e.append(y)
    at = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
    take = lambda c: table.column(c).combine_chunks().take(pa.array(at))
    return pa.table([take("doc_id"), take("th"), pa.array(np.concatenate(s) if s else at), pa.array(np.concatenate(e) if e else at)], names=["doc_id", "th", "s", "e"])


def bands(first: int, windows: int, anchor: int, raw: bytes) -> Iterator[tuple[int, bytes, int, int, int, bytes]]:
    """A segment cut by bands of the anchor's offset: (band, bytes that its windows share, first, windows, anchor, bytes)."""
    low = anchor - windows + 1
    for band in range(low // BAND, anchor // BAND + 1):
        o1, o2 = band * BAND, min(band * BAND + BAND, _W) - 1
        a, b = anchor - min(anchor, o2), anchor - max(low, o1)
        yield band, raw[anchor - o1 : anchor - o2 + LENGTH], first + a, b - a + 1, anchor - a, raw[a : b + LENGTH]


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contested segments by bands; mh becomes a hash of anchor, band and shared bytes, d tells the pieces' bytes apart."""
    kinds, names = [*[pa.int64()] * 7, pa.binary(), pa.binary()], [x.split()[0] for x in _BANDED.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for mh, doc_id, th, times, first, windows, anchor, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _PIECE_NAMES)):
            for band, shared, f, w, a, part in bands(first, windows, anchor, raw):
                key = xxhash.xxh3_64_intdigest(shared, seed=(mh ^ band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                rows.append((key - (1 << 63), doc_id, th, times, f, w, a, part, xxhash.xxh3_128_digest(part)))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 9, kinds)], names=names)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of every window of segments."""
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, th, first, windows, times, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "th", "first", "windows", "times", "bytes"))):
            rows += [(xxhash.xxh3_128_digest(raw[w : w + LENGTH]), doc_id, th, first + w, times) for w in range(windows)]
            if len(rows) > 50_000:
                yield _digests(rows)
                rows = []
        yield _digests(rows)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.binary(), *[pa.int64()] * 4])], names=["d", "doc_id", "th", "s", "times"])


def _trim_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytes_of(batch.column(1))
        out = []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            s, e = merged(np.asarray([x["s"] for x in spans or ()], np.int64), np.asarray([x["e"] for x in spans or ()], np.int64))
            keep = np.ones(len(raw), bool)
            for a, b in zip(s.tolist(), e.tolist()):
                keep[a:b] = False
            kept = raw[keep].tobytes()
            out.append((len(raw), len(raw) - len(kept), len(s), kept, sha256(kept).hexdigest(), [{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())]))
        cols = list(zip(*out)) or [()] * 6
        kinds = [*[pa.int64()] * 3, pa.binary(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=_TRIMMED_NAMES)


TRIMMED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<s:long,e:long>>"
_TRIMMED_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256, spans (removed runs)."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    cut, cut_at = materialise(rows.mapInArrow(_segment_batches, SEGMENT), "segments")
    times = F.col("place").bitwiseAND(F.lit(3))
    # of every anchor one row: those that occur once go, and those with different segments are contested
    anchors = cut.where(times > 0).groupBy("mh").agg(F.sum(times).alias("n"), (F.min("sh") != F.max("sh")).alias("contested")).where("n > 1").drop("n")
    anchors, _ = materialise(anchors, "anchors")
    found, bits = filter_of(anchors.select(F.col("mh").alias("f")), anchors.count())
    met = cut.where(times > 0).withColumn("set", found).where(may_hold(F.col("set"), F.col("mh"), bits)).drop("set").join(anchors, "mh").repartition("mh", "sh")  # not by mh alone, as the join leaves them
    by_segment = Window.partitionBy("mh", "sh")
    seen = met.withColumns({"n": F.sum(times).over(by_segment), "nth": F.row_number().over(by_segment.orderBy("doc_id", "th", "place"))})
    head = F.col("contested") & (F.col("nth") == 1)
    wanted = seen.where((F.col("n") > 1) | head).select("mh", "doc_id", "th", F.least("n", F.lit(2)).alias("times"), head.alias("contested"), F.lit(True).alias("segment"), "place")
    within = cut.where(times == 0).select("mh", "doc_id", "th", F.lit(2).cast("long").alias("times"), F.lit(False).alias("contested"), F.lit(False).alias("segment"), "place")
    places, _ = materialise(wanted.unionByName(within), "places")
    discard(docs.sparkSession, cut_at)  # only places are read from here on

    first = F.when(F.col("segment"), F.shiftright("place", 18)).otherwise(F.shiftright("place", 33))
    windows = F.shiftright("place", 10).bitwiseAND(F.lit(255)) + 1
    length = F.when(F.col("segment"), windows + (LENGTH - 1)).otherwise(F.shiftright("place", 2).bitwiseAND(F.lit((1 << 31) - 1)))
    known = places.where("times > 1 or not segment").select("doc_id", "th", first.alias("s"), (first + length).alias("e"))
    contested = places.where("contested").select("mh", "doc_id", "th", "times", F.shiftright("place", 18).alias("first"), windows.alias("windows"), F.shiftright("place", 2).bitwiseAND(F.lit(255)).alias("anchor"))
    pieces = contested.groupBy("doc_id", "th").agg(F.collect_list(F.struct("mh", "times", "first", "windows", "anchor")).alias("segments")).withColumnsRenamed({"doc_id": "c_id", "th": "c_th"})
    found = rows.join(pieces, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))).select("doc_id", "th", F.encode("text", "UTF-8").alias("raw"), "segments").mapInArrow(_cut_batches, _PIECE)
    found, _ = materialise(found, "contested")
    more = _repeated(found)
    # repeated rows have equal spans, which are one: the list is bounded by the text, not by its copies
    spans = known.unionByName(more).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"doc_id": "s_id", "th": "s_th"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_trim_batches, TRIMMED)


def _hot(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(the keys of more than MAX_CONTESTED segments, their segments, all other segments); None if there is no such key."""
    hot, _ = materialise(segments.groupBy("mh").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CONTESTED).select("mh"), "hot")
    return None if hot.isEmpty() else (hot, segments.join(hot, "mh", "left_semi"), segments.join(hot, "mh", "left_anti"))


def _repeated(found: DataFrame) -> DataFrame:
    """Spans of windows of contested segments that are equal to a window of another segment."""
    more = []
    if split := _hot(found):
        _, many, found = split
        banded, _ = materialise(many.mapInArrow(_band_batches, _BANDED), "bands")
        one = banded.groupBy("mh", "d").agg(F.sum("times").alias("n"), F.any_value(F.struct("doc_id", "th", "first", "windows", "anchor", "bytes")).alias("x"))
        one, _ = materialise(one, "pieces")
        twice, _ = materialise(one.where("n > 1").select("mh", "d"), "twice")
        more.append(banded.where("times = 1").join(twice, ["mh", "d"]).select("doc_id", "th", F.col("first").alias("s"), (F.col("first") + F.col("windows") + (LENGTH - 1)).alias("e")))
        pieces = one.select("mh", "x.doc_id", "x.th", F.least("n", F.lit(2)).alias("times"), "x.first", "x.windows", "x.anchor", "x.bytes")
        if split := _hot(pieces):
            _, many, pieces = split
            digests, _ = materialise(many.mapInArrow(_digest_batches, "d binary, doc_id long, th long, s long, times long"), "digests")
            twice, _ = materialise(digests.groupBy("d").agg(F.sum("times").alias("n")).where("n > 1").select("d"), "twice")
            more.append(digests.where("times = 1").join(twice, "d").select("doc_id", "th", "s", (F.col("s") + LENGTH).alias("e")))
        found = found.unionByName(pieces)
    groups = max(1, -(-found.count() // SORTED))
    spans = found.withColumn("g", F.pmod(F.xxhash64("mh"), F.lit(groups))).groupBy("g").applyInArrow(_resolve_table, SPAN)
    for x in more:
        spans = spans.unionByName(x)
    return spans


_PIECE = "mh long, doc_id long, th long, times long, first long, windows long, anchor long, bytes binary"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_BANDED = f"{_PIECE}, d binary"


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each contested segment of a text."""
    kinds = [*[pa.int64()] * 7, pa.binary()]
    names = _PIECE_NAMES
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, th, raw, segs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for s in segs:
                rows.append((s["mh"], doc_id, th, s["times"], s["first"], s["windows"], s["anchor"], raw[s["first"] : s["first"] + s["windows"] + LENGTH - 1]))
                size += s["windows"] + LENGTH
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)
