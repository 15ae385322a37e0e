"""Best-fit packing with swap-based local search.

Documents become pieces of at most the sequence's length; only longer ones are cut, and only the first piece may be
shorter. Pieces are dealt by a hash of their row into groups of a bounded size. Each group is packed by best fit
decreasing and improved by local search: from the least filled bin, single documents move, one is exchanged for one, or
two for one, with other underfull bins, each step increasing the sum of squared fills, until the bin is empty or no step
is left. What lies in bins that stay underfull is dealt into new groups and packed once more, until one group holds it or
a round leaves over half of it underfull. Only lengths are packed:
texts are encoded where they are read and never shuffled.

Cases: a null or empty text is one piece with the end id alone; null ids and repeated rows are pieces of their own; an
empty table gives an empty table; other columns are not read; a text of any length is cut into as many pieces as needed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts_of
from .tokens import MAX_PIECES, encoder

CAPACITY = 2048
#: Pieces of one packing group, on average.
GROUP_PIECES = 32_768
#: Bins filled less than this share are packed again, across groups.
LOOSE_FILL = 0.97

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full length but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def pieces_of(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = MAX_PIECES) -> DataFrame:
    """The pieces of every document; row tells documents apart that have the same id and text."""

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, max_pieces), np.asarray([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in slices(batches):
            rows = []
            for row, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), enc.encode_all(batch.column(2).to_pylist())):
                ids += end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((row, doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(encode_batches, PIECES)


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """No packing has fewer bins: by volume, and by pieces of which no two share a bin with the room they leave."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    volume = counts * np.arange(capacity + 1)
    below, total = np.cumsum(volume), int(volume.sum())
    best = -(-total // capacity)
    many = np.cumsum(counts)
    half = capacity // 2
    for k in range(half + 1):  # pieces under k are left out, those over capacity - k fill a bin alone
        alone = int(many[capacity] - many[capacity - k])
        large = int(many[capacity - k] - many[half])
        middle = int(below[half] - (below[k - 1] if k else 0))
        room = large * capacity - int(below[capacity - k] - below[half])
        best = max(best, alone + large + max(0, -(-(middle - room) // capacity)))
    return best


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of indices by best fit decreasing; bins of equal room wait in lists under a bit set of rooms."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class _Index:
    """Bins by a value that they hold (a length, or the sum of two) and the room beside it.

    What takes a value's place has the room and the value, together span, to lie in.
    """

    def __init__(self, capacity: int):
        self._bins: dict[tuple[int, int], dict[int, None]] = {}  # (span, room) -> bins in order
        self._rooms = [0] * (capacity + 1)  # span -> bit set of rooms
        self._most = np.zeros(capacity + 1, np.int64)  # span -> the largest room
        self._excess = np.arange(capacity + 1)

    def add(self, b: int, room: int, values: Iterable[int]) -> None:
        for v in values:
            self._bins.setdefault((v + room, room), {})[b] = None
            self._rooms[v + room] |= 1 << room
            self._most[v + room] = max(self._most[v + room], room)

    def drop(self, b: int, room: int, values: Iterable[int]) -> None:
        for v in values:
            same = self._bins[v + room, room]
            del same[b]
            if not same:
                del self._bins[v + room, room]
                self._rooms[v + room] &= ~(1 << room)
                self._most[v + room] = max(self._rooms[v + room].bit_length() - 1, 0)

    def best(self, x: int, below: int) -> tuple[int, int] | None:
        """(bin, value) of the exchange of x for a lesser value that leaves the bin least room, under below."""
        most = self._most[x : x + below]
        ok = most > self._excess[: len(most)]
        left = int(ok.argmax()) if len(ok) else 0
        if not len(ok) or not ok[left]:
            return None
        room = int(most[left])
        return next(reversed(self._bins[x + left, room])), x + left - room


class _Search:
    """Local search over the underfull bins of one group; a step touches the indexes of the one bin that it changes.

    The bin that gives is out of the indexes meanwhile.
    """

    def __init__(self, lengths: Sequence[int], bins: list[list[int]], capacity: int):
        self.n, self.bins, self.capacity = [int(x) for x in lengths], bins, capacity
        self.room = [capacity - sum(self.n[i] for i in items) for items in bins]
        self._by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self._rooms = 0  # bit set of the rooms that bins have
        self._one, self._two = _Index(capacity), _Index(capacity)
        for b in range(len(bins)):
            self.enter(b)

    def _lengths(self, b: int) -> list[int]:
        return sorted({self.n[i] for i in self.bins[b]}, reverse=True)

    def _sums(self, b: int) -> list[int]:
        """The sums of two pieces of a bin, each once, the largest first."""
        times = Counter(self.n[i] for i in self.bins[b])
        return sorted({x + y for x, y in combinations(times, 2)} | {2 * x for x, k in times.items() if k > 1}, reverse=True)

    def _pieces(self, b: int, value: int, two: bool) -> list[int]:
        """One piece of a bin of that length, or two of that sum."""
        if not two:
            return [next(i for i in self.bins[b] if self.n[i] == value)]
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            if (other := seen.get(value - self.n[i])) is not None:
                return [other, i]
            seen[self.n[i]] = i
        raise KeyError(value)

    def enter(self, b: int) -> None:
        if self.bins[b] and self.room[b] > 0:
            self._by_room[self.room[b]][b] = None
            self._rooms |= 1 << self.room[b]
            self._one.add(b, self.room[b], self._lengths(b))
            self._two.add(b, self.room[b], self._sums(b))

    def leave(self, b: int) -> None:
        if self.bins[b] and self.room[b] > 0:
            del self._by_room[self.room[b]][b]
            if not self._by_room[self.room[b]]:
                self._rooms &= ~(1 << self.room[b])
            self._one.drop(b, self.room[b], self._lengths(b))
            self._two.drop(b, self.room[b], self._sums(b))

    def _swap(self, e: int, give: list[int], b: int, take: list[int]) -> None:
        self.leave(b)
        for frm, to, items in ((e, b, give), (b, e, take)):
            for i in items:
                self.bins[frm].remove(i)
                self.bins[to].append(i)
                self.room[frm] += self.n[i]
                self.room[to] -= self.n[i]
        self.enter(b)

    def step(self, e: int) -> bool:
        """One step that takes from bin e; True if there was one. The other bin gets fuller than e, so squared fills grow."""
        lengths, room = self._lengths(e), self.room[e]
        for x in lengths:  # a move: into the least room that fits
            if fits := self._rooms >> x:
                least = x + (fits & -fits).bit_length() - 1
                if least - x < room:
                    self._swap(e, self._pieces(e, x, False), next(reversed(self._by_room[least])), [])
                    return True
        for two, values in ((False, lengths), (True, self._sums(e))):  # one for one, two for one
            for x in values:
                if found := self._one.best(x, room):
                    b, v = found
                    self._swap(e, self._pieces(e, x, two), b, self._pieces(b, v, False))
                    return True
        for x in lengths:  # one for two
            if found := self._two.best(x, room):
                b, v = found
                self._swap(e, self._pieces(e, x, False), b, self._pieces(b, v, True))
                return True
        return False


def local_search(lengths: Sequence[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty as many bins as exchanges can; ends where the bound shows that no packing has fewer, or no step is left.

    Sweeps over the underfull bins, the least filled first.
    """
    least, live = lower_bound(lengths, capacity), len(bins)
    if live > least:
        search = _Search(lengths, bins, capacity)
        moved = True
        while moved and live > least:
            moved = False
            for e in sorted((b for b in range(len(bins)) if bins[b] and search.room[b] > 0), key=lambda b: (-search.room[b], b)):
                if not bins[e] or not search.room[e]:
                    continue
                search.leave(e)
                while bins[e] and search.step(e):
                    moved = True
                search.enter(e)
                if not bins[e]:
                    live -= 1
                    if live == least:
                        break
    return [b for b in bins if b]


def packing_report(lengths: Sequence[int], capacity: int) -> tuple[int, int, int]:
    """(bins of best fit decreasing, bins after local search, lower bound)."""
    bins = best_fit(lengths, capacity)
    return len(bins), len(local_search(lengths, [list(b) for b in bins], capacity)), lower_bound(lengths, capacity)


def pack(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


_PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _pack_groups(pieces: DataFrame, capacity: int, first: int, mean_pieces: int, n: int) -> tuple[DataFrame, int]:
    """Pack n pieces group by group; sequence ids begin at the group's number, counted from first, in the high bits."""
    groups = max(1, -(-n // mean_pieces))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        seq, off, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        base = (first + (table.column("g")[0].as_py() if len(lengths) else 0)) << 24
        for b, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in items:
                seq[i], off[i] = base + b, at
                at += lengths[i]
            fill[items] = at
        out = table.drop_columns(["g"])
        for name, values in (("sequence_id", seq), ("offset", off), ("fill", fill)):
            out = out.append_column(name, pa.array(values))
        return out

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInArrow(pack_group, _PACKED), groups


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, mean_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    max_pieces: what a worker remembers of the tokenizer's work; fewer take less memory and more time.
    """
    pieces, _ = materialise(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col, max_pieces), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    loose = F.col("fill") < int(LOOSE_FILL * capacity)
    done, first, n = [], 0, pieces.count()
    while True:
        packed, groups = _pack_groups(pieces, capacity, first, mean_pieces, n)
        if groups == 1:
            done.append(packed.select(names))
            break
        packed, _ = materialise(packed, "packed")
        before, n = n, packed.where(loose).count()
        if first and 2 * n > before:  # what fills no bins in new company either
            done.append(packed.select(names))
            break
        done.append(packed.where(~loose).select(names))
        pieces, first = packed.where(loose).select(pieces.columns), first + groups
    return reduce(DataFrame.unionByName, done)
