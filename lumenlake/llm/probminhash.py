"""Near-duplicate classes by ProbMinHash.

A text is a weighted set: its five-word shingles with their numbers of times. Each shingle sends out a Poisson process of
arrivals at a rate of its weight; each arrival strikes one of M registers, which keep the shingle of the earliest. A
shingle stops as soon as its next arrival is later than all registers' (early termination). Two texts agree in a register
with the probability Jaccard of their weighted sets; registers filled with unit weights agree with the plain Jaccard of
the shingle sets. Both kinds are banded, and where no shingle repeats they are the same. Texts that share a band of any
kind are candidates, which are verified on their whole texts: a link is a pair whose probability Jaccard, or plain
Jaccard, reaches the threshold. Classes are the connected components of links and of equal texts.

Candidates are never written out as pairs of a bucket. Equal texts are one node, and of buckets with the same members
one stays. In each turn, every bucket's members are compared with its least one alone (linear in the members), links are
joined to classes, and the least ones leave; buckets whose members then lie in one class are done. After STARS turns the
members of the other buckets are dealt into blocks of BLOCK texts and BLOCK_BYTES bytes at most, on average; each pair of
blocks of a bucket is compared from posting lists, only between texts of different classes. So no task grows with a
bucket, no text is compared with one that shares no bucket with it, and no link between classes is left out; a bucket of
many texts that are not alike is quadratic, in vector operations.

Cases: null and empty texts have no shingles and are copies of one another; a text of fewer than five words is one
shingle; null ids and repeated rows are each returned with their class; the class id is the least doc_id in the class
(null if it has none); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .bitset import filter_of, may_hold
from .common import free_name, materialise, release, slices, texts_of
from .shingles import bytes_of, counted, mix, runs, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.999995 at 0.8.
BANDS, ROWS = 40, 6
#: Turns in which buckets are compared with one member.
STARS = 2
#: Texts, and bytes of text, in one block of a bucket, on average; and bytes of text that one task gets.
BLOCK, BLOCK_BYTES = 512, 8 << 20

_U = np.uint64


def signatures(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Registers of n_texts weighted sets, one row each; an empty set's are 0."""
    time, kept = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    h, t, rate, now = hashes, text, 1.0 / weights, np.zeros(len(hashes))
    turn = 0
    while len(h):
        with np.errstate(over="ignore"):
            r = mix(h + _U((turn * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # the high 53 bits time the arrival, a second draw its register
        now = now - np.log1p(-((r >> _U(11)).astype(np.float64) * 2.0**-53)) * rate
        at = t * m + (mix(r) % _U(m)).astype(np.int64)
        np.minimum.at(time, at, now)
        won = time[at] == now
        kept[at[won]] = h[won]
        alive = now < time.reshape(n_texts, m).max(1)[t]
        h, t, rate, now = h[alive], t[alive], rate[alive], now[alive]
        turn += 1
    return kept.reshape(n_texts, m)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band, different for equal registers in different bands."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(registers), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)
        for j in range(rows):
            out = mix(out ^ registers[:, j::rows][:, :bands])
    return out


def candidate_bands(h: np.ndarray, t: np.ndarray, w: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of weighted sets, text by text, and each text's number of them.

    A text has its weighted bands and those of its unit-weight bands that differ: only texts with repeats have any.
    """
    some = np.bincount(t, minlength=n_texts) > 0
    repeats = np.bincount(t[w > 1], minlength=n_texts) > 0
    both = np.zeros((n_texts, 2 * BANDS), np.uint64)
    both[:, :BANDS] = band_hashes(signatures(h, t, w, n_texts, BANDS * ROWS), BANDS, ROWS)
    used = np.zeros((n_texts, 2 * BANDS), bool)
    used[:, :BANDS] = some[:, None]
    if repeats.any():
        own = repeats[t]
        number = np.cumsum(repeats) - 1
        n = int(repeats.sum())
        both[repeats, BANDS:] = band_hashes(signatures(h[own], number[t[own]], np.ones(int(own.sum())), n, BANDS * ROWS), BANDS, ROWS)
        used[repeats, BANDS:] = both[repeats, BANDS:] != both[repeats, :BANDS]
    return both[used], used.sum(1)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two weighted sets (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    place = np.searchsorted(hb, ha)
    inside = place < len(hb)
    inside[inside] = hb[place[inside]] == ha[inside]
    x, y = wa[inside].astype(np.float64), wb[place[inside]].astype(np.float64)
    plain = len(x) / (len(ha) + len(hb) - len(x))
    if not len(x) or (x == y).all() and (wa == 1).all() and (wb == 1).all():
        return plain, plain
    # 1 / sum over j of max(x_j / x_i, y_j / y_i), by the order of the ratios x / y
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    less = np.searchsorted(ratio, ratio, "left")
    sum_x, sum_y = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(y))
    total = (only_x + sum_x[-1] - sum_x[less]) / x + (only_y + sum_y[less]) / y
    return float((1 / total).sum()), plain


def weighted_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h, _, w = counted(*shingle_hashes(data, np.asarray([0, len(data)]), SHINGLE))
    return h, w


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in slices(batches):
        data, offsets = bytes_of(batch.column(2))
        out = []
        for i, j in runs(offsets):
            own = offsets[i : j + 1] - offsets[i]
            h, t, w = counted(*shingle_hashes(data[offsets[i] : offsets[j]], own, SHINGLE))
            bands, sizes = candidate_bands(h, t, w, j - i)
            values = pa.array(bands.view(np.int64))
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values))
        lists = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), lists], names=["doc_id", "node", "size", "bands"])


def linked_classes(texts: list[str], classes: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Classes of texts under links at the threshold, as least indices, and links that join them: (i, j, similarity).

    classes: texts of equal numbers are joined already; side: compare only texts of different sides. Plain Jaccard is
    exact for all pairs, by counting posting lists; where shingles repeat within a text, so is probability Jaccard: no two
    samples agree more often than the shares of their weights overlap, so pairs whose overlap, summed from the same posting
    lists, is under the threshold need no further look.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    h, t, w = counted(*shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, SHINGLE))
    n = len(texts)
    sizes = np.bincount(t, minlength=n)
    begin = np.append(0, np.cumsum(sizes))
    by = np.argsort(h, kind="stable")
    ranked = h[by]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[by] = np.cumsum(new) - 1
    posting, length = t[by], np.diff(np.append(first, len(h)))
    repeats = np.bincount(t, weights=w > 1, minlength=n) > 0
    share = w / np.maximum(np.bincount(t, weights=w, minlength=n), 1)[t]
    posted = share[by]
    label, links = np.arange(n), []

    def exact(i: int, j: int) -> float:
        return max(similarity(*((h[begin[x] : begin[x + 1]], w[begin[x] : begin[x + 1]]) for x in (i, j))))

    if classes is not None and n:
        _, head, inverse = np.unique(classes, return_index=True, return_inverse=True)
        label = head[inverse]
    for i in range(n):
        open_ = label != label[i]
        if side is not None:
            open_ &= side != side[i]
        if not sizes[i] or not open_.any():
            continue
        mine = number[begin[i] : begin[i + 1]]
        k = length[mine]
        at = np.repeat(first[mine] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
        shared = np.bincount(posting[at], minlength=n)
        alike = shared / np.maximum(sizes + sizes[i] - shared, 1)
        link = open_ & (alike >= THRESHOLD - 1e-12)
        if repeats.any():
            overlap = np.bincount(posting[at], weights=np.minimum(posted[at], np.repeat(share[begin[i] : begin[i + 1]], k)), minlength=n)
            odd = np.flatnonzero(open_ & ~link & (overlap >= THRESHOLD - 1e-9) & (repeats | repeats[i]))
            for j in odd.tolist():
                alike[j] = exact(i, j)
                link[j] = alike[j] >= THRESHOLD - 1e-12
        if link.any():
            at = np.flatnonzero(link)
            _, one = np.unique(label[at], return_index=True)
            links += [(i, j, exact(i, j) if repeats[i] or repeats[j] else float(alike[j])) for j in at[one].tolist()]
            joined = np.unique(np.append(label[link], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label, links


LINK = "a binary, b binary, similarity double"


def _links(a: list[bytes], b: list[bytes], alike: list[float]) -> pa.Table:
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(alike, pa.float64())], names=["a", "b", "similarity"])


def _link_stars(table: pa.Table) -> pa.Table:
    """Links between the rows' texts and those of their leads, which are rows of the same table and unit."""
    lead, node, text = (table.column(c).to_pylist() for c in ("lead", "node", "text"))
    place = {n: i for i, n in enumerate(node)}
    sets = {n: weighted_set(text[i]) for n, i in place.items()}
    pairs = sorted({(a, b) for a, b in zip(lead, node) if a != b})
    found = [(a, b, s) for a, b in pairs if (s := max(similarity(sets[a], sets[b]))) >= THRESHOLD - 1e-12]
    return _links(*([x[i] for x in found] for i in range(3)))


def _link_blocks(table: pa.Table) -> pa.Table:
    """Links between classes within the units (a block, or two blocks, of a bucket) of a table."""
    table = table.sort_by([("h", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
    unit = np.stack([table.column(c).to_numpy() for c in ("h", "i", "j")])
    first = np.flatnonzero(np.append(True, (unit[:, 1:] != unit[:, :-1]).any(0)))
    a, b, alike = [], [], []
    for x, y in zip(first.tolist(), np.append(first[1:], table.num_rows).tolist()):
        part = table.slice(x, y - x)
        node, block = part.column("node").to_pylist(), part.column("block").to_numpy()
        _, number = np.unique(np.asarray(part.column("cls").to_pylist(), object), return_inverse=True)
        _, links = linked_classes(part.column("text").to_pylist(), number, block if block.min() != block.max() else None)
        for i, j, s in links:
            a.append(node[i])
            b.append(node[j])
            alike.append(s)
    return _links(a, b, alike)


def node_of(text_col: str = "text"):
    """What equal texts share: the MD5 of the text; a null is empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _blocks() -> Column:
    """Blocks of a group of texts: by number and bytes."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).cast("int")


def _tasks(units: DataFrame) -> int:
    """So many tasks that each gets BLOCK_BYTES of text, on average."""
    return max(1, -(-(units.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES))


def _star_links(star: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the pairs of star(lead, node, size); a lead of many is dealt into several units."""
    blocks = star.groupBy("lead").agg(_blocks().alias("k"), F.max("lead_size").alias("lead_size"))
    blocks, _ = materialise(blocks, "leads")
    salt = F.pmod(F.xxhash64("node"), F.col("k"))
    members = star.join(blocks.select("lead", "k"), "lead").select("lead", salt.cast("int").alias("salt"), "node", "size")
    leads = blocks.select("lead", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.col("lead").alias("node"), F.col("lead_size").alias("size"))
    units, _ = materialise(members.unionByName(leads), "stars")
    g = F.pmod(F.xxhash64("lead", "salt"), F.lit(_tasks(units))).alias("g")
    return units.select("lead", "node", g).join(texts, "node").groupBy("g").applyInArrow(_link_stars, LINK)


def _block_links(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between classes within the buckets of rest(h, node, cls, size), block by block."""
    blocks, _ = materialise(rest.groupBy("h").agg(_blocks().alias("k")), "blocks")
    placed = rest.join(blocks, "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    units, _ = materialise(placed.withColumn("with", other).select("h", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "cls", "size"), "units")
    g = F.pmod(F.xxhash64("h", "i", "j"), F.lit(_tasks(units))).alias("g")
    return units.drop("size").withColumn("g", g).join(texts, "node").groupBy("g").applyInArrow(_link_blocks, LINK)


def _verified(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(links, labels) of nodes(node, size, bands): links between different texts and (node, comp) of those that have one."""
    each = nodes.select("node", "size", F.explode("bands").alias("h"))
    shared, _ = materialise(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    found, bits = filter_of(shared.select(F.col("h").alias("f")), shared.count())
    # of the bands that no other text has most stop here and are not shuffled again
    members = each.withColumn("set", found).where(may_hold(F.col("set"), F.col("h"), bits)).drop("set")
    members, _ = materialise(members.join(shared, "h"), "members")
    spread = [F.bit_xor(F.xxhash64(F.col("node"), F.lit(i))).alias(f"x{i}") for i in range(2)]
    buckets = members.groupBy("h").agg(F.count("*").alias("n"), *spread).groupBy("n", "x0", "x1").agg(F.min("h").alias("h")).select("h")
    rest, _ = materialise(members.join(buckets, "h").withColumn("cls", F.col("node")), "buckets")

    wanted = rest.select("node").distinct()
    found, bits = filter_of(wanted.select(F.xxhash64("node").alias("f")), wanted.count())
    # of the texts in no bucket most stop here and are not shuffled
    near = rows.select("node", "text", found.alias("set")).where(may_hold(F.col("set"), F.xxhash64("node"), bits)).select("node", "text")
    texts, _ = materialise(near.groupBy("node").agg(F.any_value("text").alias("text")).join(wanted, "node", "left_semi"), "texts")

    links, labels = None, None
    for turn in range(STARS + 1):
        if rest.isEmpty():
            break
        if turn < STARS:
            leads, _ = materialise(rest.groupBy("h").agg(F.min_by(F.struct("node", "cls", "size"), "node").alias("l")).select("h", F.col("l.node").alias("lead"), F.col("l.cls").alias("lead_cls"), F.col("l.size").alias("lead_size")), "leads")
            rest, _ = materialise(rest.join(leads, "h").where("node <> lead"), "rest")
            star = rest.where("cls <> lead_cls").select("lead", "lead_size", "node", "size").distinct()
            more, _ = materialise(_star_links(star, texts), "links")
        else:
            more, _ = materialise(_block_links(rest, texts), "links")
        links = more if links is None else links.unionByName(more)
        labels = components(links.select("a", "b"))
        if turn < STARS:
            named = rest.select("h", "node", "size").join(labels, "node", "left").select("h", "node", "size", F.coalesce("comp", "node").alias("cls"))
            named, _ = materialise(named, "named")
            open_, _ = materialise(named.groupBy("h").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("h"), "open")
            rest, _ = materialise(named.join(open_, "h"), "rest")
    return links, labels


def _signed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = texts_of(docs, id_col, text_col).select("doc_id", node_of().alias("node"), "text")
    signed, _ = materialise(rows.mapInArrow(_sign_batches, "doc_id long, node binary, size long, bands array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    return rows, signed, materialise(nodes, "texts")[0]


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified links between different texts that span the classes: a and b (least doc_id of each text) and similarity."""
    rows, _, nodes = _signed(docs, id_col, text_col)
    links, _ = _verified(nodes, rows)
    if links is None:
        return docs.sparkSession.createDataFrame([], "a long, b long, similarity double")
    least = nodes.select("node", "least")
    a, b = (least.select(F.col("node").alias(c), F.col("least").alias(f"id_{c}")) for c in "ab")
    return links.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity")


def _degrees(links: DataFrame) -> DataFrame:
    """(node, n_links, most_alike) of the texts that have links; a link found in several turns counts once."""
    once = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    ends = once.select(F.explode(F.array("a", "b")).alias("node"), "similarity")
    return ends.groupBy("node").agg(F.count("*").alias("n_links"), F.max("similarity").alias("most_alike"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, node (what equal texts share), class_id, class_size in documents and kept_node.

    with_links adds class_texts, the number of different texts in the class, n_links, that of the verified links by which
    the row's text holds to others of its class, and most_alike, the greatest similarity of these (null: none). These links
    span the class: between k texts there are k - 1 or more, not all pairs.
    """
    rows, signed, nodes = _signed(docs, id_col, text_col)
    links, labels = _verified(nodes, rows)
    own = nodes.select("node", "least", "copies")
    own = own.withColumn("comp", F.col("node")) if labels is None else own.join(labels, "node", "left").select("node", "least", "copies", F.coalesce("comp", "node").alias("comp"))
    found, _ = materialise(own, "nodes")
    first = F.min_by("node", F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))).alias("kept_node")
    classes = found.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), first, F.count("*").alias("class_texts"))
    # written, so that the join's sides are plain shuffles and a class of many texts can be split
    classes, _ = materialise(classes, "classes")
    names = ["class_id", "class_size", "kept_node"]
    by_node = found.join(classes, "comp")
    if with_links:
        names += ["class_texts", "n_links", "most_alike"]
        if links is None:
            by_node = by_node.withColumns({"n_links": F.lit(0).cast("long"), "most_alike": F.lit(None).cast("double")})
        else:
            by_node = by_node.join(materialise(_degrees(links), "degrees")[0], "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return signed.select("doc_id", "node").join(by_node.select("node", *names), "node").select("doc_id", "node", *names)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each class (that of the least id), with the same columns."""
    found = near_duplicate_classes(docs, id_col, text_col)
    kept = found.where("node = kept_node and doc_id <=> class_id").select(F.col("doc_id").alias("kept_id"), "node").distinct()
    own = free_name(docs, "node")
    rows = docs.withColumn(own, node_of(text_col))
    one = rows.join(kept, (rows[own] == kept["node"]) & rows[id_col].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
    # what is left to drop are repeated rows: equal id, equal text
    return one.dropDuplicates([id_col, own]).drop(own)
