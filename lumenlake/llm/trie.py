"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of a conversation's first turns; the root is the empty one. A turn's hash is salted with its
place, and a prefix is known by the XOR of its turns' hashes, two of 64 bits, so the prefixes of a conversation are a running
XOR and a node's parent is the node's own hash without its last turn's.

Nodes are then brought into preorder by sorting. Siblings may come in any order as long as subtrees stay together, so a
node's key is not its whole path but the turns at which the path leaves the heavy child (the one of most conversations):
(depth of the parent, hash of the child) for each, and at last the node's own depth. A path leaves a heavy child at most
log2(conversations) times, so keys stay short however long conversations are. Keys are sorted by ranges; counts, leaves
and savings become running sums in that order, made of each range's own and the totals of the ranges before. A subtree
ends where its last leaf stands. As the sums never fall, a node's values at that place are the greatest among its leaves,
and what a subtree holds is the difference of two running sums.

A conversation's turns are sorted by ranges too, and each lot (the turns of one conversation in one range) is numbered
and hashed alone, from the counts and hashes of the lots before, so a conversation may hold any share of all turns. Joins
on a node or conversation that many rows meet send the most popular keys to the rows (``common.spread_join``).

Cases: rows with a null conversation id belong to no conversation and are left out; turns are ordered by number, nulls
first, ties by role and text; repeated rows are turns of their own; null roles and texts are empty; a conversation without
turns is a member of the root alone; without conversations there is no node, not even a root; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread_join

NODE = ["at", "h0", "h1"]
#: Conversation ids that go into one row on their way to a node's digest.
CHUNK = 4096


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, at, t0, t1, size): every turn with its place in its conversation, hashes of role and text, and code points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    hashes = [F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in range(2)]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed, _ = materialise(placed.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), *hashes, F.length("text").cast("long").alias("size")), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lots = placed.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    lots = lots.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return placed.join(lots, ["conv_id", "part"]).select("conv_id", "part", (F.col("id") + F.col("shift")).alias("at"), "t0", "t1", "size")


def with_lent_heads(turns: DataFrame, lender: Column, length: Column, most: int) -> DataFrame:
    """Conversations that begin with the first turns of another one, in the form of ordered_turns.

    lender and length, of the column conv_id, tell which one and how many turns, at most ``most``; the conversation's own
    turns after its first ``length`` follow. A lender must not lend to more conversations than one task can hold.
    """
    turns, _ = materialise(turns, "ordered")
    heads = turns.where(F.col("at") <= most).groupBy(F.col("conv_id").alias("lender")).agg(F.array_sort(F.collect_list(F.struct("at", "t0", "t1", "size"))).alias("head"))
    lots = turns.groupBy("conv_id", "part").agg(F.lit(1).alias("one"))
    borrowers = turns.where("at = 1").select("conv_id", lender.alias("lender"), length.cast("int").alias("h")).join(heads, "lender", "left")
    borrowers = borrowers.select("conv_id", "h", F.filter(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), lambda x: x["at"] <= F.col("h")).alias("head"))
    borrowers, _ = materialise(borrowers, "borrowers")
    shifts = lots.join(borrowers.select("conv_id", "h", (F.size("head") - F.col("h")).alias("shift")), "conv_id").drop("one")
    own = turns.join(shifts, ["conv_id", "part"]).where("at > h").select("conv_id", "part", (F.col("at") + F.col("shift")).alias("at"), "t0", "t1", "size")
    lent = borrowers.select("conv_id", F.lit(-1).alias("part"), F.inline("head")).select(*own.columns)
    return lent.unionByName(own)


def prefix_paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, at, h0, h1, g0, g1, size, whole): for every conversation (of a table conv_id) the root and a row for each prefix."""
    steps, _ = materialise(turns.select("conv_id", "part", "at", "size", *(F.xxhash64(F.lit(i), "at", "t0", "t1").alias(f"g{i}") for i in range(2))), "steps")
    lots = Window.partitionBy("conv_id").orderBy("part")
    sums = steps.groupBy("conv_id", "part").agg(F.bit_xor("g0").alias("x0"), F.bit_xor("g1").alias("x1"), F.max("at").alias("last"))
    so_far = [F.coalesce(F.bit_xor(f"x{i}").over(lots.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(f"b{i}") for i in range(2)]
    sums = sums.select("conv_id", "part", *so_far, F.max("last").over(Window.partitionBy("conv_id")).alias("n"))
    sums, _ = materialise(sums, "sums")
    run = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = steps.join(sums, ["conv_id", "part"])
    paths = met.select("conv_id", "at", *(F.bit_xor(f"g{i}").over(run).bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in range(2)), "g0", "g1", "size", (F.col("at") == F.col("n")).alias("whole"))
    zero = F.lit(0).cast("long")
    some = sums.select("conv_id").distinct().withColumn("some", F.lit(True))
    roots = conversations.select("conv_id").distinct().join(some, "conv_id", "left")
    roots = roots.select("conv_id", *(zero.alias(c) for c in ("at", "h0", "h1", "g0", "g1", "size")), F.col("some").isNull().alias("whole"))
    return paths.unionByName(roots)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows (node, conv_id) of one node become rows (node, first id, ids in decimal)."""
    key, ids, out = None, [], []

    def closed():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key or len(ids) == CHUNK:
                closed()
                key = at
            ids.append(conv)
        if len(out) > CHUNK:
            yield _rows(out, _CHUNK_SCHEMA)
            out.clear()
    closed()
    yield _rows(out, _CHUNK_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's chunks, which come in order; one state is held, whatever the number of ids."""
    key, state = None, sha256()
    for batch in batches:
        out = []
        for a, h0, h1, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, h0, h1) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (a, h0, h1), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(out, _DIGEST_SCHEMA)
    yield _rows([(*key, state.hexdigest())] if key else [], _DIGEST_SCHEMA)


_NODE_FIELDS = [(c, pa.int64()) for c in NODE]
_CHUNK_SCHEMA = pa.schema([*_NODE_FIELDS, ("first", pa.int64()), ("ids", pa.string())])
_DIGEST_SCHEMA = pa.schema([*_NODE_FIELDS, ("ends_sha256", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def ends_digest(wholes: DataFrame) -> DataFrame:
    """(node, ends_sha256): for each node at which conversations end, the digest of their ids in ascending order."""
    order = [*NODE, "conv_id"]
    chunks = wholes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "at long, h0 long, h1 long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "at long, h0 long, h1 long, ends_sha256 string")


def in_preorder(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with position, saved_upto and leaves_upto: their preorder number, and the running sums of own and of leaf up to it."""
    light = nodes.where("not heavy and at > 0").select(*NODE, F.col("n_convs").alias("__weight"))
    steps = paths.where("at > 0").select("conv_id", *NODE)
    exits = spread_join(steps, light, NODE, "__weight").groupBy("conv_id").agg(F.collect_list(F.struct((F.col("at") - 1).alias("d"), F.lit(1).alias("k"), "h0", "h1")).alias("exits"))
    carriers = nodes.groupBy("conv_id").agg(F.count("*").alias("__weight")).join(exits, "conv_id", "left")
    carriers, _ = materialise(carriers, "carriers")
    zero = F.lit(0).cast("long")
    own = F.array(F.struct(F.col("at").alias("d"), F.lit(0).alias("k"), zero.alias("h0"), zero.alias("h1")))
    above = F.array_sort(F.filter(F.coalesce("exits", F.filter(own, lambda x: F.lit(False))), lambda x: x["d"] < F.col("at")))
    keyed = spread_join(nodes, carriers, ["conv_id"], "__weight").withColumn("key", F.concat(above, own)).drop("exits")
    placed = keyed.repartitionByRange("key").sortWithinPartitions("key").withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}).drop("key")
    placed, _ = materialise(placed, "preorder")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("own").alias("s"), F.sum("leaf").alias("l"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "nsl"))
    run = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.join(F.broadcast(parts), "part")  # as many rows as there are ranges
    sums = {"position": F.count("*").over(run) + F.col("n_before"), "saved_upto": F.sum("own").over(run) + F.col("s_before"), "leaves_upto": F.sum("leaf").over(run) + F.col("l_before")}
    return met.withColumns(sums).drop("part", "id", "n_before", "s_before", "l_before")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, position, end_position.

    turns as from ordered_turns; conversations(conv_id): all of them, also those without turns. saved_tokens counts code
    points that a cache of prefixes spares: for each node of the subtree those of its last turn, once for each member but one.
    """
    paths, _ = materialise(prefix_paths(turns, conversations), "paths")
    nodes = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("g0").alias("g0"), F.max("g1").alias("g1"), F.max("size").alias("size"))
    nodes = nodes.withColumns({"p0": F.col("h0").bitwiseXOR(F.col("g0")), "p1": F.col("h1").bitwiseXOR(F.col("g1")), "own": (F.col("n_convs") - 1) * F.col("size")}).drop("g0", "g1", "size")
    nodes, _ = materialise(nodes, "nodes")
    kids = nodes.where("at > 0").groupBy((F.col("at") - 1).alias("at"), F.col("p0").alias("h0"), F.col("p1").alias("h1"))
    kids, _ = materialise(kids.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "h0", "h1")).alias("top")), "kids")
    heavy = kids.select((F.col("at") + 1).alias("at"), "top.h0", "top.h1", F.lit(True).alias("heavy"))
    nodes = nodes.join(kids.drop("top"), NODE, "left").join(heavy, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "heavy": F.coalesce("heavy", F.lit(False))})
    nodes, _ = materialise(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "children")

    ranked, _ = materialise(in_preorder(nodes, paths), "ranked")
    leaves = ranked.where("leaf = 1").select("conv_id", (F.col("at") + 1).alias("__weight"), F.struct("position", "saved_upto", "leaves_upto").alias("last"))
    ends = spread_join(paths.select("conv_id", *NODE), leaves, ["conv_id"], "__weight").groupBy(*NODE).agg(F.max("last").alias("last"))
    digests = ends_digest(paths.where("whole"))
    parents = nodes.where("n_children > 0").select((F.col("at") + 1).alias("at"), F.col("h0").alias("p0"), F.col("h1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__weight"))
    found = ranked.join(ends, NODE).join(digests, NODE, "left")
    found, _ = materialise(found, "found")
    found = spread_join(found, parents, ["at", "p0", "p1"], "__weight", "left")
    return found.select(
        "conv_id",
        F.col("at").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("last.leaves_upto") - F.col("leaves_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("last.saved_upto") - F.col("saved_upto") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        "position",
        F.col("last.position").alias("end_position"),
    )
