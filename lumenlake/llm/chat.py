"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation many times, each time with some turns more. Each turn's prefix gets a rolling hash: two
64-bit hashes of the turn and its place are combined with the prefix before it, in one running pass over a conversation's
turns. A conversation whose whole hash is the hash of a proper prefix of another one of more turns is dropped by an
anti-join; of equal conversations the one with the least id stays. What stays is rendered.

The hashes of prefixes are made distinct before they are joined, and of every whole conversation one row is joined, so a
first turn that a third of all conversations share is one row, and many copies of one conversation are one row. Prefixes
are equal if their lengths and 128 bits agree.

Cases: rows with a null conv_id belong to no conversation and are left out; turns are ordered by number, nulls first,
ties by role and text, and repeated rows of one turn count once; a null role or text differs from an empty one in the
hash and is rendered as empty; a conversation, which is one row when it is rendered, must fit in a task, and its hashes
take time in proportion to its turns; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE_START, TEMPLATE_END = "<|im_start|>", "<|im_end|>\n"


def conversations_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): a row for each conversation with its turns in order."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, h0, h1): for each prefix of n turns of each conversation its rolling hash."""
    each = conversations.select("conv_id", F.posexplode("turns").alias("at", "t"))
    hash_of = lambda salt: F.xxhash64(F.lit(salt), "at", F.col("t.role").isNull(), "t.role", F.col("t.text").isNull(), "t.text")
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("conv_id", (F.col("at") + 1).alias("n"), *(F.bit_xor(hash_of(i)).over(so_far).alias(f"h{i}") for i in range(2)), F.lead("at").over(Window.partitionBy("conv_id").orderBy("at")).isNull().alias("whole"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, copies): the conversations that are no prefix of another, each with the number of its equals."""
    prefixes = prefix_hashes(conversations)
    whole = prefixes.where("whole").groupBy("n", "h0", "h1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = prefixes.where("not whole").select("n", "h0", "h1").distinct()
    return whole.join(shorter, ["n", "h0", "h1"], "left_anti").select("conv_id", "copies")


def rendered(turns: Column) -> Column:
    line = lambda t: F.concat(F.lit(TEMPLATE_START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(TEMPLATE_END))
    return F.array_join(F.transform(turns, line), "")


def format_maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, copies, text of every maximal conversation, rendered."""
    conversations = conversations_of(turns, conv_col, turn_col, role_col, text_col)
    kept = maximal(conversations)
    return conversations.join(kept, "conv_id").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", rendered(F.col("turns")).alias("text"))
