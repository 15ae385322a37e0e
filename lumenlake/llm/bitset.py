"""Bit arrays of hashes, to leave out rows before a join; in DataFrame functions alone.

An array has 16 bits or more for each hash, so about one in seventeen others passes, up to 2**MAX_BITS bits (16 MB),
which is what may be sent to every task. With more hashes than fit it fills up little by little and more rows pass; the
plan and the result stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 27

def bit_array(hashes: DataFrame, bits: int) -> DataFrame:
    """One row, one array of longs, in which the bit of each hash of the column f is set."""
    slot = F.col("f").bitwiseAND(F.lit((1 << bits) - 1))
    got = hashes.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    every = hashes.sparkSession.range(1 << (bits - 6)).join(got, "id", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).getField("b").alias("set"))


def may_hold(found: Column, f: Column, bits: int) -> Column:
    slot = f.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(found, F.shiftright(slot, 6).cast("int"))
    return F.call_function("getbit", word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def filter_of(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A scalar with the bit array of the n hashes of the column f, and its size in bits as a power of two."""
    bits = min(MAX_BITS, max(12, (16 * max(n, 1) - 1).bit_length()))
    return bit_array(hashes, bits).scalar(), bits
