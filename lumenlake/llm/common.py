"""Helpers shared by the training-data operators: scratch tables in the shared folder and null-safe input columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash with the operators' own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows that a worker turns into Python objects at a time.
SLICE_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of SLICE_ROWS at most: of Spark's 10,000 long texts no worker needs a second copy at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


_held: list = [None, None]


def held(key: tuple, make):
    """make() for a key, kept by this worker until another key is asked for: one operator's memory at a time."""
    if _held[0] != key:
        release()
        _held[:] = [key, make()]
    return _held[1]


def release() -> None:
    """Let go of what held() keeps."""
    _held[:] = [None, None]


#: Keys that are broadcast by spread_join, at most, if not said otherwise.
POPULAR = 10_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", most: int = POPULAR) -> DataFrame:
    """rows joined with table, whose keys are unique and whose weight is at least the number of rows that meet a key.

    Keys of more than one in ``most`` of all weights, fewer than ``most`` for that reason, are broadcast, and their rows stay
    where they are; the rows of the others are shuffled, and no key of them is hot. The weight is not returned.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_popular = F.col(weight).cast("double") * most > float(total)
    popular = table.where(is_popular).drop(weight)
    rest = rows.join(F.broadcast(popular.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(popular), keys).unionByName(rest.join(table.where(~is_popular).drop(weight), keys, how))
