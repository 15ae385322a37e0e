"""A training corpus from ``documents``: quality rules, near-duplicates, decontamination, PII, packing.

Each stage judges all rows of its input and keeps its columns, whatever their names, but the last, which returns pieces.
Cases, the same in all stages: null ids are ids of their own; a null text counts as empty (quality drops both); texts of
any length are worked on whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import fertility, packing, pii, probminhash, winnow
from lumenlake.llm.common import materialise


#: Pieces that a worker remembers while packing: the workers share an executor whose other stages have filled its heap.
PACKED_PIECES = 150_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain counts or the tokenisers' bands go; repeated rows are judged alike, a null or unknown language takes its script's band."""
    return fertility.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the document with the least id stays; of repeated rows, and of rows that tie, one."""
    return probminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stands in the benchmark go; all rows of the same id and text go together."""
    return winnow.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, also in disguise; n_chars is set anew; every row stays."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; repeated rows are packed each, an empty text is the end id alone."""
    return packing.pack_documents(docs, max_pieces=PACKED_PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Tokenisers and registers are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
