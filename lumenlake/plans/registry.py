"""Registered queries of the engine's operators over the driver's tables, each with its DuckDB SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}

#: Added before rounding on both sides: means of values with two decimals often lie on a tie, where engines' last bits differ.
NUDGE = 1e-7


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles of df rounded alike in both engines."""
    return df.select(*(F.round(F.col(c) + NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def nudged(sql: str) -> str:
    """The SQL with the nudge inside each round(x, n)."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, -1, k + 6
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            comma = i if c == "," and depth == 1 else comma
            i += 1
        inner = nudged(sql[k + 6 : comma])
        out.append(f"{sql[at:k]}round(({inner}) + 1e-7{sql[comma:i]}")
        at = i
    return "".join([*out, sql[at:]])


def query(ops: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its own name; ops: ids of the operator inventory that it covers."""

    def add(build: Builder) -> Builder:
        QUERIES[build.__name__] = Query(build.__name__, tuple(ops.split()), build, nudged(sql) if sql else None)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
