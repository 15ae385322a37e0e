"""Sessions and versions as tables in a folder: Parquet and one JSON manifest, nothing pickled."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, written

VERSION = "2.0"


def save_session(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], meta: Mapping[str, object] | None = None) -> None:
    """Write each table of a session, and last the manifest that names them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    body = json.dumps({"version": VERSION, "tables": sorted(tables), "meta": dict(meta or {})}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")


def load_session(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, meta) of a saved session."""
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    if manifest["version"] != VERSION:
        raise ValueError(f"session version {manifest['version']} is not {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in manifest["tables"]}, manifest["meta"]


def append_version(df: DataFrame, path: str, version_id: str) -> None:
    """Add a version of a table to its folder, partitioned by version."""
    df.withColumn("version_id", F.lit(version_id)).write.mode("append").partitionBy("version_id").parquet(path)


def restore_version(spark: SparkSession, path: str, version_id: str) -> DataFrame:
    """A version's rows; an unknown one is an error."""
    found = spark.read.option("basePath", path).parquet(path).where(F.col("version_id").cast("string") == version_id)
    if found.isEmpty():
        raise ValueError(f"no version {version_id}")
    return found.drop("version_id")


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("version_id").cast("string").alias("version_id")).distinct().orderBy(F.desc("version_id"))


class VersionLog:
    """Versions of a table in a folder, of which unchanged parts are stored once.

    Rows are dealt into a fixed number of chunks by their key. A chunk's address is its number, its count and the sums of
    two hashes of its rows, which do not depend on their order. A commit writes the rows of those chunks whose address no
    earlier commit has stored, and a row for each chunk of the version that says where it lies; so an edit of one row
    writes one chunk, and going back to an old state writes none. Only addresses are shuffled to find that out.

    Rows may repeat and columns may be null; the key's columns need not be unique. A commit that fails leaves rows that no
    version points to. Columns must stay the same from version to version.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], chunks: int = 1024):
        self._spark, self.path, self._key, self._chunks = spark, path, list(key), chunks

    def _index(self) -> DataFrame:
        at = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index")
        at.getFileSystem(self._spark._jsc.hadoopConfiguration()).mkdirs(at)
        return self._spark.read.schema("version_id string, seq long, chunk int, n long, d0 decimal(30,0), d1 decimal(30,0), stored_by string").parquet(f"{self.path}/index")

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__chunk", F.pmod(F.xxhash64(*self._key), F.lit(self._chunks)).cast("int"))

    def commit(self, df: DataFrame, version_id: str) -> int:
        """Store a version; the number of chunks that were written. A version that exists is an error."""
        index = self._index()
        if not index.where(F.col("version_id") == version_id).isEmpty():
            raise ValueError(f"version {version_id} exists")
        told_apart = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]  # a hash passes over nulls
        sums = [F.sum(F.xxhash64(F.lit(i), *told_apart).cast("decimal(20,0)")).alias(f"d{i}") for i in range(2)]
        rows = self._dealt(df)
        now = written(rows.groupBy(F.col("__chunk").alias("chunk")).agg(F.count("*").alias("n"), *sums), "chunks")
        known = index.groupBy("chunk", "n", "d0", "d1").agg(F.min("stored_by").alias("stored_by"))
        placed = written(now.join(known, ["chunk", "n", "d0", "d1"], "left"), "placed")
        fresh = placed.where("stored_by is null").select(F.col("chunk").alias("__chunk"))  # as many as there are chunks, at most
        count = fresh.count()
        if count:
            rows.join(F.broadcast(fresh), "__chunk").withColumn("__commit", F.lit(version_id)).repartition("__chunk").write.mode("append").partitionBy("__commit").parquet(f"{self.path}/rows")
        seq = (index.agg(F.max("seq")).first()[0] or 0) + 1
        entries = placed.select(F.lit(version_id).alias("version_id"), F.lit(seq).cast("long").alias("seq"), "chunk", "n", "d0", "d1", F.coalesce("stored_by", F.lit(version_id)).alias("stored_by"))
        if placed.isEmpty():  # a version without rows is one too
            entries = self._spark.createDataFrame([(version_id, seq, None, 0, None, None, None)], index.schema)
        entries.write.mode("append").parquet(f"{self.path}/index")
        discard(now, placed)
        return count

    def _entries(self, version_id: str) -> DataFrame:
        found = self._index().where(F.col("version_id") == version_id)
        if found.isEmpty():
            raise ValueError(f"no version {version_id}")
        return found.where("chunk is not null")

    def _rows(self, entries: DataFrame) -> DataFrame:
        """The rows of chunks, from the folders of the commits that stored them."""
        stored = self._spark.read.option("basePath", f"{self.path}/rows").option("mergeSchema", "false").parquet(f"{self.path}/rows").withColumn("__commit", F.col("__commit").cast("string"))
        commits = [r[0] for r in entries.select("stored_by").distinct().collect()]  # a row a version, at most
        wanted = entries.select(F.col("chunk").alias("__chunk"), F.col("stored_by").alias("__commit"))
        return stored.where(F.col("__commit").isin(commits)).join(F.broadcast(wanted), ["__chunk", "__commit"]).drop("__chunk", "__commit")

    def restore(self, version_id: str) -> DataFrame:
        return self._rows(self._entries(version_id))

    def changes(self, old: str, new: str) -> DataFrame:
        """Rows with change, "-" or "+": what one version has and the other has not, repeated rows by number; only chunks that differ are read."""
        same = ["chunk", "stored_by"]
        one, two = self._entries(old), self._entries(new)
        gone, came = self._rows(one.join(two.select(*same), same, "left_anti")), self._rows(two.join(one.select(*same), same, "left_anti"))
        lost, won = gone.exceptAll(came), came.exceptAll(gone)
        return lost.select(F.lit("-").alias("change"), "*").unionByName(won.select(F.lit("+").alias("change"), "*"))

    def versions(self) -> DataFrame:
        """(version_id, seq, rows, chunks, stored): newest first; stored: chunks that the version brought."""
        e = self._index()
        found = e.groupBy("version_id", "seq").agg(F.sum("n").alias("rows"), F.count("chunk").alias("chunks"), F.count_if(F.col("stored_by") == F.col("version_id")).alias("stored"))
        return found.orderBy(F.desc("seq"))
