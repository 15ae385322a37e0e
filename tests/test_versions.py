"""The log of versions: what is written for an edit, restores, changes; and boundaries by tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import labels
from lumenlake.operators.session import VersionLog


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_versions_share_chunks(spark, tmp_path):
    base = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"))
    base = base.unionByName(base.where("k < 40")).unionByName(spark.createDataFrame([(None, None, 1), (None, "1", None), (None, "1", None)], "k long, a string, b long"))
    log = VersionLog(spark, str(tmp_path / "log"), ["k"], 50)
    assert log.commit(base, "v1") == 50
    edited = base.withColumn("a", F.when(F.col("k") == 4321, "new").otherwise(F.col("a")))
    assert log.commit(edited.repartition(3), "v2") == 1  # one row: one chunk
    assert log.commit(base.orderBy("k"), "v3") == 0  # back again
    assert log.commit(base.dropDuplicates(), "v4") > 0 and log.commit(base.limit(0), "v5") == 0
    for version, want in (("v1", base), ("v2", edited), ("v3", base), ("v4", base.dropDuplicates()), ("v5", base.limit(0))):
        assert rows_of(log.restore(version).select("k", "a", "b")) == rows_of(want)
    assert rows_of(log.changes("v1", "v2").select("change", "k", "a")) == rows_of(spark.createDataFrame([("-", 4321, "2"), ("+", 4321, "new")], "change string, k long, a string"))
    assert log.changes("v1", "v3").count() == 0 and log.changes("v4", "v1").groupBy("change").count().collect() == [("+", 41)]
    assert [(r.version_id, r.rows, r.stored) for r in log.versions().collect()][2:] == [("v3", 5043, 0), ("v2", 5043, 1), ("v1", 5043, 50)]
    with pytest.raises(ValueError, match="no version"):
        log.restore("v9")
    with pytest.raises(ValueError, match="exists"):
        log.commit(base, "v1")


def test_swapped_nulls_and_doubled_rows_are_changes(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, a int, b int")
    log = VersionLog(spark, str(tmp_path / "log"), ["k"], 1)
    for i, rows in enumerate(([(1, None, 2)], [(1, 2, None)], [(1, 2, None)] * 2, [(1, None, 2)] * 2, [])):
        assert log.commit(df(*rows), str(i)) == bool(rows)
        assert rows_of(log.restore(str(i))) == rows_of(df(*rows))


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_boundaries_by_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    plane = rng.integers(-1, 3, (13, 17))
    gone = rng.random(plane.shape) < 0.1
    rows = [(name, int(y), int(x), None if plane[y, x] < 0 else int(plane[y, x]) * 2**40, "more") for name in "ab" for y in range(13) for x in range(17) if not gone[y, x]]
    got = labels.boundary(spark.createDataFrame(rows, "image_id string, y int, x int, cell_id long, other string"), tile)
    at = {r[:3]: r[3] for r in rows}
    want = [r for r in rows if r[3] and any((o := at.get((r[0], r[1] + a, r[2] + b))) is not None and o != r[3] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["image_id", "y", "x", "cell_id", "other"]
    assert "Sort [y" not in got._jdf.queryExecution().toString()
