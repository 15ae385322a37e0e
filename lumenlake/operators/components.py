"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges(a, b): comp is the least node of the component.

    Each round, every component takes its least neighbour for its parent if that is less than itself; parents are
    followed twice; then edges and labels are renamed and edges within a component drop out. All that are no local
    minimum merge, so the number of components that still have edges at least halves, however long the paths are. A hub
    is pre-aggregated by min() and is one row of the renaming; nothing is collected.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("comp")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            last, parent = parent, written(parent.join(up, "p").select("a", F.col("pp").alias("p")), "parents")
            discard(last)
        to = parent.withColumnsRenamed({"a": "x", "p": "px"})
        old = labels, edges
        labels = written(labels.join(to, labels["comp"] == to["x"], "left").select("node", F.coalesce("px", "comp").alias("comp")), "labels")
        ends = edges.join(to, edges["a"] == to["x"]).select(F.col("px").alias("a"), "b")
        ends = ends.join(to, ends["b"] == to["x"]).select("a", F.col("px").alias("b")).where("a <> b")
        edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(parent, *old)
    return labels
