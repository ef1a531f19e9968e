"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospark.llm.rows import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.filter("dst > src").join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of `edges` (src, dst: two columns of one orderable type).

    component is the smallest id reachable.  Each round is written to the
    shared folder, so no plan grows and a lost executor costs one round.  Only
    a count and a checksum of the edges come to the driver.  A node with a
    large part of all edges is met only by aggregates with partial sums and by
    joins that adaptive execution can split.  Null ends and self loops are
    dropped; no edges give an empty table.
    """
    columns = edges.columns
    edges = edges.select(F.col(columns[0]).alias("src"), F.col(columns[1]).alias("dst")).filter("src <> dst")
    last = None
    while True:
        edges = written(_small_star(_large_star(edges) if last else edges))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(seen) == last:
            break
        last = tuple(seen)
    roots = edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(roots)
