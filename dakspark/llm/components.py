"""Connected components of a graph whose edges lie in a table, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step links nodes to the
smallest neighbour known, until nothing changes; the number of steps grows with the logarithm of the
nodes.  Each step aggregates by node (pre-summed by Spark before the shuffle) and is written to the
shared folder, so plans stay short and a lost executor costs one step at most.  The joins are plain
equi-joins, whose hot keys adaptive execution splits.  A graph of few edges lies in one partition, where a
step needs no shuffle: else each step of the many would leave files for every pair of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut_at, drop_path


#: Up to so many edges, of 16 bytes each, a step is one task's work.
FEW_EDGES = 100_000


def _linked(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = meet(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest neighbour."""
    down = _linked(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return meet(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def _settled(edges: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> bool:
    """If every node has one edge down at most, and none to a node that has one itself."""
    ends = meet(
        edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
        )
    )
    return ends.groupBy("node").agg(F.sum("down").alias("d"), F.max("up").alias("u")).where("d > 1 OR (d = 1 AND u = 1)").isEmpty()


def connected_components(edges: DataFrame, max_steps: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Rows (node, component) of all nodes with edges (a, b); a component is its smallest node.

    Nulls and loops in `edges` are left out; repeated edges count once.  The last table, which the result
    reads, goes to `scratch`, if given, for the caller to drop.
    """
    spark = edges.sparkSession
    now, path = cut_at(_linked(edges.select("a", "b")).distinct(), "edges")
    # Steps never add edges.
    meet = (lambda rows: rows.coalesce(1)) if now.count() <= FEW_EDGES else (lambda rows: rows)
    now = meet(now)
    for _ in range(max_steps):
        if _settled(now, meet):
            break
        nxt, new_path = cut_at(_small_star(_large_star(now, meet), meet).distinct(), "edges")
        drop_path(spark, path)
        now, path = meet(nxt), new_path
    else:
        raise RuntimeError("components did not settle")
    if scratch is not None:
        scratch.paths.append(path)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
