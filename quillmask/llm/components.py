"""Connected components by alternating large and small stars.

Every round is two grouped minima and joins over the edges; the edge table is settled in
the shared folder after each round, so lineage stays short and lost executors cost a
re-read. Nothing but a few counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to its least neighbour (or itself)."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    j = both.join(least, "u").where("v > u")
    return j.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them. Edges have a < b."""
    least = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    j = e.join(least, e.b == least.u)
    others = j.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for all nodes of edges (a, b)."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    e = C.settle(e, "components")
    for _ in range(MAX_ROUNDS):
        e = C.settle(_small_star(C.settle(_large_star(e), "components")), "components")
        # done when every edge is (root, node): no node is both, and none has two roots
        tails = e.select("b")
        deep = e.join(tails.withColumnRenamed("b", "x"), F.col("a") == F.col("x"), "left_semi")
        twice = tails.groupBy("b").count().where("count > 1")
        if deep.isEmpty() and twice.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
