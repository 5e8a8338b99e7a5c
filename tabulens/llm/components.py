"""Connected components by alternating stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.storage import stage


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point neighbours at the least node around: the large star, or the small one.

    Each star moves the edges once, by node. Only the small star's are made
    distinct: it ends a round.
    """
    if larger_only:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = around.withColumn("m", F.least("a", F.min("b").over(W.partitionBy("a"))))
    if larger_only:
        return met.filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    both = F.array(*(F.struct(F.col(end).alias("a"), F.col("m").alias("b")) for end in ("a", "b")))
    return met.select(F.explode(both).alias("e")).select("e.*").filter("a <> b").distinct()


def least_nodes(edges: DataFrame) -> DataFrame:
    """For each node of the edges (a, b) that is not the least of its component: (node, root).

    Any orderable node type; null nodes and loops are ignored; no edges give no rows.
    """
    now = stage(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), "edges")
    mark = None
    while True:
        now = stage(_towards_least(_towards_least(now, True), False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
