"""Connected components of a table of links by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b).

    In each round every node joins the neighbour (or itself) with the least random number; links
    are carried over to the chosen nodes. The number of nodes with links falls by a constant factor
    a round on average, also for long chains. Nothing but "is a link left?" reaches the driver.
    """
    links = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = materialize(links.select("a").union(links.select("b")).distinct().select(
        F.col("a").alias("node"), F.col("a").alias("at")), "labels")
    turn = 0
    while not links.isEmpty():
        ends = links.union(links.select("b", "a"))
        ends = ends.union(ends.select("a", F.col("a").alias("b")))
        choice = materialize(ends.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("to")), "choice")
        left = choice.select(F.col("a"), F.col("to").alias("ta"))
        right = choice.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = links.join(left, "a").join(right, "b").filter("ta <> tb")
        links = materialize(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        labels = materialize(labels.join(choice.withColumnRenamed("a", "at"), "at", "left").select(
            "node", F.coalesce("to", "at").alias("at")), "labels")
        turn += 1
    roots = labels.groupBy("at").agg(F.min("node").alias("component"))
    return materialize(labels.join(roots, "at").select("node", "component"), "components")
