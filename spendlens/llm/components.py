"""Connected components of links in a table, with the smallest member as the component's id.

Rounds of large-star and small-star: in a large-star every node points its larger neighbours at the smallest
member of its neighbourhood, in a small-star its smaller ones.  The number of links never grows, and a hub
only ever contributes its minimum (a combined aggregate) and a join that AQE can split, so no neighbourhood is
gathered in one task.  Every round is written to the scratch folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(
        low.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node of its component."""
    now = cut(links.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        after = cut(_small(_large(now)).distinct(), "links")
        # settled when every node has one parent and no parent has a parent
        if after.isEmpty():
            break
        parents = after.select(F.col("b").alias("a")).distinct()
        if (after.groupBy("a").count().where("count > 1").isEmpty()
                and after.join(parents, "a", "left_semi").isEmpty()):
            break
        now = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
