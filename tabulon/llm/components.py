"""Connected components of a link table, as star rounds on the link table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import written


def _stars(links: DataFrame, to: DataFrame, later_only: bool) -> DataFrame:
    """Each link (u, v) with ``u``'s smallest neighbour m: (v, m).  ``to`` is a written table, so both sides of the
    join come straight from an exchange and a node with very many links can be split over tasks."""
    found = links.join(to, "u")
    if later_only:
        found = found.where("v > u")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _is_star_forest(links: DataFrame) -> bool:
    """Every node links to one smaller node at most, and those link to none: nothing is left to do."""
    ends = links.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("out")).unionByName(
        links.select(F.col("v").alias("node")).distinct().withColumn("out", F.lit(1).cast("long")))
    # a node that links twice, or that links and is linked to
    return ends.groupBy("node").agg(F.sum("out").alias("n")).where("n > 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node it can reach.

    Alternates two steps until the links are stars around the roots: every node links its
    larger neighbours to its smallest one, then its smaller neighbours (and
    itself) to the smallest of those.  Each step is a grouping and a join; nothing
    is collected, and every step is a written table.  Null nodes have no links.
    """
    x, y = F.col(a), F.col(b)
    now = written(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
                  .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "links")
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(_stars(both, least, True).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _stars(large, least, False).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
