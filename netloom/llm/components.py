"""Connected components of a table of links, by rounds of small joins.

Every round links each node's larger neighbours, then its smaller ones, to the
smallest node next to it; trees get flat in a number of rounds that grows with
the logarithm of the longest chain.  Each round is written to the checkpoint
folder; the driver learns only two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Links of each node to smaller ones, moved to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut_lineage(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node that links reach; nodes without a link are left out."""
    now = cut_lineage(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                      .where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        now = cut_lineage(_small_star(_large_star(now)).distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
