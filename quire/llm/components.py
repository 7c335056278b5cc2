"""Connected components over a distributed list of links (alternating stars).

Each round lets every node hand the smallest id it knows to its neighbours. A
neighbour list is never gathered: both stars are an aggregate and a join, which
adaptive execution can split when a node has very many links. The number of
rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """``links(u long, v long)`` -> ``(node long, component long)``.

    ``component`` is the smallest node reachable. Nodes without links are absent;
    self-links and repeated links are harmless; no links give no rows.
    """
    now = cut(_tidy(links.select("u", "v")))
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(_tidy(small.union(low.select("u", F.col("m").alias("v")))))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select("v", "v").distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from the larger id to the smaller."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    """Count and hash sum of the links; equal in two rounds means a fixed point."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    row = links.agg(F.count("*"), F.sum(h)).first()
    return (row[0], row[1])
