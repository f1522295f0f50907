"""Connected components of a graph of links between 64-bit nodes.

Defined cases: links of a node to itself and repeated links count for nothing; nodes without other links are not returned; an
empty table gives an empty result; null ends must not occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import forget, materialise
from tessera.llm.skew import LEAST, spread_join

#: Rounds grow with the logarithm of the longest chain.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of ``links`` (columns a, b).

    Alternates the large-star and small-star steps: every node hangs its larger neighbours, then its smaller ones,
    under its smallest. A step needs the smallest neighbour of each node only, which is aggregated before it is
    shuffled; no neighbourhood is gathered. Each round is written to the shared folder.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialise(links.filter("a <> b").select(low, high).distinct(), "links")
    for _ in range(ROUNDS):
        total = edges.count()
        # What is read several times is written, unless it is small.
        cut = materialise if total > LEAST else lambda df, _: df
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # Large-star: larger neighbours go under the smallest. Each edge is held by its smaller end: a < b.
        large = cut(spread_join(edges, least, "a", total).select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), "large")
        # Small-star: a node's smaller neighbours and itself go under the smallest of them.
        small = cut(large.groupBy("b").agg(F.min("a").alias("m")), "small")
        moved = spread_join(large, small, "b", total).select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b"))
        new = materialise(moved.filter("a <> b").distinct(), "links")
        forget(edges, least, large, small)
        # Done once every node hangs under one node that hangs under none.
        parents = new.groupBy("b").agg(F.count("*").alias("n"))
        nested = new.select(F.col("a").alias("b")).distinct().join(parents.select("b"), "b", "left_semi")
        edges = new
        if parents.filter("n > 1").select("b").union(nested).isEmpty():
            break
    else:
        raise RuntimeError(f"links did not settle in {ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
