"""Connected components of a table of links, by alternating stars.

Large-star: every node hands its larger neighbours to its smallest neighbour.
Small-star: every node hands its smaller neighbours to the smallest of them.
Both are one aggregation and one join; a logarithmic number of rounds ends in
stars whose centres are the smallest ids. Every round is written to the shared
folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.runtime import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) of longs -> (node, label): label is the smallest id reachable.

    Nodes without a link to another node don't appear. Null ends, loops and
    repeated links are ignored.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct()
    edges = written(edges, "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        edges = written(small, "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
