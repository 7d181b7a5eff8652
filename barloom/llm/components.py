"""Connected components of an edge table by alternating large-star and small-star.

Every round is joins and minima over the nodes' neighbours, partially aggregated and
cut by a written table; a hub's rows can be split by Spark like any skewed join. Only
a row count and a sum of hashes come to the driver, to see that nothing changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts


class Forest(dict):
    """Union-find by least node, for edges that one task holds."""

    def find(self, x):
        root = x
        while self.get(root, root) != root:
            root = self[root]
        while self.get(x, x) != root:
            self[x], x = root, self[x]
        return root

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = self.setdefault(min(a, b), min(a, b))


def components(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of edges (u, v) that isn't a root."""

    def sign(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    down = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    own = cuts.cut(down, thin=True)
    before = sign(own)
    while before[0]:
        # these minima are cut before they are joined: only then Spark can split a hub's rows in the join
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cuts.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), thin=True)
        large = cuts.cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), thin=True)
        cuts.drop(own, least)
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # no hubs here: u is the greater end
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = cuts.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), thin=True)
        cuts.drop(large)
        now = sign(own)
        if now == before:
            break
        before = now
    return own.select(F.col("u").alias("node"), F.col("v").alias("root"))
