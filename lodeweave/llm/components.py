"""Connected components by alternating large-star and small-star steps, each round cut in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (u, v) edges that isn't its component's least node, which is the root.

    Self loops, repeated and reversed edges, and an empty table are fine. A node with very many neighbours is met only
    by aggregates that combine before the shuffle and by joins whose large partitions can be split.
    """
    pairs = lambda u, v: edges_.select(F.col(u).alias("u"), F.col(v).alias("v"))
    edges_ = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = tuple(edges_.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            return edges_.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        least = pairs("u", "v").union(pairs("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u, and u itself, goes to the least node around u
        large = pairs("v", "u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: the lower neighbours of u, and u itself, go to the least of them
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lower.select("u", F.col("m").alias("v")))
        edges_ = cut(small.distinct())
