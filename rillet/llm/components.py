"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.scratch import cut


def stars(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, root (the smallest node it reaches) for each end of ``edges`` (a, b) that isn't a root.

    Every step joins edges with one minimum per node; edges of a node with many
    neighbours lie in as many pieces as the adaptive join splits them into.
    Each round's edges are written, so a lost executor costs one round.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last, k = mark(edges), 0
    while True:
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, folder, f"{name}{k}")
        now = mark(edges)
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
