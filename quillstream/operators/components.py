"""Connected components of pairs, by stars that grow towards the smallest member.

Each round every node hands its larger neighbours to its smallest one, then its smaller ones; a chain of n nodes takes
about log n rounds. Pairs are written after each, so that a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.stages import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with m, the smallest b of each a. Counted before it is joined: a node with very many pairs is one
    row on one side, and Spark splits its rows on the other."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
    return pairs.join(low, F.col("a") == F.col("_a")).drop("_a")


def components(pairs: DataFrame) -> DataFrame:
    """node, root of pairs (a, b) of longs: root is the smallest node of the component. Only nodes of pairs come."""
    stars = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        near = _smallest(large)
        stars = cut(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = stars.select(F.col("b").alias("node")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = now
