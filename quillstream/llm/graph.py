"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node of edges (u, v: long).

    Each round gives nodes and the roots they point to the smallest label next to them, then halves the paths;
    rounds are written to the shared folder. Labels are aggregated by partial minima, so a node may have any
    number of edges."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels.node == near.u, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        told = seen.select(F.col("node").alias("n"), "new").unionByName(seen.where("new < label").select(F.col("label").alias("n"), "new"))
        told = stored(told.groupBy("n").agg(F.min("new").alias("new")), "told")
        roots = told.select(F.col("n").alias("root"), F.col("new").alias("up"))
        jumped = told.join(roots, told.new == roots.root, "left").select(F.col("n").alias("node"), F.least("new", F.coalesce("up", "new")).alias("label"))
        after = stored(jumped, "labels")
        changed = after.withColumnRenamed("label", "now").join(labels, "node").where("now <> label").limit(1).count()
        labels = after
        if not changed:
            return labels
