"""Connected components of a link table by contraction, with every round a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, store


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node, component (smallest node of the component) for every node of ``edges``; nodes are longs.

    Nodes take hashed labels (the hash of a long is a bijection).  In a round every label gives
    way to its smallest neighbour, links are relabelled, and those inside one label go; hashing
    keeps descending chains short, so the links shrink by a constant factor a round.  A node
    with very many links only meets partial aggregates and joins that can be split.
    """
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    member = store(nodes.withColumn("label", F.xxhash64("node")), "members")
    links = store(pairs.filter("x <> y").select(F.xxhash64("x").alias("x"), F.xxhash64("y").alias("y")).distinct(), "links")
    while not links.isEmpty():
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = store(both.groupBy(F.col("x").alias("label")).agg(F.min("y").alias("to")).filter("to < label"), "least")
        relabelled = store(member.join(least, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "members")
        shorter = links
        for end in ("x", "y"):
            shorter = shorter.join(least.withColumnRenamed("label", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        shorter = store(shorter.filter("x <> y").select("x", "y").distinct(), "links")
        discard(member, links, least)
        member, links = relabelled, shorter
    smallest = member.groupBy("label").agg(F.min("node").alias("component"))
    return member.join(smallest, "label").select("node", "component")
