"""Connected components of an edge list, without moving edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)``: the smallest node each node is connected with; null ends and loops are left out.

    Alternates the two star operations (every neighbour greater than a node is linked to its smallest neighbour, then
    every smaller one) until a round changes nothing, however many that takes (in practice about the logarithm of the
    longest path). A round's edges are checkpointed, so that lineage stays short and a lost executor costs one round.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut_lineage(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
        new = cut_lineage(small.select("x.u", "x.v").where("u != v").distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
