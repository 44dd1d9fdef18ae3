"""Connected components of a graph of links, without gathering links or components on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging


def connected_components(links: DataFrame, staging: Staging) -> DataFrame:
    """(id, component) for every id of links (a, b); the component is its smallest id.

    Alternating star contraction: each round points a node's larger neighbours, then its smaller ones, to the
    smallest node around it. The number of edges never grows, and rounds grow with the logarithm of the size.
    A node with very many neighbours is reduced by a partial minimum and joined back by a join that splits.
    Links with a null end are ignored. Without links the result is empty.
    """
    kind = links.schema["a"].dataType
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staging.save(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staging.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(low.where("n > 1"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = staging.save(small.where("u <> v").distinct(), "edges")
        staging.drop(edges, large)
        edges = new
        # done when all edges point to roots and each node has one
        many = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        if not many.where("n > 1").select("u").unionByName(edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")).limit(1).count():
            break
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots).select(F.col("id").cast(kind), F.col("component").cast(kind))
