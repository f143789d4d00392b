"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """(id, component) for every node of ``links`` (u, v); the component is its smallest node.

    Each round connects the larger neighbours of a node to its smallest one, then the smaller ones, until
    every edge points at the root of its component: a number of rounds logarithmic in the nodes. Edges of
    each round are a table in the shared folder. A node with very many links is a skewed join key only,
    and its minimum is combined before the shuffle.
    """
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen, k = scratch.save(edges, f"{step}-0"), None, 0
    while (now := _state(edges)) != seen and now[0]:
        seen, k = now, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(new, f"{step}-{k}")
        scratch.drop(f"{step}-{k - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()
