"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Hang the neighbours of each node on the least of them and itself: larger ones, or smaller ones (`small`).

    Gives the new edges, and the written table of least nodes that they are still read from.
    """
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # least neighbours combine within each task; the rows meet them in a join, which Spark splits at a node with very many
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "least")
    near = near.join(least, "u")
    if small:
        hung = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(near.select("u", F.col("low").alias("v")))
    else:
        hung = near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.where("u <> v").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """`links` has columns u and v; gives node and component (the least node that links reach), for linked nodes.

    The result is read from a written table, which `discard` deletes.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was or state[0] == 0:
            break
        was = state
        large, first = _star(edges, small=False)
        both, second = _star(large, small=True)
        shorter = materialize(both, "links")
        discard(edges, first, second)
        edges = shorter
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", "v").distinct().toDF("node", "component"))
    out.folder = edges.folder
    return out
