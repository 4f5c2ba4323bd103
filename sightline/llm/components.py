"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    hops = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hops.filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); a component is its least node.

    Each round is written to the shared folder; no node's neighbours meet in one task
    beyond what an aggregation or a splittable join needs.
    """
    now, before, k = ws.store(edges.select("a", "b").filter("a <> b").distinct(), f"{name}0"), None, 0
    while True:
        k += 1
        stars = ws.store(_small_star(_large_star(now).distinct()), f"{name}{k}")
        mark = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        ws.drop(f"{name}{k - 1}")
        if mark == before:
            break
        now, before = stars, mark
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
