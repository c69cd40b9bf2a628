"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    """(node, component) of every node of links: the smallest node it is connected with.

    Each round makes every node point to smaller ones, until each points to the smallest. Minima are taken before the
    shuffle, and the joins' sides are rows of two numbers whose large groups AQE can split. Links with a null end are none.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    edges = stored(edges.distinct(), "links")
    before = state(edges)
    while before[0]:
        both = edges.selectExpr("u as x", "v as y").unionByName(edges.selectExpr("v as x", "u as y"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.join(least, "x").filter("y > x").selectExpr("y as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").selectExpr("v as u", "m as v")
        edges = stored(small.unionByName(least.selectExpr("u", "m as v")).distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct().selectExpr("v as node", "v as component")
    return edges.selectExpr("u as node", "v as component").unionByName(roots)


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
