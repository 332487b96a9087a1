"""Connected components of a graph of long ids, by alternating large and small stars.

Every step is two joins of an edge table; neither a component nor a neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.scratch import forget, saved


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m) of directed edges (u, v): the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest one around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least_neighbour(both), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest one of them; edges here point from larger to smaller."""
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges, to see whether a step changed anything."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the smallest id that each linked id can reach; ids without a link are left out.

    Null ends and links of an id to itself are no links; repeated links count once; without links the result is empty.
    """
    edges = saved(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(
        F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        after = saved(_small_star(_large_star(edges)), "edges")
        forget(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
