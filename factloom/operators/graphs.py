"""Connected components and lookups that hold up when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import cut

#: A key with more than one in HOT rows is joined by broadcast; there are at most HOT such keys.
HOT = 1000
#: With no more edges than that no centre is looked for that has very many of them.
FEW_EDGES = 100_000


def lookup(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """rows left-joined with by_key, which has one row a key. Rows of hot keys stay where they are; the rest is shuffled.

    Null keys find nothing.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts)
    n = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(1, n // HOT)).select(key)
    if hot.isEmpty():
        return rows.join(by_key, key, "left")
    known = cut(by_key.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True)))
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(known), key, "left").drop("_hot")
    return hot_rows.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(by_key, key, "left"))


def _to_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """rows (u, v) with m, the least neighbour of u; least: u, m, n (rows of u). A centre with very many rows is no key of a
    shuffle: its rows stay where they are. There are at most HOT such centres."""
    if n_rows <= FEW_EDGES:
        return rows.join(least.drop("n"), "u")
    least = cut(least)
    hot = least.where(F.col("n") > max(FEW_EDGES // HOT, n_rows // HOT)).select("u", "m")
    return rows.join(F.broadcast(hot), "u").unionByName(rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.drop("n"), "u"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node of the component) for every node of the edges; loops and repeats may occur.

    Alternating large-star and small-star steps. Each step is a minimum a node, combined before the shuffle, and a join
    that leaves the rows of very large stars where they are; the edges between steps are written tables.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null")
    alone = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut(e.where("u > v").distinct())
    mark, size = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        e = _to_least(both.where("v > u"), least, size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        near = _to_least(e, least, size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, size = now, now[0]
    return alone.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
