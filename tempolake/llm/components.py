"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored


#: A node's edges are joined in so many parts, so that a hub makes no large task.
SALTS = 16


def _least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least node m of u."""
    spread = least.select(F.col("u").alias("w"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("n"))
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, (F.col("u") == F.col("w")) & (F.col("s") == F.col("n"))).select("u", "v", "m")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones) go to the least of all."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = _least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = _least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the edges; a component is its least node.

    Each round is written to the shared folder, so no lineage grows and a lost
    executor costs one round at most. The number of rounds grows with the
    logarithm of the longest chain. Hot nodes are summed before the shuffle, and
    the joins are salted. Edges with a
    null end are left out.
    """
    whole = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        later = stored(_stars(stored(_stars(now, True)), False))
        drop_stored(now)
        now = later
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
