"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and all its v as m. A join, not a collected list: a hub may have any number of neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("its"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("its")).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _stars(down)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): for each end of an edge (u, v) the least id that it is connected with.

    Each round is staged in the shared folder; rounds end when the edges no longer change, which two sums over
    them show. Loops and repeated edges are harmless; null ends are dropped; no edges give no rows.
    """
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    told = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told or not now[0]:
            break
        told = now
        edges = staged(small_star(large_star(edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
