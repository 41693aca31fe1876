"""Connected sets of rows by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _flat(parents: DataFrame) -> DataFrame:
    """(x, p) with p the last of the chain x, p, parent of p, ...: each pass doubles how far a row has gone, so a chain of n takes log n."""
    while True:
        up = parents.select(F.col("x").alias("_x"), F.col("p").alias("_p"))
        parents = stage(parents.join(up, F.col("p") == F.col("_x")).select("x", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved")), "parents")
        if parents.filter("moved").isEmpty():
            return parents.select("x", "p")
        parents = parents.select("x", "p")


def contracted(edges: DataFrame) -> DataFrame:
    """(x, root) for every end of the edges (u, v): the least that it is connected with.

    In a round each node hooks on to its least neighbour if that is smaller, chains of hooks are followed to their ends, and every tree becomes one node. Each node that
    is left has taken in another, so the nodes of a connected set halve at least: log n rounds, whatever its shape. Edges without an end, loops and repeated edges do no harm.
    """
    edges = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        flat = _flat(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("x"), F.least("u", "v").alias("p")))
        to = flat.select(F.col("x").alias("_x"), F.col("p").alias("_p"))
        roots = flat.select("x", F.col("p").alias("root")) if roots is None else stage(roots.join(to, F.col("root") == F.col("_x"), "left").select("x", F.coalesce("_p", "root").alias("root")), "roots")
        ends = edges.join(to, F.col("u") == F.col("_x")).select(F.col("_p").alias("u"), "v").join(to, F.col("v") == F.col("_x")).select("u", F.col("_p").alias("v"))
        edges = stage(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("u").alias("x"), F.col("v").alias("root"))


def clusters(rows: DataFrame, row_id: str, keys: DataFrame) -> DataFrame:
    """(row_id, cluster): rows that share keys, directly or through others, get the least row_id among them. keys: (row_id, key).

    Every key links its rows to the least of them, an edge for each, so a key that a third of all rows share adds no more edges than rows.
    """
    links = stage(keys.select(F.col(row_id).alias("u"), "key").filter("key is not null").distinct(), "keys")
    least = links.groupBy("key").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "v")
    roots = contracted(links.join(least, "key").select("u", "v"))
    return rows.select(row_id).join(roots, F.col(row_id) == F.col("x"), "left").select(row_id, F.coalesce("root", row_id).alias("cluster"))
