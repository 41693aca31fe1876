"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, running, staged, text_of

COLUMNS = "doc_id long, source string, tie long, size long, source_size long, target double, whole long, part double, bucket long, done boolean"


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, weigh 1, 2, 3, repeating.

    A target is weight * level, at most ``most`` times the source's size, and the level is such that targets add up to all
    sizes; that is where resharing the excess by weight ends. It follows from running sums over the sources in order of
    the level at which they reach their limit. The driver gets three numbers; sources may be as many as hosts.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    per = per.withColumn("weight", (F.pmod(F.col("rank") - 1, F.lit(3)) + 1).cast("double"))
    per = per.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("limit") / F.col("weight"))
    per = running(per, [F.col("full_at"), F.col("source").asc_nulls_last()], {"limits": F.col("limit"), "weights": F.col("weight"), "place": F.lit(1)})
    total, weights = per.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    # The level if exactly the sources before this one are at their limits.
    level = (F.lit(total) - (F.col("limits") - F.col("limit"))) / (F.lit(weights) - (F.col("weights") - F.col("weight")))
    found = per.filter(level <= F.col("full_at")).agg(F.min(F.struct("place", level.alias("level")))["level"]).first()[0]
    target = F.col("limit") if found is None else F.least("limit", F.col("weight") * found)
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _pivot(rows: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Rounds one group: transfers mass (size * part) between two open rows until one part is 0 or 1, and goes on with the other.

    The expected parts stay, and so does the group's mass, but for the one row that may stay open.
    """
    # Long rows first: then the row that stays open at the end is a short one as a rule.
    rows = rows.sort_values(["size", "doc_id", "tie"], ascending=[False, True, True], kind="stable", na_position="first", ignore_index=True)
    size, part = rows["size"].to_numpy(np.float64), rows["part"].to_numpy(np.float64).copy()
    chance = np.random.Generator(np.random.PCG64([seed, level, int(rows["bucket"].iloc[0]) & 0xFFFFFFFF, len(rows)])).random(len(rows))
    open_ = -1
    for i in range(len(rows)):
        if open_ < 0:
            open_ = i
            continue
        j = open_
        a, b = size[i], size[j]
        up, down = min(a * (1 - part[i]), b * part[j]), min(a * part[i], b * (1 - part[j]))
        if chance[i] * (up + down) < down:  # mass goes from j to i
            full, empty = a * (1 - part[i]) <= b * part[j], b * part[j] <= a * (1 - part[i])
            part[i] = 1.0 if full else part[i] + up / a
            part[j] = 0.0 if empty else part[j] - up / b
        else:
            empty, full = a * part[i] <= b * (1 - part[j]), b * (1 - part[j]) <= a * part[i]
            part[i] = 0.0 if empty else part[i] - down / a
            part[j] = 1.0 if full else part[j] + down / b
        closed = [k for k in (i, j) if part[k] in (0.0, 1.0)]
        open_ = -1 if len(closed) == 2 else i if closed == [j] else j
    rows["part"] = part
    rows["done"] = (part == 0.0) | (part == 1.0)
    return rows


def _pivoting(seed: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pivot(rows, seed, level)

    return run


def mixed(docs: DataFrame, most: float = 3.0, seed: int = 29, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, copies): how often the mix takes each row. tie: a hash of the text, which tells rows of one doc_id apart.

    A row's expected copies are target / source_size. Whole copies are certain; the fractional part is rounded by pivotal
    dependent rounding: first inside buckets of about bucket_rows of one source, then the one open row of each bucket in
    groups of bucket_rows buckets, and so on up a tree; the last open row of a source goes to the nearer side. A
    source's taken words are within half a document of its target. Random numbers are seeded by level and bucket and rows are
    sorted by size, doc_id and text, so reruns agree. Null text and texts without words have size 0 and no copies; a null source is one; rows that
    repeat a doc_id count each; an empty table gives an empty result. Only the number of rows of the largest source reaches the driver.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_of()).alias("tie"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    sizes = staged(sizes, "mix-sizes")
    of = targets(sizes, most).withColumnRenamed("source", "its")
    rows = sizes.join(F.broadcast(of) if _few(sizes) else of, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    largest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.lit(buckets))).withColumn("done", F.col("part") == 0.0)
    settled = rows.filter("done")
    left, level = rows.filter("not done"), 0
    layers = [settled]
    while True:
        ran = left.groupBy("source", "bucket").applyInPandas(_pivoting(seed, level), COLUMNS)
        ran = staged(ran.select(*settled.columns), f"mix-level{level}")
        layers.append(ran.filter("done"))
        left, level = ran.filter("not done"), level + 1
        if buckets == 1:
            break
        buckets = -(-buckets // bucket_rows)
        left = left.withColumn("bucket", F.floor(F.col("bucket") / bucket_rows))
    layers.append(left.withColumn("part", F.round("part")))
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("long").alias("copies"))


def _few(sizes: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough for their table to be broadcast."""
    return sizes.agg(F.approx_count_distinct("source")).first()[0] <= most


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs, whatever their names.

    Rows of one doc_id, source and text are numbered and take the copies of as many results, so a table that repeats rows is
    mixed row by row. Nulls, empty texts and empty tables as in mixed(); a text of any length is one value.
    """
    names = docs.columns
    id_, source, tie, nr, copies, its_id, its_source, its_tie, its_nr = fresh(names, "id", "of", "tie", "nr", "copies", "its_id", "its_of", "its_tie", "its_nr")
    taken = mixed(docs, **kw).select(F.col("doc_id").alias(its_id), F.col("source").alias(its_source), F.col("tie").alias(its_tie), F.col("copies").cast("int").alias(copies))
    taken = taken.withColumn(its_nr, F.row_number().over(Window.partitionBy(its_id, its_source, its_tie).orderBy(copies)))
    taken = staged(taken, "taken")
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(source, F.col("source").cast("string")).withColumn(tie, F.xxhash64(text_of()))
    same = F.col(id_).eqNullSafe(F.col(its_id)) & F.col(source).eqNullSafe(F.col(its_source)) & (F.col(tie) == F.col(its_tie))
    if not taken.filter(F.col(its_nr) > 1).isEmpty():  # else every row is told by id, source and text, and texts need no second shuffle
        rows = rows.withColumn(nr, F.row_number().over(Window.partitionBy(id_, source, tie).orderBy(F.lit(0))))
        same = same & (F.col(nr) == F.col(its_nr))
    (again,) = fresh([*names, copies], "again")
    return rows.join(taken.filter(F.col(copies) > 0), same).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*names)


def op4_mixing(docs: DataFrame) -> DataFrame:
    rows = mixed(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
