"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage_path, staged, text_of


def shuffled(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Every row of docs with ``shard`` and ``slot``, in a seeded random order of the whole table.

    Pass one scatters the rows uniformly into buckets of about bucket_bytes by a seeded hash of doc_id and text; pass two shuffles
    each bucket by Fisher-Yates. The order is bucket after bucket; shard s takes the s-th of ``shards`` runs of it, so row
    counts differ by one at most (law ``rows``) and slots are gapless from 0. Where a bucket starts comes from running sums in Spark; the
    driver gets two totals. Rows without a doc_id spread by their texts; repeated rows share a bucket and keep
    their own slots, and as they are alike any order of them is the same; null text counts as empty; a text of any length is one value; an empty table gives an empty result; columns named
    shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    names = docs.columns
    bucket, at = fresh(names, "bucket", "at")
    total = docs.agg(F.sum(F.octet_length(text_of()).cast("long") + 64)).first()[0] or 0
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))
    keyed = docs.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), text_of()), F.lit(buckets)).cast("int"))
    starts = staged(_starts(keyed.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))), "bucket-starts")
    n = starts.agg(F.sum("n")).first()[0] or 0

    def fisher_yates(key: tuple, rows: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        # Rows come in any order: a fixed one first, so that a rerun shuffles alike.
        order = rows[["doc_id", "text"]].assign(text=rows["text"].fillna("")).sort_values(["doc_id", "text"], kind="stable", na_position="last").index.to_numpy().copy()
        np.random.Generator(np.random.PCG64([seed, int(key[0])])).shuffle(order)  # Fisher-Yates, in place
        rank = int(place["start"].iloc[0]) + np.arange(len(order), dtype=np.int64)
        shard = rank * shards // n
        return rows.loc[order, names].assign(shard=shard.astype(np.int32), slot=rank - -(-shard * n // shards))

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # A bucket's number is its partition's, so no two buckets share a task by chance.
    left = keyed.repartitionById(buckets, F.col(bucket)).groupBy(bucket)
    right = starts.select(F.col("bucket").cast("int").alias(bucket), "start").repartitionById(buckets, F.col(bucket)).groupBy(bucket)
    return left.cogroup(right).applyInPandas(fisher_yates, schema)


def _starts(counts: DataFrame, together: int = 4096) -> DataFrame:
    """(bucket, n, start) from (bucket, n): running sums in two levels, so that no task sees more than ``together`` buckets or sums of as many."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("block", F.floor(F.col("bucket") / together))
    inner = counts.withColumn("upto", F.sum("n").over(upto(Window.partitionBy("block").orderBy("bucket"))))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("in_block"))
    blocks = blocks.withColumn("before", F.sum("in_block").over(upto(Window.orderBy("block"))) - F.col("in_block")).select("block", "before")
    return inner.join(blocks, "block").select("bucket", "n", (F.col("before") + F.col("upto") - F.col("n")).alias("start"))


def write_shards(docs: DataFrame, path: str, **kw) -> DataFrame:
    """Write shuffled(docs) as path/shard=N/*.parquet, each file a run of slots, and read the whole back."""
    spark = docs.sparkSession
    out = shuffled(docs, **kw)
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op10_sharding(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the shards as written."""
    rows = write_shards(docs.select("doc_id", "text"), stage_path(docs.sparkSession, "shards"))
    text = text_of()
    return rows.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
