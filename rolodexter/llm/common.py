"""What the operators share: reading, staging in the shared folder, and dealing documents out into groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ship import ship

#: The white space of every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, so that a batch of long texts stays small in both processes.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def prepare(spark: SparkSession) -> None:
    """What a session needs before an operator runs: the package on the executors, and small Arrow batches unless the session says otherwise."""
    ship(spark)
    for k, v in BATCH_ROWS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local master without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rolodexter-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rolodexter/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """SQL settings that hold for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: Of a Parquet page before compression: long enough for repeats among neighbouring texts to be found.
PAGE_BYTES = 8 << 20


def staged(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors. level: of compression."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with settings(spark, TIDY):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", PAGE_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(f: Callable[[Iterator], Iterable]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches; then the worker, which lives on, gives its free memory back to the system."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added until none is taken, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums in a global order without ties, in two levels: within ranges of the order, and over the sums of the ranges before. No task sees all rows."""
    part, *before = fresh([*rows.columns, *sums], "part", *(f"{c}_before" for c in sums))
    ranged = staged(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    upto = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy(part).agg(*(F.sum(e).alias(b) for e, b in zip(sums.values(), before, strict=True)))
    blocks = blocks.select(part, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before))
    inner = ranged.withColumns({c: F.sum(e).over(upto) for c, e in sums.items()})
    return inner.join(blocks, part).withColumns({c: F.col(c) + F.col(b) for c, b in zip(sums, before, strict=True)}).drop(part, *before)


def text_of(col: str = "text") -> Column:
    """A document's text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def group_count(docs: DataFrame, group_bytes: int, col: str = "text") -> int:
    """How many groups of about group_bytes of text the documents fill; at least two for each core."""
    total = docs.agg(F.sum(F.octet_length(text_of(col)).cast("long"))).first()[0] or 0
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // group_bytes))


def dealt(docs: DataFrame, groups: int) -> DataFrame:
    """(gid, doc_id, text), dealt out into that many groups by a hash of doc_id and text, so that rows without an id, or of one, spread too.

    A group's number is its partition's: groups never share a task by chance. Every use of the same frame has the same exchange,
    so one plan that uses it several times writes its shuffle once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("gid"), "doc_id", "text").repartitionById(groups, "gid")
