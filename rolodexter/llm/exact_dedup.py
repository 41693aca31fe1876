"""Exact deduplication with disk-backed streaming state; DataFrame and SQL functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, fresh, settings, stage_path, staged, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_ROWS = 500_000  # rows for each partition of the state
#: The state never expires: no watermark. Memory of all state stores of an executor is bounded together.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(col: str = "text") -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    return F.translate(text_of(col), SPACES, "")


def fingerprints(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, sha, digest, points, locator) of each row. locator: the file that holds the content, empty for a table without files."""
    sha = F.unhex(F.sha2(F.encode(normalised(), "UTF-8"), 256))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), F.char_length(text_of()).cast("long").alias("points"), F.input_file_name().alias("locator"))
    return out.withColumn("digest", F.substring("sha", 1, digest_bytes))


def first_seen(stream: DataFrame) -> DataFrame:
    """Streaming: for each digest the best row so far (most code points, then smallest doc_id; null ids last) with its locator, and how many rows it has."""
    # min of (-points, null id?, doc_id) is the best row
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))
    return stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))


def remember(table: str, schema, spark: SparkSession, state: str, partitions: int, max_bytes: str | None = None) -> DataFrame:
    """Runs first_seen() over what is new in a folder of fingerprints and returns the whole state as (digest, best, group_size).

    state: the checkpoint folder with the RocksDB state; a later run with the same folders takes new files only.
    partitions: of the state, fixed when it is first made. Each has a RocksDB of its own with some MB of files however little is
    in it, so their number follows the rows and not spark.sql.shuffle.partitions.
    max_bytes: of input for each micro-batch, if the first run is not to be one batch.
    """
    with settings(spark, STATE_CONF | {"spark.sql.streaming.internal.stateStore.partitions": str(partitions)}):
        reader = spark.readStream.schema(schema)
        if max_bytes:
            reader = reader.option("maxBytesPerTrigger", max_bytes)
        query = first_seen(reader.parquet(table)).writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(state)
    best, count = (F.col(f"value.`{c}`") for c in kept.schema["value"].dataType.names)
    return kept.select(F.col("key.digest").alias("digest"), best.alias("best"), count.alias("group_size"))


FILTER_BITS = 1 << 23  # of the filter below: 256 rows of 4 KB, however many hits there are


def _filter_key() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))


def hit_filter(hits: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of fixed size of the digests in ``hits``, for a broadcast join that lets all of them and few others through."""
    return hits.groupBy(F.bitmap_bucket_number(_filter_key()).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_filter_key())).alias("bits"))


def collisions(docs: DataFrame, hits: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Of the digests in ``hits``, which several rows have: those whose rows are not equal byte by byte.

    A bitmap lets the texts of hits through before they leave their task. They are combined by (digest, bytes) there, so each text of a
    group of copies leaves a task once, however large the group.
    """
    text = F.encode(normalised(), "UTF-8")
    rows = docs.select(F.substring(F.unhex(F.sha2(text, 256)), 1, digest_bytes).alias("digest"), text.alias("bytes"))
    position = F.bitmap_bit_position(_filter_key())
    byte = F.conv(F.hex(F.substr("bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(_filter_key())).join(F.broadcast(hit_filter(hits)), "bucket")
    rows = rows.filter(F.getbit(byte, (position % 8).cast("int")) == 1)
    return rows.groupBy("digest", "bytes").agg(F.lit(1).alias("one")).groupBy("digest").count().filter("count > 1").select("digest")


def deduplicated(docs: DataFrame, state: str | None = None, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha, points) for each row of docs. points: the code points of the text as it is.

    Fingerprints are staged and streamed through keyed state that retains digest, best row's id and content locator; hits are
    then held against each other by their full bytes, and the rows of a digest that stands for different texts are
    grouped by their bytes. state: a folder in which the state goes on from call to call; then group_size counts earlier calls' rows too and keep_id
    may be a row of theirs, while bytes are compared within a call. Null text is the empty one; all texts without other characters are copies of each other. Of
    rows with the same doc_id and text all count, and all are kept if that id is. A null doc_id loses ties and is kept
    only as its text's single id. Texts may be as long as a value can be. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    prints = fingerprints(docs, digest_bytes)
    state = state or stage_path(spark, "dedup-state")
    table, schema = f"{state}/fingerprints", prints.schema
    batch = f"{table}/{uuid.uuid4().hex}"
    prints.write.parquet(batch)
    prints = spark.read.schema(schema).parquet(batch)
    partitions = max(2 * spark.sparkContext.defaultParallelism, -(-prints.count() // STATE_ROWS))
    seen = remember(f"{table}/*", schema, spark, f"{state}/state", partitions)
    out = prints.select("doc_id", "sha", "points", "digest").join(seen.select(F.col("digest"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("most"), "group_size"), "digest")
    odd = staged(collisions(docs, seen.filter("group_size > 1").select("digest"), digest_bytes), "collisions")
    if not odd.isEmpty():
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text_of()).cast("long").alias("points"), normalised().alias("bytes")).withColumn("sha", F.unhex(F.sha2(F.encode("bytes", "UTF-8"), 256)))
        rows = rows.withColumn("digest", F.substring("sha", 1, digest_bytes)).join(odd, "digest", "left_semi").withColumn("locator", F.lit(""))
        per = first_seen(rows.withColumnRenamed("digest", "_").withColumnRenamed("bytes", "digest")).withColumnRenamed("digest", "bytes")
        again = rows.select("doc_id", "sha", "points", "digest", "bytes").join(per, "bytes").select("digest", "doc_id", "sha", "points", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("most"), "group_size")
        out = out.join(odd, "digest", "left_anti").unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"), "sha", "points")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each text; all columns, whatever their names.

    Null text counts as empty; ties go to the smallest doc_id, null last. Rows that repeat a doc_id with the same text are copies too: one
    of them stays. An empty table stays empty; a text of any length is one value.
    """
    names = docs.columns
    id_, sha, points = fresh(names, "its", "its_sha", "its_points")
    kept = deduplicated(docs).filter("kept").groupBy(F.col("doc_id").alias(id_), F.col("sha").alias(sha), F.col("points").alias(points)).agg(F.count(F.lit(1)).alias("n"))
    kept = staged(kept, "kept")
    own_sha, own_points = fresh([*names, id_, sha, points], "sha", "points")
    rows = docs.withColumn(own_sha, F.unhex(F.sha2(F.encode(normalised(), "UTF-8"), 256))).withColumn(own_points, F.char_length(text_of()).cast("long"))
    out = rows.join(kept.drop("n"), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)) & (F.col(own_points) == F.col(points)), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", own_sha])
    return out.select(*names)


def op1_exact_dedup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents
), g AS (
  SELECT sha, count(*) AS group_size, arg_min(doc_id, struct_pack(p := -points, d := doc_id)) AS keep_id FROM n GROUP BY sha
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM n JOIN g USING (sha)
"""
