"""The corpus pipeline: language, exact copies, near copies, mixture, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rolodexter.llm.bpe import encode
from rolodexter.llm.common import documents, prepare, shared_dir
from rolodexter.llm.exact_dedup import distinct_documents
from rolodexter.llm.language import accepted
from rolodexter.llm.mixing import mix
from rolodexter.llm.near_dedup import one_of_each
from rolodexter.llm.queries import TOKENIZER

#: No SQL expresses the profiles, MinHash or BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far from every learned language go, and those without a letter or text (null and empty ones too).

    Profiles are learned from the rows with a language; without any, every text with a letter stays. Texts of any length are judged whole, repeated rows alike, of languages at one
    distance the first by name counts. All columns stay; an empty table gives an empty one.
    """
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, of these the smallest doc_id; null counts as empty, so one empty text stays.

    Full bytes are compared, whatever their length. Rows that repeat a doc_id are one document. All columns stay; an empty table gives an empty one.
    """
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8: of documents that are linked, directly or through others, the smallest doc_id stays.

    Documents without words and rows without a doc_id stay; rows that repeat a doc_id share its fate; texts of any length count whole. All columns stay; an empty table gives an empty one.
    """
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it: not at all, or up to three times.

    Documents of null or empty text weigh nothing and are not taken; a null source is one of its own. Which documents round up is told by seeded hashes, so reruns agree. All columns stay; an empty
    table gives an empty one.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and ids (little-endian unsigned 32-bit integers). Null counts as the empty text, which has no tokens; texts of any length are encoded whole; columns of these names are replaced."""
    return encode(docs, TOKENIZER)


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _shipped(f)) for name, f in (("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("bpe", tokens))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/rolodexter/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
