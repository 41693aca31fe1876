"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, give_back, text_of, trimmed

ORDERS = (1, 2, 3)
UNKNOWN = "und"
BITS = 21  # of a code point
#: The least score of an accepted text: a distance of at most 0.75 of the largest possible. Of sf0.1 and 6,000 documents each of check_s and
#: check_h none scored under 0.36; random letters from 200 characters on scored under 0.25, other scripts 0.
LEAST = 0.25


def remainder(col: str, of: int) -> Column:
    """crc32 of an integer as text, modulo ``of``; 0 for null."""
    return F.coalesce(F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % of, F.lit(0))


class Letters:
    """A table of all code points: letters as they are, all else as a space."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            cls._table = np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), np.arange(0x110000), 32).astype(np.int64)
        return cls._table

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        """Code points of the lower-case text, words between single spaces."""
        points = cls.table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate([[32], points, [32]])
        return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]


def grams(points: np.ndarray) -> list[np.ndarray]:
    """The n-grams of each order as integers; those that are a space alone or hold one inside are left out."""
    out = []
    for n in ORDERS:
        if len(points) < n:
            continue
        code = np.zeros(len(points) - n + 1, np.int64)
        keep = np.ones(len(code), bool)
        for k in range(n):
            part = points[k : len(points) - n + 1 + k]
            code = code << BITS | part
            if n == 1 or 0 < k < n - 1:
                keep &= part != 32
        out.append(code[keep])
    return out


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, by count, then code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > top:  # only what can be among the first
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:top]


def learn(docs: DataFrame, top: int = 300) -> dict[str, list[int]]:
    """Profiles of each language in the rows of (text, lang): the ``top`` n-grams over all their texts, by count, then code.

    Counting is distributed, with a partial count for each batch; the driver gets ``top`` rows for each language. Rows
    with a null text or language are left out; without any row there are no languages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                texts = texts.tolist()
                at = 0
                while at < len(texts):  # about 1 M code points at a time
                    to, n = at, 0
                    while to < len(texts) and (to == at or n + len(texts[to]) < 1 << 20):
                        n += len(texts[to])
                        to += 1
                    for codes in grams(Letters.of(" ".join(texts[at:to]))):
                        values, counts = np.unique(codes, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": values, "n": counts})
                    at = to

    counts = docs.filter("text is not null and lang is not null").select("lang", "text").mapInPandas(trimmed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Judge:
    """Out-of-place distances of a text's profile to all languages at once."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.langs, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(p, np.int64) for p in profiles.values())]))
        # By code and language: its rank; ``top`` beyond the profile.
        self.ranks = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        points = Letters.of(text) if text else np.zeros(0, np.int64)
        if not self.langs or not (points != 32).any():
            return UNKNOWN, 0.0
        own = ranked(np.concatenate(grams(points)), self.top)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        ranks = self.ranks[at[known]]
        places = np.arange(len(own))[known][:, None]
        far = np.where(ranks < 0, self.top, np.abs(ranks - places)).sum(axis=0) + self.top * int((~known).sum())
        best = int(np.argmin(far))  # ties: the first language by name
        return self.langs[best], 1.0 - float(far[best]) / (self.top * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = 300) -> DataFrame:
    """docs with lang_pred and score (1 less the distance over the largest possible).

    Null texts and texts without a letter are ``und`` with score 0. Only the text decides; repeated rows are judged alike;
    all other columns are kept, and columns of these two names are replaced.
    """
    (judged_as,) = fresh(docs.columns, "judged")
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return with_judgement(docs, profiles, judged_as, top).select(*names, f"{judged_as}.lang_pred", f"{judged_as}.score")


def with_judgement(docs: DataFrame, profiles: dict[str, list[int]], name: str, top: int = 300) -> DataFrame:
    """docs with a struct of lang_pred and score under a name that docs does not have."""

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(profiles, top)
        for batch in texts:
            yield pd.DataFrame([judge(t) for t in batch], columns=["lang_pred", "score"])
        give_back()

    # pandas turns a null of a string series into None, which the judge takes.
    return docs.withColumn(name, judged("text"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder("doc_id", 4) != 2).select("text", "lang")


def op7_language(docs: DataFrame) -> DataFrame:
    """Learns from all rows that the contract allows."""
    judged = identify(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return judged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def lettered(docs: DataFrame) -> DataFrame:
    """The rows with a letter in their text, whatever its length; null and empty texts have none. Repeated rows stay as they are; other columns are not looked at."""

    @F.pandas_udf("boolean")
    def any_letter(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and bool((Letters.of(t) != 32).any()) for t in texts], dtype=bool)

    return docs.filter(any_letter("text"))


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows whose language is a learned one with a score of at least ``least``; the columns of docs, whatever their names. Where no language could be learned, the rows with a letter.

    Null and empty texts and those without a letter go. A text of any length is judged by its 300 most frequent n-grams; of two languages as near the first by name
    counts, which changes no decision. Repeated rows are judged alike; an empty table stays empty.
    """
    profiles = learn(training_rows(docs))
    if not profiles:
        return lettered(docs)
    (judged,) = fresh(docs.columns, "judged")
    return with_judgement(docs, profiles, judged).filter((F.col(f"{judged}.lang_pred") != UNKNOWN) & (F.col(f"{judged}.score") >= least)).select(*docs.columns)
