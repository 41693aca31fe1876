"""Whitening of embeddings by hierarchical merging of singular value decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, staged, trimmed

#: Summaries that one task of the tree merges.
TOGETHER = 8
BLOCK_ROWS = 4096
SUMMARY = "part int, n long, sums array<decimal(38,0)>, basis binary"


def finite(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def quantised(vectors: DataFrame, col: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vector counts, with x: its entries times scale, rounded down, as longs.

    Vectors that are null or empty or hold null or non-finite entries go. Of vectors of several lengths those of the most frequent one stay (of a tie, the longest). Other columns stay; one called x is replaced.
    """
    rows = vectors.filter(finite(F.col(col)))
    most = rows.groupBy(F.size(col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    rows = rows.filter(F.size(col) == (most["dims"] if most else 0))
    return rows.withColumn("x", F.transform(col, lambda c: F.floor(c.cast("double") * scale).cast("long")))


@dataclass(frozen=True)
class Summary:
    """What a set of vectors is known by: how many, exact sums, and singular values times right singular vectors of the centred rows, at full rank."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _rotated(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors; all of them."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def exact_sums(x: np.ndarray) -> tuple[int, ...]:
    """Sums of the columns of 64-bit integers, which may exceed 64 bits."""
    upper, lower = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return tuple((int(u) << 32) + int(v) for u, v in zip(upper, lower, strict=True))


def summary(x: np.ndarray) -> Summary:
    sums = exact_sums(x)
    return Summary(len(x), sums, _rotated(x - np.array([s / len(x) for s in sums])))


def merged(a: Summary, b: Summary) -> Summary:
    """Of two sets of vectors as one: both bases and a row that makes up for the distance of the means, decomposed again. Nothing is cut off."""
    shift = np.sqrt(a.n / (a.n + b.n) * b.n) * (a.mean - b.mean)
    return Summary(a.n + b.n, tuple(s + t for s, t in zip(a.sums, b.sums, strict=True)), _rotated(np.vstack([a.basis, b.basis, shift])))


def _row(part: int, s: Summary) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [s.n], "sums": [[Decimal(t) for t in s.sums]], "basis": [s.basis.tobytes()]})


def _read(row) -> Summary:
    sums = tuple(int(s) for s in row.sums)
    return Summary(int(row.n), sums, np.frombuffer(row.basis, np.float64).reshape(-1, len(sums)))


def summaries(vectors: DataFrame) -> DataFrame:
    """One row for each partition that has vectors: its Summary. Blocks of rows are merged one after the other, so memory follows the dimensions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for k in range(0, len(batch), BLOCK_ROWS):
                block = summary(np.stack(batch["x"].iloc[k : k + BLOCK_ROWS].to_numpy()).astype(np.int64))
                total = merged(total, block) if total else block
        if total:
            yield _row(TaskContext.get().partitionId(), total)

    return vectors.select("x").mapInPandas(trimmed(run), SUMMARY)


def merge_tree(rows: DataFrame) -> Summary | None:
    """The one Summary of all rows of summaries(): neighbours are merged TOGETHER at a time, level by level, each level staged."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = None
        for row in rows.itertuples():
            total = merged(total, _read(row)) if total else _read(row)
        return _row(int(rows["part"].iloc[0]) // TOGETHER, total)

    rows = staged(rows, "summaries")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        rows = staged(rows.groupBy(F.floor(F.col("part") / TOGETHER)).applyInPandas(merge, SUMMARY), "summaries")
        parts = -(-parts // TOGETHER)
    last = rows.first()  # as large as the dimensions' square, whatever the number of vectors
    return _read(last) if last else None


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, eigenvalues by falling size, their unit eigenvectors (largest entry positive), and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Eigenvalues that are not zero but for rounding."""
        least = self.values[0] * (max(self.n, len(self.sums)) * np.finfo(float).eps) ** 2 if len(self.values) else 0
        return int(np.count_nonzero(self.values > max(least, 0)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit integers, or Python's where they need more."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whiten(self, deviations: np.ndarray, components: int) -> np.ndarray:
        """A column for each component; NaN where its eigenvalue is zero."""
        centred = (deviations / self.n).astype(np.float64)
        good = min(components, self.rank)
        out = np.full((len(centred), components), np.nan)
        out[:, :good] = centred @ self.vectors[:good].T / np.sqrt(self.values[:good])
        return out


def fitted(vectors: DataFrame) -> Whitening | None:
    """The whitening of column x (arrays of longs of one length), each row counted once; None without rows.

    Every partition keeps singular values, vectors and means at full rank; the tree of merges appends a mean-correction row and decomposes again.
    """
    total = merge_tree(summaries(vectors))
    if total is None:
        return None
    dims = len(total.sums)
    _, s, vt = np.linalg.svd(np.vstack([total.basis, np.zeros((dims, dims))]), full_matrices=False)
    values = s**2 / total.n
    sign = np.sign(vt[np.arange(dims), np.abs(vt).argmax(axis=1)])
    return Whitening(total.n, total.sums, values, vt * np.where(sign == 0, 1, sign)[:, None], float(values.sum()))


def _sized(total: int | None) -> int | None:
    return None if total is None or total >= 1 << 63 else total


def whitened(rows: DataFrame, model: Whitening, components: int | None = None, col: str = "whitened") -> DataFrame:
    """rows with deviation (sum over dimensions of (n * x - sums) squared, exact; null if it exceeds a long) and an array of so many whitened components, all by default; null where an eigenvalue is zero."""
    components = len(model.sums) if components is None else min(components, len(model.sums))
    names = [c for c in rows.columns if c not in ("deviation", col)]
    rows = rows.select(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            off = model.deviations(np.stack(batch["x"].to_numpy()).astype(np.int64))
            small = off.dtype != object and int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63
            total = (off * off).sum(axis=1).tolist() if small else [_sized(sum(int(v) ** 2 for v in row)) for row in off]
            out = model.whiten(off, components)
            yield batch.assign(deviation=pd.array(total, "Int64"), **{col: [[None if np.isnan(v) else float(v) for v in row] for row in out]})

    schema = T.StructType([*rows.schema.fields, T.StructField("deviation", T.LongType()), T.StructField(col, T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(trimmed(run), schema)


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the covariance of whitened vectors minus the identity, over components whose eigenvalue is not zero. Spark's covariance centres before it multiplies."""
    k = min(components, model.rank)
    if not k:
        return 0.0
    rows = whitened(vectors.select("x"), model, k, "w").select(*(F.col("w")[i].alias(f"w{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = rows.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_whitening(vectors: DataFrame, components: int = 4) -> DataFrame:
    """The contract's columns: a row for each vector that counts and each of the first components.

    Which vectors count is said in quantised(). Repeated rows are kept and fitted once. A component whose eigenvalue is zero (fewer distinct vectors than components) has
    whitened null and explained 0 (null if all vectors are equal). Vectors with fewer entries than components have as many components as entries.
    A null vec_id is kept. No vectors, no rows. Other columns are not read.
    """
    rows = quantised(vectors.select("vec_id", "embedding")).select("vec_id", "x")
    fit = staged(rows.select("x").distinct(), "fit-list")
    model = fitted(fit)
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], columns)
    error, explained = identity_error(fit, model, components), [float(v) / model.trace if model.trace else None for v in model.values[:components]]
    out = whitened(rows, model, components).select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.array(*(F.lit(v).cast("double") for v in explained))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
