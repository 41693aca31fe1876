"""Row-by-row work that needs an order: quotas, previous runs, the best row of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark drops later rows before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def beyond(rows: DataFrame, key: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The rows that a retention of ``keep`` for each key drops."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_place") > keep).drop("_place")


def latest(rows: DataFrame, key: str, values: Sequence[str], when: Sequence[str]) -> DataFrame:
    """The values of each key's latest row: an aggregate, combined before the shuffle."""
    best = F.max(F.struct(*when, *[v for v in values if v not in when])).alias("_best")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"_best.{v}").alias(v) for v in values))


def with_quota(rows: DataFrame, eligible: Column, order: Sequence[Column], left: int, id_col: str = "id") -> DataFrame:
    """Adds ``in_quota``: true for the first ``left`` eligible rows of the whole table. Only those are sorted out globally, as a top-k."""
    first = rows.filter(eligible).orderBy(*order).limit(max(left, 0)).select(F.col(id_col).alias("_id"))
    return rows.join(first, F.col(id_col) == F.col("_id"), "left").withColumn("in_quota", F.col("_id").isNotNull()).drop("_id")


def run_history(runs: DataFrame, source: str = "source", at: Sequence[str] = ("started_at", "id"), found: str = "found", status: str = "status", good: Sequence[str] = ("Success", "Partial")) -> DataFrame:
    """Adds previous_found (the run before) and last_good (the latest earlier run that found something)."""
    w = Window.partitionBy(source).orderBy(*at)
    real = F.when((F.col(found) > 0) & F.col(status).isin(list(good)), F.col(found))
    return runs.withColumn("previous_found", F.lag(found).over(w)).withColumn("last_good", F.last(real, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def health(found: Column, invalid: Column, last_good: Column, judged: Column, resumed: Column | None = None, stored: Column | None = None, drop: float = 0.4) -> Column:
    """A warning about a run, or null: everything rejected, nothing after something, or a steep drop. judged: whether the run ended well; a resumed run does the rest only, so it is not held against the last one, but may have had everything rejected. stored: records that were new or merged."""
    nothing = F.lit(True) if stored is None else stored == 0
    whole = F.lit(True) if resumed is None else ~F.coalesce(resumed, F.lit(False))
    return F.when(~judged, None).when((found > 0) & nothing & (invalid >= found), "all rejected").when(whole & (found == 0) & (last_good > 0), "nothing found").when(whole & (found < last_good * drop), "steep drop")
