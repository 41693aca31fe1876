"""Counts, groups and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def counted(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of conditional counts, in one pass."""
    return rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))


def count_by(rows: DataFrame, key: Column | str, name: str, unknown: str | None = None, top: int | None = None) -> DataFrame:
    """Rows of each key; blank keys under ``unknown``. With top: the most frequent, ties by key."""
    value = blank_to_null(key) if unknown is not None else F.col(key) if isinstance(key, str) else key
    out = rows.groupBy((F.coalesce(value, F.lit(unknown)) if unknown is not None else value).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), F.asc(name)).limit(top)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(blank_to_null(column).alias(column)).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def usage(names: DataFrame, links: DataFrame, name: str, link: str) -> DataFrame:
    """How many links each name has, 0 included."""
    n = links.groupBy(F.col(link).alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    return names.join(n, F.col(name) == F.col("_name"), "left").select(name, F.coalesce("_n", F.lit(0)).alias("n"))


def duplicate_groups(rows: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """(kind, value, n, id): the members of the groups of two or more rows with an equal non-blank value of a key; groups of the same rows once, by the first kind.

    Groups are compared by count, least and greatest id and two sums of hashes over their ids: no group is gathered, however large.
    """
    long = reduce(DataFrame.unionByName, (rows.select(F.lit(i).alias("nr"), F.lit(k).alias("kind"), blank_to_null(F.col(k).cast("string")).alias("value"), F.col(id_col).alias("id")) for i, k in enumerate(keys)))
    members = long.filter("value is not null").distinct()
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)"))
    groups = members.groupBy("nr", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), wide(1).alias("one"), wide(2).alias("two")).filter("n > 1")
    first = groups.groupBy("n", "least", "most", "one", "two").agg(F.min(F.struct("nr", "kind", "value")).alias("g")).select("g.kind", "g.value", "n")
    return members.select("kind", "value", "id").join(first, ["kind", "value"]).select("kind", "value", "n", "id")


def surplus(groups: DataFrame) -> DataFrame:
    """How many rows all groups have beyond one each; groups: of duplicate_groups()."""
    return groups.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def frequent_keys(rows: DataFrame, maps: str, top: int = 20) -> DataFrame:
    """(key, n): the keys of a map column, most frequent first, then by name."""
    return rows.select(F.explode(F.map_keys(maps)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)


def census(rows: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """(column, sealed, plain): how many values of each column start with a prefix."""
    one = rows.agg(*(F.struct(F.count_if(F.col(c).startswith(prefix)).alias("sealed"), F.count_if((F.col(c) != "") & ~F.col(c).startswith(prefix)).alias("plain")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c + ".sealed").alias("sealed"), F.col(c + ".plain").alias("plain")) for c in columns))).alias("x")).select("x.*")


def share(condition: Column) -> Column:
    """The share of rows with the condition, as an aggregate; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def kept_if_a_directory(rows: DataFrame, source: str, marker: Column, least_rows: int = 4, least_share: float = 0.4) -> DataFrame:
    """Drops whole sources that look like no directory: enough rows, and too few names with a marker."""
    per = rows.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_n"), share(marker).alias("_share"))
    good = per.filter((F.col("_n") < least_rows) | (F.col("_share") >= least_share))
    return rows.join(good, F.col(source).eqNullSafe(F.col("_source")), "left_semi")


def filled_counts(before: DataFrame, after: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """(field, filled): how many blanks of each column were filled."""
    old = before.select(F.col(id_col).alias("_id"), *(blank_to_null(F.col(c).cast("string")).alias(f"_{c}") for c in columns))
    both = after.join(old, F.col(id_col) == F.col("_id"))
    one = both.agg(*(F.count_if(F.col(f"_{c}").isNull() & blank_to_null(F.col(c).cast("string")).isNotNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns))).alias("x")).select("x.*")
