"""Matching rows of two tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def not_known(rows: DataFrame, known: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows without any equal key among the known ones. keys: for each column of ``known`` the row's key, null where it may not match. One anti join for each key; Spark broadcasts sides under its own size limit."""
    for c, value in keys.items():
        side = known.select(F.col(c).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
        rows = rows.withColumn("_mine", value).join(side, F.col("_mine") == F.col("_key"), "left_anti").drop("_mine")
    return rows


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """parents with a row for each child, numbered from 1 in order; nth is null for a parent without any. Rows, not lists: a parent may have any number of children."""
    w = Window.partitionBy(child_key).orderBy(*order)
    numbered = children.select(F.col(child_key).alias("_key"), *columns, F.row_number().over(w).alias("nth"))
    return parents.join(numbered, F.col(key) == F.col("_key"), "left").drop("_key")


#: Characters of the keys by which a part is looked for in a whole: of parts as long, and of shorter ones.
LONG_PART, SHORT_PART = 8, 3


@dataclass(frozen=True)
class Within:
    """A key of first_match(): the row's ``part`` occurs in the target's ``whole``, in any case, where all columns of ``equal`` (row column, target column) agree."""

    part: str
    whole: str
    equal: tuple[tuple[str, str], ...] = ()


def part_matches(rows: DataFrame, targets: DataFrame, key: Within, row_id: str, target_id: str) -> DataFrame:
    """(row_id, target_id): for each row the smallest target whose whole holds its part.

    Distinct parts meet distinct wholes, not rows: by the equal columns and the first LONG_PART characters of a part, which are one of the substrings of that length of a whole; parts that are shorter go by
    SHORT_PART characters, parts shorter than that by themselves. Then the whole is looked at. All joins are on equal keys.
    """
    names = [f"_e{i}" for i in range(len(key.equal))]
    text = lambda c: blank_to_null(F.col(c).cast("string"))
    mine = rows.select(F.col(row_id).alias("row_id"), F.lower(text(key.part)).alias("_part"), *(text(m).alias(n) for (m, _), n in zip(key.equal, names, strict=True)))
    mine = mine.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ["_part", *names])))
    theirs = targets.select(F.col(target_id).alias("target_id"), F.lower(text(key.whole)).alias("_whole"), *(text(t).alias(n) for (_, t), n in zip(key.equal, names, strict=True)))
    theirs = theirs.filter(F.col("_whole").isNotNull()).groupBy("_whole", *names).agg(F.min("target_id").alias("target_id"))
    size = F.when(F.length("_part") >= LONG_PART, LONG_PART).when(F.length("_part") >= SHORT_PART, SHORT_PART).otherwise(F.length("_part"))
    parts = mine.select("_part", *names).distinct().withColumn("_key", F.substring(F.col("_part"), F.lit(1), size))
    grams = lambda n: F.when(F.length("_whole") >= n, F.transform(F.sequence(F.lit(1), F.length("_whole") - n + 1), lambda i: F.substring(F.col("_whole"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    lengths = [LONG_PART, *range(1, SHORT_PART + 1)]
    wholes = theirs.select("target_id", "_whole", *names, F.explode(F.array_distinct(F.concat(*map(grams, lengths)))).alias("_key"))
    found = parts.join(wholes, ["_key", *names]).filter(F.contains("_whole", F.col("_part"))).groupBy("_part", *names).agg(F.min("target_id").alias("target_id"))
    return mine.join(found, ["_part", *names]).select("row_id", "target_id")


def first_match(rows: DataFrame, targets: DataFrame, keys: Sequence[tuple[str, str] | Within], row_id: str = "id", target_id: str = "id") -> DataFrame:
    """(row_id, target_id, rank): for each row the target of its strongest key. keys: (row column, target column), or Within for what occurs in a column, the strongest first; blanks never match; the smallest target id wins ties."""
    edges = []
    for rank, key in enumerate(keys):
        if isinstance(key, Within):
            edges.append(part_matches(rows, targets, key, row_id, target_id).withColumn("rank", F.lit(rank)))
            continue
        mine, theirs = key
        left = rows.select(F.col(row_id).alias("row_id"), blank_to_null(F.col(mine).cast("string")).alias("_k")).filter("_k is not null")
        right = targets.select(F.col(target_id).alias("target_id"), blank_to_null(F.col(theirs).cast("string")).alias("_k")).groupBy("_k").agg(F.min("target_id").alias("target_id"))
        edges.append(left.join(right, "_k").select("row_id", "target_id", F.lit(rank).alias("rank")))
    best = reduce(DataFrame.unionByName, edges).groupBy("row_id").agg(F.min(F.struct("rank", "target_id")).alias("b"))
    return best.select("row_id", "b.target_id", "b.rank")


def with_cache(rows: DataFrame, cache: DataFrame, key: str, cache_key: str, value: str, checked: str, fresh: Column) -> DataFrame:
    """rows with the cached value, null where it is missing or too old, and ``cache_hit``."""
    side = cache.filter(fresh).select(F.col(cache_key).alias("_key"), F.col(value), F.col(checked))
    return rows.join(side, F.col(key) == F.col("_key"), "left").withColumn("cache_hit", F.col("_key").isNotNull()).drop("_key")


def by_ordinal(items: DataFrame, labels: DataFrame, item_nr: str, label_nr: str, label: str, default: str) -> DataFrame:
    """items with the first label for their number; the default without one."""
    first = labels.groupBy(F.col(label_nr).alias("_nr")).agg(F.min_by(label, "seq").alias(label))
    return items.join(first, F.col(item_nr) == F.col("_nr"), "left").drop("_nr").withColumn(label, F.coalesce(label, F.lit(default)))


#: Kinds of candidates in the order in which they are shown.
CANDIDATE_ORDER = {"directory": 0, "company": 1, "unjudged": 2, "unrelated": 3}


def labelled_hits(hits: DataFrame, labels: DataFrame, query: str = "query_id", nr: str = "nr", kind: str = "kind", reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(hits with kind, reason and place; (query, ignored)): a model's labels put on search hits by their numbers.

    Of labels for one number the first by seq counts; these others, numbers that no hit of the query has, and labels without a number are ignored and counted. Hits without a label are ``unjudged``. place: within a query, directories first, then companies,
    unjudged ones, unrelated ones, each in the order of the hits.
    """
    first = labels.filter(F.col(nr).isNotNull()).groupBy(F.col(query).alias("_q"), F.col(nr).alias("_nr")).agg(F.min_by(F.struct(F.col(kind).alias("kind"), F.col(reason).alias("reason")), "seq").alias("l"))
    both = hits.drop("kind", "reason").join(first, (F.col(query) == F.col("_q")) & (F.col(nr) == F.col("_nr")), "left")
    known = F.lower(F.trim("l.kind"))
    of = F.when(known.isin(list(CANDIDATE_ORDER)), known).otherwise("unjudged")
    out = both.withColumns({"kind": F.coalesce(of, F.lit("unjudged")), "reason": F.coalesce("l.reason", F.lit(""))}).drop("_q", "_nr", "l")
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in CANDIDATE_ORDER.items() for x in kv)), F.col("kind"))
    placed = out.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(rank, nr)))
    met = hits.select(F.col(query).alias("_q"), F.col(nr).alias("_nr")).distinct()
    said = labels.groupBy(query).agg(F.count(F.lit(1)).alias("said"))
    used = first.select("_q", "_nr").join(met, ["_q", "_nr"], "left_semi").groupBy("_q").agg(F.count(F.lit(1)).alias("used"))
    counts = said.join(used, F.col(query) == F.col("_q"), "left").select(query, (F.col("said") - F.coalesce("used", F.lit(0))).alias("ignored"))
    return placed, counts


def under_domains(rows: DataFrame, domain: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose domain is listed or lies below a listed one, by an equi join on all its suffixes: for lists of any length."""
    parts = F.split(F.lower(F.col(domain)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hits = rows.select(F.col(domain), F.explode(suffixes).alias("_suffix")).distinct()
    found = hits.join(names.select(F.lower(F.col(name)).alias("_suffix")), "_suffix", "left_semi").select(F.col(domain).alias("_domain")).distinct()
    return rows.join(found, F.col(domain) == F.col("_domain"), "left_semi")


def reconcile(files: DataFrame, index: DataFrame, key: str, size: str) -> DataFrame:
    """Full outer: ``action`` is adopt (only a file), refresh (other size), keep, or missing (only in the index, which is never deleted from)."""
    f = files.select(F.col(key), F.col(size).alias("file_size"))
    i = index.select(F.col(key), F.col(size).alias("index_size"))
    action = F.when(F.col("index_size").isNull(), "adopt").when(F.col("file_size").isNull(), "missing").when(F.col("file_size") != F.col("index_size"), "refresh").otherwise("keep")
    return f.join(i, key, "full_outer").withColumn("action", action).withColumn("size", F.coalesce("file_size", "index_size"))


def with_details(rows: DataFrame, details: DataFrame, url: str, columns: Sequence[str], order: str = "seq", most: int | None = None) -> DataFrame:
    """rows with blanks of the columns filled from the detail pages at their address: of each column the first value by ``order`` that is not blank. most: of an address only its first so many pages count."""
    if most is not None:
        details = details.withColumn("_place", F.row_number().over(Window.partitionBy(url).orderBy(order))).filter(F.col("_place") <= most)
    side = details.groupBy(F.col(url).alias("_url")).agg(*(F.min_by(c, F.when(blank_to_null(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns))
    both = rows.join(side, F.col(url) == F.col("_url"), "left")
    return both.withColumns({c: first_non_blank(c, f"_{c}") for c in columns}).select(*rows.columns)


def first_non_blank(*columns: Column | str) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))
