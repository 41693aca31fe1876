"""Declarative filters, ordering and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def contains_text(columns: Sequence[str], text: str) -> Column:
    """Whether any of the columns holds the text, whatever the case; the text is literal."""
    return reduce(Column.__or__, (F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in columns))


def present(c: str) -> Column:
    return blank_to_null(F.col(c).cast("string")).isNotNull()


@dataclass
class Search:
    """What rows to find. Parts that are empty or None do not restrict; the others are combined by AND.

    text: in any of text_columns. contains, among, presence: by column. between: by column (first, last), both included, either
    None. due: by column the latest date. tags: any of them, through ``tag_links``.
    """

    text: str = ""
    text_columns: Sequence[str] = ()
    contains: dict[str, str] = field(default_factory=dict)
    among: dict[str, Sequence] = field(default_factory=dict)
    presence: dict[str, bool] = field(default_factory=dict)
    between: dict[str, tuple] = field(default_factory=dict)
    due: dict[str, object] = field(default_factory=dict)
    tags: Sequence[str] = ()
    order_by: str = ""
    descending: bool = False
    offset: int = 0
    limit: int | None = None

    def is_empty(self) -> bool:
        """Whether it finds every row; order and paging don't count."""
        return not any(getattr(self, f.name) for f in fields(self) if f.name not in ("order_by", "descending", "offset", "limit", "text_columns"))

    def predicate(self) -> Column:
        parts = [F.lit(True)]
        if self.text.strip():
            parts.append(contains_text(self.text_columns, self.text.strip()))
        parts += [contains_text([c], v) for c, v in self.contains.items() if v]
        parts += [F.col(c).isin(list(v)) for c, v in self.among.items() if v]
        parts += [present(c) == F.lit(v) for c, v in self.presence.items() if v is not None]
        for c, (first, last) in self.between.items():
            parts += [F.col(c) >= F.lit(first)] * (first is not None) + [F.col(c) <= F.lit(last)] * (last is not None)
        parts += [F.col(c).isNotNull() & (F.col(c) <= F.lit(v)) for c, v in self.due.items() if v is not None]
        return reduce(Column.__and__, parts)


def tagged(rows: DataFrame, links: DataFrame, names: Sequence[str], id_col: str, link_id: str, tag_col: str) -> DataFrame:
    """Rows with any of the tags, each once: a semi join."""
    wanted = links.filter(F.col(tag_col).isin(list(names))).select(F.col(link_id).alias("_tagged"))
    return rows.join(wanted, F.col(id_col) == F.col("_tagged"), "left_semi")


def ordered(rows: DataFrame, by: str, descending: bool = False, sortable: Sequence[str] = (), default: str = "", tie: str = "id", blanks_last: bool = False) -> DataFrame:
    """Ordered by a column of a whitelist, else the default. Blanks are last, and first in descending order unless blanks_last; ids break ties."""
    by = by if by in sortable else default
    blank, value = F.coalesce(~present(by), F.lit(True)), F.col(by)
    if dict(rows.dtypes)[by] == "string":
        value = F.when(~blank, F.lower(value))  # all blanks are equal
    return rows.orderBy(blank.desc() if descending and not blanks_last else blank.asc(), value.desc() if descending else value.asc(), F.col(tie).asc())


def page(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def narrowed(rows: DataFrame, what: Search, tie: str, tag_links: tuple[DataFrame, str, str] | None) -> DataFrame:
    """rows that have one of the tags asked for, if any is. tag_links: (table, its id column, its tag column)."""
    if not what.tags:
        return rows
    if tag_links is None:
        raise ValueError("a search for tags needs the table of tag links")
    return tagged(rows, tag_links[0], what.tags, tie, tag_links[1], tag_links[2])


#: Named orders: column and whether descending.
PRESETS = {"score": ("lead_score", True), "newest": ("updated_at", True), "added": ("created_at", True), "name": ("company_name", False), "due": ("follow_up_date", False)}


def search(rows: DataFrame, what: Search, sortable: Sequence[str], default: str, tie: str = "id", tag_links: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    rows = narrowed(rows, what, tie, tag_links)
    return page(ordered(rows.filter(what.predicate()), what.order_by, what.descending, sortable, default, tie), what.offset, what.limit)


def day(c: str, date: str) -> Column:
    """A half-open window of one day."""
    start = F.lit(date).cast("timestamp_ntz")
    return (F.col(c) >= start) & (F.col(c) < start + F.expr("INTERVAL 1 DAY"))


def enrichable(site: str, mail: str) -> Column:
    return present(site) & ~present(mail)


def registrable(tax: str, checked: str, now: Column, days: int = 180) -> Column:
    return present(tax) & (F.col(checked).isNull() | (F.col(checked) <= now - F.make_dt_interval(days=F.lit(days))))


def completable(columns: Sequence[str]) -> Column:
    """Whether any of the columns is blank."""
    return F.exists(F.array(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)), lambda x: x == "")


def only(rows: DataFrame, keep: Sequence[str], always: Sequence[str]) -> DataFrame:
    """Columns that were not asked for are nulled."""
    return rows.select(*(F.col(c) if c in keep or c in always else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))


def filled(rows: DataFrame, column: str, default: str) -> DataFrame:
    return rows.withColumn(column, F.coalesce(blank_to_null(column), F.lit(default)))


def label(c: str, labels: dict[str, str], dash: str = "-") -> Column:
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.col(c)), blank_to_null(c), F.lit(dash))


def union_of_searches(searches: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Rows that any search finds, each once, by the first search that has it; adds ``found_by``."""
    every = reduce(DataFrame.unionByName, (s.withColumn("found_by", F.lit(k)) for k, s in enumerate(searches)))
    return every.groupBy(id_col).agg(*(F.min_by(c, "found_by").alias(c) for c in every.columns if c not in (id_col, "found_by")), F.min("found_by").alias("found_by"))


def resume_queue(rows: DataFrame, checked: str, tie: str = "id", limit: int | None = None) -> DataFrame:
    """Never tried first, then the longest ago."""
    return page(rows.orderBy(F.col(checked).asc_nulls_first(), F.col(tie).asc()), 0, limit)
