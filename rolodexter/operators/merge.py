"""Merging records: within a batch, among stored rows, and a batch into a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def _first_filled(c: str, seq: str) -> Column:
    """The value of the first row, by seq, that is not blank."""
    return F.min_by(c, F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col(seq)))


def merged(rows: DataFrame, key: str, seq: str, fill: Sequence[str], keep: Sequence[str], flags: Sequence[str] = (), latest: Sequence[str] = (), totals: Sequence[str] = ()) -> DataFrame:
    """One row for each key, null and empty keys left out. fill: first non-blank value; keep: the first row's; flags: true once true anywhere
    (a mark not to contact survives every merge); latest: the largest; totals: the sum. Adds n_merged."""
    kept = [F.min_by(c, seq).alias(c) for c in keep] + [_first_filled(c, seq).alias(c) for c in fill]
    kept += [F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in flags] + [F.max(c).alias(c) for c in latest] + [F.sum(c).alias(c) for c in totals]
    return rows.filter(blank_to_null(F.col(key).cast("string")).isNotNull()).groupBy(key).agg(*kept, F.count(F.lit(1)).alias("n_merged"))


def maps_filled(old: Column | str, new: Column | str) -> Column:
    """Two maps of strings: the old value unless it is blank."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old if isinstance(old, Column) else F.col(old), empty), F.coalesce(new if isinstance(new, Column) else F.col(new), empty), lambda k, o, n: F.coalesce(blank_to_null(o), n))


def upsert(store: DataFrame, batch: DataFrame, key: str, fill: Sequence[str], overwrite: Sequence[str] = ()) -> DataFrame:
    """The store after a batch with one row for each key: new keys are inserted, blanks of old ones filled, ``overwrite`` columns taken from the batch if it has them. Adds action: insert, fill or keep."""
    s, b = store.alias("s"), batch.alias("b")
    both = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    text = lambda side, c: blank_to_null(F.col(f"{side}.{c}").cast("string"))
    pick = {c: F.when(text("s", c).isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")) for c in fill}
    pick |= {c: F.when(text("b", c).isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")) for c in overwrite}
    fills = F.lit(False)
    for c in fill:
        fills = fills | (text("s", c).isNull() & text("b", c).isNotNull())
    action = F.when(F.col(f"s.{key}").isNull(), "insert").when(F.col(f"b.{key}").isNotNull() & fills, "fill").otherwise("keep")
    rest = [F.coalesce(F.col(f"s.{c}"), F.col(f"b.{c}")) if c in batch.columns else F.col(f"s.{c}") for c in store.columns if c != key and c not in pick]
    names = [c for c in store.columns if c != key and c not in pick]
    return both.select(F.coalesce(f"s.{key}", f"b.{key}").alias(key), *(e.alias(c) for e, c in zip(rest, names, strict=True)), *(e.alias(c) for c, e in pick.items()), action.alias("action"))


def adopted_verdict(old_mail: Column, old_verdict: Column, new_mail: Column, new_verdict: Column) -> Column:
    """A verdict counts for the address that is held only, never replaces a bounce, and says something: Unknown replaces nothing."""
    says = F.coalesce(new_verdict != "Unknown", F.lit(False)) & ~old_verdict.eqNullSafe(F.lit("Bounced")) & (F.lower(old_mail) == F.lower(new_mail))
    return F.when(says, new_verdict).otherwise(old_verdict)


def edited_verdict(old_mail: Column, new_mail: Column, verdict: Column) -> Column:
    return F.when(F.lower(old_mail).eqNullSafe(F.lower(new_mail)), verdict).otherwise("Unknown")


def promoted_contacts(companies: DataFrame, contacts: DataFrame, company: str = "company_id", person: str = "contact_person") -> DataFrame:
    """(company_id, name, is_primary): contact persons that are no contact yet; primary if the company has none."""
    new = companies.select(F.col("id").alias(company), blank_to_null(person).alias("name")).filter("name is not null")
    have = contacts.select(F.col(company), F.trim("name").alias("name"))
    any_ = have.select(F.col(company).alias("_c")).distinct()
    return new.join(have, [company, "name"], "left_anti").join(any_, F.col(company) == F.col("_c"), "left").select(company, "name", F.col("_c").isNull().alias("is_primary"))


def without(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, id_col: str = "id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """parents and their children after a cascading delete of the ids in ``gone``."""
    ids = gone.select(F.col(id_col).alias("_gone"))
    left = parents.join(ids, F.col(id_col) == F.col("_gone"), "left_anti")
    return left, {name: rows.join(ids, F.col(fk) == F.col("_gone"), "left_anti") for name, (rows, fk) in children.items()}


STAGES = ["New", "Contacted", "Replied", "Negotiating", "Won"]


def advanced(stage: Column, to: str, stages: Sequence[str] = STAGES) -> Column:
    """The stage after an event that leads to ``to``: forward only, and only from a stage of the list."""
    at = F.array_position(F.array(*map(F.lit, stages)), stage)
    return F.when((at > 0) & (at <= list(stages).index(to)), F.lit(to)).otherwise(stage)
