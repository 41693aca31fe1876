"""Keeping a store of records: entry by hand, tags, notes, registry data, keys, caches, runs and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..functions.text import blank_to_null, col
from .staging import stage

# Records


def by_hand(rows: DataFrame) -> DataFrame:
    """rows of a person's entry with name_key, dedupe_key and the source ``manual``."""
    keyed = rows.withColumn("name_key", text.company_name_key(F.coalesce("company_name", F.lit(""))))
    return keyed.withColumn("dedupe_key", identity.dedupe_key("company_name", "name_key", "tax_id", "email", "phone", "website")).withColumn("source", F.lit("manual"))


def found_by(rows: DataFrame, column: str, value: str, fold: bool = False) -> DataFrame:
    """A point lookup, trimmed, and in any case where ``fold``; an equality that reaches the scan where nothing is folded."""
    return rows.filter(F.lower(F.trim(col(column))) == value.strip().lower()) if fold else rows.filter(col(column) == value)


def renormalised(rows: DataFrame, new_keys: Column) -> DataFrame:
    """rows with dedupe_key replaced by ``new_keys`` where that key is free: no other row holds it, and of those that want it the smallest id comes first.

    rows: id, dedupe_key and more. Adds adopted.
    """
    wants = rows.withColumn("_new", F.when((new_keys != "") & ~new_keys.eqNullSafe(F.col("dedupe_key")), new_keys))
    first = wants.filter("_new is not null").groupBy("_new").agg(F.min("id").alias("_first"))
    held = rows.select(F.col("dedupe_key").alias("_new")).filter("_new is not null").distinct()
    free = first.join(held, "_new", "left_anti").select(F.col("_new").alias("_key"), "_first")
    out = wants.join(free, (F.col("_new") == F.col("_key")) & (F.col("id") == F.col("_first")), "left")
    return out.withColumn("adopted", F.col("_key").isNotNull()).withColumn("dedupe_key", F.coalesce("_key", "dedupe_key")).drop("_new", "_key", "_first")


def registered(companies: DataFrame, registry: DataFrame, now: Column, key: str = "tax_id") -> DataFrame:
    """companies with what a registry says of them.

    registry: key, status, capital, responsible, location, extra (map). Status, and a capital that is known, replace; person and address fill blanks; extra
    values replace by name. Rows that the registry has get registration_checked_at, changed or not; adds registry_changed.
    """
    r = registry.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("status", "capital", "responsible", "location", "extra")))
    both, hit = companies.join(r, F.col(key) == F.col("_k"), "left"), F.col("_k").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    fills = lambda c, new: F.when(hit & blank_to_null(c).isNull() & blank_to_null(new).isNotNull(), F.col(new)).otherwise(F.col(c))
    merged = F.map_zip_with(F.coalesce("extra_fields", empty), F.coalesce("_extra", empty), lambda k, old, new: F.coalesce(new, old))
    new = {
        "registration_status": F.when(hit, F.col("_status")).otherwise(F.col("registration_status")),
        "capital_amount": F.when(hit & (F.coalesce("_capital", F.lit(0)) > 0), F.col("_capital")).otherwise(F.col("capital_amount")),
        "contact_person": fills("contact_person", "_responsible"),
        "address": fills("address", "_location"),
        "extra_fields": F.when(hit, merged).otherwise(F.col("extra_fields")),
    }
    as_text = lambda m: F.to_json(F.array_sort(F.map_entries(F.coalesce(m, empty))))
    changed = F.lit(False)
    for c, e in new.items():
        changed = changed | (~as_text(e).eqNullSafe(as_text(F.col(c))) if c == "extra_fields" else ~e.eqNullSafe(F.col(c)))
    out = both.withColumn("registry_changed", hit & changed).withColumns({f"_n_{c}": e for c, e in new.items()})
    stamped = F.when(hit, now).otherwise(F.col("registration_checked_at")) if "registration_checked_at" in companies.columns else F.when(hit, now)
    out = out.withColumns({c: F.col(f"_n_{c}") for c in new} | {"registration_checked_at": stamped})
    return out.select(*companies.columns, *(c for c in ("registration_checked_at",) if c not in companies.columns), "registry_changed")


def matched_by_name(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, candidate columns): for each company the first registry candidate, by pos, whose name has the same key; near names never match. candidates: id of the company, pos, company_name and more."""
    key = lambda c: blank_to_null(text.company_name_key(F.coalesce(c, F.lit(""))))
    left = companies.select("id", key(F.col("company_name")).alias("_key"))
    right = candidates.withColumn("_key", key(F.col("company_name")))
    rest = [c for c in candidates.columns if c not in ("id", "pos")]
    best = left.join(right, ["id", "_key"]).groupBy("id").agg(F.min_by(F.struct(*rest), "pos").alias("b"))
    return best.select("id", *(F.col(f"b.{c}").alias(c) for c in rest))


# Children: contacts, activities, attachments, runs


def added(rows: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """rows and new ones, which get ids beyond the greatest in their own order by ``seq``; a new row's other columns go by name.

    New rows are numbered within ranges of seq; what a range starts from is the sum of those before it, of which there are as many as partitions. No task sorts all of them.
    """
    most = rows.agg(F.max(id_col)).first()[0] or 0
    ranged = stage(new.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").count()
    starts = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count") + most).alias("_start"))
    numbered = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("seq"))).join(starts, "_part").withColumn(id_col, (F.col("_start") + F.col("_nth")).cast("long"))
    return rows.unionByName(numbered.drop("_part", "_nth", "_start", "seq"), allowMissingColumns=True)


def edited(rows: DataFrame, changes: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """rows with the columns of the changes for their ids; a null of a change leaves what there is."""
    new = changes.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = rows.join(new, F.col(id_col) == F.col("_id"), "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*rows.columns)


def removed(rows: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(gone.select(F.col(id_col).alias("_id")), F.col(id_col) == F.col("_id"), "left_anti")


def contacts_of(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """contacts with company_name, primary ones of a company first, then by name in any case."""
    names = companies.select(F.col("id").alias("company_id"), "company_name")
    return contacts.join(names, "company_id").orderBy("company_id", F.desc("is_primary"), F.lower("name"), "id")


def contacts_with(contacts: DataFrame, companies: DataFrame, said: str, columns: Sequence[str]) -> DataFrame:
    """contacts_of() that hold a text in any of the columns, company_name among them, in any case."""
    from .filters import contains_text

    return contacts_of(contacts, companies).filter(contains_text(columns, said))


# Tags


def tag_set(names: DataFrame) -> DataFrame:
    """(company_id, name): a company's tags, trimmed, blanks left out, the first spelling of each. names: company_id, name, pos."""
    clean = names.select("company_id", blank_to_null("name").alias("name"), "pos").filter("name is not null")
    return clean.groupBy("company_id", F.lower("name").alias("_k")).agg(F.min_by("name", "pos").alias("name")).drop("_k")


def tag_union(links: DataFrame, moves: DataFrame) -> DataFrame:
    """(company_id, tag): links after merges; moves: (id, into). Rows without a move stay; a tag comes once."""
    m = moves.select(F.col("id").alias("company_id"), "into")
    return links.join(m, "company_id", "left").select(F.coalesce("into", "company_id").alias("company_id"), "tag").distinct()


def with_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """tags (name) and those of ``wanted`` (name, pos) that none equals in any case, the first spelling of each."""
    new = wanted.select(blank_to_null("name").alias("name"), "pos").filter("name is not null")
    new = new.join(tags.select(F.lower("name").alias("_have")), F.lower("name") == F.col("_have"), "left_anti")
    return tags.select("name").unionByName(new.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", "pos").alias("name")).select("name"))


def without_tag(tags: DataFrame, name: str) -> DataFrame:
    return tags.filter(F.lower("name") != name.strip().lower())


# Events and their notes


def stage_changes(rows: DataFrame, to: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows in their new stage, a note for each that changed). rows: id, stage; to: null where nothing changes."""
    moves = F.coalesce((to != F.col("stage")) & to.isNotNull(), F.lit(False))
    notes = rows.filter(moves).select(F.col("id").alias("company_id"), F.lit("stage").alias("kind"), F.concat_ws(" -> ", "stage", to).alias("body"), now.alias("created_at"))
    return rows.withColumn("stage", F.when(moves, to).otherwise(F.col("stage"))), notes


def bounces_applied(rows: DataFrame, bounces: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with Bounced where an address failed for good, a note for each failed address). rows: id, email, email_verdict; bounces: address, hard, reason, one for each address."""
    b = bounces.select(F.lower(F.trim("address")).alias("_a"), "hard", "reason")
    both = rows.join(b, F.lower(F.trim("email")) == F.col("_a"), "left")
    out = both.withColumn("email_verdict", F.when(F.coalesce("hard", F.lit(False)), "Bounced").otherwise(F.col("email_verdict")))
    notes = both.filter("_a is not null").select(F.col("id").alias("company_id"), F.when(F.col("hard"), "bounce").otherwise("soft bounce").alias("kind"), F.col("reason").alias("body"), now.alias("created_at"))
    return out.drop("_a", "hard", "reason"), notes


# Caches and runs


def cache_written(cache: DataFrame, new: DataFrame, key: str, when: str) -> DataFrame:
    """cache with the new rows: the latest of each key."""
    every = cache.unionByName(new)
    rest = [c for c in cache.columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), when).alias("b")).select(key, *(F.col(f"b.{c}").alias(c) for c in rest))


def cache_cleared(cache: DataFrame, when: str, before: Column | None = None) -> DataFrame:
    """cache without rows from before a time, or empty."""
    return cache.limit(0) if before is None else cache.filter(F.col(when) >= before)


def resume_cleared(runs: DataFrame, source: str | None = None) -> DataFrame:
    """runs without their markers to go on from, of one source or all."""
    of = F.lit(True) if source is None else F.col("source") == source
    return runs.withColumn("resume_marker", F.when(~of, F.col("resume_marker")))


def recent(runs: DataFrame, n: int, when: str = "started_at", tie: str = "id") -> DataFrame:
    return runs.orderBy(F.desc(when), F.desc(tie)).limit(n)


def run_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of what became of a run's records. rows: outcome, one of duplicate, invalid, known, updated, new. An updated one was in the store already and counts as duplicate too."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("found"), n("new").alias("records_new"), n("updated").alias("records_updated"), n("duplicate", "updated").alias("records_duplicate"), n("invalid").alias("records_invalid"), n("known").alias("records_skipped_known"))


def outcomes(batch: DataFrame, known: DataFrame, store: DataFrame) -> DataFrame:
    """batch (seq, dedupe_key, rejected) with outcome: duplicate of an earlier record of the batch, invalid, known, updated or new."""
    w = Window.partitionBy("dedupe_key").orderBy("seq")
    flag = lambda rows, name: rows.select(F.col("dedupe_key").alias(f"_{name}")).distinct()
    both = batch.withColumn("_nth", F.row_number().over(w)).join(flag(known, "known"), F.col("dedupe_key") == F.col("_known"), "left").join(flag(store, "store"), F.col("dedupe_key") == F.col("_store"), "left")
    out = F.when(F.col("_nth") > 1, "duplicate").when(F.col("rejected").isNotNull(), "invalid").when(F.col("_known").isNotNull(), "known").when(F.col("_store").isNotNull(), "updated").otherwise("new")
    return both.withColumn("outcome", out).drop("_nth", "_known", "_store")


def verdict_histogram(rows: DataFrame, verdicts: Sequence[str], column: str = "email_verdict") -> DataFrame:
    """(verdict, n) of each verdict, 0 included."""
    names = rows.sparkSession.createDataFrame([(v,) for v in verdicts], "verdict string")
    n = rows.groupBy(F.col(column).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "verdict", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def samples(rows: DataFrame, fields: Sequence[str], seq: str, n: int = 3, longest: int = 60) -> DataFrame:
    """(field, nth, value): the first n non-blank values of each field, cut to ``longest`` characters. A top-n for each field, combined before the shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.substring(F.trim(F.col(f).cast("string")), 1, longest).alias("value")) for f in fields)))
    long = rows.select(F.col(seq).alias("_seq"), pairs.alias("x")).select("_seq", "x.*").filter("value <> ''")
    return long.withColumn("nth", F.row_number().over(Window.partitionBy("field").orderBy("_seq"))).filter(F.col("nth") <= n).select("field", "nth", "value")


def document_links(links: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(page_id, kind, n): distinct addresses of documents by kind. kinds: by suffix."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace("href", r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return links.select("page_id", "href", F.try_element_at(table, suffix).alias("kind")).filter("kind is not null").groupBy("page_id", "kind").agg(F.count_distinct("href").alias("n"))


def within_batch(rows: DataFrame, sendable: Column, order: Sequence[Column], most: int, id_col: str = "id") -> DataFrame:
    """rows with skip_reason BATCH_CAP for the sendable ones after the first ``most``: a run's own cap beside the daily one."""
    from .windows import with_quota

    capped = with_quota(rows, sendable, order, most, id_col)
    return capped.withColumn("skip_reason", F.when(sendable & ~F.col("in_quota"), "BATCH_CAP").otherwise(F.col("skip_reason"))).drop("in_quota")
