"""Filling what companies lack from the registry, search hits and their own sites, stage by stage; and small upkeep of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, validate
from ..functions.text import blank_to_null
from . import research, upkeep


def registry_outcomes(companies: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """companies with what the registry says of their numbers, and outcome.

    no_number: without a valid number, never asked. not_asked, busy: nothing is learned and no time is noted. not_found, matched and defunct (not active any more) note the time,
    so that the next run asks for others. answers: tax_id, body; of several for a number the first row that has one counts.
    """
    rows = research.registry_rows(answers.select(F.col("tax_id").alias("asked"), "body"), "body")
    one = rows.groupBy("asked").agg(F.min_by(F.struct("status", "capital", "responsible", "location", "extra", "active"), "pos").alias("r")).select("asked", "r.*")
    # Any answer that says something outranks a busy one.
    states = answers.select(F.col("tax_id").alias("asked"), research.registry_state("body").alias("state")).groupBy("asked").agg(F.max("state").alias("state"))
    number = F.when(validate.is_tax_id("tax_id"), F.trim("tax_id"))
    known = upkeep.registered(companies.withColumn("_number", number), one.withColumnRenamed("asked", "_number"), now, "_number")
    said = known.join(states.join(one.select("asked", "active"), "asked", "left"), F.col("_number") == F.col("asked"), "left")
    outcome = F.when(F.col("_number").isNull(), "no_number").when(F.col("state").isNull(), "not_asked").when(F.col("state") == "busy", "busy").when(F.col("active").isNull(), "not_found").when(F.col("active"), "matched").otherwise("defunct")
    stamped = F.when(outcome == "not_found", now).otherwise(F.col("registration_checked_at"))
    return said.withColumn("outcome", outcome).withColumn("registration_checked_at", stamped).drop("_number", "asked", "state", "active")


def completed(companies: DataFrame, stages: Sequence[DataFrame], fields: Sequence[str], now: Column, deferred: Column | None = None, overwrite: bool = False) -> DataFrame:
    """companies with blank fields filled by the stages in turn, the first that has a value; with overwrite every stage replaces.

    stages: id and some of the fields, one row for each id. Adds filled: the fields that were blank and are not, by stage (from 0). Rows get completion_checked_at, filled or not,
    unless they are deferred (a source was busy or exhausted, so they have not had their turn).
    """
    out = companies.withColumn("filled", F.create_map().cast("map<string,int>"))
    for k, stage in enumerate(stages):
        has = [f for f in fields if f in stage.columns]
        side = stage.select(F.col("id").alias("_id"), *(blank_to_null(f).alias(f"_{f}") for f in has))
        both = out.join(side, F.col("id") == F.col("_id"), "left")
        fills = {f: blank_to_null(f).isNull() & F.col(f"_{f}").isNotNull() for f in has}
        pairs = F.filter(F.array(*(F.when(fills[f], F.struct(F.lit(f).alias("key"), F.lit(k).alias("value"))) for f in has)), lambda p: p.isNotNull())
        new = {f: F.when(fills[f] | (F.lit(overwrite) & F.col(f"_{f}").isNotNull()), F.col(f"_{f}")).otherwise(F.col(f)) for f in has}
        out = both.select(*(new.get(c, F.col(c)).alias(c) for c in companies.columns), F.map_concat("filled", F.map_from_entries(pairs)).alias("filled"))
    due = F.coalesce(deferred, F.lit(False)) if deferred is not None else F.lit(False)
    before = F.col("completion_checked_at") if "completion_checked_at" in companies.columns else F.lit(None).cast("timestamp_ntz")
    return out.withColumn("completion_checked_at", F.when(due, before).otherwise(now))


def search_query(name: Column | str) -> Column:
    return F.concat(text.col(name), F.lit(" 官網"))


def unwrapped(href: Column | str, host: str = "duckduckgo.com", parameter: str = "uddg") -> Column:
    """The address behind a search engine's own link, which holds it as a parameter; other links of the engine's are advertisements and null, as is what is no web address."""
    raw = F.trim(F.coalesce(text.col(href), F.lit("")))
    url = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    netloc = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1))
    target = F.try_url_decode(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1))
    return F.when(netloc.endswith(host), F.nullif(target, F.lit(""))).when(netloc != "", url)


#: Words of a page that a search engine shows instead of results to those who ask too often.
BLOCKED_WORDS = ["anomaly", "unusual traffic", "detected unusual", "blocked"]


def is_throttled(html: Column | str) -> Column:
    return F.coalesce(F.lower(text.col(html)).rlike("|".join(BLOCKED_WORDS)), F.lit(False))


def search_hits(links: DataFrame, most: int = 10) -> DataFrame:
    """(company_id, pos, url): the first ``most`` different targets of result links, in order. links: company_id, pos, href."""
    first = links.withColumn("url", unwrapped("href")).filter("url is not null").groupBy("company_id", "url").agg(F.min("pos").alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("company_id").orderBy("at"))).filter(F.col("pos") <= most).select("company_id", "pos", "url")


# Files


def unique_names(new: DataFrame, have: DataFrame) -> DataFrame:
    """new (seq, name) with stored: the name, or where it is taken the name with the smallest free number from (2) on, in order of seq. have: name."""
    stem = lambda c: F.regexp_extract(c, r"^(.+?)(\.[^.]*)?$", 1)
    suffix = lambda c: F.regexp_extract(c, r"^(.+?)(\.[^.]*)?$", 2)
    asked = new.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("seq")))
    # A numbered name counts against the name without its number.
    base = F.concat(F.regexp_replace(stem("name"), r" \([0-9]+\)$", ""), suffix("name"))
    taken = have.select("name").distinct().select(F.explode(F.array_distinct(F.array("name", base))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_taken"))
    wanted = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(taken, "name", "left")
    tries = wanted.select("name", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("n_taken", F.lit(0)))).alias("k"))
    offered = tries.withColumn("stored", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(stem("name"), F.lit(" ("), F.col("k").cast("string"), F.lit(")"), suffix("name"))))
    free = offered.join(have.select(F.col("name").alias("stored")).distinct(), "stored", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("k")))
    return asked.join(free.select("name", "nth", "stored"), ["name", "nth"]).select("seq", "name", "stored")


def marked_used(files: DataFrame, sent: DataFrame) -> DataFrame:
    """files (filename, use_count, last_used_at) after they were sent; sent: filename, at."""
    uses = sent.groupBy(F.col("filename").alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    both = files.join(uses, F.col("filename") == F.col("_f"), "left")
    return both.withColumns({"use_count": F.col("use_count") + F.coalesce("_n", F.lit(0)), "last_used_at": F.coalesce(F.greatest("_at", "last_used_at"), "last_used_at")}).drop("_f", "_n", "_at")
