"""Companies folded into others with all that hangs on them, names of sources, what is left to complete, and contacts of own sites."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, validate
from ..functions.text import blank_to_null
from ..sources import pages
from . import filters, research
from .connected import _flat
from .merge import maps_filled

FILL = ["tax_id", "email", "phone", "website", "address", "industry", "english_name", "fax", "products", "contact_person", "remark"]


def folded(companies: DataFrame, merges: DataFrame, links: DataFrame | None = None, children: dict[str, DataFrame] | None = None, fill: Sequence[str] = FILL, extra: str | None = "extra", flags: Sequence[str] = (), now: Column | None = None, company: str = "company_id", tag: str = "tag") -> tuple[DataFrame, DataFrame | None, dict[str, DataFrame]]:
    """(companies, links, children) after merges (keep, drop, seq): each dropped company goes into the one that is kept.

    Blank fields take the first value that is not blank, in the order of seq; maps are filled key by key; a flag that is set anywhere stays set; tags are moved, each once; rows of child tables
    follow by their company column. One company may be dropped once (the first merge counts) and may be kept elsewhere before: chains lead to the last one that is kept. Merges with companies that do not exist, or with themselves, are none.
    Aggregates and joins on ids only, so that any number may go into one.
    """
    ids = companies.select("id")
    real = merges.filter("keep <> drop").join(ids.withColumnRenamed("id", "drop"), "drop", "left_semi").join(ids.withColumnRenamed("id", "keep"), "keep", "left_semi")
    first = real.groupBy("drop").agg(F.min_by(F.struct("keep", "seq"), "seq").alias("m")).select("drop", "m.keep", "m.seq")
    ends = first.select(F.col("drop").alias("x"), F.col("keep").alias("p")).unionByName(first.select(F.col("keep").alias("x"), F.col("keep").alias("p")).distinct().join(first.select(F.col("drop").alias("x")), "x", "left_anti"))
    target = _flat(ends).filter("x <> p").select(F.col("x").alias("_id"), F.col("p").alias("_to"))
    order = first.select(F.col("drop").alias("_drop"), F.col("seq").alias("_seq"))
    gone = companies.join(target, F.col("id") == F.col("_id")).join(order, F.col("id") == F.col("_drop"))
    given = lambda c: F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col("_seq"))
    side = gone.groupBy("_to").agg(*(F.min_by(c, given(c)).alias(f"_{c}") for c in fill), *(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{c}") for c in flags), F.count(F.lit(1)).alias("_n"))
    out = companies.join(target.select("_id"), F.col("id") == F.col("_id"), "left_anti").join(side, F.col("id") == F.col("_to"), "left")
    new = {c: F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")) for c in fill}
    new |= {c: F.coalesce(c, F.lit(False)) | F.coalesce(f"_{c}", F.lit(False)) for c in flags}
    if extra:
        entries = gone.select("_to", "_seq", F.explode(extra).alias("k", "v")).filter(F.trim("v") != "").groupBy("_to", "k").agg(F.min_by("v", "_seq").alias("v"))
        maps = entries.groupBy(F.col("_to").alias("_map_of")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_map"))
        out = out.join(maps, F.col("id") == F.col("_map_of"), "left")
        new[extra] = F.when(F.col("_map").isNull(), F.col(extra)).otherwise(maps_filled(extra, "_map"))
    if now is not None:
        new["updated_at"] = F.when(F.col("_n").isNotNull(), now).otherwise(F.col("updated_at"))
    out = out.select(*(new.get(c, F.col(c)).alias(c) for c in companies.columns))

    def moved(rows: DataFrame) -> DataFrame:
        return rows.join(target, F.col(company) == F.col("_id"), "left").withColumn(company, F.coalesce("_to", company)).select(*rows.columns)

    tags = moved(links).dropDuplicates([company, tag]) if links is not None else None
    return out, tags, {name: moved(rows) for name, rows in (children or {}).items()}


def source_names(new: DataFrame, have: DataFrame) -> DataFrame:
    """new (seq, url) with name: host and last part of the path, with the smallest free number from -2 on where it is taken by a name in ``have`` or by an earlier row.

    Names of one host are given in order of seq, hosts in parallel: a list of sources has few of one host.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.startswith("."))
    tail = F.regexp_replace(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")), r"\.[^.]*$", "")
    base = new.withColumn("_host", F.when(host == "", "custom_source").otherwise(host)).withColumn("_base", F.when(tail != "", F.concat("_host", F.lit("-"), tail)).otherwise(F.col("_host")))
    # A name that is taken matters to the hosts that it begins with.
    hosts = base.select("_host").distinct()
    taken = have.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "-"))), lambda k: F.array_join(F.slice(F.split("name", "-"), F.lit(1), k), "-"))).alias("_host")).join(hosts, "_host", "left_semi")

    def named(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        used, out = set(held["name"]), []
        for base in (rows := rows.sort_values("seq"))["_base"]:
            name, k = base, 2
            while name in used:
                name, k = f"{base}-{k}", k + 1
            used.add(name)
            out.append(name)
        return rows[["seq", "url"]].assign(name=out)

    return base.groupBy("_host").cogroup(taken.groupBy("_host")).applyInPandas(named, "seq long, url string, name string")


def completion_queue(companies: DataFrame, fields: Sequence[str], now: Column, again_days: int = 30, limit: int | None = None) -> DataFrame:
    """The companies whose turn it is to be completed: any of the fields blank, never tried or not within again_days; never tried first, then the longest ago, then by id."""
    due = F.col("completion_checked_at").isNull() | (F.col("completion_checked_at") <= now - F.make_dt_interval(days=F.lit(again_days)))
    return filters.resume_queue(companies.filter(filters.completable(fields) & due), "completion_checked_at", limit=limit)


def completion_counts(companies: DataFrame, fields: Sequence[str], now: Column, again_days: int = 30) -> DataFrame:
    """One row: incomplete companies, of these never tried, due and waiting, and how many lack each field. One pass."""
    lacks = filters.completable(fields)
    never = F.col("completion_checked_at").isNull()
    due = never | (F.col("completion_checked_at") <= now - F.make_dt_interval(days=F.lit(again_days)))
    return companies.agg(F.count_if(lacks).alias("incomplete"), F.count_if(lacks & never).alias("never_tried"), F.count_if(lacks & due).alias("due"), F.count_if(lacks & ~due).alias("waiting"), *(F.count_if(blank_to_null(F.col(f).cast("string")).isNull()).alias(f"without_{f}") for f in fields))


def page_contacts(shown: Column, raw: Column, url: Column | str) -> Column:
    """struct<email, phone, fax, contact_person> of one page of a company's own: its shown text and its source, both columns without entities.

    The best address: of the site's own domain, then a shared mailbox, then by name. Telephone, fax and person by their labels; a telephone without a label is the first number of the page that is not the fax; a fax is never guessed.
    """
    host = text.website_host(url)
    linked = lambda kind: F.regexp_extract_all(raw, F.lit(rf"(?i)href\s*=\s*[\"']{kind}:([^\"'?]*)"), F.lit(1))
    def best(mails: Column) -> Column:
        domain = lambda m: F.substring_index(m, "@", -1)
        own = lambda m: (domain(m) == host) | domain(m).endswith(F.concat(F.lit("."), host)) | host.endswith(F.concat(F.lit("."), domain(m)))
        usable = F.filter(mails, lambda m: validate.is_email(m) & ~validate.is_tracking_address(m))
        ranked = F.transform(usable, lambda m: F.struct((~F.coalesce(own(m), F.lit(False))).alias("foreign"), (~validate.is_role_address(m)).alias("personal"), m.alias("email")))
        return F.array_min(ranked)["email"]

    mails = F.array_distinct(F.concat(F.transform(linked("mailto"), lambda x: F.lower(F.trim(x))), text.emails(shown)))
    numbers = F.filter(F.transform(F.concat(linked("tel"), F.regexp_extract_all(shown, F.lit(fixed.PHONE_WITH_EXTENSION), F.lit(0))), text.phone), lambda n: n.isNotNull() & validate.is_phone(n))

    def told(found: Column) -> Column:
        of = lambda f: F.try_element_at(found["fields"], F.lit(f))
        fax, phone = research.usable_phone(of("fax")), research.usable_phone(of("phone"))
        other = F.get(F.filter(numbers, lambda n: ~n.eqNullSafe(fax)), F.lit(0))
        return F.struct(best(mails).alias("email"), F.coalesce(phone, other).alias("phone"), fax.alias("fax"), research.usable_person(of("contact_person")).alias("contact_person"))

    return pages._let(pages.labelled(shown), told)


CONTACT_FIELDS = ("email", "phone", "fax", "contact_person")


def own_site_contacts(fetched: DataFrame, wanted: Sequence[str] = CONTACT_FIELDS, most: int = 3, confirm: bool = True) -> DataFrame:
    """(company_id, confirmed, pages_read, email, phone, fax, contact_person) from the pages of each company's site.

    fetched: company_id, name_key, nth (0 is the home page, then contact pages in order), url, html; a null html could not be read and costs nothing. The first page that has a value gives it; pages after the first ``most``, and after all wanted fields have values, are not
    read. With ``confirm`` the home page must mention the company, else nothing is taken and no other page read; a site whose home page could not be read is not confirmed.
    """
    readable = fetched.filter(F.col("html").isNotNull())
    place = Window.partitionBy("company_id").orderBy("nth")
    home = fetched.filter("nth = 0").select(F.col("company_id").alias("_id"), (F.col("html").isNotNull() & (research.mentions_company(pages.shown_text("html"), "name_key") if confirm else F.lit(True))).alias("confirmed"))
    kept = readable.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= most)
    kept = kept.withColumns({"_shown": pages.shown_text("html"), "_raw": text.unescaped("html")})
    told = kept.select("company_id", "_place", page_contacts(F.col("_shown"), F.col("_raw"), "url").alias("c"))
    upto = place.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    have = {f: F.max(F.col(f"c.{f}").isNotNull()).over(upto) for f in wanted}
    done = None
    for f in wanted:
        done = F.coalesce(have[f], F.lit(False)) if done is None else done & F.coalesce(have[f], F.lit(False))
    read = told.withColumn("_done", done if done is not None else F.lit(False)).filter("not _done")
    joined = read.join(home, F.col("company_id") == F.col("_id")).filter(F.col("confirmed") | (F.col("_place") == 1))
    first = [F.min_by(f"c.{f}", F.when(F.col("confirmed") & F.col(f"c.{f}").isNotNull(), F.col("_place"))).alias(f) for f in CONTACT_FIELDS]
    found = joined.groupBy("company_id").agg(F.count(F.lit(1)).alias("pages_read"), *first)
    sites = fetched.select("company_id").distinct().join(home, F.col("company_id") == F.col("_id"), "left").select("company_id", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    return sites.join(found, "company_id", "left").select("company_id", "confirmed", F.coalesce("pages_read", F.lit(0)).cast("long").alias("pages_read"), *(F.when(F.col("confirmed"), F.col(f)).alias(f) for f in CONTACT_FIELDS))
