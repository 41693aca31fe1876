"""Raw rows made storable, and small work on records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text, validate
from ..functions.text import blank_to_null, col

RAW = ["company_name", "tax_id", "email", "phone", "website", "address", "industry", "english_name", "fax", "products", "contact_person"]


def tidy_extra(pairs: Column | str, most: int = 30, key_chars: int = 60, value_chars: int = 500) -> Column:
    """map of the first ``most`` non-blank pairs; pairs: array<struct<k,v>>, whose order says which come first. Of equal keys the last value counts."""
    trimmed = F.transform(col(pairs), lambda p: F.struct(F.substring(F.trim(p["k"]), 1, key_chars).alias("k"), F.substring(F.trim(p["v"]), 1, value_chars).alias("v")))
    full = F.filter(trimmed, lambda p: (p["k"] != "") & (p["v"] != ""))
    kept = F.filter(full, lambda p, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.slice(kept, 1, most))


def cleaned(raw: DataFrame, drop_adverts: bool = True, disposable: Sequence[str] = (), mx: DataFrame | None = None) -> DataFrame:
    """raw with normalised fields, name_key, dedupe_key, email_verdict and ``rejected``: null for rows to store, else the reason.

    Only the name can reject a row; other fields that are not valid become null, except that a tax id of the right length stays though its
    checksum fails. mx: (domain, has_mx) of the mail servers that were looked up.
    """
    folded = raw.select(*(text.halfwidth(c).alias(c) if c in RAW else F.col(c) for c in raw.columns))
    name = text.company_name("company_name")
    mail, phone, site = text.email("email"), text.phone("phone"), text.website("website")
    out = folded.withColumns({
        "company_name": name,
        "_raw_site": F.col("website"),
        "email": F.when(validate.is_email(mail) & ~validate.is_tracking_address(mail), mail),
        "phone": F.when(validate.is_phone(phone), phone),
        "website": F.when(validate.is_website(site), site),
        "tax_id": text.tax_id("tax_id"),
        "address": text.address("address"),
        "industry": text.industry("industry"),
        "english_name": blank_to_null("english_name"),
        "fax": text.phone("fax"),
        "products": blank_to_null("products"),
        "contact_person": text.person("contact_person"),
    })
    advert = validate.why_not_a_company("company_name", "_raw_site") if drop_adverts else F.lit(None).cast("string")
    out = out.withColumn("rejected", F.when(~validate.is_company_name("company_name"), "no usable name").otherwise(advert)).drop("_raw_site")
    out = out.withColumn("name_key", text.company_name_key(F.coalesce("company_name", F.lit(""))))
    out = out.withColumn("dedupe_key", identity.dedupe_key("company_name", "name_key", "tax_id", "email", "phone", "website"))
    has_mx = None
    if mx is not None:
        out = out.join(mx.select(F.col("domain").alias("_domain"), F.col("has_mx").alias("_has_mx")), validate.email_domain("email") == F.col("_domain"), "left").drop("_domain")
        has_mx = F.col("_has_mx")
    out = out.withColumn("email_verdict", validate.email_verdict("email", list(disposable), has_mx))
    return out.drop("_has_mx")


def parted(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rejected rows with their reason) of cleaned()."""
    return clean.filter("rejected is null").drop("rejected"), clean.filter("rejected is not null")


def first_by_name(rows: DataFrame, name: str = "company_name", seq: str = "seq") -> DataFrame:
    """Of rows whose names are equal but for outer blanks the first; rows without a name stay."""
    key = blank_to_null(name)
    first = rows.filter(key.isNotNull()).groupBy(key.alias("_name")).agg(F.min(seq).alias("_first"))
    return rows.join(first, (key == F.col("_name")) & (F.col(seq) == F.col("_first")), "left").filter(key.isNull() | F.col("_first").isNotNull()).drop("_name", "_first")


def migrated(stored: DataFrame, current: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Stored rows in the current schema: new columns are null or have their default; columns that are gone stay behind."""
    grown = current.limit(0).unionByName(stored, allowMissingColumns=True).select(*current.columns)
    new = [c for c in current.columns if c not in stored.columns and c in defaults]
    return grown.withColumns({c: F.coalesce(c, F.lit(defaults[c])) for c in new}) if new else grown


def map_from_json(c: Column | str) -> Column:
    """A map of strings; broken JSON or another kind of value is an empty map."""
    return F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def map_to_json(c: Column | str) -> Column:
    """With sorted keys, so that equal maps are equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(c)))))


def page_urls(template: Column | str, first: Column, last: Column) -> Column:
    """An array of addresses: {page} from first to last."""
    return F.transform(F.sequence(first, last), lambda k: F.replace(col(template), F.lit("{page}"), k.cast("string")))


def run_summary(started: str, finished: str) -> Column:
    """Whole seconds that a run took; null while it runs."""
    return F.floor((F.unix_micros(F.col(finished).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1_000_000)


def zipped_details(items: Column | str, details: Column | str) -> Column:
    """Items with the detail at the same place; a missing one is empty, and blanks keep their place."""
    return F.transform(F.arrays_zip(col(items).alias("item"), col(details).alias("detail")), lambda x: F.struct(x["item"].alias("item"), F.coalesce(x["detail"], F.lit("")).alias("detail")))
