"""Identity keys, the strongest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, email, phone, tax_id, website_host
from .validate import is_email, is_tax_id

CONFIDENCE = {"tax": "exact", "mail": "exact", "np": "high", "nw": "high", "n": "moderate", "raw": "none"}


def dedupe_key(name: Column | str, name_key: Column | str, tax: Column | str, mail: Column | str, telephone: Column | str, site: Column | str) -> Column:
    """tax: valid number, mail: valid address, np: name and phone, nw: name and host, n: name, raw: the text itself; empty if there is nothing. name_key comes from company_name_key()."""
    number, address, digits, host = tax_id(tax), email(mail), phone(telephone), website_host(site)
    key = F.when(F.coalesce(col(name_key), F.lit("")) != "", col(name_key))
    raw = F.lower(F.trim(F.coalesce(col(name), F.lit(""))))
    tagged = lambda tag, *parts: F.concat(F.lit(tag + ":"), *parts)
    return F.coalesce(
        F.when(is_tax_id(number), tagged("tax", number)),
        F.when(is_email(address), tagged("mail", address)),
        tagged("np", key, F.lit("|"), digits),
        tagged("nw", key, F.lit("|"), host),
        tagged("n", key),
        F.when(raw != "", tagged("raw", raw)),
        F.lit(""),
    )


def confidence(key: Column | str) -> Column:
    tag = F.substring_index(col(key), ":", 1)
    out = F.lit("none")
    for k, v in CONFIDENCE.items():
        out = F.when(tag == k, v).otherwise(out)
    return out
