"""Importing into and exporting from the store, counted in the passes that write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import website_host
from ..sources import export
from . import records, sequential
from .staging import stage

FORMATS = ("csv", "json", "excel")


@dataclass
class ImportSummary:
    """What an import did: rows read, those rejected by reason, new rows, and records that went into rows that were there or new."""

    rows_read: int = 0
    invalid: int = 0
    reasons: dict[str, int] = field(default_factory=dict)
    new: int = 0
    merged: int = 0
    stored: int = 0


def imported(raw: DataFrame, store: DataFrame, reasons: Sequence[str] = ("no usable name", "name is a headline", "site is an article"), **options) -> tuple[DataFrame, ImportSummary]:
    """(the store after it, summary). raw: records.RAW columns and seq; store: sequential.COLUMNS. Extra columns of raw that the store has (source_url, extra) are kept.

    Each row is cleaned and written once, with its counts observed in that write; so are the counts of the merged store. Nothing is counted by a pass of its own. options go to records.cleaned().
    """
    seen, out = Observation("import"), Observation("store")
    by_reason = [F.count_if(F.col("rejected") == r).alias(f"reason_{k}") for k, r in enumerate(reasons)]
    clean = records.cleaned(raw, **options).observe(seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("rejected").isNotNull()).alias("invalid"), *by_reason)
    clean = stage(clean, "cleaned")
    batch = clean.filter("rejected is null").withColumn("host", website_host("website"))
    if "source_url" not in batch.columns:
        batch = batch.withColumn("source_url", F.lit(None).cast("string"))
    after = sequential.upserted(store, batch)
    after = stage(after.observe(out, F.count(F.lit(1)).alias("stored"), F.count_if(F.col("id").isNull()).alias("new"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged")), "store")
    a, b = seen.get, out.get
    return after, ImportSummary(a["rows_read"], a["invalid"], {r: a[f"reason_{k}"] for k, r in enumerate(reasons) if a[f"reason_{k}"]}, b["new"], b["merged"], b["stored"])


@dataclass
class ExportSummary:
    """How many rows were written, whether a credit was due, and where each format is."""

    rows: int
    credited: bool
    paths: dict[str, str]

    asdict = asdict


def exported(rows: DataFrame, folder: str, columns: Sequence[str], order: Sequence[Column | str], exported_at: str, formats: Sequence[str] = FORMATS, headers: dict[str, str] | None = None, maps: str | None = None, capital: str | None = None, status: str | None = None, credit: str | None = None) -> ExportSummary:
    """Writes rows in every format from one staged frame: the query runs once, and its rows are counted while they are staged.

    csv and json are folders, excel a folder of workbooks. Where registry data is among the rows (capital or status set), the credit is one more row of each. No rows give files with headers only.
    """
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}; known: {', '.join(FORMATS)}")
    used = [c for c in (capital, status) if c]
    due = F.lit(False)
    if capital:
        due = due | (F.coalesce(F.col(capital), F.lit(0)) != 0)
    if status:
        due = due | (F.coalesce(F.col(status), F.lit("")) != "")
    seen = Observation("export")
    held = stage(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_or(due), F.lit(False)).alias("credited")), "export")
    n, credited = seen.get["rows"], bool(seen.get["credited"]) and bool(used)
    said, paths = credit if credited else None, {}
    shaped = export.shaped(held, columns, headers, maps)
    if "csv" in formats:
        paths["csv"] = f"{folder}/csv"
        export.write_csv(shaped, paths["csv"], said)
    if "json" in formats:
        paths["json"] = f"{folder}/json"
        export.write_json(held, paths["json"], columns, exported_at, order, said)
    if "excel" in formats:
        paths["excel"] = f"{folder}/excel"
        named = [(headers or {}).get(c, c) if isinstance(c, str) else c for c in order]
        export.save_workbooks(export.workbooks(shaped, named, credit=said), paths["excel"].removeprefix("file://"))
    return ExportSummary(n, credited, paths)
