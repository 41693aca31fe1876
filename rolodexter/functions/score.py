"""The 0 to 100 lead score and its parts, as Columns; never stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import blank_to_null, col


def _tier(c: Column, tiers: list[tuple[int, int]], at_least: bool) -> Column:
    out = None
    for limit, points in tiers:
        met = c >= limit if at_least else c <= limit
        out = F.when(met, points) if out is None else out.when(met, points)
    return out.otherwise(0)


def days_since(now: Column, then: Column) -> Column:
    """Whole days that have passed, not midnights."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000)


def parts(c: dict[str, Column | str], now: Column) -> dict[str, Column]:
    """Points by part. c: Columns by role: email, email_verdict, phone, capital, updated_at, created_at, website, contact_person, address, tax_id; missing roles count as blank."""
    get = lambda k, kind="string": col(c[k]) if k in c else F.lit(None).cast(kind)
    verdict = F.coalesce(blank_to_null(get("email_verdict")), F.lit("Unknown"))
    mail = F.lit(fixed.EMAIL_POINTS["Unknown"])
    for v, points in fixed.EMAIL_POINTS.items():
        mail = F.when(verdict == v, points).otherwise(mail)
    out = {
        "email": F.when(blank_to_null(get("email")).isNotNull(), mail).otherwise(0),
        "capital": _tier(F.coalesce(get("capital", "long"), F.lit(0)), fixed.CAPITAL_POINTS, True),
        "freshness": _tier(days_since(now, F.coalesce(get("updated_at", "timestamp"), get("created_at", "timestamp"))), fixed.FRESHNESS_POINTS, False),
    }
    return out | {k: F.when(blank_to_null(get(k)).isNotNull(), p).otherwise(0) for k, p in fixed.PRESENCE_POINTS.items()}


def is_gone(status: Column | str) -> Column:
    return F.coalesce(col(status).rlike("|".join(fixed.DEAD_STATUS_WORDS)), F.lit(False))


def lead_score(c: dict[str, Column | str], now: Column) -> Column:
    total = sum(parts(c, now).values(), F.lit(0))
    veto = F.coalesce(col(c["do_not_contact"]), F.lit(False)) if "do_not_contact" in c else F.lit(False)
    if "registration_status" in c:
        veto = veto | is_gone(c["registration_status"])
    return F.when(veto, F.least(total, F.lit(fixed.SCORE_CEILING_GONE))).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))


def explained(c: dict[str, Column | str], now: Column) -> Column:
    """array<struct<part,points>>"""
    return F.array(*(F.struct(F.lit(k).alias("part"), v.cast("int").alias("points")) for k, v in parts(c, now).items()))
