"""Names, sizes, versions and bodies of messages, as Columns."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Characters that no file name has, and the longest name.
UNSAFE = '<>:"/\\|?*'
LONGEST_NAME = 120
SHOWN_TAGS = r"(?i)<(p|br|div|ul|li|h[1-6]|strong|b|em|i|u|a|img)\b[^>]*>"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def human_size(c: Column | str) -> Column:
    """Bytes as B, KB, MB or GB; one digit behind the point but for bytes."""
    n = col(c).cast("double")
    show = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(n / 1024**k, 1)), F.lit(" " + unit))
    return F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B"))).when(n < 1024**2, show(1, "KB")).when(n < 1024**3, show(2, "MB")).otherwise(show(3, "GB"))


def safe_name(c: Column | str) -> Column:
    """The last part of a path without characters that a file system refuses; a long name keeps its suffix."""
    base = F.regexp_extract(F.regexp_replace(col(c), "/+$", ""), "([^/]*)$", 1)
    bare = F.btrim(F.trim(F.translate(base, UNSAFE, "_" * len(UNSAFE))), F.lit(". "))
    name = F.when(bare == "", F.lit("attachment")).otherwise(bare)
    suffix = F.regexp_extract(name, r"\.([^.]*)$", 1)
    cut = F.concat(F.substr(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(1), F.lit(LONGEST_NAME - 1) - F.length(suffix)), F.lit("."), suffix)
    return F.when(F.length(name) <= LONGEST_NAME, name).when(F.contains(name, F.lit(".")), cut).otherwise(F.substring(name, 1, LONGEST_NAME))


def version(c: Column | str) -> Column:
    """A version as an array of numbers, which compare part by part."""
    return F.transform(F.split(F.coalesce(F.nullif(col(c), F.lit("")), F.lit("0")), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "[^0-9]", ""), F.lit("")).cast("long"), F.lit(0)))


_HEAD = r"(?m)^[ \t]*##[ \t]+([0-9]+(?:\.[0-9]+)*)[ \t]*(?:—|-|–)?.*$"


def newest_version(changelog: Column | str) -> Column:
    """struct<version, notes>: the first heading of a version, and what stands below it up to the next."""
    x = F.coalesce(col(changelog), F.lit(""))
    return F.struct(F.regexp_extract(x, _HEAD, 1).alias("version"), F.btrim(F.coalesce(F.get(F.split(x, _HEAD, -1), F.lit(1)), F.lit("")), F.lit(" \t\r\n")).alias("notes"))


def looks_like_html(c: Column | str) -> Column:
    """Whether a body has an element that shows something; a bare < is none."""
    return F.coalesce(col(c).rlike(SHOWN_TAGS), F.lit(False))


def html_to_text(c: Column | str) -> Column:
    """Paragraphs and breaks as lines, list items with a dash, links with their address, entities as characters."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", "$2 ($1)")
    x = F.regexp_replace(x, r"(?i)\s*<li\b[^>]*>\s*", "\n- ")
    x = F.regexp_replace(x, r"(?i)\s*<br\s*/?>\s*", "\n")
    x = F.regexp_replace(x, r"(?i)\s*</?(p|div|h[1-6]|ul|ol)\b[^>]*>\s*", "\n\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(character))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return F.btrim(x, F.lit(" \n"))


def text_to_html(c: Column | str) -> Column:
    """Blank lines part paragraphs, others break lines; characters that HTML reserves are written out."""
    x = F.btrim(F.coalesce(col(c), F.lit("")), F.lit(" \n"))
    for character, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(character), F.lit(name))
    paragraphs = F.transform(F.split(x, r"\n[ \t]*\n\s*"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(x == "", "").otherwise(F.array_join(paragraphs, "\n"))


def with_note(body: Column | str, note: str) -> Column:
    """A body with a sentence at its end, as a paragraph where the body is HTML; once only, and nothing for a blank sentence."""
    x = col(body)
    if not note:
        return x
    end = F.regexp_replace(x, r"\s+$", "")
    marked = F.concat(end, F.lit(f'\n<p style="color:#888;font-size:12px">{html.escape(note)}</p>'))
    return F.when(F.contains(x, F.lit(note.strip())), x).when(looks_like_html(x), marked).otherwise(F.concat(end, F.lit("\n\n" + note)))


def template_parts(source: Column | str) -> Column:
    """struct<subject, body> of a stored template: a first line "Subject: ...", a blank line, the body."""
    x = F.regexp_replace(F.coalesce(col(source), F.lit("")), "\r\n", "\n")
    subject = F.regexp_extract(x, r"^(?i:subject)[ \t]*:[ \t]*([^\n]*)", 1)
    body = F.when(x.rlike(r"^(?i:subject)[ \t]*:"), F.regexp_replace(x, r"^[^\n]*\n?\n?", "")).otherwise(x)
    return F.struct(F.trim(subject).alias("subject"), body.alias("body"))


def since_query(today: Column, days: int) -> Column:
    """A mailbox's search for mail of the last days, one at least; months are English whatever the locale."""
    day = F.date_sub(today, max(days, 1))
    return F.concat(F.lit("SINCE "), F.date_format(day, "dd"), F.lit("-"), F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1), F.lit("-"), F.year(day).cast("string"))


def unknown_placeholders(template: str, known: list[str]) -> list[str]:
    return [p for p in dict.fromkeys(re.findall(r"\{(\w+)\}", template)) if p not in known]
