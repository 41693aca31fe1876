"""Records out of pages by declared rules, and judging rules, lists and links that were found."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import emails, website_host
from ..functions.validate import is_role_address, is_tracking_address
from ..operators.staging import spread
from .pages import Tree

LEAST_HITS, LEAST_DISTINCT = 0.35, 0.5


@dataclass(frozen=True)
class Rule:
    """selector: steps of tag, .class, #id and [attr^=value], by descent. attr: of the element instead of its text. regex: its first group counts."""

    selector: str
    attr: str | None = None
    regex: str | None = None
    multiple: bool = False
    separator: str = ", "


class Page(Tree):
    """A tree that keeps all attributes."""

    def __init__(self, html: str):
        super().__init__()
        self.attributes: list[dict] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.attributes.append({k: v or "" for k, v in attrs})


_STEP = re.compile(r"(?P<tag>[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:\^=['\"]?(?P<start>[^'\"\]]*)['\"]?)?\]")


def _fits(page: Page, node: int, step: str) -> bool:
    a = page.attributes[node]
    for m in _STEP.finditer(step):
        if m["tag"] and page.nodes[node][2] != m["tag"].lower() or m["cls"] and m["cls"] not in (a.get("class") or "").split() or m["id"] and a.get("id") != m["id"]:
            return False
        if m["attr"] and not (m["attr"] in a and a[m["attr"]].startswith(m["start"] or "")):
            return False
    return True


def selected(page: Page, selector: str, scope: int = -1) -> list[int]:
    """Nodes below scope that a selector names, in page order."""
    steps, out = selector.split(), []
    for node in range(scope + 1, page.nodes[scope][7] + 1 if scope >= 0 else len(page.nodes)):
        if not _fits(page, node, steps[-1]):
            continue
        at, left, inside = page.nodes[node][1], len(steps) - 2, scope < 0
        while at >= 0 and not (inside and left < 0):
            if at == scope:
                inside = True
                break
            if left >= 0 and _fits(page, at, steps[left]):
                left -= 1
            at = page.nodes[at][1]
        if left < 0 and inside:
            out.append(node)
    return out


def value_of(page: Page, scope: int, rule: Rule) -> str | None:
    found = []
    for node in selected(page, rule.selector, scope):
        raw = page.attributes[node].get(rule.attr, "") if rule.attr else page.text(node)
        if rule.regex:
            m = re.search(rule.regex, raw)
            raw = (m[1] if m.re.groups else m[0]) if m else ""
        if raw.strip():
            found.append(raw.strip())
            if not rule.multiple:
                break
    return rule.separator.join(dict.fromkeys(found)) or None


def extracted(pages: DataFrame, item: str, rules: dict[str, Rule]) -> DataFrame:
    """(page_id, item, one column for each rule): the values of each item of each page; an item without any value is left out."""
    names = list(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                page = Page(html)
                for k, scope in enumerate(selected(page, item)):
                    values = [value_of(page, scope, rules[n]) for n in names]
                    if any(values):
                        rows.append((page_id, k, *values))
            yield pd.DataFrame(rows, columns=["page_id", "item", *names])

    return spread(pages.select("page_id", "html")).mapInPandas(run, "page_id long, item int, " + ", ".join(f"{n} string" for n in names))


def judged_rules(items: DataFrame, fields: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """(field, hit_rate, distinct_rate, valid): a rule must hit often enough; a field that differs by record must not repeat one value."""
    one = items.agg(F.count(F.lit(1)).alias("_n"), *(F.count(f).alias(f) for f in fields), *(F.count_distinct(f).alias(f"{f}_d") for f in fields))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f) / F.greatest("_n", F.lit(1))).alias("hit_rate"), (F.col(f"{f}_d") / F.greatest(f, F.lit(1))).alias("distinct_rate"), F.lit(f in distinct).alias("own"), F.col(f).alias("n")) for f in fields))
    x = one.select(F.explode(rows).alias("x")).select("x.*")
    return x.select("field", "hit_rate", "distinct_rate", ((F.col("hit_rate") >= LEAST_HITS) & (~F.col("own") | (F.col("n") <= 2) | (F.col("distinct_rate") >= LEAST_DISTINCT))).alias("valid"))


def name_score(distinct_rate: Column, marker_rate: Column, usable_rate: Column, coverage: Column, mean_length: Column, longest: int = 40) -> Column:
    """How much a field's values look like names; long ones count 0.4."""
    raw = distinct_rate * 5 + marker_rate * 4 + usable_rate * 2 + coverage
    return F.when(mean_length > longest, raw * 0.4).otherwise(raw)


def list_score(marker_rate: Column, items: Column, contacts: Column, pages: Column, fields: Column, least: float = 0.4) -> Column:
    """How much a found list is worth; null if too few of its names have a marker."""
    score = marker_rate * 60 + F.least(items, F.lit(100)) * 0.5 + contacts * 8 + F.least(pages, F.lit(50)) * 0.5 + fields * 2
    return F.when(marker_rate >= least, score)


def site_contacts(pages: DataFrame, url: str, text: str) -> DataFrame:
    """(host, email): the best address of each site: of its own domain first, then shared mailboxes, then by name; program identifiers are left out."""
    found = pages.select(website_host(url).alias("host"), F.explode(emails(text)).alias("email")).filter(~is_tracking_address("email"))
    domain = F.substring_index("email", "@", -1)
    own = (domain == F.col("host")) | domain.endswith(F.concat(F.lit("."), F.col("host"))) | F.col("host").endswith(F.concat(F.lit("."), domain))
    return found.groupBy("host").agg(F.min(F.struct((~own).alias("foreign"), (~is_role_address("email")).alias("personal"), "email"))["email"].alias("email"))


def frontier(seen: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """The next pages to visit of a site: not seen by address key, the highest priority first, then the least deep; links: (url, key, priority, depth)."""
    new = links.join(seen.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct((-F.col("priority")).alias("low"), "depth", "url")).alias("b"))
    return new.select("key", "b.url", (-F.col("b.low")).alias("priority"), "b.depth").filter("priority >= 0").orderBy(F.desc("priority"), "depth", "url").limit(budget)
