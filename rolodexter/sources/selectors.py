"""Choosing elements of pages by CSS selectors as joins over one table of nodes, and records by rules of selectors.

A page is parsed once. Its elements are numbered in document order, so an element's descendants are the numbers up to its last one: ``a b`` is containment of intervals,
told by a running sum of intervals that begin and end; ``a > b`` and ``a + b`` are equal keys.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import spread, stage
from .extraction import Page, Rule
from .pages import framed, resolved

PARSED = "page_id long, kind string, node int, parent int, last int, prev int, nth int, nth_last int, tag string, classes array<string>, attributes map<string,string>, first int, end int, text string"


def parsed(pages: DataFrame) -> DataFrame:
    """One table of each page (page_id, html), written: its elements (kind node) and its pieces of text (kind text, numbered by node).

    An element has its parent, the last number of its subtree, the element before it among its siblings, its place among them from either side, and the range of its pieces of text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for frame in framed(pieces(batches), names):
            yield frame.astype({c: "Int32" for c in ("parent", "last", "prev", "nth", "nth_last", "first", "end")})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                page, children = Page(html), defaultdict(list)
                for n in page.nodes:
                    children[n[1]].append(n[0])
                place = {k: (i, x[i - 1] if i else None, len(x) - i) for x in children.values() for i, k in enumerate(x)}
                for n in page.nodes:
                    i, prev, back = place[n[0]]
                    a = page.attributes[n[0]]
                    yield page_id, "node", n[0], n[1], n[7], prev, i + 1, back, n[2], (a.get("class") or "").split(), a, n[5], n[6], None
                yield from ((page_id, "text", k, None, None, None, None, None, None, None, None, None, None, x) for k, x in enumerate(page.texts))

    return stage(spread(pages.select("page_id", "html")).mapInPandas(run, PARSED), "nodes")


_NAME = r"[A-Za-z_\-\u0080-￿][\w\-\u0080-￿]*"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|#(?P<id>{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    r"|:(?P<pseudo>first-child|last-child|only-child|nth-child|nth-last-child|not)(?:\((?P<arg>[^()]*)\))?"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def _parts(selector: str) -> list[str]:
    """A list of selectors, cut at commas outside of brackets and quotes."""
    out, depth, quote = [""], 0, ""
    for c in selector:
        quote = "" if c == quote else c if not quote and c in "\"'" else quote
        depth += (c in "[(") - (c in "])") if not quote else 0
        if c == "," and not depth and not quote:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def steps(selector: str) -> list[tuple[str, list[re.Match]]]:
    """[(combinator, simple selectors)] of one selector without commas; the first combinator is a blank."""
    out, at, join = [], 0, " "
    while at < len(selector):
        found = []
        while m := _SIMPLE.match(selector, at):
            if m["tag"] and found:
                break
            found.append(m)
            at = m.end()
        if not found:
            raise ValueError(f"not a selector: {selector!r}")
        out.append((join, found))
        if at < len(selector):
            m = _COMBINATOR.match(selector, at)
            if not m:
                raise ValueError(f"not a selector: {selector!r}")
            join, at = m[1] or " ", m.end()
            if at == len(selector):
                raise ValueError(f"not a selector: {selector!r}")
    if not out:
        raise ValueError("an empty selector")
    return out


def _nth(place: Column, said: str) -> Column:
    """Whether a place from 1 is one of an+b, odd or even."""
    said = re.sub(r"\s", "", {"odd": "2n+1", "even": "2n"}.get(said.strip().lower(), said.lower()))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", said)
    if not m or not said:
        raise ValueError(f"not a place: {said!r}")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    if not a:
        return place == b
    return ((place - b) % a == 0) & ((place - b) / a >= 0)


def _fits(m: re.Match) -> Column:
    attr = F.try_element_at(F.col("attributes"), F.lit((m["attr"] or m["id"] and "id" or "").lower()))
    if m["tag"]:
        return F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower()
    if m["cls"]:
        return F.array_contains("classes", m["cls"])
    if m["id"]:
        return attr == m["id"]
    if m["attr"]:
        value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
        if m["op"] is None:
            return attr.isNotNull()
        v = F.lit(value)
        if m["op"] == "=":
            return attr == v
        if m["op"] == "~=":
            return F.array_contains(F.split(attr, r"\s+"), value)
        if m["op"] == "|=":
            return (attr == v) | attr.startswith(value + "-")
        if not value:
            return F.lit(False)
        return {"^=": attr.startswith(value), "$=": attr.endswith(value), "*=": F.contains(attr, v)}[m["op"]]
    if m["pseudo"] == "not":
        inner = steps(m["arg"] or "")
        if len(inner) > 1:
            raise ValueError(":not() takes one step")
        return ~_all(inner[0][1])
    if m["pseudo"] in ("nth-child", "nth-last-child"):
        return _nth(F.col("nth" if m["pseudo"] == "nth-child" else "nth_last"), m["arg"] or "")
    first, last = F.col("nth") == 1, F.col("nth_last") == 1
    return {"first-child": first, "last-child": last, "only-child": first & last}[m["pseudo"]]


def _all(simple: list[re.Match]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(_fits(m), F.lit(False)) for m in simple))


def _below(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that lie within one of found. By a running sum: an interval counts from its element's number on, not with it, to its last."""
    marks = found.select("page_id", F.inline(F.array(F.struct(F.col("node").alias("at"), F.lit(1).alias("open")), F.struct((F.col("last")).alias("at"), F.lit(-1).alias("open")))))
    marks = marks.groupBy("page_id", "at").agg(F.sum(F.when(F.col("open") > 0, 1).otherwise(0)).alias("begins"), F.sum(F.when(F.col("open") < 0, 1).otherwise(0)).alias("ends"))
    both = nodes.select("page_id", F.col("node").alias("at"), F.lit(True).alias("asks")).join(marks, ["page_id", "at"], "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("begins", "ends")})
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # Open at a number: begun before it and not ended before it.
    open_ = both.withColumn("open", F.coalesce(F.sum(F.col("begins") - F.col("ends")).over(before), F.lit(0)))
    inside = open_.filter("asks and open > 0").select("page_id", F.col("at").alias("node"))
    return nodes.join(inside, ["page_id", "node"], "left_semi")


def selected(table: DataFrame, selector: str) -> DataFrame:
    """(page_id, node, last, first, end, attributes, tag) of the elements that a selector names, each once. table: of parsed().

    Tags, classes, ids, attributes with all operators, :first-, :last-, :only-, :nth- and :nth-last-child, :not() of one step, joined by blanks, >, + and ~; lists with commas.
    """
    nodes = table.filter("kind = 'node'").drop("kind", "text")
    chosen = []
    for part in _parts(selector):
        found = None
        for join, simple in steps(part):
            fit = nodes.filter(_all(simple))
            if found is None:
                found = fit
            elif join == " ":
                found = _below(found, fit)
            elif join == ">":
                found = fit.join(found.select("page_id", F.col("node").alias("parent")), ["page_id", "parent"], "left_semi")
            elif join == "+":
                found = fit.join(found.select("page_id", F.col("node").alias("prev")), ["page_id", "prev"], "left_semi")
            else:
                least = found.groupBy("page_id", "parent").agg(F.min("node").alias("least"))
                found = fit.join(least, ["page_id", "parent"]).filter(F.col("node") > F.col("least"))
        chosen.append(found.select("page_id", "node", "last", "first", "end", "attributes", "tag"))
    return reduce(DataFrame.unionByName, chosen).dropDuplicates(["page_id", "node"]) if len(chosen) > 1 else chosen[0]


def texts(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, node, said) of nodes: the text of the whole subtree, its pieces in order; elements without text have none. Pieces stay where they are until an element asks for them."""
    piece = table.filter("kind = 'text'").select("page_id", F.col("node").alias("k"), F.col("text").alias("piece"))
    ranges = nodes.select("page_id", "node", "first", "end").distinct().filter(F.col("end") > F.col("first"))
    pairs = ranges.select("page_id", "node", F.explode(F.sequence("first", F.col("end") - 1)).alias("k")).join(piece, ["page_id", "k"])
    whole = pairs.groupBy("page_id", "node").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    return whole.select("page_id", "node", F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["piece"]), " "), r"(?U)\s+", " ")).alias("said"))


def extracted(pages: DataFrame, item: str, rules: dict[str, Rule]) -> DataFrame:
    """(page_id, item, a column for each rule) of the elements that ``item`` names on each page (page_id, html, and url for links).

    Of a rule the first element within the item counts, with ``multiple`` all in order; its text or attribute, an href or src resolved where pages have a url, cut by the rule's pattern. An item without any value
    is left out. Every page is parsed once, whatever the number of rules.
    """
    table = parsed(pages)
    items = selected(table, item).withColumn("item", F.row_number().over(Window.partitionBy("page_id").orderBy("node")) - 1).select("page_id", "item", F.col("node").alias("from"), F.col("last").alias("upto"))
    items = stage(items, "items")
    values = []
    for name, rule in rules.items():
        inside = F.col("node").between(F.col("from") + 1, F.col("upto"))
        nodes = selected(table, rule.selector).join(items, "page_id").filter(inside)
        if not rule.multiple:
            nodes = nodes.groupBy("page_id", "item").agg(F.min_by(F.struct("node", "first", "end", "attributes"), "node").alias("n")).select("page_id", "item", "n.*")
        if rule.attr:
            raw = nodes.select("page_id", "item", "node", F.trim(F.try_element_at("attributes", F.lit(rule.attr.lower()))).alias("raw"))
            if rule.attr in ("href", "src") and "url" in pages.columns:
                raw = raw.filter("raw <> ''").join(pages.select("page_id", "url"), "page_id").select("page_id", "item", "node", resolved("url", "raw").alias("raw"))
        else:
            raw = nodes.select("page_id", "item", "node").join(texts(table, nodes), ["page_id", "node"]).select("page_id", "item", "node", F.col("said").alias("raw"))
        if rule.regex:
            groups = re.compile(rule.regex).groups
            raw = raw.withColumn("raw", F.trim(F.regexp_extract("raw", rule.regex, 1 if groups else 0)))
        raw = raw.filter("raw <> ''")
        joined = raw.groupBy("page_id", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "raw"))), lambda x: x["raw"]), rule.separator).alias("value"))
        values.append(joined.withColumn("rule", F.lit(name)))
    long = reduce(DataFrame.unionByName, values)
    return long.groupBy("page_id", F.col("item").cast("int").alias("item")).agg(*(F.max(F.when(F.col("rule") == name, F.col("value"))).alias(name) for name in rules))
