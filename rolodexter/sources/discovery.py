"""What an unknown listing page consists of: records within groups, the fields of a record, links to details, buttons, query forms.

Pages become rows of elements once; every guess is then a count, a rank or a join over those rows. item_nodes() parses pages, so records_of()
checkpoints it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, validate
from ..functions.text import blank_to_null
from ..operators.staging import spread, stage
from . import pages as listing
from .extraction import LEAST_DISTINCT, LEAST_HITS, Page, name_score, selected

#: Words in the class or id of an element by the field that they name.
CLASS_WORDS = {
    "company_name": ["company-name", "companyname", "firm", "vendor", "title", "name", "公司", "廠商"],
    "phone": ["tel", "phone", "mobile", "電話", "手機"],
    "email": ["mail", "email", "信箱", "郵"],
    "address": ["addr", "address", "location", "地址", "位置"],
    "industry": ["industry", "category", "cate", "type", "產業", "行業", "類別"],
    "contact_person": ["contact", "person", "owner", "聯絡", "窗口"],
    "english_name": ["english", "eng-name", "en-name", "英文"],
    "fax": ["fax", "傳真"],
    "products": ["product", "goods", "items", "產品", "營業項目", "代銷"],
    "website": ["website", "site", "url", "homepage", "網站", "網址"],
    "tax_id": ["tax", "vat", "uniform", "統編", "統一編號"],
}
#: What values of a field look like in a text.
TEXT_SHAPES = {
    "email": fixed.EMAIL_IN_TEXT,
    "phone": fixed.PHONE_IN_TEXT,
    "tax_id": r"(?<!\d)\d{8}(?!\d)",
    "address": r"[一-鿿]{1,8}[市縣][一-鿿]{0,8}[區鄉鎮市]?[^,\n]{2,40}?[路街道段巷弄號樓]",
    "url": r"(?:https?://|www\.)[^\s<>\"']+",
}
#: Fields that differ by company; link texts that are no names; texts of buttons that show more, send a query or are in a dialogue.
OWN_FIELDS = ["email", "phone", "fax", "website", "tax_id"]
LINK_WORDS = [
    "更多", "詳細", "詳細資料", "詳細內容", "詳情", "看更多", "閱讀更多", "查看", "查看更多", "繼續閱讀", "回上頁", "上一頁", "下一頁", "首頁", "回首頁", "登入", "註冊",
    "會員專區", "聯絡我們", "關於我們", "立即聯絡", "洽詢", "詢價", "加入最愛", "分享", "列印", "地圖", "官網", "網站",
    "more", "detail", "details", "read more", "readmore", "view", "view more", "login", "sign up", "signup", "home", "back", "next", "previous", "contact",
    "click here", "learn more", "website", "map", "share", "print",
]
REVEAL_WORDS = [
    "顯示電話", "查看電話", "看電話", "顯示聯絡", "查看聯絡", "顯示信箱", "查看信箱", "顯示手機", "展開", "看詳細", "顯示完整",
    "show phone", "show contact", "show email", "reveal", "view number",
]
MORE_WORDS = ["載入更多", "看更多", "更多結果", "顯示更多", "load more", "show more", "view more", "more results"]
MORE_TAGS = ["button", "a"]
SUBMIT_WORDS = ["查詢", "搜尋", "查　詢", "送出", "確定", "開始查詢", "search", "query", "qry", "submit", "find"]
DIALOGUE_WORDS = ["modal", "dialog", "popup", "lightbox"]
#: Elements that are pieces of a record and never one; classes of page grids, spacing and display, which name nothing.
INLINE = ["a", "span", "font", "b", "strong", "em", "i", "u", "small", "big", "label", "abbr", "cite", "code", "sub", "sup", "br", "img", "wbr"]
LAYOUT_CLASS = r"(?:col|row)(?:-[\w-]+)?|[pm][xytblrse]?-\d+|d-[\w-]+|[gh]-\d+"
LEAST_NAME_SCORE = 3.0
#: A group holds records where the inner elements are so many times more, have so much of its text, look so often like records and like names.
INNER_TIMES, INNER_TEXT, INNER_RECORDS, INNER_NAMES = 1.5, 0.5, 0.5, 0.8

_READINGS = ["text", *TEXT_SHAPES, "mailto", "tel", "outside"]


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _classes(page: Page, node: int) -> list[str]:
    return (page.attributes[node].get("class") or "").split()


def _css(page: Page, node: int) -> str:
    """tag.class with the first class that names something, else the tag."""
    return _css_of(page.nodes[node][2], page.attributes[node].get("class") or "")


@lru_cache(4096)
def _css_of(tag: str, said: str) -> str:
    named = [c for c in said.split() if len(c) > 1 and not c.isdigit() and not re.fullmatch(LAYOUT_CLASS, c) and c.lower() not in fixed.ALTERNATING_CLASSES]
    return f"{tag}.{named[0]}" if named else tag


def _anchor(page: Page, node: int) -> str | None:
    """#id or tag.class of an element that can be told from others."""
    css = _css(page, node)
    return f"#{page.attributes[node]['id'].strip()}" if page.attributes[node].get("id", "").strip() else css if "." in css else None


def _items(page: Page, parent: int, tag: str, cls: str, inner: str | None) -> list[int]:
    outer = [n[0] for n in page.nodes if n[1] == parent and n[2] == tag and n[3] == cls]
    return list(dict.fromkeys(k for o in outer for k in selected(page, inner, o))) if inner else outer


def _with_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    wanted = blocks if "inner" in blocks.columns else blocks.withColumn("inner", F.lit(None).cast("string"))
    return spread(pages.select("page_id", "html")).join(wanted.select("page_id", "parent", "tag", "class", "inner"), "page_id")


_NODES = "page_id long, item int, node int, root boolean, tag string, class string, css string, selectors array<string>, names string, href string, text string, leaf boolean"


def item_nodes(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """The elements of each record of a page's block: item, node, root (it is the record), tag, class, css, selectors (all of one step that choose it), names (its classes and id), href, text, leaf.

    blocks: of list_blocks() or drilled(). A page without a block has no rows.
    """

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, html, parent, tag, cls, inner in batch.itertuples(index=False):
                page = Page(html)
                for k, item in enumerate(_items(page, parent, tag, cls, inner)):
                    for n in page.nodes[item : page.nodes[item][7] + 1]:
                        a, t = page.attributes[n[0]], n[2]
                        yield page_id, k, n[0], n[0] == item, t, n[3], _css(page, n[0]), [t, *(f"{t}.{c}" for c in dict.fromkeys(_classes(page, n[0])))], f"{a.get('class', '')} {a.get('id', '')}".lower().strip(), n[4], page.text(n[0]), n[7] == n[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from listing.framed(elements(batches), [c.split()[0] for c in _NODES.split(", ")])

    return _with_blocks(pages, blocks).mapInPandas(run, _NODES)


def is_record_text(c: Column | str) -> Column:
    """Whether a text is of a company rather than of one field: with a company marker, an address of mail or a telephone number."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(validate.has_company_marker(x) | x.rlike(TEXT_SHAPES["email"]) | x.rlike(TEXT_SHAPES["phone"]), F.lit(False))


def is_name_text(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.length(x).between(2, 60) & x.rlike(r"[\p{L}\p{N}_]")


def drilled(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """blocks with inner: the selector of the records, where the block's elements are groups of them, and n their number.

    Of the five most frequent kinds of inner elements the first counts that is frequent enough, has most of the text and looks like records.
    nodes: item_nodes() of the blocks.
    """
    inner = nodes.filter(~F.col("root") & ~F.col("tag").isin(INLINE))
    outer = nodes.filter("root").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_outer"), F.sum(F.length("text")).alias("chars_outer"))
    kinds = inner.filter(is_name_text("text")).groupBy("page_id", "tag", "class").agg(F.count(F.lit(1)).alias("n_kind"), F.min(F.struct("item", "node", "css")).alias("first"))
    by_number = Window.partitionBy("page_id").orderBy(F.desc("n_kind"), "first")
    often = kinds.withColumn("place", F.row_number().over(by_number)).filter("place <= 5").join(outer, "page_id").filter(F.col("n_kind") >= F.col("n_outer") * INNER_TIMES)
    # Elements are judged by the selector that would choose them, whatever their other classes.
    chosen = inner.select("page_id", "item", "node", "text", F.explode("selectors").alias("css")).join(often.select("page_id", "place", "n_outer", "chars_outer", F.col("first.css").alias("css")), ["page_id", "css"])
    judged = chosen.groupBy("page_id", "place", "css", "n_outer", "chars_outer").agg(F.count(F.lit(1)).alias("n_inner"), F.sum(F.length("text")).alias("chars"), F.avg(is_name_text("text").cast("double")).alias("names"), F.avg(is_record_text("text").cast("double")).alias("records"))
    good = judged.filter((F.col("n_inner") >= F.col("n_outer") * INNER_TIMES) & (F.col("names") >= INNER_NAMES) & (F.col("chars") >= F.col("chars_outer") * INNER_TEXT) & (F.col("records") >= INNER_RECORDS))
    best = good.groupBy("page_id").agg(F.min(F.struct("place", "css", "n_inner")).alias("b"))
    return blocks.join(best, "page_id", "left").select(*(F.coalesce("b.n_inner", "n").alias("n") if c == "n" else F.col(c) for c in blocks.columns if c != "inner"), F.col("b.css").alias("inner"))


_SCOPED = "page_id long, selector string, n_items int, n_chosen int"


def scoped(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, selector, n_items, n_chosen): a selector of the block's records. One that chooses over a fifth more than them is put below the nearest ancestor that has an id or a class and leaves just them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html, parent, tag, cls, inner in batch.itertuples(index=False):
                page = Page(html)
                items = _items(page, parent, tag, cls, inner)
                outer = _items(page, parent, tag, cls, None)
                best = f"{_css(page, outer[0])} {inner}" if inner else _css(page, items[0])
                chosen, at = selected(page, best), parent
                while len(chosen) > len(items) * 1.2 and at >= 0:
                    anchor = _anchor(page, at)
                    below = selected(page, f"{anchor} {best}") if anchor else []
                    if sorted(below) == sorted(items):
                        best, chosen = f"{anchor} {best}", below
                    at = page.nodes[at][1]
                rows.append((page_id, best, len(items), len(chosen)))
            yield pd.DataFrame(rows, columns=["page_id", "selector", "n_items", "n_chosen"])

    return _with_blocks(pages, blocks).mapInPandas(run, _SCOPED)


# Fields


def _first_match(c: str, pattern: str) -> Column:
    return F.regexp_extract(c, f"({pattern})", 1)


def read_values(nodes: DataFrame) -> DataFrame:
    """(page_id, item, selector, reading, value): what each one-step selector gives of each record, its first value, read as text, as a part of the text with a known shape, or as a link's target."""
    href = F.trim(F.coalesce("href", F.lit("")))
    raw = {"text": F.trim("text")} | {k: _first_match("text", p) for k, p in TEXT_SHAPES.items()}
    raw |= {"mailto": F.regexp_extract(href, r"(?i)^mailto:([^?]*)", 1), "tel": F.regexp_extract(href, r"(?i)^tel:([^?]*)", 1), "outside": F.when(href.startswith("http"), href)}
    raw["url"] = F.when(href.startswith("http"), raw["url"])
    each = nodes.filter(~F.col("root")).withColumns({f"_{k}": F.nullif(F.coalesce(raw[k], F.lit("")), F.lit("")) for k in _READINGS}).withColumn("selector", F.explode("selectors"))
    firsts = each.groupBy("page_id", "item", "selector").agg(*(F.min(F.when(F.col(f"_{k}").isNotNull(), F.struct("node", f"_{k}")))[f"_{k}"].alias(k) for k in _READINGS))
    pairs = F.array(*(F.struct(F.lit(k).alias("reading"), F.col(k).alias("value")) for k in _READINGS))
    return firsts.select("page_id", "item", "selector", F.inline(pairs)).filter("value is not null")


def candidates(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(page_id, field, guesser, place, selector, bonus): what may choose a field, in the order to try; for names a bonus by structure. hosts: page_id, host."""
    inside = nodes.filter(~F.col("root"))
    hints = {f: F.col("names").rlike(_any_of(w)) for f, w in CLASS_WORDS.items()}
    # Words in classes and ids, and links to other hosts: one row for each field that an element may be of.
    out = F.regexp_extract("href", r"(?i)^https?://(?:www\.)?([^/?#:]+)", 1)
    entries = [F.when(hint, F.struct(F.lit(f).alias("field"), F.lit("class").alias("guesser"))) for f, hint in hints.items() if f != "company_name"]
    entries.append(F.when((F.col("tag") == "a") & (out != "") & ~F.contains(F.lower(out), F.col("host")), F.struct(F.lit("website").alias("field"), F.lit("link").alias("guesser"))))
    marked = inside.join(hosts.select("page_id", "host"), "page_id").select("page_id", "item", "node", "css", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    # The smallest element of a record that has a text of the field's shape; headings and the first text for names.
    other = F.coalesce(F.col("names").rlike(_any_of([w for f, ws in CLASS_WORDS.items() if f != "company_name" for w in ws])), F.lit(False))
    shaped = {f: F.min(F.when(F.col("text").rlike(TEXT_SHAPES[f]), F.struct(F.length("text"), "node", "css")))["css"] for f in ("email", "phone", "tax_id", "address")}
    first = F.min(F.when(F.col("leaf") & ~other & ~validate.is_not_a_name("text", LINK_WORDS), F.struct("node", "css")))["css"]
    heading = F.min(F.when(F.col("tag").isin(*listing.HEADS), F.struct("node", "css")))["css"]
    per_item = inside.groupBy("page_id", "item").agg(F.min("node").alias("node"), *(c.alias(f) for f, c in shaped.items()), first.alias("first"), heading.alias("heading"))
    by_shape = per_item.select("page_id", "item", "node", F.inline(F.array(*(F.struct(F.col(f).alias("css"), F.lit(f).alias("field"), F.lit("shape").alias("guesser")) for f in shaped)))).filter("css is not null")
    counted = marked.unionByName(by_shape).groupBy("page_id", "field", "guesser", "css").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("item", "node")).alias("at"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "field", "guesser").orderBy(F.desc("n"), "at")))
    most = F.when(F.col("guesser") == "class", 4).otherwise(3)
    tried = ranked.filter(F.col("place") <= most).select("page_id", "field", "guesser", "place", F.col("css").alias("selector"), F.lit(0.0).alias("bonus"))
    # Names: every sign adds to an element's weight.
    weights = F.array(F.when(F.col("tag").isin("a", "strong", "b") & F.length("text").between(2, 80), 1.0), F.when(hints["company_name"], 2.0))
    signs = inside.select("page_id", "css", F.explode(weights).alias("w")).unionByName(per_item.select("page_id", F.inline(F.array(F.struct(F.col("first").alias("css"), F.lit(2.0).alias("w")), F.struct(F.col("heading").alias("css"), F.lit(3.0).alias("w"))))))
    heavy = signs.filter("w is not null and css is not null").groupBy("page_id", "css").agg(F.sum("w").alias("bonus"))
    named = heavy.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("bonus"), "css"))).filter("place <= 12")
    return tried.unionByName(named.select("page_id", F.lit("company_name").alias("field"), F.lit("name").alias("guesser"), "place", F.col("css").alias("selector"), "bonus"))


#: For each field, in the order to try, who guessed, how the value is read. An empty guesser tries every link.
WAYS = {
    "company_name": [("name", "text")],
    "email": [("", "mailto"), ("shape", "email")],
    "phone": [("", "tel"), ("class", "text"), ("shape", "phone")],
    "website": [("link", "url"), ("link", "outside"), ("class", "text")],
    "address": [("class", "text"), ("shape", "address")],
    "tax_id": [("class", "text"), ("shape", "tax_id")],
} | {f: [("class", "text")] for f in ("industry", "contact_person", "english_name", "fax", "products")}


def guessed_fields(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(page_id, field, selector, reading, hit_rate, samples): for each field the first rule that hits often enough and, where values are a company's own, differs by record; for names the one whose values look most like names."""
    values, found = read_values(nodes), candidates(nodes, hosts)
    n_items = nodes.filter("root").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_items"))
    v = F.col("value")
    usable = ~validate.is_not_a_name(v, LINK_WORDS)
    share = lambda c: F.avg(F.when(usable, c.cast("double")))
    judged = values.groupBy("page_id", "selector", "reading").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("value").alias("n_distinct"), F.avg(usable.cast("double")).alias("usable"), share(v.rlike(TEXT_SHAPES["address"])).alias("addresses"),
        share(validate.has_company_marker(v) & ~v.rlike(TEXT_SHAPES["address"])).alias("marked"), share(F.length(v)).alias("length"), F.transform(F.array_sort(F.collect_set(F.when(F.col("item") < 3, F.struct("item", F.substring("value", 1, 80).alias("value"))))), lambda s: s["value"]).alias("samples"),
    ).join(n_items, "page_id")
    rows = [(f, g, r, k) for f, ways in WAYS.items() for k, (g, r) in enumerate(ways)]
    ways = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(g).alias("guesser"), F.lit(r).alias("reading"), F.lit(k).alias("way")) for f, g, r, k in rows))
    links = n_items.select("page_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.lit("").alias("guesser"), F.lit(1).alias("place"), F.lit("a").alias("selector"), F.lit(0.0).alias("bonus")) for f in ("email", "phone")))))
    tried = found.unionByName(links).withColumn("w", F.explode(F.filter(ways, lambda w: (w["field"] == F.col("field")) & (w["guesser"] == F.col("guesser"))))).select("page_id", "field", "selector", "place", "bonus", "w.reading", "w.way")
    rate, distinct = F.col("hits") / F.col("n_items"), F.col("n_distinct") / F.col("hits")
    score = name_score(distinct, F.col("marked"), F.col("usable"), rate, F.when(F.col("length") < 3, 99).otherwise(F.col("length"))) + F.least(F.col("bonus") / F.col("n_items"), F.lit(1.0))
    is_name = F.col("field") == "company_name"
    own = F.col("field").isin(OWN_FIELDS) & (F.col("hits") > 2)
    good = (rate >= LEAST_HITS) & F.when(is_name, (distinct >= LEAST_DISTINCT) & (F.col("usable") > 0) & (F.col("addresses") <= 0.5) & (score >= LEAST_NAME_SCORE)).otherwise(~own | (distinct >= LEAST_DISTINCT))
    ok = tried.join(judged, ["page_id", "selector", "reading"]).filter(good)
    # Website links are tried link by link, each read as text first; other fields guesser by guesser.
    link = F.col("reading").isin("url", "outside")
    order = F.struct(F.when(is_name, -score).otherwise(0.0).alias("score"), F.when(link, 0).otherwise(F.col("way")).alias("way"), "place", F.col("way").alias("reading_way"))
    best = ok.groupBy("page_id", "field").agg(F.min_by(F.struct("selector", "reading", F.round(rate, 4).alias("hit_rate"), "samples"), order).alias("b"))
    return best.select("page_id", "field", "b.*")


def rule_selector(selector: Column | str, reading: Column | str) -> Column:
    """The selector as a rule states it: link targets only of such links."""
    s, r = (F.col(x) if isinstance(x, str) else x for x in (selector, reading))
    return F.when(r == "mailto", F.concat(s, F.lit("[href^='mailto:']"))).when(r == "tel", F.concat(s, F.lit("[href^='tel:']"))).when(r.isin("url", "outside"), F.concat(s, F.lit("[href^='http']"))).otherwise(s)


def detail_links(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(page_id, selector): links of the same site that most records have and that differ by record; of the four most frequent the first that does."""
    n_items = nodes.filter("root").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_items"))
    links = nodes.filter("not root and tag = 'a' and href is not null").join(hosts.select("page_id", "host"), "page_id")
    target = F.lower(F.regexp_extract("href", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:www\.)?([^/?#]+)", 1))
    to_page = ~F.col("href").rlike("(?i)^(?:#|mailto:|tel:|javascript:)")
    css = links.filter(to_page & ((target == "") | (target == F.col("host")))).groupBy("page_id", "css").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("item", "node")).alias("at"))
    top = css.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "at"))).filter("place <= 4").join(n_items, "page_id").filter(F.col("n") >= F.col("n_items") * LEAST_HITS)
    targets = links.select("page_id", "href", F.explode("selectors").alias("css")).join(top.select("page_id", "css", "n", "place"), ["page_id", "css"]).groupBy("page_id", "css", "n", "place").agg(F.count_distinct("href").alias("n_targets"))
    return targets.filter(F.col("n_targets") >= F.greatest(F.lit(2.0), F.col("n") * 0.7)).groupBy("page_id").agg(F.min_by("css", "place").alias("selector"))


# Buttons and forms


def page_actions(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, action, selector): click_all for buttons that half of the records have to show what is hidden, the two most frequent; click for the page's first button that loads more.

    nodes: item_nodes(); elements: pages.nodes(), of whole pages, those with one of MORE_TAGS at least.
    """
    n_items = nodes.filter("root").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_items"))
    reveal = nodes.filter(~F.col("root") & F.col("tag").isin("button", "a", "span", "div") & F.lower("text").rlike(_any_of(REVEAL_WORDS)))
    counted = reveal.groupBy("page_id", "css").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "css")))
    every = counted.filter("place <= 2").join(n_items, "page_id").filter(F.col("n") >= F.col("n_items") * 0.5).select("page_id", F.lit("click_all").alias("action"), F.col("css").alias("selector"))
    names = F.filter(F.split("class", " "), lambda c: (F.length(c) > 1) & ~c.rlike(rf"^(?:\d+|{LAYOUT_CLASS})$"))
    more = elements.filter(F.col("tag").isin(MORE_TAGS) & F.lower("text").rlike(_any_of(MORE_WORDS)))
    once = more.groupBy("page_id").agg(F.min(F.struct("node", F.concat_ws(".", "tag", F.get(names, F.lit(0))).alias("css")))["css"].alias("selector"))
    return every.unionByName(once.select("page_id", F.lit("click").alias("action"), "selector"))


_CONTROLS = "page_id long, node int, kind string, selector string, options array<string>, scopes array<struct<node:int,last:int>>"


def controls(pages: DataFrame) -> DataFrame:
    """Query controls of pages: menus, text fields and buttons that send (outside of dialogues): node, kind, selector, options (shown texts), scopes (the nearest four ancestors, then the form)."""

    def send(page: Page, n: list) -> bool:
        a, t = page.attributes[n[0]], n[2]
        if t == "input" and a.get("type", "").lower() not in ("submit", "button", "image"):
            return False
        said = " ".join([page.text(n[0]), *(a.get(k, "") for k in ("value", "title", "aria-label", "class", "id"))]).lower()
        icon = t == "button" and any(m[2] == "i" for m in page.nodes[n[0] + 1 : n[7] + 1])
        return icon or any(w in said for w in SUBMIT_WORDS)

    def up(page: Page, node: int) -> list[int]:
        out = []
        while (node := page.nodes[node][1]) >= 0:
            out.append(node)
        return out

    def chosen_alone(page: Page, node: int) -> str:
        a, tag = page.attributes[node], page.nodes[node][2]
        if a.get("id", "").strip():
            return f"#{a['id'].strip()}"
        named = [c for c in _classes(page, node) if len(c) > 1 and not re.fullmatch(LAYOUT_CLASS, c) and c.lower() not in fixed.ALTERNATING_CLASSES]
        own = f"{tag}.{max(named, key=lambda c: (any(w in c.lower() for w in SUBMIT_WORDS), len(c)))}" if named else tag
        for anchor in (None, *(_anchor(page, k) for k in up(page, node))):
            wider = f"{anchor} {own}" if anchor else own
            if len(selected(page, wider)) == 1:
                return wider
        return own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                page = Page(html)
                for n in page.nodes:
                    a, ancestors = page.attributes[n[0]], up(page, n[0])
                    if n[2] == "select":
                        kind = "menu"
                    elif n[2] == "input" and a.get("type", "text").lower() in ("text", "search", ""):
                        kind = "text"
                    elif n[2] in ("button", "input", "a") and send(page, n):
                        kind = "send"
                        if any(w in f"{page.attributes[k].get('class', '')} {page.attributes[k].get('id', '')}".lower() for k in [n[0], *ancestors[:7]] for w in DIALOGUE_WORDS):
                            continue
                    else:
                        continue
                    options = [page.text(m[0]) for m in page.nodes[n[0] + 1 : n[7] + 1] if m[2] == "option" and page.attributes[m[0]].get("value", "").strip()]
                    form = [k for k in ancestors if page.nodes[k][2] == "form"][:1]
                    scopes = [(k, page.nodes[k][7]) for k in dict.fromkeys(ancestors[:4] + form)]
                    rows.append((page_id, n[0], kind, chosen_alone(page, n[0]) if kind == "send" else _anchor(page, n[0]) or n[2], options, scopes))
            yield pd.DataFrame(rows, columns=["page_id", "node", "kind", "selector", "options", "scopes"])

    return spread(pages.select("page_id", "html")).mapInPandas(run, _CONTROLS)


def query_forms(found: DataFrame, least: int = 4) -> DataFrame:
    """(page_id, input, submit, n_options, sample, text_input, text_submit): the menu with most options that has a button near, and the first text field with one, which counts as input where there is no menu. found: controls()."""
    inputs = found.filter((F.col("kind") == "text") | ((F.col("kind") == "menu") & (F.size("options") >= least))).select("page_id", "node", "kind", "selector", "options", F.posexplode("scopes").alias("near", "scope"))
    sends = found.filter("kind = 'send'").select("page_id", F.col("node").alias("b"), F.col("selector").alias("submit"))
    both = inputs.join(sends, "page_id").filter((F.col("b") > F.col("scope.node")) & (F.col("b") <= F.col("scope.last")) & (F.col("b") != F.col("node")))
    paired = both.groupBy("page_id", "node", "kind", "selector", "options").agg(F.min(F.struct("near", "b", "submit"))["submit"].alias("submit"))
    order = F.struct((-F.size("options")).alias("fewer"), "node", "selector", "submit", "options")
    per = paired.groupBy("page_id").agg(F.min(F.when(F.col("kind") == "menu", order)).alias("m"), F.min(F.when(F.col("kind") == "text", F.struct("node", "selector", "submit"))).alias("t"))
    return per.select(
        "page_id", F.coalesce("m.selector", "t.selector").alias("input"), F.coalesce("m.submit", "t.submit").alias("submit"), F.coalesce(-F.col("m.fewer"), F.lit(0)).alias("n_options"),
        F.slice(F.coalesce("m.options", F.array().cast("array<string>")), 1, 3).alias("sample"), F.when(F.col("m").isNotNull(), F.col("t.selector")).alias("text_input"), F.when(F.col("m").isNotNull(), F.col("t.submit")).alias("text_submit"),
    )


def option_at(options: Column | str, labels: Column | str, said: Column | str, last: bool = False) -> Column:
    """The place, from 0, of the first option (or last) whose value or label holds what was said; null if none does."""
    values, shown, needle = (F.col(c) if isinstance(c, str) else c for c in (options, labels, said))
    needle = F.lower(F.trim(needle))
    hits = F.filter(F.transform(values, lambda v, i: F.when(F.contains(F.lower(v), needle) | F.coalesce(F.contains(F.lower(F.get(shown, i)), needle), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.when(needle != "", F.get(hits, F.size(hits) - 1 if last else F.lit(0)))


# The whole


def previewed(nodes: DataFrame, fields: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, item, fields, extra) of the first ``most`` records, as a run would give them: by the guessed rules, gaps filled by labels in the text; records without a name and advertisements left out."""
    first = nodes.filter(F.col("item") < most)
    rules = fields.select("page_id", "field", "selector", "reading")
    values = read_values(first).join(rules, ["page_id", "selector", "reading"]).groupBy("page_id", "item").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    texts = first.filter("root").select("page_id", "item", "text").withColumn("l", listing.labelled("text"))
    both = texts.join(values, ["page_id", "item"])
    enough = F.size("l.fields") + F.size("l.extra") >= 2
    filled = with_labels(F.col("fields"), F.col("l.fields"), enough)
    name = F.try_element_at("fields", F.lit("company_name"))
    kept = both.filter(blank_to_null(name).isNotNull() & validate.why_not_a_company(name, F.coalesce(F.try_element_at("fields", F.lit("website")), F.lit(""))).isNull())
    return kept.select("page_id", "item", filled.alias("fields"), F.when(enough, F.col("l.extra")).otherwise(F.create_map().cast("map<string,string>")).alias("extra"))


def with_labels(values: Column, labelled: Column, enough: Column) -> Column:
    """A map of values with what labels say of those that are missing or blank; nothing where there are not enough labels."""
    return F.when(enough, F.map_zip_with(values, labelled, lambda k, v, new: F.coalesce(blank_to_null(v), new))).otherwise(values)


def estimated_records(n_items: Column | str, n_pages: Column | str) -> Column:
    return (F.col(n_items) if isinstance(n_items, str) else n_items) * F.greatest(F.coalesce(F.col(n_pages) if isinstance(n_pages, str) else n_pages, F.lit(1)), F.lit(1))


def notes(pages: DataFrame, scopes: DataFrame, fields: DataFrame, details: DataFrame, next_links: DataFrame, forms: DataFrame) -> DataFrame:
    """(page_id, note, about): what a user should look at: no_list, no_name, wide_selector, weak_field (hit under 0.6 of the records), contacts_on_details, no_next, query_form."""
    per = fields.groupBy("page_id").agg(F.collect_set("field").alias("have"), F.collect_list(F.when(F.col("hit_rate") < 0.6, F.col("field"))).alias("weak"))
    all_ = pages.select("page_id").join(scopes, "page_id", "left").join(per, "page_id", "left").join(details.withColumnRenamed("selector", "detail"), "page_id", "left").join(next_links, "page_id", "left").join(forms.select("page_id", "n_options"), "page_id", "left")
    have = F.coalesce("have", F.array().cast("array<string>"))
    listed = F.col("selector").isNotNull()
    note = lambda when, name, about: F.when(when, F.struct(F.lit(name).alias("note"), about.alias("about")))
    empty = F.lit("")
    single = F.array(
        note(~listed, "no_list", empty),
        note(listed & ~F.array_contains(have, "company_name"), "no_name", empty),
        note(listed & (F.col("n_chosen") > F.col("n_items") * 1.5), "wide_selector", F.col("n_chosen").cast("string")),
        note(listed & F.col("detail").isNotNull() & ~F.arrays_overlap(have, F.array(F.lit("email"), F.lit("phone"))), "contacts_on_details", F.col("detail")),
        note(listed & F.col("next").isNull(), "no_next", empty),
        note(F.col("n_options").isNotNull(), "query_form", F.col("n_options").cast("string")),
    )
    weak = F.transform(F.array_sort(F.coalesce("weak", F.array().cast("array<string>"))), lambda f: F.struct(F.lit("weak_field").alias("note"), f.alias("about")))
    return all_.select("page_id", F.inline(F.concat(F.filter(single, lambda n: n.isNotNull()), weak)))


def records_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of pages, drilled, and their item_nodes(). Both are checkpointed: all guesses read them, and none parses pages again."""
    outer = stage(listing.list_blocks(listing.list_items(pages)))
    blocks = stage(drilled(outer, stage(item_nodes(pages, outer))))
    return blocks, stage(item_nodes(pages, blocks))


def discovered(pages: DataFrame) -> dict[str, DataFrame]:
    """All guesses about listing pages (page_id, url, html): blocks, scopes, fields, details, next, actions, forms, preview, notes."""
    hosts = pages.select("page_id", F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#]*)", 1)).alias("host"))
    blocks, nodes = records_of(pages)
    out = {"blocks": blocks, "scopes": scoped(pages, blocks), "fields": guessed_fields(nodes, hosts), "details": detail_links(nodes, hosts), "next": listing.next_links(pages), "actions": page_actions(nodes, listing.nodes(pages, MORE_TAGS)), "forms": query_forms(controls(pages))}
    out["preview"] = previewed(nodes, out["fields"])
    out["notes"] = notes(pages, out["scopes"], out["fields"], out["details"], out["next"], out["forms"])
    return out
