"""Selectors as joins against a plain matcher on random trees."""

import random
import re

import pytest

from rolodexter.sources import selectors
from rolodexter.sources.extraction import Page, Rule

SELECTORS = [
    "div", "*", ".a", "#i3", "div.a", "div p", "div > p", "p + p", "p ~ span", "div .a > p", "ul li p", "div > div > p", "div div div", ".a.b", "[x]", "[x=y]", "[x='y z']", "[x^=y]", "[x$=z]", "[x*=\"y\"]", "[x~=z]", "[x|=y]",
    "p:nth-child(2)", "p:nth-child(2n+1)", "*:nth-child(-n+2)", "li:nth-child(odd)", "div:first-child", "p:last-child", ":only-child", "*:nth-last-child(2)", "div:not(.a)", "p:not([x])", "div, span", "div > p, .b, ul + p", "ul > li + li", "div p + span", "div ~ div .a", ".a > *:nth-child(even)",
]


def tree(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4) if depth < 5 else 0):
        tag = rng.choice(["div", "p", "span", "ul", "li"] if depth < 4 else ["p", "span"])
        if tag in ("p", "li") and rng.random() < 0.7:
            tag = "div"
        a = "".join(x for x in (rng.choice([' class="a"', ' class="b a"', ' class="b"', ""]), rng.choice([' x="y"', ' x="y z"', ' x="y-q"', " x", "", ""]), f' id="i{rng.randint(0, 9)}"' if rng.random() < 0.2 else ""))
        out += f"<{tag}{a}>{rng.choice(['', 'text ', 'A &amp; B'])}{tree(rng, depth + 1) if tag not in ('p', 'li') else ''}</{tag}>"
    return out


def plain_step(page, node, step):
    """One compound of tag, classes, ids, attributes and places, by hand."""
    n, a = page.nodes[node], page.attributes[node]
    siblings = [m[0] for m in page.nodes if m[1] == n[1]]
    at = siblings.index(node) + 1
    for kind, x in step:
        ok = {
            "tag": lambda x: x == "*" or n[2] == x, "class": lambda x: x in (a.get("class") or "").split(), "id": lambda x: a.get("id") == x,
            "attr": lambda x: x[0] in a and (x[1] is None or {"=": a[x[0]] == x[2], "^=": a[x[0]].startswith(x[2]), "$=": a[x[0]].endswith(x[2]), "*=": x[2] in a[x[0]], "~=": x[2] in a[x[0]].split(), "|=": a[x[0]] == x[2] or a[x[0]].startswith(x[2] + "-")}[x[1]]),
            "place": lambda x: x(at, len(siblings)), "not": lambda x: not plain_step(page, node, x),
        }[kind](x)
        if not ok:
            return False
    return True


PLACES = {"2": lambda i, n: i == 2, "2n+1": lambda i, n: i % 2 == 1, "-n+2": lambda i, n: i <= 2, "odd": lambda i, n: i % 2 == 1, "even": lambda i, n: i % 2 == 0}


def plain_compound(text):
    out = []
    for tag, cls, id_, attr, op, value, pseudo, arg in re.findall(r"^([a-z*]+)|\.([a-z]+)|#(\w+)|\[(\w+)(?:([~|^$*]?=)[\"']?([^\"'\]]*)[\"']?)?\]|:([a-z-]+)(?:\(([^)]*)\))?", text):
        if tag:
            out.append(("tag", tag))
        if cls:
            out.append(("class", cls))
        if id_:
            out.append(("id", id_))
        if attr:
            out.append(("attr", (attr, op or None, value)))
        if pseudo == "not":
            out.append(("not", plain_compound(arg)))
        elif pseudo == "nth-child":
            out.append(("place", PLACES[arg]))
        elif pseudo:
            out.append(("place", {"first-child": lambda i, n: i == 1, "last-child": lambda i, n: i == n, "only-child": lambda i, n: n == 1, "nth-last-child": lambda i, n: n - i + 1 == 2}[pseudo]))
    return out


def plain_match(page, node, parts):
    """parts: [(combinator, compound)], the last for the node itself; tries every ancestor or sibling."""
    join, step = parts[-1]
    if not plain_step(page, node, step):
        return False
    if len(parts) == 1:
        return True
    parent = page.nodes[node][1]
    before = [m[0] for m in page.nodes if m[1] == parent and m[0] < node]
    up, at = [], parent
    while at >= 0:
        up.append(at)
        at = page.nodes[at][1]
    tried = {" ": up, ">": up[:1], "+": before[-1:], "~": before}[join]
    return any(plain_match(page, k, parts[:-1]) for k in tried)


def plain_selected(page, selector):
    found = set()
    for one in re.split(r",\s*", selector):
        tokens = re.findall(r"\s*[>+~]\s*(?![^\[(]*[\])])|\s+(?![^\[(]*[\])])|(?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+", one)
        parts, join = [], " "
        for t in tokens:
            if t.strip() in ("", ">", "+", "~"):
                join = t.strip() or " "
            else:
                parts.append((join, plain_compound(t)))
        found |= {n[0] for n in page.nodes if plain_match(page, n[0], parts)}
    return found


def test_selectors_as_joins(spark):
    rng = random.Random(12)
    htmls = {k: f"<main>{tree(rng)}</main>" for k in range(14)} | {50: "", 51: None, 52: "no tags", 53: "<p>un<div>closed"}
    table = selectors.parsed(spark.createDataFrame(list(htmls.items()), "page_id long, html string")).cache()
    pages = {k: Page(h) for k, h in htmls.items()}
    hits = 0
    for s in SELECTORS:
        got = {(r["page_id"], r["node"]) for r in selectors.selected(table, s).collect()}
        assert got == {(k, n) for k, p in pages.items() for n in plain_selected(p, s)}, s
        hits += bool(got)
    assert hits >= len(SELECTORS) - 3
    table.unpersist()


@pytest.mark.parametrize("bad", ["", "div >", "div,,p", "a:hover", "[x", "p:nth-child(x)", "> p"])
def test_what_is_no_selector(spark, bad):
    table = selectors.parsed(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string"))
    with pytest.raises(ValueError):
        selectors.selected(table, bad)


def test_records_by_selectors(spark):
    card = "<div class='card'><h3>Firm {0} &amp; Co</h3><ul><li>tel <b>02-{0}</b></li><li><b>fax</b></li></ul><a href='/c/{0}'>more</a><a href='https://x.tw/{0}'>site</a></div>"
    html = "<main><div class=card><i>none</i></div>" + "".join(card.format(k) for k in range(3)) + "</main>"
    rows = spark.createDataFrame([(1, html, "http://a.tw/list/"), (2, None, "http://b.tw")], "page_id long, html string, url string")
    rules = {
        "name": Rule("h3"), "tel": Rule("ul > li:nth-child(1)", regex=r"tel (\S+)"), "link": Rule("a:not([href^=http])", "href"), "links": Rule("a", "href", multiple=True, separator=" "),
        "bold": Rule("li b", multiple=True, separator="|"), "after": Rule("a + a"), "none": Rule("em"),
    }
    got = [r.asDict() for r in selectors.extracted(rows, "main > .card", rules).orderBy("item").collect()]
    assert got == [{"page_id": 1, "item": k + 1, "name": f"Firm {k} & Co", "tel": f"02-{k}", "link": f"http://a.tw/c/{k}", "links": f"http://a.tw/c/{k} https://x.tw/{k}", "bold": f"02-{k}|fax", "after": "site", "none": None} for k in range(3)]
