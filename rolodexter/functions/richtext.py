"""Message bodies as documents: lines of styled runs, read from HTML or plain text, with HTML and plain text as two renderings of one document.

Reading takes a parser; both renderings are expressions, so a stored document is rendered without Python.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("styles", T.ArrayType(T.StringType())), T.StructField("link", T.StringType()), T.StructField("image", T.StringType())])
LINE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("runs", T.ArrayType(RUN))])
DOCUMENT = T.ArrayType(LINE)

#: Elements that make a text markup; elements that are lines, and of what kind; elements that style; how kinds and styles are written, inner ones first.
MARKUP = r"(?i)<(?:p|br|div|ul|li|h[1-6]|strong|b|em|i|u|a|img)\b[^>]*>"
KIND_OF = {"p": "text", "div": "text", "h1": "text", "h2": "title", "h3": "heading", "h4": "heading", "li": "bullet"}
STYLE_OF = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline"}
ELEMENT_OF = {"title": "h2", "heading": "h3", "bullet": "li"}
WRITTEN = [("bold", "strong"), ("italic", "em"), ("underline", "u")]
BULLET, PICTURE = "・", "圖片："


class _Reading(HTMLParser):
    """Lines out of markup. Unknown elements are left out, never their text; white space between them is the source's layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, list[tuple]]] = []
        self.runs: list[tuple] = []
        self.kind, self.owed = "text", False  # owed: the block that is open has given no line yet
        self.styles: list[str] = []
        self.link: str | None = None

    def end_line(self) -> None:
        self.lines.append((self.kind, self.runs))
        self.runs, self.kind, self.owed = [], "text", False  # what follows a break within a block is plain text

    def add(self, text: str, image: str | None = None) -> None:
        styles = sorted(set(self.styles))
        if self.runs and not image and not self.runs[-1][3] and self.runs[-1][1:3] == (styles, self.link):
            self.runs[-1] = (self.runs[-1][0] + text, styles, self.link, None)
        else:
            self.runs.append((text, styles, self.link, image))

    def handle_starttag(self, tag, attrs):
        if tag in KIND_OF:
            if self.runs:
                self.end_line()
            self.kind, self.owed = KIND_OF[tag], True
        elif tag == "br":
            self.end_line()
        elif tag in STYLE_OF:
            self.styles.append(STYLE_OF[tag])
        elif tag == "a":
            self.link = dict(attrs).get("href") or None
        elif tag == "img" and dict(attrs).get("src"):
            self.add("", dict(attrs)["src"])

    def handle_endtag(self, tag):
        if tag in KIND_OF and (self.runs or self.owed):
            self.end_line()
        elif tag in STYLE_OF and STYLE_OF[tag] in self.styles:
            self.styles.remove(STYLE_OF[tag])
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        text = " ".join(data.split()) if data.strip() else ""
        if text:
            text = " " * data[:1].isspace() + text + " " * data[-1:].isspace()
        elif self.runs:
            text = " "
        if text:
            self.add(text)


def lines_of(source: str | None) -> list[tuple[str, list[tuple]]]:
    if not source or not re.search(MARKUP, source):
        return [("text", [(x, [], None, None)] if x else []) for x in (source or "").split("\n")]
    reading = _Reading()
    reading.feed(source)
    reading.close()
    if reading.runs:
        reading.end_line()
    return reading.lines or [("text", [])]


@F.pandas_udf(DOCUMENT)
def _document(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [{"kind": k, "runs": [dict(zip(("text", "styles", "link", "image"), r, strict=True)) for r in runs]} for k, runs in lines_of(b)])


def document(body: Column | str) -> Column:
    """The document of a body: array<struct<kind, runs: array<struct<text, styles, link, image>>>>. A text without markup is a line for each of its lines; null is one empty line."""
    return _document(col(body))


def _escaped(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def _run_html(r: Column) -> Column:
    inner = F.replace(_escaped(r["text"]), F.lit("\n"), F.lit("<br>"))
    for style, tag in WRITTEN:
        inner = F.when(F.array_contains(r["styles"], style), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)
    linked = F.when(r["link"].isNotNull(), F.concat(F.lit('<a href="'), _escaped(r["link"]), F.lit('">'), inner, F.lit("</a>"))).otherwise(inner)
    return F.when(r["image"].isNotNull(), F.concat(F.lit('<img src="'), _escaped(r["image"]), F.lit('">'))).when(r["text"] == "", "").otherwise(linked)


def to_html(doc: Column | str) -> Column:
    """A document as HTML: a line of markup for each line; list items that follow each other share a list."""
    d = col(doc)

    def line(x: Column, i: Column) -> Column:
        inner = F.array_join(F.transform(x["runs"], _run_html), "")
        out = F.when(F.trim(inner) != "", F.concat(F.lit("<p>"), inner, F.lit("</p>"))).otherwise("<p><br></p>")
        for kind, tag in ELEMENT_OF.items():
            out = F.when(x["kind"] == kind, F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(out)
        is_item = lambda k: F.coalesce(F.get(d, k)["kind"] == "bullet", F.lit(False))
        mine = x["kind"] == "bullet"
        before = F.when((i > 0) & is_item(i - 1), True).otherwise(False)
        return F.concat(F.when(mine & ~before, "<ul>\n").otherwise(""), out, F.when(mine & ~is_item(i + 1), "\n</ul>").otherwise(""))

    return F.array_join(F.transform(d, line), "\n")


def to_text(doc: Column | str) -> Column:
    """A document as plain text: list items with a dot, pictures and links that the text doesn't show with their address."""

    def line(x: Column) -> Column:
        said = F.trim(F.array_join(F.transform(x["runs"], lambda r: F.when(r["image"].isNotNull(), F.concat(F.lit(f"[{PICTURE}"), r["image"], F.lit("]"))).otherwise(r["text"])), ""))
        said = F.when((x["kind"] == "bullet") & (said != ""), F.concat(F.lit(BULLET), said)).otherwise(said)
        links = F.array_distinct(F.filter(F.transform(x["runs"], lambda r: r["link"]), lambda u: u.isNotNull()))
        return F.aggregate(links, said, lambda out, u: F.when(F.contains(out, u), out).otherwise(F.concat(out, F.lit("（"), u, F.lit("）"))))

    return F.btrim(F.array_join(F.transform(col(doc), line), "\n"), F.lit(" \n"))


def is_blank(doc: Column | str) -> Column:
    """Whether a document shows nothing."""
    return ~F.exists(col(doc), lambda x: F.exists(x["runs"], lambda r: (F.trim(r["text"]) != "") | r["image"].isNotNull()))
