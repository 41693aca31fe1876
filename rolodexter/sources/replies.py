"""What a language model answered as tables: the objects of a reply out of fences, prefaces and wrappings, held as VARIANT, and grounded in the page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.research import grounded
from .pages import _let

#: Fixed value: objects of a reply that count.
MOST_ITEMS = 300

_OBJECT, _LIST = "map<string,variant>", "array<variant>"


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def whole_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; Spark's parser alone stops behind the first value."""
    return _let(_as(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), _LIST), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))


def unfenced(reply: Column | str) -> Column:
    """A reply without the fence of a code block around it."""
    text = F.trim(F.regexp_replace(F.coalesce(col(reply), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(text.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[A-Za-z0-9_-]*\s*", ""), r"\s*```$", ""))).otherwise(text)


def _between(text: Column, opening: str, closing: str) -> Column:
    """From the first opening bracket to the last closing one."""
    start, end = F.locate(opening, text), F.length(text) - F.locate(closing, F.reverse(text)) + 1
    return F.when((start > 0) & (F.locate(closing, text) > 0) & (start < end), F.substring(text, start, end - start + 1))


def complete_objects(text: Column) -> Column:
    """The outermost objects of a text that are whole, as text: what a reply that was cut off still says. One pass over its characters that knows strings and escapes."""
    start = F.struct(
        F.array().cast("array<int>").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.array().cast("array<struct<depth:int,a:int,b:int>>").alias("found")
    )

    def step(s: Column, c: Column) -> Column:
        at, depth = s["at"] + 1, F.size(s["open"])
        opens, closes = ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}") & (depth > 0)
        cut = F.struct(depth.alias("depth"), F.element_at(s["open"], -1).alias("a"), at.alias("b"))
        return F.struct(
            F.when(opens, F.array_append(s["open"], at)).when(closes, F.slice(s["open"], F.lit(1), depth - 1)).otherwise(s["open"]).alias("open"),
            F.when(s["quoted"], s["escaped"] | (c != '"')).otherwise(c == '"').alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            at.alias("at"),
            F.when(closes, F.array_append(s["found"], cut)).otherwise(s["found"]).alias("found"),
        )

    cuts = F.aggregate(F.split(text, ""), start, step, lambda s: s["found"])
    outer = lambda found: F.filter(found, lambda x: x["depth"] == F.array_min(F.transform(found, lambda y: y["depth"])))
    return _let(cuts, lambda found: F.transform(outer(found), lambda x: F.substring(text, x["a"], x["b"] - x["a"] + 1)))


def parsed(reply: Column | str) -> Column:
    """struct<status, items, others>: the objects of a reply as VARIANT and how many of its elements are none.

    A reply is JSON, or has a list or else an object between its brackets. An object that holds a list means the first one, else itself. status: ok, empty, no list (other JSON),
    cut off (no JSON, but whole objects: these), or no JSON.
    """

    def chosen(text: Column) -> Column:
        tries = [text, _between(text, "[", "]"), _between(text, "{", "}")]
        first = F.filter(F.array(*tries), lambda t: whole_json(t).isNotNull())
        return F.struct(text.alias("text"), F.get(first, F.lit(0)).alias("json"))

    def listed(c: Column) -> Column:
        v = whole_json(c["json"])
        held = _as(v, _OBJECT)
        # The keys in the order of the text, which VARIANT does not keep.
        lists = F.filter(F.transform(F.json_object_keys(c["json"]), lambda k: _as(F.try_element_at(held, k), _LIST)), lambda x: x.isNotNull())
        saved = F.when(c["json"].isNull() & F.contains(c["text"], F.lit("{")), F.filter(F.transform(complete_objects(c["text"]), F.try_parse_json), lambda x: x.isNotNull()))
        found = F.coalesce(_as(v, _LIST), F.get(lists, F.lit(0)), F.when(held.isNotNull(), F.array(v)))
        return F.struct(c["text"].alias("text"), c["json"].isNotNull().alias("json"), found.alias("found"), saved.alias("saved"))

    def judged(c: Column) -> Column:
        objects = F.filter(F.coalesce(c["found"], c["saved"], F.array().cast(_LIST)), lambda x: _as(x, _OBJECT).isNotNull())
        status = F.when(c["text"] == "", "empty").when(c["found"].isNotNull(), "ok").when(c["json"], "no list").when(F.coalesce(F.size(c["saved"]), F.lit(0)) > 0, "cut off").otherwise("no JSON")
        return F.struct(status.alias("status"), objects.alias("items"), (F.coalesce(F.size(c["found"]), F.lit(0)) - F.when(c["found"].isNotNull(), F.size(objects)).otherwise(0)).alias("others"))

    return _let(_let(_let(unfenced(reply), chosen), listed), judged)


def said(item: Column, field: str) -> Column:
    """A field of an object as text: of text and numbers, not of lists, objects and truth values."""
    path = "$['" + field.replace("'", "\\'") + "']"
    kind = F.schema_of_variant(F.try_variant_get(item, path, "variant"))
    return F.when(~kind.rlike("^(ARRAY|OBJECT|BOOLEAN|VOID)"), F.try_variant_get(item, path, "string"))


def reply_items(replies: DataFrame, reply: str, fields: Sequence[str], most: int = MOST_ITEMS) -> DataFrame:
    """A row for each object of each reply, the first ``most`` of it: the columns of replies but the reply, nth, status, and the fields as text. Replies without any have no rows."""
    rest = [c for c in replies.columns if c != reply]
    one = replies.select(*rest, parsed(reply).alias("_r"))
    each = one.select(*rest, F.col("_r.status").alias("status"), F.posexplode(F.slice("_r.items", 1, most)).alias("nth", "_item"))
    return each.select(*rest, "nth", "status", *(said(F.col("_item"), f).alias(f) for f in fields))


def reply_states(replies: DataFrame, reply: str, most: int = MOST_ITEMS) -> DataFrame:
    """replies without the reply, with status, returned (objects), others (elements that are none) and over_limit (objects beyond ``most``)."""
    rest = [c for c in replies.columns if c != reply]
    one = replies.select(*rest, parsed(reply).alias("_r"))
    return one.select(*rest, "_r.status", F.size("_r.items").alias("returned"), "_r.others", F.greatest(F.size("_r.items") - most, F.lit(0)).alias("over_limit"))


def extracted_companies(replies: DataFrame, page_id: str, reply: str, page: str, fields: Sequence[str], most: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(items, states): the grounded companies of each page's reply, and for each page what was dropped.

    items: page_id, nth, company_name and fields, of objects with a name that the page has; values that it lacks are null. states: reply_states(), and dropped_records (names that the page lacks) and dropped_values.
    """
    named = ["company_name", *(f for f in fields if f != "company_name")]
    rows = reply_items(replies.select(page_id, page, reply), reply, named, most)
    checked = grounded(rows, page, named[1:]).select(page_id, "nth", *named, "dropped", "whole")
    lost = checked.groupBy(F.col(page_id).alias("_id")).agg(F.count_if("whole").alias("dropped_records"), F.sum(F.when(~F.col("whole") & F.col("company_name").isNotNull(), F.size("dropped")).otherwise(0)).alias("dropped_values"))
    states = reply_states(replies.select(page_id, reply), reply, most).join(lost, F.col(page_id) == F.col("_id"), "left").drop("_id").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("dropped_records", "dropped_values")})
    return checked.filter("not whole and company_name is not null").drop("dropped", "whole"), states
