"""Questions as filters: a whitelist of parameters that a model or a person may fill in; nothing else reaches a query."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

#: Parameters by kind, and what a choice may be.
PARAMETERS = {
    "keyword": "text", "city": "text", "industry": "text", "stage": "choice", "tag": "text", "has_email": "bool", "never_emailed": "bool",
    "created_within_days": "int", "follow_up_due": "bool", "order_by": "choice", "limit": "int",
}
CHOICES = {"stage": ["New", "Contacted", "Replied", "Negotiating", "Won", "Lost"], "order_by": ["lead_score", "updated_at", "created_at", "company_name"]}
DEFAULT_LIMIT, MAX_LIMIT = 50, 200


@dataclass
class Question:
    mode: str = "list"
    arguments: dict = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)


def outermost(reply: str) -> object:
    """The JSON value inside a reply that may have a fence or prose around it."""
    at = [i for i in (reply.find("{"), reply.find("[")) if i >= 0]
    end = max(reply.rfind("}"), reply.rfind("]"))
    if not at or end < min(at):
        raise ValueError("no JSON in the reply")
    return json.loads(reply[min(at) : end + 1])


def _coerced(name: str, value):
    kind = PARAMETERS[name]
    if kind == "bool":
        word = str(value).strip().lower()
        return True if word in ("true", "1", "yes", "是") else False if word in ("false", "0", "no", "否") else None
    if kind == "int":
        try:
            return int(value)
        except (TypeError, ValueError):
            return None
    if kind == "choice":
        return next((c for c in CHOICES[name] if c.lower() == str(value).strip().lower()), None)
    return str(value).strip() or None


def parsed(reply: str, tool: str = "search_companies") -> Question:
    """A reply as a question. Another tool is an error; unknown or unusable parameters are ignored and named."""
    data = outermost(reply)
    if not isinstance(data, dict) or data.get("tool", tool) != tool:
        raise ValueError("not a question that can be answered")
    out = Question("count" if data.get("mode") == "count" else "list")
    for name, value in (data.get("arguments") or {}).items():
        usable = _coerced(name, value) if name in PARAMETERS and value is not None else None
        if usable is None:
            out.ignored.append(name)
        else:
            out.arguments[name] = usable
    return out


def spellings(city: str) -> list[str]:
    """A place with 台 is also written with 臺."""
    return list(dict.fromkeys([city, city.replace("台", "臺"), city.replace("臺", "台")]))


def searches(question: Question, now, text_columns: Sequence[str]) -> list[filters.Search]:
    """One search for each spelling of the place. now: a Column of the present time."""
    a = question.arguments
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    base = dict(
        text=a.get("keyword", ""),
        text_columns=text_columns,
        among={"pipeline_stage": [a["stage"]]} if "stage" in a else {},
        presence={k: v for k, v in (("email", a.get("has_email")), ("last_emailed_at", None if "never_emailed" not in a else not a["never_emailed"])) if v is not None},
        between={"created_at": (day - F.make_dt_interval(days=F.lit(a["created_within_days"])), None)} if "created_within_days" in a else {},
        due={"follow_up_date": day} if a.get("follow_up_due") else {},
        tags=[a["tag"]] if "tag" in a else [],
        order_by=a.get("order_by", ""),
        descending=a.get("order_by", "") not in ("", "company_name"),
    )
    contains = {"industry": a["industry"]} if "industry" in a else {}
    return [filters.Search(**base, contains=contains | ({"address": c} if c else {})) for c in (spellings(a["city"]) if "city" in a else [""])]


#: Names of parameters and orders as the answer says them.
PARAMETER_LABELS = {
    "keyword": "關鍵字", "city": "縣市", "industry": "產業", "stage": "業務階段", "tag": "標籤", "has_email": "有信箱", "never_emailed": "從沒寄過信", "created_within_days": "最近幾天加入的",
    "follow_up_due": "該追蹤了", "order_by": "排序", "limit": "最多幾家",
}
ORDER_LABELS = {"lead_score": "名單品質", "updated_at": "更新時間", "created_at": "加入時間", "company_name": "公司名稱"}


def criteria_text(question: Question) -> str:
    """What an answer is based on, from the parameters that counted; a question without any is of the whole list."""
    said = []
    for name, value in question.arguments.items():
        label = PARAMETER_LABELS.get(name, name)
        if isinstance(value, bool):
            said.append(label if value else f"不是「{label}」")
        else:
            said.append(f"{label} = {ORDER_LABELS.get(value, value) if name == 'order_by' else value}")
    return "、".join(said) or "沒有加任何條件（整個名單）"


def headline(question: Question, total: Column, shown: Column) -> Column:
    """The first sentence of an answer, written from its numbers."""
    n = total.cast("string")
    whole = F.concat(F.lit("有 "), n, F.lit(" 家，全部列在下面。"))
    part = F.concat(F.lit("有 "), n, F.lit(" 家，下面列出前 "), shown.cast("string"), F.lit(" 家。"))
    counted = F.concat(F.lit("有 "), n, F.lit(" 家。"))
    return F.when(total == 0, "符合條件的一家都沒有。").otherwise(counted if question.mode == "count" else F.when(shown < total, part).otherwise(whole))


def answer(rows: DataFrame, question: Question, now, text_columns: Sequence[str], id_col: str = "id", tag_links: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """One row: headline, criteria, ignored (parameters that cannot be asked), total (complete, whatever the limit) and shown."""
    from dataclasses import replace

    total = answered(rows, replace(question, mode="count"), now, text_columns, id_col, tag_links).select(F.col("n").alias("total"))
    limit = min(max(question.arguments.get("limit", DEFAULT_LIMIT), 1), MAX_LIMIT)
    shown = F.lit(0).cast("long") if question.mode == "count" else F.least(F.col("total"), F.lit(limit).cast("long"))
    return total.withColumn("shown", shown).select(headline(question, F.col("total"), F.col("shown")).alias("headline"), F.lit(criteria_text(question)).alias("criteria"), F.lit("、".join(question.ignored)).alias("ignored"), "total", "shown")


def answered(rows: DataFrame, question: Question, now, text_columns: Sequence[str], id_col: str = "id", tag_links: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """All rows that the question asks for, each once; with mode count, one row with n. The count is complete; a list is as long as asked for, 200 at most. tag_links: (table, its id column, its tag column), for questions with a tag."""
    from functools import reduce

    wanted = reduce(lambda a, b: a | b, (s.predicate() for s in searches(question, now, text_columns)))
    found = filters.narrowed(rows.filter(wanted), searches(question, now, text_columns)[0], id_col, tag_links)
    if question.mode == "count":
        return found.agg(F.count(F.lit(1)).alias("n"))
    first = searches(question, now, text_columns)[0]
    order = first.order_by if first.order_by in rows.columns else id_col
    limit = min(max(question.arguments.get("limit", DEFAULT_LIMIT), 1), MAX_LIMIT)
    return filters.ordered(found, order, first.descending, rows.columns, id_col, id_col).limit(limit)
