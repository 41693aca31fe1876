"""Finding a company's own site and registry entry, and holding what a model said against the page that it read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed, text, validate
from ..functions.text import blank_to_null, col

#: What a cell that says nothing holds; fields of digits, and marks between digits.
EMPTY_VALUES = ["", "-", "--", "n/a", "na", "null", "none", "無", "沒有", "不詳", "未提供", "未知", "無資料", "查無", "不適用"]
NUMERIC_FIELDS = ["tax_id", "phone", "fax"]
NUMBER_NOISE = "-()+#./,_"
#: A contact's name holds none of these and is no longer than this.
NOT_A_PERSON = r"(?i)[0-9]|@|http|www|公司|有限|股份|地址|電話|傳真|信箱|服務|時間|表單|我們"
LONGEST_PERSON = 30
#: Kinds of the registry's answers, and what an active company's status is.
ACTIVE = "核准設立"
REGISTRY_ROW = "Business_Accounting_NO string, Company_Name string, Company_Status_Desc string, Capital_Stock_Amount string, Paid_In_Capital_Amount string, Responsible_Name string, Company_Location string, Company_Setup_Date string, Register_Organization_Desc string"

# Sites


def host_holds(url: Column | str, parts: Sequence[str]) -> Column:
    """Whether an address's host, www left out, holds any of the parts: for a list of sites that are nobody's own."""
    host = F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.coalesce(host.rlike("|".join(p.replace(".", r"\.") for p in parts)), F.lit(False)) if parts else F.lit(False)


def is_directory_entry(url: Column | str, name_key: Column | str, tax_id: Column | str) -> Column:
    """Whether the path of an address names the company or its number: a site of its own says so in the host."""
    path = F.try_url_decode(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    number = F.regexp_replace(F.coalesce(col(tax_id).cast("string"), F.lit("")), "[^0-9]", "")
    named = (F.length(col(name_key)) >= 2) & F.contains(text.comparable(path), col(name_key))
    return F.coalesce(named, F.lit(False)) | F.coalesce((F.length(number) == 8) & F.contains(path, number), F.lit(False))


def candidate_sites(hits: DataFrame, aggregators: Sequence[str], most: int = 3) -> DataFrame:
    """(company_id, nth, url): of each company's search hits, in their order, the first ``most`` hosts that may be its own. hits: company_id, pos, url, name_key, tax_id."""
    sites = hits.withColumn("url", text.website("url")).filter("url is not null").filter(~host_holds("url", aggregators) & ~is_directory_entry("url", "name_key", "tax_id"))
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    first = sites.groupBy("company_id", host.alias("host")).agg(F.min(F.struct("pos", "url")).alias("b")).select("company_id", "b.*")
    w = Window.partitionBy("company_id").orderBy("pos")
    return first.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("company_id", "nth", "url")


def mentions_company(page_text: Column | str, name_key: Column | str) -> Column:
    """Whether a page's text holds a company's key; keys of one character would be anywhere and count nowhere."""
    return F.coalesce((F.length(col(name_key)) >= 2) & F.contains(text.comparable(text.halfwidth(page_text)), col(name_key)), F.lit(False))


def usable_person(value: Column | str) -> Column:
    name = text.person(value)
    return F.when((F.length(name) <= LONGEST_PERSON) & ~name.rlike(NOT_A_PERSON), name)


def usable_phone(value: Column | str) -> Column:
    """The first part of a value that is a telephone number, normalised; else the whole value if it is one."""
    shaped = F.regexp_extract_all(F.coalesce(col(value), F.lit("")), F.lit(fixed.PHONE_WITH_EXTENSION), F.lit(0))
    tried = F.concat(shaped, F.array(col(value)))
    numbers = F.transform(tried, text.phone)
    return F.get(F.filter(numbers, lambda x: x.isNotNull() & validate.is_phone(x)), F.lit(0))


# The registry


def amount(value: Column | str) -> Column:
    """A positive whole number, else null."""
    n = F.col(value).try_cast("long") if isinstance(value, str) else value.try_cast("long")
    return F.when(n > 0, n)


def quoted_url(condition: Column) -> Column:
    """Percent-encoded, blanks as %20."""
    return F.replace(F.url_encode(condition), F.lit("+"), F.lit("%20"))


def query_url(base: str, tax_id: Column | str) -> Column:
    return F.concat(F.lit(base + "?$format=json&$filter="), quoted_url(F.concat(F.lit("Business_Accounting_NO eq "), col(tax_id))), F.lit("&$skip=0&$top=1"))


def name_query_url(base: str, name: Column | str, status: str = "01", most: int = 10) -> Column:
    return F.concat(F.lit(base + "?$format=json&$filter="), quoted_url(F.concat(F.lit("Company_Name like "), col(name), F.lit(f" and Company_Status eq {status}"))), F.lit(f"&$skip=0&$top={most}"))


def registry_state(body: Column | str) -> Column:
    """busy for what is no JSON, none for an empty answer, else rows."""
    said = F.trim(F.coalesce(col(body), F.lit("")))
    rows = F.from_json(F.when(said.startswith("["), said).otherwise(F.concat(F.lit("["), said, F.lit("]"))), f"array<struct<{REGISTRY_ROW}>>")
    return F.when((said == "") | (said.rlike(r"^\[\s*\]$")), "none").when(~said.rlike(r"^[\[{]") | rows.isNull(), "busy").otherwise("rows")


def registry_rows(answers: DataFrame, body: str) -> DataFrame:
    """answers with a row for each registration: pos, tax_id, company_name, status, capital, paid_in, responsible, location, setup_date, organization, extra, active."""
    said = F.trim(F.coalesce(F.col(body), F.lit("")))
    parsed = F.from_json(F.when(said.startswith("["), said).otherwise(F.concat(F.lit("["), said, F.lit("]"))), f"array<struct<{REGISTRY_ROW}>>")
    rows = answers.filter(registry_state(body) == "rows").select(*(c for c in answers.columns if c != body), F.posexplode(F.filter(parsed, lambda r: r.isNotNull())).alias("pos", "r"))
    t = lambda c: F.trim(F.coalesce(F.col(f"r.{c}"), F.lit("")))
    paid, setup = amount(F.col("r.Paid_In_Capital_Amount")), dates.roc_date("r.Company_Setup_Date")
    extra = [("登記名稱", F.nullif(t("Company_Name"), F.lit(""))), ("登記狀態", F.nullif(t("Company_Status_Desc"), F.lit(""))), ("實收資本額", F.format_number(paid, 0)), ("設立日期", setup.cast("string")), ("登記機關", F.nullif(t("Register_Organization_Desc"), F.lit("")))]
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in extra)), lambda p: p["v"].isNotNull())
    return rows.select(*(c for c in answers.columns if c != body), "pos", t("Business_Accounting_NO").alias("tax_id"), t("Company_Name").alias("company_name"), t("Company_Status_Desc").alias("status"), amount(F.col("r.Capital_Stock_Amount")).alias("capital"), paid.alias("paid_in"), t("Responsible_Name").alias("responsible"), t("Company_Location").alias("location"), setup.alias("setup_date"), t("Register_Organization_Desc").alias("organization"), F.map_from_entries(pairs).alias("extra"), (t("Company_Status_Desc") == ACTIVE).alias("active"))


# What a model said


def said_value(value: Column | str) -> Column:
    """A model's value squeezed; null for the ways of saying nothing."""
    x = text.squeeze(value)
    return F.when(~F.lower(x).isin(EMPTY_VALUES), x)


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(c), F.lit("臺"), F.lit("台")), r"(?U)\s+", "")


def is_on_page(value: Column, page: Column, numeric: bool) -> Column:
    """Whether a value is on a page but for case, blanks and 台 or 臺; of numbers marks don't count, of addresses not the scheme. Both folded to half width."""
    needle, hay = _folded(value), _folded(page)
    if numeric:
        needle, hay = (F.translate(x, NUMBER_NOISE, "") for x in (needle, hay))
        return F.coalesce((needle != "") & F.contains(hay, needle), F.lit(False))
    bare = F.regexp_replace(needle, "^(?:https?://|mailto:)", "")
    return F.coalesce((needle != "") & (F.contains(hay, needle) | ((bare != needle) & (bare != "") & F.contains(hay, bare))), F.lit(False))


def grounded(items: DataFrame, page: str, fields: Sequence[str]) -> DataFrame:
    """items with values that are not on their page nulled; adds dropped (their fields) and whole: the name is not on the page, so the item says nothing. items: company_name, fields, page."""
    folded = items.withColumns({c: text.halfwidth(c) for c in ("company_name", page, *fields)})
    values = {c: said_value(c) for c in ("company_name", *fields)}
    ok = {c: is_on_page(v, F.col(page), c in NUMERIC_FIELDS) for c, v in values.items()}
    whole = values["company_name"].isNotNull() & ~ok["company_name"]
    lost = F.filter(F.array(*(F.when(values[f].isNotNull() & ~ok[f], F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    out = folded.withColumns({f"_{c}": F.when(ok[c], v) for c, v in values.items()} | {"dropped": F.when(whole, F.array(F.lit("company_name"))).otherwise(lost), "whole": whole})
    return out.withColumns({c: F.when(~F.col("whole"), F.col(f"_{c}")) for c in values}).drop(*(f"_{c}" for c in values))


def as_index(value: Column | str) -> Column:
    """The first whole number in what a model gave for one."""
    return F.nullif(F.regexp_extract(col(value).cast("string"), r"(-?[0-9]+)", 1), F.lit("")).cast("long")


def as_reason(value: Column | str, longest: int = 60) -> Column:
    return F.substring(F.coalesce(text.squeeze(value), F.lit("")), 1, longest)
