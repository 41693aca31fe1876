"""Reading untidy tables: delimited text of unknown encoding and delimiter, workbooks, JSON of several shapes."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried.
ENCODINGS = ["utf-8-sig", "utf-8", "cp950", "big5"]
DELIMITERS = ",\t;|"
#: Header spellings by field, in lower case.
ALIASES = {
    "company_name": [
        "company_name", "company", "companyname", "company name", "name", "公司", "公司名", "公司名稱", "公司全名", "公司行號", "廠商", "廠商名", "廠商名稱", "廠商全名",
        "工廠名稱", "企業名稱", "事業名稱", "機構名稱", "單位名稱", "商號名稱", "會員名稱", "客戶名稱", "名稱",
    ],
    "tax_id": ["tax_id", "taxid", "tax id", "vat", "統一編號", "統編"],
    "email": ["email", "e-mail", "mail", "電子郵件", "電子信箱", "信箱"],
    "phone": ["phone", "tel", "telephone", "電話", "聯絡電話"],
    "website": ["website", "url", "web", "homepage", "網站", "網址"],
    "address": ["address", "addr", "地址", "公司地址"],
    "industry": ["industry", "category", "產業", "產業別", "行業", "類別"],
    "english_name": ["english_name", "englishname", "english", "english name", "英文名稱", "英文名", "英文", "外文名稱"],
    "fax": ["fax", "傳真", "傳真號碼"],
    "products": ["products", "product", "主要產品", "產品", "代理產品", "營業項目"],
    "contact_person": ["contact_person", "contact", "contactperson", "contact person", "聯絡人", "負責人", "窗口"],
    "remark": ["remark", "note", "notes", "備註"],
}
#: What a header of company names holds, the surest first; what makes it one of something else; endings of companies' own names; the longest header.
NAME_HINTS = [
    "公司名稱", "廠商名稱", "工廠名稱", "企業名稱", "事業名稱", "機構名稱", "單位名稱", "商號名稱", "會員名稱", "客戶名稱", "company name", "company_name", "companyname",
    "公司", "廠商", "工廠", "企業", "事業", "商號", "名稱", "company", "name",
]
OTHER_HINTS = ["負責人", "代表人", "聯絡人", "窗口", "人員", "姓名", "承辦", "英文", "english", "產品", "地址", "電話", "傳真", "信箱", "備註"]
NAME_ENDINGS = ["股份有限公司", "有限公司", "股份公司", "企業社", "工作室", "實業社", "商行", "企業行", "合夥", "商號", "co., ltd", "co.,ltd", "corporation", "inc."]
LONGEST_HEADER = 20
CELLS = "path string, sheet string, line int, cells array<string>"


def decoded(data: bytes) -> str:
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _lines(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        yield text[at:end]
        at = end


def _text_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    text = decoded(data)
    head = text[:4096]
    mark = max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))
    csv.field_size_limit(max(len(text), 1 << 17))  # of this process; a cell cannot be longer than its file
    for n, row in enumerate(csv.reader(_lines(text), delimiter=mark)):
        yield "", n, row


def _workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Every sheet of an OOXML workbook; a cell's column comes from its reference, so gaps stay."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for n, row in enumerate(ElementTree.fromstring(z.read(name)).iterfind(".//m:row", ns)):
                cells: list[str] = []
                for c in row.findall("m:c", ns):
                    at = 0
                    for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v = c.findtext("m:v", "", ns)
                    cells.append(shared[int(v)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else v)
                yield name, n, cells


#: What a broken workbook raises.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, NotImplementedError, RuntimeError, OSError)
LARGEST = 40 << 20
#: Lines of a file that are given at once.
FRAME_ROWS = 10_000


def _width(path: str, data: bytes) -> tuple[int, str | None]:
    """(cells of the widest row, why there are no rows): a file is read once to know them and once more to give its rows, of which it never has all at once."""
    try:
        return max((len(r[2]) for r in _rows(path, data)), default=0), None
    except BROKEN as e:
        return 0, f"broken: {type(e).__name__}"


def _rows(path: str, data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    return _workbook_rows(data) if path.lower().endswith(".xlsx") else _text_rows(data)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.(csv|tsv|txt|xlsx)$"))


def cells(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """(path, sheet, line, cells) of all delimited files and workbooks under a path. Files over ``largest`` bytes and broken ones give no rows; unread() names them. Cells may be of any length."""

    return cells_of(_files(spark, path).filter(F.col("length") <= largest))


def cells_of(files: DataFrame) -> DataFrame:
    """cells() of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                width, why = _width(path, data)  # ragged rows are padded to the widest
                rows = iter(()) if why else _rows(path, data)
                while some := list(islice(rows, FRAME_ROWS)):
                    yield pd.DataFrame({"path": path, "sheet": [r[0] for r in some], "line": [r[1] for r in some], "cells": [[c.strip() for c in r[2]] + [""] * (width - len(r[2])) for r in some]})

    return files.select("path", "content").mapInPandas(run, CELLS)


def unread(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """(path, length, why) of the files under a path that cells() leaves out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            why = [None if data is None else _width(path, data)[1] for path, data in zip(batch["path"], batch["content"], strict=True)]
            yield batch[["path", "length"]].assign(why=why)

    files = _files(spark, path)
    large = files.filter(F.col("length") > largest).select("path", "length", F.lit("too large").alias("why"))
    return files.filter(F.col("length") <= largest).select("path", "length", "content").mapInPandas(run, "path string, length long, why string").filter("why is not null").unionByName(large)


def _words(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def name_rank(header: Column) -> Column:
    """How surely a header is one of company names, 0 the surest; null if it is none: a company's own name, of a person or something else, or too long."""
    low = F.lower(F.trim(header))
    fits = F.length(low).between(1, LONGEST_HEADER) & ~low.rlike(f"(?:{_words(NAME_ENDINGS)})$") & ~low.rlike(_words(OTHER_HINTS)) & ~low.startswith("unnamed:")
    hits = F.filter(F.transform(F.array(*map(F.lit, NAME_HINTS)), lambda w, k: F.when(F.contains(low, w), k)), lambda k: k.isNotNull())
    return F.when(fits, F.get(hits, F.lit(0)))


def field_of(header: Column) -> Column:
    """The field that a header names, or null: by alias, as English name, by an alias among its words, or by an alias once its blanks are gone."""
    low = F.lower(F.trim(header))
    names = F.create_map(*(F.lit(v) for field, aliases in ALIASES.items() for a in aliases for v in (a, field)))
    # A word that names a company counts only in a header that looks like one of names: "負責人 name" is none.
    sure = lambda f: F.when((f != "company_name") | name_rank(header).isNotNull(), f)
    tokens = F.transform(F.split(low, r"[\s/_()（）:：]+"), lambda w: sure(F.try_element_at(names, w)))
    word = F.get(F.filter(tokens, lambda f: f.isNotNull()), F.lit(0))
    compact = sure(F.try_element_at(names, F.regexp_replace(low, r"(?U)\s", "")))
    return F.coalesce(F.try_element_at(names, low), F.when(low.rlike("英文|english"), "english_name"), word, compact)


def records(table: DataFrame, deepest: int = 15) -> DataFrame:
    """(path, sheet, line, fields, extra): the rows of each sheet below its header. The header is, of the first lines, the one with a company column
    and most known columns, the topmost of equals. A line without a company column by its aliases has the one that looks most like company names. Of columns for one
    field the first counts; unknown ones go to ``extra`` under header and column number; empty rows go. A sheet without a header has no records."""
    cells_ = table.filter(F.col("line") < deepest).select("path", "sheet", "line", F.posexplode("cells").alias("pos", "header")).withColumn("field", field_of(F.col("header")))
    line = Window.partitionBy("path", "sheet", "line")
    cells_ = cells_.withColumns({"named": F.max(F.col("field").eqNullSafe(F.lit("company_name"))).over(line), "rank": F.when(F.col("field").isNull(), F.struct(name_rank(F.col("header")).alias("rank"), "pos"))})
    rescued = F.min(F.when(F.col("rank.rank").isNotNull(), F.col("rank"))).over(line)
    long = cells_.withColumn("field", F.when(~F.col("named") & (F.col("pos") == rescued["pos"]), "company_name").otherwise(F.col("field"))).select("path", "sheet", "line", "pos", "header", "field")
    per = long.groupBy("path", "sheet", "line").agg(F.count_if(F.col("field") == "company_name").alias("names"), F.count_distinct("field").alias("known"))
    best = per.filter("known > 0").groupBy("path", "sheet").agg(F.max(F.struct(F.least("names", F.lit(1)).alias("n"), "known", (-F.col("line")).alias("up")))["up"].alias("up"))
    heads = best.select("path", "sheet", (-F.col("up")).alias("head"))
    first = long.join(heads, ["path", "sheet"]).filter("line = head").withColumn("nth", F.row_number().over(Window.partitionBy("path", "sheet", "field").orderBy("pos")))
    columns = first.groupBy("path", "sheet", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "header", F.when(F.col("nth") == 1, F.col("field")).alias("field")))).alias("columns"))
    rows = table.join(columns, ["path", "sheet"]).filter(F.col("line") > F.col("head")).filter(F.exists("cells", lambda c: c != ""))
    pairs = lambda known: F.map_from_entries(F.transform(F.filter("columns", lambda c: (c["field"].isNotNull() if known else c["field"].isNull() & (c["header"] != "")) & (F.get("cells", c["pos"]) != "")), lambda c: F.struct(c["field"] if known else F.concat(c["header"], F.lit(" "), (c["pos"] + 1).cast("string")), F.get("cells", c["pos"]))))
    return rows.select("path", "sheet", "line", pairs(True).alias("fields"), pairs(False).alias("extra"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files: an array, an object with ``companies`` or ``data``, or one object."""
    text = spark.read.text(path, wholetext=True).select("value")
    many = F.from_json("value", f"array<struct<{schema}>>")
    held = F.from_json("value", f"struct<companies:array<struct<{schema}>>,data:array<struct<{schema}>>>")
    one = F.array(F.from_json("value", f"struct<{schema}>"))
    found = F.when(F.ltrim("value").startswith("["), many).otherwise(F.coalesce(held["companies"], held["data"], one))
    return text.select(F.inline(found))
