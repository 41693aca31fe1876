"""Records out of word processor files and slides: their tables first, labelled text where no table gives any."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import text_blocks, text_record
from .tables import CELLS, records

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _shown(node: ElementTree.Element, ns: str) -> str:
    marks = {f"{ns}tab": "\t", f"{ns}br": "\n", f"{ns}cr": "\n"}
    return "".join((n.text or "") if n.tag == f"{ns}t" else marks.get(n.tag, "") for n in node.iter())


def _lines(node: ElementTree.Element, ns: str) -> str:
    return "\n".join(_shown(p, ns) for p in node.iter(f"{ns}p"))


def _tables(node: ElementTree.Element, ns: str) -> list[list[list[str]]]:
    return [[[_lines(cell, ns) for cell in row.findall(f"{ns}tc")] for row in t.findall(f"{ns}tr")] for t in node.iter(f"{ns}tbl")]


def _read(path: str, data: bytes) -> tuple[list[list[list[str]]], str]:
    """The tables of a document and its text outside of them; a broken file has neither."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if path.lower().endswith(".docx"):
                body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
                return _tables(body, _W), "\n".join(_shown(p, _W) for p in body.findall(f"{_W}p"))
            names = {int(m[1]): n for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
            tables, text = [], []
            for k in sorted(names):
                slide = ElementTree.fromstring(z.read(names[k]))
                tables += _tables(slide, _A)
                inside = {id(p) for t in slide.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
                text += [_shown(p, _A) for p in slide.iter(f"{_A}p") if id(p) not in inside] + [""]  # a slide ends a block
            return tables, "\n".join(text)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return [], ""


def _files(spark: SparkSession, path: str, largest: int) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter((F.col("length") <= largest) & F.lower("path").rlike(r"\.(docx|pptx)$")).select("path", "content")


def document_cells(spark: SparkSession, path: str, largest: int = 40 << 20) -> DataFrame:
    """(path, sheet, line, cells) of all tables of the documents under a path, as tables.cells() gives those of workbooks; files over ``largest`` bytes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, f"table {k:04d}", n, [c.strip() for c in row] + [""] * (max(map(len, t)) - len(row))) for k, t in enumerate(_read(path, data)[0]) for n, row in enumerate(t)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "line", "cells"])

    return _files(spark, path, largest).mapInPandas(run, CELLS)


def document_blocks(spark: SparkSession, path: str, largest: int = 40 << 20) -> DataFrame:
    """(path, pos, text): the text of documents outside of tables, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "whole": [_read(p, data)[1] for p, data in zip(batch["path"], batch["content"], strict=True)]})

    return _files(spark, path, largest).mapInPandas(run, "path string, whole string").select("path", F.posexplode(text_blocks("whole")).alias("pos", "text"))


def document_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, fields, extra): records of documents; those of text only where a document's tables give none."""
    of_tables = records(document_cells(spark, path)).filter(F.map_contains_key("fields", "company_name")).select("path", F.concat_ws(" ", "sheet", F.col("line").cast("string")).alias("place"), "fields", "extra")
    of_text = document_blocks(spark, path).join(of_tables.select("path").distinct(), "path", "left_anti").withColumn("r", text_record("text")).filter("r is not null")
    return of_tables.unionByName(of_text.select("path", F.concat(F.lit("block "), F.col("pos").cast("string")).alias("place"), "r.fields", "r.extra"))


def unique_headers(headers: Column) -> Column:
    """An array of headers, each once: nameless ones are 欄 and their number, repeated ones get a number."""
    named = F.transform(headers, lambda h, k: F.coalesce(F.nullif(F.trim(h), F.lit("")), F.concat(F.lit("欄"), (k + 1).cast("string"))))

    def numbered(names: Column) -> Column:
        nth = lambda h, k: F.size(F.filter(F.slice(names, F.lit(1), k + 1), lambda x: x == h))
        return F.transform(names, lambda h, k: F.when(nth(h, k) > 1, F.concat_ws(" ", h, nth(h, k).cast("string"))).otherwise(h))

    return F.get(F.transform(F.array(named), numbered), F.lit(0))


def best_sheet(found: DataFrame) -> DataFrame:
    """records() of the one sheet of each file that has a company column and most known fields, the first of equals."""
    per = found.select("path", "sheet", F.explode_outer(F.map_keys("fields")).alias("field")).groupBy("path", "sheet").agg(F.max((F.col("field") == "company_name").cast("int")).alias("named"), F.count_distinct("field").alias("known"))
    best = per.groupBy("path").agg(F.min_by("sheet", F.struct((-F.coalesce("named", F.lit(0))).alias("n"), (-F.col("known")).alias("k"), "sheet")).alias("sheet"))
    return found.join(best, ["path", "sheet"], "left_semi")


def import_preview(found: DataFrame, most: int = 10) -> DataFrame:
    """(path, n, fields, sample): of each file the number of records, the known fields, and its first records."""
    from pyspark.sql import Window

    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("sheet", "line"))).filter(F.col("nth") <= most)
    sample = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("nth", F.try_element_at("fields", F.lit("company_name")).alias("company_name")))).alias("sample"))
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    fields = found.select("path", F.explode(F.map_keys("fields")).alias("field")).groupBy("path").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return counts.join(fields, "path", "left").join(sample, "path").select("path", "n", "fields", F.transform("sample", lambda s: s["company_name"]).alias("sample"))
