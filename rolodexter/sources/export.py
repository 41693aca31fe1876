"""Writing lists: shaped, safe for spreadsheets, with credit to the registry where its data is used."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import neutral
from ..operators.aggregates import frequent_keys
from .tables import ALIASES


def known_columns(rows: DataFrame, wanted: Sequence[str], default: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in order; the default ones if none does."""
    return [c for c in wanted if c in rows.columns] or list(default)


def as_text(c: str, kind: str, stamp: str = "yyyy-MM-dd HH:mm") -> Column:
    x = F.col(c)
    if kind.startswith("array"):
        x = F.array_join(x.cast("array<string>"), ", ")
    elif kind.startswith("timestamp"):
        x = F.date_format(x, stamp)
    return F.coalesce(x.cast("string"), F.lit(""))


def shaped(rows: DataFrame, columns: Sequence[str], headers: dict[str, str] | None = None, maps: str | None = None, top: int = 20) -> DataFrame:
    """Text columns in order, nulls as empty text, the ``top`` keys of a map column as more columns, headers translated."""
    kinds = dict(rows.dtypes)
    out = [as_text(c, kinds[c]).alias((headers or {}).get(c, c)) for c in columns]
    if maps:
        keys = [r["key"] for r in frequent_keys(rows, maps, top).collect()]
        out += [F.coalesce(F.try_element_at(F.col(maps), F.lit(k)), F.lit("")).alias(k) for k in keys if k not in columns]
    return rows.select(*out)


def hardened(rows: DataFrame) -> DataFrame:
    """No cell and no header that a spreadsheet takes for a formula."""
    kinds = dict(rows.dtypes)
    head = lambda c: "'" + c if c[:1] in "=+-@\t\r\n" and c else c
    return rows.select(*((neutral(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")).alias(head(c)) for c in rows.columns))


def needs_credit(rows: DataFrame, capital: str, status: str) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_or((F.coalesce(F.col(capital), F.lit(0)) != 0) | (F.coalesce(F.col(status), F.lit("")) != "")), F.lit(False)).alias("needs_credit"))


MARK = "\ufeff"  # tells spreadsheets that a file is UTF-8


def write_csv(rows: DataFrame, path: str, credit: str | None = None) -> None:
    """CSV files with a header, hardened; each file starts with the mark of UTF-8. A credit is one more row."""
    safe = hardened(rows)
    safe = with_credit(safe, credit) if credit else safe
    safe.withColumnRenamed(safe.columns[0], MARK + safe.columns[0]).write.option("header", True).option("encoding", "UTF-8").option("lineSep", "\n").mode("overwrite").csv(path)


def with_credit(rows: DataFrame, credit: str) -> DataFrame:
    """rows of text and one more: the credit in its first column, the others empty."""
    line = rows.sparkSession.range(1).select(*(F.lit(credit if k == 0 else "").alias(c) for k, c in enumerate(rows.columns)))
    return rows.unionByName(line)


def tail(lines: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The last n lines, as a top-n."""
    return lines.orderBy(F.desc(pos)).limit(n)


def backups(files: DataFrame, path: str) -> DataFrame:
    """files with kind and at, out of names that end in _kind_yyyyMMdd_HHmmss and a suffix; others are left out."""
    part = lambda k: F.regexp_extract(path, r"_([a-z]+)_([0-9]{8}_[0-9]{6})\.[A-Za-z0-9]+$", k)
    return files.withColumns({"kind": part(1), "at": F.try_to_timestamp(F.nullif(part(2), F.lit("")), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")}).filter("at is not null")


def json_lines(rows: DataFrame, columns: Sequence[str], exported_at: str, order: Sequence[Column | str], credit: str | None = None, generator: str = "rolodexter") -> DataFrame:
    """(part, line): the lines of one JSON object with exported_at, generator, count, columns, companies and attribution, if any.

    Values keep their types, nulls stay. The order must tell rows apart. part: 0 head, 1 records, 2 end; only the first record has no comma before it, which takes a join with one row and no numbering.
    """
    kinds = dict(rows.dtypes)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kinds[c].startswith("timestamp") else F.col(c)
    body = rows.select(F.to_json(F.struct(*(stamp(c).alias(c) for c in columns)), {"ignoreNullFields": "false"}).alias("json"), F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)).alias("at"))
    facts = body.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    said = lambda x: json.dumps(x, ensure_ascii=False)
    head = F.concat(F.lit(f'{{"exported_at":{said(exported_at)},"generator":{said(generator)},"count":'), F.col("n").cast("string"), F.lit(f',"columns":{said(list(columns))},"companies":['))
    first = F.broadcast(facts.select("first"))  # one row
    records = body.join(first, F.col("at").eqNullSafe(F.col("first")), "left").select(F.lit(1).alias("part"), "at", F.concat(F.when(F.col("first").isNotNull(), "").otherwise(","), "json").alias("line"))
    ends = facts.select(F.lit(0).alias("part"), F.col("first").alias("at"), head.alias("line")).unionByName(facts.select(F.lit(2).alias("part"), F.col("first").alias("at"), F.lit("]" + (f',"attribution":{said(credit)}' if credit else "") + "}").alias("line")))
    return records.unionByName(ends)


def write_json(rows: DataFrame, path: str, columns: Sequence[str], exported_at: str, order: Sequence[Column | str], credit: str | None = None) -> None:
    """Text files that are one JSON object when put together in the order of their names. The order must tell rows apart."""
    json_lines(rows, columns, exported_at, order, credit).orderBy("part", "at").select("line").write.mode("overwrite").text(path)


def _letters(k: int) -> str:
    """A spreadsheet's name of the k-th column, from 1."""
    return (_letters((k - 1) // 26) if k > 26 else "") + chr(65 + (k - 1) % 26)


def _wide(value: str) -> int:
    return sum(2 if ord(ch) > 0x2E80 else 1 for ch in value)


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PARTS = "http://schemas.openxmlformats.org/package/2006"
#: Least and greatest width of a column, rows that decide it, fill of the header.
NARROWEST, WIDEST, WIDTH_ROWS, HEADER_FILL = 10, 55, 200, "FF1F4E79"


def _sheet(rows: list[list[str]], widths: list[int], framed: bool) -> str:
    cell = lambda r, c, v: f'<c r="{_letters(c)}{r}" t="inlineStr"{" s=\"1\"" if framed and r == 1 else ""}><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if framed else ""
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    data = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
    filter_ = f'<autoFilter ref="A1:{_letters(len(widths))}{len(rows)}"/>' if framed else ""
    return f'<worksheet xmlns="{_MAIN}">{pane}<cols>{cols}</cols><sheetData>{data}</sheetData>{filter_}</worksheet>'


def workbook(header: list[str], rows: list[list[str]], sheet: str = "Companies", credit: str | None = None) -> bytes:
    """An OOXML workbook: a coloured header that stays in view, a filter, columns as wide as their texts; the credit has a sheet of its own."""
    table = [header, *rows]
    widths = [min(max(max(_wide(r[k]) for r in table[: WIDTH_ROWS + 1]) + 2, NARROWEST), WIDEST) for k in range(len(header))]
    sheets = [(sheet[:31] or "Companies", _sheet(table, widths, True))] + ([("資料來源", _sheet([[credit]], [WIDEST], False))] if credit else [])
    out, n = io.BytesIO(), len(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        put("[Content_Types].xml", f'<Types xmlns="{_PARTS}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}worksheet+xml"/>' for k in range(1, n + 1)) + "</Types>")
        put("_rels/.rels", f'<Relationships xmlns="{_PARTS}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PARTS}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/><sz val="11"/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{HEADER_FILL}"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf></cellXfs></styleSheet>')
        for k, (_, text) in enumerate(sheets, 1):
            put(f"xl/worksheets/sheet{k}.xml", text)
    return out.getvalue()


def workbooks(rows: DataFrame, order: Sequence[Column | str], most: int = 50_000, sheet: str = "Companies", credit: str | None = None) -> DataFrame:
    """(file, n_rows, content): rows of text as workbooks of up to ``most`` rows each, hardened; a table without rows gives one with the header alone.

    Rows are sorted and dealt by range; a partition gives as many workbooks as it takes, so files follow the order and no task holds more than one.
    """
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns]
    header = list(hardened(rows.select(*texts)).columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held += batch.values.tolist()
            while len(held) >= most:
                yield pd.DataFrame({"file": [f"{part:06d}-{k:06d}"], "n_rows": [most], "content": [workbook(header, held[:most], sheet, credit)]})
                held, k = held[most:], k + 1
        if held:
            yield pd.DataFrame({"file": [f"{part:06d}-{k:06d}"], "n_rows": [len(held)], "content": [workbook(header, held, sheet, credit)]})

    sorted_ = hardened(rows.orderBy(*order).select(*texts))
    found = sorted_.mapInPandas(run, "file string, n_rows long, content binary")
    none = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("000000-000000").alias("file"), F.lit(0).cast("long").alias("n_rows"), F.lit(workbook(header, [], sheet, credit)).alias("content"))
    return found.unionByName(none)


def save_workbooks(books: DataFrame, folder: str) -> list[str]:
    """Writes workbooks() into a folder of the driver's, one at a time; returns their names."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for book in books.orderBy("file").toLocalIterator():
        names.append(f"{book['file']}.xlsx")
        (Path(folder) / names[-1]).write_bytes(bytes(book["content"]))
    return names


def sample_columns(spark: SparkSession) -> DataFrame:
    """(pos, field, header): the columns of a sheet to fill in and import: of each field its longest Chinese name, the first of equals, else the field's own name."""
    rows = [(k, field, n, alias) for k, (field, aliases) in enumerate(ALIASES.items()) for n, alias in enumerate(aliases)]
    names = spark.createDataFrame(rows, "pos int, field string, n int, alias string")
    longest = F.max_by("alias", F.when(F.col("alias").rlike("[一-鿿]"), F.struct(F.length("alias").alias("l"), (-F.col("n")).alias("n"))))
    return names.groupBy("pos", "field").agg(F.coalesce(longest, "field").alias("header"))


def timestamped_name(stem: str, stamp: Column, extension: str) -> Column:
    return F.concat(F.lit(f"{stem}_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(f".{extension}"))


def take_snapshot(tables: dict[str, DataFrame], root: str, kind: str, stamp: str) -> str:
    """Writes the tables as a backup that backups() finds, and returns its folder. stamp: yyyyMMdd_HHmmss."""
    folder = f"{root}/snapshot_{kind}_{stamp}.parquet"
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return folder


def restored(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
