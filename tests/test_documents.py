"""Documents, workbooks and exports by files of our own making."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rolodexter.operators import completion
from rolodexter.sources import discovery, documents, export, extraction, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def word(*body):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    return packed({"word/document.xml": f"<w:document {W}><w:body>" + "".join(p(b) if isinstance(b, str) else table(b) for b in body) + "</w:body></w:document>"})


def slides(*pages):
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    return packed({f"ppt/slides/slide{k}.xml": f"<p:sld {A}>" + "".join(map(p, lines)) + "</p:sld>" for k, lines in enumerate(pages, 1)})


def test_records_of_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word("Intro", [["公司名稱", "電話", "備用"], ["甲有限公司", "02-27001234", "x"], ["", "", ""]], "乙有限公司", "電話：1 傳真：2"))
    (tmp_path / "b.docx").write_bytes(word("丙有限公司", "電話：02-1 傳真：02-2", "丁企業社", "電話：02-3 傳真：02-4"))
    (tmp_path / "c.pptx").write_bytes(slides(["戊有限公司", "電話：02-5 傳真：02-6"], ["no record"]))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = documents.document_records(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("path", "/"), -1)).collect()
    rows = sorted((r["file"], r["fields"].get("company_name"), r["fields"].get("phone")) for r in got)
    assert rows == [("a.docx", "甲有限公司", "02-27001234"), ("b.docx", "丁企業社", "02-3"), ("b.docx", "丙有限公司", "02-1"), ("c.pptx", "戊有限公司", "02-5")]


def test_workbooks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"=公司{k}" if k % 2 else None) for k in range(7)], "id int, name string").withColumnRenamed("name", "名稱")
    names = export.save_workbooks(export.workbooks(rows, ["id"], most=3, credit="open data"), str(tmp_path))
    cells = tables.cells(spark, str(tmp_path)).collect()
    data = sorted(tuple(r["cells"]) for r in cells if r["sheet"].endswith("sheet1.xml") and r["line"] > 0)
    assert data == sorted((str(k), f"'=公司{k}" if k % 2 else "") for k in range(7))
    assert {tuple(r["cells"]) for r in cells if r["line"] == 0} == {("id", "名稱"), ("open data", "")} and len(names) >= 3
    with zipfile.ZipFile(tmp_path / names[0]) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 'state="frozen"' in sheet and "<autoFilter ref=" in sheet and 'width="10"' in sheet


def test_a_table_without_rows_gives_a_workbook_with_its_header(spark, tmp_path):
    names = export.save_workbooks(export.workbooks(spark.createDataFrame([], "a string, b string"), ["a"]), str(tmp_path))
    assert len(names) == 1 and [r["cells"] for r in tables.cells(spark, str(tmp_path)).collect()] == [["a", "b"]]


@pytest.mark.parametrize("n", [0, 1, 50])
def test_json_parts_are_one_object(spark, tmp_path, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.lit('"x"')).alias("name"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("at"))
    export.write_json(rows.repartition(5), str(tmp_path / "out"), ["id", "name", "at"], "2024-02-01T00:00:00", ["id"], "open data")
    said = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert said["count"] == n and said["attribution"] == "open data" and said["columns"] == ["id", "name", "at"]
    assert said["companies"] == [{"id": k, "name": None if k % 2 else '"x"', "at": "2024-01-02T03:04:05"} for k in range(n)]


def test_csv_has_the_mark_and_the_credit(spark, tmp_path):
    export.write_csv(spark.createDataFrame([("=1", "b")], "x string, y string"), str(tmp_path / "out"), "open data")
    texts = [p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert all(t.startswith(b"\xef\xbb\xbfx,y\n") for t in texts)
    assert b"".join(t.split(b"\n", 1)[1] for t in texts) == b"'=1,b\nopen data,\"\"\n"


def test_snapshots(spark, tmp_path):
    folder = export.take_snapshot({"a": spark.range(3)}, str(tmp_path), "auto", "20240102_030405")
    assert export.restored(spark, folder, ["a"])["a"].count() == 3
    found = export.backups(spark.createDataFrame([(folder,), (f"{tmp_path}/other",)], "path string"), "path").collect()
    assert [(r["kind"], str(r["at"])) for r in found] == [("auto", "2024-01-02 03:04:05")]


def test_best_sheet_and_preview(spark):
    cells = spark.createDataFrame(
        [("f", "s1", 0, ["公司", "欄位"]), ("f", "s1", 1, ["甲", "x"]), ("f", "s2", 0, ["公司", "電話"]), ("f", "s2", 1, ["乙", "1"]), ("f", "s2", 2, ["丙", "2"])], tables.CELLS
    )
    best = documents.best_sheet(tables.records(cells))
    assert {r["sheet"] for r in best.collect()} == {"s2"}
    assert [(r["n"], r["fields"], r["sample"]) for r in documents.import_preview(best, 1).collect()] == [(2, ["company_name", "phone"], ["乙"])]


def test_selectors_below_a_record():
    page = extraction.Page("<div class='a'><p>1</p><div><p>2</p></div></div><p>3</p>")
    assert [page.text(n) for n in extraction.selected(page, "p", 0)] == ["1", "2"]
    assert [page.text(n) for n in extraction.selected(page, "p")] == ["1", "2", "3"]


def test_no_list_gives_no_fields(spark):
    rows = spark.createDataFrame([(1, "http://a.tw/", "<p>x</p>"), (2, "http://a.tw/", None), (3, None, "")], "page_id long, url string, html string")
    got = discovery.discovered(rows)
    assert got["fields"].count() == got["preview"].count() == got["details"].count() == 0
    assert sorted((r["page_id"], r["note"]) for r in got["notes"].collect()) == [(1, "no_list"), (2, "no_list"), (3, "no_list")]


def test_later_stages_replace_only_with_overwrite(spark):
    rows = spark.createDataFrame([(1, "old"), (2, None)], "id int, site string")
    stages = [spark.createDataFrame([(1, "a"), (2, "b")], "id int, site string"), spark.createDataFrame([(1, "c"), (2, " ")], "id int, site string")]
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    of = lambda over: {r["id"]: (r["site"], r["filled"]) for r in completion.completed(rows, stages, ["site"], now, overwrite=over).collect()}
    assert of(False) == {1: ("old", {}), 2: ("b", {"site": 0})}
    assert of(True) == {1: ("c", {}), 2: ("b", {"site": 0})}
