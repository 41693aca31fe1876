"""Counts of imports and exports against separate aggregation."""

import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rolodexter.operators import records, sequential, services


def raw_rows(spark, n):
    row = lambda k: {"company_name": ["東嶼有限公司", " ", "如何選擇工廠？", f"北港繩索{k % 4}股份有限公司", "Quay Rope Ltd"][k % 5], "email": f"a{k % 7}@harbour.tw" if k % 3 else None, "phone": f"02-2581640{k % 6}" if k % 2 else None, "website": "https://blog.a.tw/news/" if k % 11 == 10 else None}
    rows = [tuple((dict.fromkeys(records.RAW) | row(k)).values()) + (k,) for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in records.RAW) + ", seq long")


def test_import_counts(spark):
    raw = raw_rows(spark, 120)
    store = spark.createDataFrame([tuple((dict.fromkeys(sequential.NAMES) | {"id": 5, "company_name": "Quay Rope", "name_key": "quayrope", "dedupe_key": "n:quayrope"}).values())], sequential.COLUMNS)
    after, s = services.imported(raw, store)
    cleaned = records.cleaned(raw)
    assert s.rows_read == 120 and s.invalid == cleaned.filter("rejected is not null").count() > 0
    assert s.reasons == {r["rejected"]: r["count"] for r in cleaned.filter("rejected is not null").groupBy("rejected").count().collect()}
    assert (s.stored, s.new, s.merged) == (after.count(), after.filter("id is null").count(), after.agg(F.sum("merged")).first()[0])
    assert s.new + s.merged == s.rows_read - s.invalid and s.stored == s.new + 1
    assert after.filter("id = 5").first()["merged"] > 0
    nothing, e = services.imported(raw.limit(0), store)
    assert (e.rows_read, e.invalid, e.new, e.merged, e.stored) == (0, 0, 0, 0, 1) and nothing.count() == 1


@pytest.mark.parametrize("n", [9, 0])
def test_export_of_all_formats(spark, tmp_path, n):
    rows = spark.createDataFrame([(k, f"=公司{k}", 10**6 if k == 3 else 0, {"a": "x"} if k % 2 else None) for k in range(9)], "id int, name string, capital long, extra map<string,string>").filter(F.col("id") < n)
    got = services.exported(rows, f"{tmp_path}/out", ["id", "name"], ["id"], "2024-02-01", headers={"name": "公司名稱"}, maps="extra", capital="capital", credit="open data")
    assert (got.rows, got.credited) == (n, n > 3) and set(got.paths) == {"csv", "json", "excel"}
    texts = [f.read_text(encoding="utf-8-sig") for f in Path(got.paths["csv"]).glob("*.csv")]
    lines = [x for t in texts for x in t.splitlines()[1:]]
    assert {t.splitlines()[0].lower().replace('"', "") for t in texts} == {"id,公司名稱" + (",a" if n else "")} and len(lines) == n + (n > 3)
    told = json.loads("".join(f.read_text(encoding="utf-8") for f in sorted(Path(got.paths["json"]).glob("part-*"))))
    assert len(told["companies"]) == n
    books = sorted(Path(got.paths["excel"]).glob("*.xlsx"))
    assert len(books) == 1
    with zipfile.ZipFile(books[0]) as z:
        assert z.read("xl/worksheets/sheet1.xml").decode().count("<row ") == n + 1
        assert any(b"open data" in z.read(name) for name in z.namelist()) == (n > 3)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="pdf"):
        services.exported(spark.range(1), str(tmp_path), ["id"], ["id"], "x", formats=["pdf"])
