"""One odd input among many: it is read, or left out and named; the others are untouched."""

from pyspark.sql import functions as F

from rolodexter.operators import joins, records, upkeep, windows
from rolodexter.sources import pages, tables


def test_long_cells_and_broken_workbooks(spark, tmp_path):
    (tmp_path / "long.csv").write_text("公司名稱,備註\n甲," + "x" * 300_000 + "\n乙,y\n", encoding="utf-8")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip at all")
    (tmp_path / "large.csv").write_text("公司名稱\n" + "z" * 600_000)
    (tmp_path / "other.bin").write_bytes(b"x")
    (tmp_path / "empty.csv").write_bytes(b"")
    found = tables.records(tables.cells(spark, str(tmp_path), 500_000)).select(F.element_at("fields", "company_name").alias("n"), F.length(F.element_at("fields", "remark")).alias("l")).collect()
    assert sorted((r["n"], r["l"]) for r in found) == [("乙", 1), ("甲", 300_000)]
    assert {r["path"].rsplit("/", 1)[1]: r["why"] for r in tables.unread(spark, str(tmp_path), 500_000).collect()} == {"broken.xlsx": "broken: BadZipFile", "large.csv": "too large"}


def test_headers(spark):
    table = lambda *lines: spark.createDataFrame([("f", "s", k, list(x)) for k, x in enumerate(lines)], tables.CELLS)
    one = lambda *lines: [(r["fields"], r["extra"]) for r in tables.records(table(*lines)).orderBy("line").collect()]
    # No column by its aliases: the one that looks most like company names, not a person's.
    assert one(["負責人姓名", "事業單位名稱(中文)", "電話"], ["林", "甲行", "1"])[0][0] == {"company_name": "甲行", "phone": "1"}
    # A file without a header has no company column; its first company is no header.
    assert all("company_name" not in f for f, _ in one(["東海精機股份有限公司", "電話"], ["南洋精機股份有限公司", "2"]))
    got = spark.createDataFrame([(h,) for h in ["公司 名稱", "Company_Name", "產品", "承辦 name", "x" * 21 + "公司", "E-Mail", ""]], "h string").select(tables.field_of(F.col("h")).alias("f")).collect()
    assert [r["f"] for r in got] == ["company_name", "company_name", "products", None, None, "email", None]


def test_pages_in_old_charsets(spark):
    rows = [("<meta charset=big5><title>東嶼</title>".encode("cp950"), "東嶼"), ("<title>plain</title>".encode(), "plain"), (b"<meta charset='no-such'><title>\xe6\x9d\xb1</title>", "東"), ("<meta charset=gb2312><title>镕</title>".encode("gb18030"), "镕"), (b"<title>\xff\xfe</title>", "��"), (None, None)]
    got = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(rows)], "k int, b binary").select("k", pages.title(pages.decoded("b")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in got] == [t for _, t in rows]


def test_one_row_group_is_spread(spark, tmp_path):
    """A file has as many pieces as its size says, however few have rows; work on rows is dealt out all the same."""
    from rolodexter.operators.staging import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        df = spark.read.parquet(str(tmp_path / "one"))
        assert df.rdd.getNumPartitions() >= 4 and df.select(F.spark_partition_id()).distinct().count() == 1
        assert spread(df).select(F.spark_partition_id()).distinct().count() >= 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_frames_are_bounded(spark):
    """Rows of many pages and long files come in frames of bounded size, small pages together."""
    rows = [(k, "x" * (3 << 20) if k > 9990 else "y") for k in range(10_000)]
    got = list(pages.framed(iter(rows), ["a", "b"]))
    assert [len(f) for f in got] == [4096, 4096, 1801, 2, 2, 2, 1] and [a for f in got for a in f["a"]] == list(range(10_000))
    lines = ["名稱;備註"] + [f"甲{k};" + ("a\n" if k % 2 else "") for k in range(25_000)]
    data = "\n".join(f'"{x[:-2]}";"{x[-2:]}"' if x.endswith("\n") else x for x in lines).encode()
    files = spark.createDataFrame([("a.csv", data)], "path string, content binary")
    assert tables.cells_of(files).agg(F.count("*"), F.max("line"), F.count_distinct("line")).first()[:] == (25_001, 25_000, 25_001)
    assert len(list(tables._rows("a.csv", data))) == 25_001


def test_entities_without_an_end(spark, duck):
    """As the SQL of page_title_and_charset and page_links reads them: a title that was cut within an entity, and parameters named like one."""
    from rolodexter.plans import queries

    rows = [(1, "<title>a &amp;&amp; b&amp</title>"), (2, "<title>&lt &quot;x&quot &copy;&ampx</title>"), (3, "<title> &amp;quot; </title><a href='/p?a=1&copy=2&amp;lt=3&gt'>x</a>"), (4, None)]
    df = spark.createDataFrame(rows, "page_id int, html string")
    own = duck.cursor()
    own.execute("create temp table odd (page_id int, html varchar)")
    own.executemany("insert into odd values (?, ?)", rows)
    want = own.execute(queries.SQL["page_title_and_charset"].replace("FROM pages", "FROM odd")).fetchall()
    assert sorted(map(tuple, df.select("page_id", pages.title("html").alias("t"), pages.charset("html").alias("c")).collect())) == sorted(want)
    want = own.execute(queries.SQL["page_links"].replace("FROM pages", "FROM odd")).fetchall()
    assert sorted((r["page_id"], r["href"], 1) for r in pages.links(df).collect()) == sorted(want) == [(3, "/p?a=1&copy=2&lt=3&gt", 1)]


def test_details_in_order_and_of_the_first_pages(spark):
    rows = spark.createDataFrame([("u", None), ("v", "own")], "url string, tel string")
    details = spark.createDataFrame([("u", " ", 1), ("u", "02-1", 2), ("u", "02-2", 3), ("v", "02-9", 1)], "url string, tel string, seq int").repartition(3)
    assert sorted(r["tel"] or "" for r in joins.with_details(rows, details, "url", ["tel"]).collect()) == ["02-1", "own"]
    assert sorted(r["tel"] or "" for r in joins.with_details(rows, details, "url", ["tel"], most=1).collect()) == ["", "own"]


def test_new_rows_are_numbered_over_partitions(spark):
    new = spark.createDataFrame([(k, f"n{k}") for k in range(500, 0, -1)], "seq int, name string").repartition(7)
    got = upkeep.added(spark.createDataFrame([(41, "old")], "id long, name string"), new).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in got] == [(41, "old")] + [(41 + k, f"n{k}") for k in range(1, 501)]
    assert upkeep.added(spark.createDataFrame([], "id long, name string"), new.limit(0)).count() == 0


def test_resumed_runs_still_warn_of_rejection(spark):
    runs = spark.createDataFrame([(5, 5, 100, True, True, 0), (5, 0, 100, True, True, 5), (0, 0, 100, True, False, 0), (20, 0, 100, True, False, 20), (5, 5, None, True, False, 0), (5, 5, None, True, False, 2), (0, 0, 9, False, False, 0)], "found int, invalid int, good int, judged boolean, resumed boolean, stored int")
    c = F.col
    got = [r["w"] for r in runs.select(windows.health(c("found"), c("invalid"), c("good"), c("judged"), c("resumed"), c("stored")).alias("w")).collect()]
    assert got == ["all rejected", None, "nothing found", "steep drop", "all rejected", None, None]


def test_first_of_each_name(spark):
    rows = spark.createDataFrame([(3, " 甲 "), (1, "甲"), (2, None), (4, " "), (5, "乙")], "seq int, company_name string")
    assert sorted(r["seq"] for r in records.first_by_name(rows).collect()) == [1, 2, 4, 5]
    good, bad = records.parted(rows.withColumn("rejected", F.when(F.col("seq") > 3, "x")))
    assert good.count() == 3 and bad.count() == 2
