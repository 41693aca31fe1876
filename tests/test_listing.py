"""The listing data sources: three ways from page to page, filters, and fixtures."""

import json

import pytest

from rolodexter.sources import listing

CARD = "<div class='card'><h3>Firm {0}</h3><p class='tel'>{1}</p><a href='mailto:A{0}@b.tw?x=1'>m</a><a href='/c/{0}'>more</a></div>"
FIELDS = json.dumps({"company_name": "h3", "phone": "p.tel", "email": "i.mail", "link": {"selector": "a[href^='/']", "attr": "href"}})


def html(page, n=3, more=None):
    return "<main>" + "".join(CARD.format(f"{page}-{k}", f"02-2700{page:02d}{k:02d}" if k else "tel") for k in range(n)) + "<div class=card><p class=tel>02-27009999</p></div></main>" + (f"<a class='next' href='{more}'>next</a>" if more else "")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fetched") / "pages")
    rows = [(f"http://a.tw/list?p={p}", html(p)) for p in range(1, 31)]
    rows += [(f"http://c{c}.tw/{p}", html(100 * c + p, more=f"/{p + 1}" if p < 4 else "#top" if c == 1 else "/1")) for c in (1, 2) for p in range(1, 5)]
    spark.createDataFrame(rows, "url string, html string").repartition(3).write.parquet(path)
    listing.register(spark)
    return path


def read(spark, store, **options):
    return spark.read.format("listing").options(path=store, list_selector="div.card", fields=FIELDS, **options).load()


def test_pages_by_number(spark, store):
    df = read(spark, store, pagination="query", page_url="http://a.tw/list?p={page}", page_limit=40, pages_each=5, source="own")
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 8 and len(rows) == 90 and {r["source"] for r in rows} == {"own"}
    first = next(r for r in rows if r["page"] == 7 and r["item"] == 1)
    assert first.asDict() == {"source": "own", "page": 7, "source_url": "http://a.tw/list?p=7", "item": 1, "company_name": "Firm 7-1", "phone": "02-27000701", "email": "a7-1@b.tw", "link": "/c/7-1"}
    assert {r["phone"] for r in rows if r["item"] == 0} == {"tel"}
    assert {r["page"] for r in read(spark, store, pagination="query", page_url="http://a.tw/list?p={page}", page_start=4, page_end=9, page_limit=3).collect()} == {4, 5, 6}


def test_pages_by_links(spark, store):
    df = read(spark, store, pagination="next_link", next_selector="a.next", start_url="http://c1.tw/1 http://c2.tw/1")
    assert df.rdd.getNumPartitions() == 2 and len(df.collect()) == 24  # the second listing leads back to its first page
    late = read(spark, store, pagination="next_link", next_selector="a.next", start_url="http://c1.tw/1", page_start=3)
    assert {(r["page"], r["source_url"]) for r in late.collect()} == {(3, "http://c1.tw/3"), (4, "http://c1.tw/4")}
    assert read(spark, store, start_url="http://c1.tw/1").count() == 3 and read(spark, store, start_url="http://none.tw/1").count() == 0


def test_filters_reach_the_source(spark, store):
    df = read(spark, store, pagination="query", page_url="http://a.tw/list?p={page}", page_limit=30, pages_each=1)
    for condition, pages in [("page = 5", {5}), ("page in (3, 9, 77)", {3, 9}), ("page > 27 and page <= 29", {28, 29}), ("page >= 29 and company_name like '%-0'", {29, 30}), ("page < 1", set())]:
        kept = df.filter(condition)
        assert {r["page"] for r in kept.collect()} == pages
        assert kept.rdd.getNumPartitions() == max(1, len(pages) + (77 in pages))
    linked = read(spark, store, pagination="next_link", next_selector="a.next", start_url="http://c1.tw/1").filter("page = 3 and item = 2").collect()
    assert [(r["page"], r["item"], r["company_name"]) for r in linked] == [(3, 2, "Firm 103-2")]


def test_fixture(spark, store, tmp_path):
    for p in (1, 2, 10):
        (tmp_path / f"page{p}.html").write_text(html(p), encoding="utf-8")
    (tmp_path / "notes.txt").write_text("x")
    df = spark.read.format("listing_fixture").options(path=str(tmp_path), list_selector="div.card", fields=FIELDS).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["page"], r["company_name"]) for r in df.collect()) == [(p, f"Firm {n}-{k}") for p, n in ((1, 1), (2, 2), (3, 10)) for k in range(3)]
    assert df.filter("page = 3").count() == 3
    assert spark.read.format("listing_fixture").options(path=str(tmp_path), list_selector="div.card", fields=FIELDS, page_start=2, page_limit=1).load().select("page").distinct().collect()[0]["page"] == 2


@pytest.mark.parametrize("options", [{"pagination": "all"}, {"fields": "[]"}, {"list_selector": ""}])
def test_options_are_checked(spark, store, options):
    with pytest.raises(Exception, match="(?i)pagination|fields|list_selector"):
        spark.read.format("listing").options(**({"path": store, "list_selector": "div", "fields": FIELDS} | options)).load().collect()
