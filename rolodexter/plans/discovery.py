"""Queries of page discovery, completion and documents on made-up pages for the driver's rows, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import completion
from ..operators.staging import spread
from ..sources import discovery, documents, export, pages
from .registry import now, query
from .upkeep import C, pick, sql_pick


def joined(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def each(first, last, f) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(first), last), f), "")


def _listing(t, where: str = "true") -> DataFrame:
    """For each page a listing: groups of three companies; odd pages have plain telephone numbers, pages of fives few sites, even ones buttons; pages of sevens no list."""
    k = C("page_id")

    def card(i: Column) -> Column:
        phone = F.lpad(i.cast("string"), 4, "0")
        tel = F.when(k % 2 == 0, joined('<p class="tel">02-2700-', phone, "</p>")).otherwise(joined("<p>02-2700-", phone, "</p>"))
        site = F.when((k % 5 > 0) | (i % 4 == 0), joined('<a class="site" href="http://c', i, '.com.tw/">官網</a>')).otherwise(F.lit(""))
        button = F.when(k % 2 == 0, '<button class="show">顯示電話</button>').otherwise("")
        return joined('<div class="card"><h3 class="name col-6">大同', i, "有限公司</h3>", tel, '<div class="links"><a href="mailto:c', i, "@b", k, '.tw">@</a> ', site, ' <a class="more" href="/c/', i, '">詳細</a></div>', button, "</div>")

    group = lambda g: joined('<section class="group">', F.array_join(F.transform(F.sequence(g * 3, g * 3 + 2), card), ""), "</section>")
    body = F.when(k % 7 == 0, "<p>Nothing</p>").otherwise(each(0, (3 + k % 3).cast("int"), group))
    html = joined('<html><body><nav><a href="/">Home</a></nav><div id="list">', body, '</div><a class="btn load" href="#">載入更多</a></body></html>')
    return spread(t("pages").filter(where).select("page_id")).select("page_id", F.lit("https://www.b.tw/list").alias("url"), html.alias("html"))


def _nodes(rows: DataFrame) -> DataFrame:
    return discovery.records_of(rows)[1]


def _hosts(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", F.lit("b.tw").alias("host"))


@query("SELECT page_id, 'div.card' AS inner, 3 * (4 + page_id % 3) AS n, 'section.group div.card' AS selector, 3 * (4 + page_id % 3) AS n_chosen FROM pages WHERE page_id % 7 > 0")
def records_in_groups(t):
    rows = _listing(t)
    blocks, _ = discovery.records_of(rows)
    return blocks.join(discovery.scoped(rows, blocks), "page_id").select("page_id", "inner", "n", "selector", "n_chosen")


@query("SELECT page_id, '#list tr' AS selector, 5 + page_id % 3 AS n_items, 5 + page_id % 3 AS n_chosen FROM pages")
def scoped_selectors(t):
    """A table within a table for layout: rows of both are tr."""
    k = C("page_id")
    html = joined('<table><tr><td>menu</td></tr><tr><td><table id="list">', each(1, (5 + k % 3).cast("int"), lambda i: joined("<tr><td>大同", i, "有限公司</td><td>02-2700123", i, "</td></tr>")), "</table></td></tr><tr><td>x</td></tr></table>")
    rows = t("pages").select("page_id", html.alias("html"))
    return discovery.scoped(rows, pages.list_blocks(pages.list_items(rows)))


_N = "(3 * (4 + page_id % 3))"


@query(
    f"WITH p AS (SELECT page_id, {_N} AS n FROM pages WHERE page_id % 7 > 0) SELECT page_id, 'company_name' AS field, 'h3.name' AS selector, 'text' AS reading, 1.0 AS hit_rate, '大同0有限公司' AS sample FROM p "
    "UNION ALL SELECT page_id, 'email', 'a[href^=''mailto:'']', 'mailto', 1.0, 'c0@b' || page_id || '.tw' FROM p "
    "UNION ALL SELECT page_id, 'phone', CASE WHEN page_id % 2 = 0 THEN 'p.tel' ELSE 'p' END, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE 'phone' END, 1.0, '02-2700-0000' FROM p "
    "UNION ALL SELECT page_id, 'website', 'a.site[href^=''http'']', 'outside', 1.0, 'http://c0.com.tw/' FROM p WHERE page_id % 5 > 0"
)
def guessed_rules(t):
    rows = _listing(t)
    got = discovery.guessed_fields(_nodes(rows), _hosts(rows))
    return got.select("page_id", "field", discovery.rule_selector("selector", "reading").alias("selector"), "reading", "hit_rate", F.get("samples", F.lit(0)).alias("sample"))


@query("SELECT page_id, 'a.more' AS selector FROM pages WHERE page_id % 7 > 0")
def detail_link_selectors(t):
    rows = _listing(t)
    return discovery.detail_links(_nodes(rows), _hosts(rows))


@query("SELECT page_id, 'click_all' AS action, 'button.show' AS selector FROM pages WHERE page_id % 2 = 0 AND page_id % 7 > 0 UNION ALL SELECT page_id, 'click', 'a.btn' FROM pages")
def page_buttons(t):
    rows = _listing(t)
    return discovery.page_actions(_nodes(rows), pages.nodes(rows, discovery.MORE_TAGS))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'input.kw' ELSE '#cat' END AS input, CASE WHEN page_id % 3 = 0 THEN 'input.go' ELSE 'button.btnqry' END AS submit, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 4 + page_id % 2 END AS n_options, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'kind 1,kind 2,kind 3' END AS sample, CASE WHEN page_id % 3 > 0 THEN 'input.kw' END AS text_input FROM pages")
def query_forms_found(t):
    k = C("page_id")
    menu = joined('<div class="box"><select id="cat"><option value="">--</option>', each(1, F.when(k % 3 == 0, 3).otherwise((4 + k % 2).cast("int")), lambda i: joined('<option value="', i, '">kind ', i, "</option>")), '</select><button class="btn btnqry">查詢</button></div>')
    html = joined('<form><div class="modal"><button>確定</button></div>', menu, '<div><div><input type="text" class="kw"><input type="submit" class="go" value="Search"></div></div></form>')
    got = discovery.query_forms(discovery.controls(t("pages").select("page_id", html.alias("html"))))
    return got.select("page_id", "input", "submit", "n_options", F.array_join("sample", ",").alias("sample"), "text_input")


@query("SELECT page_id, i AS item, '大同' || i || '有限公司' AS name, '02-2700-' || lpad(CAST(i AS VARCHAR), 4, '0') AS phone, 'c' || i || '@b' || page_id || '.tw' AS email FROM pages, generate_series(0, 9) AS s(i) WHERE page_id % 7 > 0")
def preview_records(t):
    rows = _listing(t)
    nodes = _nodes(rows)
    got = discovery.previewed(nodes, discovery.guessed_fields(nodes, _hosts(rows)))
    field = lambda f: F.try_element_at("fields", F.lit(f))
    return got.select("page_id", "item", field("company_name").alias("name"), field("phone").alias("phone"), field("email").alias("email"))


@query("SELECT page_id, 'no_list' AS note, '' AS about FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'no_next', '' FROM pages WHERE page_id % 7 > 0")
def discovery_notes(t):
    return discovery.discovered(_listing(t))["notes"]


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS first, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS last FROM orders")
def menu_ranges(t):
    values, labels = F.array(*map(F.lit, ["01", "02", "03", "10"])), F.array(*map(F.lit, ["01 Rice", "02 Fruit", "03 Fish", "10 Other"]))
    said = pick(C("o_orderkey"), " fish", "0", "none")
    return t("orders").select("o_orderkey", discovery.option_at(values, labels, said).cast("int").alias("first"), discovery.option_at(values, labels, said, last=True).cast("int").alias("last"))


@query("SELECT c_custkey, 'https://www.c' || c_custkey || '.tw/?a=1' AS url, 1 AS pos FROM customer UNION ALL SELECT c_custkey, 'http://d.tw/', 2 FROM customer WHERE c_custkey % 2 = 0")
def search_hits_unwrapped(t):
    k = C("c_custkey")
    mine = joined("//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.c", k, ".tw%2F%3Fa%3D1&rut=x")
    links = F.array(F.lit("//duckduckgo.com/y.js?ad=1"), mine, mine, F.when(k % 2 == 0, "http://d.tw/").otherwise("javascript:x"))
    rows = t("customer").select(k.alias("company_id"), F.posexplode(links).alias("pos", "href"))
    return completion.search_hits(rows).select(C("company_id").alias("c_custkey"), "url", "pos")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS throttled, 25 * greatest(o_orderkey % 5, 1) AS records FROM orders")
def throttled_and_estimated(t):
    k = C("o_orderkey")
    return t("orders").select("o_orderkey", completion.is_throttled(pick(k, "<p>Unusual Traffic</p>", "<a>hit</a>", None)).alias("throttled"), discovery.estimated_records(F.lit(25), k % 5).alias("records"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE '02-27001234' END AS phone, c_custkey % 3 = 0 AS untouched FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '', true FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def labels_fill_gaps(t):
    """Values of rules stay; labels fill the rest, where there are two of them."""
    k = C("c_custkey")
    text = F.when(k % 3 == 0, "電話：02-27001234").otherwise("電話：02-27001234 傳真：02-27001235")
    values = F.create_map(F.lit("phone"), F.when(k % 2 == 0, "kept").otherwise(""))
    rows = t("customer").select("c_custkey", values.alias("v"), pages.labelled(text).alias("l"))
    got = rows.select("c_custkey", discovery.with_labels(C("v"), C("l.fields"), F.size("l.fields") + F.size("l.extra") >= 2).alias("m"))
    return got.select("c_custkey", F.try_element_at("m", F.lit("phone")).alias("phone"), F.try_element_at("m", F.lit("fax")).isNull().alias("untouched"))


@query("SELECT o_orderkey, 'a,a 2,欄3,b,a 3' AS headers FROM orders")
def headers_once_each(t):
    got = documents.unique_headers(F.array(*map(F.lit, ["a", " a ", "", "b", "a"])))
    return t("orders").select("o_orderkey", F.array_join(got, ",").alias("headers"))


_WHY = "CASE WHEN c_custkey % 6 = 0 THEN 'no_number' WHEN c_custkey % 6 = 1 THEN 'not_asked' WHEN c_custkey % 6 = 2 THEN 'busy' WHEN c_custkey % 6 = 3 THEN 'not_found' WHEN c_custkey % 6 = 4 THEN 'matched' ELSE 'defunct' END"


def _numbers(k: Column) -> Column:
    """A valid tax number for each key: the seventh digit makes the sum of weighted digits divide by 5."""
    head = F.lpad((k % 1_000_000).cast("string"), 6, "0")
    digit = lambda c: (c / 10).cast("int") + c % 10
    total = reduce(lambda a, b: a + b, (digit(F.substring(head, i + 1, 1).cast("int") * w) for i, w in enumerate((1, 2, 1, 2, 1, 2))))
    return F.concat(head, F.lit("0"), ((5 - total % 5) % 5).cast("string"))


@query(f"SELECT c_custkey, {_WHY} AS outcome, c_custkey % 6 >= 3 AS stamped, CASE c_custkey % 6 WHEN 4 THEN '核准設立' WHEN 5 THEN '解散' END AS status FROM customer")
def registry_outcomes(t):
    k = C("c_custkey")
    number = _numbers(k)
    none = F.lit(None).cast("string")
    rows = t("customer").select(k.alias("id"), F.when(k % 6 == 0, pick(k, "", "12345", None)).otherwise(number).alias("tax_id"), none.alias("registration_status"), F.lit(None).cast("long").alias("capital_amount"), none.alias("contact_person"), none.alias("address"), F.create_map().cast("map<string,string>").alias("extra_fields"), F.lit(None).cast("timestamp_ntz").alias("registration_checked_at"))
    said = lambda status: joined('[{"Business_Accounting_NO":"', C("tax_id"), f'","Company_Status_Desc":"{status}"}}]')
    body = F.when(k % 6 == 2, "<html>busy</html>").when(k % 6 == 3, "").when(k % 6 == 4, said("核准設立")).otherwise(said("解散"))
    answers = t("customer").filter(k % 6 > 1).select("c_custkey", number.alias("tax_id")).select("tax_id", body.alias("body"))
    got = completion.registry_outcomes(rows, answers, now())
    return got.select(C("id").alias("c_custkey"), "outcome", C("registration_checked_at").isNotNull().alias("stamped"), C("registration_status").alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' WHEN c_custkey % 3 = 0 THEN 'registry' WHEN c_custkey % 5 = 0 THEN 'site' END AS address, CASE WHEN c_custkey % 5 = 0 THEN 'site' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS address_stage, c_custkey % 7 > 0 AS checked FROM customer")
def completion_stages(t):
    k = C("c_custkey")
    rows = t("customer").select(k.alias("id"), F.when(k % 2 == 0, "old").otherwise(" ").alias("address"), F.lit(None).cast("string").alias("email"))
    registry = t("customer").filter(k % 3 == 0).select(k.alias("id"), F.lit("registry").alias("address"))
    sites = t("customer").filter(k % 5 == 0).select(k.alias("id"), F.lit("site").alias("address"), F.lit("site").alias("email"))
    got = completion.completed(rows, [registry, sites], ["address", "email"], now(), C("id") % 7 == 0)
    stage = F.coalesce(F.try_element_at("filled", F.lit("address")) + 1, F.lit(0))
    return got.select(C("id").alias("c_custkey"), F.nullif("address", F.lit(" ")).alias("address"), "email", stage.alias("address_stage"), C("completion_checked_at").isNotNull().alias("checked"))


@query("SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' (3).pdf' ELSE '.pdf' END AS stored FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' (4).pdf' ELSE ' (2).pdf' END FROM supplier")
def stored_names(t):
    """Two new files of each name; of even suppliers the name and its (2) are taken."""
    s, k = t("supplier"), C("s_suppkey")
    name = lambda end: joined(C("s_name"), end).alias("name")
    new = s.select(k.alias("seq"), name(".pdf")).unionByName(s.select((k + 1000000).alias("seq"), name(".pdf")))
    have = s.filter(k % 2 == 0).select(name(".pdf")).unionByName(s.filter(k % 2 == 0).select(name(" (2).pdf")))
    return completion.unique_names(new, have).select(C("seq").alias("s_suppkey"), "stored")


@query("SELECT p_partkey, 3 + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS use_count, (SELECT max(l_shipdate) FROM lineitem WHERE l_partkey = p_partkey) AS last_used_at FROM part")
def files_marked_used(t):
    files = t("part").select(C("p_partkey").alias("filename"), F.lit(3).cast("long").alias("use_count"), F.lit(None).cast("timestamp_ntz").alias("last_used_at"))
    got = completion.marked_used(files, t("lineitem").select(C("l_partkey").alias("filename"), C("l_shipdate").alias("at")))
    return got.select(C("filename").alias("p_partkey"), "use_count", "last_used_at")


@query("WITH l AS (SELECT min(s_suppkey) AS first, count(*) AS n FROM supplier) SELECT 1 AS part, CASE WHEN s_suppkey = first THEN '' ELSE ',' END || '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"note\":null}' AS line FROM supplier, l UNION ALL SELECT 0, '{\"exported_at\":\"2024-02-01T00:00:00\",\"generator\":\"rolodexter\",\"count\":' || n || ',\"columns\":[\"s_suppkey\", \"s_name\", \"note\"],\"companies\":[' FROM l UNION ALL SELECT 2, '],\"attribution\":\"open data\"}' FROM l")
def export_json_lines(t):
    rows = t("supplier").withColumn("note", F.lit(None).cast("string"))
    return export.json_lines(rows, ["s_suppkey", "s_name", "note"], "2024-02-01T00:00:00", ["s_suppkey"], "open data").select("part", "line")


@query("SELECT c_custkey, unnest([0, 1, 6, 9]) AS pos, unnest(['公司名稱', '統一編號', '產業別', '主要產品']) AS header, unnest([c_name, '', c_mktsegment, c_name]) AS value FROM customer")
def sample_sheet(t):
    """The sheet to fill in, filled in with customers: of each field its longest Chinese name is the header; four of the columns."""
    values = F.create_map(F.lit("company_name"), C("c_name"), F.lit("industry"), C("c_mktsegment"), F.lit("products"), C("c_name"))
    columns = export.sample_columns(t("customer").sparkSession).filter(C("field").isin("company_name", "tax_id", "industry", "products"))
    held = columns.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "field", "header"))).alias("columns"))  # one row
    rows = t("customer").crossJoin(F.broadcast(held)).select("c_custkey", values.alias("v"), F.explode("columns").alias("c"))
    return rows.select("c_custkey", "c.pos", "c.header", F.coalesce(F.try_element_at("v", C("c.field")), F.lit("")).alias("value"))


@query("SELECT o_orderkey, 'companies_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.csv' AS name FROM orders")
def export_names(t):
    return t("orders").select("o_orderkey", export.timestamped_name("companies", C("o_orderdate"), "csv").alias("name"))


@query(f"SELECT c_custkey, {sql_pick('c_custkey', 'a 官網', 'b 官網')} AS q FROM customer")
def search_queries(t):
    return t("customer").select("c_custkey", completion.search_query(pick(C("c_custkey"), "a", "b")).alias("q"))
