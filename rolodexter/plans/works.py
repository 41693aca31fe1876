"""Queries of stores, connected rows, selectors, data sources, files, messages and counts, each with its SQL where SQL can say the same."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, labels, richtext, text
from ..operators import ask, connected, folding, joins, outreach, records, sequential, services
from ..operators.staging import shared_dir, spread, stage
from ..sources import export, exploration, inbox, listing, pages, pdf, replies, selectors, tables
from ..sources.extraction import Rule
from ..streaming.store import Store
from .registry import now, query
from .upkeep import C, pick


def said(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def fresh(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/rolodexter/{name}-{time.time_ns()}"


# Connected rows, the sequential upsert, parts that occur in a column


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey // 10) AS cluster FROM part")
def connected_rows(t):
    """Chains of ten: each part shares a key with the next of its ten."""
    k = C("p_partkey")
    keys = t("part").select("p_partkey", F.explode(F.array(k, F.when(k % 10 < 9, k + 1))).alias("key"))
    return connected.clusters(t("part"), "p_partkey", keys)


def people(t) -> tuple[DataFrame, DataFrame]:
    """A store of the even customers and a batch of the odd ones, with keys that meet in every way."""
    k, c = C("c_custkey"), t("customer")
    mod = lambda n: (k % n).cast("string")
    rows = c.select(
        F.when(k % 2 == 0, k).alias("id"), F.when(k % 2 == 1, k).alias("seq"), "c_custkey", C("c_name").alias("company_name"), F.when(k % 5 > 0, said("n", mod(97))).alias("name_key"),
        F.when(k % 7 == 0, said("tax:", mod(31))).when(k % 7 == 1, said("n:n", mod(97))).otherwise(said("k:", k)).alias("dedupe_key"), F.when(k % 6 == 0, said("h", mod(9), ".tw")).alias("host"), F.when(k % 4 > 0, said("u", k)).alias("source_url"),
        F.when(k % 7 == 0, mod(31)).alias("tax_id"), F.when(k % 3 == 0, "Hot@b.tw").when(k % 11 == 0, said("m", mod(13), "@b.tw")).alias("email"), F.when(k % 9 == 0, said("p", mod(3))).alias("phone"), F.when(k % 6 == 0, said("https://h", mod(9), ".tw/x")).alias("website"),
        F.when(k % 8 == 0, C("c_mktsegment")).alias("industry"), F.when(k % 10 == 0, pick(k, "Lin", "Wu", "Ho")).alias("contact_person"),
        F.create_map(F.lit("a"), F.when(k % 3 == 0, said("a", k)).otherwise(""), said("b", mod(2)), C("c_name")).alias("extra"), F.when(k % 2 == 1, pick(k, "Valid", "Unknown", "Bounced", "Invalid")).alias("email_verdict"),
    )
    return rows.filter("id is not null").drop("c_custkey"), rows.filter("seq is not null").drop("c_custkey")


@query()
def upsert_with_maps_and_contacts(t):
    """Maps filled by key, verdicts, contacts, and an e-mail that a third of all rows share; a test replays it in Python."""
    store, batch = people(t)
    return sequential.upserted(store, batch).select(*(c for c in sequential.NAMES if c != "seq"), "merged")


@query(
    "WITH r AS (SELECT c_custkey AS id, c_nationkey AS k, 'h' || c_custkey % 40 || '.tw' AS host FROM customer), s AS (SELECT s_suppkey AS id, s_nationkey AS k, lower('https://WWW.h' || s_suppkey % 40 || '.tw/x' || s_suppkey) AS site FROM supplier), "
    "e AS (SELECT r.id AS row_id, min(s.id) AS target_id, 1 AS rank FROM r JOIN s ON r.k = s.k AND contains(site, host) GROUP BY 1 UNION ALL SELECT r.id, min(s.id), 0 FROM r JOIN s ON r.id = s.id * 100 GROUP BY 1) "
    "SELECT row_id, arg_min(target_id, rank) AS target_id, min(rank) AS rank FROM e GROUP BY 1"
)
def host_within_website(t):
    """A host that occurs in the website of a row of the same name key; a number that agrees is stronger."""
    rows = t("customer").select(C("c_custkey").alias("id"), C("c_nationkey").alias("k"), C("c_custkey").alias("nr"), said("h", C("c_custkey") % 40, ".tw").alias("host"))
    targets = t("supplier").select(C("s_suppkey").alias("id"), C("s_nationkey").alias("k"), (C("s_suppkey") * 100).alias("nr"), said("https://WWW.h", C("s_suppkey") % 40, ".tw/x", C("s_suppkey")).alias("site"))
    return joins.first_match(rows, targets, [("nr", "nr"), joins.Within("host", "site", (("k", "k"),))])


# Stores and walks


@query("SELECT o_custkey % 500 || '' AS key, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS name, arg_max(o_orderstatus || o_orderkey, o_orderkey) AS url, count(*) AS records FROM orders GROUP BY 1")
def store_of_pages(t):
    """Orders as four pages of a stream, merged into keyed state page by page."""
    k, orders = C("o_orderkey"), t("orders")
    spark = orders.sparkSession
    low, high = orders.agg(F.min(k), F.max(k)).first()
    path, schema = fresh(spark, "pages"), "key string, seq long, page string, name string, url string"
    page = F.floor((k - F.lit(low or 0)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    rows = stage(orders.select((C("o_custkey") % 500).cast("string").alias("key"), k.cast("long").alias("seq"), page.cast("string").alias("page"), F.when(C("o_orderstatus") == "F", C("o_orderpriority")).alias("name"), said(C("o_orderstatus"), k).alias("url")), "orders")
    for p in range(4):  # one file after the other, so that they are read in order
        rows.filter(C("page") == str(p)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = Store(spark, fresh(spark, "store"), ["name"], ["url"])
    summary = store.ingest("orders", stream, "key", stop_on_empty=False)
    if summary.status != "success":
        raise RuntimeError(summary.error)
    return store.rows()


def sites(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """starts, links and lists of the pages' hosts: page n of a host (in order of page_id) links to 2n and 2n + 1; every fourth page is a list."""
    from pyspark.sql import Window

    numbered = t("pages").select("page_id", "url", exploration.site_of("url").alias("site")).withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_id")))
    address = said("http://", C("site"), "/", F.when(C("page_id") % 3 == 0, "members/").otherwise("x/"), F.when(C("page_id") % 2 == 0, said("p", C("page_id") % 7)).otherwise(said("q", C("page_id"), "z")))
    at = stage(numbered.withColumn("address", address), "sites")
    to = at.select(C("site").alias("_site"), C("n").alias("_n"), C("address").alias("url"))
    links = at.join(to, (C("site") == C("_site")) & (F.floor(C("_n") / 2) == C("n")))
    links = links.select(exploration.page_of(at["address"]).alias("page"), C("_n").cast("int").alias("pos"), exploration.page_of(to["url"]).alias("to"), to["url"], exploration.priority_of(to["url"], F.lit("")).alias("priority"))
    return at.filter("n = 1").select("site", C("address").alias("url")), links, at.filter("page_id % 4 = 1").select(exploration.page_of("address").alias("page")).distinct()


@query()
def site_exploration(t):
    """Every host of the pages is walked best first; a test walks them with a queue."""
    starts, links, lists = sites(t)
    return exploration.explored(starts, links, lists, budget=12, target=3)


# Pages


NAV = "WITH n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"([^\"]*)\">', 1) AS links, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"[^\"]*\">([^<]*)</a>', 1) AS names FROM pages) "


@query(NAV + "SELECT page_id, len(links) AS n, (len(links) + 1) // 2 AS odd, len(links) - 1 AS later, links[-1] AS last FROM n WHERE len(links) > 1")
def structural_selectors(t):
    table = selectors.parsed(t("pages"))
    count = lambda s, name: selectors.selected(table, s).groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    last = selectors.selected(table, "nav > ul > li:last-child > a[href^='/']").select("page_id", F.try_element_at("attributes", F.lit("href")).alias("last"))
    return count("nav ul > li", "n").join(count("nav li:nth-child(odd)", "odd"), "page_id").join(count("nav li + li", "later"), "page_id").join(last, "page_id").select("page_id", "n", "odd", "later", "last")


@query(NAV + "SELECT page_id, unnest(range(len(links)))::INT AS item, trim(unnest(names)) AS name, regexp_extract(url, '^(https?://[^/?#]*)', 1) || unnest(links) AS link FROM n")
def selector_records(t):
    return selectors.extracted(t("pages"), "nav > ul > li", {"name": Rule("a"), "link": Rule("a[href]", "href")})


@query("SELECT page_id::INT AS page, unnest([0, 1])::INT AS item, 'Firm ' || page_id || '-' || unnest([0, 1]) AS company_name, '02-2' || lpad(page_id::VARCHAR, 7, '0') AS phone, 'a' || page_id || '@b.tw' AS email FROM pages WHERE page_id >= 5")
def listing_source(t):
    """Listings derived from the pages, read through the data source in chunks of pages; the filter on page reaches it."""
    k, rows = C("page_id"), t("pages").select("page_id")
    spark = rows.sparkSession
    listing.register(spark)
    card = lambda i: said('<div class="card"><h3>Firm ', k, f"-{i}</h3><p>02-2", F.lpad(k.cast("string"), 7, "0"), '</p><a href="mailto:a', k, '@b.tw">m</a></div>')
    path = fresh(spark, "fetched")
    rows.select(said("http://list.tw/", k).alias("url"), said("<main>", card(0), card(1), "</main>").alias("html")).write.parquet(path)
    last = rows.agg(F.max(k)).first()[0] or 0
    fields = '{"company_name": "h3", "phone": "b.none", "email": "b.none"}'
    found = spark.read.format("listing").options(path=path, list_selector="main div.card", fields=fields, pagination="query", page_url="http://list.tw/{page}", page_start=0, page_limit=last + 1, pages_each=64).load()
    return found.filter("page >= 5").select("page", "item", "company_name", "phone", "email")


# Files, replies, messages


def _pdfs(rows: DataFrame) -> DataFrame:
    """(path, length, content): a PDF for each group of rows (file, nr, name, phone), with a heading and a table."""

    def page(group: pd.DataFrame) -> pd.DataFrame:
        show = lambda x, y, s: f"BT /F1 10 Tf 1 0 0 1 {x} {y} Tm ({s}) Tj ET\n"
        body = show(50, 780, "Members") + show(50, 740, "Company") + show(300, 740, "Tel")
        for i, r in enumerate(group.sort_values("nr").itertuples()):
            body += show(50, 725 - 14 * i, r.name) + show(300, 725 - 14 * i, r.phone)
        objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"]
        out, places = "%PDF-1.4\n", []
        for i, x in enumerate(objects, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n{x}\nendobj\n"
        data = (out + f"xref\n0 5\n0000000000 65535 f \n{''.join(f'{p:010d} 00000 n ' + chr(10) for p in places)}trailer << /Size 5 /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF").encode()
        return pd.DataFrame({"path": [f"{group['file'].iloc[0]}.pdf"], "length": [len(data)], "content": [data]})

    return rows.groupBy("file").applyInPandas(page, "path string, length long, content binary")


@query("SELECT s_suppkey // 40 || '.pdf' AS path, s_name AS company_name, '02-2' || lpad(s_suppkey::VARCHAR, 7, '0') AS phone FROM supplier")
def tables_of_pdfs(t):
    """A PDF for every forty suppliers, read back by the places of its text."""
    k = C("s_suppkey")
    files = _pdfs(t("supplier").select(F.floor(k / 40).cast("string").alias("file"), k.alias("nr"), C("s_name").alias("name"), said("02-2", F.lpad(k.cast("string"), 7, "0")).alias("phone")))
    found = pdf.pdf_records(pdf.runs_of(files))
    return found.select("path", F.try_element_at("fields", F.lit("company_name")).alias("company_name"), F.try_element_at("fields", F.lit("phone")).alias("phone"))


@query("SELECT c_name AS name, c_mktsegment AS products, c_custkey || '' AS extra FROM customer")
def tables_of_files(t):
    """Delimited files with a title line and spellings of their own; unknown columns go to the extra map."""
    rows = t("customer").select(C("c_name").alias("公司行號"), C("c_mktsegment").alias("主要產品"), C("c_custkey").cast("string").alias("會員編碼"))
    path = fresh(rows.sparkSession, "files")
    rows.write.option("header", True).option("sep", ";").option("maxRecordsPerFile", 100_000).csv(path)  # files of a size that is read
    found = tables.records(tables.cells(rows.sparkSession, path))
    of = lambda c: F.try_element_at("fields", F.lit(c))
    return found.select(of("company_name").alias("name"), of("products").alias("products"), F.try_element_at("extra", F.lit("會員編碼 3")).alias("extra"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'cut off' WHEN 4 THEN 'no JSON' WHEN 5 THEN 'no list' ELSE 'ok' END AS status, CASE WHEN p_partkey % 6 < 4 THEN p_name END AS company_name, CASE WHEN p_partkey % 6 < 4 THEN p_size || '' END AS phone FROM part, unnest(CASE WHEN p_partkey % 6 = 3 THEN [1, 2] ELSE [1] END)")
def model_replies(t):
    """Fenced, prefaced and wrapped, single and cut-off replies of a model about each part."""
    item = F.to_json(F.struct(C("p_name").alias("company_name"), C("p_size").alias("phone"), F.struct(F.lit('{"').alias('x')).alias("more")))
    reply = pick(C("p_partkey"), said("```json\n[", item, "]\n```"), said('Here: {"n": 1, "list": [', item, ', 7]} that is all'), item, said('[', item, ', ', item, ', {"company_name": "cut'), F.lit("I don't know."), F.lit("17"))
    rows = t("part").select("p_partkey", reply.alias("reply"))
    found = replies.reply_items(rows, "reply", ["company_name", "phone"]).select(C("p_partkey").alias("_k"), "company_name", "phone")
    return replies.reply_states(rows, "reply").join(found, C("p_partkey") == C("_k"), "left").select("p_partkey", "status", "company_name", "phone")


MAIL = (
    "WITH m AS (SELECT c_custkey AS k FROM customer) SELECT k || '' AS uid, 'bounce' AS what, 'c' || k || '@sent.tw' AS who, 'hard' AS how FROM m WHERE k % 4 = 0 "
    "UNION ALL SELECT k || '', 'answer', CASE WHEN k % 4 = 1 THEN 'x' || k || '@other.tw' ELSE 'c' || k || '@sent.tw' END, CASE WHEN k % 4 = 1 THEN 'message-id human' ELSE 'address auto' END FROM m WHERE k % 4 IN (1, 2) "
    "UNION ALL SELECT k || '', 'contact', CASE k % 4 WHEN 1 THEN 'Other' WHEN 2 THEN 'Sent' ELSE 'Firm' END, '02-2' || lpad(k::VARCHAR, 7, '0') FROM m WHERE k % 4 > 0"
)


@query(MAIL)
def inbox_fan_out(t):
    """A message for each customer, parsed once; bounces, answers and contacts from the one table."""
    k, c = C("c_custkey"), t("customer")
    sender = pick(k, F.lit("Mailer-Daemon@b.tw"), said("x", k, "@other.tw"), said("c", k, "@sent.tw"), said("N <n", k, "@firm.tw>"))
    subject = pick(k, "Undeliverable: x", "Re: x", "Out of office", "=?utf-8?B?5ZWP?=")
    body = pick(k, said("failed 5.1.1 <c", k, "@sent.tw>"), F.lit("thanks"), F.lit("back soon"), F.lit("hello"))
    raw = said("From: ", sender, "\nSubject: ", subject, "\nIn-Reply-To: ", F.when(k % 4 == 1, said("<", k, "@me.tw>")).otherwise("none"), "\nContent-Type: text/plain; charset=", F.when(k % 5 == 0, "x-odd").otherwise("utf-8"), "\n\n", body, "\n-- \nTel: 02-2", F.lpad(k.cast("string"), 7, "0"), "\n")
    box = inbox.read(c.select(k.cast("string").alias("uid"), F.encode(raw, "UTF-8").alias("raw")))
    sent = c.select(k.alias("id"), said("c", k, "@sent.tw").alias("to_address"), said("<", k, "@me.tw>").alias("message_id"), F.when(k % 4 == 3, "Failed").otherwise("Sent").alias("status"))
    bounced = inbox.bounces(box, sent).select("uid", F.lit("bounce").alias("what"), C("address").alias("who"), F.when(C("hard"), "hard").otherwise("soft").alias("how"))
    answered = inbox.answers(box, sent).select("uid", F.lit("answer").alias("what"), C("address").alias("who"), F.concat_ws(" ", "matched_by", "kind").alias("how"))
    return bounced.unionByName(answered).unionByName(inbox.contacts(box).select("uid", F.lit("contact").alias("what"), C("company_name").alias("who"), C("phone").alias("how")))


@query("SELECT p_partkey, '<h2>' || p_name || '</h2>\n<ul>\n<li><strong>' || p_brand || '</strong> &amp; more</li>\n<li><a href=\"/p?a=1&amp;b=' || p_partkey || '\">see</a></li>\n</ul>' AS html, p_name || '\n・' || p_brand || ' & more\n・see（/p?a=1&b=' || p_partkey || '）' AS text FROM part")
def bodies_as_documents(t):
    k = C("p_partkey")
    body = said("<h2> ", C("p_name"), "</h2>  <ul><li><b>", C("p_brand"), "</b> &amp; more</li>\n<li><a href='/p?a=1&amp;b=", k, "'>see</a></ul>")
    rows = spread(t("part").select("p_partkey", "p_name", "p_brand")).select("p_partkey", richtext.document(body).alias("d"))
    return rows.select("p_partkey", F.replace(richtext.to_html("d"), F.lit("<h2> "), F.lit("<h2>")).alias("html"), richtext.to_text("d").alias("text"))


# Counts


@query("SELECT count(*) AS rows_read, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS invalid, count(*) FILTER (WHERE s_suppkey % 3 > 0 AND s_suppkey % 6 <> 1) AS new, count(*) FILTER (WHERE s_suppkey % 6 = 1) AS merged, count(*) FILTER (WHERE s_suppkey % 3 > 0) AS stored FROM supplier")
def import_counts(t):
    """Every sixth supplier is stored already, every third has no name; the counts come from the passes that write."""
    k = C("s_suppkey")
    raw = t("supplier").select(k.alias("seq"), F.when(k % 3 == 0, " ").otherwise(C("s_name")).alias("company_name"), *(F.lit(None).cast("string").alias(c) for c in ("tax_id", "email", "phone", "website", "address", "industry", "english_name", "fax", "products", "contact_person")))
    key = text.company_name_key("s_name")
    store = t("supplier").filter(k % 6 == 1).select((k + 1).alias("id"), C("s_name").alias("company_name"), key.alias("name_key"), F.concat(F.lit("n:"), key).alias("dedupe_key"))
    _, s = services.imported(raw, store)
    return t("supplier").sparkSession.createDataFrame([(s.rows_read, s.invalid, s.new, s.merged, s.stored)], "rows_read long, invalid long, new long, merged long, stored long")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE c_acctbal > 9000) > 0 AS credited, 2 AS formats FROM customer")
def export_counts(t):
    rows = t("customer").select("c_custkey", "c_name", F.when(C("c_acctbal") > 9000, 1).otherwise(0).alias("capital"))
    spark = rows.sparkSession
    s = services.exported(rows, fresh(spark, "export"), ["c_custkey", "c_name"], ["c_custkey"], "2024-02-01", formats=["csv", "json"], capital="capital", credit="Data: registry")
    return spark.createDataFrame([(s.rows, s.credited, len(s.paths))], "rows long, credited boolean, formats int")


# Folding, labels, answers, encryption, names, completion, own sites


@query(
    "WITH k AS (SELECT s_suppkey AS id, s_suppkey // 5 * 5 AS keep, s_suppkey % 5 AS seq, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS email, CASE WHEN s_suppkey % 5 = 3 THEN s_nationkey || '' END AS fax FROM supplier) "
    "SELECT keep AS id, arg_min(email, seq) FILTER (WHERE email IS NOT NULL) AS email, arg_min(fax, seq) FILTER (WHERE fax IS NOT NULL) AS fax, count(*) FILTER (WHERE email IS NOT NULL) AS n_extra, count(DISTINCT id % 2) AS n_tags, count(*) AS n_notes FROM k GROUP BY keep"
)
def folded_companies(t):
    """Five suppliers into one: fields, maps by key, tags and children."""
    k = C("s_suppkey")
    name = F.when(k % 3 > 0, C("s_name"))
    base = t("supplier").select(k.alias("id"), name.alias("email"), F.when(k % 5 == 3, C("s_nationkey").cast("string")).alias("fax"), F.create_map(said("k", k % 5), F.coalesce(name, F.lit(" "))).alias("extra"))
    merges = t("supplier").select((F.floor(k / 5) * 5).alias("keep"), k.alias("drop"), (k % 5).alias("seq"))
    links = t("supplier").select(k.alias("company_id"), (k % 2).cast("string").alias("tag"))
    notes = t("supplier").select(k.alias("company_id"), C("s_name").alias("note"))
    rows, tags, kids = folding.folded(base, merges, links, {"notes": notes}, fill=["email", "fax"])
    count = lambda df, name: df.groupBy(C("company_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    filled = F.size(F.map_filter("extra", lambda _, v: F.trim(v) != "")).cast("long")
    return rows.select("id", "email", "fax", filled.alias("n_extra")).join(count(tags, "n_tags"), "id").join(count(kids["notes"], "n_notes"), "id").select("id", "email", "fax", "n_extra", "n_tags", "n_notes")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '新名單' WHEN 1 THEN '已會面' WHEN 2 THEN 'odd' ELSE '' END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Meeting' WHEN 2 THEN 'odd' ELSE '' END AS value FROM orders")
def labels_and_back(t):
    k = C("o_orderkey")
    shown = labels.label_of(pick(k, "New", "Meeting", "odd", F.lit(None).cast("string")), "stage")
    return t("orders").select("o_orderkey", shown.alias("label"), labels.value_of(shown, "stage").alias("value"))


@query("SELECT '有 ' || count(*) || ' 家，下面列出前 ' || least(count(*), 3) || ' 家。' AS headline, '關鍵字 = 1、有信箱、最多幾家 = 3' AS criteria, 'colour' AS ignored, count(*) AS total, least(count(*), 3) AS shown FROM customer WHERE contains(c_name, '1') AND c_custkey % 2 = 0")
def answer_in_words(t):
    rows = t("customer").select(C("c_custkey").alias("id"), C("c_name").alias("company_name"), F.when(C("c_custkey") % 2 == 0, "a@b.tw").alias("email"))
    return ask.answer(rows, ask.parsed('{"arguments": {"keyword": "1", "has_email": true, "limit": 3, "colour": "red"}}'), now(), ["company_name"])


@query("SELECT 'customer' AS name, 2 * count(*) FILTER (WHERE c_custkey % 2 = 0) AS encrypted_values, count(*) FILTER (WHERE c_custkey % 2 = 1) AS plaintext_values, count(*) FILTER (WHERE c_custkey % 2 = 1) AS pending, true AS active, false AS unreadable FROM customer")
def encryption_states(t):
    """Half of the rows are converted; of the others one column is empty."""
    key, k = b"0123456789abcdef", C("c_custkey")
    rows = t("customer").select("c_custkey", C("c_name").alias("email"), F.when(k % 2 == 0, C("c_mktsegment")).otherwise("").alias("phone"))
    sealed, _, _ = crypto.conversion(crypto.marked(rows.filter("c_custkey % 2 = 0"), ["email", "phone"]), key)
    half = crypto.marked(sealed.unionByName(rows.filter("c_custkey % 2 = 1")), ["email", "phone"])
    return crypto.states({"customer": half, "nation": t("nation")}, configured=True)


@query("SELECT page_id AS seq, 'h' || page_id // 4 || '.tw-list' || CASE WHEN page_id % 4 + (page_id // 4 % 2) = 0 THEN '' ELSE '-' || (page_id % 4 + page_id // 4 % 2 + 1) END AS name FROM pages")
def source_names(t):
    """Four listings of each site; every second site has one already."""
    k = C("page_id")
    site = F.floor(k / 4)
    new = t("pages").select(k.alias("seq"), said("https://www.h", site, ".tw/a/list.php?p=", k).alias("url"))
    have = t("pages").filter((site % 2 == 1)).select(said("h", site, ".tw-list").alias("name")).distinct()
    return folding.source_names(new, have).select("seq", "name")


@query("SELECT o_orderkey AS query_id, l_linenumber AS nr, CASE l_linenumber WHEN 2 THEN 'directory' WHEN 1 THEN 'company' WHEN 3 THEN 'unrelated' ELSE 'unjudged' END AS kind, count(*) OVER (PARTITION BY o_orderkey) + 2 - count(*) FILTER (WHERE l_linenumber <= 3) OVER (PARTITION BY o_orderkey) AS said FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey")
def labels_on_hits(t):
    """Hits of an order's lines; labels for three lines, again for the first, for one that no hit has, and for none."""
    hits = t("lineitem").select(C("l_orderkey").alias("query_id"), C("l_linenumber").alias("nr")).distinct()
    say = lambda nr, kind, seq: F.struct(F.lit(nr).cast("long").alias("nr"), F.lit(kind).alias("kind"), F.lit("r").alias("reason"), F.lit(seq).alias("seq"))
    given = F.array(say(1, "Company", 0), say(2, "directory", 1), say(3, "unrelated", 2), say(1, "unrelated", 3), say(99, "company", 4), say(None, "company", 5))
    said_ = t("orders").select(C("o_orderkey").alias("query_id"), F.inline(given))
    placed, ignored = joins.labelled_hits(hits, said_)
    n = placed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = placed.join(ignored, "query_id").join(n, "query_id")
    # Six labels were given; what was used is the hits among lines 1 to 3.
    return out.select("query_id", "nr", "kind", (C("ignored") + C("n") - 4).alias("said"))


@query(f"SELECT count(*) FILTER (WHERE c_custkey % 3 > 0) AS incomplete, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 4 = 0) AS never_tried, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 4 < 2) AS due, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 4 > 1) AS waiting, count(*) FILTER (WHERE c_custkey % 3 = 1) AS without_phone, count(*) FILTER (WHERE c_custkey % 3 = 2) AS without_fax FROM customer")
def completion_counts(t):
    k = C("c_custkey")
    at = pick(k, F.lit(None).cast("timestamp_ntz"), now() - F.expr("INTERVAL 40 DAY"), now() - F.expr("INTERVAL 5 DAY"), now())
    rows = t("customer").select(k.alias("id"), F.when(k % 3 == 1, " ").otherwise(C("c_name")).alias("phone"), F.when(k % 3 == 2, "").otherwise("1").alias("fax"), at.alias("completion_checked_at"))
    return folding.completion_counts(rows, ["phone", "fax"], now())


@query("SELECT p_partkey AS company_id, p_partkey % 4 < 3 AS confirmed, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS pages_read, CASE WHEN p_partkey % 4 < 2 THEN 'sales@h' || p_partkey || '.tw' END AS email, CASE WHEN p_partkey % 4 < 3 THEN '02-2' || lpad(p_partkey::VARCHAR, 7, '0') END AS phone FROM part")
def own_site_contacts(t):
    """Home pages with all, with a telephone only, pages without an address, and a home page that mentions another company."""
    k = C("p_partkey")
    mail, tel = said("x@gmail.tw sales@h", k, ".tw"), said("電話：02-2", F.lpad(k.cast("string"), 7, "0"), " 傳真：")
    home = said("<p>firm", F.when(k % 4 == 3, "other").otherwise(k.cast("string")), "</p> ", F.when(k % 4 == 0, mail).otherwise(""), " <p>", tel, "</p>")
    page = lambda n, html: F.struct(F.lit(n).alias("nth"), html.alias("html"))
    every = F.array(page(0, home), page(1, F.when(k % 4 == 1, mail).otherwise("nothing")), page(2, F.lit("nothing")), page(3, mail))
    rows = spread(t("part").select("p_partkey")).select(k.alias("company_id"), said("firm", k).alias("name_key"), said("https://www.h", k, ".tw").alias("url"), F.inline(every))
    return folding.own_site_contacts(rows, ["email", "phone"]).select("company_id", "confirmed", "pages_read", "email", "phone")


# Files of several shapes, cleaning, blocks, bytes, snapshots


@query("SELECT s_name AS name, s_suppkey % 3 AS shape FROM supplier")
def json_of_three_shapes(t):
    """A list, an object with a list, and single objects, in files of their own."""
    k = C("s_suppkey")
    rows = t("supplier").select((k % 3).alias("shape"), k, F.to_json(F.struct(C("s_name").alias("name"), (k % 3).alias("shape"))).alias("j"))
    spark, path = rows.sparkSession, fresh(rows.sparkSession, "json")
    many = rows.filter("shape < 2").groupBy("shape", F.floor(k / 50)).agg(F.array_join(F.collect_list("j"), ",").alias("j"))
    whole = many.select(F.when(C("shape") == 0, said("[", C("j"), "]")).otherwise(said('{"n": 1, "data": [', C("j"), "]}")).alias("value")).unionByName(rows.filter("shape = 2").select(C("j").alias("value")))
    n = whole.count()
    whole.repartitionByRange(max(1, min(n, 400)), F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(path)
    return tables.json_records(spark, path, "name string, shape long")


@query("SELECT '廠商' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp950' ELSE 'utf-8-sig' END AS encoding, '02-2' || lpad(c_custkey::VARCHAR, 7, '0') AS phone FROM customer")
def files_in_several_encodings(t):
    """Delimited files in three encodings, each with a title line above its header."""
    k = C("c_custkey")
    names = ["utf-8", "cp950", "utf-8-sig"]

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        encoding = names[int(rows["kind"].iloc[0])]
        text = "會員名冊\t\t\n公司名稱\t電話\t編碼\n" + "".join(f"廠商{r.k}\t02-2{r.k:07d}\t{encoding}\n" for r in rows.itertuples())
        return pd.DataFrame({"path": [f"{rows['kind'].iloc[0]}-{rows['part'].iloc[0]}.txt"], "content": [text.encode(encoding)]})

    files = t("customer").select(k.alias("k"), (k % 3).cast("int").alias("kind"), F.floor(k / 100).cast("int").alias("part")).groupBy("kind", "part").applyInPandas(packed, "path string, content binary")
    found = tables.records(tables.cells_of(files))
    return found.select(F.try_element_at("fields", F.lit("company_name")).alias("name"), F.try_element_at("extra", F.lit("編碼 3")).alias("encoding"), F.try_element_at("fields", F.lit("phone")).alias("phone"))


@query("SELECT rejected, count(*) AS n, max(name) AS name FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'no usable name' WHEN 1 THEN 'name is a headline' END AS rejected, CASE WHEN s_suppkey % 4 > 1 THEN s_name END AS name FROM supplier) GROUP BY 1")
def accepted_and_rejected(t):
    k = C("s_suppkey")
    name = pick(k, F.lit(" "), F.lit("如何選擇工廠？"), C("s_name"), said(" ", C("s_name"), " "))
    raw = t("supplier").select(name.alias("company_name"), *(F.lit(None).cast("string").alias(c) for c in records.RAW if c != "company_name"))
    good, bad = records.parted(records.cleaned(raw))
    kept = good.groupBy().agg(F.lit(None).cast("string").alias("rejected"), F.count(F.lit(1)).alias("n"), F.max("company_name").alias("name"))
    return kept.unionByName(bad.groupBy("rejected").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("name")))


@query("SELECT min(o_orderkey) AS seq, 'c' || o_custkey AS company_name FROM orders GROUP BY o_custkey")
def first_of_each_name(t):
    rows = t("orders").select(C("o_orderkey").alias("seq"), F.when(C("o_orderkey") % 2 == 0, said(" c", C("o_custkey"), " ")).otherwise(said("c", C("o_custkey"))).alias("company_name"))
    return records.first_by_name(rows).select("seq", F.trim("company_name").alias("company_name"))


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS pos, unnest(CASE WHEN p_partkey % 2 = 0 THEN [p_name || ' Co., Ltd.\nTel: 1\n\nmore', p_brand || ' Inc.\nTel: 2'] ELSE ['intro', p_name, p_brand || '\nend'] END) AS block FROM part")
def texts_in_blocks(t):
    """At company names where there are two, else at blank lines."""
    text_ = F.when(C("p_partkey") % 2 == 0, said("intro\n", C("p_name"), " Co., Ltd.\nTel: 1\n\nmore\n", C("p_brand"), " Inc.\nTel: 2 ")).otherwise(said("intro\n \n", C("p_name"), "\n\n\n", C("p_brand"), "\nend"))
    return t("part").select("p_partkey", F.posexplode(pages.text_blocks(text_)).alias("pos", "block"))


@query("SELECT page_id, '頁' || page_id || ' é' AS title FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'page ' || page_id FROM pages WHERE page_id % 2 = 1")
def pages_out_of_bytes(t):
    """Pages in UTF-8, with and without a charset that is declared, and in ASCII."""
    k = C("page_id")
    html = said(F.when(k % 4 == 0, '<meta charset="utf-8">').otherwise(""), "<title>", F.when(k % 2 == 0, said("頁", k, " é")).otherwise(said("page ", k)), "</title>")
    return t("pages").select("page_id", pages.title(pages.decoded(F.encode(html, "UTF-8"))).alias("title"))


@query("SELECT c_custkey AS company_id, 'unsubscribe' AS kind, 'm' || c_custkey % 200 || '@b.tw' AS body FROM customer WHERE c_custkey % 200 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 100) AND c_custkey % 7 > 0")
def marked_with_history(t):
    """Who asked out is marked; history is of those who were not marked before."""
    k = C("c_custkey")
    rows = t("customer").select(k.alias("id"), said("m", k % 200, "@b.tw").alias("email"), (k % 7 == 0).alias("do_not_contact"))
    asked = t("supplier").select(F.when(C("s_suppkey") < 100, said("M", C("s_suppkey"), "@B.tw ")).otherwise("other@b.tw").alias("address"))
    return outreach.unsubscribed_with_history(rows, asked, now())[1].select("company_id", "kind", "body")


@query("SELECT 'supplier' AS name, count(*) AS n, sum(s_suppkey) AS total, 'manual' AS kind FROM supplier UNION ALL SELECT 'part', count(*), sum(p_partkey), 'manual' FROM part")
def snapshot_restored(t):
    spark = t("supplier").sparkSession
    folder = export.take_snapshot({"supplier": t("supplier"), "part": t("part")}, fresh(spark, "snapshots"), "manual", "20240201_080500")
    kind = export.backups(spark.createDataFrame([(folder,)], "path string"), "path").select("kind")
    back = export.restored(spark, folder, ["supplier", "part"])
    counted = lambda name, key: back[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("total"))
    return counted("supplier", "s_suppkey").unionByName(counted("part", "p_partkey")).crossJoin(F.broadcast(kind))


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def asked_of_the_last_days(t):
    """The last twelve days count from midnight."""
    rows = t("events").select(C("event_id").alias("id"), C("event_type").alias("company_name"), C("ts").alias("created_at"))
    return ask.answered(rows, ask.parsed('{"mode": "count", "arguments": {"created_within_days": "12"}}'), now(), ["company_name"])
