"""Queries of small functions on made-up values of the driver's rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identity, text, validate
from ..operators import filters, merge, outreach, records
from ..sources import export, extraction, mail, pages
from .registry import now, query
from .upkeep import C, pick, sql_pick


@query("SELECT p_partkey, " + sql_pick("p_partkey", "ABC 12", "A B", "", "卡") + " AS said FROM part")
def folded_and_squeezed(t):
    x = text.clean(text.halfwidth(pick(C("p_partkey"), "ＡＢＣ　１２ ", "A​  B﻿", " ", "ｶ").alias("x")))
    return t("part").select("p_partkey", F.coalesce(F.replace(x, F.lit("カ"), F.lit("卡")), F.lit("")).alias("said"))


@query("SELECT p_partkey, p_name AS name, '台北市信義路5段' AS address, '王小明' AS person, '製造業' AS industry, '12345678' AS tax_id FROM part")
def normalised_fields(t):
    name = F.concat(F.lit(" ·"), C("p_name"), F.lit("— "))
    return t("part").select("p_partkey", text.company_name(name).alias("name"), text.address(F.lit("地址：110 台北市 信義路 5段")).alias("address"), text.person(F.lit("聯絡人：王小明、")).alias("person"), text.industry(F.lit("產業: 製造業/")).alias("industry"), text.tax_id(F.lit("統編 1234-5678")).alias("tax_id"))


@query("SELECT o_orderkey, " + sql_pick("o_orderkey", "exact", "high", "moderate", "none") + " AS confidence FROM orders")
def key_confidence(t):
    return t("orders").select("o_orderkey", identity.confidence(pick(C("o_orderkey"), "tax:12345675", "np:a|02-1", "n:a", "raw:x")).alias("confidence"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS website, o_orderkey % 2 = 0 AS phone FROM orders")
def valid_websites_and_phones(t):
    k = C("o_orderkey")
    return t("orders").select("o_orderkey", validate.is_website(pick(k, "https://a.tw/x", "ftp://a.tw", "a")).alias("website"), validate.is_phone(pick(k, "02-27235678#12", "12")).alias("phone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n, substr(repeat(c_name, 100), 1, 500) AS long FROM customer")
def extra_fields_tidied(t):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.array(pair(" a ", F.repeat(C("c_name"), 100)), pair("b", F.when(C("c_custkey") % 2 == 0, "x").otherwise(" ")), pair(" ", F.lit("lost")))
    m = t("customer").select("c_custkey", records.tidy_extra(pairs).alias("m"))
    return m.select("c_custkey", F.size("m").alias("n"), F.try_element_at("m", F.lit("a")).alias("long"))


@query("SELECT c_custkey, c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS b FROM customer")
def maps_filled(t):
    old = F.create_map(F.lit("a"), C("c_name"), F.lit("b"), F.when(C("c_custkey") % 2 == 0, "old").otherwise(" "))
    new = F.create_map(F.lit("a"), F.lit("z"), F.lit("b"), F.lit("new"))
    m = t("customer").select("c_custkey", merge.maps_filled(old, new).alias("m"))
    return m.select("c_custkey", F.element_at("m", F.lit("a")).alias("a"), F.element_at("m", F.lit("b")).alias("b"))


@query("SELECT c_custkey, c_custkey % 4 = 1 AS enrichable, c_custkey % 3 < 2 AS registrable FROM customer")
def enrichable_and_registrable(t):
    k = C("c_custkey")
    rows = t("customer").select("c_custkey", F.when(k % 4 < 2, "https://a.tw").alias("site"), F.when(k % 2 == 0, "a@b.tw").otherwise(" ").alias("mail"), F.lit("1").alias("tax"), pick(k, F.lit(None).cast("timestamp_ntz"), now() - F.expr("INTERVAL 180 DAY"), now() - F.expr("INTERVAL 179 DAY")).alias("at"))
    return rows.select("c_custkey", filters.enrichable("site", "mail").alias("enrichable"), filters.registrable("tax", "at", now()).alias("registrable"))


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def columns_kept(t):
    return filters.only(t("customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"], ["c_custkey"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def replies_from_the_written_to(t):
    sent = t("orders").select(C("o_custkey").cast("string").alias("to_address"), F.when(C("o_orderstatus") == "F", "Sent").otherwise("Failed").alias("status"))
    return outreach.answered(t("supplier").select("s_suppkey", C("s_suppkey").cast("string").alias("address")), sent).select("s_suppkey")


@query("WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 4 END AS ref FROM supplier) SELECT uid, CASE WHEN a.o_orderkey IS NOT NULL THEN 'message_id' WHEN b.o_orderkey IS NOT NULL THEN 'address' END AS matched_by, coalesce(a.o_custkey, b.o_custkey) AS company_id FROM r LEFT JOIN m a ON a.o_orderkey = ref LEFT JOIN m b ON b.o_custkey = uid AND b.p = 1")
def replies_matched(t):
    k = C("s_suppkey")
    sent = t("orders").select(C("o_orderkey").alias("id"), F.format_string("<%d@x>", "o_orderkey").alias("message_id"), C("o_custkey").alias("company_id"), C("o_custkey").cast("string").alias("to_address"), C("o_orderdate").alias("sent_at"), F.when(C("o_orderstatus") == "F", "Sent").otherwise("Failed").alias("status"))
    replies = t("supplier").select(k.alias("uid"), k.cast("string").alias("address"), F.when(k % 2 == 0, F.format_string("<none@y> <%d@x>", k * 4)).otherwise("").alias("references"))
    return mail.replied_to(replies, sent).select("uid", "matched_by", "company_id")


@query("SELECT o_orderkey, o_orderkey % 4 > 0 AS bounce, o_orderkey % 3 = 0 AS hard FROM orders")
def bounce_signals(t):
    k = C("o_orderkey")
    is_bounce = outreach.is_bounce(pick(k, "a@b.tw", "MAILER-DAEMON@b.tw", "a@b.tw", "a@b.tw"), pick(k, "text/plain", "text/plain", "multipart/report", "text/plain"), pick(k, "hi", "hi", "hi", "Undeliverable: hi"))
    return t("orders").select("o_orderkey", is_bounce.alias("bounce"), outreach.is_hard(pick(k, "5.1.1", "4.2.2", "5.0.0"), pick(k, "failed", "failed", "delayed")).alias("hard"))


@query("SELECT l_orderkey AS plan, sum(l_quantity) AS total, bool_and(l_linenumber <> 7) AS all_there, bool_and(l_linenumber <> 7) AND sum(CASE WHEN l_linenumber <> 7 THEN l_quantity END) <= 100 AS fits FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS l_quantity FROM lineitem) GROUP BY 1")
def attachment_size_gate(t):
    rows = t("lineitem").select(C("l_orderkey").alias("plan"), F.when(C("l_linenumber") != 7, C("l_quantity")).alias("size"))
    return outreach.size_gate(rows, "plan", "size", 100)


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS overdue FROM orders")
def overdue_runs(t):
    k = C("o_orderkey")
    last = pick(k, F.lit(None).cast("timestamp_ntz"), now(), F.lit(None).cast("timestamp_ntz"))
    rows = t("orders").select("o_orderkey", last.alias("last"), F.when(k % 3 == 2, now() + F.expr("INTERVAL 1 HOUR")).otherwise(now()).alias("due"))
    return rows.select("o_orderkey", dates.is_overdue("last", C("due"), now()).alias("overdue"))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05'")
def sent_since_midnight(t):
    rows = t("events").select(F.when(C("event_type") == "click", "Sent").otherwise("Failed").alias("status"), C("ts").alias("created_at"))
    return outreach.sent_today(rows, F.lit("2024-01-05 13:00:00").cast("timestamp_ntz"))


@query("SELECT r_regionkey, unnest(['https://a.tw/?p=1', 'https://a.tw/?p=2', 'https://a.tw/?p=3']) AS url FROM region")
def pages_of_a_template(t):
    return t("region").select("r_regionkey", F.explode(records.page_urls(F.lit("https://a.tw/?p={page}"), F.lit(1), F.lit(3))).alias("url"))


@query("SELECT c_custkey, unnest([c_name, 'b']) AS item, unnest([c_mktsegment, '']) AS detail FROM customer")
def details_by_place(t):
    z = records.zipped_details(F.array(C("c_name"), F.lit("b")), F.array(C("c_mktsegment")))
    return t("customer").select("c_custkey", F.inline(z))


@query("SELECT c_custkey, c_name, 'new' AS status, CAST(NULL AS INT) AS score FROM customer")
def schema_migrated(t):
    stored = t("customer").select("c_custkey", "c_name", F.lit("gone").alias("old"))
    current = t("customer").select("c_custkey", "c_name", F.lit("x").alias("status"), F.lit(1).alias("score"))
    return records.migrated(stored, current, {"status": "new"})


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"a\":\"' || event_type || '\",\"b\":\"1\"}' ELSE '{}' END AS props FROM events")
def maps_as_json(t):
    said = pick(C("event_id"), F.concat(F.lit('{"b": 1, "a": "'), C("event_type"), F.lit('"}')), "[1]", "{broken")
    return t("events").select("event_id", records.map_to_json(records.map_from_json(said)).alias("props"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 90 + o_orderkey % 10 END AS seconds FROM orders")
def run_seconds(t):
    end = F.when(C("o_orderkey") % 2 == 0, F.timestamp_add("SECOND", (90 + C("o_orderkey") % 10).cast("int"), now()))
    return t("orders").select("o_orderkey", now().alias("a"), end.alias("b")).select("o_orderkey", records.run_summary("a", "b").alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 12.0 ELSE 4.8 END AS names, CASE WHEN o_orderkey % 2 = 0 THEN round(60 * 0.5 + 50 + 16 + 5 + 6, 4) END AS list FROM orders")
def name_and_list_scores(t):
    k = C("o_orderkey")
    one = F.lit(1.0)
    rate = F.when(k % 2 == 0, 0.5).otherwise(0.3)
    return t("orders").select("o_orderkey", F.round(extraction.name_score(one, one, one, one, F.when(k % 2 == 0, 10).otherwise(50)), 4).alias("names"), F.round(extraction.list_score(rate, F.lit(200), F.lit(2), F.lit(10), F.lit(3)), 4).alias("list"))


@query("SELECT page_id % 100 AS host_nr, 'b@h' || page_id % 100 || '.tw' AS email FROM pages GROUP BY 1, 2")
def best_address_of_a_site(t):
    n = (C("page_id") % 100).cast("string")
    said = F.concat(F.lit("info@other.tw zz@gmail.tw info@h"), n, F.lit(".tw b@h"), n, F.lit(".tw"))
    rows = t("pages").select(F.concat(F.lit("https://www.h"), n, F.lit(".tw/x")).alias("url"), F.replace(said, F.lit("info@h"), F.lit("zoe@h")).alias("said"))
    return extraction.site_contacts(rows, "url", "said").select(F.regexp_extract("host", "([0-9]+)", 1).cast("long").alias("host_nr"), "email")


@query("SELECT page_id, 'seen ' || page_id AS said FROM pages")
def text_shown(t):
    html = F.concat(F.lit("<style>no</style><p>seen <!-- no --><b>"), C("page_id").cast("string"), F.lit("</b></p><script>var x = '<p>';</script>"))
    return t("pages").select("page_id", pages.shown_text(html).alias("said"))


@query("SELECT bool_or(s_acctbal > 9000) AS needs_credit FROM supplier")
def credit_needed(t):
    rows = t("supplier").select(F.when(C("s_acctbal") > 9000, 1).otherwise(0).alias("capital"), F.lit("").alias("status"))
    return export.needs_credit(rows, "capital", "status")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier UNION ALL SELECT 'Data: registry', ''")
def credit_row(t):
    rows = t("supplier").select(C("s_suppkey").cast("string").alias("id"), C("s_name").alias("name"))
    return export.with_credit(rows, "Data: registry")


@query("SELECT count(*) AS n, min(pos) AS first FROM (SELECT event_id AS pos FROM events ORDER BY event_id DESC LIMIT 25)")
def log_tail(t):
    return export.tail(t("events").select(C("event_id").alias("pos")), 25).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query("SELECT p_partkey, " + sql_pick("p_partkey", "auto", "manual") + " AS kind, TIMESTAMP '2024-02-01 08:05:00' AS at FROM part WHERE p_partkey % 3 < 2")
def backup_catalogue(t):
    name = F.concat(F.lit("/b/companies_"), F.when(C("p_partkey") % 3 == 2, "junk").otherwise(pick(C("p_partkey"), "auto_20240201_080500", "manual_20240201_080500")), F.lit(".db"))
    return export.backups(t("part").select("p_partkey", name.alias("path")), "path").select("p_partkey", "kind", "at")


@query("SELECT p_partkey, 'Dear ' || p_name || ', no {brand}' AS said FROM part")
def rendered_templates(t):
    return t("part").select("p_partkey", outreach.rendered("Dear {name}, no {brand}", {"name": "p_name", "brand": F.lit("{brand}")}).alias("said"))


@query("SELECT s_suppkey, '<p>' || replace(replace(s_name || ' & <' || s_suppkey || '>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') || ', 您好, 台北市</p>' AS said FROM supplier")
def templates_in_markup(t):
    """Values are escaped where the template is markup; a missing person has a stand-in, a city comes from the address."""
    k = C("s_suppkey").cast("string")
    values = outreach.template_values({"company_name": F.concat(C("s_name"), F.lit(" & <"), k, F.lit(">")), "contact_person": F.lit(" "), "address": F.concat(F.lit("台北市大安區"), k, F.lit("號"))})
    return t("supplier").select("s_suppkey", outreach.rendered("<p>{company_name}, {contact_person}, {city}</p>", values).alias("said"))
