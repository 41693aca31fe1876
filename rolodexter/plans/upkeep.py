"""Queries of answers, tags, notes, registry data, sites, runs and files, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, files, fixed, text, validate
from ..operators import aggregates, ask, filters, joins, merge, outreach, research, upkeep, windows
from ..operators.staging import spread
from ..sources import extraction, mail, pages, tables
from .registry import now, query, quoted

C = F.col


def pick(k, *values):
    """Column: values by k modulo their number."""
    return reduce(lambda out, i: out.when(k % len(values) == i, values[i]), range(1, len(values)), F.when(k % len(values) == 0, values[0]))


def sql_pick(k: str, *values: str) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# Answers

SUBJECTS = ["Out of office", "RE: offer", "休假中", "Re: please STOP EMAILING", "外出 notice", "hello"]
BODIES = ["please unsubscribe me", "thanks", "不要再寄", "take me off", "opt out", "nice", "停寄", "see you", "移除我", "ok", "勿再來信"]
KINDS = f"CASE WHEN regexp_matches(subject, '(?i)stop emailing') OR regexp_matches(body, '(?i)unsubscribe|不要再寄|take me off|opt out|停寄|移除我|勿再來信') THEN 'unsubscribe' WHEN regexp_matches(subject, '(?i)out of office|休假中|外出') OR event_id % 13 = 0 THEN 'auto' ELSE 'human' END"
REPLIES = f"WITH r AS (SELECT event_id, user_id, {sql_pick('event_id', *SUBJECTS)} AS subject, {sql_pick('event_id', *BODIES)} AS body FROM events), k AS (SELECT *, {KINDS} AS kind FROM r) "


def _replies(t):
    k = C("event_id")
    r = t("events").select("event_id", "user_id", pick(k, *SUBJECTS).alias("subject"), pick(k, *BODIES).alias("body"))
    return r.withColumn("kind", outreach.reply_kind(C("subject"), C("body"), precedence=F.when(k % 13 == 0, "Bulk")))


@query(REPLIES + "SELECT event_id, kind, kind <> 'auto' AS ticked, CASE WHEN kind = 'unsubscribe' THEN 'mark' WHEN event_id % 3 = 0 THEN 'advance' ELSE 'note' END AS action FROM k")
def reply_kinds(t):
    stage = pick(C("event_id"), "New", "Won", "Lost")
    return _replies(t).select("event_id", "kind", outreach.suggested(C("kind")).alias("ticked"), outreach.reply_action(C("kind"), stage).alias("action"))


@query(REPLIES + "SELECT user_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE kind WHEN 'unsubscribe' THEN 2 WHEN 'human' THEN 1 ELSE 0 END DESC, event_id) AS p FROM k) WHERE p = 1")
def best_reply_of_each(t):
    return windows.best_of(_replies(t), ["user_id"], [outreach.reply_rank(C("kind")).desc(), F.asc("event_id")]).select("user_id", "event_id", "kind")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'RECENTLY_EMAILED' END WHEN o_orderkey % 4 = 2 THEN 'UNVERIFIED' ELSE 'INVALID_EMAIL' END AS reason FROM orders")
def resend_window(t):
    """The boundary counts as too soon: a message is exactly 30 days old for every third row."""
    k = C("o_orderkey")
    sent = now() - F.when(k % 3 == 0, F.expr("INTERVAL 30 DAY")).otherwise(F.expr("INTERVAL '30 00:00:01' DAY TO SECOND"))
    mail = F.when(k % 4 == 1, " A@b.tw ").when(k % 4 == 2, "c@d.tw").otherwise("nobody")
    return t("orders").select("o_orderkey", outreach.skip_reason(F.lit(False), mail, F.when(k % 4 == 1, "Valid").otherwise("Unknown"), sent, now(), need_valid=True).alias("reason"))


@query("SELECT count(*) AS n FROM customer WHERE contains(lower(c_name), '1') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ask_tagged(t):
    rows = t("customer").select(C("c_custkey").alias("id"), C("c_name").alias("company_name"))
    said = '{"mode": "count", "arguments": {"keyword": "1", "tag": "1-URGENT"}}'
    return ask.answered(rows, ask.parsed(said), now(), ["company_name"], tag_links=(t("orders"), "o_custkey", "o_orderpriority"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN DATE '1987-02-21' END AS day FROM orders")
def roc_date_marks(t):
    return t("orders").select("o_orderkey", dates.roc_date(pick(C("o_orderkey"), "076/02/21", " 0760221", "760221", "0761321")).alias("day"))


@query("SELECT p_partkey, p_name AS heading, '02-' || p_partkey AS phone, 'http://a.b/' || p_partkey AS website, '主席 王小明' AS person, '紅' AS colour, '9' AS later FROM part")
def label_pairs(t):
    """Several pairs on a line, colons in addresses, CJK and Latin names, later values of a field."""
    k = C("p_partkey").cast("string")
    said = F.concat(C("p_name"), F.lit("\nTel︰ 02-"), k, F.lit(" 網址： http://a.b/"), k, F.lit("\n負責人: 主席 王小明 Mr. Wang\n色： 紅 Note: no\nTel: 9"))
    m = t("part").select("p_partkey", pages.labelled(said).alias("m"))
    of = lambda kind, name: F.try_element_at(f"m.{kind}", F.lit(name))
    return m.select("p_partkey", "m.heading", of("fields", "phone").alias("phone"), of("fields", "website").alias("website"), of("fields", "contact_person").alias("person"), of("extra", "色").alias("colour"), of("extra", "Tel").alias("later"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name FROM part")
def text_block_records(t):
    """A block needs two pairs and a name."""
    said = pick(C("p_partkey"), F.concat(C("p_name"), F.lit("\nTel： 1 Fax： 2")), F.concat(C("p_name"), F.lit(" Tel： 1")), F.lit("Tel： 1 Fax： 2"))
    return t("part").select("p_partkey", F.try_element_at(pages.text_record(said)["fields"], F.lit("company_name")).alias("name"))


@query("SELECT p_partkey, " + sql_pick("p_partkey", "company_name", "contact_person", "english_name", "phone", "company_name", "company_name", "products", "phone", "company_name", "none", "remark") + " AS field FROM part")
def header_fields(t):
    headers = pick(C("p_partkey"), "公司名稱 Company", "負責人 name", "Company Name (English)", "TEL", "公司行號", "客戶名稱", "主要產品", "電 話", "工廠名稱", "東海精機股份有限公司", "備註")
    return t("part").select("p_partkey", F.coalesce(tables.field_of(headers), F.lit("none")).alias("field"))


@query("SELECT r_regionkey, 'SINCE 25-Jan-2024' AS since FROM region")
def mailbox_since(t):
    return t("region").select("r_regionkey", files.since_query(F.to_date(now()), 7).alias("since"))


# Stages, bounces, contacts


@query("SELECT o_orderkey AS company_id, 'stage' AS kind, CASE o_orderstatus WHEN 'O' THEN 'New' ELSE 'Contacted' END || ' -> Replied' AS body FROM orders WHERE o_orderstatus IN ('O', 'P')")
def stage_history(t):
    rows = t("orders").select(C("o_orderkey").alias("id"), F.when(C("o_orderstatus") == "O", "New").when(C("o_orderstatus") == "P", "Contacted").otherwise("Replied").alias("stage"))
    return upkeep.stage_changes(rows, F.lit("Replied"), now())[1].select("company_id", "kind", "body")


BOUNCED = "WITH c AS (SELECT c_custkey AS id, 'C' || c_custkey % 500 || '@B.tw' AS email FROM customer), b AS (SELECT 'c' || s_suppkey % 1000 || '@b.tw' AS address, bool_or(s_suppkey % 2 = 0) AS hard FROM supplier GROUP BY 1) "


def _bounces(t):
    rows = t("customer").select(C("c_custkey").alias("id"), F.concat(F.lit("C"), (C("c_custkey") % 500).cast("string"), F.lit("@B.tw")).alias("email"), F.lit("Valid").alias("email_verdict"))
    b = t("supplier").select(F.concat(F.lit("c"), (C("s_suppkey") % 1000).cast("string"), F.lit("@b.tw")).alias("address"), (C("s_suppkey") % 2 == 0).alias("hard"), C("s_suppkey").cast("string").alias("uid"), F.lit("").alias("code"), F.lit("5.1.1").alias("reason"))
    b = mail.worst(b).select("address", "hard", "reason")
    return upkeep.bounces_applied(rows, b, now())


@query(BOUNCED + "SELECT id, CASE WHEN hard THEN 'Bounced' ELSE 'Valid' END AS email_verdict FROM c LEFT JOIN b ON lower(email) = address")
def bounce_verdicts(t):
    return _bounces(t)[0].select("id", "email_verdict")


@query(BOUNCED + "SELECT id AS company_id, CASE WHEN hard THEN 'bounce' ELSE 'soft bounce' END AS kind, '5.1.1' AS body FROM c JOIN b ON lower(email) = address")
def bounce_notes(t):
    return _bounces(t)[1].select("company_id", "kind", "body")


CONTACTS = "WITH k AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS name, o_orderstatus = 'F' AS is_primary, c_name AS company_name FROM orders JOIN customer ON o_custkey = c_custkey) "


def _contacts(t):
    return t("orders").select(C("o_orderkey").alias("id"), C("o_custkey").alias("company_id"), C("o_orderpriority").alias("name"), (C("o_orderstatus") == "F").alias("is_primary")), t("customer").select(C("c_custkey").alias("id"), C("c_name").alias("company_name"))


@query(CONTACTS + "SELECT id, company_id, name, is_primary, company_name, row_number() OVER (PARTITION BY company_id ORDER BY is_primary DESC, lower(name), id) AS place FROM k")
def contacts_in_order(t):
    rows = upkeep.contacts_of(*_contacts(t))
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("is_primary"), F.lower("name"), "id")).cast("long")).select("id", "company_id", "name", "is_primary", "company_name", "place")


@query(CONTACTS + "SELECT id, company_name FROM k WHERE contains(lower(name), '12') OR contains(lower(company_name), '12')")
def contacts_with_text(t):
    return upkeep.contacts_with(*_contacts(t), "12", ["name", "company_name"]).select("id", "company_name")


@query("SELECT o_custkey AS company_id, count(*) AS n FROM orders GROUP BY 1")
def contact_counts(t):
    return aggregates.count_by(_contacts(t)[0], "company_id", "company_id")


# Tags


@query("SELECT o_custkey AS company_id, arg_min(n, pos) AS name FROM (SELECT o_custkey, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS n FROM orders WHERE o_orderkey % 5 > 0) GROUP BY o_custkey, lower(n)")
def tag_set_of_each(t):
    name = F.when(C("o_orderkey") % 5 == 0, F.lit("  ")).when(C("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.lower("o_orderpriority"))
    return upkeep.tag_set(t("orders").select(C("o_custkey").alias("company_id"), name.alias("name"), C("o_orderkey").alias("pos")))


@query("SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_custkey // 3 ELSE o_custkey END AS company_id, o_orderpriority AS tag FROM orders")
def tag_union_on_merge(t):
    moves = t("customer").filter("c_custkey % 3 = 0").select(C("c_custkey").alias("id"), F.floor(C("c_custkey") / 3).cast("long").alias("into"))
    return upkeep.tag_union(t("orders").select(C("o_custkey").cast("long").alias("company_id"), C("o_orderpriority").alias("tag")), moves)


@query("SELECT upper(n_name) AS name FROM nation WHERE n_nationkey % 2 = 0 AND lower(n_name) <> 'france' UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 2 = 1 AND lower(n_name) <> 'france'")
def tags_got_or_created(t):
    n = t("nation")
    have = n.filter("n_nationkey % 2 = 0").select(F.upper("n_name").alias("name"))
    wanted = n.select(F.lower("n_name").alias("name"), C("n_nationkey").alias("pos")).unionByName(n.select(F.upper("n_name").alias("name"), (C("n_nationkey") + 100).alias("pos")))
    return upkeep.without_tag(upkeep.with_tags(have, wanted), " France ")


# Records and their children


@query("SELECT c_custkey, 'n:' || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS dedupe_key, 'manual' AS source FROM customer")
def entered_by_hand(t):
    none = F.lit(None).cast("string")
    rows = t("customer").select("c_custkey", F.concat(C("c_name"), F.lit(" 股份有限公司")).alias("company_name"), *(none.alias(c) for c in ("tax_id", "email", "phone", "website")))
    return upkeep.by_hand(rows).select("c_custkey", "dedupe_key", "source")


@query("WITH c AS (SELECT c_custkey AS id, 'k' || c_custkey AS old, 'k' || (c_custkey // 2 * 2 + CASE WHEN c_custkey % 10 < 4 THEN 1000000 ELSE 0 END) AS new FROM customer), f AS (SELECT new, min(id) AS id FROM c WHERE new <> old AND new NOT IN (SELECT old FROM c) GROUP BY new) SELECT c.id, coalesce(f.new, old) AS dedupe_key, f.id IS NOT NULL AS adopted FROM c LEFT JOIN f ON f.id = c.id")
def keys_adopted_when_free(t):
    k = C("c_custkey").cast("long")
    rows = t("customer").select(k.alias("id"), F.concat(F.lit("k"), k.cast("string")).alias("dedupe_key"))
    new = F.concat(F.lit("k"), (F.floor(C("id") / 2) * 2 + F.when(C("id") % 10 < 4, 1000000).otherwise(0)).cast("string"))
    return upkeep.renormalised(rows, new).select("id", "dedupe_key", "adopted")


@query(
    "WITH c AS (SELECT c_custkey AS id, c_custkey AS tax_id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 5 END AS capital, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS person FROM customer), "
    "g AS (SELECT s_suppkey AS tax_id, s_nationkey AS capital, s_name AS responsible FROM supplier) "
    "SELECT id, CASE WHEN g.tax_id IS NULL THEN c.status ELSE 'new' END AS status, CASE WHEN g.capital > 0 THEN CAST(g.capital AS BIGINT) ELSE c.capital END AS capital, coalesce(person, responsible) AS person, g.tax_id IS NOT NULL AS checked, "
    "g.tax_id IS NOT NULL AND (c.status <> 'new' OR (g.capital > 0 AND g.capital IS DISTINCT FROM c.capital) OR person IS NULL OR id % 5 > 0) AS changed FROM c LEFT JOIN g USING (tax_id)"
)
def registry_applied(t):
    k = C("c_custkey")
    had = F.create_map(F.lit("登記狀態"), F.when(k % 5 == 0, "new").otherwise("before"))
    rows = t("customer").select(k.alias("id"), k.cast("string").alias("tax_id"), F.when(k % 2 == 0, "old").otherwise("new").alias("registration_status"), F.when(k % 3 == 0, 5).cast("long").alias("capital_amount"), F.when(k % 4 == 0, C("c_name")).alias("contact_person"), F.lit("x").alias("address"), had.alias("extra_fields"))
    s = t("supplier").select(C("s_suppkey").cast("string").alias("tax_id"), F.lit("new").alias("status"), C("s_nationkey").cast("long").alias("capital"), C("s_name").alias("responsible"), F.lit("y").alias("location"), F.create_map(F.lit("登記狀態"), F.lit("new")).alias("extra"))
    out = upkeep.registered(rows, s, now())
    return out.select("id", C("registration_status").alias("status"), C("capital_amount").alias("capital"), C("contact_person").alias("person"), C("registration_checked_at").isNotNull().alias("checked"), C("registry_changed").alias("changed"))


@query("SELECT c_custkey AS id, 'Customer ' || c_custkey || ' Inc' AS company_name, c_custkey % 7 AS number FROM customer WHERE c_custkey % 3 > 0")
def registry_match_by_name(t):
    k = C("c_custkey")
    customers = spread(t("customer").select("c_custkey"))
    c = customers.select(k.alias("id"), F.concat(F.lit("customer "), k.cast("string"), F.lit(" Co., Ltd.")).alias("company_name"))
    named = lambda pos, name, n: customers.select(k.alias("id"), F.lit(pos).alias("pos"), name.alias("company_name"), n.alias("number"))
    near = named(0, F.concat(F.lit("Customer "), k.cast("string"), F.lit("0 Inc")), F.lit(-1))
    good = named(1, F.concat(F.lit("Customer "), k.cast("string"), F.lit(" Inc")), (k % 7).cast("int")).filter("id % 3 > 0")
    later = named(2, F.concat(F.lit("CUSTOMER "), k.cast("string")), F.lit(-2)).filter("id % 3 > 0")
    return upkeep.matched_by_name(c, near.unionByName(good).unionByName(later))


@query("SELECT s_suppkey, " + sql_pick("s_suppkey", "rows", "none", "busy", "busy", "rows") + " AS state FROM supplier")
def registry_states(t):
    bodies = pick(C("s_suppkey"), '[{"Company_Name": "a"}]', " ", "<html>busy</html>", "[{broken", '{"Company_Name": "b"}')
    return t("supplier").select("s_suppkey", research.registry_state(bodies).alias("state"))


@query("SELECT s_suppkey, s_name AS company_name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS BIGINT) END AS capital, DATE '1987-02-21' AS setup_date, '1,234' AS paid, s_suppkey % 2 = 0 AS active FROM supplier")
def registry_answers(t):
    k = C("s_suppkey")
    body = F.concat(F.lit('[{"Business_Accounting_NO": "1", "Company_Name": " '), C("s_name"), F.lit('", "Capital_Stock_Amount": "'), F.when(k % 3 > 0, k).otherwise(-k).cast("string"), F.lit('", "Paid_In_Capital_Amount": 1234, "Company_Setup_Date": "0760221", "Company_Status_Desc": "'), F.when(k % 2 == 0, "核准設立").otherwise("解散"), F.lit('"}]'))
    rows = research.registry_rows(t("supplier").select("s_suppkey", body.alias("body")), "body")
    return rows.select("s_suppkey", "company_name", "capital", "setup_date", F.try_element_at("extra", F.lit("實收資本額")).alias("paid"), "active")


@query("SELECT s_suppkey, 'https://x.tw/a?$format=json&$filter=Business_Accounting_NO%20eq%20' || s_suppkey || '&$skip=0&$top=1' AS by_id, 'https://x.tw/b?$format=json&$filter=Company_Name%20like%20' || url_encode(s_name) || '%20and%20Company_Status%20eq%2001&$skip=0&$top=10' AS by_name FROM supplier")
def registry_urls(t):
    return t("supplier").select("s_suppkey", research.query_url("https://x.tw/a", C("s_suppkey").cast("string")).alias("by_id"), research.name_query_url("https://x.tw/b", "s_name").alias("by_name"))


@query("SELECT coalesce(c.c_custkey, 0) AS k, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS name FROM customer c WHERE c_custkey % 4 > 0 UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier")
def children_added_edited_removed(t):
    rows = t("customer").select(C("c_custkey").cast("long").alias("id"), C("c_name").alias("name"))
    new = t("supplier").select(C("s_name").alias("name"), C("s_suppkey").alias("seq"))
    out = upkeep.added(rows, new)
    out = upkeep.edited(out, rows.filter("id % 10 = 0").select("id", F.lit("changed").alias("name")), ["name"])
    return upkeep.removed(out, rows.filter("id % 4 = 0")).select(C("id").alias("k"), "name")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_name)) = 'customer#000000007'")
def lookup_folded(t):
    return upkeep.found_by(t("customer"), "c_name", " CUSTOMER#000000007 ", fold=True).select("c_custkey", "c_name")


# Caches, runs, counts


@query("SELECT user_id AS domain, arg_max(event_type, (ts, event_id)) AS has_mx FROM events GROUP BY 1")
def mx_cache_written(t):
    e = t("events").select(C("user_id").alias("domain"), C("event_type").alias("has_mx"), F.struct("ts", "event_id").alias("at"))
    return upkeep.cache_written(e.filter("domain % 2 = 0"), e.filter("domain % 2 = 1"), "domain", "at").select("domain", "has_mx")


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def mx_cache_cleared(t):
    return upkeep.cache_cleared(t("events"), "ts", F.lit("2024-01-10").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN user_id END AS resume_marker FROM events")
def resume_markers_cleared(t):
    rows = t("events").select("event_id", C("event_type").alias("source"), C("user_id").alias("resume_marker"))
    return upkeep.resume_cleared(rows, "click").select("event_id", "resume_marker")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(t):
    return upkeep.recent(t("events").select("event_id", "ts"), 20, "ts", "event_id")


RUN = (
    "WITH b AS (SELECT o_orderkey AS seq, o_custkey AS k, o_orderpriority AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders), o AS (SELECT run, CASE WHEN nth > 1 THEN 'duplicate' WHEN seq % 5 = 0 THEN 'invalid' WHEN k % 3 = 0 THEN 'known' WHEN k % 2 = 0 THEN 'updated' ELSE 'new' END AS outcome FROM b) "
)


@query(RUN + "SELECT run, count(*) AS found, count(*) FILTER (WHERE outcome = 'new') AS records_new, count(*) FILTER (WHERE outcome = 'updated') AS records_updated, count(*) FILTER (WHERE outcome IN ('duplicate', 'updated')) AS records_duplicate, count(*) FILTER (WHERE outcome = 'invalid') AS records_invalid, count(*) FILTER (WHERE outcome = 'known') AS records_skipped_known FROM o GROUP BY run")
def run_counters(t):
    batch = t("orders").select(C("o_orderkey").alias("seq"), C("o_custkey").alias("dedupe_key"), C("o_orderpriority").alias("run"), F.when(C("o_orderkey") % 5 == 0, "no usable name").alias("rejected"))
    keys = t("orders").select(C("o_custkey").alias("dedupe_key"))
    return upkeep.run_counts(upkeep.outcomes(batch, keys.filter("dedupe_key % 3 = 0"), keys.filter("dedupe_key % 2 = 0")), ["run"])


@query("SELECT v AS verdict, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS v) LEFT JOIN orders ON o_orderstatus = v GROUP BY v")
def verification_histogram(t):
    return upkeep.verdict_histogram(t("orders"), ["F", "O", "P", "X"], "o_orderstatus")


@query("WITH l AS (SELECT c_custkey, 'name' AS field, substr(c_name, 1, 60) AS value FROM customer UNION ALL SELECT c_custkey, 'segment', nullif(c_mktsegment, 'BUILDING') FROM customer) SELECT field, CAST(nth AS INT) AS nth, value FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c_custkey) AS nth FROM l WHERE value IS NOT NULL) WHERE nth <= 3")
def preview_samples(t):
    rows = t("customer").select("c_custkey", C("c_name").alias("name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return upkeep.samples(rows, ["name", "segment"], "c_custkey")


@query("WITH l AS (SELECT page_id % 100 AS page_id, '/f' || page_id % 7 || " + sql_pick("page_id", ".PDF?x=1", ".docx", ".html", ".xlsx#a") + " AS href FROM pages) SELECT page_id, CASE WHEN contains(href, '.PDF') THEN 'pdf' WHEN contains(href, '.docx') THEN 'text' ELSE 'table' END AS kind, count(DISTINCT href) AS n FROM l WHERE NOT contains(href, '.html') GROUP BY 1, 2")
def document_links_by_kind(t):
    k = C("page_id")
    rows = t("pages").select((k % 100).alias("page_id"), F.concat(F.lit("/f"), (k % 7).cast("string"), pick(k, ".PDF?x=1", ".docx", ".html", ".xlsx#a")).alias("href"))
    return upkeep.document_links(rows, {"pdf": "pdf", "docx": "text", "xlsx": "table"})


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NO_EMAIL' END AS r FROM orders), q AS (SELECT o_orderkey FROM o WHERE r IS NULL ORDER BY o_orderkey LIMIT 40) SELECT o.o_orderkey, CASE WHEN r IS NULL AND q.o_orderkey IS NULL THEN 'BATCH_CAP' ELSE r END AS skip_reason FROM o LEFT JOIN q USING (o_orderkey)")
def batch_cap(t):
    rows = t("orders").select("o_orderkey", F.when(C("o_orderkey") % 3 == 0, "NO_EMAIL").alias("skip_reason"))
    return upkeep.within_batch(rows, C("skip_reason").isNull(), [F.asc("o_orderkey")], 40, "o_orderkey")


@query("SELECT page_id, href, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY strong DESC, pos) AS nth FROM (SELECT page_id, pos, href, (contains(href, 'contact')::INT + contains(href, 'about')::INT) AS strong FROM (SELECT page_id, unnest(range(4)) AS pos FROM pages) JOIN (SELECT unnest([0, 1, 2, 3]) AS pos, unnest(['/x', '/about', '/y', '/contact']) AS href) USING (pos))) WHERE nth <= 2")
def contact_links_top(t):
    """Strong words first, then page order."""
    rows = t("pages").select("page_id", F.posexplode(F.array(*map(F.lit, ["/x", "/about", "/y", "/contact"]))).alias("pos", "href"))
    return pages.contact_links(rows, ["contact", "about"], 2).select("page_id", "href", "nth")


# Sites


SITES = "WITH h AS (SELECT page_id % 50 AS company_id, page_id AS pos, CASE page_id % 5 WHEN 0 THEN 'https://www.portal.com/' || page_id WHEN 1 THEN 'https://a' || page_id % 20 || '.tw/acme' || page_id % 50 || 'x' WHEN 2 THEN 'https://b.tw/c/12345678' ELSE 'https://h' || page_id % 15 || '.tw/p' || page_id END AS url FROM pages) "


@query(SITES + "SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY pos) AS INT) AS nth, url FROM (SELECT company_id, regexp_extract(url, '//([^/]*)', 1) AS host, min(pos) AS pos, arg_min(url, pos) AS url FROM h WHERE NOT contains(url, 'portal') AND NOT contains(url, '/acme') AND NOT contains(url, '12345678') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY pos) <= 3")
def candidate_sites(t):
    k = C("page_id")
    s = lambda c: c.cast("string")
    other = F.concat(F.lit("https://h"), s(k % 15), F.lit(".tw/p"), s(k))
    url = pick(k, F.concat(F.lit("https://www.portal.com/"), s(k)), F.concat(F.lit("https://a"), s(k % 20), F.lit(".tw/acme"), s(k % 50), F.lit("x")), F.lit("https://b.tw/c/12345678"), other, other)
    hits = t("pages").select((k % 50).alias("company_id"), k.alias("pos"), url.alias("url"), F.concat(F.lit("acme"), s(k % 50)).alias("name_key"), F.lit("12345678").alias("tax_id"))
    return research.candidate_sites(hits, ["portal.com"])


@query("SELECT p_partkey, p_partkey % 3 = 0 AS mentioned FROM part")
def page_mentions_company(t):
    k = C("p_partkey")
    page = F.when(k % 3 == 0, F.concat(F.lit("歡迎 ＡＣＭＥ "), k.cast("string"), F.lit(" 臺灣 股份"))).otherwise("something else")
    return t("part").select("p_partkey", research.mentions_company(page, F.when(k % 3 < 2, F.concat(F.lit("acme"), k.cast("string"), F.lit("台灣"))).otherwise("s")).alias("mentioned"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'Acme ' || p_partkey END AS name, CASE WHEN p_partkey % 4 < 2 THEN '(02) 2723-' || p_partkey END AS phone, CASE WHEN p_partkey % 4 = 0 THEN 'https://www.acme.tw/' || p_partkey END AS website, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END AS INT) AS n_dropped, p_partkey % 4 = 3 AS whole FROM part")
def grounded_values(t):
    k = C("p_partkey")
    s = k.cast("string")
    page = F.concat(F.lit("公司 ＡＣＭＥ "), s, F.lit(" 電話 02 2723 "), s, F.lit(" www.acme.tw/"), s)
    name = F.when(k % 4 < 3, F.concat(F.lit("Acme "), s)).otherwise("Made Up")
    phone = F.when(k % 4 < 2, F.concat(F.lit("(02) 2723-"), s)).otherwise("n/a")
    site = F.when(k % 4 == 0, F.concat(F.lit("https://www.acme.tw/"), s)).otherwise("https://no.tw")
    rows = t("part").select("p_partkey", name.alias("company_name"), phone.alias("phone"), site.alias("website"), page.alias("page"))
    got = research.grounded(rows, "page", ["phone", "website"])
    return got.select("p_partkey", C("company_name").alias("name"), "phone", "website", F.size("dropped").alias("n_dropped"), "whole")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '林伯洲' END AS person, CASE WHEN p_partkey % 3 < 2 THEN '02-27235678' END AS phone FROM part")
def usable_contacts(t):
    k = C("p_partkey")
    return t("part").select("p_partkey", research.usable_person(pick(k, "聯絡人：林伯洲", "服務時間 9-5", "a@b.tw")).alias("person"), research.usable_phone(pick(k, "02-2723-5678 02-2723-1234", "(02)2723-5678", "none")).alias("phone"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS BIGINT) END AS nr, substr('a b ' || p_name, 1, 60) AS reason FROM part")
def label_coercions(t):
    k = C("p_partkey")
    return t("part").select("p_partkey", research.as_index(F.when(k % 2 == 0, F.concat(F.lit("no. "), k.cast("string"))).otherwise("none")).alias("nr"), research.as_reason(F.concat(F.lit(" a\n b  "), C("p_name"))).alias("reason"))


# Files, versions, bodies


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1024 THEN o_orderkey || ' B' WHEN o_orderkey < 1048576 THEN printf('%.1f KB', o_orderkey / 1024.0) ELSE printf('%.1f MB', o_orderkey / 1048576.0) END AS size FROM orders")
def human_sizes(t):
    return t("orders").select("o_orderkey", files.human_size("o_orderkey").alias("size"))


@query("SELECT p_partkey, " + sql_pick("p_partkey", "a_b_c.txt", "attachment", "report", "x" * 116 + ".pdf") + " AS name FROM part")
def safe_file_names(t):
    return t("part").select("p_partkey", files.safe_name(pick(C("p_partkey"), "/tmp/a:b?c.txt", " .. ", "report. ", "x" * 150 + ".pdf")).alias("name"))


@query("SELECT o_orderkey, (o_orderkey % 30) >= 9 AS newer FROM orders")
def version_order(t):
    mine = F.concat(F.lit("1."), (C("o_orderkey") % 30).cast("string"), F.lit(".0"))
    return t("orders").select("o_orderkey", (files.version(mine) > files.version(F.lit("v1.9"))).alias("newer"))


@query("SELECT s_suppkey, '1.' || s_suppkey AS version, '- ' || s_name AS notes FROM supplier")
def newest_change(t):
    log = F.concat(F.lit("# Changes\n\n## 1."), C("s_suppkey").cast("string"), F.lit(" — now\n\n- "), C("s_name"), F.lit("\n\n## 1.0\n\n- first\n"))
    return t("supplier").select("s_suppkey", files.newest_version(log).alias("v")).select("s_suppkey", "v.version", "v.notes")


@query("SELECT page_id, regexp_matches(html, '(?i)<(p|br|div|ul|li|h[1-6]|strong|b|em|i|u|a|img)\\b[^>]*>') AS is_html FROM pages UNION ALL SELECT -1 - page_id, false FROM pages")
def html_or_text(t):
    p = t("pages").select("page_id", "html").unionByName(t("pages").select((-1 - C("page_id")).alias("page_id"), F.lit("price < 100 > 80 <3").alias("html")))
    return p.select("page_id", files.looks_like_html("html").alias("is_html"))


@query("SELECT p_partkey, p_name || ' & \"co\"' || chr(10) || 'two' || chr(10) || chr(10) || 'three' AS said, '<p>' || p_name || ' &amp; &quot;co&quot;<br>two</p>' || chr(10) || '<p>three</p>' AS html FROM part")
def text_html_round_trip(t):
    html = files.text_to_html(F.concat(C("p_name"), F.lit(' & "co"\ntwo\n \nthree\n')))
    return t("part").select("p_partkey", files.html_to_text(html).alias("said"), html.alias("html"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hi' || chr(10) || chr(10) || 'Say no.' WHEN 1 THEN '<p>hi</p>' || chr(10) || '<p style=\"color:#888;font-size:12px\">Say no.</p>' ELSE 'x Say no. y' END AS body FROM part")
def unsubscribe_note(t):
    return t("part").select("p_partkey", files.with_note(pick(C("p_partkey"), "hi \n", "<p>hi</p>", "x Say no. y"), "Say no.").alias("body"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS subject, 'Dear all' AS body FROM part")
def template_store(t):
    source = F.when(C("p_partkey") % 2 == 0, F.concat(F.lit("Subject: "), C("p_name"), F.lit("\r\n\r\nDear all"))).otherwise("Dear all")
    return t("part").select("p_partkey", files.template_parts(source).alias("x")).select("p_partkey", "x.subject", "x.body")


# Records and names


@query("SELECT o_orderkey, " + sql_pick("o_orderkey", "yes", "yes", "no", "yes", "no") + " = 'yes' AS marked FROM orders")
def company_markers(t):
    names = pick(C("o_orderkey"), "大同實業", "老王豆漿店", "台北市信義路五段七號", "Acme Ltd.", "王小明")
    return t("orders").select("o_orderkey", validate.has_company_marker(names).alias("marked"))


@query("SELECT c_custkey, name, segment FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'detail ' || c_custkey END AS name, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 < 4 THEN 'from page' END) AS segment FROM customer)")
def detail_pages_merged(t):
    """A list's rows with what their detail pages add to blanks, the first that is not blank in order; every fifth row has no page."""
    k = C("c_custkey")
    rows = t("customer").select("c_custkey", F.when(k % 2 == 0, C("c_name")).otherwise(F.when(k % 5 == 4, F.concat(F.lit("detail "), k.cast("string"))).otherwise(" ")).alias("name"), F.when(k % 3 > 0, C("c_mktsegment")).alias("segment"), F.concat(F.lit("/d/"), k.cast("string")).alias("url"))
    details = t("customer").filter("c_custkey % 5 < 4").select(F.concat(F.lit("/d/"), k.cast("string")).alias("url"), F.concat(F.lit("detail "), k.cast("string")).alias("name"), F.lit("from page").alias("segment"), F.lit(2).alias("seq"))
    blank = details.withColumns({"name": F.lit(" "), "segment": F.lit(""), "seq": F.lit(1)})
    later = details.withColumns({"name": F.lit("later"), "segment": F.lit("later"), "seq": F.lit(3)})
    return joins.with_details(rows, blank.unionByName(later).unionByName(details), "url", ["name", "segment"]).select("c_custkey", "name", "segment")


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/p/' || (page_id + 1) || '?a=1&b=2' AS next FROM pages WHERE page_id % 4 < 3")
def next_links(t):
    """Links are resolved against the page's own address; places of the page itself and scripts are none."""
    k = C("page_id")
    words = pick(k, "下一頁", "更多", "次頁", "Next steps")
    html = F.concat(F.lit('<nav><a href="#p2">next</a><a href="/p/0">Home</a> <a class="x" href="/p/'), (k + 1).cast("string"), F.lit('?a=1&amp;b=2">'), words, F.lit('</a><a href="/z">Next steps</a><a href="JavaScript:go(2)">&gt;&gt;</a></nav>'))
    return pages.next_links(t("pages").select("page_id", "url", html.alias("html"))).select("page_id", "next")


@query("SELECT page_id, '02-2740' || lpad(page_id::VARCHAR, 4, '0') || '#210' AS first, '04-22' || lpad(page_id::VARCHAR, 6, '0') AS second, 'info' || page_id || '@firm.tw' AS email FROM pages")
def contacts_in_running_text(t):
    """Blanks in brackets, extensions, an entity for the at sign, and a tax id before a postcode, which is no number."""
    k = lambda n: F.lpad(C("page_id").cast("string"), n, "0")
    html = F.concat(F.lit("<p>30878408 110臺北市 (02 )2740"), k(4), F.lit("轉210</p><p>04-22"), k(6), F.lit("</p><p>info"), C("page_id").cast("string"), F.lit("&#64;firm.tw</p>"))
    got = pages.harvested(t("pages").select("page_id", html.alias("html")))
    return got.select("page_id", F.get("phones", F.lit(0)).alias("first"), F.get("phones", F.lit(1)).alias("second"), F.get("emails", F.lit(0)).alias("email"))


@query("SELECT page_id, 'div' AS tag, 'card' AS class, 8 + page_id % 5 AS n FROM pages")
def striped_lists(t):
    """Rows that take turns with classes are one list, and beat a menu of six."""
    k = C("page_id")
    menu = F.lit('<ul class="menu">' + "".join(f'<li class="m"><a href="/{i}">加入會員專區 {i}</a></li>' for i in range(6)) + "</ul>")
    rows = F.array_join(F.transform(F.sequence(F.lit(1), (8 + k % 5).cast("int")), lambda i: F.concat(F.lit('<div class="card '), F.when(i % 2 == 0, "even").otherwise("odd"), F.when(i == 1, " first").otherwise(""), F.lit('"><h3>大同'), i.cast("string"), F.lit("有限公司</h3><p>02-2700123"), (i % 10).cast("string"), F.lit("</p></div>"))), "")
    return pages.list_blocks(pages.list_items(t("pages").select("page_id", F.concat(F.lit("<body>"), menu, rows, F.lit("</body>")).alias("html")))).select("page_id", "tag", "class", "n")


@query("SELECT page_id, 'link' || page_id || '@b.tw' AS email, '02-27235678' AS phone FROM pages")
def harvested_contacts(t):
    """Addresses and numbers in links come before those in the text."""
    html = F.concat(F.lit("text@b.tw 04-22223333 <a href='mailto:Link"), C("page_id").cast("string"), F.lit("@b.tw?subject=x'>x</a><a href='tel:02-2723-5678'>y</a>"))
    got = pages.harvested(t("pages").select("page_id", html.alias("html")))
    return got.select("page_id", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"))


@query("SELECT o_orderkey, round(r, 4) AS hit_rate FROM (SELECT o_orderkey, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE r >= 0.35")
def selectors_that_hit(t):
    rows = t("lineitem").join(t("orders").select(C("o_orderkey").alias("l_orderkey")), "l_orderkey")
    got = rows.groupBy(C("l_orderkey").alias("o_orderkey")).agg(aggregates.share(C("l_discount") > 0.05).alias("r"))
    return got.filter(C("r") >= extraction.LEAST_HITS).select("o_orderkey", F.round("r", 4).alias("hit_rate"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 5 > 0")
def scheduled_recipients(t):
    """A schedule's audience as a search: never who may not be contacted."""
    k = C("c_custkey")
    rows = t("customer").withColumn("email", F.when(C("c_acctbal") > 0, "a@b.tw").otherwise(" ")).withColumn("do_not_contact", k % 5 == 0)
    return rows.filter(outreach.recipients({"c_mktsegment": ["BUILDING", "MACHINERY"]})).select("c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'customer' END AS reason FROM orders")
def non_names(t):
    value = pick(C("o_orderkey"), "2024/01/02 10:00", "大同公司", "acme")
    return t("orders").select("o_orderkey", F.when(~validate.is_not_a_name(value), "customer").alias("reason"))


@query(f"SELECT s_suppkey, s_name NOT IN ({quoted(fixed.NOT_A_COMPANY)}) AS usable FROM supplier")
def company_names_usable(t):
    return t("supplier").select("s_suppkey", validate.is_company_name("s_name").alias("usable"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@b.tw' END AS plain, c_custkey % 2 = 0 AS sealed FROM customer")
def encrypted_in_bulk(t):
    from ..functions import crypto

    key = bytes(range(32))
    mail = F.when(C("c_custkey") % 2 == 0, F.concat(F.lit(" "), C("c_name"), F.lit("@B.tw ")))
    sealed = crypto.converted(t("customer").select("c_custkey", mail.alias("email"), F.lit("enc:v1:broken").alias("note")), ["email", "note"], key, emails=["email"])
    back = crypto.converted_back(sealed, ["email", "note"], key)
    return back.join(sealed.select(C("c_custkey").alias("k"), C("email").alias("e")), C("c_custkey") == C("k")).filter("note = 'enc:v1:broken'").select("c_custkey", C("email").alias("plain"), F.coalesce(C("e").startswith("enc:v1:"), F.lit(False)).alias("sealed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'lead_score' WHEN o_orderkey % 4 = 1 THEN 'updated_at' ELSE 'company_name' END AS by, o_orderkey % 4 < 2 AS descending FROM orders")
def sort_presets(t):
    names = F.create_map(*(F.lit(x) for name, (by, down) in filters.PRESETS.items() for x in (name, F.struct(F.lit(by).alias("by"), F.lit(down).alias("descending")))))
    preset = pick(C("o_orderkey"), "score", "newest", "name", "unheard of")
    return t("orders").select("o_orderkey", F.coalesce(F.try_element_at(names, preset), F.element_at(names, F.lit("name"))).alias("p")).select("o_orderkey", "p.by", "p.descending")
