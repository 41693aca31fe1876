"""The operators bound to the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, dates, fixed, identity, score, text, validate
from ..operators import aggregates, ask, filters, joins, merge, outreach, sequential, windows
from ..sources import export, extraction, pages
from .registry import QUERIES, SQL, now, query, quoted, NOW, table  # noqa: F401

# Filters, order, paging


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7') OR contains(lower(c_mktsegment), 'build')")
def filter_text_any_column(t):
    c = t("customer")
    some = lambda w: filters.Search(text=w, text_columns=["c_name", "c_mktsegment"]).predicate()
    return c.filter(some("7") | some("BUILD")).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def filter_in_lists_and_range(t):
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    s = filters.Search(among={"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, between={"o_orderdate": (stamp("1995-01-01"), stamp("1996-12-31"))})
    return t("orders").filter(s.predicate()).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


@query("SELECT event_id, user_id FROM events WHERE nullif(trim(props), '') IS NOT NULL AND ts IS NOT NULL AND ts <= TIMESTAMP '2024-01-10'")
def filter_presence_and_due(t):
    s = filters.Search(presence={"props": True}, due={"ts": F.lit("2024-01-10").cast("timestamp_ntz")})
    return t("events").filter(s.predicate()).select("event_id", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def filter_one_day(t):
    return t("events").filter(filters.day("ts", "2024-01-05")).select("event_id", "ts")


@query("SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def search_sorted_page(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = filters.Search(order_by="c_acctbal", descending=True, offset=10, limit=20)
    return filters.search(rows, s, ["c_acctbal", "c_name"], "c_custkey", "c_custkey").select("c_custkey", "c_name", "n_name", "c_acctbal")


@query("SELECT doc_id, nullif(lang, 'en') AS lang FROM documents ORDER BY (nullif(lang, 'en') IS NULL), lower(nullif(lang, 'en')), doc_id")
def sort_blanks_grouped(t):
    rows = t("documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    return filters.ordered(rows, "lang", sortable=["lang"], tie="doc_id")


@query("SELECT c_custkey, coalesce(nullif(trim(nullif(c_mktsegment, 'BUILDING')), ''), 'unsorted') AS industry, nullif(c_mktsegment, 'BUILDING') IS NULL AS was_blank FROM customer")
def default_fill(t):
    rows = t("customer").withColumn("industry", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return filters.filled(rows.withColumn("was_blank", F.col("industry").isNull()), "industry", "unsorted").select("c_custkey", "industry", "was_blank")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE coalesce(nullif(trim(o_orderstatus), ''), '-') END AS status FROM orders")
def display_labels(t):
    return t("orders").select("o_orderkey", filters.label("o_orderstatus", {"F": "finished", "O": "open"}).alias("status"))


@query("SELECT c_custkey, min(k) AS found_by FROM (SELECT c_custkey, 0 AS k FROM customer WHERE contains(c_name, '1') UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal < 0) GROUP BY c_custkey")
def union_spellings(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    return filters.union_of_searches([c.filter(F.contains("c_name", F.lit("1"))), c.filter("c_acctbal < 0")], "c_custkey").select("c_custkey", "found_by")


@query("SELECT d.doc_id, l.quality AS checked FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 200")
def resume_queue(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.col("quality").alias("checked"))
    return filters.resume_queue(rows, "checked", "doc_id", 200)


@query("SELECT count(*) FILTER (WHERE c_acctbal IS NULL OR trim(coalesce(nullif(c_mktsegment, 'MACHINERY'), '')) = '') AS completable, count(*) FILTER (WHERE nullif(c_mktsegment, 'MACHINERY') IS NOT NULL AND c_acctbal < 0) AS rest FROM customer")
def completable_counts(t):
    rows = t("customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return aggregates.counted(rows, {"completable": filters.completable(["c_acctbal", "segment"]), "rest": filters.present("segment") & (F.col("c_acctbal") < 0)})


# Joins


@query("SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_brand IN ('Brand#12', 'Brand#23'))")
def tag_semi_join(t):
    brands = t("part").filter(F.col("p_brand").isin("Brand#12", "Brand#23")).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    links = t("lineitem").select("l_suppkey", "l_partkey").join(brands, "l_partkey")
    return filters.tagged(t("supplier"), links, ["Brand#12", "Brand#23"], "s_suppkey", "l_suppkey", "p_brand").select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_acctbal > 0 AND c.c_custkey = o.o_custkey) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE length(o.o_orderpriority) >= 2 AND s.s_suppkey = o.o_orderkey)")
def skip_known_anti(t):
    one = joins.not_known(t("orders"), t("customer").filter("c_acctbal > 0"), {"c_custkey": F.col("o_custkey")})
    return joins.not_known(one, t("supplier"), {"s_suppkey": F.when(F.length("o_orderpriority") >= 2, F.col("o_orderkey"))}).select("o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_row_per_key(t):
    return windows.latest(t("orders"), "o_custkey", ["o_orderkey", "o_orderdate"], ["o_orderdate", "o_orderkey"])


@query("SELECT c_custkey, o_orderkey, CAST(CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) END AS INT) AS nth FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def nested_children(t):
    return joins.with_children(t("customer").select("c_custkey"), t("orders"), "c_custkey", "o_custkey", ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS cache_hit FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON d.doc_id = l.doc_id")
def ttl_cache_join(t):
    return joins.with_cache(t("documents").select("doc_id"), t("labels").withColumnRenamed("doc_id", "k"), "doc_id", "k", "quality", "toxic", F.col("toxic") == 0).select("doc_id", "quality", "cache_hit")


@query(
    "WITH f AS (SELECT s_suppkey AS k, s_nationkey AS size FROM supplier WHERE s_suppkey % 3 > 0), i AS (SELECT s_suppkey AS k, s_nationkey + (s_suppkey % 2) AS size FROM supplier WHERE s_suppkey % 5 > 0) "
    "SELECT coalesce(f.k, i.k) AS k, CASE WHEN i.k IS NULL THEN 'adopt' WHEN f.k IS NULL THEN 'missing' WHEN f.size <> i.size THEN 'refresh' ELSE 'keep' END AS action, coalesce(f.size, i.size) AS size FROM f FULL JOIN i ON f.k = i.k"
)
def index_reconcile(t):
    s = t("supplier")
    f = s.filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("size"))
    i = s.filter("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("int").alias("size"))
    return joins.reconcile(f, i, "k", "size").select("k", "action", F.col("size").cast("long").alias("size"))


@query(
    "WITH r AS (SELECT c_custkey AS id, c_name AS a, c_mktsegment AS b FROM customer), s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS a, c_mktsegment AS b FROM customer) "
    "SELECT row_id, arg_min(target_id, (rank, target_id)) AS target_id, min(rank) AS rank FROM (SELECT r.id AS row_id, min(s.id) AS target_id, 0 AS rank FROM r JOIN s USING (a) GROUP BY r.id UNION ALL SELECT r.id, m.id, 1 FROM r JOIN (SELECT b, min(id) AS id FROM s GROUP BY b) m USING (b)) GROUP BY row_id"
)
def strongest_match(t):
    c = t("customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    targets = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("a"), F.col("c_mktsegment").alias("b"))
    return joins.first_match(rows, targets, [("a", "a"), ("b", "b")])


# Aggregates


@query(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS recent, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate < {NOW}) AS due FROM orders"
)
def dashboard_counts(t):
    c = F.col
    return aggregates.counted(t("orders"), {"total": F.lit(True), "finished": c("o_orderstatus") == "F", "urgent": c("o_orderpriority") == "1-URGENT", "large": c("o_totalprice") > 100000, "recent": c("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"), "due": (c("o_orderstatus") == "O") & (c("o_orderdate") < now())})


@query("SELECT o_orderstatus AS stage, count(*) AS n FROM orders GROUP BY 1")
def count_by_stage(t):
    return aggregates.count_by(t("orders"), "o_orderstatus", "stage")


@query("SELECT coalesce(nullif(trim(nullif(source, 'src3')), ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_sources(t):
    return aggregates.count_by(t("documents").withColumn("source", F.nullif("source", F.lit("src3"))), "source", "source", "unknown", 10)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def rows_per_day(t):
    return aggregates.count_by(t("events"), F.to_date("ts"), "day")


@query("SELECT DISTINCT p_type FROM part WHERE trim(p_type) <> '' ORDER BY 1")
def distinct_values_sorted(t):
    return aggregates.distinct_values(t("part"), "p_type")


@query("SELECT p_brand, count(l_partkey) AS n FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand AS x, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10) l ON b.p_brand = l.x GROUP BY p_brand")
def tag_usage_counts(t):
    small = t("part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return aggregates.usage(t("part").select("p_brand").distinct(), t("lineitem").select("l_partkey").join(small, "l_partkey"), "p_brand", "brand")


DUPLICATES = (
    "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 < 3 THEN CAST(c_custkey // 7 AS VARCHAR) END AS tax_id, CASE WHEN c_custkey % 5 < 2 THEN CAST(c_custkey // 5 AS VARCHAR) END AS email FROM customer), "
    "l AS (SELECT 0 AS nr, 'tax_id' AS kind, tax_id AS value, id FROM c WHERE tax_id IS NOT NULL UNION ALL SELECT 1, 'email', email, id FROM c WHERE email IS NOT NULL), "
    "g AS (SELECT nr, kind, value, list_sort(list(id)) AS ids FROM l GROUP BY ALL HAVING count(*) > 1), "
    "d AS (SELECT ids, arg_min(kind, (nr, kind, value)) AS kind, arg_min(value, (nr, kind, value)) AS value FROM g GROUP BY ids) "
)


def _duplicates(t):
    c = t("customer").select(F.col("c_custkey").alias("id"))
    c = c.withColumn("tax_id", F.when(F.col("id") % 7 < 3, F.floor(F.col("id") / 7).cast("string"))).withColumn("email", F.when(F.col("id") % 5 < 2, F.floor(F.col("id") / 5).cast("string")))
    return aggregates.duplicate_groups(c, ["tax_id", "email"])


@query(DUPLICATES + "SELECT kind, value, CAST(len(ids) AS BIGINT) AS n, unnest(ids) AS id FROM d")
def duplicate_groups(t):
    return _duplicates(t)


@query(DUPLICATES + "SELECT CAST(coalesce(sum(len(ids) - 1), 0) AS BIGINT) AS surplus FROM d")
def duplicate_surplus(t):
    return aggregates.surplus(_duplicates(t))


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k ORDER BY n DESC, k LIMIT 20")
def dynamic_extra_columns(t):
    return aggregates.frequent_keys(t("events").select(F.from_json("props", "map<string,string>").alias("m")), "m")


@query("SELECT 'source' AS \"column\", count(*) FILTER (WHERE starts_with(source, 'src1')) AS sealed, count(*) FILTER (WHERE source <> '' AND NOT starts_with(source, 'src1')) AS plain FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE starts_with(lang, 'src1')), count(*) FILTER (WHERE lang <> '' AND NOT starts_with(lang, 'src1')) FROM documents")
def prefix_census(t):
    return aggregates.census(t("documents"), ["source", "lang"], "src1")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) < 4 OR avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) >= 0.6)")
def directory_gate(t):
    return aggregates.kept_if_a_directory(t("documents").select("doc_id", "source", "lang"), "source", F.col("lang") == "en", 4, 0.6).select("doc_id", "source")


# Windows


RUNS = "WITH r AS (SELECT event_type AS source, CAST(ts AS DATE) AS started_at, count(*) AS found, CASE WHEN count(*) % 5 = 0 THEN 'Failed' ELSE 'Success' END AS status FROM events GROUP BY 1, 2), h AS (SELECT *, lag(found) OVER w AS previous_found, last_value(CASE WHEN found > 0 AND status IN ('Success', 'Partial') THEN found END IGNORE NULLS) OVER (PARTITION BY source ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_good FROM r WINDOW w AS (PARTITION BY source ORDER BY started_at)) "


def _runs(t):
    r = t("events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("started_at")).agg(F.count(F.lit(1)).alias("found"))
    return windows.run_history(r.withColumn("status", F.when(F.col("found") % 5 == 0, "Failed").otherwise("Success")), at=["started_at"])


@query(RUNS + "SELECT source, started_at, found, status, previous_found, last_good FROM h")
def previous_and_last_good_run(t):
    return _runs(t).select("source", "started_at", "found", "status", "previous_found", "last_good")


@query(RUNS + "SELECT source, started_at, CASE WHEN status = 'Failed' THEN NULL WHEN found > 0 AND 0 >= found THEN 'all rejected' WHEN found = 0 AND last_good > 0 THEN 'nothing found' WHEN found < last_good * 0.8 THEN 'steep drop' END AS warning FROM h")
def health_drop(t):
    c = F.col
    return _runs(t).select("source", "started_at", windows.health(c("found"), F.lit(0), c("last_good"), c("status") != "Failed", drop=0.8).alias("warning"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 5")
def history_top_n(t):
    return windows.best_of(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p > 10")
def retention_prune(t):
    return windows.beyond(t("events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 10).select("event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, ts, event_id) AS p FROM events) WHERE p = 1")
def worst_event_per_user(t):
    return windows.best_of(t("events"), ["user_id"], [(F.col("event_type") == "error").desc(), F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


PLAN = (
    "WITH o AS (SELECT o_custkey, max(o_orderdate) AS last_sent FROM orders GROUP BY 1), j AS (SELECT c_custkey AS id, c_acctbal, CASE WHEN c_nationkey = 3 THEN 'DO_NOT_CONTACT' WHEN c_acctbal < 0 THEN 'BOUNCED' WHEN c_custkey % 11 = 0 THEN 'NO_EMAIL' WHEN c_custkey % 13 = 0 THEN 'INVALID_EMAIL' WHEN last_sent >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY THEN 'RECENTLY_EMAILED' END AS reason FROM customer LEFT JOIN o ON c_custkey = o_custkey), "
    "q AS (SELECT id FROM j WHERE reason IS NULL ORDER BY c_acctbal DESC, id LIMIT 50), p AS (SELECT j.id, CASE WHEN reason IS NULL AND q.id IS NULL THEN 'DAILY_CAP' ELSE reason END AS skip_reason FROM j LEFT JOIN q ON j.id = q.id) "
)


def _plan(t):
    sent = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_sent"))
    c = t("customer").withColumnRenamed("c_custkey", "id").join(sent, "id", "left")
    mail = F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 13 == 0, "nobody").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@mail.org")))
    reason = outreach.skip_reason(F.col("c_nationkey") == 3, mail, F.when(F.col("c_acctbal") < 0, "Bounced").otherwise("Valid"), F.col("last_sent"), F.lit("1998-06-01").cast("timestamp_ntz"))
    return outreach.plan(c, reason, [F.desc("c_acctbal"), F.asc("id")], 50)


@query(PLAN + "SELECT id, skip_reason FROM p")
def outreach_plan(t):
    return _plan(t).select("id", "skip_reason")


@query(PLAN + "SELECT coalesce(skip_reason, 'SEND') AS reason, count(*) AS n FROM p GROUP BY 1")
def skip_reasons(t):
    return aggregates.count_by(_plan(t), F.coalesce("skip_reason", F.lit("SEND")), "reason")


@query("SELECT conv_id, turn, kind FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE kind WHEN 'unsubscribe' THEN 2 WHEN 'human' THEN 1 ELSE 0 END DESC, turn, text) AS p FROM (SELECT conv_id, turn, text, CASE WHEN role = 'system' THEN 'auto' WHEN regexp_matches(substr(text, 1, 400), '(?i)the re|stop') THEN 'unsubscribe' ELSE 'human' END AS kind FROM conversations)) WHERE p = 1")
def best_reply_per_conversation(t):
    kind = F.when(F.col("role") == "system", "auto").when(F.substring("text", 1, 400).rlike("(?i)the re|stop"), "unsubscribe").otherwise("human")
    rows = t("conversations").withColumn("kind", kind)
    return windows.best_of(rows, ["conv_id"], [outreach.reply_rank(F.col("kind")).desc(), F.asc("turn"), F.asc("text")]).select("conv_id", "turn", "kind")


# Scores


def _score_roles():
    return {"email": F.when(F.col("s_suppkey") % 3 > 0, "a@b.org"), "email_verdict": F.when(F.col("s_suppkey") % 2 == 0, "Valid"), "phone": F.when(F.col("s_suppkey") % 5 > 0, "02-27231234"), "capital": (F.col("s_acctbal") * 20000).cast("long"), "updated_at": F.col("seen"), "do_not_contact": F.col("s_nationkey") == 7}


def _suppliers(t):
    first = F.lit("2023-12-01 06:00:00").cast("timestamp_ntz")
    return t("supplier").withColumn("seen", F.timestamp_add("DAY", -(F.col("s_suppkey") % 500).cast("int"), first))


SCORED = (
    f"WITH s AS (SELECT *, TIMESTAMP '2023-12-01 06:00:00' - to_days(CAST(s_suppkey % 500 AS INT)) AS seen, CAST(trunc(s_acctbal * 20000) AS BIGINT) AS capital FROM supplier), p AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 40 ELSE 28 END AS email, CASE WHEN s_suppkey % 5 > 0 THEN 20 ELSE 0 END AS phone, "
    f"CASE WHEN capital >= 100000000 THEN 15 WHEN capital >= 10000000 THEN 12 WHEN capital >= 1000000 THEN 8 WHEN capital > 0 THEN 4 ELSE 0 END AS capital_points, CASE WHEN date_sub('day', seen, {NOW}) <= 30 THEN 10 WHEN date_sub('day', seen, {NOW}) <= 90 THEN 7 WHEN date_sub('day', seen, {NOW}) <= 365 THEN 4 ELSE 0 END AS freshness FROM s), "
    "t AS (SELECT *, email + phone + capital_points + freshness AS total FROM p) "
)


@query(SCORED + "SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 7 THEN least(total, 10) ELSE total END AS lead_score FROM t ORDER BY 3 DESC, s_suppkey LIMIT 100")
def lead_score_rank(t):
    rows = _suppliers(t).select("s_suppkey", "s_name", score.lead_score(_score_roles(), now()).alias("lead_score"))
    return rows.orderBy(F.desc("lead_score"), "s_suppkey").limit(100)


@query(SCORED + "SELECT s_suppkey, part, points FROM (SELECT s_suppkey, unnest(['email', 'capital', 'freshness', 'phone', 'website', 'contact_person', 'address', 'tax_id']) AS part, unnest([email, capital_points, freshness, phone, 0, 0, 0, 0]) AS points FROM t)")
def lead_score_explain(t):
    return _suppliers(t).select("s_suppkey", F.inline(score.explained(_score_roles(), now())))


# Text


@query("SELECT DISTINCT doc_id, trim(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.+\\-]+@[A-Za-z0-9_\\-]+(?:\\.[A-Za-z0-9_\\-]+)+'))), '.') AS email FROM documents")
def extract_emails(t):
    return t("documents").select("doc_id", F.explode(text.emails("text")).alias("email"))


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}')) AS phone FROM documents")
def extract_phones(t):
    return t("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})"), F.lit(1)))).alias("phone"))


@query("SELECT DISTINCT doc_id, '+' || regexp_replace(unnest(regexp_extract_all(text, '\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}')), '[^0-9]', '', 'g') AS phone FROM documents")
def normalised_phones(t):
    raw = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})"), F.lit(1))).alias("raw"))
    return raw.select("doc_id", text.phone("raw").alias("phone")).distinct()


@query(
    "WITH e AS (SELECT DISTINCT doc_id, trim(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.+\\-]+@[A-Za-z0-9_\\-]+(?:\\.[A-Za-z0-9_\\-]+)+'))), '.') AS email FROM documents) "
    f"SELECT doc_id, email, CASE WHEN NOT regexp_matches(email, '{fixed.EMAIL.replace(chr(39), chr(39) * 2)}') THEN 'Invalid Syntax' WHEN regexp_matches(email, '(@|\\.)mail\\.example$') THEN 'Disposable' ELSE 'Unknown' END AS verdict, "
    f"regexp_extract(email, '^(.*)@', 1) IN ({quoted(fixed.ROLE_LOCAL_PARTS)}) AS is_role, regexp_matches(email, '(@|\\.)({'|'.join(fixed.TRACKING_DOMAINS + fixed.PLACEHOLDER_DOMAINS)})$') OR regexp_matches(email, '^[0-9a-f]{{24,}}@') AS is_tracking FROM e"
)
def email_validity_verdict(t):
    rows = t("documents").select("doc_id", F.explode(text.emails("text")).alias("email"))
    return rows.select("doc_id", "email", validate.email_verdict("email", ["mail.example"]).alias("verdict"), validate.is_role_address("email").alias("is_role"), validate.is_tracking_address("email").alias("is_tracking"))


TAX = "WITH o AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + 12345) % 100000000 AS VARCHAR), 8, '0') AS tax_id FROM orders), d AS (SELECT *, list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda k: (CAST(substr(tax_id, k, 1) AS INT) * [1, 2, 1, 2, 1, 2, 4, 1][k]) // 10 + (CAST(substr(tax_id, k, 1) AS INT) * [1, 2, 1, 2, 1, 2, 4, 1][k]) % 10)) AS total FROM o) "


@query(TAX + "SELECT o_orderkey, tax_id, total % 5 = 0 OR (substr(tax_id, 7, 1) = '7' AND (total - 9) % 5 = 0) AS valid FROM d")
def tax_id_checksum(t):
    number = F.lpad(((F.col("o_orderkey") * 7919 + 12345) % 100000000).cast("string"), 8, "0")
    return t("orders").select("o_orderkey", number.alias("tax_id")).withColumn("valid", validate.is_tax_id("tax_id"))


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^:/?#]+)', 1), '^www\\.', '') AS host FROM pages")
def url_host(t):
    return t("pages").select("page_id", text.website_host("url").alias("host"))


def sql_unescaped(x: str) -> str:
    """SQL: the entities that the pages hold, by plain replacement."""
    for entity, said in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{said}')"
    return x


@query(
    "WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 1) AS s, lower(regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 2)) AS h, regexp_replace(regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 3), '/+$', '') AS p, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_cid|mc_eid|_ga)')), '&') AS q FROM pages) "
    "SELECT page_id, s || '://' || h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM p"
)
def url_normalised(t):
    return t("pages").select("page_id", text.website("url").alias("url"))


@query("SELECT page_id, trim(regexp_replace(" + sql_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", '\\s+', ' ', 'g')) AS title, lower(regexp_extract(substr(html, 1, 4096), '(?i)charset\\s*=\\s*[\"'']?([A-Za-z0-9_\\-]+)', 1)) AS charset FROM pages")
def page_title_and_charset(t):
    return t("pages").select("page_id", pages.title("html").alias("title"), pages.charset("html").alias("charset"))


LINKS = "WITH l AS (SELECT page_id, " + sql_unescaped("unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))") + " AS href FROM pages) "


@query(LINKS + "SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2")
def page_links(t):
    return pages.links(t("pages")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(LINKS + "SELECT href, max(CASE WHEN contains(lower(href), 'login') THEN -1.0 ELSE round((contains(lower(href), 'about')::INT + contains(lower(href), 'contact')::INT) * 2, 2) END) AS priority FROM l GROUP BY 1")
def link_priority(t):
    found = pages.links(t("pages"))
    return found.groupBy("href").agg(F.max(pages.link_priority("href", F.lit(0), ["about", "contact"], ["login"])).alias("priority"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[0-9]+', '#', 'g') AS key FROM pages")
def pagination_key(t):
    return t("pages").select("page_id", pages.pagination_key("url").alias("key"))


@query()
def list_block_detection(t):
    return pages.list_blocks(pages.list_items(t("pages")))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"([^\"]*)\">', 1)) AS link FROM pages) SELECT page_id, count(*) AS n, min(link) AS first, max(link) AS last FROM l GROUP BY page_id")
def page_rule_extraction(t):
    rows = extraction.extracted(t("pages"), "nav ul li", {"name": extraction.Rule("a"), "link": extraction.Rule("a[href^='/']", "href")})
    return rows.groupBy("page_id").agg(F.count("link").alias("n"), F.min("link").alias("first"), F.max("link").alias("last"))


@query()
def rule_validation(t):
    rows = extraction.extracted(t("pages"), "nav ul li", {"name": extraction.Rule("a"), "missing": extraction.Rule("b.none")})
    return extraction.judged_rules(rows, ["name", "missing"], ["name"])


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r\\n]') THEN '''' || text ELSE text END AS cell FROM documents")
def formula_neutralise(t):
    return t("documents").select("doc_id", text.neutral("text").alias("cell"))


@query("SELECT p_partkey, trim(p_name) AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def label_value_parse(t):
    body = F.concat(F.lit("Name: "), F.col("p_name"), F.lit(" Brand : "), F.col("p_brand"), F.lit("\nBrand: other\nSize："), F.col("p_size").cast("string"))
    got = t("part").select("p_partkey", pages.labelled(body).alias("m"))
    return got.select("p_partkey", F.try_element_at("m.fields", F.lit("company_name")).alias("name"), F.try_element_at("m.extra", F.lit("Brand")).alias("brand"), F.try_element_at("m.extra", F.lit("Size")).alias("size"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'mail:c' || c_custkey || '@mail.org' WHEN c_custkey % 3 = 1 THEN 'np:customer' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '|02-2' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') ELSE 'n:customer' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS key FROM customer")
def identity_key_cascade(t):
    c = F.col("c_custkey")
    number = F.lpad(c.cast("string"), 9, "0")
    rows = t("customer").select("c_custkey", F.concat(F.lit("Customer#"), number, F.lit(" Co., Ltd.")).alias("name"), F.when(c % 3 == 0, F.concat(F.lit("<C"), c.cast("string"), F.lit("@mail.org>"))).alias("mail"), F.when(c % 3 == 1, F.concat(F.lit("+886 2 2"), F.lpad((c % 10000000).cast("string"), 7, "0"))).alias("tel"))
    none = F.lit(None).cast("string")
    return rows.withColumn("nk", text.company_name_key("name")).select("c_custkey", identity.dedupe_key("name", "nk", none, "mail", "tel", none).alias("key"))


# Merging


@query(
    "SELECT k AS key, min(doc_id) AS doc_id, arg_min(lang, doc_id) FILTER (WHERE lang <> 'en') AS lang, arg_min(source, doc_id) AS source, bool_or(n_chars > 5000) AS flagged, count(*) AS n_merged FROM (SELECT *, regexp_replace(lower(text), '[\\s]+', ' ', 'g') AS k FROM documents WHERE trim(coalesce(text, '')) <> '') GROUP BY k"
)
def merge_records(t):
    rows = t("documents").select(F.regexp_replace(F.lower("text"), r"\s+", " ").alias("key"), "doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "source", (F.col("n_chars") > 5000).alias("flagged"))
    return merge.merged(rows.withColumn("seq", F.col("doc_id")), "key", "seq", ["lang"], ["doc_id", "source"], ["flagged"])


@query(
    "WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 > 0 THEN 'new' ELSE '' END AS segment FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT coalesce(s.id, b.id) AS id, coalesce(s.name, b.name) AS name, coalesce(nullif(b.segment, ''), s.segment) AS segment, CASE WHEN s.id IS NULL THEN 'insert' WHEN s.name IS NULL AND b.name IS NOT NULL THEN 'fill' ELSE 'keep' END AS action FROM s FULL JOIN b ON s.id = b.id"
)
def fill_blanks_upsert(t):
    c = t("customer")
    s = c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 > 0, "new").otherwise("").alias("segment"))
    return merge.upsert(s, b, "id", ["name"], ["segment"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Replied' WHEN o_orderstatus = 'P' THEN 'Replied' ELSE 'Lost' END AS stage FROM orders")
def stage_advance(t):
    stage = F.when(F.col("o_orderstatus") == "O", "New").when(F.col("o_orderstatus") == "P", "Contacted").otherwise("Lost")
    return t("orders").select("o_orderkey", merge.advanced(stage, "Replied").alias("stage"))


@query("SELECT c_custkey AS id, regexp_replace(lower(c_name), '[0-9]$', '') AS email, regexp_replace(lower(c_name), '[0-9]$', '') IN (SELECT regexp_replace(lower(c_name), '[0-9]$', '') FROM customer WHERE c_acctbal < -900) AS do_not_contact FROM customer")
def unsubscribe_by_address(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.regexp_replace(F.lower("c_name"), "[0-9]$", "").alias("email"), F.lit(False).alias("do_not_contact"), "c_acctbal")
    return outreach.unsubscribed(c, c.filter("c_acctbal < -900").select(F.col("email").alias("address"))).select("id", "email", "do_not_contact")


# Dates


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def roc_date(t):
    as_roc = F.concat(F.lpad((F.year("o_orderdate") - 1911).cast("string"), 3, "0"), F.date_format("o_orderdate", "MMdd"))
    return t("orders").select("o_orderkey", dates.roc_date(as_roc).alias("day"))


@query("WITH m AS (SELECT o_orderkey, o_orderdate AS d, least(last_day(o_orderdate), CAST(date_trunc('month', o_orderdate) AS DATE) + 30) + INTERVAL 6 HOUR AS a, least(last_day(o_orderdate + INTERVAL 1 MONTH), CAST(date_trunc('month', o_orderdate + INTERVAL 1 MONTH) AS DATE) + 30) + INTERVAL 6 HOUR AS b FROM orders) SELECT o_orderkey, CASE WHEN a > d THEN a ELSE b END AS due FROM m")
def next_run_monthly(t):
    return t("orders").select("o_orderkey", dates.next_monthly("o_orderdate", 31, 6).alias("due"))


@query("SELECT event_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hourly, CASE WHEN date_trunc('day', ts) + INTERVAL 9 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 9 HOUR ELSE date_trunc('day', ts) + INTERVAL 33 HOUR END AS daily FROM events")
def next_run_hourly_daily(t):
    ntz = lambda c: c.cast("timestamp_ntz")
    return t("events").select("event_id", ntz(dates.next_hourly("ts")).alias("hourly"), ntz(dates.next_daily("ts", 9)).alias("daily"))


# More of merging, matching and pages


@query(
    "WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE ' ' END AS segment FROM customer) "
    "SELECT 'name' AS field, count(*) FILTER (WHERE name IS NULL) AS filled FROM b UNION ALL SELECT 'segment', count(*) FILTER (WHERE trim(segment) = '') FROM b"
)
def completion_filled_counts(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    before = c.select("id", F.when(F.col("id") % 3 > 0, F.col("name")).alias("name"), F.when(F.col("id") % 4 > 0, F.col("segment")).otherwise(" ").alias("segment"))
    return aggregates.filled_counts(before, c, ["name", "segment"])


@query(
    "WITH l AS (SELECT l_orderkey AS nr, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS kind FROM lineitem WHERE l_quantity > 30 GROUP BY 1) SELECT o_orderkey, coalesce(kind, 'unjudged') AS kind FROM orders LEFT JOIN l ON o_orderkey = nr"
)
def labels_by_ordinal(t):
    labels = t("lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("nr"), F.col("l_returnflag").alias("kind"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("seq"))
    return joins.by_ordinal(t("orders").select("o_orderkey"), labels, "o_orderkey", "nr", "kind", "unjudged")


@query("SELECT page_id, regexp_extract(lower(url), '^https?://([^:/?#]+)', 1) AS host FROM pages WHERE regexp_matches(regexp_extract(lower(url), '^https?://([^:/?#]+)', 1), '(^|\\.)example\\.(com|net)$')")
def domain_suffix_match(t):
    rows = t("pages").select("page_id", F.regexp_extract(F.lower("url"), "^https?://([^:/?#]+)", 1).alias("host"))
    return joins.under_domains(rows, "host", t("region").select(F.when(F.col("r_regionkey") == 0, "example.com").otherwise("example.net").alias("d")).distinct(), "d")


@query(
    "WITH k AS (SELECT o_custkey AS company_id, trim(o_orderpriority) AS name FROM orders) SELECT c_custkey AS company_id, c_mktsegment AS name, NOT EXISTS (SELECT 1 FROM k WHERE k.company_id = c_custkey) AS is_primary FROM customer"
)
def contact_promotion(t):
    companies = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("contact_person"))
    return merge.promoted_contacts(companies, t("orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("name")))


@query("SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(t):
    gone = t("customer").filter("c_acctbal < 0").select("c_custkey")
    left, children = merge.without(t("customer"), {"orders": (t("orders"), "o_custkey")}, gone, "c_custkey")
    count = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("customer", left).unionByName(count("orders", children["orders"]))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'Valid' END AS verdict, CASE WHEN o_orderkey % 5 = 0 THEN 'Bounced' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'Valid' ELSE 'No MX' END AS adopted FROM orders")
def verdict_rules(t):
    k = F.col("o_orderkey")
    old, new = F.lit("A@b.tw"), F.when(k % 3 == 0, "c@d.tw").otherwise("a@b.tw")
    return t("orders").select("o_orderkey", merge.edited_verdict(old, new, F.lit("Valid")).alias("verdict"), merge.adopted_verdict(old, F.when(k % 5 == 0, "Bounced").otherwise("Valid"), new, F.when(k % 7 == 0, "Unknown").otherwise("No MX")).alias("adopted"))


@query("WITH p AS (SELECT unnest(['page=' || page_id % 7, 'ref=x', 'size=20']) AS pair FROM pages), v AS (SELECT 'all' AS site, 'x' AS base, string_split(pair, '=')[1] AS parameter, regexp_extract(pair, '=([0-9]+)$', 1) AS value FROM p) SELECT site, base, parameter, count(DISTINCT value) AS n_values FROM v WHERE value <> '' GROUP BY ALL HAVING count(DISTINCT value) > 1")
def pagination_parameters(t):
    urls = t("pages").select(F.lit("all").alias("site"), F.concat(F.lit("x?page="), (F.col("page_id") % 7).cast("string"), F.lit("&ref=x&size=20")).alias("url"))
    return pages.page_parameters(urls, "url", "site")


@query("SELECT event_id, coalesce(ts >= TIMESTAMP '2024-02-01' - INTERVAL 168 HOUR, false) AS fresh, CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week FROM events")
def freshness_and_week(t):
    return t("events").select("event_id", dates.is_fresh("ts", now(), 168).alias("fresh"), dates.iso_week("ts").alias("week"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'name is a headline' WHEN p_partkey % 4 = 1 THEN 'site is an article' WHEN p_partkey % 4 = 2 THEN NULL ELSE 'no name' END AS why, length(p_name) + 4 AS width FROM part")
def company_or_advert(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit("?"))).when(k == 1, "Acme").when(k == 2, F.concat("p_name", F.lit(" Co., Ltd?"))).otherwise(" ")
    return t("part").select("p_partkey", validate.why_not_a_company(name, F.when(k == 1, "https://x.tw/news/1")).alias("why"), text.display_width(F.concat("p_name", F.lit("公司"))).alias("width"))


@query(
    "WITH p AS (SELECT c_custkey AS k, c_custkey % 2 AS odd, c_name, substr(c_name, -6, 5) AS nk, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) || '@b.tw' END AS mail FROM customer), "
    "h AS (SELECT nk, arg_min(k, (odd, k)) AS head, count(*) FILTER (WHERE odd = 1) AS n, arg_max(seg, k) FILTER (WHERE odd = 1) AS seg, arg_min(mail, k) FILTER (WHERE odd = 1 AND mail IS NOT NULL) AS mail FROM p GROUP BY nk) "
    "SELECT CASE WHEN odd = 0 THEN k END AS id, CASE WHEN odd = 0 THEN -1 ELSE k END AS seq, CASE WHEN odd = 0 THEN c_name ELSE lower(c_name) END AS company_name, p.nk AS name_key, 'n:' || p.nk AS dedupe_key, NULL AS host, CASE WHEN h.head IS NULL THEN p.seg ELSE coalesce(h.seg, p.seg) END AS source_url, "
    "NULL AS tax_id, CASE WHEN h.head IS NULL THEN p.mail ELSE coalesce(p.mail, h.mail) END AS email, NULL AS phone, NULL AS website, NULL AS address, NULL AS industry, NULL AS english_name, NULL AS fax, NULL AS products, NULL AS contact_person, CASE WHEN h.head IS NULL THEN 0 WHEN odd = 1 THEN n - 1 ELSE n END AS merged "
    "FROM p LEFT JOIN h ON h.nk = p.nk AND h.head = p.k WHERE odd = 0 OR h.head IS NOT NULL"
)
def upsert_sequential(t):
    c = t("customer")
    none = F.lit(None).cast("string")
    row = lambda seq, name: [F.col("c_custkey").alias("id"), seq.cast("long").alias("seq"), name.alias("company_name"), F.substring("c_name", -6, 5).alias("name_key"), F.concat(F.lit("n:"), F.substring("c_name", -6, 5)).alias("dedupe_key"), none.alias("host"), F.col("c_mktsegment").alias("source_url")] + [none.alias(x) for x in sequential.FILLED if x != "email"] + [F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("@b.tw"))).alias("email")]
    store = c.filter("c_custkey % 2 = 0").select(*row(F.lit(-1), F.col("c_name")))
    batch = c.filter("c_custkey % 2 = 1").select(*row(F.col("c_custkey"), F.lower("c_name")))
    return sequential.upserted(store, batch).drop("extra", "email_verdict", "contacts")


# Questions


@query("SELECT c_custkey AS id, c_name AS company_name, c_mktsegment AS industry FROM customer WHERE contains(lower(c_name), '1') AND contains(lower(c_mktsegment), 'build') ORDER BY lower(c_name), c_custkey LIMIT 30")
def ask_list(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"))
    said = 'Sure: ```json\n{"tool": "search_companies", "arguments": {"keyword": "1", "industry": "Build", "order_by": "company_name", "limit": "30", "drop": "table"}}\n```'
    return ask.answered(rows, ask.parsed(said), now(), ["company_name"])


@query("SELECT count(*) AS n FROM customer WHERE contains(lower(c_name), '12')")
def ask_count(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company_name"))
    return ask.answered(rows, ask.parsed('{"mode": "count", "arguments": {"keyword": "12"}}'), now(), ["company_name"])


# Encryption, export, windows over events

KEY = bytes(range(32))


@query("SELECT c_custkey, c_name AS plain, true AS stable FROM customer")
def crypto_roundtrip(t):
    c = t("customer").select("c_custkey", crypto.encrypted("c_name", KEY).alias("sealed"))
    return c.select("c_custkey", crypto.decrypted("sealed", KEY).alias("plain"), (crypto.encrypted("sealed", KEY) == F.col("sealed")).alias("stable"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"No.\", coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M'), '') AS Date, o_orderpriority AS o_orderpriority FROM orders")
def export_shape(t):
    return export.hardened(export.shaped(t("orders"), ["o_orderkey", "o_orderdate", "o_orderpriority"], {"o_orderkey": "No.", "o_orderdate": "Date"}))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(t):
    from ..streaming import ingest

    return ingest.windowed(t("events"), "ts", "event_type", "value", "1 hour")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k")
def ext_session_window(t):
    from ..streaming import ingest

    return ingest.sessions(t("events"), "ts", "user_id", "2 hours")
