import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolodexter.operators import aggregates, filters, joins, merge, outreach, windows
from rolodexter.sources import export, pages, tables
from rolodexter.streaming import ingest


def test_batch_merge_fills_gaps_and_keeps_marks(spark):
    rows = spark.createDataFrame([(1, "k", None, "x", False), (2, "k", "b", "y", True), (3, "", "c", "z", False), (4, None, "d", "w", None)], "seq int, key string, mail string, name string, dnc boolean")
    got = merge.merged(rows, "key", "seq", ["mail"], ["name"], ["dnc"]).collect()
    assert [(r["key"], r["mail"], r["name"], r["dnc"], r["n_merged"]) for r in got] == [("k", "b", "x", True, 2)]


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "k", None), (2, "k", "b")], "seq int, key string, mail string")
    once = merge.merged(rows, "key", "seq", ["mail"], ["seq"])
    twice = merge.merged(once.drop("n_merged"), "key", "seq", ["mail"], ["seq"])
    assert once.drop("n_merged").collect() == twice.drop("n_merged").collect()


def test_search(spark):
    rows = spark.createDataFrame([(1, "Alpha_x", "b"), (2, None, "A%"), (3, " ", "c")], "id int, name string, other string")
    find = lambda **k: sorted(r["id"] for r in rows.filter(filters.Search(**k).predicate()).collect())
    assert find(text="a%", text_columns=["name", "other"]) == [2]
    assert find(text="_", text_columns=["name"]) == [1]
    assert find(presence={"name": False}) == [2, 3]
    assert find(among={"id": []}) == [1, 2, 3]
    assert filters.Search(limit=5).is_empty() and not filters.Search(text="x").is_empty()
    by = lambda **k: [r["id"] for r in filters.ordered(rows, "name", sortable=["name"], tie="id", **k).collect()]
    assert by() == [1, 2, 3]
    assert by(descending=True) == [2, 3, 1]
    assert by(descending=True, blanks_last=True) == [1, 2, 3]


def test_quota_counts_only_eligible_rows(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "id int, ok boolean")
    got = windows.with_quota(rows, F.col("ok"), [F.asc("id")], 2).filter("in_quota").select("id").collect()
    assert sorted(r["id"] for r in got) == [1, 3]


def test_not_to_contact_outranks_all(spark):
    rows = spark.createDataFrame([(1, True, "", "Bounced"), (2, False, "a@b.org", "Bounced"), (3, None, "a@b.org", "Valid"), (4, False, "x", "Valid")], "id int, dnc boolean, mail string, verdict string")
    reason = outreach.skip_reason(F.col("dnc"), F.col("mail"), F.col("verdict"), F.lit(None).cast("timestamp_ntz"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    got = {r["id"]: r["skip_reason"] for r in outreach.plan(rows, reason, [F.asc("id")], 0).collect()}
    assert got == {1: "DO_NOT_CONTACT", 2: "BOUNCED", 3: "DAILY_CAP", 4: "INVALID_EMAIL"}


def test_domains_by_suffix(spark):
    rows = spark.createDataFrame([("a.mailinator.com",), ("xmailinator.com",), ("mailinator.com",)], "d string")
    names = spark.createDataFrame([("mailinator.com",)], "n string")
    assert sorted(r["d"] for r in joins.under_domains(rows, "d", names, "n").collect()) == ["a.mailinator.com", "mailinator.com"]


def test_template():
    with pytest.raises(ValueError):
        outreach.rendered("Dear {name}", {})


def test_rendered_values_are_not_rendered_again(spark):
    row = spark.createDataFrame([("{b}", "x")], "a string, b string").select(outreach.rendered("{a}-{b}!", {"a": "a", "b": "b"}).alias("t")).first()
    assert row["t"] == "{b}-x!"


def test_delimited_and_workbook(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名冊,,\n公司名稱;電話;備考\n".replace(";", ",").encode("cp950") + "東嶼公司,02-1,好\n,,\n聲寶\n".encode("cp950"))
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>company</t></is></c><c r="C1" t="inlineStr"><is><t>email</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Acme</t></is></c><c r="C2" t="inlineStr"><is><t>a@b.tw</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = tables.records(tables.cells(spark, f"file://{tmp_path}")).orderBy("path", "line").collect()
    assert [r["fields"] for r in got] == [{"company_name": "東嶼公司", "phone": "02-1"}, {"company_name": "聲寶"}, {"company_name": "Acme", "email": "a@b.tw"}]
    assert got[0]["extra"] == {"備考 3": "好"}


@pytest.mark.parametrize("body", ['[{"name":"a"}]', '{"companies":[{"name":"a"}]}', '{"data":[{"name":"a"}]}', '{"name":"a"}'])
def test_json_shapes(spark, tmp_path, body):
    (tmp_path / "x.json").write_text(body)
    assert [r["name"] for r in tables.json_records(spark, f"file://{tmp_path}/x.json", "name string").collect()] == ["a"]


def test_list_blocks(spark):
    card = '<div class="c b"><h3>{0}有限公司</h3><a href="/{0}">x</a><p>a{0}@b.tw</div>'
    html = "<body><ul><li>1<li>2<li>3</ul><main>" + "".join(card.format(i) for i in range(5)) + "</main><script>var x='</p>'</script></body>"
    got = pages.list_blocks(pages.list_items(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string"))).collect()
    assert [(r["tag"], r["class"], r["n"]) for r in got] == [("div", "b c", 5)]


def test_labels(spark):
    said = "  Head line\nTel︰ 02-1 FAX： 03-2\n負責人: 主席 林水秀 Mr. Wang\n見 http://a.b:80/x\nTel: 04\nNote: no\n色：紅"
    got, none = (r["m"] for r in spark.createDataFrame([(said,), (None,)], "t string").select(pages.labelled("t").alias("m")).collect())
    assert got["heading"] == "Head line" and got["extra"] == {"Tel": "04", "色": "紅"}
    assert got["fields"] == {"phone": "02-1", "fax": "03-2", "contact_person": "主席 林水秀"} or got["fields"]["contact_person"].startswith("主席 林水秀")
    assert none["heading"] == "" and none["fields"] == {}
    kept = [r["r"] for r in spark.createDataFrame([("東嶼\n電話： 1 傳真： 2",), ("電話： 1",)], "t string").select(pages.text_record("t").alias("r")).collect()]
    assert kept[0]["fields"] == {"company_name": "東嶼", "phone": "1", "fax": "2"} and kept[1] is None


def test_export(spark):
    rows = spark.createDataFrame([(1, "=x", ["b", "a"], {"k": "v"}), (2, None, [], {})], "id int, name string, tags array<string>, extra map<string,string>")
    got = export.hardened(export.shaped(rows, ["id", "name", "tags"], {"name": "+name"}, "extra")).collect()
    assert got[0].asDict() == {"id": "1", "'+name": "'=x", "tags": "b, a", "k": "v"}
    assert got[1].asDict() == {"id": "2", "'+name": "", "tags": "", "k": ""}


def test_ingest_takes_new_files_only(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ck"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 5).write.mode("append").parquet(src)
        ingest.ingest(ingest.read_new(spark, src, "id long"), out, ck)
    assert spark.read.parquet(out).count() == 10
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2


def test_duplicate_groups_collapse_equal_members(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "id int, k1 string, k2 string")
    got = aggregates.duplicate_groups(rows, ["k1", "k2"]).collect()
    assert sorted((r["kind"], r["n"], r["id"]) for r in got) == [("k1", 2, 1), ("k1", 2, 2)]


def test_questions_are_whitelisted(spark):
    from rolodexter.operators import ask

    q = ask.parsed('here: {"tool":"search_companies","arguments":{"city":"台中","has_email":"true","sql":"drop","limit":9999,"stage":"new"}} ok')
    assert q.arguments == {"city": "台中", "has_email": True, "limit": 9999, "stage": "New"} and q.ignored == ["sql"]
    with pytest.raises(ValueError):
        ask.parsed('{"tool":"delete_all"}')
    rows = spark.createDataFrame([(1, "臺中市", "a@b.tw", "New"), (2, "台中", None, "New"), (3, "台北", "x@y.tw", "New")], "id int, address string, email string, pipeline_stage string")
    assert [r["id"] for r in ask.answered(rows, q, F.lit(datetime(2024, 1, 1)), []).collect()] == [1]


DSN = """From: MAILER-DAEMON@x.tw
Subject: Undelivered Mail
Content-Type: multipart/report; report-type=delivery-status; boundary="b"

--b
Content-Type: text/plain

failed
--b
Content-Type: message/delivery-status

Reporting-MTA: dns; x.tw

Final-Recipient: rfc822; Bad@Firm.tw
Action: failed
Status: 5.1.1
Diagnostic-Code: smtp; 550 no such user

Final-Recipient: rfc822; slow@firm.tw
Action: delayed
Status: 5.4.1

Final-Recipient: rfc822; fine@firm.tw
Action: delivered
Status: 2.0.0
--b--
"""


def test_bounces(spark):
    from rolodexter.sources import mail

    text = "From: postmaster@y.tw\nSubject: returned mail\nContent-Type: text/plain\n\n550 5.1.1 <gone@firm.tw> unknown, other@else.tw"
    raw = spark.createDataFrame([("1", bytearray(DSN.encode())), ("2", bytearray(text.encode())), ("3", bytearray(b"From: a@b.tw\nSubject: hello\n\nbad@firm.tw"))], "uid string, raw binary")
    sent = spark.createDataFrame([(a, "Sent") for a in ("bad@firm.tw", "slow@firm.tw", "fine@firm.tw", "gone@firm.tw")] + [("other@else.tw", "Failed")], "to_address string, status string")
    found = mail.bounces(raw, sent)
    got = {r["address"]: (r["uid"], r["hard"], r["code"], r["reason"]) for r in found.collect()}
    assert got == {"bad@firm.tw": ("1", True, "5.1.1", "550 no such user"), "slow@firm.tw": ("1", False, "5.4.1", ""), "gone@firm.tw": ("2", True, "5.1.1", "550 5.1.1 <gone@firm.tw> unknown, other@else.tw")}
    assert mail.worst(found).count() == 3


def test_replies_find_their_company(spark):
    from rolodexter.sources import mail

    sent = spark.createDataFrame([(1, "<m1>", "a@x.tw", 10, 1, "Sent"), (2, "<m2>", "a@x.tw", 20, 2, "Sent")], "id int, message_id string, to_address string, company_id int, sent_at int, status string")
    replies = spark.createDataFrame([("r1", "A@x.tw", "<zz> <m1>"), ("r2", "a@x.tw", ""), ("r3", "q@x.tw", None)], "uid string, address string, references string")
    got = {r["uid"]: (r["company_id"], r["matched_by"]) for r in mail.replied_to(replies, sent).collect()}
    assert got == {"r1": (10, "message_id"), "r2": (20, "address"), "r3": (None, None)}


def test_signature(spark):
    from rolodexter.sources import mail

    row = spark.createDataFrame([("Hi\n--\nWang\nSales Manager\nAcme Co., Ltd.\nTel: 02-25816407\nwww.acme.tw",)], "b string").select(mail.signature("b").alias("s")).first()["s"]
    assert row.asDict() == {"company": "Acme Co., Ltd.", "title": "Sales Manager", "phone": "02-25816407", "url": "www.acme.tw"}


def test_sequential_upsert_equals_one_long_replay(spark):
    import random

    import pandas as pd

    from rolodexter.operators import sequential

    rng = random.Random(4)
    pick = lambda pool, p: rng.choice(pool) if rng.random() < p else None

    def record(k, stored):
        name = rng.choice("abcdefghijklmnop")
        r = dict.fromkeys(c.split()[0] for c in sequential.COLUMNS.split(", "))
        r |= {"id": k + 1 if stored else None, "seq": None if stored else k, "company_name": name, "name_key": pick([name], 0.9)}
        r |= {"tax_id": pick(["1", "2", "3", "4"], 0.2), "email": pick([f"{x}@b.tw" for x in "ABCDEF"], 0.3), "phone": pick(["p1", "p2"], 0.5), "host": pick(["h1.tw", "h2.tw"], 0.4), "source_url": f"u{k}"}
        r["website"] = r["host"] and f"https://{r['host']}"
        r["dedupe_key"] = f"tax:{r['tax_id']}" if r["tax_id"] else f"np:{r['name_key']}|{r['phone']}" if r["phone"] else f"n:{rng.choice('abcdefghijklmnop')}"
        return r

    store, batch = [record(k, True) for k in range(25)], [record(k, False) for k in range(120)]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], sequential.COLUMNS)
    got = sequential.upserted(frame(store), frame(batch)).toPandas()
    rows: list[dict] = []  # one record after another against all rows before it
    for r in [r | {"seq": -1} for r in store] + batch:
        r = r | {"email": r["email"] and r["email"].lower(), "merged": 0}
        same = lambda c: next((x for x in rows if r[c] and x[c] == r[c]), None)  # noqa: E731, B023
        named = [x for x in rows if r["name_key"] and x["name_key"] == r["name_key"]]
        old = None
        if r["seq"] is None or r["seq"] >= 0:
            old = same("dedupe_key") or same("tax_id") or same("email")
            old = old or next((x for x in named if r["phone"] and x["phone"] == r["phone"]), None)
            old = old or next((x for x in named if r["host"] and r["host"] in (x["website"] or "")), None)
            old = old or (next((x for x in rows if x["dedupe_key"] == "n:" + r["name_key"]), None) if r["name_key"] else None)
        if old is None:
            rows.append(r)
            continue
        old["merged"] += 1
        for c in sequential.FILLED:
            old[c] = old[c] or r[c]
        old["source_url"] = r["source_url"] or old["source_url"]
    want = pd.DataFrame(rows)
    key = lambda df: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df[["company_name", "dedupe_key", *sequential.FILLED, "source_url", "merged"]].itertuples(index=False))
    assert key(got) == key(want) and 25 < len(want) < 120


def test_sequential_upsert_of_a_common_key(spark):
    """A key that the store holds, and one that only the batch has, with many records each: few are replayed."""
    from rolodexter.operators import sequential

    record = lambda k, key, **kw: tuple((dict.fromkeys(sequential.NAMES) | {"id": None, "seq": k, "company_name": f"n{k}", "name_key": key, "dedupe_key": f"n:{key}", "source_url": f"u{k}"} | kw).values())
    store = spark.createDataFrame([record(None, "old", id=7)], sequential.COLUMNS)
    batch = spark.createDataFrame([record(k, "old" if k % 2 else "new", **({"phone": f"p{k}"} if k in (5, 6, 7, 8) else {})) for k in range(2000)], sequential.COLUMNS)
    for slice_rows in (20_000, 50):
        got = {r["dedupe_key"]: r for r in sequential.upserted(store, batch, slice_rows).collect()}
        assert len(got) == 2
        assert [(got[k]["id"], got[k]["company_name"], got[k]["phone"], got[k]["source_url"], got[k]["merged"]) for k in ("n:old", "n:new")] == [(7, "nNone", "p5", "u1999", 1000), (None, "n0", "p6", "u1998", 999)]


def plain_upsert(store, batch):
    """One record after another against all rows before it."""
    rows: list[dict] = []
    for r in [r | {"seq": -1} for r in store] + batch:
        stored = r["seq"] == -1
        r = r | {"email": r["email"] and r["email"].lower(), "merged": 0, "extra": dict(r["extra"] or {}), "contacts": list(r["contacts"] or [])}
        same = lambda c: next((x for x in rows if r[c] and x[c] == r[c]), None)  # noqa: E731, B023
        named = [x for x in rows if r["name_key"] and x["name_key"] == r["name_key"]]
        old = None
        if not stored:
            old = same("dedupe_key") or same("tax_id") or same("email")
            old = old or next((x for x in named if r["phone"] and x["phone"] == r["phone"]), None)
            old = old or next((x for x in named if r["host"] and r["host"] in (x["website"] or "")), None)
            old = old or (next((x for x in rows if x["dedupe_key"] == "n:" + r["name_key"]), None) if r["name_key"] else None)
        into = old or r
        if old is None:
            rows.append(r)
        else:
            old["merged"] += 1
            for c in ["tax_id", "email", "phone", "website", "address", "industry", "english_name", "fax", "products", "contact_person"]:
                old[c] = old[c] or r[c]
            for k, v in r["extra"].items():
                if v and not old["extra"].get(k):
                    old["extra"][k] = v
            old["source_url"] = r["source_url"] or old["source_url"]
            if r["email_verdict"] not in (None, "Unknown") and r["email"] and r["email"] == old["email"] and old["email_verdict"] != "Bounced":
                old["email_verdict"] = r["email_verdict"]
        if not stored and r["contact_person"] and r["contact_person"] not in [c["name"] for c in into["contacts"]]:
            into["contacts"].append({"name": r["contact_person"], "email": r["email"], "phone": r["phone"], "is_primary": not into["contacts"]})
    return rows


def shown(rows):
    """Rows of a store, comparable."""
    out = []
    for r in rows:
        people = [tuple((c if isinstance(c, dict) else c.asDict()).values()) for c in r["contacts"] or []]
        out.append(tuple(str(r[c]) for c in ["id", "company_name", "dedupe_key", "tax_id", "email", "phone", "website", "source_url", "email_verdict", "merged"]) + (str(sorted((r["extra"] or {}).items())), str(people)))
    return sorted(out)


@pytest.mark.parametrize("seed, slice_rows, task_rows", [(1, 20_000, 50_000), (2, 40, 60), (3, 60, 1000)])
def test_upsert_in_slices_equals_one_after_another(spark, seed, slice_rows, task_rows):
    """Maps, verdicts and contacts too; one e-mail and one key that a third of all records share, in the store or not."""
    import random

    from rolodexter.operators import sequential

    rng = random.Random(seed)
    pick = lambda pool, p: rng.choice(pool) if rng.random() < p else None

    def record(k, stored):
        name = rng.choice("abcdefghijklmnopqrstuvw") * rng.randint(1, 2)
        r = dict.fromkeys(sequential.NAMES) | {"id": k + 1 if stored else None, "seq": None if stored else k, "company_name": name, "name_key": pick([name], 0.8)}
        r |= {"tax_id": pick([str(x) for x in range(12)], 0.15), "email": pick(["hot@b.tw"] * 6 + [f"{x}@b.tw" for x in "ABCDEF"], 0.6), "phone": pick(["p1", "p2"], 0.4), "host": pick(["h1.tw", "h2.tw"], 0.3), "source_url": pick([f"u{k}"], 0.8)}
        r |= {"contact_person": pick(["Lin", "Wu", "Ho"], 0.3), "extra": pick([{"a": f"{k}", "b": ""}, {"b": f"{k}"}, {"c": None}], 0.5), "email_verdict": pick(["Valid", "Unknown", "Bounced", "Invalid"], 0.5)}
        r["website"] = r["host"] and f"https://{r['host']}"
        r["dedupe_key"] = f"tax:{r['tax_id']}" if r["tax_id"] else f"np:{r['name_key']}|{r['phone']}" if r["phone"] else f"k:{k}" if rng.random() < 0.4 else "n:hot" if rng.random() < 0.5 else f"n:{name}"
        if stored and seed % 2:
            r["email"] = r["email"] and r["email"].replace("hot", "cold")
        return r

    store, batch = [record(k, True) for k in range(20)], [record(k, False) for k in range(160)]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], sequential.COLUMNS)
    got = sequential.upserted(frame(store), frame(batch), slice_rows, task_rows).collect()
    assert shown(r.asDict() for r in got) == shown(plain_upsert(store, batch))


def test_common_mail_leaves_few_records(spark):
    """Records of one held e-mail, each with a key of its own, are counted, not replayed."""
    from rolodexter.operators import sequential

    record = lambda k, **kw: tuple((dict.fromkeys(sequential.NAMES) | {"id": None, "seq": k, "company_name": "x", "email": "hot@b.tw", "dedupe_key": f"k:{k}"} | kw).values())
    ready = lambda df, pending: sequential.complete(df).withColumns({"pending": F.lit(pending), "weight": F.lit(int(pending)).cast("long"), "merged": F.lit(0).cast("long"), "row_id": F.coalesce(-F.col("id"), "seq")})
    state = ready(spark.createDataFrame([record(None, id=7, dedupe_key="mail:hot@b.tw")], sequential.COLUMNS), False)
    batch = ready(spark.createDataFrame([record(k, phone=f"p{k}", source_url="u", tax_id="9" if k == 5 else None) for k in range(500)], sequential.COLUMNS), True)
    heavier, left = sequential._lighter(state, batch)
    assert [r["weight"] for r in heavier.collect()] == [497] and sorted(r["seq"] for r in left.collect()) == [0, 5, 499]


def test_records_of_a_name_leave_few(spark):
    """Of records that only their name leads to a held row those are kept that change it; an e-mail that records of held keys share too is settled; new rows that nothing finds are in no set."""
    from rolodexter.operators import sequential

    record = lambda k, **kw: tuple((dict.fromkeys(sequential.NAMES) | {"id": None, "seq": k, "company_name": "x", "dedupe_key": f"k:{k}"} | kw).values())
    ready = lambda df, pending: sequential.complete(df).withColumns({"pending": F.lit(pending), "weight": F.lit(int(pending)).cast("long"), "merged": F.lit(0).cast("long"), "row_id": F.coalesce(-F.col("id"), "seq")})
    held = [record(None, id=6, email="hot@b.tw", dedupe_key="mail:hot"), record(None, id=7, dedupe_key="n:a")]
    state = ready(spark.createDataFrame(held, sequential.COLUMNS), False)
    kinds = [{"name_key": "a", "source_url": "u"}, {"name_key": "a", "email": "hot@b.tw", "dedupe_key": "n:a"}, {"email": "hot@b.tw"}, {"name_key": "b"}]
    batch = ready(spark.createDataFrame([record(k, **kinds[k % 4]) for k in range(400)], sequential.COLUMNS), True)
    heavier, left = sequential._lighter(state, batch)
    assert {r["id"]: r["weight"] for r in heavier.collect()} == {6: 99, 7: 198}
    assert sorted(r["seq"] for r in left.filter("not alone").collect()) == [1, 2, 396] and left.filter("alone").count() == 100


def test_replay_gets_only_rows_that_records_find(spark, tmp_path, monkeypatch):
    """Of 400 rows of one name those are replayed that are the first with a signal of a record; blanks in hosts count; the rest comes out in the same form."""
    import uuid

    from rolodexter.operators import sequential

    real, told = sequential._replay, str(tmp_path)

    def counted(rows):
        with open(f"{told}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(rows)))
        return real(rows)

    record = lambda k, **kw: dict.fromkeys(sequential.NAMES) | {"id": None, "seq": k, "company_name": f"c{k}", "name_key": "a", "dedupe_key": f"k:{k}", "source_url": f"u{k}"} | kw
    sites = {5: "https://h1.tw", 6: "https:// h1.tw", 7: "https://h1.tw/x"}
    store = [record(None, id=k, dedupe_key=f"s:{k}", phone=f"p{k // 40}", tax_id=str(k // 100) if k > 150 else None, website=sites.get(k)) for k in range(1, 401)]
    signals = [{"phone": "p3"}, {"host": "h1.tw"}, {"host": " h1.tw"}, {"dedupe_key": "s:77"}, {"tax_id": "2", "phone": "new"}, {"phone": "new", "contact_person": "Lin"}, {"host": "none.tw"}]
    batch = [record(k, **signals[k % 7]) for k in range(70)]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], sequential.COLUMNS)
    monkeypatch.setattr(sequential, "_replay", counted)
    for slice_rows in (20_000, 30):
        got = sequential.upserted(frame(store), frame(batch), slice_rows).collect()
        assert shown(r.asDict() for r in got) == shown(plain_upsert(store, batch))
        sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
        assert max(sizes) <= 70 + 5
    store[299] |= {"fax": " ", "address": "\t"}
    left = next(r for r in sequential.upserted(frame(store), frame(batch)).collect() if r["id"] == 300)
    assert (left["fax"], left["address"], left["contacts"], left["extra"]) == (None, None, [], {})


@pytest.mark.parametrize("shape", ["chain", "shuffled chain", "stars", "mixed"])
def test_clusters_by_contraction(spark, shape):
    import random

    from rolodexter.operators.connected import clusters, contracted

    rng = random.Random(9)
    n = 5000 if "chain" in shape else 300
    names = list(range(n))
    if shape == "shuffled chain":
        rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(n - 1)] if "chain" in shape else [(i, i % 7) for i in range(n)] if shape == "stars" else [(rng.randrange(n), rng.randrange(n)) for _ in range(200)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(links + [(1, 1), (None, 2)], "u long, v long")
    got = {r["x"]: r["root"] for r in contracted(edges).collect()}
    assert got == {x: find(x) for x in {y for e in links for y in e if e[0] != e[1]}}
    keys = spark.createDataFrame([(k, x) for k, e in enumerate(links) for x in e] + [(None, 3), (None, 4)], "key long, id long")
    assert {r["id"]: r["cluster"] for r in clusters(spark.range(n), "id", keys).collect()} == {x: find(x) for x in range(n)}


def test_rules(spark):
    from rolodexter.sources.extraction import Rule, extracted, judged_rules

    card = "<div class='card x' id='c{0}'><h3 class=name>Firm {0}</h3><a href='mailto:a{0}@b.tw'>m</a><a href='/x'>y</a><p class=t>tel <b>02-{0}</b></div>"
    html = "<main>" + "".join(card.format(k) for k in range(4)) + "</main><div class=card><h3>no name</h3></div>"
    rules = {"name": Rule("h3.name"), "email": Rule("a[href^='mailto:']", "href", "mailto:(.*)"), "phone": Rule("p b"), "links": Rule("a", "href", multiple=True, separator="|"), "none": Rule("i")}
    rows = extracted(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "main div.card", rules)
    got = rows.collect()
    assert [(r["name"], r["email"], r["phone"], r["links"]) for r in got] == [(f"Firm {k}", f"a{k}@b.tw", f"02-{k}", f"mailto:a{k}@b.tw|/x") for k in range(4)]
    assert {r["field"]: r["valid"] for r in judged_rules(rows, ["name", "none"], ["name"]).collect()} == {"name": True, "none": False}


def test_site_contacts(spark):
    from rolodexter.sources.extraction import site_contacts

    rows = spark.createDataFrame([("https://www.firm.tw/a", "wang@firm.tw info@firm.tw x@other.tw"), ("http://b.tw", "0f3c5a7b9d1e4c2f8a6b0d4e7f9c1b35@sentry.io z@mail.tw")], "url string, text string")
    assert {r["host"]: r["email"] for r in site_contacts(rows, "url", "text").collect()} == {"firm.tw": "info@firm.tw", "b.tw": "z@mail.tw"}


def test_cleaning(spark):
    from rolodexter.operators import records

    cols = ["id", *records.RAW]
    row = lambda k, **v: tuple([k] + [v.get(c) for c in records.RAW])
    raw = spark.createDataFrame(
        [
            row(1, company_name="　東嶼股份有限公司 ", email="Info@Tatung.COM.tw", phone="+886 2 24417730", website="www.tatung.com", tax_id="４８６１３００３", address="104 台北市 中山區", fax="x"),
            row(2, company_name=" "),
            row(3, company_name="如何選擇工廠？", website="a.tw"),
            row(4, company_name="Acme Ltd", email="0f3c5a7b9d1e4c2f8a6b0d4e7f9c1b35@sentry.io", phone="12", tax_id="99999999"),
        ],
        ", ".join(f"{c} {'int' if c == 'id' else 'string'}" for c in cols),
    )
    mx = spark.createDataFrame([("tatung.com.tw", True)], "domain string, has_mx boolean")
    got = {r["id"]: r for r in records.cleaned(raw, mx=mx).collect()}
    a = got[1]
    assert (a["company_name"], a["name_key"], a["dedupe_key"], a["email"], a["phone"], a["website"], a["address"], a["fax"], a["email_verdict"], a["rejected"]) == ("東嶼股份有限公司", "東嶼", "tax:48613003", "info@tatung.com.tw", "02-24417730", "https://www.tatung.com", "台北市中山區", None, "Valid", None)
    assert got[2]["rejected"] == "no usable name" and got[3]["rejected"] == "name is a headline"
    assert (got[4]["email"], got[4]["phone"], got[4]["tax_id"], got[4]["dedupe_key"], got[4]["email_verdict"]) == (None, None, "99999999", "n:acme", "Empty")


def test_small_record_work(spark):
    from rolodexter.operators import records

    pairs = spark.createDataFrame([([(" a ", "1"), ("b", " "), ("a", "2"), ("c", "3")],)], "x array<struct<k:string,v:string>>")
    assert pairs.select(records.tidy_extra("x").alias("m")).first()["m"] == {"a": "2", "c": "3"}
    js = spark.createDataFrame([('{"b":"1","a":"2"}',), ("[1",), (None,)], "j string").select(records.map_from_json("j").alias("m"))
    assert [r["m"] for r in js.collect()] == [{"b": "1", "a": "2"}, {}, {}]
    assert js.select(records.map_to_json("m").alias("j")).first()["j"] == '{"a":"2","b":"1"}'
    old, new = spark.createDataFrame([(1, "x")], "id int, gone string"), spark.createDataFrame([], "id int, stage string, note string")
    assert records.migrated(old, new, {"stage": "New"}).collect()[0].asDict() == {"id": 1, "stage": "New", "note": None}
    assert spark.range(1).select(records.page_urls(F.lit("u?p={page}"), F.lit(2), F.lit(3)).alias("u")).first()["u"] == ["u?p=2", "u?p=3"]
    z = spark.createDataFrame([(["a", "b"], ["x"])], "i array<string>, d array<string>").select(records.zipped_details("i", "d").alias("z")).first()["z"]
    assert [tuple(x) for x in z] == [("a", "x"), ("b", "")]
