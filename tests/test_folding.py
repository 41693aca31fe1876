"""Folding companies, labels, answers, the encryption catalogue, source names, completion and site contacts."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolodexter.functions import crypto, labels
from rolodexter.operators import ask, folding, joins

def now():
    return F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")


def plain_fold(companies, merges, links, children):
    """One merge after another, as a store does it; a dropped company is gone for the merges after it."""
    rows = {c["id"]: dict(c, extra=dict(c["extra"] or {})) for c in companies}
    tags, kids, first = {i: [] for i in rows}, [dict(k) for k in children], {}
    for company, tag in links:
        tags.setdefault(company, []).append(tag)
    for keep, drop, seq in sorted(merges, key=lambda m: m[2]):
        if keep != drop and keep in rows and drop in rows and drop not in first:
            first[drop] = (keep, seq)
    target = lambda i: target(first[i][0]) if i in first else i
    for drop, (_, _) in sorted(first.items(), key=lambda x: x[1][1]):
        to, gone = rows[target(drop)], rows[drop]
        for c in folding.FILL:
            if not (to[c] or "").strip() and (gone[c] or "").strip():
                to[c] = gone[c]
        for k, v in (gone["extra"] or {}).items():
            if (v or "").strip() and not (to["extra"].get(k) or "").strip():
                to["extra"][k] = v
        to["dnc"] = bool(to["dnc"]) or bool(gone["dnc"])
        to["updated_at"] = "new"
    return [r for i, r in rows.items() if i not in first], {(target(i), t) for i, ts in tags.items() for t in ts}, [dict(k, company_id=target(k["company_id"])) for k in kids]


@pytest.mark.parametrize("seed", [1, 2])
def test_folding(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    companies = [{"id": i, **{c: pick(None, "", " ", f"{c}{i}") for c in folding.FILL}, "extra": pick(None, {"a": f"a{i}"}, {"a": "", "b": f"b{i}"}), "dnc": pick(None, False, False, True), "updated_at": "old"} for i in range(60)]
    merges = [(rng.randint(0, 62) if rng.random() < 0.6 else 3, rng.randint(4, 62), k) for k in range(45)]
    merges = [m for m in merges if m[0] < m[1]]  # no rings
    merges += [(9, 9, 900), (5, None, 901), (None, 6, 902)]
    links = [(rng.randint(0, 59), pick("x", "y", "z")) for _ in range(80)]
    children = [{"company_id": rng.randint(0, 59), "note": f"n{k}"} for k in range(70)]
    frame = spark.createDataFrame([tuple(c.values()) for c in companies], "id long, " + ", ".join(f"{c} string" for c in folding.FILL) + ", extra map<string,string>, dnc boolean, updated_at string")
    got, tags, kids = folding.folded(frame, spark.createDataFrame(merges, "keep long, drop long, seq long"), spark.createDataFrame(links, "company_id long, tag string"), {"notes": spark.createDataFrame([tuple(c.values()) for c in children], "company_id long, note string")}, flags=["dnc"], now=F.lit("new"))
    want, want_tags, want_kids = plain_fold(companies, [m for m in merges if None not in m], links, children)
    show = lambda r: tuple(str((r[c] or "").strip()) for c in folding.FILL) + (r["id"], bool(r["dnc"]), r["updated_at"], tuple(sorted((k, v) for k, v in (r["extra"] or {}).items() if (v or "").strip())))
    assert sorted(map(show, (r.asDict() for r in got.collect()))) == sorted(map(show, want)) and 10 < len(want) < 60
    assert sorted(tuple(r) for r in tags.collect()) == sorted(want_tags)
    assert sorted((r["company_id"], r["note"]) for r in kids["notes"].collect()) == sorted((k["company_id"], k["note"]) for k in want_kids)


def test_labels_and_back(spark):
    rows = spark.createDataFrame([("New",), ("Meeting",), ("odd",), (None,), ("Unknown",)], "v string")
    got = rows.select(labels.label_of("v").alias("any"), labels.label_of("v", "activity").alias("activity")).collect()
    assert [r["any"] for r in got] == ["新名單", "已會面", "odd", "", "未檢查"] and [r["activity"] for r in got][1] == "會議"
    for kind, pairs in labels.LABELS.items():
        back = spark.createDataFrame([(v,) for v in pairs], "v string").select("v", labels.value_of(labels.label_of("v", kind), kind).alias("b")).collect()
        assert all(r["v"] == r["b"] for r in back)
    assert [r["b"] for r in spark.createDataFrame([("全部",), ("",), ("全然",), ("會議",)], "v string").select(labels.value_of("v").alias("b")).collect()] == ["", "", "全然", "Meeting"]
    assert labels.options("priority", True) == ["全部", "低", "中", "高", "緊急"] and labels.field_label("fax") == "傳真" and labels.field_label("x") == "x"


def test_answers_say_what_they_rest_on(spark):
    rows = spark.createDataFrame([(k, f"公司{k}", None if k % 2 else "a@b.tw") for k in range(7)], "id int, company_name string, email string")
    say = lambda reply: ask.answer(rows, ask.parsed(reply), now(), ["company_name"]).first()
    listed = say('{"arguments": {"has_email": true, "limit": 2, "order_by": "company_name", "colour": "red"}}')
    assert listed["headline"] == "有 4 家，下面列出前 2 家。" and listed["criteria"] == "有信箱、最多幾家 = 2、排序 = 公司名稱" and listed["ignored"] == "colour" and (listed["total"], listed["shown"]) == (4, 2)
    assert say('{"mode": "count", "arguments": {"has_email": false}}')["headline"] == "有 3 家。" and say('{"mode": "count", "arguments": {"has_email": false}}')["criteria"] == "不是「有信箱」"
    assert say("{}")["headline"] == "有 7 家，全部列在下面。" and say("{}")["criteria"] == "沒有加任何條件（整個名單）"
    assert say('{"arguments": {"keyword": "none"}}')["headline"] == "符合條件的一家都沒有。"


def test_encryption_catalogue(spark):
    key = b"k" * 32
    rows = spark.createDataFrame([(1, "A@b.tw ", "1"), (2, None, ""), (3, "c@d.tw", None)], "id int, email string, phone string")
    plain = crypto.marked(rows, ["email", "phone"])
    tables = {"companies": plain, "tags": spark.range(3)}
    assert crypto.catalogue(tables) == {"companies": ["email", "phone"]}
    tell = lambda df, **kw: crypto.states({"companies": df}, **kw).first()
    assert tuple(tell(plain, configured=True)) == ("companies", 0, 3, 3, True, False) and tell(plain, configured=False)["pending"] == 0 and tell(plain, configured=True, usable=False)["pending"] == 0
    sealed, changed, lost = crypto.conversion(plain, key, emails=["email"])
    assert plain.agg(F.sum(changed)).first()[0] == 3 and crypto.catalogue({"x": sealed}) == {"x": ["email", "phone"]}
    half = crypto.marked(sealed.filter("id = 1").unionByName(rows.filter("id <> 1")), ["email", "phone"])
    assert tuple(tell(half, configured=True, key_present=False))[1:] == (2, 1, 1, True, True) and tell(half, configured=False)["pending"] == 2
    broken = crypto.marked(half.unionByName(spark.createDataFrame([(4, "enc:v1:xx", None)], "id int, email string, phone string")), ["email", "phone"])
    opened, changed, lost = crypto.conversion(broken, key, back=True)
    assert tuple(broken.agg(F.sum(changed), F.sum(lost)).first()) == (2, 1)
    assert sorted((r["id"], r["email"]) for r in opened.collect()) == sorted([(1, "a@b.tw"), (2, None), (3, "c@d.tw"), (4, "enc:v1:xx")])


def test_source_names(spark):
    new = [(0, "https://www.a.tw/member/"), (1, "http://a.tw/member.php?x=1"), (2, "https://a.tw/member-2"), (3, "https://a.tw/"), (4, "https://A.tw/x/.hidden"), (5, "b.tw"), (6, "https://c.tw/a/b.html"), (7, "https://a.tw/member")]
    have = spark.createDataFrame([("a.tw-member",), ("c.tw-b",), ("c.tw-b-2",), ("zzz",)], "name string")
    got = {r["seq"]: r["name"] for r in folding.source_names(spark.createDataFrame(new, "seq long, url string"), have).collect()}
    assert got == {0: "a.tw-member-2", 1: "a.tw-member-3", 2: "a.tw-member-2-2", 3: "a.tw", 4: "a.tw-x", 5: "custom_source", 6: "c.tw-b-3", 7: "a.tw-member-4"}


def test_completion_queue(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, "x", "y", None), (2, " ", "y", at(31)), (3, None, "y", at(1)), (4, "x", "", None), (5, "", "", at(2))], "id int, phone string, fax string, completion_checked_at timestamp_ntz")
    assert [r["id"] for r in folding.completion_queue(rows, ["phone", "fax"], now(), 10).collect()] == [4, 3, 5]
    assert folding.completion_counts(rows, ["phone", "fax"], now(), 10).first().asDict() == {"incomplete": 4, "never_tried": 1, "due": 3, "waiting": 1, "without_phone": 3, "without_fax": 2}


def test_labels_on_hits(spark):
    hits = spark.createDataFrame([("q", n, f"u{n}") for n in range(5)] + [("r", 0, "v")], "query_id string, nr int, url string")
    said = [("q", 3, "directory", "many", 0), ("q", 1, "Company", "one", 1), ("q", 1, "unrelated", "again", 2), ("q", 9, "company", "none", 3), ("q", None, "company", "?", 4), ("q", 0, "nonsense", "x", 5), ("q", 4, "unrelated", "no", 6), ("z", 0, "company", "no query", 0)]
    out, ignored = joins.labelled_hits(hits, spark.createDataFrame(said, "query_id string, nr int, kind string, reason string, seq int"))
    assert [(r["nr"], r["kind"]) for r in out.filter("query_id = 'q'").orderBy("place").collect()] == [(3, "directory"), (1, "company"), (0, "unjudged"), (2, "unjudged"), (4, "unrelated")]
    assert {r["query_id"]: r["ignored"] for r in ignored.collect()} == {"q": 3, "z": 1} and out.filter("query_id = 'r'").first()["kind"] == "unjudged"


def test_site_contacts_by_label(spark):
    home = "<p>東嶼繩索股份有限公司</p> <p>傳真：02-2581-6408 電話：</p> <p>聯絡人：林水秀 </p> webmaster@provider.com wang@islandrope.tw sales@islandrope.tw"
    rows = [
        (1, "東嶼繩索", 0, "https://www.islandrope.tw", home), (1, "東嶼繩索", 1, "https://www.islandrope.tw/contact", "<a href='tel:02-2581-6407'>f</a> 02-2581-6408 (04 )22223333"), (1, "東嶼繩索", 2, "https://www.islandrope.tw/about", "電話：02-9999-9999"),
        (2, "別家", 0, "https://b.tw", "no such name 02-2581-0000"), (2, "別家", 1, "https://b.tw/c", "別家 02-2581-0001"),
        (3, "北港", 0, "https://c.tw", None), (3, "北港", 1, "https://c.tw/c", "北港 02-2581-0002"),
        (4, "南港", 0, "https://d.tw", "南港"), (4, "南港", 1, "https://d.tw/1", None), (4, "南港", 2, "https://d.tw/2", "x"), (4, "南港", 3, "https://d.tw/3", "info@d.tw"), (4, "南港", 4, "https://d.tw/4", "02-2581-0003"),
    ]
    got = {r["company_id"]: tuple(r)[1:] for r in folding.own_site_contacts(spark.createDataFrame(rows, "company_id int, name_key string, nth int, url string, html string")).collect()}
    assert got[1] == (True, 2, "sales@islandrope.tw", "02-25816407", "02-25816408", "林水秀")
    assert got[2] == (False, 1, None, None, None, None) and got[3][:1] == (False,) and got[3][2:] == (None,) * 4
    assert got[4] == (True, 3, "info@d.tw", None, None, None)
    loose = {r["company_id"]: r for r in folding.own_site_contacts(spark.createDataFrame(rows, "company_id int, name_key string, nth int, url string, html string"), ["phone"], confirm=False).collect()}
    assert (loose[2]["confirmed"], loose[2]["pages_read"], loose[2]["phone"]) == (True, 1, "02-25810000")
