"""Replies of a model in every shape, against plain parsing."""

import json
import random

from pyspark.sql import functions as F

from rolodexter.sources import replies

CASES = {
    "plain": ('[{"a": "1"}, {"a": "2"}]', "ok", ["1", "2"], 0),
    "fenced": ('```json\n[{"a": "1"}]\n```', "ok", ["1"], 0),
    "fence without language": ('```\n{"a": "1"}\n```  ', "ok", ["1"], 0),
    "preface": ('好的，以下是結果：\n[{"a": "x]y"}] 以上', "ok", ["x]y"], 0),
    "preface, one object": ('Here {"a": "1"} it is', "ok", ["1"], 0),
    "wrapped": ('{"n": 3, "z": [{"a": "z"}], "b": [{"a": "b"}]}', "ok", ["z"], 0),
    "one object": ('{"a": "1", "b": {"c": [1]}}', "ok", ["1"], 0),
    "others": ('[1, {"a": "1"}, null, "x", [2]]', "ok", ["1"], 4),
    "types": ('[{"a": 12}, {"a": 1.5}, {"a": true}, {"a": null}, {"a": ["x"]}, {"a": {"b": 1}}, {}]', "ok", ["12", "1.5", None, None, None, None, None], 0),
    "cut off": ('[{"a": "1", "d": {"e": "}"}}, {"a": "2 \\" {"}, {"a": "3', "cut off", ["1", '2 " {'], 0),
    "cut off in a wrapping": ('```json\n{"companies": [{"a": "1"}, {"a": "2"}, {"a', "cut off", ["1", "2"], 0),
    "empty": ("  \n ", "empty", [], 0),
    "null": (None, "empty", [], 0),
    "no JSON": ("I cannot do that.", "no JSON", [], 0),
    "no list": ("12", "no list", [], 0),
    "braces only": ("use {name} here", "no JSON", [], 0),
    "empty list": ("[]", "ok", [], 0),
}


def test_replies(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "k string, reply string").repartition(3)
    states = {r["k"]: r for r in replies.reply_states(df, "reply", most=3).collect()}
    items = replies.reply_items(df, "reply", ["a"]).orderBy("k", "nth").collect()
    for k, (_, status, values, others) in CASES.items():
        assert (states[k]["status"], states[k]["returned"], states[k]["others"], states[k]["over_limit"]) == (status, len(values), others, max(len(values) - 3, 0)), k
        assert [r["a"] for r in items if r["k"] == k] == values, k
    assert {r["k"] for r in replies.reply_items(df, "reply", ["a"], most=3).filter("nth > 2").collect()} == set()


def test_cut_replies_keep_whole_objects(spark):
    """Cut anywhere, a list gives the objects that ended before the cut."""
    rng = random.Random(3)
    items = [{"a": rng.choice(['x"y', "{", "}}", "\\", "公司", "[{"]) + str(k), "in": {"b": [k, {"c": "}"}]}} for k in range(5)]
    whole = "Sure:\n" + json.dumps(items, ensure_ascii=False)
    ends = [len("Sure:\n[" + ", ".join(json.dumps(x, ensure_ascii=False) for x in items[:k])) for k in range(1, 6)]
    cuts = sorted(rng.sample(range(8, len(whole) - 1), 60)) + ends
    rows = spark.createDataFrame([(c, whole[:c]) for c in dict.fromkeys(cuts)], "cut int, reply string")
    got = {r["cut"]: [json.loads(x)["a"] for x in r["found"]] for r in rows.select("cut", replies.complete_objects(F.col("reply")).alias("found")).collect() if all("in" in json.loads(x) for x in r["found"])}
    for cut, found in got.items():
        assert found == [x["a"] for x, e in zip(items, ends, strict=True) if e <= cut]
    assert len(got) > 40


def test_grounded_replies(spark):
    page = "東嶼有限公司 電話 02-2581-6407 信箱 info@island.tw；林水秀商行 電話 (04)2222-3333"
    reply = '```json\n{"companies": [{"company_name": "東嶼有限公司", "phone": "02 25816407", "email": "made@up.tw"}, {"company_name": "虛構公司", "phone": "02-25816407"}, {"company_name": "", "phone": "1"}, {"company_name": "林水秀商行", "phone": "04-22223333", "email": "N/A"}]}\n```'
    items, states = replies.extracted_companies(spark.createDataFrame([(1, page, reply), (2, page, "no"), (3, "", None)], "page_id int, page string, reply string"), "page_id", "reply", "page", ["phone", "email"])
    assert [tuple(r) for r in items.orderBy("nth").collect()] == [(1, 0, "東嶼有限公司", "02 25816407", None), (1, 3, "林水秀商行", "04-22223333", None)]
    assert sorted(tuple(r) for r in states.select("page_id", "status", "returned", "dropped_records", "dropped_values").collect()) == [(1, "ok", 4, 1, 1), (2, "no JSON", 0, 0, 0), (3, "empty", 0, 0, 0)]
