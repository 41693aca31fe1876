from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rolodexter.functions import crypto, dates, identity, score, text, validate


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.clean, "  a   b\tc\n d ", "a b c d"),
        (text.clean, "   ", None),
        (text.clean, None, None),
        (text.email, "Name <A@B.COM>", "a@b.com"),
        (text.email, "mailto:a@b.com?subject=hi", "a@b.com"),
        (text.email, "bureau[at]harbour[dot]tw", "bureau@harbour.tw"),
        (text.email, "bureau AT harbour DOT tw", None),
        (text.email, "nobody", None),
        (text.phone, "+886-2-2581-6407", "02-25816407"),
        (text.phone, "0931207745", "0931-207-745"),
        (text.phone, "(02)2596-3318 分機 210", "02-25963318#210"),
        (text.phone, "+44 20 7946 0018", "+442079460018"),
        (text.phone, "0800123456", "0800-123-456"),
        (text.phone, "n/a", None),
        (text.website, "https://Harbour.tw/?utm_medium=mail&page=3", "https://harbour.tw?page=3"),
        (text.website, "example.com/a/", "https://example.com/a"),
        (text.website, "ftp://example.com", None),
        (text.website, "無", None),
        (text.website_host, "http://www.example.com:80/x", "example.com"),
        (text.tax_id, "統編 4861-3003", "48613003"),
        (text.address, "880 澎湖縣馬公市 7 號", "澎湖縣馬公市7號"),
        (text.person, "聯絡人：林水秀、", "林水秀"),
        (text.industry, "產業: 機械/", "機械"),
        (text.neutral, "=1+1", "'=1+1"),
        (text.neutral, "a", "a"),
        (validate.is_tax_id, "48613003", True),
        (validate.is_tax_id, "53041872", True),
        (validate.is_tax_id, "99999999", False),
        (validate.is_tax_id, "1234567", False),
        (validate.is_tax_id, None, False),
        (validate.is_email, "a..b@c.de", False),
        (validate.is_email, "a.b@c.de", True),
        (validate.is_phone, "123456", False),
        (validate.is_phone, "02-25816407#9", True),
        (validate.is_company_name, "a" * 255, True),
        (validate.is_company_name, "a" * 256, False),
        (validate.is_company_name, "合計", False),
        (validate.is_company_name, "合計企業有限公司", True),
        (validate.is_company_name, "123", False),
        (validate.is_tracking_address, "0f3c5a7b9d1e4c2f8a6b0d4e7f9c1b35@x.org", True),
        (validate.is_tracking_address, "logo@2x.png", True),
        (validate.is_tracking_address, "a@o1.ingest.sentry.io", True),
        (validate.is_tracking_address, "wang@factory.tw", False),
        (validate.is_website, "https://a.b.tw/x", True),
        (validate.email_verdict, "", "Empty"),
        (validate.email_verdict, "x@", "Invalid Syntax"),
        (validate.email_verdict, "x@y.org", "Unknown"),
        (dates.roc_date, "0760221", date(1987, 2, 21)),
        (dates.roc_date, "0769931", None),
        (dates.roc_date, "x", None),
        (identity.confidence, "np:a|b", "high"),
    ],
)
def test_value(spark, f, value, want):
    assert one(spark, value, f) == want


def test_halfwidth(spark):
    assert one(spark, "Ａｂｃ　１", text.halfwidth) == "Abc 1"
    assert one(spark, "plain", text.halfwidth) == "plain"
    assert one(spark, None, text.halfwidth) is None


@pytest.mark.parametrize(("a", "b"), [("Quay Rope Company Limited", "QUAY ROPE Corp."), ("台東海岸茶葉研究所股份有限公司", "臺東海岸茶葉研究所"), ("月光窯（股）公司", "月光窯")])
def test_name_keys_agree(spark, a, b):
    rows = spark.createDataFrame([(a,), (b,)], "x string").select(text.company_name_key("x").alias("k")).collect()
    assert rows[0]["k"] == rows[1]["k"] != ""


def test_company_or_headline(spark):
    why = lambda n, s=None: spark.createDataFrame([(n, s)], "n string, s string").select(validate.why_not_a_company("n", "s").alias("y")).first()["y"]
    assert why("東嶼股份有限公司？") is None
    assert why("如何選擇工廠") == "name is a headline"
    assert why("某某", "https://blog.example.com/x") == "site is an article"
    assert why(" ") == "no name"
    assert why("東嶼") is None


def test_dedupe_key_cascade(spark):
    def key(**k):
        row = {c: k.get(c) for c in ("name", "tax", "mail", "tel", "site")}
        df = spark.createDataFrame([tuple(row.values())], "name string, tax string, mail string, tel string, site string")
        return df.withColumn("nk", text.company_name_key("name")).select(identity.dedupe_key("name", "nk", "tax", "mail", "tel", "site").alias("k")).first()["k"]

    assert key(name="A Ltd", tax="48613003", mail="a@b.tw") == "tax:48613003"
    assert key(name="A Ltd", tax="99999999", mail="A@b.tw") == "mail:a@b.tw"
    assert key(name="Abc Ltd", tel="02-25816407") == "np:abc|02-25816407"
    assert key(name="Abc Ltd", site="www.abc.tw") == "nw:abc|abc.tw"
    assert key(name="Abc Ltd") == "n:abc"
    assert key(name="…") == "raw:…"
    assert key() == ""


def test_score_is_the_sum_of_its_parts(spark):
    now = F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")
    rows = spark.createDataFrame([("a@b.tw", "Valid", "1", 10**9, datetime(2024, 1, 1), False), (None, None, None, None, None, False), ("a@b.tw", "Valid", "1", 10**9, datetime(2024, 1, 1), True)], "email string, email_verdict string, phone string, capital long, updated_at timestamp, do_not_contact boolean")
    roles = {c: c for c in rows.columns}
    got = rows.select(score.lead_score(roles, now).alias("s"), F.aggregate(score.explained(roles, now), F.lit(0), lambda a, x: a + x["points"]).alias("t")).collect()
    assert [r["s"] for r in got] == [82, 0, 10]  # 31 days: 40 + 20 + 15 + 7
    assert got[0]["s"] == got[0]["t"]


def test_encryption(spark):
    key = b"k" * 32
    rows = spark.createDataFrame([("a",), ("a",), ("臺",), (None,), ("",), ("enc:v1:broken",)], "x string").withColumn("s", crypto.encrypted("x", key)).withColumn("p", crypto.decrypted("s", key)).collect()
    assert rows[0]["s"] == rows[1]["s"] != rows[2]["s"]
    assert [r["p"] for r in rows] == ["a", "a", "臺", None, "", None]
