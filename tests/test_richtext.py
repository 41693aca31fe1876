"""Bodies as documents and back."""

import html
import random

import pytest
from pyspark.sql import functions as F

from rolodexter.functions import richtext


def show(spark, bodies):
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string").select("k", richtext.document("body").alias("d"))
    return [r for r in df.select("k", "d", richtext.to_html("d").alias("html"), richtext.to_text("d").alias("text"), richtext.is_blank("d").alias("blank")).orderBy("k").collect()]


def plain(d):
    return [(x["kind"], [(r["text"], list(r["styles"]), r["link"], r["image"]) for r in x["runs"]]) for x in d]


def random_document(rng):
    lines = []
    for _ in range(rng.randint(1, 8)):
        runs = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.15:
                runs.append(("", [], None, f"http://p.tw/{rng.randint(0, 9)}.png?a=1&b=\"2\""))
                continue
            text = rng.choice(["A & B", "<tag>", "公司", "x", "\"q\" 'p'", "&amp; stays", "a  b".replace("  ", " "), "©", "1 < 2 > 0"])
            run = (text, sorted(rng.sample(["bold", "italic", "underline"], rng.choice([0, 0, 1, 2, 3]))), rng.choice([None, None, "http://a.tw/?x=1&y='2'", "mailto:a@b.tw"]), None)
            if not runs or runs[-1][3] or runs[-1][1:3] != run[1:3]:  # runs alike would be one
                runs.append(run)
        lines.append((rng.choice(["text", "text", "title", "heading", "bullet"]) if runs else "text", runs))
    return lines


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(spark, seed):
    rng = random.Random(seed)
    docs = [random_document(rng) for _ in range(60)]
    rows = spark.createDataFrame([(k, [{"kind": kind, "runs": [dict(zip(("text", "styles", "link", "image"), r, strict=True)) for r in runs]} for kind, runs in d]) for k, d in enumerate(docs)], "k int, d array<struct<kind:string,runs:array<struct<text:string,styles:array<string>,link:string,image:string>>>>")
    once = rows.select("k", richtext.to_html("d").alias("h"), richtext.to_text("d").alias("t"))
    back = once.select("k", "h", "t", richtext.document("h").alias("d")).select("k", "h", "t", "d", richtext.to_html("d").alias("h2"), richtext.to_text("d").alias("t2")).orderBy("k").collect()
    for r in back:
        assert plain(r["d"]) == docs[r["k"]] and r["h2"] == r["h"] and r["t2"] == r["t"]
        words = "".join(t for _, runs in docs[r["k"]] for t, *_ in runs)
        assert sorted(html.unescape(__import__("re").sub(r"<[^>]*>", "", r["h"])).replace("\n", "")) == sorted(words)


def test_bodies(spark):
    got = show(spark, ["", None, "plain\n\n1 < 2 & <3", "<p>A&nbsp;&euro; &#x516C;&#21496;<br>B</p><p><br></p>\n<div>C</div>", "<ul><li>one</li>\n<li><b>two</b> <a href='http://x.tw/2'>there</a></li></ul>tail", "<h1>t</h1><h2>T</h2><h4>H</h4><img src='i.png'><script2>kept</script2>", "<p> </p>", "<b>un<i>closed</b> text"])
    assert [r["blank"] for r in got] == [True, True, False, False, False, False, True, False]
    assert [r["text"] for r in got[:3]] == ["", "", "plain\n\n1 < 2 & <3"]
    assert got[3]["text"] == "A € 公司\nB\n\nC" and plain(got[3]["d"])[2] == ("text", [])
    assert got[4]["text"] == "・one\n・two there（http://x.tw/2）\ntail" and got[4]["html"] == '<ul>\n<li>one</li>\n<li><strong>two</strong> <a href="http://x.tw/2">there</a></li>\n</ul>\n<p>tail</p>'
    assert [x["kind"] for x in got[5]["d"]] == ["text", "title", "heading", "text"] and got[5]["text"].endswith("[圖片：i.png]kept")
    assert got[7]["text"] == "unclosed text"


def test_rendering_needs_no_python(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "b string").select(richtext.document("b").alias("d")).checkpoint(False)
    rendered = df.select(richtext.to_html("d"), richtext.to_text("d"))
    assert "Python" not in rendered._jdf.queryExecution().executedPlan().toString().split("Scan")[0] and rendered.agg(F.count(F.lit(1))).first()[0] == 1
