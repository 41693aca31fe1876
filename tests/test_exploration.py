"""Walking sites against a plain best-first search with a queue."""

import random
import re
from collections import defaultdict
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest

from rolodexter.sources import exploration as ex


def plain_page(url):
    p = urlsplit(url)
    return urlunsplit((p.scheme, p.netloc.lower(), p.path.rstrip("/") or "/", p.query, ""))


def plain_list(page):
    p = urlsplit(page)
    return f"{p.netloc}{re.sub(r'[0-9]+', '#', p.path)}?{re.sub(r'[0-9]+', '#', p.query)}"


def plain_priority(url, label=""):
    p = urlsplit(url)
    said = f"{p.path} {p.query} {label}".lower()
    if any(w in said for w in ex.UNPROMISING):
        return -1.0
    return max(sum(2.0 for w in ex.PROMISING if w in said) - p.path.strip("/").count("/") * 0.3, 0.0)


def plain_walk(start, links, lists, seeds, budget, target):
    """[(page, found)] and whether the budget ended it; links: {page: [(url, priority)]}"""
    queue, seen, lists_seen, out = [(1000.0, start), *((p, u) for u, p in seeds)], set(), set(), []
    while queue and len(out) < budget and sum(f for _, f in out) < target:
        queue.sort(key=lambda x: -x[0])
        _, url = queue.pop(0)
        page = plain_page(url)
        if page in seen:
            continue
        seen.add(page)
        if plain_list(page) in lists_seen:
            continue
        found = page in lists
        out.append((page, found))
        if found:
            lists_seen.add(plain_list(page))
        else:
            queue += [(p, u) for u, p in links.get(page, []) if plain_page(u) not in seen]
    left = [u for _, u in queue if plain_page(u) not in seen and plain_list(plain_page(u)) not in lists_seen]
    return out, len(out) >= budget and bool(left)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sites_are_walked_best_first(spark, seed):
    rng = random.Random(seed)
    words = ["news", "members", "list", "about", "company", "x", "directory", "cat"]
    links, starts, lists, seeds = defaultdict(list), {}, set(), defaultdict(list)
    rows = []
    for k in range(6):
        host = f"https://s{k}.tw"
        urls = [f"{host}/"] + [f"{host}/{'/'.join(rng.choice(words) for _ in range(rng.randint(1, 3)))}{rng.choice(['', '/', '?p=' + str(rng.randint(1, 4)), str(rng.randint(1, 9))])}" for _ in range(70)]
        starts[f"s{k}.tw"] = urls[0]
        for u in dict.fromkeys(map(plain_page, urls)):
            for pos in range(rng.randint(0, 5) if k else 40 * (u == plain_page(urls[0]))):
                to = rng.choice(urls)
                label = rng.choice(["", "會員名錄", "more", "Search"])
                if plain_priority(to, label) >= 0:
                    links[u].append((to, plain_priority(to, label)))
                    rows.append((u, pos, plain_page(to), to, plain_priority(to, label)))
            if rng.random() < 0.12:
                lists.add(u)
        if k % 2:
            seeds[f"s{k}.tw"] = sorted(((u, plain_priority(u)) for u in rng.sample(urls, 9) if plain_priority(u) > 0), key=lambda x: -x[1])
    frame = spark.createDataFrame(rows, "page string, pos int, to string, url string, priority double")
    seed_rows = spark.createDataFrame([(s, k + 1, u, p) for s, us in seeds.items() for k, (u, p) in enumerate(us)], "site string, pos int, url string, priority double")
    got = ex.explored(spark.createDataFrame(list(starts.items()), "site string, url string"), frame, spark.createDataFrame([(x,) for x in lists], "page string"), seed_rows, budget=12, target=3).collect()
    for site, start in starts.items():
        mine = sorted((r for r in got if r["site"] == site), key=lambda r: r["nth"])
        want, more = plain_walk(start, links, lists, seeds[site], 12, 3)
        assert [(r["page"], r["found"]) for r in mine] == want and [r["nth"] for r in mine] == list(range(1, len(want) + 1))
        assert {r["more"] for r in mine} == {more}


def test_several_pages_a_round(spark):
    """Wider rounds keep to the budget and visit no page twice."""
    links = [(f"http://a.tw/p{i}", j, f"http://a.tw/p{3 * i + j}", f"http://a.tw/p{3 * i + j}", 1.0) for i in range(40) for j in range(1, 4)]
    got = ex.explored(spark.createDataFrame([("a.tw", "http://a.tw/p0")], "site string, url string"), spark.createDataFrame(links, "page string, pos int, to string, url string, priority double"), spark.createDataFrame([], "page string"), budget=17, width=5).collect()
    assert len(got) == 17 and len({r["page"] for r in got}) == 17 and sorted(r["nth"] for r in got) == list(range(1, 18)) and got[0]["more"]


def test_links_of_a_site(spark):
    html = '<a href="/Members/?a=1&amp;b=2#x">名錄</a><a href="http://www.a.tw/list/2/">L</a><a href="https://b.tw/x">out</a><a href="#p">p</a><a href="mailto:x@a.tw">m</a><a href="/x.pdf">pdf</a><a href="/login">in</a><a href="http://[bad">bad</a>'
    rows = spark.createDataFrame([("http://A.tw/dir/", html), ("http://a.tw/none", None)], "url string, html string")
    got = [(r["page"], r["to"], round(r["priority"], 2)) for r in ex.site_links(rows).orderBy("pos").collect()]
    assert got == [("http://a.tw/dir", "http://a.tw/Members?a=1&b=2", 6.0), ("http://a.tw/dir", "http://www.a.tw/list/2", 1.7)]
    assert "http://a.tw/x.pdf" in [r["to"] for r in ex.site_links(rows, (".pdf",)).collect()]
    for url, label in [("https://a.tw/a/b/c/company-list", "x"), ("https://a.tw/", "登入"), ("https://a.tw/a/b/c/d/e", ""), ("http://a.tw/q?search=1", "Members")]:
        one = spark.createDataFrame([(url, label)], "u string, l string").select(ex.priority_of("u", "l").alias("p"), ex.page_of("u").alias("k"), ex.list_of(ex.page_of("u")).alias("n")).first()
        assert abs(one["p"] - plain_priority(url, label)) < 1e-9 and one["k"] == plain_page(url) and one["n"] == plain_list(plain_page(url))


def test_sitemaps(spark):
    loc = lambda u: f"<url><loc> {u} </loc></url>"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>/s{k}.xml</loc></sitemap>" for k in range(7)) + "</sitemapindex>"
    many = "<urlset>" + "".join(loc(f"http://a.tw/{'members' if k % 3 == 0 else 'x'}/{k}?a=1&amp;b") for k in range(2500)) + "</urlset>"
    files = [("http://a.tw/sitemap.xml", index), ("http://a.tw/s0.xml", "<urlset>" + loc("http://a.tw/company/directory/list") + loc("http://b.tw/company") + loc("/list.pdf") + "</urlset>"), ("http://a.tw/s1.xml", many), ("http://a.tw/s6.xml", loc("http://a.tw/company/list/search"))]
    roots = spark.createDataFrame([("a.tw", 0, "http://a.tw/sitemap.xml"), ("a.tw", 9, "http://a.tw/s6.xml")], "site string, nth int, url string")
    got = ex.sitemap_seeds(roots, spark.createDataFrame(files, "url string, xml string")).orderBy("pos").collect()
    # 3 of the first file, then the first 1,997 of the second; the sixth nested file and the tenth announced one don't count.
    members = [urljoin("http://a.tw", f"/members/{k}?a=1&b") for k in range(1997) if k % 3 == 0]
    assert [r["url"] for r in got] == ["http://a.tw/company/directory/list", *members[:199]]
    assert [r["pos"] for r in got] == list(range(1, 201))
