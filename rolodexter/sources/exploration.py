"""Finding the listing pages of sites: a best-first walk of every site's links, all sites at once, in staged rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, unescaped
from ..operators.staging import stage
from .pages import anchors, resolved

#: Words of addresses and link texts that promise a directory, words that rule a page out, and endings of what is no page.
PROMISING = [
    "名錄", "會員", "廠商", "業者", "供應商", "廠商名錄", "會員名錄", "會員廠商", "公司", "企業", "工廠", "商家", "店家", "目錄", "清冊", "查詢", "搜尋",
    "directory", "member", "members", "company", "companies", "supplier", "suppliers", "vendor", "firm", "list", "search", "query", "catalog",
]
UNPROMISING = [
    "login", "logout", "signin", "signup", "register", "cart", "checkout", "privacy", "terms", "sitemap", "rss", "feed", "comment", "print",
    "登入", "登出", "註冊", "隱私", "條款", "購物車", "留言", "列印",
]
NO_PAGES = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".mp4", ".mp3",
    ".css", ".js", ".json", ".xml", ".csv", ".txt", ".exe", ".dmg",
]
PAGE_BUDGET, TARGET, SITEMAP_ADDRESSES, SITEMAP_SEEDS, SITEMAP_FILES = 30, 5, 2000, 200, 5
START = 1000.0

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column | str, k: int) -> Column:
    return F.regexp_extract(col(url), _PARTS, k)


def page_of(url: Column | str) -> Column:
    """An address as one page is known by: no place in the page, no last slash, host in lower case."""
    path, query = F.regexp_replace(_part(url, 3), "/+$", ""), _part(url, 4)
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def site_of(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def list_of(page: Column | str) -> Column:
    """What the pages of one list share: the address with numbers of path and query as #."""
    number = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    return F.concat(F.lower(_part(page, 2)), number(_part(page, 3)), F.lit("?"), number(_part(page, 4)))


def priority_of(url: Column | str, label: Column | str) -> Column:
    """Two for each promising word of path, query and link text, less 0.3 for each level, 0 at least; -1 with an unpromising word."""
    said = F.lower(F.concat_ws(" ", _part(url, 3), _part(url, 4), col(label)))
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(said, w)))
    depth = F.length(F.regexp_replace(F.regexp_replace(_part(url, 3), "^/+|/+$", ""), "[^/]", ""))
    return F.when(hits(UNPROMISING) > 0, F.lit(-1.0)).otherwise(F.greatest(F.lit(0.0), hits(PROMISING) * 2.0 - depth * F.lit(0.3)))


def is_page(url: Column | str, kinds: tuple[str, ...] = ()) -> Column:
    """Whether an address is a page, or a file of one of the wanted kinds (endings)."""
    path = F.lower(_part(url, 3))
    ends = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: path.endswith(w))
    return ~ends(NO_PAGES) | (ends(list(kinds)) if kinds else F.lit(False))


def site_links(pages: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(page, pos, to, url, priority) of the links of each page (url, html) that stay on its site and may be walked."""
    numbered = pages.select(F.monotonically_increasing_id().alias("page_id"), "url", "html")
    numbered = stage(numbered, "pages")
    found = anchors(numbered).filter("href <> '' and not lower(href) rlike '^(#|mailto:|tel:|javascript:)'").join(numbered.select("page_id", F.col("url").alias("base")), "page_id")
    linked = found.select("base", "pos", "label", resolved("base", "href").alias("url")).filter("url is not null")
    fit = linked.filter((site_of("url") == site_of("base")) & is_page("url", kinds))
    return fit.select(page_of("base").alias("page"), "pos", page_of("url").alias("to"), "url", priority_of("url", F.substring("label", 1, 60)).alias("priority")).filter("priority >= 0")


def sitemap_addresses(files: DataFrame) -> DataFrame:
    """(url, nested, pos, address) of each file (url, xml): the addresses that a sitemap names, and whether they are of further sitemaps."""
    loc = F.lit(r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>")
    inner = F.array_join(F.regexp_extract_all("xml", F.lit(r"(?is)(<sitemap\b[^>]*>.*?</sitemap\s*>)"), F.lit(1)), " ")
    outer = F.regexp_replace("xml", r"(?is)<sitemap\b[^>]*>.*?</sitemap\s*>", " ")
    both = F.array(F.struct(F.lit(False).alias("nested"), F.regexp_extract_all(outer, loc, F.lit(1)).alias("found")), F.struct(F.lit(True).alias("nested"), F.regexp_extract_all(inner, loc, F.lit(1)).alias("found")))
    one = files.select("url", F.inline(both)).select("url", "nested", F.posexplode("found").alias("pos", "address"))
    return one.select("url", "nested", "pos", resolved("url", unescaped("address")).alias("address")).filter("address is not null")


def sitemap_seeds(roots: DataFrame, files: DataFrame, levels: int = 2) -> DataFrame:
    """(site, pos, url, priority): where sitemaps (url, xml) say that a site's directories may be: of the first 2,000 addresses the 200 of highest priority above 0.

    roots: (site, nth, url) of the sitemaps a site announces, of which the first five count; of the sitemaps that one names again the first five, one level down.
    """
    known = stage(sitemap_addresses(files), "sitemaps")
    at = roots.filter(F.col("nth") < SITEMAP_FILES).select("site", F.col("nth").cast("long").alias("rank"), "url").dropDuplicates(["site", "url"])
    read = None
    for _ in range(levels):
        named = at.join(known, "url")
        read = named.filter("not nested") if read is None else read.unionByName(named.filter("not nested"))
        # Sitemaps found in a round come after all of the round before.
        at = named.filter("nested").filter(F.col("pos") < SITEMAP_FILES).groupBy("site", F.col("address").alias("url")).agg(F.min((F.col("rank") + 1) * 1000 + F.col("pos")).alias("rank"))
    w = Window.partitionBy("site").orderBy("rank", "pos")
    first = read.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= SITEMAP_ADDRESSES)
    fit = first.filter((site_of("address") == F.col("site")) & is_page("address")).select("site", F.col("address").alias("url"), "nth", priority_of("address", F.lit("")).alias("priority")).filter("priority > 0")
    best = Window.partitionBy("site").orderBy(F.desc("priority"), "nth")
    return fit.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= SITEMAP_SEEDS).select("site", "pos", "url", "priority")


def explored(starts: DataFrame, links: DataFrame, lists: DataFrame, seeds: DataFrame | None = None, budget: int = PAGE_BUDGET, target: int = TARGET, width: int = 1) -> DataFrame:
    """(site, nth, url, page, priority, found, more): the pages that are visited of each site, in order.

    A round visits the ``width`` most promising pages of every site that is not done; with 1 each site is walked best first, ties in the order in which links were seen. A page
    that is a list (lists: page) is found, its links are not followed, and other pages of its list are not visited. Other pages add their links (of site_links()) that are
    new; in one round of several pages, pages of one list may be visited together. A site is done after ``budget`` pages, ``target`` lists, or when nothing is left; more says that the budget ended it. starts: (site, url), one for each site. Pages that could not be read simply have no links.
    Every round is staged; rounds are bounded by the budget, not by links.
    """
    empty_seeds = "site string, pos int, url string, priority double"
    seeds = seeds if seeds is not None else starts.sparkSession.createDataFrame([], empty_seeds)
    entry = lambda df, rnd, nth, pos: df.select("site", "url", page_of("url").alias("page"), "priority", F.struct(rnd.cast("int").alias("round"), nth.cast("int").alias("nth"), pos.cast("int").alias("pos")).alias("since"))
    frontier = entry(starts.withColumn("priority", F.lit(START)), F.lit(0), F.lit(0), F.lit(0)).unionByName(entry(seeds, F.lit(0), F.lit(1), F.col("pos")))
    frontier, is_list, at = stage(frontier, "frontier"), lists.select("page").distinct(), 1
    visited = None
    while True:
        # One entry for each page, its best; so a page that many link to is one row.
        best = frontier.groupBy("site", "page").agg(F.min(F.struct((-F.col("priority")).alias("low"), "since", "url")).alias("b"))
        order = Window.partitionBy("site").orderBy("b.low", "b.since")
        picks = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= width)
        if visited is not None:
            so_far = visited.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"))
            picks = picks.join(so_far, "site", "left").filter((F.coalesce("n", F.lit(0)) + F.col("place") <= budget) & (F.coalesce("n_found", F.lit(0)) < target))
        else:
            picks = picks.withColumn("n", F.lit(0).cast("long")).filter(F.col("place") <= budget)
        picks = picks.select("site", (F.coalesce("n", F.lit(0)) + F.col("place")).cast("int").alias("nth"), "b.url", "page", (-F.col("b.low")).alias("priority"))
        picks = stage(picks.join(is_list.withColumn("found", F.lit(True)), "page", "left").withColumn("found", F.coalesce("found", F.lit(False))), "picks")
        if picks.isEmpty():
            break
        visited = picks if visited is None else visited.unionByName(picks)
        alive = frontier.join(picks.select("site", "page"), ["site", "page"], "left_anti")
        taken = picks.filter("found").select("site", list_of("page").alias("of_list")).distinct()
        all_taken = visited.filter("found").select("site", list_of("page").alias("of_list")).distinct()
        alive = alive.withColumn("of_list", list_of("page")).join(taken, ["site", "of_list"], "left_anti").drop("of_list")
        fresh = picks.filter("not found").select("site", "nth", "page").join(links, "page").select("site", F.col("to").alias("page"), "url", "priority", F.struct(F.lit(at).alias("round"), F.col("nth"), F.col("pos").cast("int").alias("pos")).alias("since"))
        fresh = fresh.join(visited.select("site", "page"), ["site", "page"], "left_anti").withColumn("of_list", list_of("page")).join(all_taken, ["site", "of_list"], "left_anti").drop("of_list")
        frontier = stage(alive.unionByName(fresh.select(*alive.columns)), "frontier")
        at += 1
    left = frontier.select("site").distinct().withColumn("left", F.lit(True))
    if visited is None:
        return picks.withColumn("more", F.lit(False)).select("site", "nth", "url", "page", "priority", "found", "more")
    total = visited.groupBy("site").agg(F.count(F.lit(1)).alias("total")).join(left, "site", "left").select("site", ((F.col("total") >= budget) & F.col("left").isNotNull()).alias("more"))
    return visited.join(total, "site").select("site", "nth", "url", "page", "priority", "found", "more")
