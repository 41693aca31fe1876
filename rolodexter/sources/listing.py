"""Listings as a Spark data source: ``spark.read.format("listing")`` over pages that were fetched, and ``format("listing_fixture")`` over a folder of page files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import fixed
from ..plans.ship import ship
from .extraction import Page, Rule, selected, value_of

#: Fixed columns before those of the rules.
ABOUT = [T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("source_url", T.StringType()), T.StructField("item", T.IntegerType())]
DEFAULTS = {"pagination": "none", "page_start": "1", "page_limit": "100", "pages_each": "8", "source": "listing", "harvest": "true"}


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and their code to its executors; Python sources may then be given filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Listing, ListingFixture):
        spark.dataSource.register(source)


def rules_of(said: str) -> dict[str, Rule]:
    """Rules from JSON: a selector, or an object of Rule's fields, for each column."""
    told = json.loads(said)
    if not isinstance(told, dict) or not told:
        raise ValueError("fields: an object of rules by column")
    return {name: Rule(r) if isinstance(r, str) else Rule(**r) for name, r in told.items()}


@dataclass
class Chunk(InputPartition):
    """Pages of a listing, by number and address; of a listing that goes on by links only the first."""

    def __init__(self, pages: list[tuple[int, str]]):
        self.pages = pages


def _items(html: str, about: tuple, item: str, rules: dict[str, Rule], harvest: bool) -> Iterator[tuple]:
    """The records of one page; without a name there is none. harvest: a blank email or phone is looked for in the item's links and text."""
    page = Page(html)
    names = list(rules)
    for k, scope in enumerate(selected(page, item)):
        values = {n: value_of(page, scope, r) for n, r in rules.items()}
        if harvest:
            inside = range(scope, page.nodes[scope][7] + 1)
            linked = lambda kind: [page.attributes[n]["href"][len(kind) + 1 :].split("?")[0] for n in inside if page.attributes[n].get("href", "").lower().startswith(kind + ":")]  # noqa: E731, B023
            if "email" in values and not values["email"]:
                values["email"] = next(iter([x.strip().lower() for x in linked("mailto") if x.strip()] + [m[0].lower() for m in re.finditer(fixed.EMAIL_IN_TEXT, page.text(scope))]), None)
            if "phone" in values and not values["phone"]:
                values["phone"] = next(iter([x.strip() for x in linked("tel") if x.strip()] + [m[0].strip() for m in re.finditer(fixed.PHONE_WITH_EXTENSION, page.text(scope))]), None)
        if any(values.values()) and ("company_name" not in values or values["company_name"]):
            yield (*about, k, *(values[n] for n in names))


class ListingReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in DEFAULTS.items()} | {k.lower(): v for k, v in options.items()}
        for needed in ("path", "list_selector", "fields"):
            if not self.options.get(needed):
                raise ValueError(f"option {needed} is missing")
        if self.options["pagination"] not in ("none", "query", "next_link"):
            raise ValueError("pagination: none, query or next_link")
        self.rules = rules_of(self.options["fields"])
        self.wanted = [f.name for f in schema.fields]
        self.least, self.most, self.among = int(self.options["page_start"]), None, None
        if self.options.get("page_end"):
            self.most = int(self.options["page_end"])
        self.asked = self.least

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Pages that a filter rules out are not read. Filters on page hold exactly; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page",):
                yield f
            elif isinstance(f, EqualTo):
                self._narrow(f.value, f.value)
            elif isinstance(f, GreaterThan):
                self._narrow(f.value + 1, None)
            elif isinstance(f, GreaterThanOrEqual):
                self._narrow(f.value, None)
            elif isinstance(f, LessThan):
                self._narrow(None, f.value - 1)
            elif isinstance(f, LessThanOrEqual):
                self._narrow(None, f.value)
            elif isinstance(f, In):
                self.among = set(f.value) if self.among is None else self.among & set(f.value)
            else:
                yield f

    def _narrow(self, least: int | None, most: int | None) -> None:
        if least is not None:
            self.asked = max(self.asked, least)
        if most is not None:
            self.most = most if self.most is None else min(self.most, most)

    def _last(self) -> int:
        """The last page that limit, end and filters leave; the limit counts from the first page of the listing, not of the filters."""
        last = self.least + int(self.options["page_limit"]) - 1
        return last if self.most is None else min(last, self.most)

    def _serves(self, page: int) -> bool:
        return page >= self.asked and (self.among is None or page in self.among)

    def address(self, page: int) -> str:
        url = self.options.get("page_url") or self.options.get("start_url") or ""
        return url.replace("{page}", str(page))

    def partitions(self) -> list[InputPartition]:
        if self.options["pagination"] == "query":
            pages = [(p, self.address(p)) for p in range(self.least, self._last() + 1) if self._serves(p)]
            each = int(self.options["pages_each"])
            return [Chunk(pages[k : k + each]) for k in range(0, len(pages), each)] or [Chunk([])]
        starts = [u for u in (self.options.get("start_url") or "").split() if u]
        return [Chunk([(1, u)]) for u in starts] or [Chunk([])]

    def fetched(self, urls: list[str]) -> dict[str, str]:
        """The pages of addresses in the table of fetched pages (columns url and html); an address that it lacks has none."""
        store, at = pa.fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (pa.fs.LocalFileSystem(), self.options["path"].removeprefix("file:"))
        rows = pa.dataset.dataset(at, filesystem=store, format="parquet").to_table(["url", "html"], filter=pa.dataset.field("url").isin(pa.array(urls, pa.string())))
        return dict(zip(rows["url"].to_pylist(), rows["html"].to_pylist(), strict=True))

    def read(self, partition: Chunk) -> Iterator[tuple]:
        item, harvest, label = self.options["list_selector"], self.options["harvest"].lower() == "true", self.options["source"]
        at = [ABOUT[k].name for k in range(4)] + list(self.rules)
        order = [at.index(n) for n in self.wanted]

        def rows(page: int, url: str, html: str | None) -> Iterator[tuple]:
            for row in _items(html or "", (label, page, url), item, self.rules, harvest):
                yield tuple(row[k] for k in order)

        if self.options["pagination"] != "next_link":
            found = self.fetched([u for _, u in partition.pages])
            for page, url in partition.pages:
                if self._serves(page) and url in found:
                    yield from rows(page, url, found[url])
            return
        for _, start in partition.pages:  # page 5 is where four links lead to: earlier ones are walked and not collected
            url, seen, page = start, set(), 1
            while url and url not in seen and page <= self._last():
                seen.add(url)
                html = self.fetched([url]).get(url)
                if html is None:
                    break
                if self._serves(page):
                    yield from rows(page, url, html)
                tree = Page(html)
                links = selected(tree, self.options.get("next_selector", "a.next"))
                href = tree.attributes[links[0]].get("href", "").strip() if links else ""
                url = urljoin(url, href) if href and not href.startswith("#") else ""
                page += 1


class Listing(DataSource):
    """Records of a paginated listing, out of fetched pages.

    Options: path of the table of fetched pages; list_selector; fields, JSON of rules by column; pagination none, query (page_url with {page}, chunks of pages_each pages in
    parallel) or next_link (next_selector; several start_url, by blanks, are walked in parallel); page_start, page_end, page_limit; source; harvest.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> T.StructType:
        return T.StructType([*ABOUT, *(T.StructField(n, T.StringType()) for n in rules_of(self.options.get("fields") or "{}"))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ListingReader(schema, dict(self.options))


class FixtureReader(ListingReader):
    def _files(self) -> list[str]:
        store, at = pa.fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (pa.fs.LocalFileSystem(), self.options["path"])
        found = store.get_file_info(pa.fs.FileSelector(at))
        number = lambda f: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", f.base_name)]
        return [f.path for f in sorted((f for f in found if f.extension in ("html", "htm")), key=number)]

    def partitions(self) -> list[InputPartition]:
        pages = [(p, f) for p, f in enumerate(self._files(), 1) if self.least <= p <= self._last() and self._serves(p)]
        return [Chunk([x]) for x in pages] or [Chunk([])]

    def fetched(self, urls: list[str]) -> dict[str, str]:
        store = pa.fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else pa.fs.LocalFileSystem()
        out = {}
        for u in urls:
            with store.open_input_file(u) as f:
                out[u] = f.read().decode("utf-8", "replace")
        return out


class ListingFixture(Listing):
    """Records of a folder of page files, one page each in the order of their numbers. Options: path, list_selector, fields, page_start, page_end, page_limit, source, harvest."""

    @classmethod
    def name(cls) -> str:
        return "listing_fixture"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FixtureReader(schema, dict(self.options) | {"pagination": "none"})
