"""Every registered query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from rolodexter.plans import queries as plans


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return round(float(v), 6) if isinstance(v, Decimal) else v


def table(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = table(got.columns, got.collect(), cols)
    if name not in plans.SQL:
        assert rows
        return
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert rows == table(names, want.fetchall(), cols)


def test_upsert_sequential_takes_every_customer(spark, sf_dir, duck):
    """By brute force: the odd customers of a name key go into its first even one, in order of their keys."""
    people = duck.execute("SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey").fetchall()
    store, by_key, new = [], {}, []
    for parity in (0, 1):
        for k, name, segment in people:
            if k % 2 != parity:
                continue
            email = f"{name}@b.tw".lower() if k % 3 == 0 else None
            row = by_key.get(name[-6:-1]) if parity else None
            if row is None:
                row = {"id": None if parity else k, "name": name.lower() if parity else name, "url": segment, "email": email, "merged": 0}
                (new if parity else store).append(row)
                by_key.setdefault(name[-6:-1], row)
            else:
                row |= {"merged": row["merged"] + 1, "url": segment or row["url"], "email": row["email"] or email}
    got = plans.QUERIES["upsert_sequential"](spark, sf_dir).collect()
    want = sorted((r["name"], r["id"], r["url"], r["email"], r["merged"]) for r in store + new)
    assert sorted((r["company_name"], r["id"], r["source_url"], r["email"], r["merged"]) for r in got) == want
    assert sum(1 + r["merged"] for r in got) == len(people)


def test_upsert_with_maps_and_contacts(spark, sf_dir):
    """The query against a replay in Python, one record after another."""
    from test_operators import plain_upsert, shown

    from rolodexter.operators import sequential
    from rolodexter.plans import works
    from rolodexter.plans.registry import table as read

    store, batch = (sequential.complete(x) for x in works.people(lambda name: read(spark, sf_dir, name)))
    rows = lambda df, by: [r.asDict() for r in df.orderBy(by).collect()]
    got = plans.QUERIES["upsert_with_maps_and_contacts"](spark, sf_dir).collect()
    want = plain_upsert(rows(store, "id"), rows(batch, "seq"))
    assert shown(r.asDict() for r in got) == shown(want) and len(want) < len(rows(store, "id")) + len(rows(batch, "seq"))


def test_site_exploration_walks_like_a_queue(spark, sf_dir):
    from collections import defaultdict

    from test_exploration import plain_walk

    from rolodexter.plans import works
    from rolodexter.plans.registry import table as read

    starts, links, lists = works.sites(lambda name: read(spark, sf_dir, name))
    by_page = defaultdict(list)
    for r in links.orderBy("page", "pos").collect():
        by_page[r["page"]].append((r["url"], r["priority"]))
    listed = {r["page"] for r in lists.collect()}
    got = plans.QUERIES["site_exploration"](spark, sf_dir).collect()
    for s in starts.collect():
        walk, more = plain_walk(s["url"], by_page, listed, [], 12, 3)
        mine = sorted((r["nth"], r["page"], r["found"], r["more"]) for r in got if r["site"] == s["site"])
        assert mine == [(k, page, found, more) for k, (page, found) in enumerate(walk, 1)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_folders(tmp_path):
    """The rest imports and answers when llm and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "rolodexter", tmp_path / "rolodexter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 50
