"""Runs over pages that fail, are killed, cancelled or stopped, against one batch over the same records."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rolodexter.streaming.store import Store, store_of_one_batch

SCHEMA = "key string, seq long, page string, name string, phone string, url string"


def write_pages(spark, folder, sizes, seed=1):
    """A file for each page, in order of time; a page of size 0 is an empty file."""
    rng = random.Random(seed)
    folder.mkdir()
    for p, size in enumerate(sizes):
        rows = [(f"k{rng.randint(0, 9)}" if rng.random() < 0.9 else rng.choice([None, " "]), p * 100 + i, f"p{p}", f"n{p}-{i}" if rng.random() < 0.5 else " ", f"t{p}-{i}" if rng.random() < 0.3 else None, f"u{p}-{i}" if rng.random() < 0.8 else "") for i in range(size)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"tmp{p}"))
        (file,) = (folder / f"tmp{p}").glob("*.parquet")
        file.rename(folder / f"p{p}.parquet")
        for x in (folder / f"tmp{p}").iterdir():
            x.unlink()
        (folder / f"tmp{p}").rmdir()
        os.utime(folder / f"p{p}.parquet", (10_000 + p, 10_000 + p))


def parts(spark, tmp_path):
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    return Store(spark, f"file://{tmp_path}/store", ["name", "phone"], ["url"]), stream


def rows_of(df, *less):
    return sorted(tuple(r) for r in df.drop(*less).collect())


def whole(spark, tmp_path, upto=99):
    return store_of_one_batch(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").filter(F.col("seq") < upto * 100), "key", ["name", "phone"], ["url"])


def test_a_failed_run_goes_on(spark, tmp_path):
    write_pages(spark, tmp_path / "in", [20, 15, 25, 10])
    store, stream = parts(spark, tmp_path)

    def fail(batch):
        if batch == 2:
            raise RuntimeError("lost")

    first = store.ingest("a", stream(), "key", before_commit=fail)
    assert first.status == "failed" and first.pages == 2 and store.marker("a") == first.run and "lost" in first.error
    second = store.ingest("a", stream(), "key")
    assert (second.status, second.resumed, second.run, second.pages) == ("success", True, first.run, 2) and store.marker("a") is None
    assert rows_of(store.rows()) == rows_of(whole(spark, tmp_path))
    assert rows_of(store.progress(first.run).select("batch", "page", "upto")) == [(b, "a", b) for b in range(4)]
    assert first.added + second.added == store.rows().count()


def test_a_killed_process_goes_on(spark, tmp_path):
    """The process dies when a batch is written and not committed yet; another one finds the store as one batch leaves it."""
    write_pages(spark, tmp_path / "in", [20, 15, 25])
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from rolodexter.streaming.store import Store
store = Store(spark, "file://{tmp_path}/store", ["name", "phone"], ["url"])
pages = spark.readStream.schema({SCHEMA!r}).option("maxFilesPerTrigger", 1).parquet("file://{tmp_path}/in")
store.ingest("a", pages, "key", before_commit=lambda b: os._exit(7) if b == 1 else None)
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, timeout=300)
    assert done.returncode == 7
    store, stream = parts(spark, tmp_path)
    assert store.marker("a") is not None
    summary = store.ingest("a", stream(), "key")
    assert (summary.status, summary.resumed, summary.pages) == ("success", True, 2)
    assert rows_of(store.rows()) == rows_of(whole(spark, tmp_path))


def test_cancelled_runs_start_anew(spark, tmp_path):
    write_pages(spark, tmp_path / "in", [12, 12, 12])
    store, stream = parts(spark, tmp_path)
    seen = []
    first = store.ingest("a", stream(), "key", before_commit=seen.append, cancelled=lambda: len(seen) >= 1)
    assert (first.status, first.pages) == ("cancelled", 1) and store.marker("a") is None
    assert rows_of(store.rows()) == rows_of(whole(spark, tmp_path, 1))
    second = store.ingest("a", stream(), "key")
    assert (second.status, second.resumed, second.pages) == ("success", False, 3) and second.run > first.run
    assert rows_of(store.rows(), "records") == rows_of(whole(spark, tmp_path), "records")  # the first page's records are merged again and fill nothing


@pytest.mark.parametrize("sizes, options, pages", [([10, 0, 10], {}, 2), ([10, 0, 10], {"stop_on_empty": False}, 3), ([10, 10, 10, 10], {"budget": 2}, 2)])
def test_runs_stop(spark, tmp_path, sizes, options, pages):
    write_pages(spark, tmp_path / "in", sizes)
    store, stream = parts(spark, tmp_path)
    got = store.ingest("a", stream(), "key", **options)
    assert (got.status, got.pages) == ("success", pages) and store.marker("a") is None
    assert rows_of(store.rows()) == rows_of(whole(spark, tmp_path, pages))


def test_known_records_change_nothing(spark, tmp_path):
    """Known is what the store held when the run began: records of one run still merge."""
    write_pages(spark, tmp_path / "in", [10])
    store, stream = parts(spark, tmp_path)
    store.ingest("a", stream(), "key")
    before = rows_of(store.rows())
    write_pages(spark, tmp_path / "more", [0, 30, 30], seed=2)
    again = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/more")
    got = store.ingest("b", again, "key", stop_on_empty=False, skip_known=True)
    after = rows_of(store.rows())
    assert set(before) < set(after) and got.merged > 0
    known = [r[0] for r in before]
    fresh = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/more").filter(~F.col("key").isin(known) | F.col("key").isNull())
    assert sorted(set(after) - set(before)) == rows_of(store_of_one_batch(fresh, "key", ["name", "phone"], ["url"]))
    assert store.clear() in (0, 1)
