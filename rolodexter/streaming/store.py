"""A store of merged records that runs over pages keep up to date: keyed state, progress committed with the data, runs that go on after a failure."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import blank_to_null

# Spark plans stateful operators in a Python process of its own, which does not see the package's path: the class goes there by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _filled(x) -> bool:
    return x is not None and str(x).strip() != ""


class Merge(StatefulProcessor):
    """A key's row: the first value of each field to fill, the last of each to replace, and how many records went into it.

    Rows of a batch may come in any order, since each field is told by seq; memory is one row. What the state holds was there before.
    """

    def __init__(self, fill: Sequence[str], latest: Sequence[str]):
        self.fill, self.latest = list(fill), list(latest)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in [*self.fill, *self.latest]] + [T.StructField("records", T.LongType())])

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", self.schema())

    def handleInitialState(self, key, rows, timerValues) -> None:  # noqa: N802
        row = rows.asDict()
        self.held.update(tuple(row[c] for c in [*self.fill, *self.latest, "records"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        first: dict[str, tuple] = {}
        last: dict[str, tuple] = {}
        n = 0
        for r in rows:
            n += 1
            for c in self.fill:
                if _filled(r[c]) and (c not in first or r["seq"] < first[c][0]):
                    first[c] = (r["seq"], r[c])
            for c in self.latest:
                if _filled(r[c]) and (c not in last or r["seq"] >= last[c][0]):
                    last[c] = (r["seq"], r[c])
        old = self.held.get() if self.held.exists() else None
        old = dict(zip([*self.fill, *self.latest, "records"], old, strict=True)) if old is not None else {}
        new = {c: old[c] if _filled(old.get(c)) else first.get(c, (0, None))[1] for c in self.fill}
        new |= {c: last[c][1] if c in last else old.get(c) for c in self.latest}
        new["records"] = (old.get("records") or 0) + n
        self.held.update(tuple(new.values()))
        yield Row(key=key[0], **new, added=not old, n=n)

    def close(self) -> None:
        pass


@dataclass
class Summary:
    """What a run did: status is success, cancelled or failed."""

    run: str
    resumed: bool
    status: str = "running"
    pages: int = 0
    found: int = 0
    added: int = 0
    merged: int = 0
    error: str = ""


class _Done(Exception):
    """Ends a query before the next page is worked on."""


@dataclass
class Store:
    """A folder, shared by driver and executors, with a table of batches and a marker for each source whose run did not end.

    A batch's rows and its progress (page, and the last record's seq) are one write into a folder named by run and batch, so that neither is there without the other; a batch that is run
    again after a failure replaces itself. A marker names the run that goes on: kept when a run fails or is killed, cleared when it succeeds or is cancelled.
    """

    spark: SparkSession
    root: str
    fill: Sequence[str]
    latest: Sequence[str] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.fill, *self.latest]

    def _path(self, name: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(conf), path

    def marker(self, source: str) -> str | None:
        """The run of a source that did not end."""
        fs, path = self._path(f"markers/{source}")
        if not fs.exists(path):
            return None
        return self.spark.read.text(path.toString(), wholetext=True).first()[0].strip()

    def clear(self, source: str | None = None) -> int:
        """Forgets that a run did not end: of one source or of all. How many were cleared."""
        fs, path = self._path(f"markers/{source}" if source else "markers")
        if not fs.exists(path):
            return 0
        n = 1 if source else len(fs.listStatus(path))
        fs.delete(path, True)
        return n

    def _mark(self, source: str, run: str) -> None:
        fs, path = self._path(f"markers/{source}")
        out = fs.create(path, True)
        out.write(bytearray(run, "utf-8"))
        out.close()

    def batches(self) -> DataFrame:
        """All rows of committed batches: key, columns, records, added, n, run, batch, started; progress rows have a null key."""
        kinds = {"key": "string", **dict.fromkeys(self.columns, "string"), "records": "long", "added": "boolean", "n": "long", "page": "string", "upto": "long", "run": "string", "batch": "long"}
        fs, path = self._path("batches")
        schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
        done = [f.getPath().toString() for f in fs.globStatus(self._path("batches/*/*/_SUCCESS")[1])] if fs.exists(path) else []
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(d.removesuffix("/_SUCCESS") for d in done))

    def rows(self) -> DataFrame:
        """The store: of each key its row after the last batch that touched it. Runs are named in order."""
        best = F.max(F.struct("run", "batch", *self.columns, "records")).alias("b")
        return self.batches().filter("key is not null").groupBy("key").agg(best).select("key", *(F.col(f"b.{c}").alias(c) for c in [*self.columns, "records"]))

    def progress(self, run: str) -> DataFrame:
        """(batch, page, upto, n): what a run has committed."""
        return self.batches().filter((F.col("run") == run) & F.col("key").isNull()).select("batch", "page", "upto", "n")

    def ingest(self, source: str, pages: DataFrame, key: str, budget: int | None = None, stop_on_empty: bool = True, skip_known: bool = False, cancelled: Callable[[], bool] = lambda: False, before_commit: Callable[[int], None] = lambda batch: None) -> Summary:
        """Works through a stream of pages, one micro-batch each (maxFilesPerTrigger 1), and merges their records into the store.

        pages: a stream with key, seq, page and the columns. The run ends when nothing is left, on an empty page, after ``budget`` pages, or when ``cancelled`` says so; it goes on with
        the run that the marker names, else a new one starts from the store's rows as its first state. skip_known: records whose key the store held when the run began change nothing.
        before_commit is called when a batch is written but not committed by Spark yet.
        """
        run = self.marker(source)
        summary = Summary(run or f"{self._next():08d}-{uuid.uuid4().hex[:8]}", run is not None)
        self._mark(source, summary.run)
        work = f"{self.root}/runs/{summary.run}"
        held = f"{work}/held"
        fs, path = self._path(f"runs/{summary.run}/held/_SUCCESS")
        if not fs.exists(path):  # frozen: what the store holds when the run begins
            self.rows().write.mode("overwrite").parquet(held)
        start = self.spark.read.parquet(held)
        records = pages.filter(blank_to_null(F.col(key)).isNotNull()).select(F.col(key).alias("key"), "seq", *self.columns)
        if skip_known:
            records = records.join(start.select("key"), "key", "left_anti")
        merge = Merge(self.fill, self.latest)
        out = T.StructType([T.StructField("key", T.StringType()), *merge.schema().fields, T.StructField("added", T.BooleanType()), T.StructField("n", T.LongType())])
        states = records.groupBy("key").transformWithState(merge, out, "Update", "None", initialState=start.select("key", *self.columns, "records").groupBy("key"))
        stopping: list[str] = []

        def write(batch: DataFrame, batch_id: int) -> None:
            if stopping or cancelled():
                raise _Done(stopping[0] if stopping else "cancelled")
            rows = batch.withColumns({"page": F.lit(None).cast("string"), "upto": F.lit(None).cast("long")})
            target = f"{self.root}/batches/{summary.run}/{batch_id:08d}"
            said = batch.sparkSession.createDataFrame([(batch_id,)], "upto long").select(F.lit(None).cast("string").alias("key"), *(F.lit(None).cast("string").alias(c) for c in self.columns), F.lit(None).cast("long").alias("records"), F.lit(None).cast("boolean").alias("added"), F.lit(None).cast("long").alias("n"), F.lit(source).alias("page"), "upto")
            both = rows.select("key", *self.columns, "records", "added", "n", "page", "upto").unionByName(said)
            both.withColumns({"run": F.lit(summary.run), "batch": F.lit(batch_id).cast("long")}).write.mode("overwrite").parquet(target)
            done = batch.sparkSession.read.parquet(target).filter("key is not null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("added"), F.coalesce(F.sum(F.when(F.col("added"), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0))).first()
            before_commit(batch_id)
            summary.pages += 1
            summary.found += done[0]
            summary.added += done[1]
            summary.merged += done[2]
            if stop_on_empty and not done[0]:
                stopping.append("empty page")
            if budget is not None and summary.pages >= budget:
                stopping.append("budget")

        old = {k: self.spark.conf.get(k, None) for k in STATE_STORE}
        for k, v in STATE_STORE.items():
            self.spark.conf.set(k, v)
        try:
            states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            summary.status = "success"
        except Exception as e:
            # What ends a query comes back as text of the streaming engine; only our own marks count.
            if stopping:
                summary.status = "success"
            elif cancelled():
                summary.status = "cancelled"
            else:
                summary.status, summary.error = "failed", str(e)[:2000]
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        if summary.status != "failed":
            self.clear(source)
        return summary

    def _next(self) -> int:
        fs, path = self._path("runs")
        return len(fs.listStatus(path)) if fs.exists(path) else 0


def store_of_one_batch(records: DataFrame, key: str, fill: Sequence[str], latest: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """What Store.rows() is after any run over the records: the first filled value of fields to fill, the last of fields to replace, by order."""
    at = F.struct(*order)
    named = records.filter(blank_to_null(F.col(key)).isNotNull())
    given = lambda c: F.when(blank_to_null(c).isNotNull(), at)
    return named.groupBy(F.col(key).alias("key")).agg(*(F.min_by(c, given(c)).alias(c) for c in fill), *(F.max_by(c, given(c)).alias(c) for c in latest), F.count(F.lit(1)).alias("records"))
