"""A batch merged into a store record after record, where each sees what those before it changed."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .connected import clusters
from .joins import Within, part_matches
from .staging import stage

KEYS = ["dedupe_key", "tax_id", "email", "name_key"]
FILLED = ["tax_id", "email", "phone", "website", "address", "industry", "english_name", "fax", "products", "contact_person"]
#: Columns of store and batch; ids of the store are positive, new rows get none. extra is filled key by key; contacts are the persons of a company.
CONTACTS = "array<struct<name:string,email:string,phone:string,is_primary:boolean>>"
COLUMNS = (
    "id long, seq long, company_name string, name_key string, dedupe_key string, host string, source_url string, " + ", ".join(f"{c} string" for c in FILLED)
    + f", extra map<string,string>, email_verdict string, contacts {CONTACTS}"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Records of one connected set that a round replays, and rows that a task replays.
SLICE_ROWS, TASK_ROWS = 20_000, 50_000


def complete(df: DataFrame) -> DataFrame:
    """df with all of COLUMNS, null where it has none."""
    types = dict(c.split() for c in COLUMNS.split(", "))
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in NAMES))


def _filled(x) -> bool:
    return x is not None and x == x and str(x).strip() != ""


class _Store:
    """Rows in order, found by their signals through indexes: each value's first row that has it."""

    def __init__(self):
        self.rows: list[dict] = []
        self.first: dict[tuple, int] = {}
        self.hosts: dict[str, list[int]] = defaultdict(list)

    def index(self, at: int) -> None:
        row = self.rows[at]
        for c in KEYS[:3]:
            if row[c] is not None:
                self._set((c, row[c]), at)
        if row["name_key"] is not None and row["phone"] is not None:
            self._set(("phone", row["name_key"], row["phone"]), at)
        if row["name_key"] is not None and row["website"] is not None and at not in self.hosts[row["name_key"]]:
            self.hosts[row["name_key"]].append(at)

    def _set(self, key: tuple, at: int) -> None:
        if at < self.first.get(key, at + 1):
            self.first[key] = at

    def find(self, r: dict) -> int | None:
        """The row that a record means: by the strongest signal that finds one, of several the first."""
        for c in KEYS[:3]:
            if r[c] is not None and (c, r[c]) in self.first:
                return self.first[c, r[c]]
        name = r["name_key"]
        if name is None:
            return None
        if r["phone"] is not None and ("phone", name, r["phone"]) in self.first:
            return self.first["phone", name, r["phone"]]
        if r["host"] is not None:
            held = [at for at in self.hosts[name] if r["host"].lower() in self.rows[at]["website"].lower()]
            if held:
                return min(held)
        return self.first.get(("dedupe_key", "n:" + name))


def _with_person(row: dict, r: dict) -> None:
    """The person that a record names becomes a contact of the row unless it has one of that name."""
    name = (r["contact_person"] or "").strip()
    if name and all((c["name"] or "").strip() != name for c in row["contacts"]):
        row["contacts"] = [*row["contacts"], {"name": name, "email": r["email"], "phone": r["phone"], "is_primary": not row["contacts"]}]


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of the store in order, then the records by seq. Sets that share no key don't touch each other, so any number of them may come together."""
    new = rows["id"].isna()
    rows = rows.assign(id=(-rows["row_id"]).astype("Int64").mask(new), new=new, at=rows["row_id"].where(new, -rows["row_id"])).sort_values(["pending", "new", "at"], kind="stable").drop(columns=["new", "at"])
    store, whole = _Store(), ("id", "seq", "weight", "pending", "merged", "row_id", "extra", "contacts")
    for r in rows.to_dict("records"):
        r = {k: (v if k in whole or _filled(v) else None) for k, v in r.items()}
        r["extra"], r["contacts"] = dict(r["extra"] or {}), list(r["contacts"] if r["contacts"] is not None else [])
        at = store.find(r) if r["pending"] else None
        if at is None:
            r["merged"] += r["weight"]
            if r["pending"]:
                r["merged"] -= 1
                _with_person(r, r)
            store.rows.append(r)
            store.index(len(store.rows) - 1)
            continue
        old = store.rows[at]
        old["merged"] += r["weight"]
        for c in FILLED:
            if old[c] is None:
                old[c] = r[c]
        for k, v in r["extra"].items():
            if _filled(v) and not _filled(old["extra"].get(k)):
                old["extra"][k] = v
        old["source_url"] = r["source_url"] or old["source_url"]
        if r["email_verdict"] not in (None, "Unknown") and r["email"] is not None and r["email"] == old["email"] and old["email_verdict"] != "Bounced":
            old["email_verdict"] = r["email_verdict"]
        _with_person(old, r)
        store.index(at)
    return pd.DataFrame(store.rows, columns=[*NAMES, "merged"])


def _targets(state: DataFrame, pending: DataFrame) -> DataFrame:
    """pending with target: the row of the store that a record goes into whatever comes before it, null where that cannot be told; and alone: it is a new row that no record will ever find.

    It goes into the row that holds its dedupe_key. It goes into the one that holds its e-mail if nothing stronger can ever find another row for any record with that e-mail: their
    dedupe_keys are not held and come with held e-mails only, so that no row of that key arises; their tax ids are not held and come with this e-mail only; those whose key is
    held leave neither e-mail nor tax id where it would be found first. It goes into the row of its name alone if the rest of it is its own: no row of the store and no other record
    has its dedupe_key, tax id, e-mail or telephone, and it has no host. Such a record is alone if there is no row of its name alone, will be none, and none can find it by host.
    """
    value = lambda c: blank_to_null(c)
    old, new = F.col("id"), F.when(F.col("id").isNull(), F.col("seq"))
    of_first = lambda c: F.when(F.min(old).isNotNull(), F.min_by(value(c).isNotNull(), old)).otherwise(F.min_by(value(c).isNotNull(), new))
    at = F.struct(F.min(old).isNull().alias("new"), F.coalesce(F.min(old), F.min(new)).alias("nr"))
    first = F.struct(at.alias("at"), F.coalesce(-F.min(old), F.min(new)).alias("row_id"), of_first("email").alias("mailed"), of_first("tax_id").alias("taxed"))
    held = lambda c, name: state.filter(value(c).isNotNull()).groupBy(value(c).alias(f"_{c}")).agg(first.alias(name))
    p = pending
    for c, name in (("dedupe_key", "_by_key"), ("email", "_by_mail"), ("tax_id", "_by_tax"), ("phone", "_by_phone")):
        p = p.join(held(c, name), value(c) == F.col(f"_{c}"), "left")
    named = held("dedupe_key", "_by_name").withColumnRenamed("_dedupe_key", "_named")
    p = p.join(named, F.concat(F.lit("n:"), value("name_key")) == F.col("_named"), "left")
    p = stage(p, "held")
    by = lambda c, *e: p.filter(value(c).isNotNull()).groupBy(value(c).alias(f"_of_{c}")).agg(*e)
    n = lambda c: F.count(F.lit(1)).alias(f"_n_{c}")
    same = F.coalesce(F.min(value("email")) == F.max(value("email")), F.lit(False)) & (F.count(value("email")) == F.count(F.lit(1)))
    of_key = by("dedupe_key", F.every(F.col("_by_mail").isNotNull()).alias("_key_safe"), n("dedupe_key"))
    of_tax = by("tax_id", (same & F.every(F.col("_by_tax").isNull())).alias("_tax_safe"), n("tax_id"))
    of_name = by("name_key", F.bool_or(value("host").isNotNull()).alias("_hosts"))
    for c, found in (("dedupe_key", of_key), ("tax_id", of_tax), ("phone", by("phone", n("phone"))), ("name_key", of_name)):
        p = p.join(found, value(c) == F.col(f"_of_{c}"), "left")
    plain = F.col("_by_key").isNull() & F.coalesce("_key_safe", F.lit(True)) & F.coalesce("_tax_safe", F.lit(True))
    harmless = F.col("_by_key").isNotNull() & (F.col("_by_key.mailed") | (F.col("_by_key.at") > F.col("_by_mail.at"))) & (F.col("_by_key.taxed") | value("tax_id").isNull())
    of_mail = by("email", F.every(F.coalesce(plain | harmless, F.lit(False)) & F.col("_by_mail").isNotNull()).alias("_mail_safe"), n("email"))
    p = p.join(of_mail, value("email") == F.col("_of_email"), "left")
    own = value("host").isNull()
    for c, name in (("dedupe_key", "_by_key"), ("tax_id", "_by_tax"), ("email", "_by_mail"), ("phone", "_by_phone")):
        own = own & F.col(name).isNull() & (F.coalesce(f"_n_{c}", F.lit(0)) <= 1)
    target = F.coalesce("_by_key.row_id", F.when(F.col("_mail_safe"), F.col("_by_mail.row_id")), F.when(own, F.col("_by_name.row_id")))
    # Names that records still make rows for, and rows that a name can find.
    arising = pending.filter(value("dedupe_key").startswith("n:")).select(value("dedupe_key").alias("_arising")).distinct()
    p = p.join(arising, F.concat(F.lit("n:"), value("name_key")) == F.col("_arising"), "left")
    hidden = ~F.coalesce(value("dedupe_key").startswith("n:"), F.lit(False)) & (value("name_key").isNull() | value("website").isNull() | ~F.coalesce("_hosts", F.lit(False)))
    alone = own & F.col("_by_name").isNull() & F.col("_arising").isNull() & hidden
    return p.select(*pending.columns, target.alias("target"), F.coalesce(alone, F.lit(False)).alias("alone"))


def _lighter(state: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, pending) without the records that change nothing; their number is added to the weight of their row. pending has alone: the record is a new row of its own.

    Of the records that go into one row for certain, those count that are the first to fill a field, a key of extra or to name a person, the last with
    a source, and for each address the last verdict and the first bounce. So a key or an e-mail that a third of all records share leaves a few of them. Aggregates only: no group is gathered.
    """
    of = stage(_targets(state, pending), "targets")
    late = of.filter("target is not null")
    said = F.when(F.col("email").isNotNull() & F.coalesce(F.col("email_verdict") != "Unknown", F.lit(False)), F.col("email_verdict"))
    entry = lambda kind, key, first: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(first).alias("first"))
    tells = [F.when(blank_to_null(c).isNotNull(), entry(c, F.lit(""), True)) for c in FILLED]
    tells += [F.when(blank_to_null("contact_person").isNotNull(), entry("person", F.trim("contact_person"), True)), F.when(blank_to_null("source_url").isNotNull(), entry("source", F.lit(""), False))]
    tells += [F.when(said.isNotNull(), entry("verdict", F.col("email"), False)), F.when(said == "Bounced", entry("bounce", F.col("email"), True))]
    keys = F.transform(F.map_keys(F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))), lambda k: entry("extra", k, True))
    told = late.select("target", "seq", F.explode(F.concat(F.filter(F.array(*tells), lambda x: x.isNotNull()), keys)).alias("t"))
    ends = told.groupBy("target", "t").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    telling = stage(ends.select("target", F.when(F.col("t.first"), F.col("a")).otherwise(F.col("b")).alias("seq")).distinct(), "telling")
    kept = late.join(telling, ["target", "seq"], "left_semi")
    spare = late.join(telling, ["target", "seq"], "left_anti").groupBy(F.col("target").alias("row_id")).agg(F.count(F.lit(1)).alias("_spare"))
    heavier = state.join(spare, "row_id", "left").withColumn("weight", F.col("weight") + F.coalesce("_spare", F.lit(0))).select(*state.columns)
    return heavier, of.filter("target is null").unionByName(kept).drop("target")


def _signals(*site: str) -> Column:
    """An array of (kind, a, b): what a row is found by, or with ``site`` host what a record looks for one by. Values are as they stand, since a replay compares them so."""
    value = lambda c: F.when(blank_to_null(c).isNotNull(), F.col(c))
    said = lambda kind, a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")))
    kinds = [said(c, value(c), F.lit("")) for c in KEYS[:3]] + [said("phone", value("name_key"), value("phone")), said("site", value("name_key"), value(site[0] if site else "website"))]
    if site:
        kinds.append(said("dedupe_key", F.concat(F.lit("n:"), value("name_key")), F.lit("")))
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def _found(state: DataFrame, probes: DataFrame) -> DataFrame:
    """(kind, a, b, row_id): for each of the probes (kind, a, b) the first row of the store that has it, or whose website holds the host.

    No record can find another row first: a row that is not the first of any of its values is found only after a record went into it. So these are all that a replay needs.
    """
    by = ["kind", "a", "b"]
    held = state.select("id", F.when(F.col("id").isNull(), F.col("seq")).alias("seq"), F.inline(_signals())).groupBy(*by).agg(F.min("id").alias("_old"), F.min("seq").alias("_new"))
    held = held.select(*by, F.struct(F.col("_old").isNull().alias("new"), F.coalesce("_old", "_new").alias("nr")).alias("at"))
    asked = probes.select(*by).distinct()
    equal = asked.filter("kind <> 'site'").join(held, by)
    # Blanks at the ends of names, hosts and websites count here, unlike in part_matches().
    whole = lambda c: F.translate(c, " ", "\1").alias(c)
    hosts = asked.filter("kind = 'site'").select(F.struct(*by).alias("probe"), whole("a"), whole("b"))
    sites = held.filter("kind = 'site'").join(asked.filter("kind = 'site'").select("a").distinct(), "a", "left_semi").select("at", whole("a"), whole("b"))
    within = part_matches(hosts, sites, Within("b", "b", (("a", "a"),)), "probe", "at").select("row_id.*", F.col("target_id").alias("at"))
    return equal.unionByName(within).select(*by, F.when(F.col("at.new"), F.col("at.nr")).otherwise(-F.col("at.nr")).alias("row_id"))


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """rows with turn: whether a round replays them; and _upto, null unless their set has over slice_rows records. Of those it replays the ones up to a quantile of their seq, which holds slice_rows or a thousandth of them."""
    large = rows.filter("pending").groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slice_rows)
    ends = rows.filter("pending").join(large, "cluster").groupBy("cluster").agg(F.first("_n").alias("_n"), F.percentile_approx("seq", [k / 1000 for k in range(1, 1001)], 10000).alias("_q"))
    limits = ends.select("cluster", F.element_at("_q", F.greatest(F.lit(1), F.floor(slice_rows * 1000 / F.col("_n"))).cast("int")).alias("_upto"))
    return rows.join(limits, "cluster", "left").withColumn("turn", ~F.col("pending") | F.col("_upto").isNull() | (F.col("seq") <= F.col("_upto")))


def upserted(store: DataFrame, batch: DataFrame, slice_rows: int = SLICE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """The store after the batch, in the order of ``seq``: COLUMNS and merged, how many records went into each row. Blank columns come out null, maps and contacts that are missing empty.

    store and batch have columns of COLUMNS; a store's seq does not count, a batch's id is null and its seq is its own. A record finds its row by dedupe_key, tax id, e-mail,
    name and phone, name and host, or a row known by its name only. Blank fields and keys of extra are filled, the source is the latest, a verdict counts for the address that is held and never replaces a bounce,
    and a new person becomes a contact. After _lighter() has left out what changes nothing, rows of the store that no record can find are done. The others and the records share a key or the
    probe "n:" + name_key if they can ever meet; such sets are replayed, many in one task. A set with more than slice_rows records is replayed in rounds, each of which makes most of the rest light and
    takes only the rows that its slice can find: six for a record at most. Only records of one set whose signals others share, and that all are new rows, need a round for each slice.
    """
    row_id = F.when(F.col("id").isNotNull(), -F.col("id")).otherwise(F.col("seq"))
    texts = {c: F.when(F.col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.col(c)) for c in NAMES if c not in ("id", "seq", "extra", "contacts")}
    given = {"extra": F.coalesce("extra", F.create_map().cast("map<string,string>")), "contacts": F.coalesce("contacts", F.array().cast(CONTACTS))}
    shape = lambda df, pending: df.withColumns({"pending": F.lit(pending), "weight": F.lit(int(pending)).cast("long"), "row_id": row_id})
    ready = lambda df, pending: shape(complete(df).withColumns(texts | given | {"email": F.lower(texts["email"]), "merged": F.lit(0).cast("long")}), pending)
    state, pending = ready(store, False), ready(batch.withColumn("id", F.lit(None).cast("long")), True)
    done: list[DataFrame] = []
    while True:
        heavier, pending = _lighter(state, pending)
        pending = stage(pending, "pending")
        probes = stage(pending.filter("not alone").select("row_id", F.inline(_signals("host"))), "probes")
        found = stage(_found(state, probes), "found")
        state = stage(heavier.join(found.select("row_id", F.lit(True).alias("met")).distinct(), "row_id", "left"), "state")
        done.append(state.filter("met is null").drop("met"))
        rows = state.filter("met").drop("met").unionByName(pending.filter("not alone").drop("alone"))
        tagged = [F.concat(F.lit(c + "="), blank_to_null(c)) for c in KEYS] + [F.concat(F.lit("dedupe_key=n:"), blank_to_null("name_key"))]
        keys = rows.select("row_id", F.explode(F.filter(F.array(*tagged), lambda k: k.isNotNull())).alias("key"))
        named = stage(_sliced(rows.join(clusters(rows, "row_id", keys), "row_id"), slice_rows), "sliced")
        waiting, turn = not named.filter("_upto is not null").isEmpty(), named.filter("turn")
        if waiting:
            slices = probes.join(turn.filter("pending and _upto is not null").select("row_id"), "row_id", "left_semi").drop("row_id").distinct()
            met = found.join(slices, ["kind", "a", "b"], "left_semi").select("row_id").distinct()
            turn = turn.filter("pending or _upto is null").unionByName(turn.filter("not pending and _upto is not null").join(met, "row_id", "left_semi"))
        turn = turn.drop("turn", "_upto").unionByName(pending.filter("alone").drop("alone").withColumn("cluster", F.col("row_id")))
        tasks = max(2, -(-turn.count() // task_rows))
        out = stage(turn.withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(tasks))).drop("cluster").groupBy("task").applyInPandas(_replay, COLUMNS + ", merged long"), "replayed")
        rest = stage(named.join(turn.select("row_id"), "row_id", "left_anti").drop("turn", "_upto", "cluster"), "rest")
        left = lambda df: df.withColumn("merged", F.col("merged") + F.col("weight")).select(*out.columns)  # noqa: E731, B023
        out = out.unionByName(left(rest.filter("not pending")))
        if not waiting:
            return reduce(DataFrame.unionByName, map(left, done), out)
        state, pending = shape(out, False).select(*rows.columns), rest.filter("pending")
