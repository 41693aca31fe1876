"""Near-duplicate documents by MinHash, banding, verification on full shingle sets, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, staged, text_of, trimmed
from .components import components

BANDS = 32


def rows_for(percent: int) -> int:
    """Minima in a band: a pair at the limit then shares none of 32 bands three times in a million at 80 %, once in four million at 85 %."""
    return 6 if percent >= 85 else 5 if percent >= 80 else 3


#: A pair is not verified if its estimate is this far below the limit: six standard deviations.
SLACK = 0.16


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z. A text with fewer words is one shingle; without words there is none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def _family(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(0, (1 << 32) - 1, (2, n), np.uint32, endpoint=True)
    return a | np.uint32(1), b


def minima(values: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least a * x + b mod 2**32 for each universal hash function, over the upper halves x of the values, a few thousand at a time."""
    a, b = family
    upper = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(upper), 2048):
        block = a[:, None] * upper[None, k : k + 2048]
        block += b[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, width: int = 3, rows_each: int = 6, seed: int = 41) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands, sig): the set's size and 128-bit fingerprint, a key for each band, and a byte of each minimum."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, family = Hashes(), _family(seed, rows_each * BANDS)
        spread = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                values = shingles(text, width, hashes)
                if not len(values):
                    rows.append((0, 0, 0, [], b""))
                    continue
                least = minima(values, family)
                key = spread.copy()
                for k in range(rows_each):
                    key = mixed(key + least[k::rows_each])
                whole = xxhash.xxh3_128_digest(values.tobytes())
                rows.append((len(values), *np.frombuffer(whole, np.int64).tolist(), key.view(np.int64), (least & 255).astype(np.uint8).tobytes()))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_shingles", "fp1", "fp2", "bands", "sig"])], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(trimmed(sign), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from signatures, row by row; a byte of two different minima agrees once in 256."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    rows = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
    return pd.Series(estimates(rows(a), rows(b)))


@F.pandas_udf(T.LongType())
def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sizes of the intersections of sorted sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, members) for the documents in ids: their whole shingle sets, packed and sorted."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "members": [shingles(t, width, hashes).tobytes() for t in batch["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(ids, "id", "left_semi")
    return texts.mapInPandas(trimmed(pack), "id long, members binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union, on full sets."""
    left, right = (sets.select(F.col("id").alias(c), F.col("members").alias(f"{c}_set")) for c in "uv")
    both = pairs.select("u", "v").join(left, "u").join(right, "v")
    size = F.floor((F.octet_length("u_set") + F.octet_length("v_set")) / 8)
    both = both.select("u", "v", size.alias("size"), shared("u_set", "v_set").alias("common"))
    return both.filter(F.col("common") * 100 >= F.lit(percent) * (F.col("size") - F.col("common"))).select("u", "v")


BLOCK_ROWS = 2048


def _grid(members: DataFrame, extra: list[str]) -> DataFrame:
    """members: (key, id, component, ...) of buckets with several components. Rows for comparing, in groups (main, asks_block, block).

    A bucket belongs to its largest component, its main one. For each main component, the rows of its buckets outside of it ask,
    and all its buckets' rows are asked, each once. Both are dealt into blocks of about BLOCK_ROWS, and each block of those that ask
    meets each block of those that are asked: no group is larger, whatever the size of a bucket.
    """
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    rows = members.select("key", "id", "component").join(main, "key").select("main", "id", "component").distinct()
    sizes = rows.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("component") != F.col("main")) / BLOCK_ROWS).cast("int").alias("asks_blocks")).filter("asks_blocks > 0")
    rows = rows.join(members.select("id", *extra).dropDuplicates(["id"]), "id").join(sizes, "main")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("main", every("asks_blocks").alias("asks_block"), spread("blocks").alias("block"), "id", "component", F.lit(False).alias("asks"), *extra)
    asks = rows.filter(F.col("component") != F.col("main")).select("main", spread("asks_blocks").alias("asks_block"), every("blocks").alias("block"), "id", "component", F.lit(True).alias("asks"), *extra)
    return asks.unionByName(asked)


def _rivals(rows: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row that asks, rows of other components with an estimate of at least ``least``, the best first). Pairs of two that ask come once."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
    ids, comp, asks, main = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["asks"].to_numpy(), int(rows["main"].iloc[0])
    there = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        other = there[(comp[there] != comp[i]) & ((comp[there] == main) | (ids[there] < ids[i]))]
        score = estimates(sig[other], sig[i])
        good = np.flatnonzero(score >= least)
        if len(good):
            yield int(i), other[good[np.lexsort((ids[other[good]], -score[good]))]]


def contested(members: DataFrame, least: float) -> DataFrame:
    """(id): the rows that have a rival, or are one. members: with sig."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(rows), bool)
        for i, rivals in _rivals(rows, least):
            found[i] = True
            found[rivals] = True
        return pd.DataFrame({"id": rows["id"].to_numpy()[found]})

    return _grid(members, ["sig"]).groupBy("main", "asks_block", "block").applyInPandas(run, "id long").distinct()


def settled(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (u, v) between components. members: with sig and members (full sets). A row that asks is held against its rivals, and against no more of a component once it is linked with it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        ids, comp, out = rows["id"].to_numpy(), rows["component"].to_numpy(), []
        for i, rivals in _rivals(rows, least):
            linked: set[int] = set()
            for j in rivals.tolist():
                if comp[j] not in linked:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common * 100 >= percent * (len(sets[i]) + len(sets[j]) - common):
                        linked.add(comp[j])
                        out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return _grid(members, ["sig", "members"]).groupBy("main", "asks_block", "block").applyInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, seed: int = 41) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents with equal shingle sets are one class, which its smallest doc_id stands for. Classes that share a band key
    are candidates. Each is first held against the smallest of the bucket where their signatures agree most, on full sets. Then,
    in buckets that still have several components, all rows outside of the largest one are held against the rest in blocks: by
    signature, then on full sets, until linked. So no pair of a bucket is left out unless its ends are connected already, and
    no table of pairs is made. Links go through large-star and small-star.
    Texts of any length count whole; of equal scores the smaller doc_id is tried first, which no result depends on; an empty table gives an empty result.
    Documents without words (null, empty, white space) are alone. Rows that repeat a doc_id share its fate. Rows without a doc_id link
    to nothing: their component_id is null and they are kept. Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    signed = staged(signatures(docs, width, rows_for(percent), seed), "signatures")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = staged(named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id")), "classes")
    heads = named.join(classes.select("id"), named["doc_id"] == F.col("id"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "bands", "sig")
    heads = staged(heads, "heads")
    keys = heads.select("id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub")
    buckets = staged(keys.join(hubs, "key").select("key", "id", "hub"), "buckets")
    sigs = heads.select("id", "sig")
    least = percent / 100 - SLACK
    pairs = buckets.filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    scored = pairs.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("u_sig")), "u").join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("v_sig")), "v")
    scored = staged(scored.select("u", "v", estimate("u_sig", "v_sig").alias("score")).filter(F.col("score") >= least), "pairs")

    ends = lambda x: x.select(F.col("u").alias("id")).union(x.select(F.col("v").alias("id"))).distinct()
    sets = staged(full_sets(docs, ends(scored), width), "sets")
    best = scored.groupBy("u").agg(F.max(F.struct("score", (-F.col("v")).alias("v")))["v"].alias("v")).select("u", (-F.col("v")).alias("v"))
    links = staged(verified(best, sets, percent), "links")
    labels = staged(components(links), "labels")
    # Buckets that have several components still: all that differ by component in them are held against each other.
    named = buckets.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    torn = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    members = staged(named.join(torn, "key", "left_semi").join(sigs, "id"), "torn")
    active = staged(contested(members, least), "active")
    if not active.isEmpty():
        missing = staged(active.join(sets.select("id"), "id", "left_anti"), "missing")
        if not missing.isEmpty():
            sets = sets.unionByName(staged(full_sets(docs, missing, width), "sets"))
        rivals = members.join(active, "id", "left_semi").join(sets, "id")
        found = staged(settled(rivals, least, percent), "links")
        if not found.isEmpty():
            labels = staged(components(links.unionByName(found)), "labels")
    at = signed.join(classes.withColumnRenamed("id", "head"), ["fp1", "fp2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("head")).otherwise(F.col("doc_id")).alias("head"))
    out = at.join(labels.withColumnRenamed("id", "head"), "head", "left").withColumn("component_id", F.coalesce("component", "head"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, **kw) -> DataFrame:
    """The rows of docs that stay, one doc_id of each component; all columns, whatever their names.

    Nulls, empty and very long texts, ties and repeated rows as in near_duplicates(): rows without words or without a doc_id stay, and rows that repeat a doc_id stay or go together.
    """
    (its,) = fresh(docs.columns, "its")
    gone = near_duplicates(docs, width, percent, **kw).filter("not kept").select(F.col("doc_id").alias(its)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(its), "left_anti")


def op6_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS g FROM t),
c AS (SELECT g, min(doc_id) AS head, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g),
x AS (SELECT head, n, unnest(g) AS g FROM c),
f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS (SELECT x.* FROM x SEMI JOIN f USING (g)),
e AS (SELECT a.head AS u, b.head AS v FROM y a JOIN y b ON a.g = b.g AND a.head <> b.head AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.head, b.head, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
r AS (SELECT head AS id, head AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
k AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE k.component_id END AS component_id, s.doc_id = CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE k.component_id END AS kept
FROM s JOIN c ON list_sort(s.g) = c.g JOIN k ON k.id = c.head
"""
