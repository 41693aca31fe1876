"""Near-duplicate documents by SimHash: vantage-point trees over Hamming distance, exact pairs, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged, text_of, trimmed
from .components import components

BITS = 64
#: Fingerprints of a shard, on average over its tree's leaves, and rows of either side of a block that a task compares.
SHARD_ROWS, BLOCK_ROWS = 4096, 8192
#: Points of a leaf of the tree inside a task, which are compared one by one.
LEAF_ROWS = 128


def hashed(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; A-Z count as a-z. Fewer words are one shingle, none are none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    last = ends[min(width, len(words)) - 1 :]
    first = (ends - size)[: len(last)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; without any the fingerprint is 0."""
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row's whole text, as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(hashed(t, width, seed)) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(trimmed(run), "doc_id long, fp long")


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree over the values of one field of the fingerprints. Nodes are numbered from the root, 0.

    A node sends values within ``reach`` of its vantage to ``near``, the rest to ``far``; a leaf has near -1. inner and outer give the least and the greatest
    distance from the vantage of the values on either side.
    """

    shift: int
    mask: int
    radius: int
    vantage: np.ndarray
    reach: np.ndarray
    near: np.ndarray
    far: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def field(self, fps: np.ndarray) -> np.ndarray:
        return fps >> np.uint64(self.shift) & np.uint64(self.mask)

    def routes(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for every leaf that may hold values within the radius of a row's: by the triangle inequality, those whose bounds its ball overlaps. home marks the leaf of the row's own value."""
        values, rows, leaves, homes = self.field(fps), [], [], []
        stack = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while stack:
            node, at, home = stack.pop()
            if self.near[node] < 0:
                rows.append(at), leaves.append(np.full(len(at), node)), homes.append(home)
                continue
            d = np.bitwise_count(values[at] ^ self.vantage[node]).astype(np.int64)
            for child, (low, high), own in ((self.near[node], self.inner[node], d <= self.reach[node]), (self.far[node], self.outer[node], d > self.reach[node])):
                to = (d >= low - self.radius) & (d <= high + self.radius) | own & home
                if to.any():
                    stack.append((int(child), at[to], (own & home)[to]))
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def grown(values: np.ndarray, weights: np.ndarray, most: int, shift: int, mask: int, radius: int) -> Tree:
    """A tree whose leaves hold weights of ``most`` at most, or a single value. values: distinct, of one field, with how many fingerprints have each.

    Of a few vantage points and all reaches that leave each side a quarter, a node takes those that let the fewest fingerprints overlap both sides;
    where none leaves a quarter, the most even ones.
    """
    nodes: list[list] = []

    def add(at: np.ndarray) -> int:
        nodes.append([0, 0, -1, -1, (0, 0), (0, 0)])
        return len(nodes) - 1

    stack = [(add(np.arange(len(values))), np.arange(len(values)))]
    while stack:
        node, at = stack.pop()
        total = int(weights[at].sum())
        if total <= most or len(at) < 2:
            continue
        best = None
        tries = at[np.unique(np.linspace(0, len(at) - 1, 8).astype(np.int64))]
        for v in values[tries]:
            d = np.bitwise_count(values[at] ^ v).astype(np.int64)
            mass = np.bincount(d, weights[at], BITS + 2)
            upto = np.cumsum(mass)
            for reach in range(int(d.max())):
                side = min(upto[reach], total - upto[reach])
                if side <= 0:
                    continue
                both = upto[min(reach + radius, BITS)] - (upto[reach - radius] if reach >= radius else 0)
                rank = (side >= total / 4, -both if side >= total / 4 else side)
                if best is None or rank > best[0]:
                    best = (rank, v, reach, d)
        _, vantage, reach, d = best
        inside = d <= reach
        near, far = add(at[inside]), add(at[~inside])
        nodes[node] = [int(vantage), reach, near, far, (int(d[inside].min()), int(d[inside].max())), (int(d[~inside].min()), int(d[~inside].max()))]
        stack += [(near, at[inside]), (far, at[~inside])]
    columns = list(zip(*nodes, strict=True))
    return Tree(shift, mask, radius, np.array(columns[0], np.uint64), *(np.array(c, np.int64) for c in columns[1:4]), np.array(columns[4], np.int64), np.array(columns[5], np.int64))


def fields(limit: int) -> list[tuple[int, int, int]]:
    """(shift, mask, radius) of the fields that trees are grown over.

    Fingerprints that differ in ``limit`` bits differ in limit // 4 bits or fewer of some field of 16: a ball of that radius overlaps far fewer
    shards than one of the whole limit in all 64 bits.
    """
    return [(shift, 0xFFFF, limit // 4) for shift in range(0, BITS, 16)]


def trees(heads: DataFrame, limit: int, shard_rows: int) -> list[Tree]:
    """A tree for each field, grown on how many fingerprints have each value: 65,536 values a field at most, whatever the number of fingerprints."""
    n = heads.count()
    out = []
    for shift, mask, radius in fields(limit):
        counts = heads.groupBy(F.shiftrightunsigned("fp", shift).bitwiseAND(mask).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").collect()
        values, weights = np.array([r["value"] for r in counts], np.uint64), np.array([r["n"] for r in counts], np.float64)
        out.append(grown(values, weights, max(1, min(shard_rows, -(-n // 8))), shift, mask, radius))
    return out


def routed(heads: DataFrame, grown_trees: list[Tree]) -> DataFrame:
    """(tree, leaf, id, fp, home): each fingerprint in its own shard, and in those with a greater number that its ball overlaps; a pair of two shards so meets in the greater."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            fps, ids = batch["fp"].to_numpy(np.int64).view(np.uint64), batch["id"].to_numpy(np.int64)
            for k, tree in enumerate(grown_trees):
                rows, leaves, homes = tree.routes(fps)
                own = np.zeros(len(fps), np.int64)
                own[rows[homes]] = leaves[homes]
                keep = homes | (leaves > own[rows])
                rows = rows[keep]
                yield pd.DataFrame({"tree": np.int32(k), "leaf": leaves[keep].astype(np.int32), "id": ids[rows], "fp": fps[rows].view(np.int64), "home": homes[keep]})

    return heads.select("id", "fp").mapInPandas(trimmed(run), "tree int, leaf int, id long, fp long, home boolean")


def blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows of routed() with the blocks (point_block, ask_block) of their shard in which they meet others.

    A shard's own fingerprints are its points; these and the visitors ask. Both are dealt into blocks by a hash, and each block of points meets each that asks,
    so that no group is larger than two blocks, whatever the size of a shard. A shard that is small enough is one block.
    """
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count_if("home") / block_rows).cast("int").alias("points"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("asks"))
    sizes = sizes.filter("points > 0")
    sized = rows.join(sizes, ["tree", "leaf"]).withColumns({"p": F.pmod(F.xxhash64("fp"), F.col("points")).cast("int"), "q": F.pmod(F.xxhash64("fp", F.lit(1)), F.col("asks")).cast("int")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda p, q: F.struct(p.alias("point_block"), q.alias("ask_block"))
    asks, points = F.transform(every("points"), lambda p: pair(p, F.col("q"))), F.transform(every("asks"), lambda q: pair(F.col("p"), q))
    cells = F.when(F.col("home"), F.array_union(asks, points)).otherwise(asks)
    out = sized.select("tree", "leaf", "id", "fp", "home", "p", "q", F.explode(cells).alias("cell"))
    return out.select("tree", "leaf", "cell.point_block", "cell.ask_block", "id", "fp", (F.col("home") & (F.col("p") == F.col("cell.point_block"))).alias("point"), (F.col("q") == F.col("cell.ask_block")).alias("asks"))


class Links:
    """Which rows are connected so far; only links that connect are kept."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        new = a != b
        if not new.any():
            return
        parent = self.root
        for x, y in np.unique(np.column_stack([a[new], b[new]]), axis=0).tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        while True:  # every row at its root again
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def search(fps: np.ndarray, points: np.ndarray, asks: np.ndarray, limit: int, links: Links) -> None:
    """Links every row that asks with each point within the limit, through a vantage-point tree over the points.

    A node splits its points at the median distance from one of them; a row that asks goes on to a side only if the triangle inequality lets
    that side hold a point within the limit. Leaves, and nodes that no vantage splits well, compare row by row in pieces.
    """
    stack = [(points, asks)]
    while stack:
        points, asks = stack.pop()
        if not len(points) or not len(asks):
            continue
        if len(points) > LEAF_ROWS:
            d = np.bitwise_count(fps[points] ^ fps[points[len(points) // 2]]).astype(np.int64)
            reach = int(np.median(d))
            reach = reach - 1 if reach == d.max() else reach
            near = d <= reach
            if near.any() and not near.all():
                to = np.bitwise_count(fps[asks] ^ fps[points[len(points) // 2]]).astype(np.int64)
                goes = [(to >= d[side].min() - limit) & (to <= d[side].max() + limit) for side in (near, ~near)]
                work = sum(int(side.sum()) * int(go.sum()) for side, go in zip((near, ~near), goes, strict=True))
                if work < 0.9 * len(points) * len(asks):
                    stack += [(points[side], asks[go]) for side, go in zip((near, ~near), goes, strict=True)]
                    continue
        step = max(1, (1 << 18) // len(points))
        for k in range(0, len(asks), step):
            rows = asks[k : k + step]
            a, b = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[points][None, :]) <= limit)
            if len(a):
                links.add(rows[a], points[b])


def linked(cells: DataFrame, limit: int) -> DataFrame:
    """Links (u, v) that connect what each block of blocked() connects: a row and the smallest id of its set, not all pairs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        links = Links(len(rows))
        search(rows["fp"].to_numpy(np.int64).view(np.uint64), np.flatnonzero(rows["point"]), np.flatnonzero(rows["asks"]), limit, links)
        ids = rows["id"].to_numpy()
        more = links.root != np.arange(len(rows))
        return pd.DataFrame({"u": ids[more], "v": ids[links.root[more]]})

    return cells.groupBy("tree", "leaf", "point_block", "ask_block").applyInPandas(run, "u long, v long").distinct()


def simhash_components(docs: DataFrame, width: int = 5, limit: int = 4, seed: int = 42, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: documents whose fingerprints differ in ``limit`` bits or fewer are linked.

    Equal fingerprints are one class, which its smallest doc_id stands for; classes are routed to shards of vantage-point trees and compared exactly.
    Documents without words (null, empty, white space) have fingerprint zero and are linked by it like any other. Rows without a doc_id link
    to nothing: their component_id is null. Rows that repeat a doc_id are linked each by its own fingerprint. Texts of any length are read
    whole; ties do not arise. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    signed = staged(fingerprints(docs.select("doc_id", "text"), width, seed), "fingerprints")
    heads = staged(signed.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprint-heads")
    if heads.isEmpty():
        return signed.withColumn("component_id", F.lit(None).cast("long"))
    shards = staged(routed(heads, trees(heads, limit, shard_rows)), "shards")
    links = staged(linked(blocked(shards, block_rows), limit), "links")
    labels = components(links).withColumnRenamed("id", "head")
    whole = heads.join(labels, F.col("id") == F.col("head"), "left").select("fp", F.coalesce("component", "id").alias("component"))
    out = signed.join(whole, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op11_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: shingles of four words, four bits."""
    found = simhash_components(docs, width=4, limit=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
