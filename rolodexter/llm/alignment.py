"""Aligning the tokens of two tokenizers by byte ranges, with corpus-wide counts of the pairs of ids that meet."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, prepare, stage_path, staged, text_of
from .exchange import pack, unpack

#: Characters of text that are encoded together, pairs made at once, and pair keys that a task gathers before it adds them up.
SLICE_CHARS, PAIRS, GATHERED = 1 << 20, 1 << 20, 1 << 21


def byte_level() -> dict[str, int]:
    """The character for each byte in byte-level vocabularies: printable Latin-1 as it is, the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how byte-level vocabularies cut a text before merging.
BYTE_LEVEL_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a run as long without, or of, white space are left to the tokenizers library, whose time does not grow with the square of a run.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class ByteBpe:
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text.

    Where the file says no more than the usual cuts and merges in the order of their ids, tiktoken encodes with the file's own tokens: it gives the same ids several times faster.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        to_byte = byte_level()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        vocab = model.get("vocab", {})
        parts = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        plain = not told.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges")
        plain = plain and len(vocab) >= 256 + len(parts) and all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(parts))
        ranks = {self.bytes[i]: i for i in range(256 + len(parts))} if plain else {}
        self.fast = Encoding("own", pat_str=BYTE_LEVEL_CUTS, mergeable_ranks=ranks, special_tokens={}) if plain and len(ranks) == 256 + len(parts) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self.library([t])[0] if LONG_RUN.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]
        return self.library(texts)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        named = [self.model.id_to_piece(i) for i in every]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(every, named, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, which of them count) of every number up to ``most`` in decimal, and a place for what follows it."""
    width = len(str(most))
    rest = np.arange(most + 1)[:, None] // 10 ** np.arange(width - 1, -1, -1)[None, :]
    shown, keep = np.zeros((most + 1, width + 1), np.uint8), np.ones((most + 1, width + 1), bool)
    shown[:, :-1], keep[:, :-2] = rest % 10 + 48, rest[:, :-1] > 0
    return shown, keep


def written(ids: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> str:
    """Decimal ids, each followed by its character of ``ends``, the last one by none."""
    shown = table[0][ids]
    shown[:, -1] = ends
    return shown[table[1][ids]].tobytes()[:-1].decode()


class Alignment:
    """One text's tokens of both sides: groups between the byte offsets where tokens of both end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        common = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a
        cuts = ends_a[common]
        self.n_groups, self.group_a, self.group_b = len(cuts), np.cumsum(common) - common, np.searchsorted(cuts, ends_b)
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))

    def text(self, table: tuple[np.ndarray, np.ndarray]) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, side by side."""
        n = len(self.a) + len(self.b)
        ids, ends = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a)] = self.a
        ids[np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")] = self.b
        close = np.cumsum(self.n_a + self.n_b)
        ends[close - self.n_b - 1] = ord("|")
        ends[close - 1] = ord(";")
        return written(ids, ends, table)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct packed pairs a << 32 | b that share a group, how often each is linked). Of a large group its distinct ids are paired, with how often they occur."""
        links = self.n_a * self.n_b
        large = links > 4096
        keys, times = [], []

        def gather(a: np.ndarray, b: np.ndarray, start: np.ndarray, count: np.ndarray, weight_a: np.ndarray | None, weight_b: np.ndarray | None) -> None:
            # Token k of a meets b[start[k] : start[k] + count[k]]; PAIRS at a time.
            upto = np.cumsum(count)
            lo = 0
            while lo < len(a):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
                c = count[lo:hi]
                left = np.repeat(np.arange(lo, hi), c)
                right = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[lo:hi], c)
                key = a[left].astype(np.int64) << 32 | b[right].astype(np.int64)
                if weight_a is None:
                    found, n = np.unique(key, return_counts=True)
                else:
                    found, n = _added(key, weight_a[left] * weight_b[right])
                keys.append(found)
                times.append(n)
                lo = hi

        begin_b = np.cumsum(self.n_b) - self.n_b
        of = ~large[self.group_a]
        gather(self.a[of], self.b, begin_b[self.group_a[of]], self.n_b[self.group_a[of]], None, None)
        begin_a = np.cumsum(self.n_a) - self.n_a
        for g in np.flatnonzero(large):
            a, wa = np.unique(self.a[begin_a[g] : begin_a[g] + self.n_a[g]], return_counts=True)
            b, wb = np.unique(self.b[begin_b[g] : begin_b[g] + self.n_b[g]], return_counts=True)
            gather(a, b, np.zeros(len(a), np.int64), np.full(len(a), len(b)), wa, wb)
        if len(keys) == 1:
            return keys[0], times[0]
        return _added(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values: runs of the sorted keys."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (without text) with n_a, n_b, n_groups, groups, and the packed pairs of ids linked: pair_keys and pair_times, as of exchange.pack().

    path_a is a byte-level vocabulary of the tokenizers library, which reads a space and the text; path_b a sentencepiece model, which reads the text. Both files must be at
    these paths on every executor. Texts that are null, empty, or that either side does not give back byte for byte have no tokens: zeros, groups ''
    and no pairs. Texts of any length are encoded whole; repeated rows are aligned alike; an empty table gives none. Other columns stay; those of the added names are replaced.
    """
    added = {"n_a": "long", "n_b": "long", "n_groups": "long", "groups": "string", "pair_keys": "binary", "pair_times": "binary"}
    docs = docs.drop(*added)
    (its,) = fresh(docs.columns, "its_text")
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(*kept, text_of().alias(its))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteBpe(path_a), Pieces(path_b)
        size_a, size_b = (np.array([len(x) for x in side.bytes]) for side in (one, two))
        table = digits(max(len(size_a), len(size_b)) - 1)
        none = (0, 0, 0, "", pack(np.zeros(0, np.int64)), pack(np.zeros(0, np.int64)))

        def align(text: str, a: list[int], b: list[int]) -> tuple:
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if not text or any(b"".join(map(side.bytes.__getitem__, ids)) != whole for side, ids in ((one, a), (two, b))):
                return none
            both = Alignment(np.array(a, np.int64), np.array(b, np.int64), size_a, size_b)
            keys, times = both.pairs()
            return len(a), len(b), both.n_groups, both.text(table), pack(keys), pack(times)

        try:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                lo = 0
                while lo < len(texts):
                    hi, n = lo, 0
                    while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= SLICE_CHARS):
                        n += len(texts[hi])
                        hi += 1
                    part = texts[lo:hi]
                    out = [align(*x) for x in zip(part, one.encode(part), two.encode(part), strict=True)]
                    new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], *new], [*kept, *added])
                    lo = hi
        finally:
            del one, two
            give_back()

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields] if kept else []
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{n} {t}" for n, t in added.items())]))


def partial_counts(rows: DataFrame) -> DataFrame:
    """(key, n): how many of a partition's documents hold each pair; GATHERED keys at a time, so that memory follows the distinct pairs between two flushes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def emptied() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], ["key", "n"])

        def add_up() -> None:
            nonlocal keys, counts
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, counts = _added(np.concatenate([keys, found]), np.concatenate([counts, n]))
            waiting.clear()

        n = 0
        for batch in batches:
            for packed in batch["pair_keys"].to_pylist():
                waiting.append(unpack(packed).view(np.int64))
                n += len(waiting[-1])
                if n >= GATHERED:
                    add_up()
                    n = 0
                    if len(keys) >= 2 * GATHERED:
                        yield from emptied()
                        keys, counts = keys[:0], counts[:0]
        if waiting:
            add_up()
        yield from emptied()
        give_back()

    return rows.select("pair_keys").mapInArrow(run, "key long, n long")


def local_path(uri: str) -> str | None:
    """The path of a file: address, None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save_shard(uri: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """A shard's keys and counts, side by side in one file, which exists only whole."""
    data = np.concatenate([keys, counts]).astype("<i8").tobytes()
    path = local_path(uri)
    if path is None:
        store, at = pa.fs.FileSystem.from_uri(uri)
        with store.open_output_stream(at) as f:
            f.write(data)
        return
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def mapped_shard(uri: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a shard: memory-mapped where the shared folder is a file system, read whole from other stores."""
    path = local_path(uri)
    if path is not None:
        both = np.memmap(path, "<i8", "r")
    else:
        store, at = pa.fs.FileSystem.from_uri(uri)
        with store.open_input_file(at) as f:
            both = np.frombuffer(f.read(), "<i8")
    return both[:n], both[n:]


class Shards:
    """The count table: sorted shards in the shared folder, and the largest count of each id of side a."""

    def __init__(self, files: list[tuple[str, int, int]], best: np.ndarray):
        self.files, self.best = sorted(files, key=lambda f: f[1]), best  # (address, first key, keys)
        self.first = np.array([f[1] for f in self.files], np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; a shard is open while its own keys are looked up."""
        out = np.zeros(len(keys), np.int64)
        cut = np.searchsorted(keys, self.first)
        for (uri, _, n), lo, hi in zip(self.files, cut, [*cut[1:], len(keys)], strict=True):
            if lo < hi:
                there, count = mapped_shard(uri, n)
                at = np.minimum(np.searchsorted(there, keys[lo:hi]), n - 1)
                out[lo:hi] = np.where(there[at] == keys[lo:hi], count[at], 0)
        return out


def count_shards(rows: DataFrame, vocabulary: int) -> Shards:
    """Corpus-wide document counts of the pairs in rows of aligned(): partial counts, a range-partitioned sort, and sums of runs, written as a shard for each range.

    A key has one partial count for each flush of a partition, so that frequent pairs make no large range. What the driver gets is a line for each shard and, for each id of
    side a, its largest count in a shard.
    """
    folder = stage_path(rows.sparkSession, "pair-counts")
    if local_path(folder) is not None:
        os.makedirs(local_path(folder), exist_ok=True)
    else:
        store, at = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
    partial = staged(partial_counts(rows), "partial-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            if batch.num_rows:
                k, n = _added(batch["key"].to_numpy(), batch["n"].to_numpy())
                if keys and keys[-1][-1] == k[0]:  # a run goes on
                    counts[-1][-1] += n[0]
                    k, n = k[1:], n[1:]
                if len(k):
                    keys.append(k)
                    counts.append(n)
        if keys:
            key, count = np.concatenate(keys), np.concatenate(counts)
            uri = f"{folder}/{uuid.uuid4().hex}"
            save_shard(uri, key, count)
            ids = key >> 32
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            best = np.maximum.reduceat(count, first)
            yield pa.RecordBatch.from_pylist([{"uri": uri, "first": int(key[0]), "n": len(key), "ids": ids[first].tolist(), "best": best.tolist()}], pa.schema([("uri", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))]))
        give_back()

    found = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "uri string, first long, n long, ids array<long>, best array<long>").collect()
    best = np.zeros(vocabulary, np.int64)
    for row in found:
        np.maximum.at(best, np.array(row["ids"], np.int64), np.array(row["best"], np.int64))
    return Shards([(r["uri"], r["first"], r["n"]) for r in found], best)


def counted(rows: DataFrame, shards: Shards) -> DataFrame:
    """rows of aligned() with n_links, n_best (links whose count is the largest of their id of side a) and count_sum in place of the packed pairs."""
    kept = [c for c in rows.columns if c not in ("pair_keys", "pair_times", "n_links", "n_best", "count_sum")]
    rows = rows.select(*kept, "pair_keys", "pair_times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = [unpack(x).view(np.int64) for x in batch["pair_keys"].to_pylist()]
            keys, times = np.concatenate(each), np.concatenate([unpack(x).view(np.int64) for x in batch["pair_times"].to_pylist()])
            distinct, place = np.unique(keys, return_inverse=True)
            count = shards.counts(distinct)
            best = count == shards.best[distinct >> 32]
            ends = np.cumsum([len(x) for x in each])
            sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])
            new = [pa.array(sums(times)), pa.array(sums(times * best[place])), pa.array(sums(times * count[place]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], [*kept, "n_links", "n_best", "count_sum"])
        give_back()

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "n_links long, n_best long, count_sum long"]))


def op13_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The contract's columns. Each text is encoded once; its pairs are staged, counted over all documents and looked up again."""
    prepare(docs.sparkSession)
    rows = aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path_a, path_b)
    rows = staged(rows.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"), "aligned")
    out = counted(rows, count_shards(rows, 1 << 16))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
