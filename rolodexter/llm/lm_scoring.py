"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates, mixed by how often the context occurs."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, group_count, staged
from .exchange import pack, ranges, summed, unpack
from .near_dedup import Hashes, mixed

#: The end of a text, which is also the context of its first word. No word is empty.
END = b""
STEPS = 4  # cells of held-out evidence for each doubling of a probability
UNSEEN = -(1 << 15)


def fold(doc_id: int | None) -> int:
    """crc32 of doc_id as text, modulo 10: 0 is held out of training, 1 is training's part that weights are learned on. A null id counts as 0."""
    return zlib.crc32(str(doc_id).encode()) % 10 if doc_id is not None else 0


class Tokens:
    """One group's tokens: for each its word's key, the key of the pair with the word before, and its document."""

    def __init__(self, ids: list, texts: list[str], hashes: Hashes):
        words, lengths = [], []
        end = np.array([hashes[END]], np.uint64)
        for text in texts:
            w = text.encode("utf-8", "surrogatepass").lower().split()
            words += [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), end]
            lengths.append(len(w) + 1)
        self.word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        before = np.concatenate([end, self.word[:-1]]) if len(self.word) else self.word
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pair = mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(self.word))
        self.folds = np.array([fold(i) for i in ids], np.int64)
        self.fold = np.repeat(self.folds, self.lengths)
        # Sorted distinct keys of both kinds, and each token's place among them.
        self.kinds = [np.unique(x, return_inverse=True) for x in (self.word, self.pair)]
        self.end_at = int(np.searchsorted(self.kinds[0][0], end[0])) if len(self.word) else 0

    def counts(self, kind: int, part: str) -> np.ndarray:
        """How often each distinct key occurs in the part of training that counts come from (main) or that weights are learned on (tuning)."""
        keys, place = self.kinds[kind]
        chosen = self.fold == 1 if part == "tuning" else self.fold > 1
        return np.bincount(place[chosen], minlength=len(keys))

    def before(self) -> np.ndarray:
        """The place of each token's context among the distinct words."""
        place = self.kinds[0][1]
        return np.concatenate([[self.end_at], place[:-1]]) if len(place) else place


REQUEST = "part int, gid int, kind int, keys binary, main binary, tuning binary"
ANSWER = "gid int, part int, kind int, main binary, tuning binary, n_main long, n_tuning long, n_keys long"


def _ask(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        tokens = Tokens(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), Hashes())
        gid, rows = docs["gid"][0].as_py(), []
        for kind in (0, 1):
            keys, main, tuning = tokens.kinds[kind][0], tokens.counts(kind, "main"), tokens.counts(kind, "tuning")
            rows += [(k, gid, kind, pack(keys[s]), pack(main[s]), pack(tuning[s])) for k, s in ranges(keys, parts)]
        return _table(rows, [("part", pa.int32()), ("gid", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("main", pa.binary()), ("tuning", pa.binary())])

    return run


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _answer(requests: pa.Table) -> pa.Table:
    """Sums for each group in the order of its request; a row without a group has the range's totals."""
    out = []
    part = requests["part"][0].as_py()
    for kind in (0, 1):
        rows = sorted((r for r in requests.to_pylist() if r["kind"] == kind), key=lambda r: r["gid"])
        keys = [unpack(r["keys"]) for r in rows]
        _, main, places = summed(keys, [unpack(r["main"]) for r in rows])
        _, tuning, _ = summed(keys, [unpack(r["tuning"]) for r in rows])
        out += [(r["gid"], part, kind, pack(main[p]), pack(tuning[p]), 0, 0, 0) for r, p in zip(rows, places, strict=True)]
        out.append((-1, part, kind, b"", b"", int(main.sum()), int(tuning.sum()), int(np.count_nonzero(main + tuning))))
    return _table(out, [("gid", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("main", pa.binary()), ("tuning", pa.binary()), ("n_main", pa.int64()), ("n_tuning", pa.int64()), ("n_keys", pa.int64())])


def _counts(answers: pa.Table) -> list[dict[str, np.ndarray]]:
    """For each kind the counts of the group's distinct keys, in their order."""
    rows = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["part"]))
    return [{c: np.concatenate([unpack(r[c]).astype(np.int64) for r in rows if r["kind"] == kind] or [np.zeros(0, np.int64)]) for c in ("main", "tuning")} for kind in (0, 1)]


def bucket_of(count: np.ndarray) -> np.ndarray:
    """The context's frequency bucket: 0 for a new one, then one for each doubling."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _evidence(total: int):
    """Held-out tokens counted by context bucket and the two estimates, in steps of a quarter of a doubling; UNSEEN where an estimate is 0."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        cells: Counter = Counter()
        if docs.num_rows:
            tokens = Tokens(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), Hashes())
            words, pairs = (x["main"] for x in _counts(answers))
            chosen = tokens.fold == 1
            context = words[tokens.before()[chosen]]
            pair, word = pairs[tokens.kinds[1][1][chosen]], words[tokens.kinds[0][1][chosen]]
            with np.errstate(divide="ignore", invalid="ignore"):
                steps = lambda p: np.where(p > 0, np.rint(STEPS * np.log2(np.where(p > 0, p, 1))), UNSEEN).astype(np.int64)
                two, one = steps(pair / np.maximum(context, 1)), steps(word / max(total, 1))
            cell, n = np.unique(np.stack([bucket_of(context), two, one]), axis=1, return_counts=True)
            cells.update(dict(zip(map(tuple, cell.T.tolist()), n.tolist(), strict=True)))
        return _table([(*k, v) for k, v in cells.items()], [("bucket", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("n", pa.int64())])

    return run


def learned_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation for each context bucket: weights (bigram, unigram, uniform). A bucket without evidence takes those of all together; the uniform weight never reaches 0."""
    data = np.array(cells, np.float64).reshape(-1, 4)
    estimates = np.stack([np.where(data[:, k] == UNSEEN, 0, 2.0 ** (data[:, k] / STEPS)) for k in (1, 2)] + [np.full(len(data), uniform)], axis=1)

    def learn(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            w = n @ (share / share.sum(axis=1, keepdims=True))
            w = np.maximum(w / w.sum(), [0, 0, 1e-6])
            w /= w.sum()
        return w

    out = np.tile(learn(estimates, data[:, 3]) if len(data) else np.array([0.0, 0.0, 1.0]), (64, 1))
    for b in np.unique(data[:, 0]).astype(int):
        mine = data[:, 0] == b
        out[b] = learn(estimates[mine], data[mine, 3])
    out[0, 2] += out[0, 0]  # a new context has no bigram estimate
    out[0, 0] = 0
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, distinct: int, weights: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            ids = docs["doc_id"].to_pylist()
            tokens = Tokens(ids, docs["text"].to_pylist(), Hashes())
            words, pairs = (x["main"] + x["tuning"] for x in _counts(answers))
            word, pair, context = words[tokens.kinds[0][1]], pairs[tokens.kinds[1][1]], words[tokens.before()]
            base = np.log10((word + 0.1) / (total + 0.1 * (distinct + 1)))
            w = weights[bucket_of(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (distinct + 1)
            add = lambda x: np.add.reduceat(x, tokens.starts).tolist()
            known, bases, scores = add((word > 0).astype(np.int64)), add(base), add(np.log10(p))
            rows = [(i, bool(f == 0), n, k, total, b, s) for i, f, n, k, b, s in zip(ids, tokens.folds.tolist(), tokens.lengths.tolist(), known, bases, scores, strict=True)]
        return _table(rows, [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    return run


def scored(docs: DataFrame, group_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    All training rows are counted: nine tenths of them give the estimates that the weights are learned for, on the other
    tenth; then both together give the estimates that score. Words and pairs are counted by 64-bit hashes. Null text is
    empty and has its end alone; rows that repeat count and are scored each; a null doc_id is held out; an empty table
    gives an empty result; a text of any length is scored whole; ties do not arise; without training rows only the uniform estimate is left. Columns other than doc_id and
    text are not read. The driver gets two totals for each range of keys and the cells of evidence, whose number is bounded by
    the range of probabilities.
    """
    spark = docs.sparkSession
    groups = group_count(docs, group_bytes)
    texts = dealt(docs, groups)
    requests = texts.groupBy("gid").applyInArrow(_ask(groups), REQUEST)
    answers = staged(requests.repartitionById(groups, "part").groupBy("part").applyInArrow(_answer, ANSWER), "lm-answers")
    sums = answers.filter("gid < 0 and kind = 0").agg(F.sum("n_main"), F.sum("n_tuning"), F.sum("n_keys")).first()
    main, tuning, distinct = (int(x or 0) for x in sums)
    mine = answers.filter("gid >= 0").select("gid", "part", "kind", "main", "tuning").repartitionById(groups, "gid").groupBy("gid")
    cells = texts.groupBy("gid").cogroup(mine).applyInArrow(_evidence(main), "bucket int, two int, one int, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    cells = staged(cells, "lm-evidence").orderBy("bucket", "two", "one").collect()
    weights = learned_weights([tuple(r) for r in cells], 1 / (distinct + 1))
    return texts.groupBy("gid").cogroup(mine).applyInArrow(_score(main + tuning, distinct, weights), SCORES)


def op9_lm_scoring(docs: DataFrame) -> DataFrame:
    return scored(docs)
