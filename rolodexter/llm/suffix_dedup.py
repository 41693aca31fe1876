"""Removing byte strings that an earlier document has too, with suffix arrays by induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, group_count, staged
from .exchange import pack, ranges, summed, unpack
from .near_dedup import mixed

LENGTH = 50  # bytes of a string that is removed
ANCHOR = 24  # bytes of an anchor; each string of LENGTH bytes has one at a place that its bytes alone decide
SPAN = LENGTH - ANCHOR + 1  # windows of anchors
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd; one for each eight bytes of an anchor
CHUNK = 1 << 20  # bytes handled at a time
NEAR = 1 << 16  # the same where arrays should stay in a core's cache


def words(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on, as an integer."""
    n = len(data)
    out = np.empty(max(n - 7, 0), np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = data[k : k + (n - k) // 8 * 8].view(np.uint64)
    return out


# Suffix arrays -------------------------------------------------------------------------------------------------------


def _classes(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S). The last character is the only 0."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    at = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]  # the next place where it is decided
    return np.concatenate([text[at] < text[at + 1], [True]])


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that the leftmost-smaller suffixes, in this order, induce: L from the left, then S from the right.

    Buckets go one after another; all that a bucket has so far induces at once, in order.
    """
    n = len(text)
    sizes = np.bincount(text, minlength=sigma)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    out = np.full(n, -1, np.int64)

    def put(places: np.ndarray, free: np.ndarray, forward: bool) -> None:
        chars = text[places]
        order = np.argsort(chars, kind="stable")
        chars, places = chars[order], places[order]
        first = np.searchsorted(chars, chars)
        nth = np.arange(len(chars)) - first
        out[free[chars] + nth if forward else free[chars] - 1 - nth] = places
        more = np.bincount(chars, minlength=sigma)
        free += more if forward else -more

    free = tails.copy()
    put(lms[::-1], free, False)
    at_lms = free.copy()
    free = heads.copy()
    for c in range(sigma):
        done = heads[c]
        while done < free[c]:  # L suffixes that induce others of this bucket
            upto = free[c]
            before = out[done:upto] - 1
            before = before[before >= 0]
            before = before[~small[before]]
            done = upto
            if len(before):
                put(before, free, True)
        before = out[at_lms[c] : tails[c]] - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if len(before):
            put(before, free, True)
    ends = free  # of the L suffixes of each bucket
    for c in range(sigma):
        out[ends[c] : tails[c]] = -1
    out[0] = n - 1  # the 0 behind the text, which nothing induces
    free = tails.copy()
    for c in range(sigma - 1, -1, -1):
        done = tails[c]
        while done > free[c]:
            upto = free[c]
            before = out[upto:done][::-1] - 1
            before = before[before >= 0]
            before = before[small[before]]
            done = upto
            if len(before):
                put(before, free, False)
        before = out[heads[c] : ends[c]][::-1] - 1
        before = before[before >= 0]
        before = before[small[before]]
        if len(before):
            put(before, free, False)
    return out


def _same_substrings(text: np.ndarray, small: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring of ``order`` equals the one before it. ends: for each place the end of its substring."""
    a, b = order[:-1], order[1:]
    length = ends[a] - a
    same = length == ends[b] - b
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (length[live] >= k)]
    return np.concatenate([[False], same])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: integers from 1 on, small in range; the suffix array of it with a 0 behind, without that 0's own entry."""
    return _sorted(np.concatenate([text, [0]]).astype(np.int64))[1:]


def _sorted(text: np.ndarray) -> np.ndarray:
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1]
    sigma = int(text.max()) + 1
    if sigma > 4096:  # the recursion's alphabet: ranks, doubled in reach until all differ
        return _doubled(text)
    small = _classes(text)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    if len(lms) < 2:
        return _induce(text, small, lms, sigma)
    rough = _induce(text, small, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    ends = np.full(n, n - 1)
    ends[lms[:-1]] = lms[1:]
    names = np.cumsum(~_same_substrings(text, small, order, ends)) - 1
    if names[-1] + 1 < len(lms):
        name_at = np.empty(n, np.int64)
        name_at[order] = names
        order = lms[_sorted(name_at[lms])]
    return _induce(text, small, order, sigma)


def _doubled(rank: np.ndarray) -> np.ndarray:
    n, step = len(rank), 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def repeated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each entry of the suffix array, whether it shares ``length`` characters with the one before.

    The permuted form: places in text order are held against their predecessors in the suffix array, eight bytes at a time.
    Characters below 2 are borders and never match.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    word = words(np.concatenate([np.where(text > 1, text - 2, 0).astype(np.uint8), np.zeros(length, np.uint8)]))
    border = np.cumsum(np.concatenate([[0], text <= 1, np.ones(length)]))
    ok = (before >= 0) & (border[length : n + length] == border[:n])
    places = np.flatnonzero(ok)
    places = places[border[before[places] + length] == border[before[places]]]
    for k in [*range(0, length - 8, 8), length - 8]:
        places = places[word[places + k] == word[before[places] + k]]
    common = np.zeros(n, bool)
    common[places] = True
    return common[order]


# Anchors -------------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, first window, last window) of each anchor of the documents data[starts:ends], in order.

    A window's anchor is the leftmost of its ANCHOR-byte strings with the least hash, so windows with the same bytes have the
    same one at the same distance. Neighbouring windows with the same anchor are one run. Documents may be empty; those
    shorter than LENGTH have no window.
    """
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    word = words(data)
    m = n - ANCHOR + 1
    h = word[:m] * FACTORS[0]
    for k, factor in enumerate(FACTORS[1:], 1):
        h += word[8 * k : 8 * k + m] * factor
    h = mixed(h)
    del word
    # The upper half of the hash, then the place: a window's least value holds its leftmost least place.
    least, width = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64), 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = len(least)
    del least
    # Windows that lie inside a document.
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    inside[starts[long]] += 1
    inside[ends[long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside[:windows]) > 0
    first = np.flatnonzero(inside & np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([(place[1:] != place[:-1]) | ~inside[1:], [True]]))
    at = place[first]
    # Least hashes are small numbers: mixed again, keys spread evenly over the ranges.
    return at, mixed(h[at] + np.uint64(0x9E3779B97F4A7C15)), first, last


def pieces(ids: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, row numbers) of about NEAR bytes of documents at a time."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= NEAR):
            n += len(texts[to])
            to += 1
        sizes = np.array([len(t) for t in texts[at:to]], np.int64)
        ends = np.cumsum(sizes)
        yield np.frombuffer(b"".join(texts[at:to]), np.uint8), ends - sizes, ends, np.arange(at, to)
        at = to


class Group:
    """One group's documents in the order of doc_id, with their anchors."""

    def __init__(self, docs: pa.Table):
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes  # where each document starts among all bytes of the group
        # A document without an id comes after all others and is nobody's earlier document.
        self.number = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        found = []
        for data, starts, ends, rows in pieces(self.ids, self.texts):
            at, key, first, last = anchors(data, starts, ends)
            shift = self.base[rows[0]] if len(rows) else 0
            found.append((at + shift, key, first + shift, last + shift))
        self.at, self.key, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        self.key = self.key.astype(np.uint64)
        self.doc = np.searchsorted(self.base + self.sizes, self.first, "right")
        self.keys, self.place, self.times = np.unique(self.key, return_inverse=True, return_counts=True)
        self.all = np.frombuffer(b"".join(self.texts), np.uint8)


NO_ID = (1 << 63) - 1
FEW, HOT = 1, 2
#: Anchors with more occurrences than this send their strings singly, each to the range of its own hash.
MANY = 2000


def _table(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, t in zip(cols, fields.values(), strict=True)], names=list(fields))


REQUEST = {"part": pa.int32(), "gid": pa.int32(), "keys": pa.binary(), "times": pa.binary()}
REQUEST_SQL = "part int, gid int, keys binary, times binary"
ANSWER = {"gid": pa.int32(), "step": pa.int32(), "part": pa.int32(), "body": pa.binary()}
ANSWER_SQL = "gid int, step int, part int, body binary"
STRINGS = {"part": pa.int32(), "gid": pa.int32(), "keys": pa.binary(), "sizes": pa.binary(), "first": pa.binary(), "last": pa.binary(), "body": pa.binary()}
STRINGS_SQL = "part int, gid int, keys binary, sizes binary, first binary, last binary, body binary"


def _ask(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        group, gid = Group(docs), docs["gid"][0].as_py()
        return _table([(k, gid, pack(group.keys[s]), pack(group.times[s])) for k, s in ranges(group.keys, parts)], REQUEST)

    return run


def _common_anchors(many: int):
    """For each group and key: 0 if the anchor occurs once in all, FEW, or HOT."""

    def run(requests: pa.Table) -> pa.Table:
        rows = sorted(requests.to_pylist(), key=lambda r: r["gid"])
        _, total, places = summed([unpack(r["keys"]) for r in rows], [unpack(r["times"]) for r in rows])
        kind = np.where(total < 2, 0, np.where(total > many, HOT, FEW))
        return _table([(r["gid"], 1, rows[0]["part"], pack(kind[p])) for r, p in zip(rows, places, strict=True)], ANSWER)

    return run


def _same_bytes(word: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the strings at a and at b, of the same sizes, are equal byte by byte. word: of words()."""
    same, live = np.ones(len(a), bool), np.arange(len(a))
    for k in range(0, int(sizes.max(initial=0)), 8):
        live = live[sizes[live] > k]
        at = np.minimum(k, sizes[live] - 8)  # the last eight bytes may overlap the ones before
        equal = word[a[live] + at] == word[b[live] + at]
        same[live[~equal]] = False
        live = live[equal]
    return same


def _runs(word: np.ndarray, keys: np.ndarray, sizes: np.ndarray, content: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): strings ordered by key, size and hash, and where another string begins: hashes order them, bytes decide."""
    order = np.lexsort((content, sizes, keys))
    k, z, c, at = keys[order], sizes[order], content[order], starts[order]
    new = np.ones(len(order), bool)
    alike = np.flatnonzero((k[1:] == k[:-1]) & (z[1:] == z[:-1]) & (c[1:] == c[:-1])) + 1
    new[alike] = ~_same_bytes(word, at[alike], at[alike - 1], z[alike])
    return order, new


def _hash_runs(word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of these sizes at starts, eight bytes at a time. word: of words()."""
    out = np.zeros(len(starts), np.uint64)
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        at = starts[mine]
        h = np.full(len(mine), np.uint64(size))
        for k in [*range(0, int(size) - 8, 8), int(size) - 8]:
            h = mixed(h + word[at + k])
        out[mine] = h
    return out


class Strings:
    """A group's distinct candidate strings: runs of windows with a common anchor, as bytes, with the range that each goes to.

    A string of a hot anchor is cut into its windows, each of which goes to the range of its own hash.
    """

    def __init__(self, group: Group, kind: np.ndarray):
        kind = kind[group.place]
        few, hot = np.flatnonzero(kind == FEW), np.flatnonzero(kind == HOT)
        windows = group.last[hot] - group.first[hot] + 1
        hot = np.repeat(hot, windows)
        nth = np.arange(len(hot)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = np.concatenate([group.first[few], group.first[hot] + nth])
        size = np.concatenate([group.last[few] - group.first[few] + LENGTH, np.full(len(hot), LENGTH)])
        doc = np.concatenate([group.doc[few], group.doc[hot]])
        word = words(group.all)
        content = _hash_runs(word, self.start, size)
        key = np.concatenate([group.key[few], content[len(few) :]])
        # Equal strings of one group go once.
        order, new = _runs(word, key, size, content, self.start)
        del word
        self.of = np.empty(len(order), np.int64)  # for each occurrence its string
        self.of[order] = np.cumsum(new) - 1
        head = order[new]
        self.keys, self.sizes, self.at = key[head], size[head], self.start[head]
        self.doc = doc
        edge = np.flatnonzero(new)
        number = group.number[doc[order]]
        self.least = np.minimum.reduceat(number, edge) if len(edge) else number
        self.most = np.maximum.reduceat(number, edge) if len(edge) else number


def _send(parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], STRINGS)
        group, gid = Group(docs), docs["gid"][0].as_py()
        strings = Strings(group, _joined(answers, 1))
        rows = []
        for k, s in ranges(strings.keys, parts):
            if s.start < s.stop:
                body = zstandard.compress(_gathered(group.all, strings.at[s], strings.sizes[s]).tobytes(), 1)
                rows.append((k, gid, pack(strings.keys[s]), pack(strings.sizes[s]), pack(strings.least[s]), pack(strings.most[s]), body))
        return _table(rows, STRINGS)

    return run


def _joined(answers: pa.Table, step: int) -> np.ndarray:
    rows = sorted((r for r in answers.to_pylist() if r["step"] == step), key=lambda r: r["part"])
    return np.concatenate([unpack(r["body"]).astype(np.int64) for r in rows] or [np.zeros(0, np.int64)])


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start : start + size] of all, one after another."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _earliest(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, offset, windows): for the strings of all rows, one after another, how many windows each has and where the least documents of these start in ``least``."""
    keys = np.concatenate([unpack(r["keys"]) for r in rows])
    sizes = np.concatenate([unpack(r["sizes"]).astype(np.int64) for r in rows])
    first = np.concatenate([unpack(r["first"]).astype(np.int64) for r in rows])
    bodies = [np.frombuffer(zstandard.decompress(r["body"]), np.uint8) for r in rows]
    data = np.concatenate(bodies)
    del bodies
    starts = np.cumsum(sizes) - sizes
    word = words(data)
    order, new = _runs(word, keys, sizes, _hash_runs(word, starts, sizes), starts)
    del word
    kinds = np.cumsum(new) - 1  # equal strings
    least = np.minimum.reduceat(first[order], np.flatnonzero(new))
    head = order[new]
    windows = sizes - LENGTH + 1
    mine = np.repeat(least, windows[head])  # of the windows of each distinct string, as far as it alone tells
    offset = np.cumsum(windows[head]) - windows[head]
    # Anchors with several distinct strings: these may overlap in part.
    own = keys[head]
    several = np.concatenate([own[1:] == own[:-1], [False]]) | np.concatenate([[False], own[1:] == own[:-1]])
    todo = np.flatnonzero(several)
    at = 0
    while at < len(todo):
        to = min(at + (CHUNK >> 5), len(todo))
        while to < len(todo) and own[todo[to]] == own[todo[to - 1]]:
            to += 1
        part = todo[at:to]
        size = sizes[head[part]]
        # One text: each string, then a border.
        ends = np.cumsum(size + 1)
        text = np.ones(ends[-1], np.int64)
        inner = np.ones(len(text), bool)
        inner[ends - 1] = False
        text[inner] = _gathered(data, starts[head[part]], size).astype(np.int64) + 2
        suffixes = suffix_array(text)
        group = np.cumsum(~repeated(text, suffixes, LENGTH)) - 1
        place = np.full(len(text), NO_ID)
        valid = np.arange(len(text)) - np.repeat(ends - size - 1, size + 1) < np.repeat(windows[head[part]], size + 1)
        place[valid] = np.repeat(least[part], windows[head[part]])
        lowest = np.full(group[-1] + 1, NO_ID)
        np.minimum.at(lowest, group, place[suffixes])
        found = np.empty(len(text), np.int64)
        found[suffixes] = lowest[group]
        mine[np.arange(windows[head[part]].sum()) + np.repeat(offset[part] - (np.cumsum(windows[head[part]]) - windows[head[part]]), windows[head[part]])] = found[valid]
        at = to
    back = np.empty(len(order), np.int64)
    back[order] = kinds
    return mine, offset[back], windows


def _answer_strings(strings: pa.Table) -> pa.Table:
    rows = sorted(strings.to_pylist(), key=lambda r: r["gid"])
    mine, offset, windows = _earliest(rows)
    at, out = 0, []
    for r in rows:
        last = unpack(r["last"]).astype(np.int64)
        s = slice(at, at + len(last))
        values = _gathered(mine, offset[s], windows[s])
        values = np.where(values < np.repeat(last, windows[s]), values, NO_ID)  # else no document of the group is later
        out.append((r["gid"], 2, r["part"], pack(values)))
        at = s.stop
    return _table(out, ANSWER)


RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary(), "kept_sha256": pa.string()}
RESULT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"


def _cut(with_bytes: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], RESULT)
        group = Group(docs)
        strings = Strings(group, _joined(answers, 1))
        least = _joined(answers, 2)
        windows = strings.sizes - LENGTH + 1
        offset = np.cumsum(windows) - windows
        covered = np.zeros(len(group.all) + 1, np.int32)
        step = CHUNK >> 2
        for k in range(0, len(strings.of), step):  # occurrences, some at a time
            of, start, doc = strings.of[k : k + step], strings.start[k : k + step], strings.doc[k : k + step]
            n = windows[of]
            earliest = _gathered(least, offset[of], n)
            where = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            hit = where[earliest < np.repeat(group.number[doc], n)]
            covered[hit] += 1  # a window is in one string: no place comes twice
            covered[hit + LENGTH] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        rows = []
        for i, (doc_id, text, base, size) in enumerate(zip(group.ids, group.texts, group.base.tolist(), group.sizes.tolist(), strict=True)):
            cut = gone[base : base + size]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
            kept = group.all[base : base + size][~cut].tobytes() if len(edges) else text
            spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            rows.append((doc_id, size, int(cut.sum()), spans, kept if with_bytes else None, hashlib.sha256(kept).hexdigest()))
        return _table(rows, RESULT)

    return run


def without_repeats(docs: DataFrame, group_bytes: int = 5 << 20, many: int = MANY, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_sha256): each text's bytes without those that an earlier document's LENGTH-byte strings cover.

    Anchors, chosen by the bytes around them, are counted over all documents; only strings around anchors that occur twice or
    more travel. Equal strings meet in the task of their anchor's range of keys, where those that are equal in part only are
    held against each other by a suffix array (induced sorting) and permuted common prefixes. An anchor with more than
    ``many`` occurrences sends its strings singly to the ranges of their own hashes, so no range gathers a hot passage.
    Null text is empty; texts under LENGTH bytes are left whole. Rows that repeat a doc_id are the same document: they do
    not count as earlier ones for each other. Without a doc_id a row comes last and is never the earlier one. An empty table
    gives an empty result; other columns are not read; a text of any length is one value. Hashes order strings, bytes decide which are equal.
    """
    groups = group_count(docs, group_bytes)
    texts = dealt(docs, groups)
    requests = texts.groupBy("gid").applyInArrow(_ask(groups), REQUEST_SQL)
    common = staged(requests.repartitionById(groups, "part").groupBy("part").applyInArrow(_common_anchors(many), ANSWER_SQL), "anchors")
    mine = lambda x: x.repartitionById(groups, "gid").groupBy("gid")
    strings = texts.groupBy("gid").cogroup(mine(common)).applyInArrow(_send(groups), STRINGS_SQL)
    earliest = staged(strings.repartitionById(groups, "part").groupBy("part").applyInArrow(_answer_strings, ANSWER_SQL), "earliest")
    return texts.groupBy("gid").cogroup(mine(common.unionByName(earliest))).applyInArrow(_cut(with_bytes), RESULT_SQL)


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs, with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
p AS (SELECT doc_id, h, unnest(range(n_bytes - 49)) AS pos FROM n WHERE n_bytes >= 50),
w AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 100)) AS s FROM p),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, pos FROM w JOIN m USING (s) WHERE first < doc_id),
run AS (SELECT doc_id, pos, sum(CASE WHEN pos - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nr
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM hit)),
span AS (SELECT doc_id, nr, min(pos) AS a, max(pos) + 50 AS b FROM run GROUP BY ALL),
gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM span UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(gap.b, n_bytes) - a)), '' ORDER BY a) AS h FROM gap JOIN n USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
