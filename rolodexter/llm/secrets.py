"""Secret scans with a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import text_of, trimmed

try:  # the parser of the standard library's regular expressions
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # pragma: no cover - before Python 3.11
    import sre_constants
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. A match counts if its group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's three kinds, in its order, then further well-known token formats.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A Boolean query: True (anything), ("tri", t), ("and", parts) or ("or", parts).
Query = object
MOST_EXACT = 64


def _both(op: str, parts: list[Query]) -> Query:
    if op == "or" and (not parts or any(p is True for p in parts)):
        return True
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _grams(text: str) -> Query:
    data = text.encode("utf-8", "surrogatepass")
    return _both("and", [("tri", data[i : i + 3]) for i in range(len(data) - 2)])


def _folded(code: int) -> str:
    """A character as the index holds it: only A-Z change."""
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that the items can match, or None if too many; a query that every match satisfies). Letters are lower case."""
    exact: set[str] | None = {""}
    found: list[Query] = []

    def close() -> None:
        nonlocal exact
        if exact:
            found.append(_both("or", [_grams(x) for x in exact]))
        exact = None

    for op, arg in items:
        inner: set[str] | None = None
        query: Query = True
        if op is sre_constants.LITERAL:
            inner = {_folded(arg)}
        elif op is sre_constants.SUBPATTERN:
            inner, query = _walk(arg[-1])
        elif op is sre_constants.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in sides):
                inner = set().union(*(s for s, _ in sides))
            query = _both("or", [q if s is None else _both("or", [_grams(x) for x in s]) for s, q in sides])
        elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[1] == 1:
            inner, query = _walk(arg[2])
            if arg[0] == 0:
                inner, query = (None if inner is None else inner | {""}), True
        elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0]:
            inner, query = _walk(arg[2])
            query, inner = (query if inner is None else _both("or", [_grams(x) for x in inner])), None
        elif op is sre_constants.IN and all(k is sre_constants.LITERAL for k, _ in arg) and len(arg) <= 8:
            inner = {_folded(v) for _, v in arg}
        if inner is not None and exact is not None and len(inner) * len(exact) <= MOST_EXACT:
            exact = {a + b for a in exact for b in inner}
        else:
            close()
            exact = inner if inner is not None else {""}
            if inner is None:
                found.append(query)
    if len(found) == 0:
        return exact, True
    close()
    return None, _both("and", found)


def trigram_query(pattern: str) -> Query:
    """The Boolean query on trigrams of lower-case bytes that each match of the pattern satisfies; True if there is none."""
    exact, query = _walk(sre_parser.parse(pattern))
    return query if exact is None else _both("or", [_grams(x) for x in exact])


def _terms(query: Query) -> set[bytes]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*(_terms(p) for p in query[1]))


def _lower(text: str) -> bytes:
    """UTF-8 with A-Z in lower case: what the index is built on."""
    return text.encode("utf-8", "surrogatepass").lower()


class Index:
    """Posting lists of the wanted trigrams over one batch of texts: for each trigram the sorted rows that hold it."""

    def __init__(self, texts: list[bytes], terms: set[bytes]):
        self.rows = np.arange(len(texts))
        named = sorted(terms)
        slots = np.zeros(1 << 24, np.uint8 if len(named) < 256 else np.uint16 if len(named) < 65536 else np.uint32)
        slots[[int.from_bytes(t, "big") for t in named]] = np.arange(1, len(named) + 1)
        found: list[np.ndarray] = []
        at = 0
        while at < len(texts):  # a few MB at a time
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) < 4 << 20):
                n += len(texts[to]) + 2
                to += 1
            data = np.frombuffer(b"\0\0".join(texts[at:to]) + b"\0\0", np.uint8)
            starts = np.cumsum([0] + [len(x) + 2 for x in texts[at : to - 1]])
            code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
            hit = slots[code]
            where = np.flatnonzero(hit)
            row = np.searchsorted(starts, where, "right") - 1 + at
            found.append(np.unique(hit[where].astype(np.int64) << 32 | row))
            at = to
        # Each text is in one piece, so sorted by trigram and row the pieces' pairs are the posting lists.
        pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(pairs >> 32, np.arange(1, len(named) + 2))
        self.postings = {t: pairs[a:b] & 0xFFFFFFFF for t, a, b in zip(named, cuts, cuts[1:], strict=False)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return self.rows
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = sorted((self.candidates(p) for p in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, spans): for each row its secrets as array<struct<kind,start,end>>, by start, then in the rules' order.

    Each batch of rows is indexed by the trigrams that the rules' queries name; a rule's postings are intersected and
    united to candidates, and only those are matched. Rules without a mandatory trigram (hex) scan every row. Matches are
    leftmost and non-overlapping for each kind; those whose group is too short are dropped after matching. Null and empty
    texts have no spans; a text of any length is matched whole; spans that begin together go by the rules' order; repeated rows and null ids stay rows of
    their own; an empty table gives an empty result; no column but doc_id and text is read.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    terms = set().union(*map(_terms, queries))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            texts = batch["text"].tolist()
            index = Index([_lower(t) for t in texts], terms)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query, match) in enumerate(zip(rules, queries, compiled, strict=True)):
                for i in index.candidates(query).tolist():
                    for m in match.finditer(texts[i]):
                        a, b = m.span(rule.group)
                        if b - a >= rule.least:
                            spans[i].append((m.start(), k, m.end()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(trimmed(scan), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def op5_secrets(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *(of(r.kind) for r in BASE), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The contract's digest of spans that are in order."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
