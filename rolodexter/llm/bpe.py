"""BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import give_back

#: Added to the last character of a word: it stands for the character with the end-of-word suffix.
END = 0x2000
WIDTH = 20  # bits of an id


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def unassigned() -> re.Pattern:
    """Any code point that this Python's Unicode tables lack."""
    lacks = [unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)] + [False]
    edges = [c for c in range(0x110001) if lacks[c] != lacks[c - 1]]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]")


class Bpe:
    """A vocabulary file of the tokenizers library: byte-level BPE with a word-end suffix, pre-split by a pattern.

    encode_word() finds the last token of each prefix of a word. A token that ends there is the last one of the prefix's
    encoding if and only if it can follow the last token of the prefix before it, so there is exactly one, and the
    encoding is read off from the end.
    """

    def __init__(self, path: str, memory: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.token_text: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_text |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.ascii_pieces = re.compile(pattern.replace(r"\s", r" \t-\r").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"))
        self.rare, self.unassigned = re.compile("[^\0-\u024f]"), unassigned()
        self.path = path
        self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.letters = dict(enumerate(byte_letters()))
        # Tokens as strings of symbols; a symbol with the suffix is one character.
        inner = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + END) if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, tuple[int, str, str]] = {}
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            a, b = inner(a), inner(b)
            self.rank[self.ids[a] << WIDTH | self.ids[b]] = k
            made.setdefault(a + b, (k, a, b))
        self.made = {self.ids[t]: (k, self.ids[a], self.ids[b]) for t, (k, a, b) in made.items()}
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or i in self.made:
                self.trie.add_word(t, (i, len(t)))
        self.trie.make_automaton()
        self.edges: dict[int, list[tuple[int, float]]] = {}
        self.follows: dict[int, bool] = {}
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's left (0) or right (1) edge while it is built, each with the merge that ends it."""
        key = token << 1 | side
        out = self.edges.get(key)
        if out is None:
            out, until, at = [], float("inf"), token
            while True:
                out.append((at, until))
                if at not in self.made:
                    break
                until, *parts = self.made[at]
                at = parts[side]
            self.edges[key] = out
        return out

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether a then b stay apart: no merge across the border comes before the merges that hide its parts. Of equal merges the left one goes first."""
        found, rank, right = True, self.rank, self._edge(b, 0)
        for x, end_x in self._edge(a, 1):
            x <<= WIDTH
            for y, end_y in right:
                k = rank.get(x | y)
                if k is not None and k < end_x and k <= end_y:
                    found = False
        if len(self.follows) >= 500_000:
            self.follows.clear()
        self.follows[a << WIDTH | b] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """word: symbols, the last one with END."""
        whole = self.ids.get(word)
        if whole is not None and (len(word) == 1 or whole in self.made):
            return [whole]
        n = len(word)
        last, size, follows = [-1] * n, [0] * n, self.follows
        for end, (token, length) in self.trie.iter(word):
            if last[end] < 0:
                if length <= end:
                    before = last[end - length]
                    if before < 0:
                        continue
                    fits = follows.get(before << WIDTH | token)
                    if not (self._can_follow(before, token) if fits is None else fits):
                        continue
                last[end], size[end] = token, length
        out, at = [], n - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError(f"no token for {word[at]!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _letters(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, packed; remembered up to a bound."""
        word = self._letters(piece)
        ids = self.encode_word(word[:-1] + chr(ord(word[-1]) + END))
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 32:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of the normalised text. No piece holds white space, so runs of it need no replacing."""
        if text.isascii():
            return self.ascii_pieces.findall(text.lower())
        if self.rare.search(text) and self.unassigned.search(text):
            return self.newer_pieces(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by character: no final sigma
        return self.pieces.findall(text.lower())

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own reading of the file, loaded when a text first needs it."""
        return Tokenizer.from_file(self.path)

    def newer_pieces(self, text: str) -> list[str]:
        """Pieces of a text with characters that this Python's Unicode tables lack: the library that reads the file may know them."""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in p).decode("utf-8", "replace") for p, _ in split]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                for piece in self.split(part):
                    ids = known.get(piece)
                    out.append(self._piece(piece) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' texts with spaces between, as a file without a decoder says; special tokens too."""
        text = self.token_text
        return " ".join([text[i] for i in memoryview(ids).cast("I").tolist()])


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One for each task of a Python worker."""
    return Bpe(path)


SLICE = 256  # rows of an Arrow batch that are handled at a time


def _tokenized(docs: DataFrame, path: str, decoded: bool) -> DataFrame:
    added = ["ids", "n_tokens", "decoded"][: 3 if decoded else 2]
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    types = dict(ids=T.BinaryType(), n_tokens=T.LongType(), decoded=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, SLICE):
                    part = batch.slice(k, SLICE)
                    ids = [bpe.encode(t or "") for t in part["text"].to_pylist()]
                    new = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                    if decoded:
                        new.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names)
        finally:
            loaded.cache_clear()  # a worker lives on and may have other work to do
            del bpe
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, types[n]) for n in added)]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens``.

    Null counts as the empty text, which has no tokens. A piece of text is remembered with its ids, up to a bound; memory
    else is that of one batch. Repeated rows are encoded alike; other columns are kept, those of these names replaced. The
    vocabulary file must be at ``path`` on every executor.
    """
    return _tokenized(docs, path, False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode(), and ``decoded``: the text that the ids decode to; in one pass, so that each worker loads one vocabulary."""
    return _tokenized(docs, path, True)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with ``decoded``, from ``ids``; null ids count as none."""

    @F.pandas_udf("string")
    def texts(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in ids:
            yield pd.Series([bpe.decode(x) for x in batch])

    return tokens.withColumn("decoded", texts(F.coalesce("ids", F.lit(b""))))


def op2_bpe(docs: DataFrame, path: str) -> DataFrame:
    tokens = round_trip(docs.select("doc_id", "text"), path)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
