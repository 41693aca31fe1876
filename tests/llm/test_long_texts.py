"""Texts of hundreds of kilobytes and columns of the operators' own names, through the operators that other tests give short texts only."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_training_data import brute_secrets, words_of

from rolodexter.llm import alignment, lm_scoring, media, queries, secrets, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, gid string, key string, spans string, pcm string, fp string, groups string, id string, members string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["er", "th", "on", "é", "ing", "a", "token=" + "x" * 12]) for _ in range(rng.randint(1, 3)))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, long[1000:1400]), (2, long), (3, long[:200_000]), (4, None), (5, ""), (6, "a"), (None, "x y z"), (2, long)]
    return spark.createDataFrame([(i, t, *["c"] * 8) for i, t in rows], SCHEMA).repartition(3).cache()


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_op3_long(docs):
    first: dict[bytes, int] = {}
    rows = {i: t.encode() for i, t in texts(docs) if i is not None}
    for i in sorted(rows, reverse=True):
        first |= dict.fromkeys((rows[i][k : k + 50] for k in range(len(rows[i]) - 49)), i)
    got = {r["doc_id"]: r for r in suffix_dedup.op3_suffix_dedup(docs.filter("doc_id is not null")).collect()}
    for i, data in rows.items():
        gone = np.zeros(len(data) + 1, np.int64)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k] += 1
                gone[min(k + 50, len(data))] -= 1
        kept = bytes(b for b, g in zip(data, np.cumsum(gone)[:-1] > 0, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(data), len(data) - len(kept), hashlib.sha256(kept).hexdigest())


def test_op5_long(docs):
    want = Counter((i, secrets.digest(brute_secrets(t))) for i, t in texts(docs))
    assert Counter((r["doc_id"], r["base_sha256"]) for r in secrets.op5_secrets(docs).collect()) == want


def test_op8_long(docs):
    def told(t):
        data = t.encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

    got = media.op8_media(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == Counter((i, *told(t)) for i, t in texts(docs))
    assert len({r["feature"] for r in got if r["doc_id"] == 2}) == 1


def test_op9_long(docs):
    rows = [(i, [*words_of(t), None]) for i, t in texts(docs)]
    part = lambda i: zlib.crc32(str(i).encode()) % 10 if i is not None else 0
    count = Counter(w for i, ws in rows for w in ws if part(i))
    total, kinds = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm_scoring.op9_lm_scoring(docs).collect()}
    for i, ws in rows:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert (got[i]["n_tokens"], got[i]["train_tokens"]) == (len(ws), total) and abs(got[i]["base_score"] - base) < 1e-6 * max(1, abs(base))


def test_op11_and_op13_long(docs):
    ids = Counter(r["doc_id"] for r in simhash.op11_simhash(docs).collect())
    assert ids == Counter(i for i, _ in texts(docs))
    one, two = alignment.ByteBpe(queries.BYTE_BPE), alignment.Pieces(queries.PIECES)
    for r in alignment.op13_alignment(docs, queries.BYTE_BPE, queries.PIECES).collect():
        text = next(t for i, t in texts(docs) if i == r["doc_id"])
        assert (r["n_a"], r["n_b"]) == ((len(one.library([text])[0]), len(two.encode([text])[0])) if text else (0, 0))
