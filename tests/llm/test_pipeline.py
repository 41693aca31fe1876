"""The pipeline's stages, each on what the one before kept."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rolodexter.llm import queries  # noqa: E402


def test_stages_take_effect(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs.count()
        if name != "bpe":
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
    assert seen["language"] >= seen["exact_dedup"] > seen["near_dedup"] > 0
    assert seen["mixture"] == seen["bpe"]
    assert docs.filter("octet_length(ids) = 4 * n_tokens").count() == seen["bpe"]


def test_run_by_brute_force(spark, tmp_path):
    """Every row of run() on a table with planted exact and near copies, texts without letters, noise and nulls, against plain Python and the library."""
    import math
    import random
    import re
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from test_training_data import brute_near, fill, plain_grams, plain_profile
    from tokenizers import Tokenizer

    rng = random.Random(21)
    parts = {"en": ["the", "ing", "and", "wo", "ter"], "de": ["der", "sch", "ung", "ein", "ß"]}
    said = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, said(lang := rng.choice(["en", "de"]), rng.randint(30, 90)), lang, rng.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", i), rows[i][2], "a") for i in range(8)]
    rows += [(200 + i, rows[i + 10][1] + " " + said("en", 1), rows[i + 10][2], "b") for i in range(8)]
    rows += [(300, None, None, "a"), (301, "12 34!", "en", "a"), (302, "", None, None), (303, "日本語のテキスト", None, "b"), (304, "zq xj vk qz jx kv qq", None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    counts = defaultdict(Counter)
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None:
            counts[lang] += plain_grams(t)
    profiles = {lang: plain_profile(c) for lang, c in counts.items()}

    def score(t):
        own = plain_profile(plain_grams(t))
        return max(1 - sum(abs(p.index(g) - k) if g in p else 300 for k, g in enumerate(own)) / (300 * len(own)) for p in profiles.values())

    left = {i: (t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t) and score(t) >= 0.25}
    assert not {300, 301, 302, 303} & set(left)
    groups = defaultdict(list)
    for i, (t, _) in left.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    left = {i: left[i] for i in (min(g)[1] for g in groups.values())}
    heads = {i: head for i, (_, head) in brute_near({i: t for i, (t, _) in left.items()}, 5, 80).items()}
    assert any(i != h for i, h in heads.items()) and len(groups) < len(rows) - 8
    left = {i: left[i] for i, h in heads.items() if i == h}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in left.items()}
    of = Counter()
    for i, (_, s) in left.items():
        of[s] += size[i]
    target, times = fill(of), Counter(r["doc_id"] for r in got)
    assert set(times) <= set(left)
    for s in of:
        taken = sum(size[i] * times[i] for i, (_, x) in left.items() if x == s)
        assert abs(taken - target[s]) <= max(size[i] for i, (_, x) in left.items() if x == s)
    for i, (_, s) in left.items():
        assert math.floor(target[s] / of[s] + 1e-9) <= times[i] <= math.ceil(target[s] / of[s] - 1e-9)
    library = Tokenizer.from_file(queries.TOKENIZER)
    for r in got:
        want = library.encode(left[r["doc_id"]][0], add_special_tokens=False).ids
        assert (r["text"], r["source"]) == left[r["doc_id"]] and r["n_tokens"] == len(want)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_exact_dedup_sql(spark, sf_dir, duck):
    got = queries.QUERIES["op1_exact_dedup"](spark, sf_dir)
    want = duck.execute(queries.ORACLE_SQL["op1_exact_dedup"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
