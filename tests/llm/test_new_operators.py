"""SimHash, whitening and tokenizer alignment against brute force, on small tables with every odd row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rolodexter.llm import alignment, queries, simhash, whitening

SCHEMA = "doc_id long, text string, lang string, fp string, component_id string, n_a string, groups string, its_text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["er", "th", "on", "é", "ing", "ß", "a", "日本", " "]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(40, 200))) for _ in range(15)]
    near = [" ".join(w if rng.random() > 0.01 else word() for w in base[k % 4].split()) for k in range(40)]
    odd = [None, "", "  \n\t", "x", "Two words", " two\tWORDS", "one two three four", "\x00\x1c control \x85", "😀 emoji <|endoftext|> <s> <unk>", "A" * 3000, "▁ is no space", "tab\t\ttab\n\n\n   spaces", base[0], base[0].upper(), " ".join(base) * 150]
    rows = [(i * 7, t, None if i % 2 else "en", "f", "c", "n", "g", "t") for i, t in enumerate(base + near + odd)]
    rows += [(None, base[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[0], rows[20]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain_fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit=4):
    """{id: smallest id reachable}; prints: {id: fingerprint}"""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op11_against_brute_force(docs):
    got = simhash.op11_simhash(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{plain_fingerprint(r.text):016x}") for r in rows)
    exp = plain_components({i: f for i, f in prints.items() if i is not None})
    assert all(r.component_id == exp.get(r.doc_id) for r in got)
    assert len({r.component_id for r in got}) < len(exp)


@pytest.mark.parametrize("shard_rows, block_rows", [(40, 8192), (100000, 37), (20, 50)])
def test_simhash_shards_lose_no_pair(spark, shard_rows, block_rows):
    """Clusters, a chain at the limit, one 16-bit field shared by a third of all, in small shards and blocks."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(200)]
    for k in range(150):
        x = prints[k % 12]
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints += [rng.getrandbits(48) << 16 | 0xBEEF for _ in range(150)]
    x = rng.getrandbits(64)
    for _ in range(20):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        prints.append(x)
    heads = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(dict.fromkeys(prints))], "id long, fp long").repartition(4)
    shards = simhash.routed(heads, simhash.trees(heads, 4, shard_rows))
    cells = simhash.blocked(shards, block_rows)
    largest = cells.groupBy("tree", "leaf", "point_block", "ask_block").count().agg(F.max("count")).first()[0]
    assert largest <= min(4 * block_rows, 4 * len(prints))
    links = simhash.linked(cells, 4).collect()
    exp = plain_components({i: p for i, p in enumerate(dict.fromkeys(prints))})
    root = {i: i for i in exp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.u), find(r.v)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in root} == exp
    assert len(links) <= shards.count() * 2


def test_tree_search_visits_less_than_all():
    """A far cluster is pruned by the triangle bounds, and links hold all pairs within the limit."""
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 8, 600, dtype=np.uint64)
    far = near ^ np.uint64(0xFFFFFFFFFFFF0000)
    fps = np.concatenate([near, far])
    links = simhash.Links(len(fps))
    every = np.arange(len(fps))
    simhash.search(fps, every, every, 1, links)
    exp = plain_components(dict(enumerate(int(f) for f in fps)), 1)
    assert links.root.tolist() == [exp[i] for i in range(len(fps))]
    tree = simhash.grown(np.arange(65536, dtype=np.uint64), np.ones(65536), 256, 0, 0xFFFF, 1)
    rows, leaves, homes = tree.routes(np.arange(0, 65536, 97, dtype=np.uint64))
    leaf_of = np.zeros(65536, np.int64)
    r, at, h = tree.routes(np.arange(65536, dtype=np.uint64))
    leaf_of[r[h]] = at[h]
    met = set(zip(rows.tolist(), leaves.tolist(), strict=True))
    for k, v in enumerate(range(0, 65536, 97)):
        assert {(k, int(leaf_of[v ^ x])) for x in [0, *(1 << b for b in range(16))]} <= met
    assert len(met) < 0.2 * len(set(leaf_of.tolist())) * len(range(0, 65536, 97)) and homes.sum() == len(range(0, 65536, 97))


def test_simhash_of_an_empty_table(spark, docs):
    assert simhash.op11_simhash(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert simhash.op11_simhash(alone).collect()[0].component_id is None


def plain_whitening(rows):
    """{vec_id: ([x], deviation)}, distinct x, eigenvalues, eigenvectors, sums"""
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([x for _, x in good]), axis=0)
    sums = fit.sum(axis=0)
    centred = fit - sums / len(fit)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return good, len(fit), sums, values[::-1], vectors[:, ::-1]


VECTORS = "vec_id long, embedding array<float>, label int, x string, deviation string, whitened string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    data = (rng.normal(size=(300, 7)) * np.array([3, 2.2, 1.5, 1, 0.7, 0.4, 0.1]) + 5).astype(np.float32).tolist()
    rows = [(i, v, i, "x", "d", "w") for i, v in enumerate(data)]
    rows += [(1000 + i, data[3], None, None, None, None) for i in range(200)] + rows[:5]
    rows += [(2000, None, 1, "x", "d", "w"), (2001, [], 1, "x", "d", "w"), (2002, [1.0, None, *[0.0] * 5], 1, "x", "d", "w"), (2003, [float("nan")] + [0.0] * 6, 1, "x", "d", "w"), (2004, [float("-inf")] + [0.0] * 6, 1, "x", "d", "w"), (None, data[9], 1, "x", "d", "w")]
    return spark.createDataFrame(rows, VECTORS).repartition(13)


def test_op12_against_numpy(vectors):
    good, n, sums, values, basis = plain_whitening([(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()])
    got = whitening.op12_whitening(vectors).collect()
    assert len(got) == 4 * len(good)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    side = {}
    for k in range(4):
        exp = {i: float((x - sums / n) @ basis[:, k] / np.sqrt(values[k])) for i, x in good}
        rows = [r for r in got if r.component == k + 1]
        side[k] = np.sign(sum(r.whitened * exp[r.vec_id] for r in rows))
        assert max(abs(r.whitened - side[k] * exp[r.vec_id]) for r in rows) < 1e-9
        assert abs(rows[0].explained - values[k] / values.sum()) < 1e-12
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in good}
    assert all(r.deviation == exact[r.vec_id] for r in got)


def test_whitening_keeps_every_dimension(vectors):
    rows = whitening.quantised(vectors)
    fit = rows.select("x").distinct()
    model = whitening.fitted(fit)
    assert model.rank == 7
    white = np.array(whitening.whitened(fit, model).select("whitened").toPandas()["whitened"].tolist())
    assert np.allclose(white.T @ white / len(white), np.eye(7), atol=1e-9)
    back = (white * np.sqrt(model.values)) @ model.vectors + np.array(model.sums) / model.n
    assert np.allclose(sorted(map(tuple, np.rint(back).astype(int))), sorted(map(tuple, (list(r.x) for r in fit.collect()))))
    assert whitening.whitened(rows, model).columns == ["vec_id", "embedding", "label", "x", "deviation", "whitened"]


def test_merging_equals_one_decomposition():
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (500, 6)) + 70000
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 1), (1, 3), (3, 200), (200, 500))]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.merged(total, p)
    centred = x - x.mean(axis=0)
    assert total.n == 500 and list(total.sums) == x.sum(axis=0).tolist()
    assert np.allclose(total.basis.T @ total.basis, centred.T @ centred, rtol=1e-10)
    big = np.array([[2**61, -(2**61)]] * 9)
    assert whitening.exact_sums(big) == (9 * 2**61, -9 * 2**61)


def test_whitening_of_odd_tables(spark, vectors):
    assert whitening.op12_whitening(vectors.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = whitening.op12_whitening(one).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got} == {(i, k, 1, 0, None, None) for i in (1, 2) for k in (1, 2)}
    two = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [3.0, 4.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.component, r.whitened if r.whitened is None else round(abs(r.whitened), 9), round(r.explained, 9)) for r in whitening.op12_whitening(two).collect())
    assert got[:3] == [(1, 1, 1.0, 1.0), (1, 2, None, 0.0), (1, 3, None, 0.0)]
    wide = spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.op12_whitening(wide).collect()} == {None}  # exceeds a long


def plain_alignment(texts):
    """A row of contract values for each text, by plain loops."""
    one, two = alignment.ByteBpe(queries.BYTE_BPE), alignment.Pieces(queries.PIECES)
    found, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = one.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.model.encode(text) if text else []
        if not text or b"".join(one.bytes[i] for i in a) != whole or b"".join(two.bytes[i] for i in b) != whole:
            found.append(None)
            continue
        ends = [np.cumsum([len(side.bytes[i]) for i in ids]).tolist() for side, ids in ((one, a), (two, b))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i0, j0 = i, j
            while i < len(a) and ends[0][i] <= cut:
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                j += 1
            groups.append((a[i0:i], b[j0:j]))
        links = Counter((u, v) for left, right in groups for u in left for v in right)
        held.update(links.keys())
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = f
            shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
            yield a, b, len(groups), sum(links.values()), sum(m for k, m in links.items() if held[k] == best[k[0]]), sum(m * held[k] for k, m in links.items()), hashlib.sha256(shown.encode()).hexdigest()


def test_op13_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    exp = Counter((r.doc_id, *v) for r, v in zip(rows, plain_alignment([r.text for r in rows]), strict=True))
    got = alignment.op13_alignment(docs, queries.BYTE_BPE, queries.PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == exp
    assert alignment.op13_alignment(docs.limit(0), queries.BYTE_BPE, queries.PIECES).count() == 0


def test_alignment_keeps_other_columns_and_gives_groups(docs):
    out = alignment.aligned(docs, queries.BYTE_BPE, queries.PIECES)
    assert set(out.columns) == {"doc_id", "lang", "fp", "component_id", "its_text", "n_a", "n_b", "n_groups", "groups", "pair_keys", "pair_times"}
    row = out.filter("n_a between 2 and 9").first()
    assert row.groups.count(";") == row.n_groups - 1 and row.its_text == "t"
    none = out.filter("doc_id is null and n_a = 0").first()
    assert none.groups == "" and none.n_groups == 0


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_large_groups(seed):
    """Groups of every size, large ones with repeated ids, and pieces smaller than a token's pairs, against plain counting."""
    rng = np.random.default_rng(seed)
    size = np.array([1, 2, 3, 5, 7])
    a, b = rng.integers(0, 5, 300), np.where(rng.random(400) < 0.5, 4, rng.integers(0, 5, 400))
    total = int(min(size[a].sum(), size[b].sum()))
    fit = lambda ids: ids[np.cumsum(size[ids]) <= total]
    a, b = fit(a), fit(b)
    a, b = (np.append(x, [0] * (total - int(size[x].sum()))).astype(np.int64) for x in (a, b))
    both = alignment.Alignment(a, b, size, size)
    exp = Counter()
    for g in range(both.n_groups):
        for u in a[both.group_a == g]:
            for v in b[both.group_b == g]:
                exp[int(u) << 32 | int(v)] += 1
    for piece in (3, 1 << 20):
        alignment.PAIRS, old = piece, alignment.PAIRS
        keys, times = both.pairs()
        alignment.PAIRS = old
        assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == exp and (np.diff(keys) > 0).all()
    one = alignment.Alignment(np.array([4] * 90 + [1]), np.array([1] + [4] * 90), size, size)  # one group of 91 by 91
    keys, times = one.pairs()
    assert times.sum() == 91 * 91 and len(keys) == 4


def test_byte_level_encoders_agree():
    """Every code point, long runs, and random texts: the fast way gives the library's ids."""
    bpe = alignment.ByteBpe(queries.BYTE_BPE)
    assert bpe.fast is not None
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{c}b {c} 1{c}2  {c}!{c}\n{c}" for c in every[k : k + 64]) for k in range(0, len(every), 64)]
    rng = random.Random(6)
    texts += ["".join(rng.choice(["the", " ", "\t", "\n", "'s", "é", "日", "😀", "1", "_", "A", "\u00a0", "\u2003"]) for _ in range(rng.randint(0, 200))) for _ in range(2000)]
    texts += ["A" * 5000, " " * 5000 + "x", "ab" * 1500 + " c"]
    assert bpe.encode(texts) == bpe.library(texts)


def test_shards_are_sorted_and_looked_up(spark, docs):
    rows = alignment.aligned(docs, queries.BYTE_BPE, queries.PIECES).cache()
    shards = alignment.count_shards(rows, 1 << 16)
    keys = [alignment.unpack(r.pair_keys).view(np.int64) for r in rows.select("pair_keys").collect()]
    exp = Counter(k for x in keys for k in x.tolist())
    distinct = np.array(sorted(exp), np.int64)
    assert shards.counts(distinct).tolist() == [exp[k] for k in distinct.tolist()]
    assert shards.counts(np.array([-5, (70000 << 32) + 1])).tolist() == [0, 0]
    assert all(np.all(np.diff(alignment.mapped_shard(u, n)[0]) > 0) for u, _, n in shards.files) and sum(n for _, _, n in shards.files) == len(exp)
    rows.unpersist()
