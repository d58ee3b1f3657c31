"""Embeddings, MinHash and SimHash against all pairs."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from siltworks.llm import blocks, common, embeddings, minhash, simhash
from siltworks.llm.common import components
from siltworks.llm.words import sequence_hash, shingle_hashes, word_hashes


def classes(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        root = [root[r] for r in root]
        if root == before:
            return root
    return root


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(500, 600)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(500, 600), 1000], 500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [7, 1024])
def test_links_count_each_pair_once(spark, block, monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, (60, 4))
    x = rng.integers(0, 4, 60)
    items = spark.createDataFrame([(i, int(i % 3 + 1), bytes([v]), c.tolist()) for i, (v, c) in enumerate(zip(x, codes, strict=True))], "id long, weight long, payload binary, codes array<long>")

    def equal(a, b):
        return np.nonzero(np.array([y[0] for y in a])[:, None] == np.array([y[0] for y in b])[None, :])

    pairs = [(i, j) for i in range(60) for j in range(i) if x[i] == x[j] and (codes[i] == codes[j]).any()]
    for lean in (True, False):
        found = blocks.links(items, equal, block, lean).collect()
        n = Counter()
        for r in found:
            n[r.id] += r.n
        want = Counter()
        for i, j in pairs:
            want[i] += j % 3 + 1
            want[j] += i % 3 + 1
        assert n == want
        assert classes(60, [(r.id, r.root) for r in found]) == classes(60, pairs)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base, base[:10] + 0.12 * rng.normal(size=(10, 16)), base[:10] + 0.12 * rng.normal(size=(10, 16)), base[:4] * 2]).astype(np.float32)
    rows = [(int(i), [float(y) for y in x]) for i, x in enumerate(v)] + [(100, v[0].tolist())] * 3
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, []), (None, v[0].tolist()), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    ids = [r[0] for r in rows]
    w = np.array([r[1] for r in rows], float)
    w /= np.sqrt((w * w).sum(1))[:, None]
    near = w @ w.T >= 0.9
    np.fill_diagonal(near, False)
    root = classes(len(ids), list(zip(*np.nonzero(near), strict=True)))
    want = [(i, int(near[k].sum()), ids[root[k]], i == ids[root[k]]) for k, i in enumerate(ids)]
    want += [(i, 0, i, True) for i in (200, 201, 202, 203, 204, 207)] + [(None, 0, None, True), (205, 1, 205, True), (206, 1, 205, False)]
    assert got == sorted(want, key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_bag_min_hash_is_unbiased_for_multisets():
    rng = np.random.default_rng(4)
    for _ in range(3):
        u = rng.integers(0, 2**63, 50).astype(np.uint64)
        a, b = (np.repeat(u, rng.integers(0, 12, 50)) for _ in range(2))
        ca, cb = Counter(a.tolist()), Counter(b.tolist())
        j = (ca & cb).total() / (ca | cb).total()
        assert abs((minhash.bag_min_hash(a, 4000) == minhash.bag_min_hash(b, 4000)).mean() - j) < 0.035


def _brute(texts, width=5):
    bags = [Counter(shingle_hashes(word_hashes(t), width).tolist()) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if bags[i] and bags[j] and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()]


def test_minhash_against_all_pairs(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    rng = np.random.default_rng(5)
    for k, (_, t) in enumerate(rows[:25]):  # copies with a word changed here and there
        w = (t or "").split(" ")
        for p in rng.integers(0, len(w), max(1, len(w) // 60)):
            w[p] = "changed"
        rows.append((10_000 + k, " ".join(w)))
        rows.append((20_000 + k, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    pairs = _brute([t for _, t in rows])
    root = classes(len(rows), pairs)
    n = Counter(i for p in pairs for i in p)
    for k, (i, _) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id) == (n[k], rows[root[k]][0]), i
    kept = minhash.keep_one(df)
    assert kept.count() == len({root[k] for k in range(len(rows))}) and kept.columns == df.columns


def test_minhash_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in minhash.near_duplicates(odd).collect()), key=str)
    assert (5, 2, 4, False) in got and got.count((4, 2, 4, True)) == 2
    assert (None, 0, None, True) in got and {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)} <= set(got)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_minhash_of_one_id_with_several_texts_and_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(f"{k}{x}" for x in rng.integers(0, 10**6, 60)) for k in "abc")
    changed = b.replace(b.split(" ")[59], "changed")
    rows = [(1, a), (1, b), (2, changed), (3, a + " more"), (4, c), (4, c), (4, c.upper()), (4, c + " more"), (5, c), (6, None), (6, None), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(i, j) for i, j in _brute([t for _, t in rows]) if rows[i][0] is not None and rows[j][0] is not None]
    root = classes(len(rows), pairs)
    n = Counter(i for p in pairs for i in p)
    want = Counter((i, n[k], min(rows[x][0] for x in range(len(rows)) if root[x] == root[k]) if i else i) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_links, r.component_id) for r in minhash.near_duplicates(df).collect()) == want
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(df).collect()]
    assert len(kept) == 6 and {(1, a), (1, b), (6, None), (None, c)} <= set(kept) and kept.count((6, None)) == 2
    assert sum(i == 4 for i, _ in kept) == 1


def test_hot_keys_join_like_others(spark, monkeypatch):
    big = spark.createDataFrame([(k % 7 if k % 5 else 0, k) for k in range(3000)] + [(None, -1), (99, -2)], "k long, v long")
    small = spark.createDataFrame([(k, k * 10, sum((j % 7 if j % 5 else 0) == k for j in range(3000))) for k in range(8)], "k long, w long, n long")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        assert sorted(map(tuple, common.hot_join(big, small, ["k"], "n", 3002, how).collect()), key=str) == want
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for least in (0, 300, 10**6):
        hot = big.groupBy("k").count().withColumnRenamed("count", "n").where(f"n > {least}")
        assert sorted(map(tuple, common.salted_join(big, small, ["k"], hot).collect())) == want


def test_hash_sample_is_bounded_whatever_repeats(spark):
    one_id = spark.createDataFrame([("a", 1, f"t{k}") for k in range(1000)] + [("b", None, "same")] * 500 + [(None, 1, "x")], "label string, doc_id long, text string")
    got = common.hash_sample(one_id, "label", ["doc_id", "text"], 150).collect()
    assert Counter(r.label for r in got) == {"a": 150, "b": 1} and len({r.text for r in got}) == 151
    again = common.hash_sample(one_id.repartition(7), "label", ["doc_id", "text"], 150).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert common.hash_sample(one_id.limit(0), "label", ["doc_id", "text"], 5).count() == 0


def test_simhash_rows_and_neighbours(spark, documents, odd):
    for df in (documents, odd):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in simhash.report(df).collect())
        want = []
        for k, (i, t) in enumerate(rows):
            t, follows = t or "", rows[(k + 1) % len(rows)][1] or ""
            half = len(t) // 2
            e = t[: len(t) - half] + follows[:half]
            a, b, c = (simhash.fingerprint(x, 5) for x in (t, e, follows))
            want.append((i is not None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)))
        assert got == sorted(want)
    near = simhash.report(documents).collect()
    prints = [int(r.fingerprint, 16) for r in near]
    assert [r.n_near for r in near] == [sum((x ^ y).bit_count() <= 6 for y in prints) - 1 if x else 0 for x in prints]
    assert simhash.report(odd.limit(0)).count() == 0


def test_simhash_with_larger_tables(spark, monkeypatch):
    """Pairs of blocks as tables, as for very many items."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, (40, 128))
    near = base[rng.integers(0, 40, 80)].copy()
    for row in near:
        row[rng.choice(128, rng.integers(1, 10), replace=False)] ^= 1
    prints = list({np.packbits(x).tobytes() for x in np.concatenate([base, near])})
    df = spark.createDataFrame([(bytearray(x), 1 + k % 2) for k, x in enumerate(prints)], "fp binary, weight long")
    p, many = simhash.Params(), simhash.tables(1 << 28, simhash.Params())
    assert len(simhash.tables(100, p)) == 7 and len(many) == 28
    monkeypatch.setattr(simhash, "tables", lambda n, p: many)
    got = {bytes(r.fp): r.n_near for r in simhash.neighbours_of(df, p).collect()}
    n = [int.from_bytes(x) for x in prints]
    for k, x in enumerate(prints):
        assert got[x] == sum(1 + j % 2 for j in range(len(n)) if (n[j] ^ n[k]).bit_count() <= 6) - 1


def test_word_hashes():
    a = word_hashes("The quick, brown FOX! über 42")
    assert len(a) == 6 and (a == word_hashes("the QUICK brown fox ÜBER 42")).all()
    assert len(word_hashes(None)) == len(word_hashes(" ..")) == 0
    assert len(shingle_hashes(a, 5)) == 2 and len(shingle_hashes(a[:3], 5)) == 1
    assert sequence_hash(a) != sequence_hash(a[::-1])
