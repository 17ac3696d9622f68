import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from ballotlens.llm import minhash, queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jp(x, y):
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def plain(x, y):
    return len(x.keys() & y.keys()) / max(1, len(x.keys() | y.keys()))


def classes(texts, ids):
    """Brute force over all pairs."""
    bags, parent = [bag(t) for t in texts], {i: i for i in ids}
    sizes = [len(b) for b in bags]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    where = {}
    for k, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(k)
    pairs = Counter(p for v in where.values() for p in itertools.combinations(v, 2))
    for (i, j), n in pairs.items():
        if n / (sizes[i] + sizes[j] - n) >= 0.8:
            a, b = find(ids[i]), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def made(seed):
    """A large family of near copies, chains, and texts that share much but not enough."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 60))
    base = [word() for _ in range(150)]
    out = []
    for _ in range(60):                       # near copies of one text, each with a few own words
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(150)] = word()
        out.append(" ".join(t))
    chain = [word() for _ in range(100)]      # each step changes a little more
    for _ in range(12):
        chain = chain[3:] + [word() for _ in range(3)]
        out.append(" ".join(chain))
    for _ in range(25):                       # half of the base, half of its own
        out.append(" ".join(base[:80] + [word() for _ in range(70)]))
    line = " ".join(word() for _ in range(8)) + "\n"
    out += [line * 20 + " ".join(word() for _ in range(n)) for n in (0, 2, 5, 30)]
    loud = "is on he " * 300              # one repeated line makes nothing alike
    out += [loud + " ".join(word() for _ in range(80)) for _ in range(4)]
    out += ["  A b C d e f ", "a b c d e f", "a b c d", "A B\tc d", "a b c e", "one", "ONE", "two"]
    out += [None, "", " \n", None]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    texts = made(seed)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == classes(texts, list(range(len(texts))))


def test_similarity_as_definition():
    r = random.Random(5)
    for _ in range(60):
        a, b = (" ".join(r.choice("xyz") + str(r.randint(0, 2)) for _ in range(r.randint(1, 60))) for _ in range(2))
        s, _, own = minhash.shingles([a, b])
        assert abs(minhash.similarity(s[own == 0], s[own == 1]) - plain(bag(a), bag(b))) < 1e-9


def damped(b):
    return {k: 1 + math.log(v) / 2 for k, v in b.items()}


def test_registers_estimate_probability_jaccard():
    r, errors = random.Random(6), []
    for _ in range(60):
        a = [str(r.randint(0, 99)) for _ in range(120)] + ["rep eat ed li ne"] * r.randint(0, 9)
        b = a[:r.randint(20, 120)] + [str(r.randint(0, 99)) for _ in range(20)]
        s, w, own = minhash.shingles([" ".join(a), " ".join(b), "", "short"])
        sig = minhash.registers(s, w, own, 4)
        errors.append((sig[0] == sig[1]).mean() - jp(damped(bag(" ".join(a))), damped(bag(" ".join(b)))))
        assert not sig[2].any()
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.17


def test_rows_of_one_id_null_ids_and_empty_table(spark):
    df = docs(spark, ["a b c d e f g", "x y z q r s t", "a b c d e f g", None])
    same = minhash.near_duplicates(df.unionByName(df)).collect()
    assert sorted((r.doc_id, r.class_id) for r in same) == [(0, 0), (1, 1), (2, 0), (3, 3)]
    null = df.withColumn("doc_id", df["doc_id"] * None)
    assert [tuple(r) for r in minhash.near_duplicates(null).collect()] == [(None, None)]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1900, 1990)]
    got = dict(tuple(x) for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i in parent} == {i: find(i) for i in parent}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_as_brute_force(spark, sf):
    rows = queries.documents(spark, sf).select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, sf).collect()}
    assert got == classes([r.text for r in rows], [r.doc_id for r in rows])


def crowd(monkeypatch):
    """All documents share one bucket."""
    monkeypatch.setattr(minhash, "buckets", lambda sketched: sketched.selectExpr("1L as bucket", "doc"))


def test_lone_pairs_in_a_crowded_bucket(spark, monkeypatch):
    """Each pair is a family of two; the bucket's least member is like neither."""
    r = random.Random(11)
    texts = []
    for _ in range(12):
        t = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
        texts += [" ".join(t), " ".join([*t[:-3], "x", "y", "z"])]
    texts = [" ".join(f"u{r.randint(0, 10**6)}" for _ in range(90)) for _ in range(6)] + texts
    crowd(monkeypatch)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == classes(texts, list(range(len(texts)))) and len(set(got.values())) == 18


@pytest.mark.parametrize("crowded", [True, False])
def test_similar_sets_of_unlike_counts(spark, monkeypatch, crowded):
    """One of each pair repeats half of what both share a hundred times."""
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 10**6)}"
    texts = []
    for _ in range(60):
        shared = [word() for _ in range(94)]
        texts += [" ".join(shared[:50] * 100 + shared[50:] + [word() for _ in range(5)]), " ".join(shared + [word() for _ in range(5)])]
    if crowded:
        crowd(monkeypatch)
    want = classes(texts, list(range(120)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == want and len(set(want.values())) == 60


def test_unit_signature_estimates_set_jaccard():
    r, errors = random.Random(13), []
    for _ in range(60):
        a = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
        b = a[:50] * r.choice([1, 9]) + a[50:r.randint(90, 120)]
        s, w, own = minhash.shingles([" ".join(a), " ".join(b)])
        sig = minhash.signatures(s, w, own, 2)
        assert (sig[:, 1] == minhash.registers(s, w, own, 2)).all()
        errors.append((sig[0, 0] == sig[1, 0]).mean() - plain(bag(" ".join(a)), bag(" ".join(b))))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.17


def test_unlike_texts_of_one_id_are_apart(spark):
    rows = [(1, "a b c d e f g"), (2, "k l m n o p q"), (7, "k l m n o p q"), (7, "r s t u v w x"), (8, "r s t u v w x"), (None, "A b c d e f g"), (None, "1 2 3 4 5 6"), (None, "5 6 7 8 9 0")]
    got = minhash.near_duplicates(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 2), (7, 2), (7, 7), (8, 7)]


def test_four_bits_agree_where_registers_do():
    r = np.random.default_rng(14)
    a = r.integers(0, 2**32, (50, 2, minhash.REGISTERS), dtype=np.uint32)
    a[::3, 1] = a[::3, 0]
    b = np.where(r.random(a.shape) < 0.5, a, r.integers(0, 2**32, a.shape, dtype=np.uint32))
    x, y = (minhash.unpack(minhash.pack(s)) for s in (a, b))
    want = ((a ^ b) & 15 == 0).sum(axis=2).max(axis=1)
    assert (minhash.agreement(x, y) == want).all() and (want >= minhash.agreement(a, b)).all()
    assert (minhash.agreements(x[:4], y) == [[minhash.agreement(i, j) for j in y] for i in x[:4]]).all()


def test_filter_of_keys_holds_all_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) as k1", "xxhash64('2', id) as k2")
    others = spark.range(20_000, 60_000).selectExpr("xxhash64(id) as k1", "xxhash64('2', id) as k2")
    held = minhash.key_filter(keys)
    assert keys.filter(held).count() == 20_000 and others.filter(held).count() < 4_000
    assert others.filter(minhash.key_filter(keys.limit(0))).count() == 0


def test_very_long_texts(spark):
    """Copies of two megabytes that differ in a few words, within one family."""
    r = random.Random(15)
    base = [f"w{r.randint(0, 10**5)}" for _ in range(300_000)]
    texts = [" ".join(base), " ".join(base[:-50]), " ".join([*base[100:], "end"]), " ".join(reversed(base)), "short one here to be alone"]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_blocks_are_bounded_by_bytes(spark):
    rows = [(1, 0, i, i, 1000, 1000 * minhash.BLOCK_BYTES // 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "bucket long, main long, doc long, root long, n long, size long")
    sizes = [len(x.ms) for x in minhash._blocks(df, "bucket", df["root"], "b").collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 150
