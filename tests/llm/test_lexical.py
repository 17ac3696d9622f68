import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ballotlens.llm import lexical_search as ls
from ballotlens.llm import queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in rows]
    bags = [(i, c) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in {(i, frozenset(words(t))) for i, t in items}:
        found = []
        for i, c in bags:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in text if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(150)] + ["été", "Straße", "日本", " x", "a1", "İ"]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice([5, 20, 156])]) + r.choice(["", ",", "\n", "-X"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(700)]
    rows += [(None, rows[3][1]), (None, None), (1, None), (2, ""), (3, "...!"), (5000, rows[3][1]), (-4, rows[3][1]), (4, rows[4][1]), (9000, "long " * 300_000 + "Straße")]
    r.shuffle(rows)
    items = [(i, text(r.randint(1, 25))) for i in range(30)] + [(50, None), (51, ""), (52, "nowhere-at-all"), (None, "a b c"), (0, "long straße"), (53, "日本  x")]
    return rows, items


def test_varint():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**35 - 1, 2**36, 5])
    coded, sizes = ls.varint(v)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 5, 6, 1] and ls.unvarint(coded).tolist() == v.tolist()
    assert ls.unvarint(ls.varint(v[:3])[0]).tolist() == [0, 1, 127] and len(ls.varint(v[:0])[0]) == 0


def test_terms_as_pattern():
    r = random.Random(6)
    for _ in range(300):
        t = "".join(r.choice("aZ09 _-\t\x0b\x85  éß日😀@[`{\x7f/:") for _ in range(r.randint(0, 40)))
        assert [w.decode() for p in ls.pieces(t.encode()) for w in p] == words(t)


@pytest.mark.parametrize("shard,item_bytes", [(40, 300), (100_000, 1 << 20), (7, 1 << 20)])
def test_as_brute_force(spark, shard, item_bytes):
    rows, items = corpus()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, score long, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items + items[:3]], "item_id long, text string, rank int")
    index = ls.build_index(df, shard_docs=shard)
    assert index.shards.count() >= 700 / shard
    got = ls.search(index, asked, item_bytes=item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)


@pytest.mark.parametrize("shard,block", [(40, 4), (5000, 8), (5000, 128)])
def test_shards_as_brute_force(monkeypatch, shard, block):
    """Small blocks, in one process; later shards start from the heap."""
    monkeypatch.setattr(ls, "BLOCK", block)
    rows, items = corpus()
    bags = [(i, words(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    weights = {t.encode(): ls.weight(n_docs, n) for t, n in df.items()}
    shards, b = [], ls.Builder(n_docs, n_terms)
    for i, t in rows:
        b.add(i, (t or "").encode())
        if len(b.ids) == shard:
            shards.append(b)
            b = ls.Builder(n_docs, n_terms)
    columns = [c.split()[0] for c in ls._SHARD.split(", ")]
    shards = [ls.Shard(dict(zip(columns, s.pack(), strict=True)), weights) for s in [*shards, b] if s.ids]
    out = []
    for item, t in items:
        heap = []
        for s in shards:
            found = s.search([(w, weights[w]) for w in {x.encode() for x in words(t)} if w in weights], 10, -heap[-1][0] if len(heap) == 10 else 0)
            heap = sorted(heap + [(-n, d >= len(s.ids), int(s.ids[d]) if d < len(s.ids) else 0) for d, n in found])[:10]
        out += [(item, r + 1, None if none else i, -n) for r, (n, none, i) in enumerate(heap)]
    assert sorted(out, key=str) == brute(rows, items)


def test_blocks_are_passed_over():
    """A rare term decides: of the frequent term's hundred blocks few are read."""
    b = ls.Builder(12_800, 128_000)
    for i in range(12_800):
        b.add(i, b"common " * (1 + i % 3) + (b"rare rare rare" if i % 640 == 7 else b"filler words here"))
    s = ls.Shard(dict(zip([c.split()[0] for c in ls._SHARD.split(", ")], b.pack(), strict=True)), {b"common", b"rare"})
    found = s.search([(b"common", 2), (b"rare", 5000)], 10, 0)
    assert len(found) >= 10 and s.blocks_read < 30


def test_empty(spark):
    assert ls.rank_documents(empty(spark), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert ls.rank_documents(docs(spark, ["a", "..."]), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert ls.rank_documents(docs(spark, [None, ""]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(queries.ORACLE_SQL["op12_lexical_search"])
    got = queries.op12_lexical_search(spark, sf).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall())
