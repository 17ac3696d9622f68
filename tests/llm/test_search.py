import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlens.llm import decontamination as dc
from ballotlens.llm import knn, queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty


def least_distance(item, text):
    """Plain dynamic programming: item against any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers_as_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, n))) for n in (90, 120))
        assert dc.myers(a, b) == least_distance(a, b)


def test_matches_as_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    items = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(12)] + ["tiny", None, "", "exactly twelve"]
    items += ["Ab c", "q"]
    texts = [None, "", "tiny", "EXACTLY \n twelve", "a tiny-ish text", "tinytown destiny", "xab c", "ab\nC!", "q", "(q)", "quick", "\u00e9q"]
    for _ in range(40):
        t = list(" ".join(word() for _ in range(20)) + "\n" + (r.choice(items[:12]) if r.random() < 0.7 else "") + " " + " ".join(word() for _ in range(9)))
        for _ in range(r.choice([0, 1, 3, 6, 12])):
            t[r.randrange(len(t))] = r.choice(["", "x", "ab"])
        texts.append("".join(t).upper() if r.random() < 0.3 else "".join(t))
    texts.append("abc " * 60_000 + items[0] + " tail")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            c, b = dc.canonical(t or ""), dc.canonical(item or "")
            if 0 < len(b) < dc.MIN_CHARS:      # as it is, between word bounds
                if re.search(r"(?<![^\W_])" + re.escape(b) + r"(?![^\W_])", c):
                    want.add((d, i, 0))
            elif b:
                if len(c) > 10_000:
                    c = c[-500:]
                if (e := least_distance(b, c)) <= int(0.05 * len(b)):
                    want.add((d, i, e))
    df = docs(spark, texts)
    for block in (5, 1000):
        got = dc.matches(df.unionByName(df), bench.unionByName(bench), block_items=block).collect()
        assert len(got) == len(want) and {(x.doc_id, x.item_id, x.distance) for x in got} == want
    hold = {d for d, _, _ in want}
    for block in (5, 1000):          # several blocks, one automaton at a time
        left = dc.without_matches(df, bench, block_items=block)
        assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - hold and left.columns == df.columns
        assert left._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert dc.matches(empty(spark), bench).count() == 0
    assert dc.matches(df, bench.limit(0)).count() == 0


def test_query_finds_every_whole_item(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF_MID).collect()}
    bench = [(r.item_id, dc.canonical(r.text)) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    want = {(d.doc_id, i) for d in queries.documents(spark, SF_MID).collect() for i, t in bench if t in dc.canonical(d.text)}
    assert want and want <= got


def brute_top(rows, k):
    ok = [(i, [int(np.floor(np.float64(x) * 1024)) for x in e]) for i, e in rows
          if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = set()
    for i, e in ok:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in ok if j != i and len(f) == len(e))[:k]
            out |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s)}
    return out


@pytest.mark.parametrize("pivots,block", [(1, 7), (8, 50), (64, 8192)])
def test_top_k_as_brute_force(spark, pivots, block):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=5).tolist() if i % 3 else [0.5, -0.25, 0.0, 1.0, 2.0]) for i in range(401)]
    rows += [(None, [1.0] * 5), (500, None), (600, [1.0, None, 0.0, 0.0, 0.0]), (700, [float("nan")] * 5), (701, [float("inf")] * 5),
             (800, [1.0, 2.0]), (801, [3.0, -1.0]), (900, []), (901, []), (1000, [1e9] * 5)]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = knn.top_k(df, F.col("vec_id") % 100 == 0, k=10, n_pivots=pivots, block_rows=block, block_queries=2).collect()
    assert {tuple(x) for x in got} == brute_top(rows, 10) and len(got) == len({tuple(x) for x in got})
    assert knn.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_groups_are_passed_over():
    """Far clusters: a query goes to few groups."""
    r = np.random.default_rng(4)
    p = r.normal(size=(20, 8)) * 1000
    class Row:  # noqa: D106
        def __init__(self, **k):
            self.__dict__.update(k)
    s = knn.Summary({8: p}, [Row(dim=8, cell=c, n=50, radius=5.0, norm=1e9) for c in range(20)],
                    [Row(dim=8, cell=c, distance=float(d)) for c in range(20) for d in range(3)], 2, 10)
    assert len(s.groups_for(p[3])) < 5


def test_pivots_are_distinct_vectors(spark):
    """One id and one vector hold most rows: neither leaves the table with one pivot."""
    r = np.random.default_rng(5)
    rows = [(7, r.normal(size=3).tolist()) for _ in range(150)] + [(i, [1.0, 2.0, 3.0]) for i in range(5000)]
    df = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1024, "vec_id", "embedding")
    got = knn.pivot_sets(df)
    assert got[3].shape == (64, 3) and len({tuple(x) for x in got[3]}) == 64
    assert knn.pivot_sets(df, 500)[3].shape == (151, 3) and knn.pivot_sets(df.limit(0)) == {}
    assert (knn.pivot_sets(df.repartition(7))[3] == got[3]).all()


def test_repeated_rows_of_the_query_hide_no_answer(spark):
    """Every vector is a pivot and occurs twelve times: cells of no radius."""
    r = np.random.default_rng(8)
    rows = [(50 * c, r.normal(size=6).tolist()) for c in range(24)] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("vec_id") % 100 == 0, k=10, n_pivots=300).collect()
    assert {tuple(x) for x in got} == brute_top(rows, 10) and len(got) == 120


def test_queries_never_pass_the_driver(spark, monkeypatch):
    """Packs of queries are few long rows: their number must not make them a table to broadcast."""
    plans, lasting = [], knn.lasting

    def seen(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return lasting(df, name)

    monkeypatch.setattr(knn, "lasting", seen)
    r = np.random.default_rng(9)
    rows = [(10 * i, r.normal(size=6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("vec_id") % 100 == 0, k=10, block_rows=7, block_queries=4).collect()
    assert {tuple(x) for x in got} == brute_top(rows, 10)
    final = plans[0].split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and "SortMergeJoin" in final
    assert final.count("BroadcastHashJoin") <= 1      # the numbers of blocks, a row for each pivot


def test_blocks_are_bundled():
    """Small groups share a bundle, a large one has several, and no bundle is beyond its size."""
    class Row:  # noqa: D106
        def __init__(self, dim, cell, n):
            self.dim, self.cell, self.n = dim, cell, n
    r = random.Random(6)
    rows = [Row(d, c, r.choice([1, 5, 9, 30, 400])) for d in (2, 3) for c in range(200)]
    span, got = knn.bundles(rows, block_rows=10, bundle_rows=40, least=4)
    assert span == 4 and set(got) == {(x.dim, x.cell) for x in rows}
    held, of = {}, {}
    for x in rows:
        first, blocks = got[x.dim, x.cell]
        assert blocks == -(-x.n // 10)
        for b in range(blocks):
            held[first + b // span] = held.get(first + b // span, 0) + x.n / blocks
            of.setdefault(first + b // span, set()).add(x.dim)
    assert max(held.values()) <= 40 and sorted(held) == list(range(len(held))) and all(len(d) == 1 for d in of.values())
    assert 2 * len(held) < sum(blocks for _, blocks in got.values())
    assert knn.bundles([], 10)[1] == {}


@pytest.mark.parametrize("top", [3, 2**20, 2**26, 2**31])       # ties; sums that a double, a long, none of them holds
def test_local_best_as_brute_force(top):
    r = np.random.default_rng(top)
    data, queries = (r.integers(-top, top, size=(n, 5)) * (2**5 if top == 2**31 else 1) for n in (300, 150))
    ids, qids = r.integers(0, 200, size=300), r.integers(0, 220, size=150)
    want = []
    for i, q in enumerate(queries.tolist()):
        found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in zip(ids.tolist(), data.tolist()) if j != qids[i])[:10]
        want += [(i, j, max(-(2**63), min(2**63 - 1, -s))) for s, j in found]
    assert knn.local_best(ids, data, qids, queries, 10) == want


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rel = con.sql(queries.ORACLE_SQL["op10_top_k"])
    got = queries.op10_top_k(spark, sf).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall())
