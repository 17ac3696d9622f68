import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlens.llm import exact_dedup as ed
from ballotlens.llm import queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_primes_and_bases():
    for p in ed.PRIMES:
        assert p < 2**31 and all(p % d for d in range(2, 46341))
    assert all(1 < b < min(ed.PRIMES) for b in ed.BASES)


def test_terms_compose():
    r = random.Random(1)
    for n in (0, 1, 5, ed.CHUNK - 1, ed.CHUNK, 3 * ed.CHUNK + 7):
        data = r.randbytes(n)
        want = [0] * 4
        for x in reversed(data):
            want = [(w * b + x + 1) % p for w, b, p in zip(want, ed.BASES, ed.PRIMES)]
        assert ed.terms(data) == want
        cut = r.randint(0, n)
        parts = zip(ed.terms(data[:cut]), ed.terms(data[cut:], cut), ed.PRIMES)
        assert [(a + b) % p for a, b, p in parts] == want
    assert ed.terms(b"\0") != ed.terms(b"\0\0") != ed.terms(b"")


def rows_with_copies():
    r = random.Random(2)
    texts = [None, "", "a", "A", "a ", "é", "é", "x" * 300, "x" * 301, "hot " * 40] + ["".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(1000 + i, texts[9]) for i in range(200)]
    rows += [(None, "a"), (None, None), (None, "alone, no id"), (7, "a"), (7, "a"), (5000, "twice"), (5000, "twice"), (-3, "less"), (None, "less")]
    return rows


@pytest.mark.parametrize("chunk", [16, ed.CHUNK])
def test_as_brute_force(spark, chunk):
    rows = rows_with_copies()
    df = spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in rows], "doc_id long, text string, rid string, f1 long, group_size long, tag long").repartition(5)
    assert got(ed.exact_duplicates(df, chunk=chunk)) == brute(rows)


@pytest.mark.parametrize("chunk", [16, ed.CHUNK])
def test_texts_that_share_a_fingerprint(spark, chunk, monkeypatch):
    """Every base is 1 in the tasks: anagrams collide, and comparing tells them apart."""
    rows = [(i, "".join(random.Random(i % 30).sample("abcdefghijklmnopqrstuvwxyz", 26))) for i in range(120)] + [(200, "zz"), (201, "zz"), (202, "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    @F.arrow_udf(ed._TERMS)
    def weak(piece: ed.pa.Array, before: ed.pa.Array) -> ed.pa.Array:
        import pyarrow as pa
        sums = pa.array([sum(x) for x in piece.to_pylist()], pa.int64())
        return pa.StructArray.from_arrays([sums] * 4, ["h1", "h2", "h3", "h4"])
    monkeypatch.setattr(ed, "hashed", lambda piece, before: weak(piece, before))
    assert got(ed.exact_duplicates(df, chunk=chunk)) == brute(rows)


def test_very_long_texts_and_empty_tables(spark):
    text = "".join(random.Random(3).choice("abc \n") for _ in range(ed.CHUNK * 3 + 11))
    rows = [(1, text), (2, text[:-1] + "z"), (3, text), (4, "z" + text[1:]), (5, None), (6, "")]
    assert got(ed.exact_duplicates(docs(spark, [t for _, t in rows], first=1))) == brute(rows)
    assert ed.exact_duplicates(empty(spark)).count() == 0


def test_rows_that_stay(spark):
    rows = rows_with_copies()
    df = spark.createDataFrame([(i, t, n % 7) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source long")
    kept = [(r.doc_id, r.text or "") for r in ed.without_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted(((i, t) for t, i in {t or "": k for (i, t) in rows for k in [max((j for j, u in rows if (u or "") == (t or "") and j is not None), default=None)]}.items()), key=str)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(queries.ORACLE_SQL["op13_exact_dedup"])
    want = sorted(rel.fetchall(), key=str)
    have = sorted((tuple(r) for r in queries.op13_exact_dedup(spark, sf).select(*rel.columns).collect()), key=str)
    assert have == want and any(r[rel.columns.index("group_size")] > 1 for r in want)
