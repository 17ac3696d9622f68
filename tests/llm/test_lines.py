import hashlib
import random

import duckdb
import pytest

from ballotlens.llm import line_dedup, queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty


def brute(texts, ids, min_docs, keep_first):
    where = {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        for p, x in enumerate((t or "").split("\n")):
            k = x.strip(" \t\n\x0b\x0c\r")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if k:
                where.setdefault(k, []).append((i, p))
    often = {k for k, v in where.items() if len({d for d, _ in v}) >= min_docs}
    drop = {x for k in often for x in (where[k][1:] if keep_first else where[k])}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in drop) for i, t in zip(ids, texts, strict=True)}


def made(seed, n):
    r = random.Random(seed)
    lines = ["Same", " same\t", "SAME", "É", "é", "x", "", "  ", "b c"]
    return ["\n".join(r.choice([*lines, f"rare{r.randint(0, 30)}"]) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts,few", [(1, None), (8, None), (8, 0), (40, None), (40, 0)])
def test_as_brute_force(spark, monkeypatch, keep_first, parts, few):
    """``few`` 0: totals too many to broadcast."""
    if few is not None:
        monkeypatch.setattr(line_dedup, "FEW_SUMMARIES", few)
    texts = [None, "", "\n\n", "same\nsame\nsame", *made(parts, 60), "k " * 50_000 + "\nsame"]
    df = docs(spark, texts)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        maps = line_dedup.keep_bitmaps(df, min_docs=4, keep_first=keep_first)
        got = {r.row.doc_id: r.kept for r in line_dedup.apply_bitmaps(df, maps).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == brute(texts, list(range(len(texts))), 4, keep_first)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, ["a\nb"] * 3 + ["a"])
    same = df.unionByName(df)
    out = line_dedup.apply_bitmaps(same, line_dedup.keep_bitmaps(same, min_docs=4)).collect()
    assert sorted((r.row.doc_id, r.kept) for r in out) == sorted([(i, "b") for i in range(3)] * 2 + [(3, "")] * 2)
    null = df.withColumn("doc_id", df["doc_id"] * None)
    assert line_dedup.keep_bitmaps(null, min_docs=2).count() == 0
    assert line_dedup.keep_bitmaps(null, min_docs=1).count() == 2
    assert line_dedup.apply_bitmaps(empty(spark), line_dedup.keep_bitmaps(empty(spark))).count() == 0


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(queries.ORACLE_SQL["op9_line_dedup"])
    df = queries.op9_line_dedup(spark, sf).select(*rel.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(rel.fetchall())


def test_hash_of_kept_text(spark):
    r = queries.op9_line_dedup(spark, SF_SMALL).filter("n_dropped = 0").first()
    text = queries.documents(spark, SF_SMALL).filter(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
