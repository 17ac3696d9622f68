"""Queries over tables that are kept up to date: share totals by load, the page
index, the outreach table as a stream, the slim layout's swap; and a table of searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ballotlens.operators import incremental as inc
from ballotlens.operators import pages, search
from ballotlens.plans import fixtures as fx
from ballotlens.plans.catalog import REGISTRY, register
from ballotlens.plans.queries import FLAGSHIP_SQL, _scratch
from ballotlens.sources import buckets, sinks
from ballotlens.streaming import outreach as so

_ALL_FILES = 2**31 - 1      # a stream's run takes all files that are there in one batch
_OUTREACH_IDS = ["id", "account_hash_key", "proposal_master_skey", "director_master_skey"]


# ------------------------------------------------------------- J6 / A4 / A5
@register("incremental_totals", FLAGSHIP_SQL, ["proposals", "accounts"])
def q_incremental_totals(spark, sf):
    """Totals from three loads' partial sums, one load repeated, compacted after two."""
    path, compact = _scratch(spark, "share-partials"), _scratch(spark, "share-partials-compact")
    a = fx.accounts(spark, sf)
    for load in (0, 1, 1):
        inc.append_share_partials(a.filter(F.col("id") % 3 == load), path, f"day-{load}")
    inc.compact_partials(spark, path, compact)
    inc.append_share_partials(a.filter(F.col("id") % 3 == 2), compact, "day-2")
    return inc.totals_of_partials(fx.proposals(spark, sf), compact)


# ----------------------------------------------------------------------- O3
@register("page_numbers", """
SELECT id, issuer_name, (row_number() OVER (ORDER BY id DESC) - 1) // 50 + 1 AS page, (row_number() OVER (ORDER BY id DESC) - 1) % 50 + 1 AS place
FROM proposals""", ["proposals"])
def q_page_numbers(spark, sf):
    return pages.with_pages(fx.proposals(spark, sf).select("id", "issuer_name"), limit=50)


@register("page_index", """
WITH p AS (SELECT id, (row_number() OVER (ORDER BY id DESC) - 1) // 50 + 1 AS page FROM account_unvoted)
SELECT page, min(id) AS low, max(id) AS high, CAST(count(*) AS BIGINT) AS rows FROM p GROUP BY page""", ["account_unvoted"])
def q_page_index(spark, sf):
    return pages.page_index(pages.with_pages(fx.account_unvoted(spark, sf).select("id"), limit=50))


# ------------------------------------------------------------------ D2 / R1
@register("stream_insert_ignore", "WITH new_rows AS (" + REGISTRY["insert_ignore"].sql.replace("WITH ok AS", "WITH ok AS", 1) + ")\nSELECT "
          + ", ".join(_OUTREACH_IDS) + " FROM new_rows\nUNION ALL SELECT " + ", ".join(_OUTREACH_IDS) + " FROM outreach", ["account_unvoted", "outreach"])
def q_stream_insert_ignore(spark, sf):
    """Unvoted rows arrive in three loads by id, a batch each; the second batch
    is cut off between its write and its commit, and repeated."""
    src, table, ledger, ck = (_scratch(spark, f"stream-{n}") for n in ("src", "table", "ledger", "ck"))
    u = fx.account_unvoted(spark, sf)
    so.begin_table(fx.outreach(spark, sf).select(*_OUTREACH_IDS), table)
    low, high = u.agg(F.min("id"), F.max("id")).first()
    step = (high - low) // 3 + 1

    def cut(number):
        if number == 1:
            raise RuntimeError("cut off before the commit")

    for k in range(3):
        # a load has as many files as tasks that wrote it, and is a batch of its own whatever their number
        u.filter(F.col("id").between(low + k * step, low + (k + 1) * step - 1)).select(*_OUTREACH_IDS).write.mode("append").parquet(src)
        for before_commit in (cut, None) if k == 1 else (None,):
            try:
                so.stream_insert_ignore(spark, src, table, ledger, ck, max_files_per_trigger=_ALL_FILES, before_commit=before_commit)
            except Exception as e:  # noqa: BLE001 - the cut that this query makes itself
                if before_commit is None or "cut off before the commit" not in str(e):
                    raise
    return spark.read.parquet(table).select(*_OUTREACH_IDS)


# ------------------------------------------------------------------------ F2
#: a search for each supplier: brands, keys, wildcards, short terms, one without letters, none
_REQUESTS = """
SELECT s_suppkey AS request_id,
  CASE s_suppkey % 8 WHEN 0 THEN concat('brand#', CAST(s_nationkey AS VARCHAR(5))) WHEN 1 THEN concat('FK', CAST(s_suppkey AS VARCHAR(20)))
    WHEN 2 THEN concat('k', CAST(s_suppkey % 10 AS VARCHAR(5)), '_', CAST(s_nationkey % 10 AS VARCHAR(5))) WHEN 3 THEN 'LUE%w_d'
    WHEN 4 THEN CAST(s_nationkey AS VARCHAR(5)) WHEN 5 THEN substr(s_name, 1, 5) WHEN 6 THEN 'r%k1' ELSE CASE WHEN s_nationkey % 2 = 0 THEN '____________' END END AS term
FROM supplier"""


@register("search_many", f"""
SELECT r.request_id, p.id, p.final_key FROM ({_REQUESTS}) r JOIN proposals p
  ON coalesce(r.term, '') = '' OR p.issuer_name ILIKE '%' || r.term || '%' OR p.proposal ILIKE '%' || r.term || '%' OR p.final_key ILIKE '%' || r.term || '%'""",
          ["proposals"])
def q_search_many(spark, sf):
    requests = spark.sql(_REQUESTS.replace("FROM supplier", "FROM {supplier}"), supplier=fx.table(spark, sf, "supplier"))
    return search.search_many(fx.proposals(spark, sf).select("id", "issuer_name", "proposal", "final_key"), requests).select("request_id", "id", "final_key")


# ------------------------------------------------------------------------ H8
_SLIM = "id, account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable, rank_of_shareholding"


@register("slim_swap", f"""
SELECT 'table' AS folder, {_SLIM}, NULL::INTEGER AS row_index FROM outreach
UNION ALL SELECT 'backup', {_SLIM}, 1 FROM outreach""", ["outreach"])
def q_slim_swap(spark, sf):
    """A table is backed up, its slim copy counted and put in its place; both folders' rows."""
    path = _scratch(spark, "slim-swap")
    fx.outreach(spark, sf).select(F.lit(1).alias("row_index"), F.lit("u").alias("unnamed_col"), "*").write.parquet(path)
    done = sinks.slim_accounts(spark, path, "20240105")
    slim, backup = spark.read.parquet(path), spark.read.parquet(done["backup"])
    if "row_index" in slim.columns or "unnamed_col" not in backup.columns:
        raise RuntimeError("the slim copy isn't in the table's place")
    cols = _SLIM.split(", ")
    return slim.select(F.lit("table").alias("folder"), *cols, F.lit(None).cast("int").alias("row_index")) \
        .unionByName(backup.select(F.lit("backup").alias("folder"), *cols, "row_index"))


# ------------------------------------------------------------------ J3 / J6
_KEY = "proposal_master_skey"


def _bucketed_accounts(spark, sf) -> str:
    name = f"accounts_{uuid.uuid4().hex[:12]}"
    buckets.write_bucketed(fx.accounts(spark, sf).select("id", _KEY, "shares_summable"), name, _scratch(spark, "buckets"), _KEY, 8)
    return name


@register("bucketed_join", f"""
SELECT p.id AS proposal_id, count(*) AS rows, CAST(sum(a.shares_summable) AS BIGINT) AS shares
FROM accounts a JOIN proposals p ON a.{_KEY} = p.{_KEY} WHERE p.{_KEY} <> -1 GROUP BY p.id""", ["accounts", "proposals"])
def q_bucketed_join(spark, sf):
    p = fx.proposals(spark, sf).filter(f"{_KEY} <> -1").select(F.col("id").alias("proposal_id"), _KEY)
    return buckets.join_bucketed(spark, _bucketed_accounts(spark, sf), p, _KEY) \
        .groupBy("proposal_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("shares_summable").cast("bigint").alias("shares"))


@register("bucketed_totals", f"""
SELECT {_KEY}, count(*) AS rows, CAST(sum(shares_summable) AS BIGINT) AS total FROM accounts GROUP BY {_KEY}""", ["accounts"])
def q_bucketed_totals(spark, sf):
    return buckets.totals_by_key(spark, _bucketed_accounts(spark, sf), _KEY, "shares_summable").withColumn("total", F.col("total").cast("bigint"))
