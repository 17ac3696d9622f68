"""Input views derived from the driver's TPC-H-like tables.

The reference ships no data, so the test inputs are derived from the driver's
tables: ``lineitem`` rows become account rows (voted and unvoted together),
``part`` rows become proposals whose share totals are rolled up from those
accounts, ``orders`` rows become messy text for the cleaning functions and
numbered dump lines.  Each view is one SQL text (``VIEW_SQL``): Spark runs it
through ``spark.sql`` with the input DataFrames bound as parameters, and the
DuckDB oracles use the same text as a ``WITH`` prefix, so both engines derive
the same inputs.

The views are lazy projections over a Parquet scan (plus one partial
aggregation for ``proposals``), so column pruning and filter pushdown reach
the files whatever operator sits on top.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# The builders run the view SQL below through ``spark.sql`` with the input
# DataFrames bound as parameters: one JVM call per view, and literally the
# same text the DuckDB oracles use, so both engines derive the same inputs.
_BASE = {"accounts": ["lineitem"], "proposals": ["part"], "raw_values": ["orders"], "dump_lines": ["orders"], "date_values": ["orders"]}


def _bind(text: str, names: list[str]) -> str:
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture view ``name`` as a DataFrame over the driver's tables."""
    inputs = {t: table(spark, sf_dir, t) for t in _BASE.get(name, [])}
    inputs.update({d: view(spark, sf_dir, d) for d in _DEPS[name]})
    return spark.sql(_bind(VIEW_SQL[name], list(inputs)), **inputs)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one account row per lineitem; ``is_voted`` splits voted / unvoted."""
    return view(spark, sf_dir, "accounts")


def account_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "account_voted")


def account_unvoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "account_unvoted")


def account_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "account_rollup")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal per part; share totals rolled up from ``accounts``."""
    return view(spark, sf_dir, "proposals")


def outreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Already-chosen accounts, unique per non-NULL key triple."""
    return view(spark, sf_dir, "outreach")


def accounts_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and calibrated model variants."""
    return view(spark, sf_dir, "accounts_by_model")


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text for the cleaning functions."""
    return view(spark, sf_dir, "raw_values")


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered dump lines."""
    return view(spark, sf_dir, "dump_lines")


# ------------------------------------------------------- SQL text of the views
# The same view definitions as SQL, used as a WITH prefix for DuckDB oracles.
VIEW_SQL: dict[str, str] = {
    "accounts": """
SELECT l_partkey AS part_key,
  CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id,
  concat('H', lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0')) AS account_hash_key,
  CASE WHEN l_partkey % 5 = 0 THEN -1 ELSE l_partkey END AS proposal_master_skey,
  CASE WHEN l_partkey % 5 = 0 THEN l_partkey WHEN l_partkey % 7 = 0 THEN NULL ELSE -1 END AS director_master_skey,
  CASE l_returnflag WHEN 'A' THEN 'Individual' WHEN 'N' THEN 'Institution' ELSE 'Mutual Fund' END AS account_type,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE CAST(l_quantity AS DECIMAL(20,2)) END AS shares_summable,
  CAST(l_linenumber AS INT) AS rank_of_shareholding,
  CAST(l_discount * 10 AS DECIMAL(10,6)) AS score,
  CASE WHEN (l_orderkey + l_suppkey) % 13 = 0 THEN NULL WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN l_linestatus = 'O' THEN 0 WHEN l_tax <= 0.04 THEN 1 ELSE 2 END AS Target_encoded,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_voted
FROM lineitem""",
    "accounts_hot": """
SELECT part_key, id,
  CASE WHEN id % 3 = 0 THEN 'H_HOT' ELSE account_hash_key END AS account_hash_key,
  CASE WHEN id % 3 = 0 THEN 1 ELSE proposal_master_skey END AS proposal_master_skey,
  CASE WHEN id % 3 = 0 THEN -1 ELSE director_master_skey END AS director_master_skey,
  account_type, shares_summable, rank_of_shareholding, score, prediction, Target_encoded, is_voted
FROM accounts""",
    "account_voted": """
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score AS score_model2, prediction AS prediction_model2, Target_encoded
FROM accounts WHERE is_voted = 1""",
    "account_unvoted": """
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score AS score_model1, prediction AS prediction_model1, Target_encoded
FROM accounts WHERE is_voted = 0""",
    "account_rollup": """
SELECT part_key,
  SUM(CASE WHEN is_voted = 1 AND prediction = 0 THEN shares_summable END) AS pf,
  SUM(CASE WHEN is_voted = 1 AND prediction = 1 THEN shares_summable END) AS pa,
  SUM(CASE WHEN is_voted = 0 THEN shares_summable END) AS pu,
  SUM(CASE WHEN Target_encoded = 1 THEN shares_summable END) AS tf,
  SUM(CASE WHEN Target_encoded = 2 THEN shares_summable END) AS ta
FROM accounts GROUP BY part_key""",
    "proposals": """
SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
  CASE WHEN p_partkey % 41 = 40 THEN NULL WHEN p_partkey % 5 = 0 THEN -1 ELSE p_partkey END AS proposal_master_skey,
  CASE WHEN p_partkey % 41 = 40 THEN -1 WHEN p_partkey % 5 = 0 THEN p_partkey WHEN p_partkey % 7 = 0 THEN NULL ELSE -1 END AS director_master_skey,
  concat('FK', CAST(p_partkey AS VARCHAR(20))) AS final_key,
  CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN ' '
       WHEN p_partkey % 10 = 3 THEN upper(p_brand) ELSE p_brand END AS issuer_name,
  p_name AS proposal, p_type AS category,
  concat('S', CAST(p_size % 5 AS VARCHAR(5))) AS subcategory,
  CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'S' END AS proposal_type,
  CAST(pf AS BIGINT) AS predicted_for_shares,
  CAST(pa AS BIGINT) AS predicted_against_shares,
  CAST(p_size AS BIGINT) AS predicted_abstain_shares,
  CAST(pu AS BIGINT) AS predicted_unvoted_shares,
  CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 0 ELSE CAST(tf AS BIGINT) END AS total_for_shares,
  CAST(ta AS BIGINT) AS total_against_shares,
  CAST(p_size AS BIGINT) AS total_abstain_shares,
  CAST(pu AS BIGINT) AS total_unvoted_shares,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN coalesce(tf, 0) > coalesce(ta, 0) THEN TRUE ELSE FALSE END AS approved,
  CASE WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 THEN NULL
       WHEN (coalesce(pf, 0) > coalesce(pa, 0)) = (coalesce(tf, 0) > coalesce(ta, 0)) THEN TRUE ELSE FALSE END AS prediction_correct,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 10000 AS DOUBLE) / 10000 END AS for_percentage,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 1000 AS DOUBLE) / 1000 END AS for_percentage_true,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST('2024-01-01' AS DATE) + CAST(p_partkey % 365 AS INT) END AS mt_date
FROM part LEFT JOIN account_rollup ON part_key = p_partkey""",
    "outreach": """
SELECT MIN(id) AS id, account_hash_key, proposal_master_skey, director_master_skey,
  MIN(account_type) AS account_type, MIN(shares_summable) AS shares_summable,
  MIN(rank_of_shareholding) AS rank_of_shareholding
FROM account_unvoted WHERE rank_of_shareholding <= 2
GROUP BY account_hash_key, proposal_master_skey, director_master_skey""",
    "accounts_by_model": """
SELECT 'original' AS dataset, is_voted, account_hash_key, score AS score_model2, CAST(prediction AS DECIMAL(10,6)) AS prediction_model2 FROM accounts
UNION ALL
SELECT 'calibrated' AS dataset, is_voted, account_hash_key, score AS score_model2,
  CASE WHEN prediction IS NULL THEN NULL ELSE CAST(score * 0.8 + 0.1 AS DECIMAL(10,6)) END AS prediction_model2 FROM accounts""",
    "raw_values": """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN '-1.0' WHEN 3 THEN ' 7 ' WHEN 4 THEN '123.9' WHEN 5 THEN '-2.5'
       WHEN 6 THEN 'abc' WHEN 7 THEN NULL WHEN 8 THEN '1e3' WHEN 9 THEN 'null' WHEN 10 THEN '2.5' ELSE CAST(o_custkey AS VARCHAR(20)) END AS num_text,
  CASE o_orderkey % 5 WHEN 0 THEN '1,234.56789' WHEN 1 THEN ' 0.12344 ' WHEN 2 THEN 'NULL' WHEN 3 THEN '12,3x'
       ELSE CASE o_orderkey % 4 WHEN 0 THEN '0x1FFFFFFFFFFFFFFFFF' WHEN 1 THEN '0x10' WHEN 2 THEN '1e400' ELSE '1234567' END END AS comma_text,
  CASE o_orderkey % 11 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN 'Y' WHEN 3 THEN '1' WHEN 4 THEN 'false' WHEN 5 THEN ' no '
       WHEN 6 THEN 'N' WHEN 7 THEN '0' WHEN 8 THEN 'maybe' WHEN 9 THEN '' ELSE 't' END AS bool_text,
  CASE o_orderkey % 9
       WHEN 0 THEN concat(CAST(year(o_orderdate) AS VARCHAR(4)), '-', lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0'))
       WHEN 1 THEN concat(CAST(month(o_orderdate) AS VARCHAR(2)), '/', CAST(day(o_orderdate) AS VARCHAR(2)), '/', CAST(year(o_orderdate) AS VARCHAR(4)))
       WHEN 2 THEN concat('25/', CAST(month(o_orderdate) AS VARCHAR(2)), '/', CAST(year(o_orderdate) AS VARCHAR(4)))
       WHEN 3 THEN concat(CAST(year(o_orderdate) AS VARCHAR(4)), '/', CAST(month(o_orderdate) AS VARCHAR(2)), '/', CAST(day(o_orderdate) AS VARCHAR(2)))
       WHEN 4 THEN concat(CAST(month(o_orderdate) AS VARCHAR(2)), '-', CAST(day(o_orderdate) AS VARCHAR(2)), '-', CAST(year(o_orderdate) AS VARCHAR(4)))
       WHEN 5 THEN concat('25-', CAST(month(o_orderdate) AS VARCHAR(2)), '-', CAST(year(o_orderdate) AS VARCHAR(4)))
       WHEN 6 THEN ' null ' WHEN 7 THEN 'not a date' ELSE '5/13/25' END AS date_text,
  CASE o_orderkey % 4 WHEN 0 THEN '12.5%' WHEN 1 THEN '~ 7' WHEN 2 THEN 'n/a' ELSE '--' END AS pct_text,
  CASE o_orderkey % 6 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' WHEN 2 THEN concat('  ', chr(9)) WHEN 3 THEN NULL ELSE concat('H', CAST(o_orderkey AS VARCHAR(20))) END AS key_text
FROM orders""",
    "dump_lines": """
SELECT o_orderkey AS line_no,
  CASE WHEN o_orderkey % 97 = 0 THEN '-- comment'
       WHEN (o_orderkey % 300) < 170 THEN concat('INSERT INTO `account_voted` VALUES (', CAST(o_custkey AS VARCHAR(20)), ');')
       ELSE concat('INSERT INTO `account_unvoted` VALUES (', CAST(o_custkey AS VARCHAR(20)), ');') END AS line
FROM orders""",
    "dump_lines_padded": """
SELECT CASE WHEN line_no % 3 = 0 THEN 'a.sql' ELSE 'b.sql' END AS file, line_no,
  CASE line_no % 8 WHEN 1 THEN concat('  ', line, ' ') WHEN 2 THEN concat(chr(9), line) ELSE line END AS line
FROM dump_lines""",
    "date_values": """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 16
       WHEN 0 THEN concat(y, m, d) WHEN 1 THEN concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(m AS INT) * 3 - 2, 3), ' ', dd, ', ', y)
       WHEN 2 THEN concat(dd, '-', substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(m AS INT) * 3 - 2, 3), '-', y)
       WHEN 3 THEN concat(y, '-', m, '-', d, ' 10:30:00') WHEN 4 THEN concat(m, '/', d, '/', y, ' 3:07 PM') WHEN 5 THEN concat(d, '/', m, '/', y)
       WHEN 6 THEN concat(m, '.', d, '.', y) WHEN 7 THEN concat(y, '/', mm, '/', dd) WHEN 8 THEN concat(y, '-', m, '-', d, ' junk')
       WHEN 9 THEN CAST(45000 + o_custkey AS VARCHAR(20)) WHEN 10 THEN concat('  ', y, '-', mm, '-', dd, '  ') WHEN 11 THEN concat(mm, '/', dd, '/', substring(y, 3, 2))
       WHEN 12 THEN concat('1', y, '-', m, '-', d) WHEN 13 THEN concat(y, '-', m, '-31') WHEN 14 THEN NULL ELSE 'null' END AS date_text
FROM (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS VARCHAR(4)) AS y, CAST(month(o_orderdate) AS VARCHAR(2)) AS mm, CAST(day(o_orderdate) AS VARCHAR(2)) AS dd,
        lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') AS d FROM orders) o""",
    "proposals_accented": """
SELECT id, proposal_master_skey, director_master_skey, final_key, proposal, mt_date, prediction_correct, approved,
  CASE id % 6 WHEN 0 THEN 'Soci\u00e9t\u00e9 ' || issuer_name WHEN 1 THEN 'SOCIETE ' || issuer_name WHEN 2 THEN 'societ\u00c9 ' || issuer_name || '  '
       WHEN 3 THEN '\u00c5bo ' || issuer_name WHEN 4 THEN 'abo ' || issuer_name ELSE issuer_name END AS issuer_name,
  CASE id % 3 WHEN 0 THEN '\u00c9lection ' || category WHEN 1 THEN 'election ' || category ELSE category END AS category
FROM proposals""",
}

_DEPS = {
    "accounts": [], "accounts_hot": ["accounts"], "account_voted": ["accounts"], "account_unvoted": ["accounts"],
    "account_rollup": ["accounts"], "proposals": ["account_rollup"],
    "outreach": ["account_unvoted"], "accounts_by_model": ["accounts"],
    "raw_values": [], "dump_lines": [], "dump_lines_padded": ["dump_lines"], "date_values": [], "proposals_accented": ["proposals"],
}

BUILDERS = {
    "accounts": accounts, "accounts_hot": lambda s, d: view(s, d, "accounts_hot"), "account_voted": account_voted, "account_unvoted": account_unvoted,
    "account_rollup": account_rollup, "proposals": proposals, "outreach": outreach,
    "accounts_by_model": accounts_by_model, "raw_values": raw_values, "dump_lines": dump_lines,
    "dump_lines_padded": lambda s, d: view(s, d, "dump_lines_padded"), "date_values": lambda s, d: view(s, d, "date_values"),
    "proposals_accented": lambda s, d: view(s, d, "proposals_accented"),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, views: list[str]) -> str:
    """Prefix ``sql`` with WITH clauses for ``views`` (and what they depend on).

    A query that starts with its own ``WITH`` has its CTEs appended after ours.
    """
    body = sql.strip()
    if not views:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in _closure(views))
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
