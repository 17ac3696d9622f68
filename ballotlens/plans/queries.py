"""Query definitions: one registered entry per operator of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotlens.operators import accounts as acc
from ballotlens.plans import fixtures as fx
from ballotlens.plans.catalog import register

# ======================================================== flagship
FLAGSHIP_SQL = """
WITH p AS (
  SELECT id,
    CASE WHEN proposal_master_skey <> -1 THEN 'P' WHEN director_master_skey <> -1 THEN 'D' END AS key_type,
    CASE WHEN proposal_master_skey <> -1 THEN proposal_master_skey WHEN director_master_skey <> -1 THEN director_master_skey END AS key_value
  FROM proposals),
a AS (
  SELECT 'P' AS key_type, proposal_master_skey AS key_value, is_voted, prediction, shares_summable FROM accounts WHERE proposal_master_skey <> -1
  UNION ALL
  SELECT 'D' AS key_type, director_master_skey AS key_value, is_voted, prediction, shares_summable FROM accounts WHERE director_master_skey <> -1),
r AS (
  SELECT key_type, key_value, SUM(is_voted) AS nv, SUM(1 - is_voted) AS nu,
    SUM(CASE WHEN is_voted = 1 THEN shares_summable END) AS vs,
    SUM(CASE WHEN is_voted = 0 THEN shares_summable END) AS us,
    SUM(CASE WHEN is_voted = 1 AND prediction = 0 THEN shares_summable END) AS f,
    SUM(CASE WHEN is_voted = 1 AND prediction = 1 THEN shares_summable END) AS g
  FROM a GROUP BY key_type, key_value)
SELECT p.id, p.key_type, CAST(p.key_value AS BIGINT) AS key_value,
  CAST(coalesce(nv, 0) AS BIGINT) AS voted_accounts, CAST(coalesce(nu, 0) AS BIGINT) AS unvoted_accounts,
  CAST(coalesce(vs, 0) AS DECIMAL(38,2)) AS voted_shares, CAST(coalesce(us, 0) AS DECIMAL(38,2)) AS unvoted_shares,
  CAST(coalesce(f, 0) AS DECIMAL(38,2)) AS voted_for_shares, CAST(coalesce(g, 0) AS DECIMAL(38,2)) AS voted_against_shares,
  CAST(CASE WHEN coalesce(g, 0) > coalesce(f, 0) THEN coalesce(g, 0) - coalesce(f, 0) END AS DECIMAL(38,2)) AS shares_needed
FROM p LEFT JOIN r ON p.key_type = r.key_type AND p.key_value = r.key_value
"""


@register("proposal_account_join", FLAGSHIP_SQL, ["proposals", "accounts"])
def q_proposal_account_join(spark, sf):
    return acc.proposal_share_totals(fx.proposals(spark, sf), fx.accounts(spark, sf))


# ================================================================ quality
from ballotlens.operators import quality as qm  # noqa: E402


def r6(c):
    return F.round(c, 6)


# shared SQL: coalesced shares per proposal (NULL counts as 0)
_NUM_SQL = """n AS (
  SELECT id, issuer_name, proposal_type, category, subcategory, approved, prediction_correct, total_for_shares,
    coalesce(CAST(predicted_for_shares AS DOUBLE), 0) AS pf, coalesce(CAST(predicted_against_shares AS DOUBLE), 0) AS pa,
    coalesce(CAST(predicted_abstain_shares AS DOUBLE), 0) AS pb, coalesce(CAST(total_for_shares AS DOUBLE), 0) AS tf,
    coalesce(CAST(total_against_shares AS DOUBLE), 0) AS ta, coalesce(CAST(total_abstain_shares AS DOUBLE), 0) AS tb
  FROM proposals)"""

_DELTA_TABLE_SQL = """
  abs(pf - tf) / CASE WHEN tf = 0 THEN 1.0 ELSE abs(tf) END AS delta1,
  abs(pf / CASE WHEN pf + pa + pb = 0 THEN 1.0 ELSE pf + pa + pb END - tf / CASE WHEN tf + ta + tb = 0 THEN 1.0 ELSE tf + ta + tb END) AS delta2"""

_DELTA_QUALITY_SQL = """
  CASE WHEN tf <> 0 THEN abs(pf - tf) / abs(tf) END AS delta1,
  CASE WHEN pf + pa + pb <> 0 AND tf + ta + tb <> 0 THEN abs(pf / (pf + pa + pb) - tf / (tf + ta + tb)) END AS delta2"""

_DELTA_LONG_SQL = _NUM_SQL + """,
dq AS (SELECT id, """ + _DELTA_QUALITY_SQL + """ FROM n WHERE total_for_shares IS NULL OR total_for_shares <> 0),
dl AS (SELECT id, 'delta1' AS metric, delta1 AS value FROM dq WHERE delta1 IS NOT NULL
       UNION ALL SELECT id, 'delta2' AS metric, delta2 AS value FROM dq WHERE delta2 IS NOT NULL)"""


@register("delta_table", "WITH " + _NUM_SQL + """
SELECT id, round(delta1, 6) AS delta1, round(delta2, 6) AS delta2 FROM (SELECT id, """ + _DELTA_TABLE_SQL + " FROM n) t",
          ["proposals"])
def q_delta_table(spark, sf):
    d = qm.with_deltas(fx.proposals(spark, sf), "table")
    return d.select("id", r6(F.col("delta1")).alias("delta1"), r6(F.col("delta2")).alias("delta2"))


@register("delta_quality", "WITH " + _NUM_SQL + """
SELECT id, round(delta1, 6) AS delta1, round(delta2, 6) AS delta2 FROM (SELECT id, """ + _DELTA_QUALITY_SQL + """ FROM n
WHERE total_for_shares IS NULL OR total_for_shares <> 0) t""", ["proposals"])
def q_delta_quality(spark, sf):
    d = qm.with_deltas(qm.quality_set(fx.proposals(spark, sf)), "quality")
    return d.select("id", r6(F.col("delta1")).alias("delta1"), r6(F.col("delta2")).alias("delta2"))


@register("delta_filter", "WITH " + _NUM_SQL + """
SELECT id, round(delta1, 6) AS delta1, round(delta2, 6) AS delta2 FROM (SELECT id, """ + _DELTA_TABLE_SQL + """ FROM n) t
WHERE delta1 IS NOT NULL AND delta1 <= 0.5 AND delta2 IS NOT NULL AND delta2 <= 0.3""", ["proposals"])
def q_delta_filter(spark, sf):
    d = qm.delta_filter(fx.proposals(spark, sf), max_delta1=0.5, max_delta2=0.3)
    return d.select("id", r6(F.col("delta1")).alias("delta1"), r6(F.col("delta2")).alias("delta2"))


_CM_BODY = """
  CAST(coalesce(count_if(approved IS NOT NULL AND pred AND approved), 0) AS BIGINT) AS tp,
  CAST(coalesce(count_if(approved IS NOT NULL AND pred AND NOT approved), 0) AS BIGINT) AS fp,
  CAST(coalesce(count_if(approved IS NOT NULL AND NOT pred AND approved), 0) AS BIGINT) AS fn,
  CAST(coalesce(count_if(approved IS NOT NULL AND NOT pred AND NOT approved), 0) AS BIGINT) AS tn,
  CAST(count(*) AS BIGINT) AS total, CAST(coalesce(count_if(approved IS NOT NULL), 0) AS BIGINT) AS valid"""

_CM_FRAME = _NUM_SQL + """,
c AS (SELECT *, CASE WHEN prediction_correct IS NOT NULL THEN
        CASE WHEN prediction_correct THEN coalesce(approved, FALSE) ELSE NOT coalesce(approved, FALSE) END
      ELSE pf > pa END AS pred FROM n)"""


@register("confusion_matrix", "WITH " + _CM_FRAME + " SELECT " + _CM_BODY + " FROM c", ["proposals"])
def q_confusion_matrix(spark, sf):
    return qm.confusion_matrix(fx.proposals(spark, sf))


@register("confusion_by_type", "WITH " + _CM_FRAME + " SELECT proposal_type, " + _CM_BODY
          + " FROM c GROUP BY proposal_type", ["proposals"])
def q_confusion_by_type(spark, sf):
    return qm.confusion_matrix(fx.proposals(spark, sf), group_by=["proposal_type"])


_METRICS_SQL = """
SELECT tp, fp, fn, tn, total, valid,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) * 1.0 / (tp + fp + fn + tn) ELSE 0.0 END, 6) AS accuracy,
  round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1_score
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END AS prec,
        CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS rec FROM m) x"""


@register("quality_metrics", "WITH " + _CM_FRAME + ", m AS (SELECT " + _CM_BODY + " FROM c)" + _METRICS_SQL,
          ["proposals"])
def q_quality_metrics(spark, sf):
    m = qm.classification_metrics(qm.confusion_matrix(fx.proposals(spark, sf)))
    return m.select("tp", "fp", "fn", "tn", "total", "valid",
                    *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@register("quality_filter", """
SELECT id, issuer_name, proposal_type, category, subcategory, approved FROM proposals
WHERE approved = TRUE AND proposal_type = 'M' AND subcategory = 'S1'""", ["proposals"])
def q_quality_filter(spark, sf):
    f = qm.quality_filter(fx.proposals(spark, sf), proposal_type="M", outcome="Approved", subcategory="S1")
    return f.select("id", "issuer_name", "proposal_type", "category", "subcategory", "approved")


@register("quality_filtered_matrix", "WITH " + _CM_FRAME + " SELECT " + _CM_BODY
          + " FROM c WHERE issuer_name = 'Brand#13' AND proposal_type = 'S'", ["proposals"])
def q_quality_filtered_matrix(spark, sf):
    p = fx.proposals(spark, sf)
    return qm.confusion_matrix(qm.quality_filter(p, issuer="Brand#13", proposal_type="S"))


@register("delta_thresholds", "WITH " + _DELTA_LONG_SQL + """,
per AS (SELECT metric, count(*) AS n,
  count_if(value <= 0.15) AS c0, count_if(value <= 0.30) AS c1, count_if(value <= 0.50) AS c2, count_if(value <= 0.75) AS c3
  FROM dl GROUP BY metric),
l AS (SELECT metric, n, 0.15 AS threshold, c0 AS cnt FROM per UNION ALL SELECT metric, n, 0.30, c1 FROM per
      UNION ALL SELECT metric, n, 0.50, c2 FROM per UNION ALL SELECT metric, n, 0.75, c3 FROM per)
SELECT metric, CAST(threshold AS DOUBLE) AS threshold, CAST(cnt AS BIGINT) AS count, CAST(n AS BIGINT) AS total,
  CASE WHEN n > 0 THEN round(cnt * 100.0 / n, 1) ELSE 0.0 END AS percent FROM l""", ["proposals"])
def q_delta_thresholds(spark, sf):
    return qm.threshold_table(fx.proposals(spark, sf))


def _hist_sql(metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, r.bin, printf('%.2f', mn + r.bin * CASE WHEN mx = mn THEN 0.0 ELSE (mx - mn) / 10.0 END) AS label,
  round(mn + r.bin * CASE WHEN mx = mn THEN 0.0 ELSE (mx - mn) / 10.0 END, 6) AS bin_start,
  CAST(coalesce(cb.cnt, 0) AS BIGINT) AS count
FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) r(bin)
CROSS JOIN (SELECT min(value) AS mn, max(value) AS mx FROM dl WHERE metric = '{metric}') mm
LEFT JOIN (SELECT CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((value - mn) / ((mx - mn) / 10.0)) AS INT), 9) END AS bin,
             count(*) AS cnt
           FROM dl, (SELECT min(value) AS mn, max(value) AS mx FROM dl WHERE metric = '{metric}') m2
           WHERE metric = '{metric}' GROUP BY 1) cb ON cb.bin = r.bin
WHERE mn IS NOT NULL AND r.bin < CASE WHEN mx = mn THEN 1 ELSE 10 END"""


@register("delta_histogram", "WITH " + _DELTA_LONG_SQL + "\n" + _hist_sql("delta1") + "\nUNION ALL\n"
          + _hist_sql("delta2"), ["proposals"])
def q_delta_histogram(spark, sf):
    h = qm.delta_histogram(fx.proposals(spark, sf))
    return h.select("metric", "bin", "label", r6(F.col("bin_start")).alias("bin_start"), "count")


# ================================================================ proposals browsing
from ballotlens.functions import text as T  # noqa: E402
from ballotlens.operators import proposals as pr  # noqa: E402

# fixed values: oracle-test parameters
ISSUERS = ["Brand#1", "Brand#13"]
SEARCH_TERM = "anvil"
PAGE_NO, PAGE_LIMIT = 2, 50

_ISSUER_SQL = "lower(rtrim(issuer_name)) IN ('brand#1', 'brand#13')"


@register("proposals_filter", f"""
SELECT id, issuer_name, category, prediction_correct, approved FROM proposals
WHERE prediction_correct = TRUE AND approved = FALSE AND {_ISSUER_SQL}""", ["proposals"])
def q_proposals_filter(spark, sf):
    f = pr.filter_proposals(fx.proposals(spark, sf), prediction_correct="true", approved="no", issuers=ISSUERS)
    return f.select("id", "issuer_name", "category", "prediction_correct", "approved")


@register("proposals_filter_category", """
SELECT id, issuer_name, category FROM proposals
WHERE lower(rtrim(category)) = 'promo' AND prediction_correct = FALSE""", ["proposals"])
def q_proposals_filter_category(spark, sf):
    f = pr.filter_proposals(fx.proposals(spark, sf), prediction_correct="false", category="Promo  ")
    return f.select("id", "issuer_name", "category")


@register("proposals_search", f"""
SELECT id, issuer_name, proposal, final_key FROM proposals
WHERE issuer_name ILIKE '%{SEARCH_TERM}%' OR proposal ILIKE '%{SEARCH_TERM}%' OR final_key ILIKE '%{SEARCH_TERM}%'""",
          ["proposals"])
def q_proposals_search(spark, sf):
    f = pr.filter_proposals(fx.proposals(spark, sf), search=SEARCH_TERM)
    return f.select("id", "issuer_name", "proposal", "final_key")


@register("proposals_search_wildcard", """
SELECT id, final_key FROM proposals
WHERE issuer_name ILIKE '%fk1_3%' OR proposal ILIKE '%fk1_3%' OR final_key ILIKE '%fk1_3%'""", ["proposals"])
def q_proposals_search_wildcard(spark, sf):
    return pr.filter_proposals(fx.proposals(spark, sf), search="fk1_3").select("id", "final_key")


@register("issuer_filter", f"SELECT id, issuer_name FROM proposals WHERE {_ISSUER_SQL}", ["proposals"])
def q_issuer_filter(spark, sf):
    return pr.issuer_in(fx.proposals(spark, sf), ISSUERS).select("id", "issuer_name")


@register("proposals_page", f"""
SELECT id, issuer_name, proposal FROM proposals ORDER BY id DESC LIMIT {PAGE_LIMIT} OFFSET {(PAGE_NO - 1) * PAGE_LIMIT}""",
          ["proposals"])
def q_proposals_page(spark, sf):
    return pr.page(fx.proposals(spark, sf), PAGE_NO, PAGE_LIMIT).select("id", "issuer_name", "proposal")


@register("proposals_page_info", f"""
SELECT CAST({PAGE_NO} AS BIGINT) AS current_page, CAST({PAGE_LIMIT} AS BIGINT) AS per_page, CAST(count(*) AS BIGINT) AS total,
  CAST(ceil(count(*) / {float(PAGE_LIMIT)}) AS BIGINT) AS total_pages
FROM proposals WHERE {_ISSUER_SQL}""", ["proposals"])
def q_proposals_page_info(spark, sf):
    return pr.page_info(pr.issuer_in(fx.proposals(spark, sf), ISSUERS), PAGE_NO, PAGE_LIMIT)


@register("proposals_sorted", """
SELECT id, issuer_name FROM proposals ORDER BY lower(coalesce(issuer_name, '')) DESC, id ASC LIMIT 50 OFFSET 100""",
          ["proposals"])
def q_proposals_sorted(spark, sf):
    s = pr.sort_proposals(fx.proposals(spark, sf), "issuer_name", ascending=False)
    return s.offset(100).limit(50).select("id", "issuer_name")


@register("dashboard", """
SELECT CAST(count(*) AS BIGINT) AS total_proposals,
  CAST(coalesce(count_if(prediction_correct = TRUE), 0) AS BIGINT) AS correct_predictions,
  CAST(coalesce(count_if(approved = TRUE), 0) AS BIGINT) AS approved_proposals,
  (SELECT CAST(count(*) AS BIGINT) FROM accounts WHERE is_voted = 1) AS voted_accounts,
  (SELECT CAST(count(*) AS BIGINT) FROM accounts WHERE is_voted <> 1) AS unvoted_accounts
FROM proposals""", ["proposals", "accounts"])
def q_dashboard(spark, sf):
    return pr.dashboard(fx.proposals(spark, sf), fx.accounts(spark, sf))


@register("accuracy_rate", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(coalesce(count_if(prediction_correct = TRUE), 0) AS BIGINT) AS correct,
  CASE WHEN count(*) > 0 THEN round(coalesce(count_if(prediction_correct = TRUE), 0) * 100.0 / count(*), 1) ELSE 0.0 END AS accuracy_rate
FROM proposals""", ["proposals"])
def q_accuracy_rate(spark, sf):
    return pr.accuracy_rate(fx.proposals(spark, sf))


@register("categories", """
SELECT min(category) AS category FROM proposals WHERE category IS NOT NULL GROUP BY lower(rtrim(category))""",
          ["proposals"])
def q_categories(spark, sf):
    return pr.distinct_categories(fx.proposals(spark, sf))


@register("categories_of_issuers", f"""
SELECT min(category) AS category FROM proposals WHERE category IS NOT NULL AND {_ISSUER_SQL}
GROUP BY lower(rtrim(category))""", ["proposals"])
def q_categories_of_issuers(spark, sf):
    return pr.distinct_categories(fx.proposals(spark, sf), ISSUERS)


@register("filter_options", """
SELECT DISTINCT field, value FROM (
  SELECT 'issuer' AS field, issuer_name AS value FROM proposals
  UNION ALL SELECT 'type', proposal_type FROM proposals
  UNION ALL SELECT 'category', category FROM proposals
  UNION ALL SELECT 'subcategory', subcategory FROM proposals) t
WHERE value IS NOT NULL AND value <> ''""", ["proposals"])
def q_filter_options(spark, sf):
    return pr.filter_options(fx.proposals(spark, sf))


@register("issuer_list", """
SELECT min(issuer_name) AS name, CAST(count(DISTINCT proposal_master_skey) AS BIGINT) AS proposal_count,
  CAST(count(DISTINCT director_master_skey) AS BIGINT) AS director_count, 'active' AS status,
  min(issuer_name) IN ('Brand#13') AS selected
FROM proposals WHERE issuer_name IS NOT NULL AND rtrim(issuer_name) <> ''
GROUP BY lower(rtrim(issuer_name))""", ["proposals"])
def q_issuer_list(spark, sf):
    return pr.issuer_list(fx.proposals(spark, sf), selected=["Brand#13"])


@register("top_issuers", """
SELECT issuer_name, proposal_count FROM (
  SELECT lower(rtrim(issuer_name)) AS key, min(issuer_name) AS issuer_name, CAST(count(*) AS BIGINT) AS proposal_count
  FROM proposals GROUP BY lower(rtrim(issuer_name))) g
ORDER BY proposal_count DESC, key ASC NULLS FIRST LIMIT 10""", ["proposals"])
def q_top_issuers(spark, sf):
    return pr.top_issuers(fx.proposals(spark, sf), 10)


def _pct_sql(x: str, null_text: str = "-") -> str:
    return (f"CASE WHEN {x} IS NULL THEN '{null_text}' ELSE "
            f"CAST(CAST(round(CAST({x} * 100 AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) || '%' END")


def _plain_sql(x: str) -> str:
    return f"CASE WHEN CAST({x} AS VARCHAR) IS NULL OR CAST({x} AS VARCHAR) = '' THEN '-' ELSE CAST({x} AS VARCHAR) END"


_WS = T.WS


def _truncate_sql(x: str, n: int = 10) -> str:
    words = f"string_split_regex(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+')"
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '-' WHEN len({words}) <= {n} THEN {x} "
            f"ELSE array_to_string({words}[1:{n}], ' ') || '...' END")


_SHARE_COLS = ["predicted_for_shares", "predicted_against_shares", "predicted_abstain_shares",
               "predicted_unvoted_shares", "total_for_shares", "total_against_shares",
               "total_abstain_shares", "total_unvoted_shares"]


@register("proposal_report", "WITH " + _NUM_SQL + """,
d AS (SELECT p.*, """ + _DELTA_TABLE_SQL + """ FROM proposals p JOIN n USING (id))
SELECT id, """ + _plain_sql("proposal_master_skey") + " AS proposal_master_key, "
          + _plain_sql("director_master_skey") + " AS director_master_key, "
          + _plain_sql("issuer_name") + " AS issuer, " + _plain_sql("category") + " AS category, "
          + _truncate_sql("CASE WHEN trim(proposal) <> '' THEN proposal END") + """ AS proposal_content,
  CASE WHEN prediction_correct THEN 'Correct' ELSE 'Incorrect' END AS prediction_accuracy,
  CASE WHEN approved THEN 'Yes' ELSE 'No' END AS approved_status,
  """ + _pct_sql("for_percentage") + " AS for_percentage, " + _pct_sql("for_percentage_true") + """ AS true_for_percentage, """
          + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE format('{{:,}}', {c}) END AS {c}" for c in _SHARE_COLS)
          + ", " + _pct_sql("delta1") + " AS delta1, " + _pct_sql("delta2") + " AS delta2 FROM d",
          ["proposals"])
def q_proposal_report(spark, sf):
    return pr.proposal_report(fx.proposals(spark, sf))


_PROPOSAL_COLS = ["id", "proposal_master_skey", "director_master_skey", "final_key", "issuer_name", "proposal",
                  "category", "subcategory", "proposal_type"] + _SHARE_COLS + [
    "approved", "prediction_correct", "for_percentage", "for_percentage_true", "mt_date"]


def _detail_sql() -> str:
    parts = []
    for c in _PROPOSAL_COLS:
        if c in ("approved", "prediction_correct"):
            v = f"CASE WHEN {c} IS NULL THEN 'N/A' WHEN {c} THEN 'Yes' ELSE 'No' END"
        elif c.startswith("for_percentage"):
            v = _pct_sql(c, "N/A")
        else:
            v = f"CASE WHEN CAST({c} AS VARCHAR) IS NULL OR CAST({c} AS VARCHAR) = '' THEN 'N/A' ELSE CAST({c} AS VARCHAR) END"
        parts.append(f"SELECT id, '{c}' AS field, {v} AS value FROM proposals")
    return "\nUNION ALL ".join(parts)


@register("proposal_detail", _detail_sql(), ["proposals"])
def q_proposal_detail(spark, sf):
    return pr.proposal_detail(fx.proposals(spark, sf).select(*_PROPOSAL_COLS))


# ================================================================ outreach
from ballotlens.operators import outreach as ot  # noqa: E402

_U_COLS = ["id", "account_hash_key", "proposal_master_skey", "director_master_skey", "account_type",
           "shares_summable", "rank_of_shareholding", "score_model1", "prediction_model1", "Target_encoded"]
_ORDER_ALL = ", ".join(f"{c} ASC NULLS FIRST" for c in _U_COLS)
_KEYS_NN = "account_hash_key IS NOT NULL AND proposal_master_skey IS NOT NULL AND director_master_skey IS NOT NULL"


def _selection(spark, sf):
    """All keys at once: each unvoted row of rank <= 3 selects its hash under each valid key."""
    u = fx.account_unvoted(spark, sf).filter(F.col("rank_of_shareholding") <= 3)
    return acc.account_keys(u).select("account_hash_key", "key_type", "key_value")


def _selected_all(spark, sf):
    return ot.selected_accounts_all(fx.account_unvoted(spark, sf), _selection(spark, sf))


_SEL_SQL = f"""sel AS (
  SELECT DISTINCT account_hash_key, 'P' AS key_type, proposal_master_skey AS key_value FROM account_unvoted
  WHERE rank_of_shareholding <= 3 AND proposal_master_skey <> -1
  UNION SELECT DISTINCT account_hash_key, 'D' AS key_type, director_master_skey AS key_value FROM account_unvoted
  WHERE rank_of_shareholding <= 3 AND director_master_skey <> -1),
s AS (
  SELECT u.* FROM account_unvoted u WHERE EXISTS (SELECT 1 FROM sel WHERE sel.account_hash_key = u.account_hash_key
    AND sel.key_type = 'P' AND sel.key_value = u.proposal_master_skey)
  UNION ALL
  SELECT u.* FROM account_unvoted u WHERE EXISTS (SELECT 1 FROM sel WHERE sel.account_hash_key = u.account_hash_key
    AND sel.key_type = 'D' AND sel.key_value = u.director_master_skey)),
ok AS (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach WHERE {_KEYS_NN}),
fl AS (SELECT s.*, CASE WHEN ok.account_hash_key IS NOT NULL THEN 1 ELSE 0 END AS already_exists
  FROM s LEFT JOIN ok ON s.account_hash_key = ok.account_hash_key AND s.proposal_master_skey = ok.proposal_master_skey
    AND s.director_master_skey = ok.director_master_skey),
ne AS (SELECT * EXCLUDE (already_exists) FROM fl WHERE already_exists = 0),
nw AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account_hash_key, proposal_master_skey,
    director_master_skey ORDER BY {_ORDER_ALL}) AS rn FROM ne WHERE {_KEYS_NN}) t WHERE rn = 1
  UNION ALL SELECT * FROM ne WHERE NOT ({_KEYS_NN}))"""

_OUTREACH_COMMON = ["account_hash_key", "proposal_master_skey", "director_master_skey", "account_type",
                    "shares_summable", "rank_of_shareholding"]


@register("selected_accounts", """
SELECT id, account_hash_key, proposal_master_skey, shares_summable FROM account_unvoted
WHERE proposal_master_skey = 1 AND account_hash_key IN (
  SELECT account_hash_key FROM account_unvoted WHERE proposal_master_skey = 1 AND rank_of_shareholding <= 3)""",
          ["account_unvoted"])
def q_selected_accounts(spark, sf):
    u = fx.account_unvoted(spark, sf)
    hashes = u.filter((F.col("proposal_master_skey") == 1) & (F.col("rank_of_shareholding") <= 3))
    s = ot.selected_accounts(u, hashes, "proposal_master_skey", 1)
    return s.select("id", "account_hash_key", "proposal_master_skey", "shares_summable")


@register("selected_accounts_all", "WITH " + _SEL_SQL + """
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, shares_summable FROM s""",
          ["account_unvoted", "outreach"])
def q_selected_accounts_all(spark, sf):
    return _selected_all(spark, sf).select("id", "account_hash_key", "proposal_master_skey",
                                           "director_master_skey", "shares_summable")


@register("already_exists", f"""
WITH ok AS (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach WHERE {_KEYS_NN})
SELECT u.id, u.account_hash_key, u.proposal_master_skey, u.director_master_skey,
  CASE WHEN ok.account_hash_key IS NOT NULL THEN 1 ELSE 0 END AS already_exists
FROM account_unvoted u LEFT JOIN ok ON u.account_hash_key = ok.account_hash_key
  AND u.proposal_master_skey = ok.proposal_master_skey AND u.director_master_skey = ok.director_master_skey""",
          ["account_unvoted", "outreach"])
def q_already_exists(spark, sf):
    f = ot.flag_existing(fx.account_unvoted(spark, sf), fx.outreach(spark, sf))
    return f.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey", "already_exists")


@register("outreach_new", "WITH " + _SEL_SQL + "\nSELECT " + ", ".join(_OUTREACH_COMMON) + " FROM nw",
          ["account_unvoted", "outreach"])
def q_outreach_new(spark, sf):
    return ot.add_to_outreach(_selected_all(spark, sf), fx.outreach(spark, sf))["new"]


@register("outreach_duplicates", "WITH " + _SEL_SQL + """
SELECT account_hash_key, proposal_master_skey, director_master_skey,
  'account_hash_key(' || coalesce(CAST(account_hash_key AS VARCHAR), 'null') || ')+proposal_master_skey('
  || coalesce(CAST(proposal_master_skey AS VARCHAR), 'null') || ')+director_master_skey('
  || coalesce(CAST(director_master_skey AS VARCHAR), 'null') || ') is not inserted because it is already in outreach table' AS message
FROM fl WHERE already_exists = 1""", ["account_unvoted", "outreach"])
def q_outreach_duplicates(spark, sf):
    return ot.add_to_outreach(_selected_all(spark, sf), fx.outreach(spark, sf))["duplicates"]


@register("outreach_report", "WITH " + _SEL_SQL + """
SELECT CAST((SELECT count(*) FROM nw) AS BIGINT) AS inserted,
  CAST((SELECT count(*) FROM fl WHERE already_exists = 1) AS BIGINT) AS skipped,
  round(coalesce((SELECT sum(coalesce(CAST(shares_summable AS DOUBLE), 0)) FROM ne), 0.0), 6) AS total_shares,
  round(coalesce((SELECT sum(coalesce(CAST(shares_summable AS DOUBLE), 0)) FROM nw), 0.0), 6) AS inserted_shares""",
          ["account_unvoted", "outreach"])
def q_outreach_report(spark, sf):
    r = ot.add_to_outreach(_selected_all(spark, sf), fx.outreach(spark, sf))["report"]
    return r.select("inserted", "skipped", r6(F.col("total_shares")).alias("total_shares"),
                    r6(F.col("inserted_shares")).alias("inserted_shares"))


@register("insert_ignore", f"""
WITH ok AS (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach WHERE {_KEYS_NN}),
fr AS (SELECT u.* FROM account_unvoted u WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.account_hash_key = u.account_hash_key
  AND ok.proposal_master_skey = u.proposal_master_skey AND ok.director_master_skey = u.director_master_skey))
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, shares_summable FROM (
  SELECT *, row_number() OVER (PARTITION BY account_hash_key, proposal_master_skey, director_master_skey
    ORDER BY {_ORDER_ALL}) AS rn FROM fr WHERE {_KEYS_NN}) t WHERE rn = 1
UNION ALL SELECT id, account_hash_key, proposal_master_skey, director_master_skey, shares_summable FROM fr
WHERE NOT ({_KEYS_NN})""", ["account_unvoted", "outreach"])
def q_insert_ignore(spark, sf):
    n = ot.insert_ignore(fx.outreach(spark, sf), fx.account_unvoted(spark, sf))
    return n.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey", "shares_summable")


@register("in_outreach", """
WITH ok AS (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach
            WHERE account_hash_key IS NOT NULL)
SELECT u.id, u.account_hash_key, u.proposal_master_skey, u.director_master_skey,
  ok.account_hash_key IS NOT NULL AS in_outreach
FROM account_unvoted u LEFT JOIN ok ON u.account_hash_key = ok.account_hash_key
  AND u.proposal_master_skey IS NOT DISTINCT FROM ok.proposal_master_skey
  AND u.director_master_skey IS NOT DISTINCT FROM ok.director_master_skey""", ["account_unvoted", "outreach"])
def q_in_outreach(spark, sf):
    f = ot.in_outreach(fx.account_unvoted(spark, sf), fx.outreach(spark, sf))
    return f.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey", "in_outreach")


@register("issuer_semi_join", f"""
SELECT id, account_hash_key, proposal_master_skey, director_master_skey FROM accounts
WHERE proposal_master_skey IN (SELECT proposal_master_skey FROM proposals WHERE {_ISSUER_SQL} AND proposal_master_skey <> -1)
   OR director_master_skey IN (SELECT director_master_skey FROM proposals WHERE {_ISSUER_SQL} AND director_master_skey <> -1)""",
          ["accounts", "proposals"])
def q_issuer_semi_join(spark, sf):
    a = ot.issuer_semi_join(fx.accounts(spark, sf), fx.proposals(spark, sf), ISSUERS)
    return a.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey")


@register("distinct_hashes", """
SELECT DISTINCT key_text AS account_hash_key FROM raw_values WHERE key_text IS NOT NULL AND trim(key_text, ' ' || chr(9)) <> ''""",
          ["raw_values"])
def q_distinct_hashes(spark, sf):
    return ot.distinct_hashes(fx.raw_values(spark, sf), "key_text")


@register("outreach_list", "SELECT id, account_hash_key, proposal_master_skey, director_master_skey FROM outreach",
          ["outreach"])
def q_outreach_list(spark, sf):
    return ot.outreach_list(fx.outreach(spark, sf)).select("id", "account_hash_key", "proposal_master_skey",
                                                           "director_master_skey")


@register("outreach_count", "SELECT CAST(count(*) AS BIGINT) AS outreach_count FROM outreach", ["outreach"])
def q_outreach_count(spark, sf):
    return ot.outreach_count(fx.outreach(spark, sf))


@register("delete_where", """
SELECT id, account_hash_key FROM accounts WHERE NOT coalesce(account_hash_key LIKE 'H000001_%', FALSE)""",
          ["accounts"])
def q_delete_where(spark, sf):
    return ot.delete_where_like(fx.accounts(spark, sf), "account_hash_key", "H000001_%") \
        .select("id", "account_hash_key")


@register("migrate_outreach", """
SELECT id, NULL::BIGINT AS row_index, NULL::VARCHAR AS unnamed_col, account_hash_key, proposal_master_skey,
  director_master_skey, account_type, shares_summable, rank_of_shareholding, NULL::DOUBLE AS score_model1,
  NULL::INTEGER AS prediction_model1, NULL::BIGINT AS Target_encoded FROM outreach""", ["outreach"])
def q_migrate_outreach(spark, sf):
    return ot.migrate_outreach(fx.outreach(spark, sf).withColumnRenamed("account_hash_key", "account_id"))


@register("copy_outreach", f"""
WITH src AS (SELECT * FROM account_unvoted),
ok AS (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach WHERE {_KEYS_NN}),
fr AS (SELECT u.* FROM src u WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.account_hash_key = u.account_hash_key
  AND ok.proposal_master_skey = u.proposal_master_skey AND ok.director_master_skey = u.director_master_skey)),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_hash_key, proposal_master_skey, director_master_skey
    ORDER BY {_ORDER_ALL}) AS rn FROM fr WHERE {_KEYS_NN}) t WHERE rn = 1
  UNION ALL SELECT *, 1 AS rn FROM fr WHERE NOT ({_KEYS_NN}))
SELECT {", ".join(_OUTREACH_COMMON)}, 'proxy' AS dataset FROM outreach
UNION ALL SELECT {", ".join(_OUTREACH_COMMON)}, 'other' FROM outreach
UNION ALL SELECT {", ".join(_OUTREACH_COMMON)}, 'proxy' FROM nw""", ["account_unvoted", "outreach"])
def q_copy_outreach(spark, sf):
    """All unvoted rows copied into one dataset of a partitioned outreach
    table; the whole table read back."""
    path = scratch_path(spark, f"outreach-{uuid.uuid4().hex[:12]}")
    old = fx.outreach(spark, sf).select(*_OUTREACH_COMMON)
    for name in ("proxy", "other"):
        sinks.append_table(old.withColumn("dataset", F.lit(name)), path)
    sinks.copy_table(fx.account_unvoted(spark, sf), path, ot.copy_rows, dataset="proxy", columns=_OUTREACH_COMMON, order=_U_COLS)
    return spark.read.parquet(path).select(*_OUTREACH_COMMON, "dataset")


# ================================================================ account analytics
_CAL_SQL = """cal AS (SELECT id, account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score AS score_model2,
  CASE WHEN prediction IS NULL THEN NULL ELSE CAST(score * 0.8 + 0.1 AS DECIMAL(10,6)) END AS prediction_model2,
  Target_encoded, is_voted FROM accounts)"""


def _calibrated(spark, sf):
    a = fx.accounts(spark, sf)
    pred = F.when(F.col("prediction").isNull(), F.lit(None)).otherwise(
        (F.col("score") * F.lit(0.8).cast("decimal(2,1)") + F.lit(0.1).cast("decimal(2,1)")).cast("decimal(10,6)"))
    return a.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey", "account_type",
                    "shares_summable", "rank_of_shareholding", F.col("score").alias("score_model2"),
                    pred.alias("prediction_model2"), "Target_encoded", "is_voted")


@register("accounts_filter", """
SELECT id, account_hash_key, account_type, shares_summable, rank_of_shareholding FROM account_voted
WHERE account_type = 'Institution' AND CAST(shares_summable AS DOUBLE) >= 20 AND rank_of_shareholding <= 4
  AND CAST(score_model2 AS DOUBLE) >= 0.3 AND CAST(Target_encoded AS VARCHAR) = '1' AND prediction_model2 = 1""",
          ["account_voted"])
def q_accounts_filter(spark, sf):
    f = acc.filter_accounts(fx.account_voted(spark, sf), account_type="Institution", shares_min=20, rank_max=4,
                            score_min=0.3, target=1, prediction=1)
    return f.select("id", "account_hash_key", "account_type", "shares_summable", "rank_of_shareholding")


@register("high_confidence", "WITH " + _CAL_SQL + """
SELECT account_hash_key, account_type, shares_summable, score_model2, prediction_model2, id FROM cal
WHERE is_voted = 0 AND prediction_model2 > 0.8
ORDER BY prediction_model2 DESC, shares_summable DESC NULLS LAST, account_hash_key ASC, id ASC NULLS FIRST,
  account_type ASC NULLS FIRST, score_model2 ASC NULLS FIRST LIMIT 100""", ["accounts"])
def q_high_confidence(spark, sf):
    u = _calibrated(spark, sf).filter(F.col("is_voted") == 0)
    h = acc.high_confidence(u, 0.8, 100, tie_break=["id", "account_type", "score_model2"])
    return h.select("account_hash_key", "account_type", "shares_summable", "score_model2", "prediction_model2", "id")


@register("prediction_band", "WITH " + _CAL_SQL + """
SELECT id, account_hash_key, prediction_model2 FROM cal WHERE prediction_model2 BETWEEN 0.6 AND 0.9""",
          ["accounts"])
def q_prediction_band(spark, sf):
    return acc.prediction_band(_calibrated(spark, sf), 0.6, 0.9).select("id", "account_hash_key", "prediction_model2")


@register("lookup_account", "SELECT * FROM account_voted WHERE account_hash_key = 'H00000007'", ["account_voted"])
def q_lookup_account(spark, sf):
    return acc.lookup_account(fx.account_voted(spark, sf), "H00000007")


_STATS_SQL = """
SELECT status, measure, round(avg(v), 6) AS avg, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(stddev_pop(v), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN is_voted = 1 THEN 'voted' ELSE 'unvoted' END AS status, 'score' AS measure, CAST(score AS DOUBLE) AS v FROM accounts
  UNION ALL
  SELECT CASE WHEN is_voted = 1 THEN 'voted' ELSE 'unvoted' END, 'prediction', CAST(prediction AS DOUBLE) FROM accounts) t
WHERE v IS NOT NULL GROUP BY status, measure"""


def _round_all(df, cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("score_stats", _STATS_SQL, ["accounts"])
def q_score_stats(spark, sf):
    return _round_all(acc.score_stats(fx.accounts(spark, sf)), {"avg", "min", "max", "std"})


@register("type_distribution", """
SELECT account_type, CAST(count(*) AS BIGINT) AS count,
  round(count(*) * 100.0 / (SELECT count(*) FROM account_unvoted), 2) AS percentage
FROM account_unvoted GROUP BY account_type""", ["account_unvoted"])
def q_type_distribution(spark, sf):
    return acc.type_distribution(fx.account_unvoted(spark, sf))


@register("prediction_by_status", """
SELECT CASE WHEN is_voted = 1 THEN 'voted' ELSE 'unvoted' END AS account_status,
  round(avg(CAST(prediction_model2 AS DOUBLE)), 6) AS avg_prediction,
  round(stddev_pop(CAST(prediction_model2 AS DOUBLE)), 6) AS std_prediction, CAST(count(*) AS BIGINT) AS total_accounts
FROM accounts_by_model WHERE dataset = 'calibrated' AND prediction_model2 IS NOT NULL GROUP BY 1""",
          ["accounts_by_model"])
def q_prediction_by_status(spark, sf):
    a = fx.accounts_by_model(spark, sf).filter(F.col("dataset") == "calibrated")
    return _round_all(acc.prediction_by_status(a), {"avg_prediction", "std_prediction"})


@register("compare_models", """
SELECT dataset AS model_type, round(avg(CAST(prediction_model2 AS DOUBLE)), 6) AS avg_pred,
  round(stddev_pop(CAST(prediction_model2 AS DOUBLE)), 6) AS std_pred
FROM accounts_by_model WHERE is_voted = 1 GROUP BY dataset""", ["accounts_by_model"])
def q_compare_models(spark, sf):
    a = fx.accounts_by_model(spark, sf).filter(F.col("is_voted") == 1)
    return _round_all(acc.compare_models(a), {"avg_pred", "std_pred"})


@register("coverage", """
SELECT CAST(count(*) AS BIGINT) AS total_records, CAST(count(score_model1) AS BIGINT) AS records_with_score,
  CAST(count(prediction_model1) AS BIGINT) AS records_with_prediction,
  CASE WHEN count(*) > 0 THEN round(count(score_model1) * 100.0 / count(*), 2) END AS score_coverage_pct,
  CASE WHEN count(*) > 0 THEN round(count(prediction_model1) * 100.0 / count(*), 2) END AS prediction_coverage_pct
FROM account_unvoted""", ["account_unvoted"])
def q_coverage(spark, sf):
    return acc.coverage(fx.account_unvoted(spark, sf), "score_model1", "prediction_model1")


@register("admin_stats", """
SELECT CAST(count_if(is_voted = 1) AS BIGINT) AS voted_count, CAST(count_if(is_voted <> 1) AS BIGINT) AS unvoted_count,
  CAST(count(*) AS BIGINT) AS total_accounts,
  (SELECT CAST(count(DISTINCT proposal_master_skey) AS BIGINT) FROM proposals) AS proposals
FROM accounts""", ["accounts", "proposals"])
def q_admin_stats(spark, sf):
    return acc.admin_stats(fx.accounts(spark, sf), fx.proposals(spark, sf))


@register("selected_shares", """
SELECT CAST(count(*) AS BIGINT) AS selected_rows, coalesce(sum(CAST(shares_summable AS DOUBLE)), 0.0) AS selected_shares
FROM account_unvoted u WHERE EXISTS (SELECT 1 FROM outreach o WHERE o.account_hash_key = u.account_hash_key
  AND o.proposal_master_skey = u.proposal_master_skey AND o.director_master_skey = u.director_master_skey)""",
          ["account_unvoted", "outreach"])
def q_selected_shares(spark, sf):
    return acc.selected_shares(fx.account_unvoted(spark, sf), fx.outreach(spark, sf))


@register("filtered_shares", """
WITH a AS (SELECT * FROM accounts WHERE account_type = 'Individual' AND CAST(shares_summable AS DOUBLE) >= 10),
k AS (SELECT 'P' AS key_type, proposal_master_skey AS key_value, * FROM a WHERE proposal_master_skey <> -1
      UNION ALL SELECT 'D', director_master_skey, * FROM a WHERE director_master_skey <> -1)
SELECT key_type, CAST(key_value AS BIGINT) AS key_value,
  CAST(coalesce(sum(CASE WHEN is_voted = 1 AND prediction = 0 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS for_shares,
  CAST(coalesce(sum(CASE WHEN is_voted = 1 AND prediction = 1 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS against_shares,
  CAST(coalesce(sum(CASE WHEN is_voted <> 1 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS unvoted_shares
FROM k GROUP BY key_type, key_value""", ["accounts"])
def q_filtered_shares(spark, sf):
    return acc.filtered_share_sums(fx.accounts(spark, sf), account_type="Individual", shares_min=10)


@register("accounts_sorted", """
SELECT id, shares_summable, score_model1 FROM account_unvoted
ORDER BY shares_summable DESC NULLS LAST, id ASC, proposal_master_skey ASC NULLS FIRST,
  director_master_skey ASC NULLS FIRST, score_model1 ASC NULLS FIRST LIMIT 50 OFFSET 50""", ["account_unvoted"])
def q_accounts_sorted(spark, sf):
    s = acc.sort_accounts(fx.account_unvoted(spark, sf), "shares_summable", ascending=False,
                          tie_break=["id", "proposal_master_skey", "director_master_skey", "score_model1"])
    return s.offset(50).limit(50).select("id", "shares_summable", "score_model1")


_VPAGE = ["id", "proposal_master_skey", "director_master_skey", "shares_summable"]


@register("voted_page", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score_model2, prediction_model2, Target_encoded FROM account_voted
ORDER BY id ASC NULLS FIRST, proposal_master_skey ASC NULLS FIRST, director_master_skey ASC NULLS FIRST,
  shares_summable ASC NULLS FIRST, score_model2 ASC NULLS FIRST LIMIT 50 OFFSET 50""", ["account_voted"])
def q_voted_page(spark, sf):
    p = acc.account_page(fx.account_voted(spark, sf), 2, 50, _VPAGE + ["score_model2"])
    return acc.voted_view(p)


@register("unvoted_page", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score_model1, prediction_model1, Target_encoded FROM account_unvoted
ORDER BY id ASC NULLS FIRST, proposal_master_skey ASC NULLS FIRST, director_master_skey ASC NULLS FIRST,
  shares_summable ASC NULLS FIRST, score_model1 ASC NULLS FIRST LIMIT 50 OFFSET 50""", ["account_unvoted"])
def q_unvoted_page(spark, sf):
    p = acc.account_page(fx.account_unvoted(spark, sf), 2, 50, _VPAGE + ["score_model1"])
    return acc.unvoted_view(p)


@register("voted_view", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score_model2, prediction_model2, Target_encoded FROM account_voted""", ["account_voted"])
def q_voted_view(spark, sf):
    return acc.voted_view(fx.account_voted(spark, sf))


@register("unvoted_view", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score_model1, prediction_model1, in_outreach, Target_encoded FROM (
  SELECT u.*, ok.account_hash_key IS NOT NULL AS in_outreach FROM account_unvoted u
  LEFT JOIN (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach
             WHERE account_hash_key IS NOT NULL) ok
  ON u.account_hash_key = ok.account_hash_key AND u.proposal_master_skey IS NOT DISTINCT FROM ok.proposal_master_skey
  AND u.director_master_skey IS NOT DISTINCT FROM ok.director_master_skey) t""", ["account_unvoted", "outreach"])
def q_unvoted_view(spark, sf):
    return acc.unvoted_view(ot.in_outreach(fx.account_unvoted(spark, sf), fx.outreach(spark, sf)))


@register("effective_key", """
SELECT id, CASE WHEN proposal_master_skey <> -1 THEN 'P' WHEN director_master_skey <> -1 THEN 'D' END AS key_type,
  CAST(CASE WHEN proposal_master_skey <> -1 THEN proposal_master_skey WHEN director_master_skey <> -1 THEN director_master_skey END AS BIGINT) AS key_value
FROM proposals""", ["proposals"])
def q_effective_key(spark, sf):
    return acc.effective_key(fx.proposals(spark, sf)).select("id", "key_type", "key_value")


@register("share_totals", FLAGSHIP_SQL.replace("p.id, p.key_type", "p.key_type").replace(
    "FROM p LEFT JOIN r", "FROM (SELECT DISTINCT key_type, key_value FROM p WHERE key_type IS NOT NULL) p LEFT JOIN r"),
    ["proposals", "accounts"])
def q_share_totals(spark, sf):
    """A4 + A5 per distinct proposal key (no proposal id)."""
    p = acc.effective_key(fx.proposals(spark, sf)).select("key_type", "key_value") \
        .filter(F.col("key_type").isNotNull()).distinct()
    r = acc.rollup_by_key(fx.accounts(spark, sf))
    j = p.join(r, ["key_type", "key_value"], "left")
    f, g = acc._dec0("f"), acc._dec0("g")
    return j.select("key_type", "key_value",
                    F.coalesce(F.col("nv"), F.lit(0)).cast("bigint").alias("voted_accounts"),
                    F.coalesce(F.col("nu"), F.lit(0)).cast("bigint").alias("unvoted_accounts"),
                    acc._dec0("vs").alias("voted_shares"), acc._dec0("us").alias("unvoted_shares"),
                    f.alias("voted_for_shares"), g.alias("voted_against_shares"),
                    acc.shares_needed(f, g).alias("shares_needed"))


@register("for_against_threshold", "WITH " + _CAL_SQL + """,
k AS (SELECT 'P' AS key_type, proposal_master_skey AS key_value, * FROM cal WHERE proposal_master_skey <> -1
      UNION ALL SELECT 'D', director_master_skey, * FROM cal WHERE director_master_skey <> -1)
SELECT key_type, CAST(key_value AS BIGINT) AS key_value,
  CAST(coalesce(sum(CASE WHEN is_voted = 1 AND prediction_model2 <= 0.5 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS for_shares,
  CAST(coalesce(sum(CASE WHEN is_voted = 1 AND prediction_model2 > 0.5 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS against_shares
FROM k GROUP BY key_type, key_value""", ["accounts"])
def q_for_against_threshold(spark, sf):
    """A5 on a calibrated (fractional) prediction with the threshold option."""
    r = acc.rollup_by_key(_calibrated(spark, sf), prediction_col="prediction_model2", against_threshold=0.5)
    return r.select("key_type", "key_value", acc._dec0("f").alias("for_shares"), acc._dec0("g").alias("against_shares"))


# ================================================================ cleaning
from ballotlens.functions import clean as C  # noqa: E402

_DEC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INT_RE = r"^[+-]?[0-9]+$"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def _num_ok(x: str) -> str:
    return f"regexp_matches(trim({x}), '{_DEC_RE}')"


def _raw(spark, sf):
    return fx.raw_values(spark, sf)


def _clean_query(key: str, fn, col: str, sql_expr: str):
    def build(spark, sf):
        r = _raw(spark, sf)
        return r.select("row_id", F.col(col).alias("raw"), fn(F.col(col)).alias("value"))
    register(key, f"SELECT row_id, {col} AS raw, {sql_expr} AS value FROM raw_values", ["raw_values"])(build)


_clean_query("clean_int", C.clean_int, "num_text",
             f"CASE WHEN {_blank('num_text')} OR trim(num_text) = '-1' THEN NULL WHEN {_num_ok('num_text')} "
             "THEN CAST(trunc(CAST(trim(num_text) AS DOUBLE)) AS BIGINT) END")
_clean_query("clean_int_excel", C.clean_int_excel, "num_text",
             f"CASE WHEN {_blank('num_text')} THEN NULL WHEN {_num_ok('num_text')} "
             "THEN CAST(trunc(CAST(trim(num_text) AS DOUBLE)) AS BIGINT) END")
_clean_query("clean_float", C.clean_float, "num_text",
             f"CASE WHEN {_blank('num_text')} THEN NULL WHEN {_num_ok('num_text')} THEN CAST(trim(num_text) AS DOUBLE) END")
_clean_query("clean_numeric", C.clean_numeric, "comma_text",
             f"CASE WHEN {_blank('comma_text')} OR lower(trim(comma_text)) = 'null' THEN NULL "
             f"WHEN regexp_matches(trim(replace(comma_text, ',', '')), '{_DEC_RE}') THEN "
             "CAST(round(TRY_CAST(trim(replace(comma_text, ',', '')) AS DECIMAL(38,10)), 4) AS DECIMAL(38,4)) END")
_clean_query("clean_numeric_sci", lambda c: C.clean_numeric_sci(c, 6), "num_text",
             f"CASE WHEN {_blank('num_text')} THEN NULL "
             "WHEN num_text LIKE '%E+%' OR num_text LIKE '%E-%' OR num_text LIKE '%e+%' OR num_text LIKE '%e-%' "
             f"OR num_text LIKE '%.%' THEN CASE WHEN {_num_ok('num_text')} THEN round(CAST(trim(num_text) AS DOUBLE), 6) END "
             f"WHEN regexp_matches(trim(num_text), '{_INT_RE}') THEN CAST(CAST(trim(num_text) AS BIGINT) AS DOUBLE) END")
_clean_query("clean_bool", C.clean_bool, "bool_text",
             f"CASE WHEN {_blank('bool_text')} THEN NULL WHEN upper(trim(bool_text)) IN ('TRUE', '1', 'YES', 'Y') THEN TRUE "
             "WHEN upper(trim(bool_text)) IN ('FALSE', '0', 'NO', 'N') THEN FALSE END")
_clean_query("clean_bool_tf", C.clean_bool_tf, "bool_text",
             f"CASE WHEN {_blank('bool_text')} THEN NULL WHEN upper(trim(bool_text)) IN ('TRUE', 'T', '1', 'YES', 'Y') THEN TRUE "
             "WHEN upper(trim(bool_text)) IN ('FALSE', 'F', '0', 'NO', 'N') THEN FALSE END")
_clean_query("clean_bool_excel", C.clean_bool_excel, "bool_text",
             "CASE WHEN bool_text IS NULL THEN NULL ELSE lower(bool_text) IN ('true', '1', 'yes', 'y') END")
_clean_query("clean_bool_default", C.clean_bool_default, "bool_text",
             f"CASE WHEN {_blank('bool_text')} THEN FALSE WHEN regexp_matches(trim(bool_text), '{_INT_RE}') "
             "THEN CAST(trim(bool_text) AS BIGINT) <> 0 END")

_D2 = "[0-9]{1,2}"


def _date_sql(t: str, fmts: list[tuple[str, str]]) -> str:
    parts = [f"CASE WHEN regexp_matches({t}, '^{rx}$') THEN CAST(try_strptime({t}, '{f}') AS DATE) END"
             for rx, f in fmts]
    return "coalesce(" + ", ".join(parts) + ")"


_YMD = (f"[0-9]{{4}}-{_D2}-{_D2}", "%Y-%m-%d")
_MDY_SL = (f"{_D2}/{_D2}/[0-9]{{4}}", "%m/%d/%Y")
_DMY_SL = (f"{_D2}/{_D2}/[0-9]{{4}}", "%d/%m/%Y")
_YMD_SL = (f"[0-9]{{4}}/{_D2}/{_D2}", "%Y/%m/%d")
_MDY_DA = (f"{_D2}-{_D2}-[0-9]{{4}}", "%m-%d-%Y")
_DMY_DA = (f"{_D2}-{_D2}-[0-9]{{4}}", "%d-%m-%Y")

_clean_query("clean_date6", C.clean_date6, "date_text",
             f"CASE WHEN {_blank('date_text')} OR lower(trim(date_text)) = 'null' THEN NULL ELSE "
             + _date_sql("trim(date_text)", [_YMD, _MDY_SL, _DMY_SL, _YMD_SL, _MDY_DA, _DMY_DA]) + " END")
_clean_query("clean_date3", C.clean_date3, "date_text",
             f"CASE WHEN {_blank('date_text')} THEN NULL ELSE "
             + _date_sql("trim(date_text)", [_MDY_SL, _YMD, _MDY_DA]) + " END")
_clean_query("clean_date_mdy", C.clean_date_mdy, "date_text",
             f"CASE WHEN {_blank('date_text')} THEN NULL ELSE " + _date_sql("date_text", [_MDY_SL]) + " END")
_clean_query("clean_percentage", C.clean_percentage, "pct_text",
             "CASE WHEN regexp_replace(pct_text, '[^0-9.-]', '', 'g') <> '' AND "
             f"regexp_matches(regexp_replace(pct_text, '[^0-9.-]', '', 'g'), '{_DEC_RE}') "
             "THEN CAST(regexp_replace(pct_text, '[^0-9.-]', '', 'g') AS DOUBLE) END")
_clean_query("clean_tinyint", C.clean_tinyint, "num_text",
             f"CASE WHEN {_blank('num_text')} THEN NULL WHEN {_num_ok('num_text')} "
             "THEN CAST(greatest(0, least(255, CAST(trunc(CAST(trim(num_text) AS DOUBLE)) AS BIGINT))) AS INTEGER) END")
_clean_query("clean_blank", C.clean_blank, "key_text", "nullif(key_text, '')")
_clean_query("clean_director_name", C.clean_director_name, "num_text",
             "CASE WHEN num_text NOT IN ('', '-1') THEN num_text END")
_clean_query("parse_number", C.parse_number, "comma_text",
             "CASE WHEN comma_text = '0x1FFFFFFFFFFFFFFFFF' THEN 590295810358705651712.0 WHEN comma_text = '0x10' THEN 16.0 "
             "WHEN comma_text = '1e400' THEN NULL "
             f"WHEN replace(trim(comma_text), ',', '') <> '' AND regexp_matches(replace(trim(comma_text), ',', ''), "
             f"'{_DEC_RE}') THEN CAST(replace(trim(comma_text), ',', '') AS DOUBLE) END")
_clean_query("coerce_int_zero", C.coerce_int_zero, "num_text",
             f"coalesce(CASE WHEN {_num_ok('num_text')} THEN CAST(round_even(CAST(trim(num_text) AS DOUBLE), 0) AS BIGINT) END, 0)")


@register("drop_blank_keys", """
SELECT row_id, CASE WHEN key_text IS NULL OR key_text IN ('nan', 'None') THEN '' ELSE key_text END AS key_text
FROM raw_values WHERE trim(CASE WHEN key_text IS NULL OR key_text IN ('nan', 'None') THEN '' ELSE key_text END, ' ' || chr(9)) <> ''""",
          ["raw_values"])
def q_drop_blank_keys(spark, sf):
    return C.drop_blank_keys(_raw(spark, sf).select("row_id", "key_text"), "key_text")


@register("non_finite_null", """
SELECT row_id, CASE WHEN isfinite(v) THEN v END AS v, w FROM (
  SELECT row_id, try_cast(key_text AS DOUBLE) AS v, CAST(row_id AS DOUBLE) / 3 AS w FROM raw_values) t""",
          ["raw_values"])
def q_non_finite_null(spark, sf):
    r = _raw(spark, sf).select("row_id", F.col("key_text").try_cast("double").alias("v"),
                               (F.col("row_id").cast("double") / 3).alias("w"))
    return C.non_finite_to_null(r)


@register("clean_truncate", """
SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE substring(text, 1, 500) END AS value FROM documents""")
def q_clean_truncate(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", C.clean_truncate("text").alias("value"))


@register("typed_accounts", """
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, CAST(trunc(CAST(shares_summable AS DOUBLE)) AS BIGINT) AS shares_summable,
  CAST(rank_of_shareholding AS BIGINT) AS rank_of_shareholding, CAST(score_model1 AS DOUBLE) AS score_model1,
  CAST(prediction_model1 AS DOUBLE) AS prediction_model1, CAST(Target_encoded AS BIGINT) AS Target_encoded
FROM account_unvoted""", ["account_unvoted"])
def q_typed_accounts(spark, sf):
    u = fx.account_unvoted(spark, sf).drop("account_type")
    return C.typed_accounts(u, shares_as="int")


# ---------------------------------------------------------------- text helpers
@register("truncate_words", "SELECT doc_id, " + _truncate_sql("text") + " AS value FROM documents")
def q_truncate_words(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", T.truncate_words("text", 10).alias("value"))


@register("percent_text", "SELECT l_orderkey, l_linenumber, " + _pct_sql("l_tax") + " AS value FROM lineitem")
def q_percent_text(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", T.percent_text("l_tax").alias("value"))


@register("row_key", """
SELECT row_id, regexp_replace(coalesce(CASE WHEN key_text IS NOT NULL AND key_text <> '' THEN 'hash_' || key_text END,
  'idx_' || CAST(row_id AS VARCHAR)), '[^a-zA-Z0-9_.:-]', '_', 'g') AS value FROM raw_values""", ["raw_values"])
def q_row_key(spark, sf):
    return _raw(spark, sf).select("row_id", T.row_key(None, "key_text", "row_id").alias("value"))


@register("first_non_blank", """
SELECT row_id, coalesce(CASE WHEN trim(key_text, ' ' || chr(9)) <> '' THEN key_text END, CASE WHEN trim(num_text) <> '' THEN num_text END,
  CASE WHEN trim(comma_text) <> '' THEN comma_text END) AS value FROM raw_values""", ["raw_values"])
def q_first_non_blank(spark, sf):
    return _raw(spark, sf).select("row_id", T.first_non_blank(["key_text", "num_text", "comma_text"]).alias("value"))


# ================================================================ shape + validation (H1-H8, V1-V8)
from ballotlens import schema as S  # noqa: E402
from ballotlens.operators import shape as sh  # noqa: E402
from ballotlens.operators import validate as va  # noqa: E402

_RAW_P_SQL = """rawp AS (SELECT CAST(proposal_master_skey AS VARCHAR) AS "proposal_master_skey",
  CAST(director_master_skey AS VARCHAR) AS "director_master_skey", final_key AS "final_key",
  issuer_name AS "issuer_name", CAST(id % 12 + 1 AS VARCHAR) || '/' || CAST(id % 28 + 1 AS VARCHAR) || '/2024' AS "mt_date",
  CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 28 + 1 AS VARCHAR) || '/' || CAST(id % 12 + 1 AS VARCHAR) || '/2023' END AS "record_date",
  proposal AS "proposal", proposal_type AS "proposal_type",
  CASE WHEN id % 4 = 0 THEN '-1' ELSE 'Name ' || CAST(id AS VARCHAR) END AS "director_name",
  category AS "Category", subcategory AS "Subcategory",
  CAST(predicted_for_shares AS VARCHAR) AS "predicted_for_shares", CAST(total_for_shares AS VARCHAR) AS "total_for_shares",
  '0.' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') AS "For %",
  CASE WHEN id % 5 = 0 THEN 'n/a' ELSE '0.' || lpad(CAST((id * 7) % 10000 AS VARCHAR), 4, '0') END AS "VotingRatio",
  CAST(approved AS VARCHAR) AS "approved", CAST(prediction_correct AS VARCHAR) AS "prediction_correct",
  CAST(id % 7 AS VARCHAR) || '.5%' AS "Against (%) - From Prospectus 2026 File", 'x' AS "merge_flag"
FROM proposals)"""


def _raw_proposals(spark, sf):
    p = fx.proposals(spark, sf)
    i = F.col("id")
    s = lambda c: F.col(c).cast("string")
    return p.select(
        s("proposal_master_skey").alias("proposal_master_skey"), s("director_master_skey").alias("director_master_skey"),
        F.col("final_key"), F.col("issuer_name"),
        F.concat((i % 12 + 1).cast("string"), F.lit("/"), (i % 28 + 1).cast("string"), F.lit("/2024")).alias("mt_date"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.concat((i % 28 + 1).cast("string"), F.lit("/"),
                                                         (i % 12 + 1).cast("string"), F.lit("/2023"))).alias("record_date"),
        F.col("proposal"), F.col("proposal_type"),
        F.when(i % 4 == 0, F.lit("-1")).otherwise(F.concat(F.lit("Name "), i.cast("string"))).alias("director_name"),
        F.col("category").alias("Category"), F.col("subcategory").alias("Subcategory"),
        s("predicted_for_shares").alias("predicted_for_shares"), s("total_for_shares").alias("total_for_shares"),
        F.concat(F.lit("0."), F.lpad((i % 10000).cast("string"), 4, "0")).alias("For %"),
        F.when(i % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("0."), F.lpad(((i * 7) % 10000).cast("string"), 4, "0")))
        .alias("VotingRatio"),
        s("approved").alias("approved"), s("prediction_correct").alias("prediction_correct"),
        F.concat((i % 7).cast("string"), F.lit(".5%")).alias("Against (%) - From Prospectus 2026 File"),
        F.lit("x").alias("merge_flag"),
    )


_RAW_P_COLS = {"proposal_master_skey", "director_master_skey", "final_key", "issuer_name", "mt_date", "record_date",
               "proposal", "proposal_type", "director_name", "Category", "Subcategory", "predicted_for_shares",
               "total_for_shares", "For %", "VotingRatio", "approved", "prediction_correct",
               "Against (%) - From Prospectus 2026 File"}
_SQL_TYPE = {"int": "BIGINT", "str": "VARCHAR", "date": "DATE", "dirname": "VARCHAR", "float": "DOUBLE",
             "bool": "BOOLEAN"}


def _norm_sql_expr(header: str, kind: str, float_mode: str) -> str:
    if header not in _RAW_P_COLS:
        return f"CAST(NULL AS {_SQL_TYPE[kind]})"
    x = f'"{header}"'
    if kind == "int":
        return (f"CASE WHEN {_blank(x)} OR trim({x}) = '-1' THEN NULL WHEN {_num_ok(x)} "
                f"THEN CAST(trunc(CAST(trim({x}) AS DOUBLE)) AS BIGINT) END")
    if kind == "float":
        if float_mode == "numeric":
            return (f"CASE WHEN {_blank(x)} OR lower(trim({x})) = 'null' THEN NULL "
                    f"WHEN regexp_matches(trim(replace({x}, ',', '')), '{_DEC_RE}') THEN "
                    f"CAST(round(CAST(trim(replace({x}, ',', '')) AS DECIMAL(38,10)), 4) AS DOUBLE) END")
        return f"CASE WHEN {_blank(x)} THEN NULL WHEN {_num_ok(x)} THEN CAST(trim({x}) AS DOUBLE) END"
    if kind == "bool":
        return (f"CASE WHEN {_blank(x)} THEN NULL WHEN upper(trim({x})) IN ('TRUE', '1', 'YES', 'Y') THEN TRUE "
                f"WHEN upper(trim({x})) IN ('FALSE', '0', 'NO', 'N') THEN FALSE END")
    if kind == "date":
        return (f"CASE WHEN {_blank(x)} OR lower(trim({x})) = 'null' THEN NULL ELSE "
                + _date_sql(f"trim({x})", [_YMD, _MDY_SL, _DMY_SL, _YMD_SL, _MDY_DA, _DMY_DA]) + " END")
    if kind == "dirname":
        return f"CASE WHEN {x} NOT IN ('', '-1') THEN {x} END"
    return f"nullif({x}, '')"


def _normalise_select(float_mode: str) -> str:
    cols = ", ".join(f"{_norm_sql_expr(h, k, float_mode)} AS {n}" for n, h, k in S.PROPOSAL_FIELDS)
    return f"SELECT {cols} FROM rawp"


def _normalise_sql(float_mode: str) -> str:
    return f"WITH {_RAW_P_SQL}\n{_normalise_select(float_mode)}"


@register("normalise_proposals", _normalise_sql("float"), ["proposals"])
def q_normalise_proposals(spark, sf):
    return sh.normalise_proposals(_raw_proposals(spark, sf), "float")


@register("normalise_proposals_numeric", _normalise_sql("numeric"), ["proposals"])
def q_normalise_proposals_numeric(spark, sf):
    return sh.normalise_proposals(_raw_proposals(spark, sf), "numeric")


@register("alias_columns", """
SELECT id, account_hash_key, score_model2, prediction_model2, Target_encoded FROM account_voted""", ["account_voted"])
def q_alias_columns(spark, sf):
    v = fx.account_voted(spark, sf).select("id", "account_hash_key", F.col("score_model2").alias("score"),
                                           F.col("prediction_model2").alias("prediction_model"),
                                           F.col("Target_encoded").alias("target"))
    return sh.alias_columns(v)


_UNV_EXPECTED = ["account_hash_key", "proposal_master_skey", "director_master_skey", "account_type",
                 "shares_summable", "rank_of_shareholding", "score_model1", "prediction_model1", "Target_encoded"]


@register("fuzzy_alias", "SELECT " + ", ".join(_UNV_EXPECTED) + " FROM account_unvoted", ["account_unvoted"])
def q_fuzzy_alias(spark, sf):
    u = fx.account_unvoted(spark, sf).select(
        F.col("account_hash_key").alias("Account_Hash_Key_v2"), F.col("proposal_master_skey"),
        F.col("director_master_skey"), F.col("account_type").alias("TYPE"), F.col("shares_summable").alias("shares"),
        F.col("rank_of_shareholding"), F.col("score_model1"), F.col("prediction_model1"),
        F.col("Target_encoded").alias("target_encoded"))
    # 'TYPE' is contained in 'account_type'; 'shares' in 'shares_summable'
    return sh.fuzzy_alias(u, _UNV_EXPECTED)


@register("copy_if_missing", """
SELECT id, score_model1, prediction_model1, score_model1 AS score_model2, prediction_model1 AS prediction_model2
FROM account_unvoted""", ["account_unvoted"])
def q_copy_if_missing(spark, sf):
    u = fx.account_unvoted(spark, sf).select("id", "score_model1", "prediction_model1")
    return sh.copy_if_missing(u)


@register("select_available", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score_model2, prediction_model2, Target_encoded FROM account_voted""", ["account_voted"])
def q_select_available(spark, sf):
    req = ["account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable",
           "rank_of_shareholding", "score_model2", "prediction_model2", "Target_encoded", "unnamed_col"]
    out, _missing = sh.select_available(fx.account_voted(spark, sf), req)
    return out


@register("align_columns", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable, rank_of_shareholding
FROM account_unvoted""", ["account_unvoted"])
def q_align_columns(spark, sf):
    return sh.align_to_target(fx.account_unvoted(spark, sf), fx.outreach(spark, sf).columns)


@register("drop_prefixed", "WITH " + _RAW_P_SQL + """
SELECT * EXCLUDE (merge_flag) FROM rawp""", ["proposals"])
def q_drop_prefixed(spark, sf):
    return sh.drop_prefixed(_raw_proposals(spark, sf))


@register("slim_accounts", """
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding FROM outreach""", ["outreach"])
def q_slim_accounts(spark, sf):
    o = fx.outreach(spark, sf).select(F.lit(1).alias("row_index"), F.lit("u").alias("unnamed_col"), "*")
    return sh.drop_redundant(o)


def _js_num_sql(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    return (f"CASE WHEN {t} = '' THEN 0.0 WHEN regexp_matches({t}, '{_DEC_RE}') THEN TRY_CAST({t} AS DOUBLE) "
            f"WHEN regexp_matches({t}, '^0[xX][0-9a-fA-F]+$') THEN 16.0 "   # only whether it's finite and whole counts
            f"WHEN {t} IN ('Infinity', '+Infinity') THEN CAST('inf' AS DOUBLE) WHEN {t} = '-Infinity' THEN CAST('-inf' AS DOUBLE) END")


def _any_date_sql(x: str) -> str:
    return (f"CASE WHEN {_blank(x)} OR lower(trim({x})) = 'null' THEN NULL ELSE "
            + _date_sql(f"trim({x})", [_YMD, _MDY_SL, _DMY_SL, _YMD_SL, _MDY_DA, _DMY_DA]) + " END")


def _type_ok_sql(x: str, kind: str) -> str:
    n = _js_num_sql(x)
    if kind == "int":
        ok = f"(regexp_matches({x}, '^-?[0-9]+$') OR coalesce(isfinite({n}) AND floor({n}) = {n}, FALSE))"
    elif kind == "float":
        ok = f"coalesce(isfinite({n}), FALSE)"
    elif kind == "bool":
        ok = f"{x} IN ('0', '1', 'true', 'false')"
    elif kind == "date":
        ok = f"({_any_date_sql(x)}) IS NOT NULL"
    else:
        ok = "TRUE"
    return f"({x} IS NULL OR {x} = '' OR {ok})"


_V2_CHECKS = {"num_text": "int", "comma_text": "float", "bool_text": "bool", "date_text": "date", "key_text": "string"}


@register("type_violations", "\nUNION ALL\n".join(
    f"SELECT row_id, '{c}' AS column, '{k}' AS expected, {c} AS got FROM raw_values WHERE NOT {_type_ok_sql(c, k)}"
    for c, k in _V2_CHECKS.items()), ["raw_values"])
def q_type_violations(spark, sf):
    return va.type_violations(_raw(spark, sf), _V2_CHECKS, "row_id", n=None)


@register("type_violations_sample", "WITH s AS (SELECT *, CAST(row_number() OVER (ORDER BY row_id) + 1 AS INTEGER) AS row "
          "FROM (SELECT * FROM raw_values ORDER BY row_id LIMIT 10) t)\n" + "\nUNION ALL\n".join(
    f"SELECT row, row_id, '{c}' AS column, '{k}' AS expected, {c} AS got FROM s WHERE NOT {_type_ok_sql(c, k)}"
    for c, k in _V2_CHECKS.items()), ["raw_values"])
def q_type_violations_sample(spark, sf):
    return va.type_violations(_raw(spark, sf), _V2_CHECKS, "row_id", n=10)


@register("type_violation_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, '{k}' AS expected, CAST(coalesce(count_if(NOT {_type_ok_sql(c, k)}), 0) AS BIGINT) AS violations FROM raw_values"
    for c, k in _V2_CHECKS.items()), ["raw_values"])
def q_type_violation_counts(spark, sf):
    return va.type_violation_counts(_raw(spark, sf), _V2_CHECKS)


def _fits_sql(x: str, kind: str) -> str:
    d = f"CASE WHEN {_num_ok(x)} THEN TRY_CAST(trim({x}) AS DOUBLE) END"
    if kind == "int":
        ok = f"coalesce(floor({d}) = {d} AND {d} BETWEEN -2147483648 AND 2147483647, FALSE)"
    elif kind == "float":
        ok = f"coalesce(abs({d}) < 1e14, FALSE)"
    elif kind == "bool":
        ok = f"{x} IN ('0', '1', 'true', 'false')"
    elif kind == "date":
        ok = f"({_any_date_sql(x)}) IS NOT NULL"
    else:
        ok = f"length({x}) <= 255"
    return f"({x} IS NULL OR {x} = '' OR {ok})"


@register("fit_violations", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, '{k}' AS expected, CAST(coalesce(count_if(NOT {_fits_sql(c, k)}), 0) AS BIGINT) AS violations, "
    f"min(CASE WHEN NOT {_fits_sql(c, k)} THEN {c} END) AS example FROM raw_values"
    for c, k in _V2_CHECKS.items()), ["raw_values"])
def q_fit_violations(spark, sf):
    return va.fit_violations(_raw(spark, sf), _V2_CHECKS)


@register("verify_dataset", """
SELECT proposal_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT lower(rtrim(issuer_name))) AS BIGINT) AS issuers,
  min(mt_date) AS first_meeting, max(mt_date) AS last_meeting FROM proposals GROUP BY proposal_type""",
          ["proposals"])
def q_verify_dataset(spark, sf):
    return va.verify_dataset(fx.proposals(spark, sf), "proposal_type")


@register("format_check", """
SELECT TRUE AS columns_in_order, FALSE AS old_format, CAST(count(*) AS BIGINT) AS rows_checked,
  CAST(coalesce(count_if(NOT coalesce(account_type IN ('Individual', 'Institution', 'Mutual Fund', 'Other'), FALSE)), 0) AS BIGINT) AS bad_account_type,
  CAST(coalesce(count_if(NOT coalesce(CAST(prediction_model1 AS VARCHAR) IN ('0', '1', '0.0', '1.0'), FALSE)), 0) AS BIGINT) AS bad_prediction,
  CAST(coalesce(count_if(coalesce(trim(account_hash_key) = '', TRUE)), 0) AS BIGINT) AS empty_hash
FROM account_unvoted""", ["account_unvoted"])
def q_format_check(spark, sf):
    return va.format_check(fx.account_unvoted(spark, sf).select(*S.ACCOUNT_FILE_COLUMNS))


@register("load_completeness", """
SELECT CAST(count(*) AS BIGINT) AS total, (SELECT CAST(count(*) AS BIGINT) FROM account_voted) AS current,
  CAST(greatest(count(*) - (SELECT count(*) FROM account_voted), 0) AS BIGINT) AS remaining,
  (SELECT count(*) FROM account_voted) >= count(*) AS complete FROM accounts""", ["accounts", "account_voted"])
def q_load_completeness(spark, sf):
    return va.load_completeness(fx.accounts(spark, sf), fx.account_voted(spark, sf))


@register("load_report", "WITH " + _RAW_P_SQL + """
SELECT CAST(count(*) AS BIGINT) AS imported, CAST(0 AS BIGINT) AS errors, CAST(count_if(bad) AS BIGINT) AS rows_with_bad_cells,
  CAST(count_if(bad) AS BIGINT) AS bad_cells FROM (
  SELECT ("VotingRatio" IS NOT NULL AND trim("VotingRatio") <> '' AND NOT """ + _num_ok('"VotingRatio"') + """) AS bad
  FROM rawp) t""", ["proposals"])
def q_load_report(spark, sf):
    """V7: every row is imported; cells that don't parse are counted."""
    raw = _raw_proposals(spark, sf)
    rows = raw.select("*", sh.proposal_errors(raw).alias("_errors"))
    return va.load_report(rows)


@register("cell_errors", "WITH " + _RAW_P_SQL + """
SELECT 'voting_ratio' AS field, CAST(count(*) AS BIGINT) AS bad_cells FROM rawp
WHERE "VotingRatio" IS NOT NULL AND trim("VotingRatio") <> '' AND NOT """ + _num_ok('"VotingRatio"') + """ HAVING count(*) > 0""", ["proposals"])
def q_cell_errors(spark, sf):
    raw = _raw_proposals(spark, sf)
    return va.cell_errors(raw.select(sh.proposal_errors(raw).alias("_errors")))


@register("table_counts", """
SELECT dataset, CASE WHEN is_voted = 1 THEN 'account_voted' ELSE 'account_unvoted' END AS "table", CAST(count(*) AS BIGINT) AS rows
FROM accounts_by_model GROUP BY 1, 2
UNION ALL SELECT dataset, 'total', CAST(count(*) AS BIGINT) FROM accounts_by_model GROUP BY 1""", ["accounts_by_model"])
def q_table_counts(spark, sf):
    return va.table_counts(fx.accounts_by_model(spark, sf))


_FOUND = ["account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable", "id", "score_model1"]


@register("column_diff", "\nUNION ALL\n".join(
    f"SELECT '{k}' AS kind, '{c}' AS column, {i} AS position, "
    + (f"CAST(count_if(trim(CAST({c} AS VARCHAR)) <> '') AS BIGINT)" if k != "missing" else "CAST(0 * count(*) AS BIGINT)") + " AS filled FROM account_unvoted"
    for c, k, i in [*((c, "ok" if c in _FOUND else "missing", i) for i, c in enumerate(S.ACCOUNT_CHECKS)),
                    *((c, "extra", i) for i, c in enumerate(_FOUND) if c not in S.ACCOUNT_CHECKS)]), ["account_unvoted"])
def q_column_diff(spark, sf):
    """V1: expected and found columns, with how many rows fill each."""
    return va.column_fill(fx.account_unvoted(spark, sf).select(*_FOUND), list(S.ACCOUNT_CHECKS))


@register("table_inventory")
def q_table_inventory(spark, sf):
    import os
    return va.table_inventory(spark, {t: os.path.join(sf, f"{t}.parquet") for t in fx.TABLES})


# ================================================================ sources / sinks / streaming
import os  # noqa: E402
import uuid  # noqa: E402

from ballotlens.session import scratch_path  # noqa: E402
from ballotlens.sources import dumps, generate, readers, sinks, textscan  # noqa: E402
from ballotlens.streaming.resumable import resumable_load  # noqa: E402


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("insert_batches", """
WITH l AS (SELECT line_no, CASE WHEN regexp_matches(line, '^INSERT INTO `([^`]*)` VALUES \\((.*)\\);$')
    THEN regexp_extract(line, '^INSERT INTO `([^`]*)`', 1) END AS tbl FROM dump_lines),
p AS (SELECT *, lag(tbl) OVER (ORDER BY line_no) AS prev, row_number() OVER (ORDER BY line_no) AS idx FROM l),
s AS (SELECT *, tbl IS NOT NULL AND (prev IS NULL OR prev <> tbl) AS st FROM p),
r AS (SELECT *, max(CASE WHEN st THEN idx END) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sidx,
        max(CASE WHEN st THEN line_no END) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sline FROM s)
SELECT tbl AS table_name, sline AS run_start, CAST(floor((idx - sidx) / 50) AS BIGINT) AS batch_no,
  min(line_no) AS first_line, max(line_no) AS last_line, CAST(count(*) AS BIGINT) AS n_lines
FROM r WHERE tbl IS NOT NULL GROUP BY 1, 2, 3""", ["dump_lines"])
def q_insert_batches(spark, sf):
    return dumps.insert_statement_batches(fx.dump_lines(spark, sf), batch_size=50, block_lines=4096)


@register("repair_text", "SELECT doc_id, replace(replace(text, chr(65533), ''), chr(0), '') AS text FROM documents")
def q_repair_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", textscan.repair_text("text").alias("text"))


@register("repair_text_ascii", """
SELECT doc_id, regexp_replace(replace(replace(text, chr(65533), ''), chr(0), ''), '[^\\x00-\\x7F]', '', 'g') AS text FROM documents""")
def q_repair_text_ascii(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", textscan.repair_text("text", drop_non_ascii=True).alias("text"))


_LINES_SQL = """ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM documents)"""


@register("non_ascii_profile", "WITH " + _LINES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count_if(regexp_matches(line, '[^\\x00-\\x7F]')) AS BIGINT) AS non_ascii_lines,
  CAST(count(DISTINCT CASE WHEN regexp_matches(line, '[^\\x00-\\x7F]') THEN doc_id END) AS BIGINT) AS non_ascii_texts FROM ln""")
def q_non_ascii_profile(spark, sf):
    return textscan.non_ascii_profile(fx.table(spark, sf, "documents"), "text", "doc_id")


@register("non_ascii_lines", "WITH " + _LINES_SQL + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
  CAST(strpos(line, regexp_extract(line, '[^\\x00-\\x7F]')) AS INTEGER) AS position
FROM ln WHERE regexp_matches(line, '[^\\x00-\\x7F]')""")
def q_non_ascii_lines(spark, sf):
    return textscan.non_ascii_lines(fx.table(spark, sf, "documents"), "text", "doc_id") \
        .select("doc_id", F.col("line_no").cast("int").alias("line_no"), "position")


@register("non_ascii_first", "WITH " + _LINES_SQL + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
  CAST(strpos(line, regexp_extract(line, '[^\\x00-\\x7F]')) AS INTEGER) AS position
FROM ln WHERE regexp_matches(line, '[^\\x00-\\x7F]') ORDER BY doc_id, line_no LIMIT 5""")
def q_non_ascii_first(spark, sf):
    return textscan.first_non_ascii(fx.table(spark, sf, "documents"), "text", "doc_id", 5) \
        .select("doc_id", F.col("line_no").cast("int").alias("line_no"), "position")


@register("src_accounts_parquet", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def q_src_accounts_parquet(spark, sf):
    return readers.read_accounts_parquet(spark, os.path.join(sf, "lineitem.parquet"),
                                         columns=["l_orderkey", "l_partkey", "l_quantity"])


@register("src_multi_dataset", """
SELECT *, 'parts' AS dataset FROM part UNION ALL BY NAME SELECT *, 'suppliers' AS dataset FROM supplier""")
def q_src_multi_dataset(spark, sf):
    routes = {os.path.join(sf, "part.parquet"): "parts", os.path.join(sf, "no_such_table.parquet"): "missing",
              os.path.join(sf, "supplier.parquet"): "suppliers"}
    return readers.load_datasets(spark, routes)


@register("sample_rows", """
SELECT * FROM account_voted ORDER BY id ASC NULLS FIRST, proposal_master_skey ASC NULLS FIRST,
  director_master_skey ASC NULLS FIRST, shares_summable ASC NULLS FIRST, score_model2 ASC NULLS FIRST LIMIT 3""",
          ["account_voted"])
def q_sample_rows(spark, sf):
    return readers.sample_rows(fx.account_voted(spark, sf), 3, _VPAGE + ["score_model2"])


@register("src_parquet_inventory")
def q_src_parquet_inventory(spark, sf):
    return readers.parquet_inventory(spark.read.parquet(os.path.join(sf, "lineitem.parquet")))


def _pseudonym_sql(x: str, n: int) -> str:
    return f"substr(sha256('sample|' || {x}), 1, {n})"


@register("gen_accounts", f"""
SELECT id, {_pseudonym_sql('account_hash_key', 24)} AS account_hash_key, proposal_master_skey, director_master_skey, account_type,
  CAST(floor(shares_summable / 100) * 100 AS BIGINT) AS shares_summable, prediction, is_voted FROM accounts""", ["accounts"])
def q_gen_accounts(spark, sf):
    """Sample account rows, hash keys replaced and shares coarsened."""
    return generate.sample_accounts(fx.accounts(spark, sf), "sample").select(
        "id", "account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable", "prediction", "is_voted")


@register("gen_proposals", f"""
SELECT id, 'Issuer ' || {_pseudonym_sql('lower(rtrim(issuer_name))', 8)} AS issuer_name, {_pseudonym_sql('final_key', 12)} AS final_key,
  'Proposal ' || CAST(id AS VARCHAR) AS proposal, category, approved FROM proposals""", ["proposals"])
def q_gen_proposals(spark, sf):
    return generate.sample_proposals(fx.proposals(spark, sf), "sample").select("id", "issuer_name", "final_key", "proposal", "category", "approved")


@register("src_proposals_csv", "WITH " + _RAW_P_SQL + "\nSELECT * FROM (" + _normalise_select("float")
          + ") a\nUNION ALL\nSELECT * FROM (" + _normalise_select("float") + ") b", ["proposals"])
def q_src_proposals_csv(spark, sf):
    """Two CSV files whose columns come in different orders, bound by header name."""
    raw = _raw_proposals(spark, sf)
    p1, p2 = _scratch(spark, "csv-a"), _scratch(spark, "csv-b")
    opts = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.write.options(**opts).mode("overwrite").csv(p1)
    raw.select(*reversed(raw.columns)).write.options(**opts).mode("overwrite").csv(p2)
    return sh.normalise_proposals(readers.read_proposals_csv(spark, [p1, p2]))


@register("resumable_load", "SELECT * FROM events")
def q_resumable_load(spark, sf):
    """Events split into files, loaded in two interrupted rounds, then re-run:
    every row once."""
    src, dst, ck = _scratch(spark, "rl-src"), _scratch(spark, "rl-dst"), _scratch(spark, "rl-ck")
    ev = fx.table(spark, sf, "events")
    first = ev.filter(F.col("event_id") % 3 != 0)
    first.repartition(4, "event_id").write.mode("overwrite").parquet(src)
    resumable_load(spark, src, dst, ck, max_files_per_trigger=2)
    ev.filter(F.col("event_id") % 3 == 0).repartition(2, "event_id").write.mode("append").parquet(src)
    resumable_load(spark, src, dst, ck, max_files_per_trigger=2)
    resumable_load(spark, src, dst, ck, max_files_per_trigger=2)
    return spark.read.parquet(dst)


# ================================================================ remaining inventory keys
@register("for_against", """
WITH k AS (SELECT 'P' AS key_type, proposal_master_skey AS key_value, * FROM accounts WHERE proposal_master_skey <> -1
      UNION ALL SELECT 'D', director_master_skey, * FROM accounts WHERE director_master_skey <> -1)
SELECT key_type, CAST(key_value AS BIGINT) AS key_value,
  CAST(coalesce(sum(CASE WHEN is_voted = 1 AND prediction = 0 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS for_shares,
  CAST(coalesce(sum(CASE WHEN is_voted = 1 AND prediction = 1 THEN shares_summable END), 0) AS DECIMAL(38,2)) AS against_shares
FROM k GROUP BY key_type, key_value""", ["accounts"])
def q_for_against(spark, sf):
    """A5: voted For (prediction exactly 0) / Against (exactly 1) shares per key."""
    r = acc.rollup_by_key(fx.accounts(spark, sf))
    return r.select("key_type", "key_value", acc._dec0("f").alias("for_shares"), acc._dec0("g").alias("against_shares"))


@register("shares_needed", """
SELECT id, predicted_for_shares, predicted_against_shares,
  CAST(CASE WHEN predicted_against_shares > predicted_for_shares THEN predicted_against_shares - predicted_for_shares END
       AS DECIMAL(38,2)) AS shares_needed FROM proposals""", ["proposals"])
def q_shares_needed(spark, sf):
    """A22 on the proposal's predicted shares (a NULL side gives no value)."""
    p = fx.proposals(spark, sf)
    return p.select("id", "predicted_for_shares", "predicted_against_shares",
                    acc.shares_needed(F.col("predicted_for_shares"), F.col("predicted_against_shares"))
                    .alias("shares_needed"))


@register("duplicate_messages", """
SELECT account_hash_key, proposal_master_skey, director_master_skey,
  'account_hash_key(' || coalesce(CAST(account_hash_key AS VARCHAR), 'null') || ')+proposal_master_skey('
  || coalesce(CAST(proposal_master_skey AS VARCHAR), 'null') || ')+director_master_skey('
  || coalesce(CAST(director_master_skey AS VARCHAR), 'null') || ') is not inserted because it is already in outreach table' AS message
FROM outreach""", ["outreach"])
def q_duplicate_messages(spark, sf):
    return ot.duplicate_messages(fx.outreach(spark, sf))


@register("clean_date_any", f"SELECT row_id, {_any_date_sql('date_text')} AS value FROM raw_values", ["raw_values"])
def q_clean_date_any(spark, sf):
    """Date / timestamp values or text in ISO or one of the six layouts."""
    r = _raw(spark, sf)
    return r.select("row_id", C.date_from_any("date_text").alias("value"))


@register("varchar_limits", """
SELECT * FROM (VALUES
  ('final_key', 1000, (SELECT CAST(count_if(length(final_key) > 1000) AS BIGINT) FROM proposals)),
  ('issuer_name', 200, (SELECT CAST(count_if(length(issuer_name) > 200) AS BIGINT) FROM proposals)),
  ('proposal_type', 50, (SELECT CAST(count_if(length(proposal_type) > 50) AS BIGINT) FROM proposals)),
  ('category', 50, (SELECT CAST(count_if(length(category) > 50) AS BIGINT) FROM proposals)),
  ('subcategory', 50, (SELECT CAST(count_if(length(subcategory) > 50) AS BIGINT) FROM proposals))) t("column", max_length, violations)""",
          ["proposals"])
def q_varchar_limits(spark, sf):
    return va.varchar_violations(fx.proposals(spark, sf), S.VARCHAR_LIMITS)


_CSV_COLS = ["account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable",
             "rank_of_shareholding", "score_model2", "prediction_model2", "Target_encoded"]


@register("csv_roundtrip", "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CSV_COLS)
          + " FROM account_voted", ["account_voted"])
def q_csv_roundtrip(spark, sf):
    """S9 + S2: export the voted accounts as header CSV, read them back by name (text)."""
    path = _scratch(spark, "csv-export")
    sinks.write_csv(fx.account_voted(spark, sf).select(*_CSV_COLS), path)
    return readers.read_accounts_csv(spark, path, multi_line=False)


# ================================================================ bulk loads (L1 path)
from ballotlens.plans import load as ld  # noqa: E402


@register("load_accounts", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type,
  CAST(shares_summable AS DECIMAL(20,4)) AS shares_summable, CAST(rank_of_shareholding AS BIGINT) AS rank_of_shareholding,
  CAST(score_model1 AS DECIMAL(20,15)) AS score_model2, CAST(prediction_model1 AS DECIMAL(10,6)) AS prediction_model2,
  CAST(Target_encoded AS BIGINT) AS Target_encoded, 0 AS is_voted, 'sds' AS dataset
FROM account_unvoted WHERE account_hash_key IS NOT NULL AND trim(account_hash_key) <> ''""", ["account_unvoted"])
def q_load_accounts(spark, sf):
    """Unvoted account file (model-1 names) -> typed, clustered, partitioned table."""
    target = _scratch(spark, "accounts-table")
    ld.load_accounts(fx.account_unvoted(spark, sf), target, dataset="sds", is_voted=0)
    t = spark.read.parquet(target)
    return t.select(*ld.ACCOUNT_OUT, F.col("is_voted").cast("int").alias("is_voted"), "dataset")


@register("load_proposals", "WITH " + _RAW_P_SQL + ",\nn AS (" + _normalise_select("float") + ")\nSELECT *, 'proxy' AS dataset FROM n",
          ["proposals"])
def q_load_proposals(spark, sf):
    """Proposal CSV text -> normalised rows, all of them; a bad cell is NULL."""
    target = _scratch(spark, "proposals-table")
    ld.load_proposals(_raw_proposals(spark, sf), target, dataset="proxy")
    t = spark.read.parquet(target)
    return t.select(*[n for n, _, _ in S.PROPOSAL_FIELDS], "dataset")


@register("load_narrow_proposals", """
SELECT CASE WHEN id % 6 <> 0 THEN proposal_master_skey END AS proposal_master_skey, director_master_skey,
  CASE WHEN issuer_name IS NOT NULL AND trim(issuer_name) <> '' THEN issuer_name END AS issuer_name, category, proposal,
  coalesce(prediction_correct, FALSE) AS prediction_correct, coalesce(approved, FALSE) AS approved,
  CASE WHEN id % 4 = 0 THEN NULL ELSE round(CAST(id AS DOUBLE) / 8, 6) END AS for_percentage,
  CAST(predicted_for_shares AS DOUBLE) AS predicted_for_shares, mt_date AS meeting_date, 'narrow' AS dataset
FROM proposals WHERE id % 7 <> 0""", ["proposals"])
def q_load_narrow_proposals(spark, sf):
    """The narrow form: rows with a bad key are rejected, other bad cells NULL."""
    p, i = fx.proposals(spark, sf), F.col("id")
    flag = lambda c: F.col(c).cast("int").cast("string").alias(c)
    raw = p.select(
        F.when(i % 7 == 0, F.lit("12a")).when(i % 6 == 0, F.lit(" ")).otherwise(F.col("proposal_master_skey").cast("string")).alias("proposal_master_skey"),
        F.col("director_master_skey").cast("string").alias("director_master_skey"), "issuer_name", "category", "proposal",
        flag("prediction_correct"), flag("approved"),
        F.when(i % 4 == 0, F.lit("n/a")).otherwise(F.format_string("%.4f", i / 8)).alias("for_percentage"),
        F.col("predicted_for_shares").cast("string").alias("predicted_for_shares"), F.date_format("mt_date", "M/d/yyyy").alias("meeting_date"))
    target = _scratch(spark, "narrow-table")
    ld.load_narrow_proposals(raw, target, dataset="narrow", rejects_path=_scratch(spark, "narrow-rejects"))
    return spark.read.parquet(target).select(
        "proposal_master_skey", "director_master_skey", "issuer_name", "category", "proposal", "prediction_correct", "approved",
        "for_percentage", "predicted_for_shares", "meeting_date", "dataset")


@register("normalise_excel", "WITH " + _RAW_P_SQL + f"""
SELECT final_key, director_name, CASE WHEN {_num_ok("proposal_master_skey")} THEN CAST(trunc(CAST(trim(proposal_master_skey) AS DOUBLE)) AS BIGINT) END
    AS proposal_master_skey, CAST(predicted_for_shares AS DOUBLE) AS predicted_for_shares,
  CASE WHEN {_num_ok('"VotingRatio"')} THEN CAST("VotingRatio" AS DOUBLE) END AS voting_ratio,
  {_any_date_sql("mt_date")} AS mt_date, {_any_date_sql("record_date")} AS record_date, lower(approved) = 'true' AS approved,
  CAST(replace("Against (%) - From Prospectus 2026 File", '%', '') AS DOUBLE) AS against_prospectus_2026 FROM rawp""", ["proposals"])
def q_normalise_excel(spark, sf):
    """H5, rows read out of a spreadsheet: text and -1 are kept."""
    return sh.normalise_excel_proposals(_raw_proposals(spark, sf)).select(
        "final_key", "director_name", "proposal_master_skey", "predicted_for_shares", "voting_ratio", "mt_date", "record_date",
        "approved", "against_prospectus_2026")


_OUT_TYPED = """CAST(proposal_master_skey AS BIGINT) AS proposal_master_skey, CAST(director_master_skey AS BIGINT) AS director_master_skey,
  account_type, CAST(shares_summable AS DOUBLE) AS shares_summable, CAST(rank_of_shareholding AS BIGINT) AS rank_of_shareholding"""


@register("load_outreach", f"""
WITH f AS (SELECT account_hash_key, CASE WHEN proposal_master_skey <> -1 THEN proposal_master_skey END AS proposal_master_skey,
    CASE WHEN director_master_skey <> -1 THEN director_master_skey END AS director_master_skey, account_type, shares_summable, rank_of_shareholding
  FROM account_unvoted),
r AS (SELECT account_hash_key, {_OUT_TYPED} FROM f)
SELECT * FROM r WHERE NOT ({_KEYS_NN})
UNION ALL SELECT * FROM (SELECT DISTINCT ON (account_hash_key, proposal_master_skey, director_master_skey) * FROM r WHERE {_KEYS_NN}
  ORDER BY account_hash_key, proposal_master_skey, director_master_skey, account_type NULLS FIRST, shares_summable NULLS FIRST,
    rank_of_shareholding NULLS FIRST) t""", ["account_unvoted"])
def q_load_outreach(spark, sf):
    """An outreach CSV loaded twice: the second load adds only rows whose key
    triple has a NULL, which never conflict, so it's cleared of them first."""
    cols = ["account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable", "rank_of_shareholding"]
    path, target = _scratch(spark, "outreach-csv"), _scratch(spark, "outreach-table")
    sinks.write_csv(fx.account_unvoted(spark, sf).select(*cols), path)
    raw = readers.read_accounts_csv(spark, path)
    ld.load_outreach(raw, target, "proxy")
    rows = ld.prepare_outreach(raw)
    full = rows.filter(F.expr(_KEYS_NN))
    sinks.copy_table(full, target, ot.copy_rows, dataset="proxy", order=ot.OUTREACH_COLUMNS)
    return spark.read.parquet(target).select(*cols)


@register("load_accounts_fill_zero", """
SELECT account_hash_key, CAST(coalesce(proposal_master_skey, 0) AS BIGINT) AS proposal_master_skey,
  CAST(coalesce(director_master_skey, 0) AS BIGINT) AS director_master_skey, coalesce(nullif(account_type, 'Other'), '') AS account_type,
  CAST(coalesce(round_even(CAST(shares_summable AS DOUBLE) / 2, 0), 0) AS DECIMAL(20,4)) AS shares_summable, CAST(0 AS BIGINT) AS Target_encoded
FROM account_unvoted WHERE account_hash_key IS NOT NULL AND trim(account_hash_key) <> ''""", ["account_unvoted"])
def q_load_accounts_fill_zero(spark, sf):
    """The loader variant that writes 0 for what is missing: keys, shares
    (halved here, so that half-even rounding shows) and the lacking target."""
    raw = fx.account_unvoted(spark, sf).drop("Target_encoded").withColumn("shares_summable", F.col("shares_summable").cast("double") / 2)
    raw = raw.withColumn("account_type", F.when(F.col("account_type") == "Other", F.lit("nan")).otherwise(F.col("account_type"))).withColumn("Target_encoded", F.lit(None).cast("long"))
    target = _scratch(spark, "accounts-zero")
    ld.load_accounts(raw, target, dataset="sel", is_voted=0, fill_zero=True)
    return spark.read.parquet(target).select("account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable", "Target_encoded")


_TABLE = "SELECT id, account_type, CASE WHEN is_voted = 1 THEN 'a=b/c' ELSE 'plain' END AS dataset FROM accounts"


def _two_datasets(spark, sf):
    return fx.accounts(spark, sf).select("id", "account_type", F.when(F.col("is_voted") == 1, F.lit("a=b/c")).otherwise(F.lit("plain")).alias("dataset"))


@register("append_table", f"{_TABLE} UNION ALL {_TABLE}", ["accounts"])
def q_append_table(spark, sf):
    """The same rows appended twice."""
    path = _scratch(spark, "append-table")
    for _ in range(2):
        sinks.append_table(_two_datasets(spark, sf), path)
    return spark.read.parquet(path).select("id", "account_type", "dataset")


@register("load_if_empty", _TABLE, ["accounts"])
def q_load_if_empty(spark, sf):
    """The second load finds rows and does nothing."""
    path = _scratch(spark, "load-if-empty")
    for _ in range(2):
        sinks.load_if_empty(_two_datasets(spark, sf), path)
    return spark.read.parquet(path).select("id", "account_type", "dataset")


@register("clear_dataset", _TABLE + " WHERE is_voted <> 1", ["accounts"])
def q_clear_dataset(spark, sf):
    """A dataset whose name a partition folder must escape."""
    path = _scratch(spark, "clear-dataset")
    sinks.append_table(_two_datasets(spark, sf), path)
    sinks.clear_dataset(spark, path, "a=b/c", confirm=True)
    return spark.read.parquet(path).select("id", "account_type", "dataset")


@register("confusion_outcome_fallback", "WITH " + _NUM_SQL + """,
c AS (SELECT coalesce(CASE WHEN id % 2 = 0 THEN total_for_shares IS NOT NULL END, approved) AS approved, pf > pa AS pred FROM n)
SELECT """ + _CM_BODY + " FROM c", ["proposals"])
def q_confusion_outcome_fallback(spark, sf):
    """The outcome column is chosen row by row."""
    p = fx.proposals(spark, sf).drop("prediction_correct")
    even = F.col("id") % 2 == 0
    word = F.when(F.col("total_for_shares").isNotNull(), F.lit("approved")).otherwise(F.lit("rejected"))
    text = F.when(F.col("approved"), F.lit("1")).when(~F.col("approved"), F.lit("0"))
    p = p.withColumn("outcome", F.when(even, word).otherwise(text)).withColumn("approved", F.lit(None).cast("boolean"))
    return qm.confusion_matrix(p)


@register("confusion_model_fallback", "WITH " + _NUM_SQL + """,
c AS (SELECT approved, id % 10 > 5 AS pred FROM n) SELECT """ + _CM_BODY + " FROM c", ["proposals"])
def q_confusion_model_fallback(spark, sf):
    """Without shares the first model column in the table's order decides."""
    p = fx.proposals(spark, sf).select("id", "approved", ((F.col("id") % 10).cast("double") / 10).alias("score_model2"), F.lit(0.1).alias("prediction_model1"))
    return qm.confusion_matrix(p)


@register("delta_missing_column", "WITH " + _NUM_SQL + """
SELECT id, round(delta1, 6) AS delta1, CAST(NULL AS DOUBLE) AS delta2 FROM (SELECT id, """ + _DELTA_TABLE_SQL + " FROM n) t", ["proposals"])
def q_delta_missing_column(spark, sf):
    """A table without the abstain shares has no Delta2."""
    d = qm.with_deltas(fx.proposals(spark, sf).drop("total_abstain_shares"), "table")
    return d.select("id", r6(F.col("delta1")).alias("delta1"), "delta2")


@register("issuer_semi_join_hot", f"""
SELECT id, account_hash_key, proposal_master_skey, director_master_skey FROM accounts_hot
WHERE proposal_master_skey IN (SELECT proposal_master_skey FROM proposals WHERE {_ISSUER_SQL} AND proposal_master_skey <> -1)
   OR director_master_skey IN (SELECT director_master_skey FROM proposals WHERE {_ISSUER_SQL} AND director_master_skey <> -1)""",
          ["accounts_hot", "proposals"])
def q_issuer_semi_join_hot(spark, sf):
    """J4 where one proposal key holds a third of all account rows."""
    a = ot.issuer_semi_join(fx.view(spark, sf, "accounts_hot"), fx.proposals(spark, sf), ISSUERS)
    return a.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey")


@register("accounts_sorted_text", """
SELECT id, account_type FROM account_unvoted
ORDER BY lower(account_type) ASC NULLS FIRST, id ASC, proposal_master_skey ASC NULLS FIRST,
  director_master_skey ASC NULLS FIRST, score_model1 ASC NULLS FIRST LIMIT 50 OFFSET 50""", ["account_unvoted"])
def q_accounts_sorted_text(spark, sf):
    """O6 on a text field: case doesn't count."""
    u = fx.account_unvoted(spark, sf)
    mixed = F.when(F.col("id") % 2 == 0, F.upper("account_type")).otherwise(F.lower("account_type"))
    s = acc.sort_accounts(u.withColumn("t", F.col("account_type")).withColumn("account_type", mixed), "account_type",
                          tie_break=["id", "proposal_master_skey", "director_master_skey", "score_model1"])
    return s.offset(50).limit(50).select("id", F.col("t").alias("account_type"))


@register("account_filter_options", """
WITH k AS (SELECT 'P' AS key_type, proposal_master_skey AS key_value, * FROM accounts WHERE proposal_master_skey <> -1
      UNION ALL SELECT 'D', director_master_skey, * FROM accounts WHERE director_master_skey <> -1)
SELECT DISTINCT key_type, CAST(key_value AS BIGINT) AS key_value, side, field, value FROM (
  SELECT key_type, key_value, CASE WHEN is_voted = 1 THEN 'voted' ELSE 'unvoted' END AS side, 'account_type' AS field,
    CAST(account_type AS VARCHAR) AS value FROM k
  UNION ALL
  SELECT key_type, key_value, CASE WHEN is_voted = 1 THEN 'voted' ELSE 'unvoted' END, 'Target_encoded',
    CAST(Target_encoded AS VARCHAR) FROM k) t
WHERE value IS NOT NULL AND value <> ''""", ["accounts"])
def q_account_filter_options(spark, sf):
    return acc.account_filter_options(fx.accounts(spark, sf))


@register("verify_datasets", """
SELECT d.dataset, CAST(coalesce(s.rows, 0) AS BIGINT) AS rows, CAST(coalesce(s.issuers, 0) AS BIGINT) AS issuers,
  s.f AS first_meeting, s.l AS last_meeting, s.rows IS NOT NULL AS present
FROM (VALUES ('M'), ('S'), ('X')) d(dataset) LEFT JOIN (
  SELECT proposal_type, count(*) AS rows, count(DISTINCT lower(rtrim(issuer_name))) AS issuers, min(mt_date) AS f, max(mt_date) AS l FROM proposals
  GROUP BY proposal_type) s ON s.proposal_type = d.dataset""", ["proposals"])
def q_verify_datasets(spark, sf):
    return va.verify_datasets(spark, fx.proposals(spark, sf), "proposal_type", ["M", "S", "X"])


@register("proposal_detail_one", "SELECT * FROM (" + _detail_sql().replace("FROM proposals", "FROM proposals WHERE id = 42")
          + ") t", ["proposals"])
def q_proposal_detail_one(spark, sf):
    """F11 point form: the detail rows of one proposal (the lookup is the feature)."""
    return pr.proposal_detail(fx.proposals(spark, sf).select(*_PROPOSAL_COLS), proposal_id=42)


# ================================================================ hot key (a third of all rows on one key)
@register("proposal_account_join_hot", FLAGSHIP_SQL.replace("FROM accounts WHERE", "FROM accounts_hot WHERE"),
          ["proposals", "accounts_hot"])
def q_proposal_account_join_hot(spark, sf):
    """Flagship where proposal key 1 holds a third of all account rows: the
    partial aggregate combines the hot key inside each map task."""
    return acc.proposal_share_totals(fx.proposals(spark, sf), fx.view(spark, sf, "accounts_hot"))


@register("insert_ignore_hot", f"""
WITH u AS (SELECT id, account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
             rank_of_shareholding, score AS score_model1, prediction AS prediction_model1, Target_encoded
           FROM accounts_hot WHERE is_voted = 0),
ok AS (SELECT DISTINCT account_hash_key, proposal_master_skey, director_master_skey FROM outreach WHERE {_KEYS_NN}),
fr AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.account_hash_key = u.account_hash_key
  AND ok.proposal_master_skey = u.proposal_master_skey AND ok.director_master_skey = u.director_master_skey))
SELECT id, account_hash_key, proposal_master_skey, director_master_skey, shares_summable FROM (
  SELECT *, row_number() OVER (PARTITION BY account_hash_key, proposal_master_skey, director_master_skey
    ORDER BY {_ORDER_ALL}) AS rn FROM fr WHERE {_KEYS_NN}) t WHERE rn = 1
UNION ALL SELECT id, account_hash_key, proposal_master_skey, director_master_skey, shares_summable FROM fr
WHERE NOT ({_KEYS_NN})""", ["accounts_hot", "outreach"])
def q_insert_ignore_hot(spark, sf):
    """D2 where one key triple holds a third of the rows: the first-row pick
    is an aggregate, so the hot triple collapses map-side."""
    u = fx.view(spark, sf, "accounts_hot").filter(F.col("is_voted") == 0).select(
        "id", "account_hash_key", "proposal_master_skey", "director_master_skey", "account_type", "shares_summable",
        "rank_of_shareholding", F.col("score").alias("score_model1"), F.col("prediction").alias("prediction_model1"),
        "Target_encoded")
    n = ot.insert_ignore(fx.outreach(spark, sf), u)
    return n.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey", "shares_summable")


@register("proposal_accounts_page", """
SELECT account_hash_key, proposal_master_skey, director_master_skey, account_type, shares_summable,
  rank_of_shareholding, score_model2, prediction_model2, Target_encoded FROM account_voted WHERE proposal_master_skey = 1
ORDER BY id ASC NULLS FIRST, proposal_master_skey ASC NULLS FIRST, director_master_skey ASC NULLS FIRST,
  shares_summable ASC NULLS FIRST, score_model2 ASC NULLS FIRST LIMIT 1000""", ["account_voted"])
def q_proposal_accounts_page(spark, sf):
    """O1 for one request: the voted accounts of proposal key 1, first page of 1000."""
    a = acc.accounts_for_key(fx.account_voted(spark, sf), "P", 1)
    return acc.voted_view(acc.account_page(a, 1, 1000, _VPAGE + ["score_model2"]))


# ================================================================ option variants
@register("issuer_semi_join_sentinel", f"""
SELECT id, account_hash_key, proposal_master_skey, director_master_skey FROM accounts
WHERE proposal_master_skey IN (SELECT proposal_master_skey FROM proposals WHERE {_ISSUER_SQL})
   OR director_master_skey IN (SELECT director_master_skey FROM proposals WHERE {_ISSUER_SQL})""",
          ["accounts", "proposals"])
def q_issuer_semi_join_sentinel(spark, sf):
    """J4 as the source had it: the -1 "no key" value also matches itself."""
    a = ot.issuer_semi_join(fx.accounts(spark, sf), fx.proposals(spark, sf), ISSUERS, exclude_sentinel=False)
    return a.select("id", "account_hash_key", "proposal_master_skey", "director_master_skey")


@register("proposals_search_literal", """
SELECT id, issuer_name FROM proposals
WHERE issuer_name ILIKE '%#1%' OR proposal ILIKE '%#1%' OR final_key ILIKE '%#1%'
   OR issuer_name ILIKE '%k\\_%' ESCAPE '\\' OR proposal ILIKE '%k\\_%' ESCAPE '\\' OR final_key ILIKE '%k\\_%' ESCAPE '\\'""",
          ["proposals"])
def q_proposals_search_literal(spark, sf):
    """F2 with literal=True: '%' and '_' in the term match themselves."""
    p = fx.proposals(spark, sf)
    cond = pr.search_condition("#1", literal=True) | pr.search_condition("k_", literal=True)
    return p.filter(cond).select("id", "issuer_name")


@register("proposals_keyset_page", """
SELECT id, issuer_name FROM proposals WHERE id < 1000 ORDER BY id DESC LIMIT 50""", ["proposals"])
def q_proposals_keyset_page(spark, sf):
    """O1 deep paging without OFFSET: the page after id 1000 in id DESC order."""
    return pr.keyset_page(fx.proposals(spark, sf), after_id=1000, limit=50).select("id", "issuer_name")
