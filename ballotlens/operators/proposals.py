"""Proposal browsing: filters, search, paging, sorting, dashboard counts, option lists, reports.

String matching follows the rules of the two layers the operators come from:
server-side filters are case-insensitive and ignore trailing spaces (we key
on ``lower(rtrim(x))``, and show ``min(x)`` as a group's name); browser-side
filters are exact.  ``LIKE`` searches are ``ILIKE``.  With
``accent_insensitive`` the server's whole comparison rule holds: keys and
searched texts are folded to letters without accents as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.functions import text as T
from ballotlens.operators import quality as qm

def ci_key(c: Column | str, accent_insensitive: bool = False) -> Column:
    """Grouping / equality key of the server's case-insensitive collation."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.rtrim(T.fold_accents(c) if accent_insensitive else c))


def ci_text(s: str, accent_insensitive: bool = False) -> str:
    """The same key of a parameter."""
    return (T.fold_accents_text(s) if accent_insensitive else s).rstrip(" ").lower()


def not_blank(c: Column | str) -> Column:
    """present and not empty once trailing spaces are ignored."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.rtrim(c) != "")


# ---------------------------------------------------------------------- F3
def issuer_in(df: DataFrame, issuers: Sequence[str] | None, col: str = "issuer_name", accent_insensitive: bool = False) -> DataFrame:
    """Keep rows whose issuer is in the list (case-insensitive); empty list = no filter."""
    if not issuers:
        return df
    keys = sorted({ci_text(i, accent_insensitive) for i in issuers})
    # a local relation: its bytes are known, Spark picks the join by them
    sel = df.sparkSession.createDataFrame([(k,) for k in keys], "k string")
    return df.join(sel, ci_key(col, accent_insensitive) == F.col("k"), "left_semi")


# ---------------------------------------------------------------------- F2
def search_condition(term: str, cols: Sequence[str] = ("issuer_name", "proposal", "final_key"),
                     literal: bool = False, accent_insensitive: bool = False) -> Column:
    """Case-insensitive substring match on any of ``cols``; '%' and '_' in the
    term act as wildcards unless ``literal``."""
    t = T.fold_accents_text(term) if accent_insensitive else term
    if literal:
        t = t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    pat = f"%{t}%"
    cond = F.lit(False)
    for c in cols:
        text = T.fold_accents(c) if accent_insensitive else F.col(c)
        cond = cond | F.coalesce(text.ilike(pat), F.lit(False))
    return cond


def _flag_value(v: str) -> bool:
    return v == "true"


# ---------------------------------------------------------------------- F1
def filter_proposals(df: DataFrame, prediction_correct: str | None = None, approved: str | None = None,
                     category: str | None = None, search: str | None = None,
                     issuers: Sequence[str] | None = None, accent_insensitive: bool = False) -> DataFrame:
    """AND of the given conditions.  Flag text 'true' means TRUE, any other
    non-empty text FALSE; NULL flags never match.  Category is compared
    case-insensitively; empty / None parameters are ignored."""
    cond = F.lit(True)
    if prediction_correct:
        cond = cond & (F.col("prediction_correct") == F.lit(_flag_value(prediction_correct)))
    if approved:
        cond = cond & (F.col("approved") == F.lit(_flag_value(approved)))
    if category:
        cond = cond & (ci_key("category", accent_insensitive) == ci_text(category, accent_insensitive))
    if search:
        cond = cond & search_condition(search, accent_insensitive=accent_insensitive)
    out = df.filter(F.coalesce(cond, F.lit(False)))
    return issuer_in(out, issuers, accent_insensitive=accent_insensitive)


# ------------------------------------------------------------------ O1 / O2
def page(df: DataFrame, page_no: int = 1, limit: int = 50, order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of page ``page_no`` (1-based) in ``order`` (default id DESC).

    Spark plans this as a top-k (TakeOrderedAndProject): each task keeps
    ``offset + limit`` rows, so deep pages cost O(offset); use ``keyset_page``
    for deep scrolling.
    """
    if page_no < 1 or limit < 1:
        raise ValueError("page and limit must be >= 1")
    order = list(order) if order is not None else [F.col("id").desc()]
    return df.orderBy(*order).offset((page_no - 1) * limit).limit(limit)


def keyset_page(df: DataFrame, after_id: int | None, limit: int = 50, descending: bool = True) -> DataFrame:
    """Deep paging without an offset: rows after ``after_id`` in id order."""
    c = F.col("id")
    if after_id is not None:
        df = df.filter(c < after_id if descending else c > after_id)
    return df.orderBy(c.desc() if descending else c.asc()).limit(limit)


def page_info(df: DataFrame, page_no: int = 1, limit: int = 50) -> DataFrame:
    """One row: current page, per page, total rows, total pages."""
    total = F.count(F.lit(1))
    return df.agg(
        F.lit(page_no).cast("bigint").alias("current_page"),
        F.lit(limit).cast("bigint").alias("per_page"),
        total.cast("bigint").alias("total"),
        F.ceil(total / F.lit(float(limit))).cast("bigint").alias("total_pages"),
    )


# ---------------------------------------------------------------------- O5
def sort_proposals(df: DataFrame, field: str = "id", ascending: bool = True) -> DataFrame:
    """id sorts numerically; other fields as lower-case text with NULL as ''.
    id breaks ties so the order is total."""
    if field == "id":
        key = F.col("id")
    else:
        key = F.lower(F.coalesce(F.col(field).cast("string"), F.lit("")))
    key = key.asc() if ascending else key.desc()
    return df.orderBy(key, F.col("id").asc())


# --------------------------------------------------------------- A1 / A2
def dashboard(proposals: DataFrame, accounts: DataFrame, voted_col: str = "is_voted") -> DataFrame:
    """Total / correct / approved proposals and voted / unvoted account rows.

    One aggregate per table (the account split is a conditional count over a
    single scan), combined through scalar subqueries: no join, no driver trip.
    """
    p = proposals.agg(
        F.count(F.lit(1)).alias("total_proposals"),
        F.count_if(F.col("prediction_correct") == F.lit(True)).alias("correct_predictions"),
        F.count_if(F.col("approved") == F.lit(True)).alias("approved_proposals"),
    )
    a = accounts.agg(
        F.count_if(F.col(voted_col) == 1).alias("voted_accounts"),
        F.count_if(F.col(voted_col) != 1).alias("unvoted_accounts"),
    )
    # one scalar subquery (a struct) referenced twice: Spark runs it once
    both = a.select(F.struct("voted_accounts", "unvoted_accounts")).scalar()
    va, ua = both.getField("voted_accounts"), both.getField("unvoted_accounts")
    return p.select(
        *[F.col(c).cast("bigint").alias(c) for c in p.columns],
        va.cast("bigint").alias("voted_accounts"), ua.cast("bigint").alias("unvoted_accounts"),
    )


def accuracy_rate(proposals: DataFrame) -> DataFrame:
    """correct / total * 100 to one decimal; 0 when there are no rows (NULL
    flags stay in the denominator)."""
    total = F.count(F.lit(1))
    correct = F.count_if(F.col("prediction_correct") == F.lit(True))
    return proposals.agg(
        total.cast("bigint").alias("total"), correct.cast("bigint").alias("correct"),
        F.when(total > 0, F.round(correct * 100.0 / total, 1)).otherwise(F.lit(0.0)).alias("accuracy_rate"),
    )


# ---------------------------------------------------------------- A6 - A9
def distinct_categories(proposals: DataFrame, issuers: Sequence[str] | None = None, accent_insensitive: bool = False) -> DataFrame:
    """Distinct non-NULL categories (case-insensitive groups, shown as their
    smallest spelling)."""
    df = issuer_in(proposals, issuers, accent_insensitive=accent_insensitive).filter(F.col("category").isNotNull())
    return df.groupBy(ci_key("category", accent_insensitive).alias("k")).agg(F.min("category").alias("category")) \
        .select("category").orderBy("category")


def filter_options(proposals: DataFrame) -> DataFrame:
    """Distinct non-empty values (exact, browser-side) per filter field:
    issuer, type, category (+ ``categorization``), subcategory (+ ``subcategorization``)."""
    cols = set(proposals.columns)
    pairs = [("issuer", "issuer_name"), ("type", "proposal_type"), ("category", "category"),
             ("subcategory", "subcategory")]
    if "categorization" in cols:
        pairs.append(("category", "categorization"))
    if "subcategorization" in cols:
        pairs.append(("subcategory", "subcategorization"))
    pairs = [(f, c) for f, c in pairs if c in cols]
    args = ", ".join(f"'{f}', CAST({c} AS STRING)" for f, c in pairs)
    long = proposals.select(F.expr(f"stack({len(pairs)}, {args}) AS (field, value)"))
    return long.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct().orderBy("field", "value")


def issuer_list(proposals: DataFrame, selected: Sequence[str] = (), accent_insensitive: bool = False) -> DataFrame:
    """Per non-blank issuer: distinct proposal keys, distinct director keys
    (the -1 sentinel counts as a value), status and selection flag."""
    df = proposals.filter(not_blank("issuer_name"))
    g = df.groupBy(ci_key("issuer_name", accent_insensitive).alias("k")).agg(
        F.min("issuer_name").alias("name"),
        F.count_distinct("proposal_master_skey").cast("bigint").alias("proposal_count"),
        F.count_distinct("director_master_skey").cast("bigint").alias("director_count"),
    )
    sel = list(selected)
    flag = F.col("name").isin(sel) if sel else F.lit(False)
    return g.select("name", "proposal_count", "director_count", F.lit("active").alias("status"),
                    flag.alias("selected"), "k").orderBy("k").drop("k")


def top_issuers(proposals: DataFrame, k: int = 10, accent_insensitive: bool = False) -> DataFrame:
    """The ``k`` issuers with most proposals (ties by name)."""
    g = proposals.groupBy(ci_key("issuer_name", accent_insensitive).alias("key")).agg(
        F.min("issuer_name").alias("issuer_name"), F.count(F.lit(1)).cast("bigint").alias("proposal_count"))
    return g.orderBy(F.col("proposal_count").desc(), F.col("key").asc_nulls_first()).limit(k) \
        .select("issuer_name", "proposal_count")


# --------------------------------------------------------------------- F10
def proposal_report(proposals: DataFrame) -> DataFrame:
    """The 20 columns of the proposals table as displayed text."""
    cols = set(proposals.columns)

    def col_or_null(c: str) -> Column:
        return F.col(c) if c in cols else F.lit(None).cast("string")

    def plain(c: str) -> Column:
        x = col_or_null(c).cast("string")
        return F.when(x.isNull() | (x == ""), F.lit("-")).otherwise(x)

    text_cols = [c for c in ("proposal", "Proposal", "description", "text", "content",
                             "proposal_text", "proposal_description") if c in cols]
    body = T.first_non_blank(text_cols) if text_cols else F.lit(None).cast("string")
    d = qm.with_deltas(proposals, "table")
    shares = ["predicted_for_shares", "predicted_against_shares", "predicted_abstain_shares",
              "predicted_unvoted_shares", "total_for_shares", "total_against_shares",
              "total_abstain_shares", "total_unvoted_shares"]
    return d.select(
        F.col("id"),
        plain("proposal_master_skey").alias("proposal_master_key"),
        plain("director_master_skey").alias("director_master_key"),
        plain("issuer_name").alias("issuer"),
        plain("category").alias("category"),
        T.truncate_words(body, 10).alias("proposal_content"),
        T.yes_no("prediction_correct", "Correct", "Incorrect").alias("prediction_accuracy"),
        T.yes_no("approved").alias("approved_status"),
        T.percent_text(col_or_null("for_percentage")).alias("for_percentage"),
        T.percent_text(col_or_null("for_percentage_true")).alias("true_for_percentage"),
        *[T.share_text(col_or_null(c)).alias(c) for c in shares],
        T.percent_text("delta1").alias("delta1"),
        T.percent_text("delta2").alias("delta2"),
    )


# --------------------------------------------------------------------- F11
_PERCENT_FIELDS = ("for_percentage", "for_percentage_true", "abstain_percentage")
_FLAG_FIELDS = ("approved", "prediction_correct")


def proposal_detail(proposals: DataFrame, proposal_id: int | None = None) -> DataFrame:
    """Every field of every proposal (or of one id) as (id, field, value) text
    rows: flags Yes/No, percentages x100 with 2 decimals, NULL / '' -> 'N/A'."""
    if proposal_id is not None:
        proposals = proposals.filter(F.col("id") == proposal_id)
    exprs = []
    for c in proposals.columns:
        x = F.col(c)
        if c in _PERCENT_FIELDS:
            v = T.percent_text(x, 2, "N/A")
        elif c in _FLAG_FIELDS:
            v = T.yes_no(x, null_text="N/A")
        else:
            s = x.cast("string")
            v = F.when(s.isNull() | (s == ""), F.lit("N/A")).otherwise(s)
        exprs.append(F.struct(F.lit(c).alias("field"), v.alias("value")))
    return proposals.select(F.col("id"), F.inline(F.array(*exprs)))
