"""Outreach list: choose unvoted accounts and add them without duplicates.

Uniqueness follows a UNIQUE (hash, proposal key, director key) constraint:
rows whose three keys are all present are unique; a row with any NULL key
never conflicts (so it is always inserted).  Spark has no such constraint, so
it is enforced with joins and a grouped "first row per key" pick:

* rows with a NULL key part bypass every join;
* in-batch duplicates: ``min(struct(order cols..., row))`` per key triple,
  *before* any join.  This is an aggregate, so Spark combines it map-side and
  a hot triple costs one row per task; a window would sort the whole hot group
  in one task instead;
* existing rows: joins on the three keys with plain ``=``, of one row a triple
  on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.functions.text import js_trim
from ballotlens.operators.accounts import DM, PM, account_keys
from ballotlens.schema import OUTREACH_TYPES

HASH = "account_hash_key"
KEYS = (HASH, PM, DM)

# fixed values: the 11 columns an outreach row carries
OUTREACH_COLUMNS = ("row_index", "unnamed_col", "account_hash_key", "proposal_master_skey",
                    "director_master_skey", "account_type", "shares_summable", "rank_of_shareholding",
                    "score_model1", "prediction_model1", "Target_encoded")


def _keys_present(keys: Sequence[str] = KEYS) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).isNotNull()
    return c


# ---------------------------------------------------------------------- U2
# fixed values: names under which a request may carry the hash key, first one that isn't empty counts
HASH_NAMES = ("account_hash_key", "accountHashKey", "account_id", "id")


def distinct_hashes(selection: DataFrame, col: str | None = None) -> DataFrame:
    """Distinct hash keys of a request: row by row the first of ``HASH_NAMES``
    that is neither NULL nor '' (or just ``col``); blank values (after trim)
    are dropped, the kept values are not trimmed."""
    names = [col] if col else [c for c in HASH_NAMES if c in selection.columns]
    values = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]
    h = F.coalesce(*values) if len(values) > 1 else values[0]
    return selection.select(h.alias(HASH)).filter(F.col(HASH).isNotNull() & (js_trim(HASH) != "")).distinct()


# ---------------------------------------------------------------------- J3
def selected_accounts(unvoted: DataFrame, hashes: DataFrame, key_param: str, key_value) -> DataFrame:
    """Unvoted rows of one key context whose hash is among ``hashes``."""
    if key_param not in (PM, DM):
        raise ValueError(f"key_param must be {PM} or {DM}")
    h = distinct_hashes(hashes)
    return unvoted.filter(F.col(key_param) == F.lit(key_value)).join(h, HASH, "left_semi")


def selected_accounts_all(unvoted: DataFrame, selection: DataFrame) -> DataFrame:
    """Batch form for many key contexts at once.

    ``selection`` has (account_hash_key, key_type 'P'/'D', key_value).  A row
    of ``unvoted`` is picked once per key kind through which it is selected.
    """
    sel = selection.select(F.col(HASH).cast("string").alias(HASH), "key_type",
                           F.col("key_value").cast("bigint").alias("key_value")) \
        .filter(F.col(HASH).isNotNull() & (js_trim(HASH) != "")).distinct()
    k = account_keys(unvoted)
    return k.join(sel, [HASH, "key_type", "key_value"], "left_semi").drop("key_type", "key_value")


# ---------------------------------------------------------------------- J1
def flag_existing(rows: DataFrame, outreach: DataFrame, flag: str = "already_exists") -> DataFrame:
    """Add ``already_exists`` (0/1): the key triple is in ``outreach`` (plain
    ``=``, so a NULL key never matches).  Outreach keys are made distinct
    first so the join cannot multiply rows."""
    o = outreach.select(*KEYS).filter(_keys_present()).distinct().withColumn("_hit", F.lit(1))
    j = rows.join(o, list(KEYS), "left")
    return j.withColumn(flag, F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit").select(*rows.columns, flag)


def _first_per_key(rows: DataFrame, order: Sequence[str], *more: Column) -> DataFrame:
    """First row (by ``order``, then all columns) per non-NULL key triple; with
    ``more`` aggregates of the triple's rows."""
    rest = [c for c in rows.columns if c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    keyed = rows.filter(_keys_present())
    firsts = keyed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(KEYS)]).agg(F.min(packed).alias("_r"), *more)
    # the keys from the grouping, so that a join on them needs no new shuffle
    named = [F.col(f"_k{KEYS.index(c)}").alias(c) if c in KEYS else F.col(f"_r.`{c}`").alias(c) for c in rows.columns]
    return firsts.select(*named, *firsts.columns[len(KEYS) + 1:])


def _present(outreach: DataFrame) -> DataFrame:
    return outreach.select(*KEYS).filter(_keys_present())


# ---------------------------------------------------------------------- D2
def insert_ignore(target: DataFrame, rows: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of ``rows`` an INSERT IGNORE would add to ``target``.

    NULL-key rows always go in; of the others the first per key triple (by
    ``order``) goes in unless the triple exists in ``target``.
    """
    fresh = _first_per_key(rows, order).join(_present(target), list(KEYS), "left_anti")
    return fresh.unionByName(rows.filter(~_keys_present()))


# ---------------------------------------------------------------------- D3
def duplicate_messages(duplicates: DataFrame) -> DataFrame:
    def txt(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    # fixed value: the message's wording
    msg = F.concat(F.lit("account_hash_key("), txt(HASH), F.lit(")+proposal_master_skey("), txt(PM),
                   F.lit(")+director_master_skey("), txt(DM),
                   F.lit(") is not inserted because it is already in outreach table"))
    return duplicates.select(*KEYS, msg.alias("message"))


# ---------------------------------------------------------------------- D1
def add_to_outreach(selected: DataFrame, outreach: DataFrame, order: Sequence[str] = ("id",),
                    outreach_columns: Sequence[str] | None = None, materialize: bool = False) -> dict[str, DataFrame]:
    """Split selected unvoted rows into new rows and duplicates, and report.

    Returns DataFrames: ``new`` (rows to append, aligned to the outreach
    columns present in both tables), ``duplicates`` (with messages) and
    ``report`` (one row: inserted, skipped, total_shares, inserted_shares).
    ``total_shares`` sums all rows not yet in outreach, in-batch duplicates
    included; ``inserted_shares`` only the rows actually added.
    ``materialize`` writes the grouped selection (a row a triple) once to the
    shared checkpoint folder so the outputs do not each recompute it.
    """
    shares = F.coalesce(F.col("shares_summable").cast("double"), F.lit(0.0))
    # one row a triple, with how many rows and shares stand behind it
    g = _first_per_key(selected, order, F.count(F.lit(1)).alias("_n"), F.sum(shares).alias("_shares"))
    g = flag_existing(g, outreach)
    if materialize:
        from ballotlens.session import materialize as _mat
        g = _mat(g, "outreach-triples")
    open_rows = selected.filter(~_keys_present())
    fresh = g.filter("already_exists = 0")
    new = fresh.select(*selected.columns).unionByName(open_rows)
    # rows against the triples that exist: a semi join, split at run time if a triple is hot
    dups = selected.filter(_keys_present()).join(_present(outreach), list(KEYS), "left_semi")
    target_cols = list(outreach_columns) if outreach_columns is not None else list(outreach.columns)
    common = [c for c in target_cols if c not in ("id", "created_at") and c in set(selected.columns)]
    if not common:
        raise ValueError("no common columns between outreach and the selected rows")
    return {"new": new.select(*common), "duplicates": duplicate_messages(dups), "report": _add_report(g, open_rows, shares)}


def _add_report(g: DataFrame, open_rows: DataFrame, shares: Column) -> DataFrame:
    """inserted / skipped / total_shares / inserted_shares from the triples and
    the rows with a NULL key part, which are summed up on their own first."""
    fresh = F.col("already_exists") == 0
    a = g.select(fresh.cast("bigint").alias("ins"), F.when(~fresh, F.col("_n")).otherwise(F.lit(0)).alias("dup"),
                 F.when(fresh, F.col("_shares")).alias("total"), F.when(fresh, shares).alias("ins_shares"))
    b = open_rows.agg(F.count(F.lit(1)).alias("ins"), F.lit(0).cast("bigint").alias("dup"), F.sum(shares).alias("total"))
    both = a.unionByName(b.withColumn("ins_shares", F.col("total")))
    return both.agg(
        F.coalesce(F.sum("ins"), F.lit(0)).cast("bigint").alias("inserted"),
        F.coalesce(F.sum("dup"), F.lit(0)).cast("bigint").alias("skipped"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_shares"),
        F.coalesce(F.sum("ins_shares"), F.lit(0.0)).alias("inserted_shares"))


# ---------------------------------------------------------------------- J2
def in_outreach(unvoted: DataFrame, outreach: DataFrame, flag: str = "in_outreach") -> DataFrame:
    """Flag unvoted rows already in outreach: the hash matches with ``=``, and
    both keys match NULL-safely (NULL matches NULL)."""
    o = outreach.select(*KEYS).filter(F.col(HASH).isNotNull()).distinct() \
        .select(F.col(HASH).alias("_h"), F.col(PM).alias("_p"), F.col(DM).alias("_d"), F.lit(True).alias("_hit"))
    cond = (F.col(HASH) == F.col("_h")) & F.col(PM).eqNullSafe(F.col("_p")) & F.col(DM).eqNullSafe(F.col("_d"))
    j = unvoted.join(o, cond, "left")
    return j.select(*unvoted.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias(flag))


# ---------------------------------------------------------------------- O4
def outreach_list(outreach: DataFrame) -> DataFrame:
    """All outreach rows, newest first (created_at DESC, id DESC)."""
    order = [F.col("created_at").desc()] if "created_at" in outreach.columns else []
    return outreach.orderBy(*order, F.col("id").desc())


def outreach_count(outreach: DataFrame) -> DataFrame:
    return outreach.agg(F.count(F.lit(1)).cast("bigint").alias("outreach_count"))


# ---------------------------------------------------------------------- S8
def copy_rows(source: DataFrame, target: DataFrame, columns: Sequence[str] = OUTREACH_COLUMNS,
              order: Sequence[str] = ("id",)) -> dict[str, DataFrame]:
    """Copy the fixed outreach columns from one dataset's table to another's,
    skipping duplicates; report copied / skipped."""
    cols = [c for c in columns if c in source.columns]
    order = [c for c in order if c in source.columns] or cols[:1]
    src = source.select(*dict.fromkeys(cols + list(order)))
    new = insert_ignore(target, src, order)
    # one aggregate over both: source rows count 1, new rows 0
    both = src.select(F.lit(1).alias("s")).unionByName(new.select(F.lit(0).alias("s")))
    report = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source_rows"), F.count(F.lit(1)).alias("_all")).select(
        "source_rows", (F.col("_all") - F.col("source_rows")).cast("bigint").alias("copied"),
        (2 * F.col("source_rows") - F.col("_all")).cast("bigint").alias("skipped"))
    return {"new": new.select(*cols), "report": report}


# ---------------------------------------------------------------------- D5
def delete_where_like(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows that remain after ``DELETE ... WHERE col LIKE pattern`` ('_' and
    '%' are wildcards; a NULL value is kept)."""
    return df.filter(~F.coalesce(F.col(col).like(pattern), F.lit(False)))


# ---------------------------------------------------------------------- D6
def migrate_outreach(old: DataFrame, hash_aliases: Sequence[str] = ("account_id", "accountHashKey", "hash_key"),
                     columns: Sequence[str] = OUTREACH_COLUMNS) -> DataFrame:
    """Bring an old outreach table to the current shape, keeping its rows.

    When ``account_hash_key`` is missing it is taken from the first alias
    present; columns of the current shape that the old table lacks are NULL.
    """
    df = old
    if HASH not in df.columns:
        src = next((a for a in hash_aliases if a in df.columns), None)
        if src is None:
            raise ValueError("no account hash column to migrate from")
        df = df.withColumnRenamed(src, HASH)
    keep = [c for c in ("id", "created_at") if c in df.columns]
    out = [F.col(c) if c in df.columns else F.lit(None).cast(OUTREACH_TYPES.get(c, "string")).alias(c) for c in columns]
    return df.select(*keep, *out)


# ---------------------------------------------------------------------- J4
def issuer_semi_join(accounts: DataFrame, proposals: DataFrame, issuers: Sequence[str] | None,
                     exclude_sentinel: bool = True) -> DataFrame:
    """Accounts whose proposal key or director key belongs to a proposal of
    one of ``issuers`` (case-insensitive); empty list = no filter.

    One pass over the accounts: rows with a valid key are looked up in the
    issuers' proposal keys and in their director keys, and stay if either is
    found.  The -1 "no key" is no key: rows without any never enter a join, and
    where one of two is missing, a hash of the row stands for it, which spreads
    such rows over the tasks and matches nothing.
    With ``exclude_sentinel=False`` -1 is a key like any other.
    """
    if not issuers:
        return accounts
    from ballotlens.operators.proposals import issuer_in
    p = issuer_in(proposals, issuers)

    def valid(c: str) -> Column:
        v = F.col(c).isNotNull()
        return v & (F.col(c) != -1) if exclude_sentinel else v

    def looked_up(rows: DataFrame, c: str, hit: str) -> DataFrame:
        has = F.coalesce(valid(c), F.lit(False))
        rows = rows.withColumn("_has", has).withColumn("_key", F.when(has, F.col(c)).otherwise(F.xxhash64(HASH, PM, DM)))
        keys = p.filter(valid(c)).select(F.col(c).alias("_valid")).distinct().withColumn(hit, F.lit(True))
        return rows.join(keys, (F.col("_key") == F.col("_valid")) & F.col("_has"), "left").drop("_key", "_has", "_valid")

    keyed = accounts.filter(F.coalesce(valid(PM), F.lit(False)) | F.coalesce(valid(DM), F.lit(False)))
    found = looked_up(looked_up(keyed, PM, "_by_proposal"), DM, "_by_director")
    return found.filter(F.col("_by_proposal").isNotNull() | F.col("_by_director").isNotNull()).select(*accounts.columns)
