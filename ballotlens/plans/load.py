"""Bulk loads (the source loaders' work as single Spark jobs).

Accounts: read (Parquet or CSV) -> alias the model columns -> type and clean
-> drop rows without a hash key -> write Parquet partitioned by
``dataset`` / ``is_voted``, each file sorted by proposal key, so later key
lookups skip row groups.  No shuffle: one task per input split.

Proposals: read CSV by header name -> normalise the 48 fields -> write every
row, a cell that doesn't parse as NULL; bad cells are counted per field during
the write.  The narrow form fails rows whose keys or flags aren't whole
numbers; those go to a rejects table.

Outreach: read CSV by header name -> clean the 11 columns -> skip rows without
a hash key -> append those whose key triple isn't there yet.

Rows are counted while they are written: one scan for each table that is
written, and one more only where ``max_errors`` has to be checked first.
Nothing passes through the driver, and a re-run overwrites the same partitions (safe after a lost executor or a
failed job).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.functions import clean as C
from ballotlens.operators import outreach as ot
from ballotlens.operators import shape as sh
from ballotlens.operators import validate as va
from ballotlens.schema import ACCOUNT_ALIASES, ACCOUNTS_SCHEMA, OUTREACH_TYPES, PROPOSAL_FIELDS
from ballotlens.sources import sinks

ACCOUNT_OUT = ("account_hash_key", "proposal_master_skey", "director_master_skey", "account_type",
               "shares_summable", "rank_of_shareholding", "score_model2", "prediction_model2", "Target_encoded")


def _as_decimal(x, dtype, target: str):
    """Decimal sources cast exactly; floats and text via a finite double."""
    if isinstance(dtype, T.DecimalType):
        return x.try_cast(target)
    return C.as_double(x, dtype).try_cast(target)


def prepare_accounts(raw: DataFrame, dataset: str, is_voted: int, fill_zero: bool = False,
                     columns: Sequence[str] = ACCOUNT_OUT) -> DataFrame:
    """Typed, cleaned account rows ready to write.

    ``fill_zero`` reproduces the loader variant that turns missing keys and
    shares into 0 (whole numbers, half-even rounding) and missing-value tokens
    of the account type into ''; by default a missing value stays NULL.
    """
    df = sh.copy_if_missing(sh.alias_columns(raw, ACCOUNT_ALIASES))
    df = sh.drop_redundant(df)
    df = C.drop_blank_keys(df.withColumn("account_hash_key", F.col("account_hash_key").cast("string")))
    ints = ("proposal_master_skey", "director_master_skey", "rank_of_shareholding", "Target_encoded")
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns:
        if c not in types:   # typed, or later files could not share the table
            out.append(F.lit(None).cast(ACCOUNTS_SCHEMA[c].dataType).alias(c))
            continue
        x, t = F.col(c), types[c]
        # typed (Parquet) columns are cast directly; text (CSV) columns parsed
        if c in ints:
            v = C.coerce_int_zero(x) if fill_zero else C.as_long(x, t)
        elif c == "shares_summable":
            v = C.coerce_int_zero(x).cast("decimal(20,4)") if fill_zero else _as_decimal(x, t, "decimal(20,4)")
        elif c == "account_type" and fill_zero:
            v = C.blank_text_tokens(x.cast("string"))
        elif c.startswith("score_model"):
            v = _as_decimal(x, t, "decimal(20,15)")
        elif c.startswith("prediction_model"):
            v = _as_decimal(x, t, "decimal(10,6)")
        else:
            v = x.cast("string")
        out.append(v.alias(c))
    return df.select(*out, F.lit(is_voted).alias("is_voted"), F.lit(dataset).alias("dataset"))


def load_accounts(raw: DataFrame, target: str, dataset: str, is_voted: int, **kw) -> None:
    rows = prepare_accounts(raw, dataset, is_voted, **kw)
    # No shuffle: each input split is cleaned and written by its own task,
    # sorted by (key, hash), so every file's row groups cover narrow key
    # ranges and min/max statistics prune key lookups.  A global range
    # partitioning would cost a full extra read of the source (its sampling
    # pass) for fewer footers to open per lookup; a hot key needs no special
    # handling because nothing is partitioned by key.
    # Lookups by hash, which the files aren't sorted by, use bloom filters.
    sinks.replace_table(rows, target, partition_by=("dataset", "is_voted"), bloom=("account_hash_key",),
                        sort_within=("dataset", "is_voted", "proposal_master_skey", "account_hash_key"))


def prepare_proposals(raw: DataFrame, float_mode: str = "float") -> DataFrame:
    """Every row typed, and ``_errors``: its fields that were set to NULL."""
    raw = sh.drop_prefixed(raw)
    return sh.normalise_proposals(raw, float_mode, extra=[sh.proposal_errors(raw, float_mode=float_mode).alias("_errors")])


def load_proposals(raw: DataFrame, target: str, dataset: str, float_mode: str = "float") -> dict:
    """Load one dataset's proposals, all rows.  Returns the rows imported and
    the cells set to NULL by field, counted while the rows are written."""
    typed, seen = prepare_proposals(raw, float_mode), Observation()
    fields = [n for n, _, kind in PROPOSAL_FIELDS if kind not in ("str", "dirname")]
    typed = typed.observe(seen, F.count(F.lit(1)).alias("imported"),
                          *[F.count_if(F.array_contains("_errors", n)).alias(n) for n in fields])
    sinks.replace_table(typed.drop("_errors").withColumn("dataset", F.lit(dataset)), target, partition_by=("dataset",))
    counts = seen.get
    return {"imported": counts["imported"], "errors": 0, "bad_cells": {n: counts[n] for n in fields if counts[n]}}


def load_narrow_proposals(raw: DataFrame, target: str, dataset: str, max_errors: int | None = None,
                          rejects_path: str | None = None) -> dict:
    """Load the narrow form; rows that fail go to ``rejects_path`` if given.
    ``max_errors`` stops the load, writing nothing, when more rows fail; by
    default any number may."""
    rows, seen = sh.normalise_narrow_proposals(raw), Observation()
    counts = [F.count_if(~F.col("_failed")).alias("imported"), F.count_if("_failed").alias("errors")]
    if max_errors is not None:     # nothing may be written before the rows are counted
        va.enforce_error_budget(rows.agg(*counts), max_errors)
    if rejects_path:
        va.split_rejects(rows)[1].drop("_failed").withColumn("dataset", F.lit(dataset)).write.mode("overwrite").parquet(rejects_path)
    good, _ = va.split_rejects(rows.observe(seen, *counts))
    sinks.replace_table(good.withColumn("dataset", F.lit(dataset)), target, partition_by=("dataset",))
    return seen.get


def prepare_outreach(raw: DataFrame) -> DataFrame:
    """The 11 outreach columns, cleaned; rows without a hash key left out."""
    def x(c):
        return F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")

    def clean(c):
        if c == "account_hash_key":
            return x(c)
        if c in ("unnamed_col", "account_type"):
            return C.clean_blank(x(c))
        if c == "prediction_model1":
            return C.clean_tinyint(x(c))
        return C.clean_float(x(c)) if c in ("shares_summable", "score_model1") else C.clean_int(x(c))

    rows = raw.select(*[clean(c).cast(t).alias(c) for c, t in OUTREACH_TYPES.items()])
    return rows.filter(F.coalesce("account_hash_key", F.lit("")) != "")


def load_outreach(raw: DataFrame, target: str, dataset: str) -> DataFrame:
    """Append an outreach file to ``dataset``'s part of the table, skipping
    rows whose key triple is there or comes twice (of those the least row
    stays).  Returns (source_rows, copied, skipped)."""
    return sinks.copy_table(prepare_outreach(raw), target, ot.copy_rows, dataset=dataset, order=ot.OUTREACH_COLUMNS)
