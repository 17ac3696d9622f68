"""Schema operators: aliasing, selection, alignment and the proposal normaliser.

Column decisions are made on the driver from ``df.columns`` (a schema, not
data) and become one ``select``; no data moves to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.functions import clean as C
from ballotlens.schema import ACCOUNT_ALIASES, NARROW_FIELDS, OLD_FORMAT_COLUMNS, PROPOSAL_FIELDS


# ---------------------------------------------------------------------- H1
def alias_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ACCOUNT_ALIASES) -> DataFrame:
    """For each missing target take the first variant present and rename it."""
    cols = list(df.columns)
    rename: dict[str, str] = {}
    for target, variants in aliases.items():
        if target in cols:
            continue
        src = next((v for v in variants if v in cols and v not in rename), None)
        if src is not None:
            rename[src] = target
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in cols])


# ---------------------------------------------------------------------- H2
def fuzzy_alias(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """When any expected column is missing, map each expected name to the first
    actual column whose name contains it or is contained in it (case-insensitive).
    Two expected names claiming the same column is an error."""
    cols = list(df.columns)
    if all(e in cols for e in expected):
        return df
    rename: dict[str, str] = {}
    for e in expected:
        for a in cols:
            if e.lower() in a.lower() or a.lower() in e.lower():
                if a in rename and rename[a] != e:
                    raise ValueError(f"column {a!r} matches both {rename[a]!r} and {e!r}")
                rename[a] = e
                break
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in cols])


# ---------------------------------------------------------------------- H3
def copy_if_missing(df: DataFrame, pairs: Mapping[str, str] | None = None) -> DataFrame:
    """Copy source -> target columns when the target is missing (source kept)."""
    pairs = pairs or {"score_model1": "score_model2", "prediction_model1": "prediction_model2"}
    for src, dst in pairs.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumn(dst, F.col(src))
    return df


# ---------------------------------------------------------------------- H4
def select_available(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Required columns that exist, in required order; plus the missing names."""
    have = [c for c in required if c in df.columns]
    return df.select(*have), [c for c in required if c not in df.columns]


# ---------------------------------------------------------------------- H5
def _typed(raw: Column, kind: str, float_mode: str) -> Column:
    if kind == "int":
        return C.clean_int(raw)
    if kind == "float":
        return C.clean_numeric(raw, 4).cast("double") if float_mode == "numeric" else C.clean_float(raw)
    if kind == "bool":
        return C.clean_bool(raw)
    if kind == "date":
        return C.clean_date6(raw)
    if kind == "dirname":
        return C.clean_director_name(raw)
    return C.clean_blank(raw)


def _source(df: DataFrame, header: str, name: str) -> str | None:
    return header if header in df.columns else name if name in df.columns else None


def normalise_proposals(raw: DataFrame, float_mode: str = "float",
                        fields: Sequence[tuple[str, str, str]] = PROPOSAL_FIELDS,
                        extra: Sequence[Column] = ()) -> DataFrame:
    """Map the proposal file headers to table columns and type every field in
    one ``select``.  ``float_mode`` 'float' parses ratios as floats, 'numeric'
    as exact decimals rounded to 4 places.  Headers absent from the file give
    NULL columns; ``merge_*`` and other extra columns are dropped."""
    out = []
    for name, header, kind in fields:
        src = _source(raw, header, name)
        rawc = F.col(f"`{src}`").cast("string") if src else F.lit(None).cast("string")
        out.append(_typed(rawc, kind, float_mode).alias(name))
    return raw.select(*out, *extra)


def normalise_excel_proposals(raw: DataFrame, fields: Sequence[tuple[str, str, str]] = PROPOSAL_FIELDS) -> DataFrame:
    """The same fields from rows read out of a spreadsheet: text is kept as it
    is ('' and -1 too), whole numbers keep -1, shares and ratios are floats,
    dates take any layout, the two text columns of the prospectus become
    percentages."""
    out = []
    for name, header, kind in fields:
        src = _source(raw, header, name)
        x = F.col(f"`{src}`") if src else F.lit(None).cast("string")
        text = x.cast("string")
        if name in ("against_prospectus_2026", "abstain_prospectus_2026"):
            v = C.clean_percentage(text)
        elif kind == "float" or name.endswith("_shares"):
            v = C.clean_float(text)
        elif kind == "int":
            v = C.clean_int_excel(text)
        elif kind == "bool":
            v = C.clean_bool_excel(text)
        elif kind == "date":
            v = C.date_from_any(x)
        else:
            v = text
        out.append(v.alias(name))
    return raw.select(*out)


def normalise_narrow_proposals(raw: DataFrame, fields: Sequence[tuple[str, str]] = NARROW_FIELDS) -> DataFrame:
    """The narrow file's 19 fields and ``_failed``: rows whose keys or flags
    aren't whole numbers can't be inserted; any other bad cell becomes NULL."""
    out, failed = [], F.lit(False)
    for name, kind in fields:
        x = F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")
        if kind == "key":
            v = F.when(~C.is_blank(x), F.when(C.strip(x).rlike("^[+-]?[0-9]+$"), C.strip(x).try_cast("bigint")))
            failed = failed | (~C.is_blank(x) & v.isNull())
        elif kind == "flag":
            v = C.clean_bool_default(x)
            failed = failed | v.isNull()
        elif kind in ("num6", "num4"):
            v = C.clean_numeric_sci(x, int(kind[3:]))
        elif kind == "date":
            v = C.clean_date3(x)
        elif kind == "text500":
            v = C.clean_truncate(x, 500)
        else:
            v = F.when(~C.is_blank(x), x)
        out.append(v.alias(name))
    return raw.select(*out, failed.alias("_failed"))


def union_proposal_forms(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """Wide and narrow rows in one table: fields that a form lacks are NULL,
    ``mt_date`` takes the narrow form's ``meeting_date``, shares are doubles."""
    shares = [c for c in wide.columns if c.endswith("_shares") and c in narrow.columns]
    both = wide.withColumns({c: F.col(c).cast("double") for c in shares}).unionByName(
        narrow.withColumns({c: F.col(c).cast("double") for c in shares}), allowMissingColumns=True)
    return both.withColumn("mt_date", F.coalesce("mt_date", "meeting_date")) if "mt_date" in both.columns else both


def proposal_errors(raw: DataFrame, fields: Sequence[tuple[str, str, str]] = PROPOSAL_FIELDS,
                    float_mode: str = "float") -> Column:
    """Array of the fields whose raw text is not blank but did not parse."""
    errs = []
    for name, header, kind in fields:
        src = _source(raw, header, name)
        if kind in ("str", "dirname") or src is None:
            continue
        r = F.col(f"`{src}`").cast("string")
        bad = ~C.is_blank(r) & _typed(r, kind, float_mode).isNull()
        if kind == "int":
            bad = bad & (C.strip(r) != "-1")
        if kind == "date":
            bad = bad & (F.lower(C.strip(r)) != "null")
        errs.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*errs), lambda x: x.isNotNull()) if errs else F.array().cast("array<string>")


# ---------------------------------------------------------------------- H6
def align_to_target(src: DataFrame, target_columns: Sequence[str],
                    skip: Sequence[str] = ("id", "created_at")) -> DataFrame:
    """Columns of ``src`` that the target also has, in target order (minus
    ``skip``); an empty intersection is an error."""
    common = [c for c in target_columns if c not in skip and c in src.columns]
    if not common:
        raise ValueError("no common columns between source and target")
    return src.select(*common)


def union_aligned(target: DataFrame, src: DataFrame) -> DataFrame:
    """Append ``src`` to ``target`` by name; target columns it lacks are NULL."""
    return target.unionByName(align_to_target(src, target.columns), allowMissingColumns=True)


# ---------------------------------------------------------------- H7 / H8
def drop_prefixed(df: DataFrame, prefix: str = "merge_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower().startswith(prefix)])


def drop_redundant(df: DataFrame, cols: Sequence[str] = OLD_FORMAT_COLUMNS) -> DataFrame:
    """Slim account layout: drop the old index columns."""
    return df.drop(*[c for c in cols if c in df.columns])


def is_old_format(df: DataFrame) -> bool:
    return any(c in df.columns for c in OLD_FORMAT_COLUMNS)
