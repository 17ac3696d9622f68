"""Repair and profile text columns (encoding clean-up, non-ASCII lines)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NON_ASCII = "[^\\x00-\\x7F]"


def repair_text(c: Column | str, drop_non_ascii: bool = False) -> Column:
    """Drop U+FFFD replacement characters and NUL bytes; optionally every
    non-ASCII character.  For binary input, decode with ``make_valid_utf8``
    first (bad bytes become U+FFFD, then removed here)."""
    x = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(F.regexp_replace(x, "\\x{FFFD}", ""), "\\x{0000}", "")
    return F.regexp_replace(out, NON_ASCII, "") if drop_non_ascii else out


def repair_bytes(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return repair_text(F.make_valid_utf8(x).cast("string"))


def repair_columns(df: DataFrame, cols: Sequence[str], drop_non_ascii: bool = False) -> DataFrame:
    return df.select(*[repair_text(c, drop_non_ascii).alias(c) if c in cols else F.col(c) for c in df.columns])


def text_lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Whole texts split into (id, line_no 1-based, line)."""
    return df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")) \
        .select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def non_ascii_lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Lines holding a non-ASCII character, with the 1-based position of the first one."""
    lines = text_lines(df, text_col, id_col)
    return lines.filter(F.col("line").rlike(NON_ASCII)).select(
        id_col, "line_no", F.regexp_instr(F.col("line"), F.lit(NON_ASCII)).cast("int").alias("position"))


def non_ascii_profile(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row: lines in total, lines with non-ASCII, texts with non-ASCII."""
    lines = text_lines(df, text_col, id_col)
    bad = F.col("line").rlike(NON_ASCII)
    return lines.agg(F.count(F.lit(1)).cast("bigint").alias("lines"),
                     F.count_if(bad).cast("bigint").alias("non_ascii_lines"),
                     F.count_distinct(F.when(bad, F.col(id_col))).cast("bigint").alias("non_ascii_texts"))


def first_non_ascii(df: DataFrame, text_col: str, id_col: str, k: int = 5) -> DataFrame:
    """The first ``k`` offending lines (by id, line) with their position."""
    return non_ascii_lines(df, text_col, id_col).orderBy(id_col, "line_no").limit(k)
