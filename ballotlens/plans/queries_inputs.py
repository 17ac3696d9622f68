"""Queries of the input side: quoted CSV, free-form dates, rewritten dumps, and
the server's accent-insensitive comparison."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ballotlens.functions import clean as C
from ballotlens.functions import dates
from ballotlens.operators import proposals as pr
from ballotlens.operators import validate as va
from ballotlens.plans import fixtures as fx
from ballotlens.plans.catalog import register
from ballotlens.session import materialize, remove_path, scratch_path
from ballotlens.sources import dumps, readers, row_groups


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def input_splits(spark, size: str):
    """Input splits of ``size`` in the jobs that run inside."""
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ------------------------------------------------------------------ S1 / S2
@register("src_csv_quoted", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CASE doc_id % 4 WHEN 0 THEN '"' || text WHEN 1 THEN text || ' "said", ""' WHEN 2 THEN text || chr(10) ELSE text END AS text
FROM documents""")
def q_src_csv_quoted(spark, sf):
    """Texts with newlines, commas and quotes, written as CSV and read back in
    splits of 64 KB, most of which begin inside a record."""
    path = _scratch(spark, "csv-quoted")
    text = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('"', text) WHEN 1 THEN concat(text, ' "said", ""') WHEN 2 THEN concat(text, '\\n') ELSE text END""")
    fx.table(spark, sf, "documents").select("doc_id", "source", text.alias("text")).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    with input_splits(spark, "64k"):
        out = materialize(readers.read_proposals_csv(spark, path), "csv-quoted-rows")
    remove_path(spark, path)
    return out


# ------------------------------------------------------------- C13 (layouts)
# The same patterns as plain SQL; RE2 has no lookbehind, so the time goes first.
_DAY_SQL = "(?i:monday|tuesday|wednesday|thursday|friday|saturday|sunday|tues|thur|thurs|mon|tue|wed|thu|fri|sat|sun)"
_TIME_SQL = "([0-9])(?:T| +)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?$"
_BARE_SQL = f"regexp_replace(trim(date_text), '{_TIME_SQL}', '\\1')"
_MON_SQL = "((?i:january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec))"


def _ymd_sql(pattern: str, y: int, m: int, d: int, name: bool = False) -> str:
    def part(k):
        return f"regexp_extract(t, '{pattern}', {k})"
    month = f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({part(m)}, 3))) + 2) // 3 AS VARCHAR)" if name else part(m)
    return (f"WHEN regexp_matches(t, '{pattern}') AND {part(y)} <> '0000' THEN "
            f"TRY_CAST({part(y)} || '-' || lpad({month}, 2, '0') || '-' || lpad({part(d)}, 2, '0') AS DATE)")


def _free_date_sql() -> str:
    d, y = "([0-9]{1,2})", "([0-9]{4})"
    whens = [_ymd_sql(f"^{y}{s}{d}{s}{d}$", 1, 2, 3) for s in ("-", "/", "[.]")]
    whens.append(_ymd_sql("^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3))
    for s in ("-", "/", "[.]"):
        p = f"^{d}{s}{d}{s}{y}$"
        whens.append(f"WHEN regexp_matches(t, '{p}') AND CAST(regexp_extract(t, '{p}', 1) AS INT) > 12 THEN (CASE " + _ymd_sql(p, 3, 2, 1) + " END)")
        whens.append(_ymd_sql(p, 3, 1, 2))
    whens.append(_ymd_sql(f"^{_MON_SQL} {d}, {y}$", 3, 1, 2, True))
    whens.append(_ymd_sql(f"^{d}-{_MON_SQL}-{y}$", 3, 2, 1, True))
    return "CASE " + " ".join(whens) + " END"


_DATES_SQL = f"WITH b AS (SELECT row_id, date_text, {_BARE_SQL} AS t FROM date_values)"


@register("clean_date_free", f"{_DATES_SQL} SELECT row_id, date_text, {_free_date_sql()} AS value FROM b", ["date_values"])
def q_clean_date_free(spark, sf):
    """C13 over month names, digits in a row, times, serial numbers and junk."""
    return fx.view(spark, sf, "date_values").select("row_id", "date_text", C.date_from_any("date_text").alias("value"))


@register("date_layouts", _DATES_SQL + f""", s AS (
  SELECT regexp_replace(regexp_replace(trim(date_text), {"'\\b" + _MON_SQL + "\\b'"}, 'Mon', 'g'), '[0-9]', '9', 'g') AS shape, {_free_date_sql()} AS value
  FROM b WHERE date_text IS NOT NULL AND trim(date_text) <> '')
SELECT shape, CAST(count(*) AS BIGINT) AS values, CAST(count(value) AS BIGINT) AS dates FROM s GROUP BY shape""", ["date_values"])
def q_date_layouts(spark, sf):
    """How the column writes its dates: values and dates by shape."""
    return dates.date_layouts(fx.view(spark, sf, "date_values"), "date_text").drop("layout")


# ---------------------------------------------------------------------- S12
_DUMP_SQL = """
WITH l AS (
  SELECT file, line_no, line, trim(line, ' ' || chr(9)) AS t FROM dump_lines_padded
), m AS (
  SELECT *, CASE WHEN regexp_matches(t, '^INSERT INTO `([^`]+)` VALUES (.+);$') THEN regexp_extract(t, '^INSERT INTO `([^`]+)`', 1) END AS tbl,
    regexp_extract(t, '^INSERT INTO `[^`]+` VALUES (.+);$', 1) AS vals FROM l
), p AS (
  SELECT *, lag(tbl) OVER w AS prev, lead(tbl) OVER w AS nxt, row_number() OVER w AS idx FROM m WINDOW w AS (PARTITION BY file ORDER BY line_no)
), r AS (
  SELECT *, (idx - max(CASE WHEN tbl IS NOT NULL AND (prev IS NULL OR prev <> tbl) THEN idx END)
    OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)) % 20 AS place FROM p
), o AS (
  SELECT file, line_no, CASE WHEN tbl IS NULL THEN line ELSE CASE WHEN place = 0 THEN 'INSERT INTO `' || tbl || '` VALUES' || chr(10) ELSE '' END || vals
    || CASE WHEN place = 19 OR nxt IS NULL OR nxt <> tbl THEN ';' ELSE ',' END END AS text FROM r
)"""


@register("dump_rewritten", _DUMP_SQL + " SELECT file, line_no, text FROM o", ["dump_lines_padded"])
def q_dump_rewritten(spark, sf):
    """Every line's new text, two files, blocks of 500 lines."""
    return dumps.rewrite_dump(fx.view(spark, sf, "dump_lines_padded"), batch_size=20, file_col="file", block_lines=500)


@register("dump_written", _DUMP_SQL + """
SELECT file, line, CAST(count(*) AS BIGINT) AS n FROM (SELECT file, unnest(string_split(text, chr(10))) AS line FROM o) GROUP BY file, line""", ["dump_lines_padded"])
def q_dump_written(spark, sf):
    """The rewritten dump through its sink, read back as lines."""
    path = _scratch(spark, "dump")
    dumps.write_dump(dumps.rewrite_dump(fx.view(spark, sf, "dump_lines_padded"), batch_size=20, file_col="file", block_lines=500), path, file_col="file")
    return spark.read.text(path).groupBy("file", F.col("value").alias("line")).agg(F.count("*").alias("n"))


# ------------------------------------------------- the server's comparison rule
_AI = "lower(rtrim(strip_accents(issuer_name)))"
_ACCENTED = ["societe brand#13", "ÅBO BRAND#13 "]
_AI_ISSUERS = f"{_AI} IN ('societe brand#13', 'abo brand#13')"


@register("accent_issuer_filter", f"SELECT id, issuer_name FROM proposals_accented WHERE {_AI_ISSUERS}", ["proposals_accented"])
def q_accent_issuer_filter(spark, sf):
    return pr.issuer_in(fx.view(spark, sf, "proposals_accented"), _ACCENTED, accent_insensitive=True).select("id", "issuer_name")


@register("accent_filter", f"""
SELECT id, issuer_name, category FROM proposals_accented
WHERE lower(rtrim(strip_accents(category))) = 'election promo'
  AND (strip_accents(issuer_name) ILIKE '%societe%' OR strip_accents(proposal) ILIKE '%societe%' OR strip_accents(final_key) ILIKE '%societe%')""", ["proposals_accented"])
def q_accent_filter(spark, sf):
    f = pr.filter_proposals(fx.view(spark, sf, "proposals_accented"), category="élection Promo", search="Sociéte", accent_insensitive=True)
    return f.select("id", "issuer_name", "category")


@register("accent_categories", f"""
SELECT min(category) AS category FROM proposals_accented WHERE category IS NOT NULL AND {_AI_ISSUERS} GROUP BY lower(rtrim(strip_accents(category)))""", ["proposals_accented"])
def q_accent_categories(spark, sf):
    return pr.distinct_categories(fx.view(spark, sf, "proposals_accented"), _ACCENTED, accent_insensitive=True)


@register("accent_issuer_list", f"""
SELECT min(issuer_name) AS name, CAST(count(DISTINCT proposal_master_skey) AS BIGINT) AS proposal_count,
  CAST(count(DISTINCT director_master_skey) AS BIGINT) AS director_count, 'active' AS status, FALSE AS selected
FROM proposals_accented WHERE issuer_name IS NOT NULL AND rtrim(issuer_name) <> '' GROUP BY {_AI}""", ["proposals_accented"])
def q_accent_issuer_list(spark, sf):
    return pr.issuer_list(fx.view(spark, sf, "proposals_accented"), accent_insensitive=True)


@register("accent_top_issuers", f"""
SELECT issuer_name, proposal_count FROM (
  SELECT {_AI} AS key, min(issuer_name) AS issuer_name, CAST(count(*) AS BIGINT) AS proposal_count FROM proposals_accented GROUP BY 1) g
ORDER BY proposal_count DESC, key ASC NULLS FIRST LIMIT 10""", ["proposals_accented"])
def q_accent_top_issuers(spark, sf):
    return pr.top_issuers(fx.view(spark, sf, "proposals_accented"), 10, accent_insensitive=True)


@register("accent_verify", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT {_AI}) AS BIGINT) AS issuers, min(mt_date) AS first_meeting, max(mt_date) AS last_meeting
FROM proposals_accented""", ["proposals_accented"])
def q_accent_verify(spark, sf):
    return va.verify_dataset(fx.view(spark, sf, "proposals_accented"), accent_insensitive=True)


# ---------------------------------------------------------------------- A25
@register("table_rows", "\nUNION ALL\n".join(f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in fx.TABLES)
          + "\nUNION ALL\nSELECT 'TOTAL', CAST(" + " + ".join(f"(SELECT count(*) FROM {t})" for t in fx.TABLES) + " AS BIGINT)")
def q_table_rows(spark, sf):
    """The inventory's rows by table (files and sizes depend on how tables are stored)."""
    return va.table_inventory(spark, {t: os.path.join(sf, f"{t}.parquet") for t in fx.TABLES}).select("table", "rows")


# ------------------------------------------------------------- S4 / A25 / R1
@register("row_group_inventory", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(1 AS BIGINT) AS files, count(*) AS rows, count(*) AS end_row, (SELECT count(*) FROM (DESCRIBE {t})) AS columns FROM {t}"
    for t in fx.TABLES))
def q_row_group_inventory(spark, sf):
    """Footers of every table: its files, rows, the row after its last group, columns."""
    groups = None
    for t in fx.TABLES:
        one = row_groups.row_groups(spark, os.path.join(sf, f"{t}.parquet")).withColumn("table_name", F.lit(t))
        groups = one if groups is None else groups.unionByName(one)
    return groups.groupBy("table_name").agg(F.count_distinct("file_path").alias("files"), F.sum("rows").alias("rows"),
                                            F.max(F.col("first_row") + F.col("rows")).alias("end_row"), F.max("columns").cast("bigint").alias("columns"))


_FILE_ROWS = 2_000_000      # rows of a file of row_group_load's input, where it has more than three


@register("row_group_load", "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag || l_linestatus AS flags FROM lineitem")
def q_row_group_load(spark, sf):
    """Lineitem in three files or more, of many row groups each; the second batch
    is cut off between its write and its commit; the next run has other batches."""
    src, table, done = (_scratch(spark, f"row-group-{n}") for n in ("src", "table", "ledger"))
    rows = fx.table(spark, sf, "lineitem")
    files = max(3, -(-rows.count() // _FILE_ROWS))
    rows.repartition(files, "l_orderkey", "l_linenumber").write.option("parquet.block.size", 64 * 1024).parquet(src)

    def cut(batch):
        if batch == 2:
            raise RuntimeError("cut off before the commit")

    def prepare(rows):
        return rows.withColumn("flags", F.concat("l_returnflag", "l_linestatus")).drop("l_returnflag", "l_linestatus")

    columns = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus").schema
    total = row_groups.row_groups(spark, src).agg(F.sum("bytes")).first()[0]
    try:
        row_groups.load_row_groups(spark, src, table, done, columns, transform=prepare, batch_bytes=total // 4 + 1, before_commit=cut)
    except RuntimeError as e:      # the cut that this query makes itself
        if "cut off before the commit" not in str(e):
            raise
    row_groups.load_row_groups(spark, src, table, done, columns, transform=prepare, batch_bytes=total // 2 + 1, task_bytes=total // 8 + 1)
    remove_path(spark, src)
    return row_groups.loaded(spark, table, done).drop("load_batch")
