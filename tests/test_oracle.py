"""Every registered query against its DuckDB oracle (multiset of rows, columns by name)."""
import decimal
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return v


def _rows(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows),
                  key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck_small, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck_small.sql(ORACLES[key])
    dcols = rel.columns
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    assert df.count() >= 1
