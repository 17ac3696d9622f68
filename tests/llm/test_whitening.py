from decimal import Decimal

import numpy as np
import pytest

from ballotlens.llm import queries
from ballotlens.llm import whitening as wh
from conftest import SF_MID, SF_SMALL


def longs(rows):
    return [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in e]) for i, e in rows
            if e is not None and all(c is not None and np.isfinite(c) for c in e)]


def check(rows, got, k=16, explained=1e-4):
    """``got`` against numpy's eigenvectors of the plain covariance."""
    kept = longs(rows)
    want = {}
    for d in {len(x) for _, x in kept} - {0}:
        fit = np.array(sorted({tuple(x) for _, x in kept if len(x) == d}), np.int64).reshape(-1, d)
        n, s = len(fit), fit.sum(0)
        y = (n * fit - s) / n
        values, u = np.linalg.eigh(y.T @ y / n)
        values, u = values[::-1], u[:, ::-1]
        rank = min(k, int((values > 1e-13 * max(values.sum(), 1e-300)).sum())) if d else 0
        for i, x in kept:
            if len(x) == d:
                z = n * np.array(x, np.int64) - s
                for c in range(rank):
                    gap = min([abs(values[c] - values[e]) for e in range(d) if e != c], default=1) / values[0]
                    w = float(z / n @ u[:, c] / np.sqrt(values[c])) if gap > 1e-6 else None
                    want.setdefault((i, c + 1), []).append((n, sum(int(v) ** 2 for v in z), w, values[c] / values.sum()))
    have = {}
    for r in got:
        have.setdefault((r.vec_id, r.component), []).append((r.n, int(r.deviation), r.whitened, r.explained))
        assert r.identity_error <= 1e-9
    assert {key: len(v) for key, v in have.items()} == {key: len(v) for key, v in want.items()}
    signs = {}
    for key in want:
        for g, w in zip(sorted(have[key]), sorted(want[key], key=lambda v: (v[0], v[1], v[2] or 0)), strict=True):
            assert g[:2] == w[:2] and abs(g[3] / w[3] - 1) < explained
            if w[2] is not None:
                assert abs(abs(g[2]) - abs(w[2])) < 1e-6
                if abs(w[2]) > 1e-3:
                    signs.setdefault((w[0], key[1]), set()).add(g[2] * w[2] > 0)
    assert all(len(s) == 1 for s in signs.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "n", 1) for i, e in rows], "vec_id long, embedding array<double>, n string, component int").repartition(3)


def test_cholesky_and_jacobi():
    r = np.random.default_rng(1)
    for n, rank in ((1, 1), (5, 5), (40, 7), (65, 65)):
        b = r.normal(size=(n, rank)) * np.logspace(0, -4, rank)
        a = (b @ b.T).astype(np.longdouble)
        l = wh.pivoted_cholesky(a, 1e-14 * np.trace(a))
        assert l.shape[1] <= rank and np.abs(l @ l.T - a).max() < 1e-12 * np.trace(a)
        values, u = wh.components(a)
        assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-15 and (np.diff(values) <= 0).all()
        assert np.abs(u @ np.diag(values) @ u.T - a).max() < 1e-12 * np.trace(a)
    assert wh.components(np.zeros((3, 3), np.longdouble))[0].shape == (0,)


def test_as_plain_eigenvectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=20) * np.linspace(3, 0.2, 20) + 5).tolist()) for i in range(500)]
    rows += rows[:30] + [(9000 + i, rows[0][1]) for i in range(300)]                    # repeated rows and a hot vector
    rows += [(None, r.normal(size=20).tolist()), (1, None), (2, [None] * 20), (3, [float("nan")] * 20), (4, [float("inf")] * 20), (5, [1.0, None] * 10)]
    check(rows, wh.whiten(frame(spark, rows)).collect())


def test_low_rank_unlike_lengths_and_constants(spark):
    r = np.random.default_rng(3)
    rows = [(i, [*(np.round(r.normal(size=2)) * 10).tolist(), 4.0, 4.0]) for i in range(100)]     # two constant dimensions
    rows += [(200 + i, r.normal(size=3).tolist()) for i in range(50)] + [(300, [1.0] * 5), (301, [1.0] * 5), (302, [])]
    rows += [(400 + i, [1e9 + float(x) for x in r.integers(0, 50, 2)]) for i in range(60)]   # far from zero
    check(rows, wh.whiten(frame(spark, rows)).collect())
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert wh.whiten(frame(spark, []).limit(0)).count() == 0


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) * 2.0**40 for x in r.integers(-9, 9, 3)]) for i in range(80)]
    got = wh.whiten(frame(spark, rows)).collect()
    kept = longs(rows)
    fit = {tuple(x) for _, x in kept}
    sums = [sum(c) for c in zip(*fit)]
    want = {i: sum((len(fit) * a - b) ** 2 for a, b in zip(x, sums)) for i, x in kept}
    assert {g.vec_id: g.deviation for g in got} == {i: Decimal(v) for i, v in want.items()} and got[0].identity_error < 1e-9
    with pytest.raises(Exception, match="too large"):
        wh.whiten(frame(spark, [(1, [1e30]), (2, [0.0])])).collect()


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_as_plain_eigenvectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(rows, got.collect())
