"""Embedding whitening by principal components.

1. Entries become integers, floor(scale * c) + shift.  The fit list holds each
   distinct vector once; copies combine before the shuffle.
2. Tasks sum the fit list, then, with the rounded mean taken off every vector,
   its products: exact integers, one triangle of sums a task, added in Spark.
   The rest of the centring, less than half a unit, is taken off in integers.
3. The covariance is factored by pivoted Cholesky, and one-sided Jacobi rotates
   the columns of the triangular factor until they are orthogonal: their squared
   norms are the eigenvalues, the normalised columns the components.  Both run
   on the driver in extended precision, on as many numbers as the square of a
   vector's length, whatever the number of rows.
4. Every row is projected where it is read; the fit list once more, for the
   covariance of what comes out.

Defined results: vectors that are null or hold a null or non-finite entry are
left out; rows without an id are whitened, too; repeated rows each give their
rows but count once in the fit; vectors of unlike length are fitted apart;
eigenvalues of 1e-14 of the trace or less count as none, so constant vectors (a
single one as well) and empty ones give no rows; an entry that no long holds is
an error; a component's sign makes its entry of greatest size positive; extra
columns go no further; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, batch_rows, lasting, stored, temporary

ROWS = 4096                # of an Arrow batch
NOTHING = 1e-14            # of the trace
_WHITE = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """Of the vectors of one length: n, sums of integers, components by falling
    eigenvalue (columns), eigenvalues and the trace."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def long_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("e"))
    whole = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale) + shift)
    x = F.transform("e", lambda c: F.coalesce(fits(c), F.raise_error(F.lit("an entry is too large for a long")).cast("long")))
    return rows.filter(F.col("e").isNotNull() & whole).select("vec_id", x.alias("x"))


def _by_length(lists):
    """(length, places, matrix) for an Arrow array of lists of longs."""
    ends = np.asarray(lists.offsets, np.int64)
    values, lengths = np.asarray(lists.values, np.int64), np.diff(ends)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, values[ends[at][:, None] + np.arange(d)]


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def products(y: np.ndarray) -> np.ndarray:
    """y.T y in exact integers."""
    most = _most(y) ** 2 * len(y)
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    g = y.astype(kind).T @ y.astype(kind)
    return (g.astype(np.int64) if kind is np.float64 else g).astype(object)


def _sums(fit: DataFrame, centres: dict[int, np.ndarray] | None) -> dict[tuple[int, int, int], int]:
    """(length, i, j): sums over the fit list; (d, -1, -1) counts, (d, i, -1) are
    plain sums, and with ``centres`` (d, i, j), j <= i, sums of products."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])
        n, first, second = {}, {}, {}
        for b in batches:
            for d, at, x in _by_length(b.column(0)):
                n[d] = n.get(d, 0) + len(at)
                if centres is None:
                    kind = np.int64 if _most(x) * len(x) < 2**63 else object
                    first[d] = first.get(d, 0) + x.astype(kind).sum(0).astype(object)
                else:
                    second[d] = second.get(d, 0) + products(x - centres[d])
        out = [(d, -1, -1, Decimal(c)) for d, c in n.items()]
        out += [(d, i, -1, Decimal(int(s))) for d, v in first.items() for i, s in enumerate(v)]
        out += [(d, i, j, Decimal(int(v[i, j]))) for d, v in second.items() for i in range(d) for j in range(i + 1)]
        yield arrays_to_batch(schema, [[r[c] for r in out] for c in range(4)])

    rows = fit.mapInArrow(run, "d int, i int, j int, s decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r.d, r.i, r.j): int(r.s) for r in rows}


def pivoted_cholesky(a: np.ndarray, nothing: float) -> np.ndarray:
    """l with a = l l', of as many columns as there are pivots over ``nothing``;
    rows in the order of the pivots are triangular."""
    left, l, order = np.diag(a).copy(), np.zeros_like(a), np.arange(len(a))
    for k in range(len(a)):
        p = k + int(np.argmax(left[order[k:]]))
        order[[k, p]] = order[[p, k]]
        top, below = order[k], order[k + 1:]
        if left[top] <= nothing:
            return l[:, :k]
        l[top, k] = np.sqrt(left[top])
        l[below, k] = (a[below, top] - l[below, :k] @ l[top, :k]) / l[top, k]
        left[below] -= l[below, k] ** 2
    return l


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of l rotated until they are orthogonal; as many disjoint pairs
    at once as there are, in the order of a round-robin tournament."""
    n = l.shape[1] + l.shape[1] % 2
    u = np.zeros((l.shape[0], n), l.dtype)
    u[:, :l.shape[1]] = l
    eps, seats = np.finfo(l.dtype).eps, np.arange(n)
    for _ in range(sweeps):
        turned = False
        for _ in range(n - 1):
            p, q = seats[:n // 2], seats[n // 2:][::-1]
            a, b, g = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            turn = np.abs(g) > 4 * eps * np.sqrt(a * b)
            if turn.any():
                turned = True
                z = (b[turn] - a[turn]) / (2 * g[turn])
                t = np.where(z < 0, -1, 1) / (np.abs(z) + np.sqrt(1 + z * z))
                c = 1 / np.sqrt(1 + t * t)
                x, y = u[:, p[turn]], u[:, q[turn]]
                u[:, p[turn]], u[:, q[turn]] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return u[:, :l.shape[1]]


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns)."""
    trace = np.trace(covariance)
    u = one_sided_jacobi(pivoted_cholesky(covariance, NOTHING * trace))
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] ** 2 > NOTHING * trace]
    u = u[:, order] / norms[order]
    signs = np.where(u[np.abs(u).argmax(0), np.arange(len(order))] < 0, -1, 1) if len(order) else 1
    return norms[order] ** 2, u * signs


def fit_components(fit: DataFrame, k: int) -> dict[int, Fit]:
    """A fit for each length of vectors, from the distinct ones."""
    first = _sums(fit, None)
    lengths = {d: n for (d, i, _), n in first.items() if i == -1}
    sums = {d: [first[d, i, -1] for i in range(d)] for d in lengths}
    centres = {d: np.array([(2 * s + n) // (2 * n) for s in sums[d]], np.int64) for d, n in lengths.items()}
    second, out = _sums(fit, centres), {}
    for d, n in lengths.items():
        rest = [s - n * int(c) for s, c in zip(sums[d], centres[d], strict=True)]
        v = np.zeros((d, d), np.longdouble)
        for i in range(d):
            for j in range(i + 1):
                v[i, j] = v[j, i] = np.longdouble(str(n * second[d, i, j] - rest[i] * rest[j])) / np.longdouble(str(n * n))
        values, u = components(v)
        out[d] = Fit(n, sums[d], u[:, :k].astype(np.float64), values[:k].astype(np.float64), float(np.trace(v)))
    return out


def scaled(f: Fit, x: np.ndarray) -> np.ndarray:
    """n x - sums, exactly."""
    if f.n * _most(x) + max(map(abs, f.sums), default=0) < 2**63:
        return f.n * x - np.array(f.sums, np.int64)
    return f.n * x.astype(object) - np.array(f.sums, object)


def white(f: Fit, z: np.ndarray) -> np.ndarray:
    centred = (z / f.n).astype(np.float64)
    return centred @ f.components / np.sqrt(f.values)


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Greatest entry, by size, of the whitened fit list's covariance less the
    identity; the vectors are centred before they are projected."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])
        total = {}
        for b in batches:
            for d, _, x in _by_length(b.column(0)):
                w = white(fits[d], scaled(fits[d], x))
                total[d] = total.get(d, 0) + np.vstack([w.sum(0)[None], w.T @ w])
        out = [(d, i - 1, j, float(v[i, j])) for d, v in total.items() for i in range(v.shape[0]) for j in range(v.shape[1])]
        yield arrays_to_batch(schema, [[r[c] for r in out] for c in range(4)])

    rows = fit.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect()
    sums = {(r.d, r.i, r.j): r.s for r in rows}
    out = {}
    for d, f in fits.items():
        r = range(len(f.values))
        mean = [sums[d, -1, i] / f.n for i in r]
        out[d] = max((abs(sums[d, i, j] / f.n - mean[i] * mean[j] - (i == j)) for i in r for j in r), default=0.0)
    return out


def whiten(vectors: DataFrame, k: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    a row for each row that takes part and each of the first k components."""
    spark = vectors.sparkSession
    with temporary(spark), batch_rows(spark, ROWS):
        data = lasting(long_vectors(vectors, scale, shift, id_col, vec_col), "longs")
        fit = stored(data.select("x").distinct(), "distinct")
        fits = fit_components(fit, k)
        errors = identity_errors(fit, fits)

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
                            ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                for d, at, x in _by_length(b.column(1)):
                    f, z = fits[d], scaled(fits[d], x)
                    r = len(f.values)
                    if not r:
                        continue
                    if z.dtype != object and _most(z) ** 2 * d < 2**63:
                        deviation = pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
                    else:
                        deviation = pa.array([Decimal(sum(int(c) ** 2 for c in row)) for row in z], pa.decimal128(38, 0))
                    each = pa.array(np.repeat(np.arange(len(at)), r))
                    yield arrays_to_batch(schema, [
                        b.column(0).take(pa.array(at)).take(each), np.tile(np.arange(1, r + 1, dtype=np.int32), len(at)), np.full(len(at) * r, f.n),
                        deviation.take(each), white(f, z).ravel(), np.tile(f.values / f.trace, len(at)), np.full(len(at) * r, errors[d])])

    return data.mapInArrow(run, _WHITE)
