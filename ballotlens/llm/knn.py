"""Exact top-k inner-product search as a Voronoi kNN join.

1. A bounded sample of distinct vectors are pivots (more of them the more
   vectors there are, up to a bound); every vector joins its nearest
   pivot's group (its Voronoi cell).
2. A summary of each group (size, radius, greatest norm, and the ``k + 1``
   least distances from the pivot, of as many ids) bounds inner products by
   Cauchy-Schwarz:
   a member x at distance d from pivot p has q.p - |q| d <= q.x <= q.p + |q| d.
   The k-th best of the lower bounds over all groups, without those of the
   query's own id, is a score that a query's k-th answer reaches.
3. A query meets only the groups whose upper bound reaches that score, there
   each block of the group (a group of a third of all rows is as many blocks as
   its size asks for), and every block is solved locally.  Neighbouring blocks
   are a bundle: queries are copied to bundles, not to blocks, so copies don't
   grow with the number of groups; and they are shuffled, never broadcast.
4. The blocks' best k of each query merge into its best k.

Components are floor(scale * x); scores are exact integers.  Bounds carry a
slack for rounding, so no answer is lost.

Defined results: vectors that are null or hold a null or non-finite component,
and rows without an id, take no part; vectors are compared with those of equal
length (an empty vector scores 0); a candidate with the query's id is the
query's own; repeated rows are candidates as often as they occur, and a
repeated query row is one query; ties go to the smaller id; scores beyond a
long are set to its limits; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, batch_rows, discard, lasting, stored, temporary

PIVOTS = 64, 1_024        # least and most; between them a quarter of the root of the number of vectors
BLOCK_ROWS = 8_192        # vectors of a block of a group
BLOCK_QUERIES = 1_024     # queries solved with a block at once
BUNDLE_ROWS = 65_536      # vectors of a bundle at most (a block at least) ...
BUNDLES = 64              # ... and so many bundles at least, if there are as many blocks
SLICE = 64                # queries scored at once
ROUTED = 256              # queries that one task routes
_VECTOR = "vec_id long, dim int, v binary"


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, v): components as packed 64-bit integers."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("e")).filter("vec_id is not null and e is not null")

    def pack(batches):
        import pyarrow as pa
        schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])
        for b in batches:
            ids, dims, out = [], [], []
            for i, e in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = e.values
                if x.null_count:
                    continue
                x = np.asarray(x, np.float64) * scale
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(np.clip(np.floor(x), -(2.0**62), 2.0**62).astype("<i8").tobytes())
            yield arrays_to_batch(schema, [ids, dims, out])

    return rows.mapInArrow(pack, _VECTOR)


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), dim)


def pivot_sets(vectors: DataFrame, n_pivots: int | None = None) -> dict[int, np.ndarray]:
    """Pivots of each length: the vectors of least hash, alike ones once
    whatever their ids, and the zero vector where a length has none."""
    n = vectors.count()
    if n_pivots is None:
        n_pivots = max(PIVOTS[0], min(PIVOTS[1], math.isqrt(n) // 4))
    rows = vectors.select("dim", "v", F.xxhash64("dim", "v").alias("h"))
    out: dict[int, set] = {}
    # a share of the hashes that holds about eight times as many, so that few vectors are
    # compared to be told apart; all of them if copies leave too few in that share
    for share in sorted({min(1.0, 8 * n_pivots / max(1, n)), 1.0}):
        some = rows if share == 1 else rows.filter(F.col("h") < int((share - 0.5) * 2**64))
        found = some.distinct().orderBy("h", "dim", "v").limit(n_pivots).collect()
        if len(found) == n_pivots:
            break
    for r in found:
        out.setdefault(r.dim, set()).add(bytes(r.v))
    return {d: _matrix(sorted(s), d).astype(np.float64) for d, s in out.items()}


def cell_of(pivots: dict[int, np.ndarray], dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot's number and the distance from it, for each row of x."""
    p = pivots.get(dim, np.zeros((1, dim)))
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T)
    best = d.argmin(1)
    diff = x - p[best]
    return best, np.sqrt((diff * diff).sum(1))


def grouped(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    def assign(batches):
        import pyarrow as pa
        schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), ("cell", pa.int32()), ("distance", pa.float64()), ("norm", pa.float64())])
        for b in batches:
            dims, packed = np.asarray(b.column(1)), b.column(2).to_pylist()
            cell, dist, norm = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix([packed[i] for i in at], int(d)).astype(np.float64)
                cell[at], dist[at] = cell_of(pivots, int(d), x)
                norm[at] = np.sqrt((x * x).sum(1))
            yield arrays_to_batch(schema, [*b.columns, cell, dist, norm])

    return vectors.mapInArrow(assign, _VECTOR + ", cell int, distance double, norm double")


class Summary:
    """Of each length: pivots, and by group radius, norm, least distances and blocks."""

    def __init__(self, pivots: dict[int, np.ndarray], rows: list, near: list, k: int, block_rows: int):
        self.k, self.cells = k, {}
        for r in rows:
            p = pivots.get(r.dim, np.zeros((1, r.dim)))
            self.cells.setdefault(r.dim, []).append((r.cell, p[r.cell], r.radius, r.norm, -(-r.n // block_rows)))
        self.near = {}
        for r in near:
            self.near.setdefault((r.dim, r.cell), []).append((r.distance, getattr(r, "vec_id", None)))

    def groups_for(self, q: np.ndarray, query_id: int | None = None) -> list[tuple[int, int]]:
        """(cell, blocks) of the groups that may hold one of q's best k."""
        cells = self.cells[len(q)]
        p = np.array([c[1] for c in cells]).reshape(len(cells), len(q))
        size = float(np.sqrt((q * q).sum()))
        middle = p @ q
        slack = 1e-9 * (1 + size * (np.abs(p).sum(1).max(initial=0) + max(c[2] for c in cells)))
        others = [[d for d, i in self.near[len(q), c[0]] if i is None or i != query_id] for c in cells]
        lower = np.concatenate([m - size * np.array(d, float) for m, d in zip(middle, others, strict=True)])
        reach = np.sort(lower)[::-1][self.k - 1] if len(lower) >= self.k else -np.inf
        upper = np.minimum(middle + size * np.array([c[2] for c in cells]), size * np.array([c[3] for c in cells]))
        return [(c[0], c[4]) for c, u in zip(cells, upper, strict=True) if u + slack >= reach - slack]


def bundles(rows: list, block_rows: int, bundle_rows: int = BUNDLE_ROWS, least: int = BUNDLES) -> tuple[int, dict[tuple[int, int], tuple[int, int]]]:
    """Blocks of a bundle, and (first bundle, blocks) of each (length, cell): small
    groups of one length share a bundle, a large one has as many as its blocks ask for."""
    most = min(bundle_rows, sum(r.n for r in rows) // least)
    span = max(1, most // block_rows)
    out, following, room, dim = {}, 0, 0, None
    for r in sorted(rows, key=lambda r: (r.dim, r.cell)):
        blocks = -(-r.n // block_rows)
        if dim == r.dim and r.n <= room and blocks <= span:
            out[r.dim, r.cell], room = (following - 1, blocks), room - r.n
        else:
            out[r.dim, r.cell] = (following, blocks)
            following += -(-blocks // span)
            dim, room = r.dim, most - r.n if blocks <= span else 0
    return span, out


def local_best(ids: np.ndarray, data: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """Best k of a block for each query: (query number, id, score)."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    dim = max(1, data.shape[1])
    most = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dim
    if most >= 2.0**62:
        scores, out = queries.astype(object) @ data.T.astype(object), []
        for i in range(len(qids)):
            own = np.flatnonzero(ids != qids[i])
            best = sorted(own, key=lambda j: (-scores[i, j], j))[:k]
            out += [(i, int(ids[j]), max(-(2**63), min(2**63 - 1, int(scores[i, j])))) for j in best]
        return out
    kind = np.float64 if most < 2.0**53 else np.int64
    queries, data = queries.astype(kind), np.ascontiguousarray(data.T, kind)
    none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min      # scores lie above it
    first, end = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
    parts = 4 * k if len(ids) >= 16 * k else 0
    out = []
    for at in range(0, len(qids), SLICE):
        scores = queries[at:at + SLICE] @ data
        for i in np.flatnonzero(first[at:at + SLICE] < end[at:at + SLICE]):
            scores[i, first[at + i]:end[at + i]] = none
        # k parts reach the k-th best of the parts' best scores, and so do k vectors
        if parts:
            width = len(ids) // parts
            tops = scores[:, :parts * width].reshape(len(scores), parts, width).max(2)
            reach = np.partition(tops, parts - k, axis=1)[:, parts - k]
            at_least = np.flatnonzero(scores >= reach[:, None])
        else:
            at_least = np.arange(scores.size)
        at_least = at_least[scores.ravel()[at_least] > none]
        i, j = np.divmod(at_least, max(1, len(ids)))
        s = scores[i, j]
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out += zip((i[best] + at).tolist(), ids[j[best]].tolist(), map(int, s[best].tolist()), strict=True)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, n_pivots: int | None = None, block_rows: int = BLOCK_ROWS,
          block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on vec_id.
    The result is a written table; the tables it was made from are removed."""
    with temporary(vectors.sparkSession):
        return _top_k(vectors, is_query, k, scale, n_pivots, block_rows, block_queries, id_col, vec_col)


def _top_k(vectors, is_query, k, scale, n_pivots, block_rows, block_queries, id_col, vec_col) -> DataFrame:
    spark = vectors.sparkSession
    with batch_rows(spark, 4096):
        packed = stored(integer_vectors(vectors, scale, id_col, vec_col), "vectors")
    pivots = pivot_sets(packed, n_pivots)
    data = stored(grouped(packed, pivots), "cells")
    discard(packed)
    # both bounded: a row for each group, and distances of k + 1 ids of each, as one may be the query's own
    groups = data.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm"))
    by = Window.partitionBy("dim", "cell").orderBy("distance", "vec_id")
    near = data.groupBy("dim", "cell", "vec_id").agg(F.min("distance").alias("distance")).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    summary = Summary(pivots, rows := groups.collect(), near.collect(), k, block_rows)
    # block counts and bundles: a group for each pivot at most, and one for each odd length
    span, first = bundles(rows, block_rows)
    counts = spark.createDataFrame([(*key, n, bundle) for key, (bundle, n) in first.items()], "dim int, cell int, blocks long, first long")

    def route(batches):
        import pyarrow as pa
        schema = pa.schema([("dim", pa.int32()), ("bundle", pa.int64()), ("query_id", pa.int64()), ("q", pa.binary()), ("cells", pa.list_(pa.int32()))])
        for b in batches:
            out = []
            for i, d, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                asks: dict[int, list[int]] = {}
                for c, blocks in summary.groups_for(_matrix([v], d)[0].astype(np.float64), i):
                    for n in range(-(-blocks // span)):
                        asks.setdefault(first[d, c][0] + n, []).append(c)
                out += [(d, bundle, i, v, cells) for bundle, cells in asks.items()]
            yield arrays_to_batch(schema, [[r[j] for r in out] for j in range(5)])

    key = ["dim", "bundle"]
    n_queries = data.filter(is_query).count()
    asked = (data.filter(is_query).select("vec_id", "dim", "v").distinct().repartition(max(1, -(-n_queries // ROUTED)))
             .mapInArrow(route, "dim int, bundle long, query_id long, q binary, cells array<int>"))
    # queries of a bundle, in packs of bounded size: enough packs for all queries at once; both sides are shuffled once, by what they are joined on
    packs = max(1, -(-n_queries // block_queries))
    asked = (asked.withColumn("pack", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(packs))).repartition(*key)
             .groupBy(*key, "pack").agg(F.collect_list(F.struct("query_id", "q", "cells")).alias("queries")).drop("pack"))
    blocks = (data.join(F.broadcast(counts), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
              .withColumn("bundle", F.col("first") + F.floor(F.col("block") / span)).repartition(*key)
              .groupBy(*key, "cell", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("members")))

    def solve(batches):
        import pyarrow as pa
        schema = pa.schema([("query_id", pa.int64()), ("q_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for b in batches:
            for dim, cell, qs, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                qids, packed, cells = (qs.values.field(i).to_pylist() for i in range(3))
                at = [i for i, c in enumerate(cells) if cell in c]
                if not at:
                    continue
                qids, packed = np.array([qids[i] for i in at]), [packed[i] for i in at]
                # rows of one id that differ are told apart by their components
                marks = [int.from_bytes(hashlib.blake2b(q, digest_size=7).digest(), "little") for q in packed]
                ids, members = (ms.values.field(i) for i in range(2))
                found = local_best(np.asarray(ids), _matrix(members.to_pylist(), dim), qids, _matrix(packed, dim), k)
                yield arrays_to_batch(schema, [[int(qids[f[0]]) for f in found], [marks[f[0]] for f in found], [f[1] for f in found], [f[2] for f in found]])

    # rows of packs are long and few: by their number Spark would take them for a small table and broadcast them
    best = asked.hint("merge").join(blocks, key).select("dim", "cell", "queries", "members").mapInArrow(solve, "query_id long, q_hash long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id"))
    with batch_rows(spark, 4):     # a row is a block of vectors and a pack of queries
        return lasting(best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
