"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

1. The corpus's documents and terms are counted.
2. Each task cuts its documents into shards (bounded in documents and bytes) and
   writes one row a shard: sorted terms, and for each a posting list in blocks
   of 128 (document gap, occurrences) in variable bytes.  Of a block stand
   outside the bytes: its last document and its greatest impact, from the
   corpus's counts.  A frequent term's list is spread over all shards.
3. A shard answers every query: lists in order of their greatest scores; as long
   as documents found only in the lists to come could reach the k-th best score,
   a list is essential and read whole.  Of the rest only blocks are read that
   hold a candidate whose score, the block's greatest and the greatest of the
   lists after it reach the k-th best.
4. A task's shards share a heap for each query, so later shards start from its
   k-th best; tasks' heaps merge in one ranking by query.

Queries come in blocks of bounded bytes, each against all shards.

Scores are integers: a term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))),
a posting's impact (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L.

Defined results: terms are runs of digits, letters a-z and characters beyond
ASCII, after lower-casing A-Z; null and empty texts have none and are never
found; rows are documents of their own, repeated ones too; equal scores go by
doc_id, those without one last; items without a term find nothing; rows of one
item_id with the same terms are one item, others rank each on their own; texts
of any length are read whole; extra columns go no further; empty tables give an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, batch_rows, forget_vocabularies, id_and_text, lasting, small_batches, stored, temporary, text_of

BLOCK = 128                # postings
SHARD_DOCS = 16_384
SHARD_BYTES = 16 << 20     # of text; one longer text is a shard of its own
ITEM_BYTES = 4 << 20       # of queries' terms that are searched at once
_PIECE = 1 << 20           # bytes of a text that are split at once
_CLASSES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SHARD = "terms binary, df binary, block_max binary, block_last binary, block_at binary, postings binary, ids binary, n_null int, m binary"


class Index(NamedTuple):
    n_docs: int            # documents with a term
    n_terms: int           # their terms, with repeats
    shards: DataFrame


def pieces(body: bytes):
    """Lists of the terms of a text in UTF-8, a megabyte at a time."""
    words, start = body.translate(_CLASSES), 0
    while start < len(words):
        end = words.find(b" ", start + _PIECE)
        end = len(words) if end < 0 else end
        yield words[start:end].split()
        start = end


def varint(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first; and the bytes of each value."""
    n = np.ones(len(v), np.int64)
    for bits in (7, 14, 21, 28, 35):
        n += v >= 1 << bits
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[at[has] + k] = ((v[has] >> 7 * k) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, n


def unvarint(b: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(b < 128)
    if len(ends) == len(b):
        return b.astype(np.int64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


class _Numbers(dict):
    def __missing__(self, term):
        self[term] = n = len(self)
        return n


class Builder:
    """Collects a shard's documents."""

    def __init__(self, n_docs: int, n_terms: int, most_docs: int = SHARD_DOCS):
        self.corpus, self.most_docs, self.numbers, self.size = (n_docs, n_terms), most_docs, _Numbers(), 0
        self.ids, self.lengths, self.terms, self.tfs = [], [], [], []

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or self.size >= SHARD_BYTES

    def add(self, doc_id: int | None, body: bytes) -> None:
        counts, n = Counter(), 0
        for words in pieces(body):
            counts.update(words)
            n += len(words)
        if n:
            self.size += len(body)
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
            self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))

    def pack(self) -> list:
        n_docs, n_terms = self.corpus
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        m = np.array([10 + 90 * self.lengths[i] * n_docs // n_terms for i in order], np.int64)
        names = sorted(self.numbers)
        place = np.empty(len(names), np.int64)
        place[[self.numbers[t] for t in names]] = np.arange(len(names))
        term = place[np.concatenate(self.terms)]
        doc = np.repeat(rank, [len(t) for t in self.terms])
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], np.concatenate(self.tfs)[by]
        df = np.bincount(term, minlength=len(names))
        within = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
        first = np.flatnonzero(within % BLOCK == 0)
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        coded, sizes = varint(np.stack([gap, tf], 1).ravel())
        at = np.append(0, np.cumsum(sizes))[2 * first]
        known = [i for i in (self.ids[i] for i in order) if i is not None]
        return [b"\n".join(names), df.astype("<i4").tobytes(), np.maximum.reduceat(impact(tf, m[doc]), first).astype("<i4").tobytes(),
                doc[np.append(first[1:], len(doc)) - 1].astype("<i4").tobytes(), at.astype("<i4").tobytes(), coded.tobytes(),
                np.array(known, "<i8").tobytes(), len(order) - len(known), m.astype("<i8").tobytes()]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """A shard's lists of the terms that are asked for."""

    def __init__(self, row: dict, asked):
        self.numbers = {t: i for i, t in enumerate(row["terms"].split(b"\n")) if t in asked}
        self.df, self.block_max, self.block_last, self.block_at = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("df", "block_max", "block_last", "block_at"))
        self.coded, self.m = np.frombuffer(row["postings"], np.uint8), np.frombuffer(row["m"], "<i8")
        self.ids = np.frombuffer(row["ids"], "<i8")
        blocks = -(-self.df // BLOCK)
        self.first = np.append(0, np.cumsum(blocks))
        self.at = np.append(self.block_at, len(self.coded))
        self.whole, self.blocks_read = {}, 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        self.blocks_read += 1
        v = unvarint(self.coded[self.at[b]:self.at[b + 1]])
        doc = np.cumsum(v[::2])
        return doc, impact(v[1::2], self.m[doc])

    def list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list, kept for the queries to come."""
        if i not in self.whole:
            a, z = self.first[i], self.first[i + 1]
            self.blocks_read += int(z - a)
            v = unvarint(self.coded[self.at[a]:self.at[z]])
            gap, head = v[::2], np.arange(0, len(v) // 2, BLOCK)
            total = np.cumsum(gap)
            before = total[head] - gap[head]
            doc = total - np.repeat(before, np.diff(np.append(head, len(gap))))
            self.whole[i] = doc, impact(v[1::2], self.m[doc])
        return self.whole[i]

    def search(self, weights: list[tuple[bytes, int]], k: int, reach: int) -> list[tuple[int, int]]:
        """(document, score) of all that may be among the best k, given that a
        score below ``reach`` is not."""
        lists = sorted(((w * int(self.block_max[self.first[i]:self.first[i + 1]].max()), w, i)
                        for t, w in weights if w > 0 and (i := self.numbers.get(t)) is not None), reverse=True)
        rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0) if lists else [0]
        scores, reach, j = np.zeros(len(self.m), np.int64), max(reach, 1), 0

        def raised(found):
            return max(reach, int(np.partition(found, len(found) - k)[len(found) - k])) if len(found) >= k else reach

        while j < len(lists) and rest[j] >= reach:        # essential: read whole
            doc, f = self.list(lists[j][2])
            scores[doc] += lists[j][1] * f
            j += 1
            reach = raised(scores)
        candidates = np.flatnonzero((scores > 0) & (scores + rest[j] >= reach))
        for j in range(j, len(lists)):
            if not len(candidates):
                break
            _, w, i = lists[j]
            a, z = int(self.first[i]), int(self.first[i + 1])
            b = a + np.searchsorted(self.block_last[a:z], candidates)
            most = np.where(b < z, w * self.block_max[np.minimum(b, z - 1)], 0)
            keep = scores[candidates] + most + rest[j + 1] >= reach
            candidates, b = candidates[keep], b[keep]
            for n in np.unique(b[b < z]).tolist():
                doc, f = self.block(n)
                asked = candidates[b == n]
                place = np.minimum(np.searchsorted(doc, asked), len(doc) - 1)
                scores[asked] += np.where(doc[place] == asked, w * f[place], 0)
            reach = raised(scores[candidates])
            candidates = candidates[scores[candidates] + rest[j + 1] >= reach]
        return [(int(d), int(scores[d])) for d in candidates]


def counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64())])
        n_docs = n_terms = 0
        for b in batches:
            for body in b.column(0).cast(pa.binary()).to_pylist():
                n = sum(map(len, pieces(body)))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield arrays_to_batch(schema, [[n_docs], [n_terms]])

    total = docs.select("text").mapInArrow(run, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return total[0] or 0, total[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    """An index of all terms of all documents; its shards are a written table."""
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    n_docs, n_terms = counts(rows)

    def run(batches):
        import pyarrow as pa
        forget_vocabularies()
        schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in _SHARD.split(", ")])
        shard = Builder(n_docs, n_terms, shard_docs)
        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shard.add(i, body)
                if shard.full():
                    yield arrays_to_batch(schema, [[x] for x in shard.pack()])
                    shard = Builder(n_docs, n_terms, shard_docs)
        if shard.ids:
            yield arrays_to_batch(schema, [[x] for x in shard.pack()])

    return Index(n_docs, n_terms, stored(rows.mapInArrow(run, _SHARD), "shards"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): distinct terms of each item, sorted, one a line."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("item_id", pa.int64()), ("terms", pa.binary())])
        for b in batches:
            terms = [b"\n".join(sorted(set().union(*pieces(t)))) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield arrays_to_batch(schema, [b.column(0), terms])

    rows = items.select(items[id_col].cast("long").alias("item_id"), text_of(items, text_col).alias("text"))
    return rows.mapInArrow(run, "item_id long, terms binary").filter(F.length("terms") > 0).distinct()


def frequencies(index: Index, asked: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the terms asked for."""
    def run(batches):
        import pyarrow as pa
        schema, found = pa.schema([("term", pa.binary()), ("df", pa.int64())]), Counter()
        for b in batches:
            for terms, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df = np.frombuffer(df, "<i4")
                found.update({t: int(df[i]) for i, t in enumerate(terms.split(b"\n")) if t in asked})
        yield arrays_to_batch(schema, [list(found), list(found.values())])

    rows = index.shards.select("terms", "df").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in rows.collect()}      # no more rows than terms asked for


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def heaps(index: Index, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """(number, item_id, doc_id, score): each task's best k of every item."""
    df = frequencies(index, {t for _, terms in items for t in terms})
    weights = {t: weight(index.n_docs, n) for t, n in df.items()}
    queries = [(i, [(t, weights[t]) for t in terms if t in weights]) for i, terms in items]

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("number", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        best: list[list] = [[] for _ in queries]        # (-score, without an id, id)
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row, weights)
                for heap, (_, terms) in zip(best, queries, strict=True):
                    found = shard.search(terms, k, -heap[-1][0] if len(heap) == k else 0)
                    if found:
                        heap += [(-s, d >= len(shard.ids), int(shard.ids[d]) if d < len(shard.ids) else 0) for d, s in found]
                        heap.sort()
                        del heap[k:]
        out = [(n, queries[n][0], None if none else i, -s) for n, heap in enumerate(best) for s, none, i in heap]
        yield arrays_to_batch(schema, [[r[c] for r in out] for c in range(4)])

    return index.shards.mapInArrow(run, "number int, item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best k documents of each item."""
    spark = items.sparkSession
    asked = stored(item_terms(items, id_col, text_col), "items")
    blocks = -(-(asked.agg(F.sum(F.length("terms") + 8)).first()[0] or 0) // item_bytes)
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks if index.n_docs else 0):
        some = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()   # about ``item_bytes``
        if some:
            with batch_rows(spark, 1):      # a row is a shard
                ranked = heaps(index, [(r.item_id, bytes(r.terms).split(b"\n")) for r in some], k).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
                out = out.unionByName(lasting(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The best k of ``docs`` for each of ``items``; the index is removed after."""
    with temporary(docs.sparkSession):
        return search(build_index(docs), items, k)
