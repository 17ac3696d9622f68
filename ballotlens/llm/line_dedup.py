"""Duplicate lines across documents, as compressed keep bitmaps.

1. Every line's key (ends stripped, A-Z lower-cased) becomes a 128-bit hash;
   rows (hash, document, position) go through one range partitioning with a
   secondary sort by document and position.  The range is over all of them, so
   a line that a third of the corpus holds spreads over as many partitions as
   its rows fill.
2. Each partition streams its runs of equal hashes, keeping no more of a run
   than the rows of fewer than ``min_docs`` documents.  It returns the rows of
   lines found in that many documents.  The first and the last run of a
   partition may go on in its neighbours: they leave a summary (two a
   partition), and summaries add up to totals, which are broadcast if they are
   counted to be few.
3. Rows to drop gather by document into a zlib-compressed bitmap, one bit a
   line (1: keep).  Texts are read again only where a bitmap is applied.

``keep_first=True`` keeps a repeated line's first occurrence by document and
position; otherwise all its lines go.

Defined results: a null or empty text is one empty line, which has no key;
documents are told apart by doc_id (null ids count as one document) and rows
of one id by their text; repeated rows are the same lines once more and get
the same bitmap; an empty table gives no bitmaps.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, forget_vocabularies, small_batches, stored, text_of

BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)            # stands for a null doc_id
ROW = ["h1", "h2", "doc", "text_hash", "pos"]
FEW_SUMMARIES = 200_000     # of some 80 bytes: totals of so many are broadcast, of more joined as Spark chooses
STREAM_ROWS = 65_536        # rows of an Arrow batch while runs are streamed


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash and text: what names a row's document and its text."""
    text = text_of(docs, text_col)
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def line_rows(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line that has a key: its hash, document and position."""
    rows = with_keys(docs, id_col, text_col)
    lines = rows.select("doc", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)
    return (lines.select("doc", "text_hash", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"), "doc", "text_hash", "pos"))


#: rows to drop (edge: in a run that may cross partitions), and runs' summaries
_STREAMED = "edge boolean, summary boolean, h1 long, h2 long, doc long, text_hash long, pos int, first boolean, n_docs long, last_doc long"


def _stream(min_docs: int):
    def run(batches):
        import pyarrow as pa
        forget_vocabularies()
        schema = pa.schema([("edge", pa.bool_()), ("summary", pa.bool_()), *((c, pa.int64()) for c in ROW[:4]), ("pos", pa.int32()),
                            ("first", pa.bool_()), ("n_docs", pa.int64()), ("last_doc", pa.int64())])
        state = None   # the open run: hash, first row, documents, last document, rows not returned yet, at the partition's start?

        def rows_out(rows, edge, first):
            n = len(rows[0])
            return arrays_to_batch(schema, [np.full(n, edge), np.zeros(n, bool), *rows[:4], rows[4].astype(np.int32), first, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())])

        def summary(s):
            return arrays_to_batch(schema, [[True], [True], *([x] for x in s["row"]), [None], [s["n"]], [s["last"]]])

        def close(s, at_end):
            edge = s["start"] or at_end
            if edge:
                yield summary(s)
            if s["rows"] is not None and (edge or s["n"] >= min_docs):
                first = np.zeros(len(s["rows"][0]), bool)
                first[0] = True
                yield rows_out(s["rows"], edge, first)

        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            n = len(cols[0])
            if not n:
                continue
            new_run = np.empty(n, bool)
            new_run[0] = state is None or (cols[0][0], cols[1][0]) != state["row"][:2]
            new_run[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
            new_doc = new_run.copy()
            new_doc[1:] |= np.diff(cols[2]) != 0
            new_doc[0] |= state is not None and cols[2][0] != state["last"]
            starts = np.flatnonzero(new_run)
            head = starts[0] if len(starts) else n   # rows that go on with the open run
            if head:
                rows = [c[:head] for c in cols]
                state["n"] += int(new_doc[:head].sum())
                state["last"] = int(rows[2][-1])
                if state["rows"] is not None:
                    state["rows"] = [np.concatenate(x) for x in zip(state["rows"], rows, strict=True)]
                else:   # enough documents already: no need to hold its rows
                    yield rows_out(rows, state["start"], np.zeros(head, bool))
            if len(starts):
                if state is not None:
                    yield from close(state, False)
                lengths = np.diff(np.append(starts, n))
                n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
                inner = np.zeros(len(starts), bool)
                inner[(state is None):len(starts) - 1] = True
                if state is None and len(starts) > 1:   # the partition's first run
                    e = starts[1]
                    yield from close({"row": tuple(int(c[0]) for c in cols), "n": int(n_docs[0]), "last": int(cols[2][e - 1]), "rows": [c[:e] for c in cols], "start": True}, False)
                take = np.repeat(inner & (n_docs >= min_docs), lengths)
                if take.any():
                    at = np.flatnonzero(take) + head
                    yield rows_out([c[at] for c in cols], False, new_run[at])
                e = int(starts[-1])
                state = {"row": tuple(int(c[e]) for c in cols), "n": int(n_docs[-1]), "last": int(cols[2][-1]), "rows": [c[e:] for c in cols], "start": state is None and len(starts) == 1}
            if state["rows"] is not None and state["n"] >= min_docs:
                first = np.zeros(len(state["rows"][0]), bool)
                first[0] = True
                # whether the run is an edge shows only at its end unless it began the partition;
                # a first row is settled by the totals, so all rows of an open run count as edge
                yield rows_out(state["rows"], True, first)
                state["rows"] = None
        if state is not None:
            yield from close(state, True)
    return run


def dropped_rows(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, pos) of the lines to drop."""
    rows = line_rows(docs, min_chars, id_col, text_col)
    small_batches(docs.sparkSession)
    ranged = rows.repartitionByRange(*ROW).sortWithinPartitions(*ROW)
    found = stored(ranged.mapInArrow(_stream(min_docs), _STREAMED), "line-runs")
    # summaries of one hash in their order: documents that go on across a cut count once
    order = Window.partitionBy("h1", "h2").orderBy("doc", "text_hash", "pos")
    totals = (found.filter("summary")
              .withColumn("again", (F.lag("last_doc").over(order) == F.col("doc")).cast("long"))
              .groupBy("h1", "h2")
              .agg((F.sum("n_docs") - F.coalesce(F.sum("again"), F.lit(0))).alias("total"),
                   F.min(F.struct("doc", "text_hash", "pos")).alias("first_row")))
    rows = found.filter("not summary")
    inner = rows.filter("not edge").select("doc", "text_hash", "pos", "first")
    few = found.filter("summary").count() <= FEW_SUMMARIES
    edge = (rows.filter("edge").join(F.broadcast(totals) if few else totals, ["h1", "h2"], "left")
            .filter(F.col("total").isNull() | (F.col("total") >= min_docs))
            .select("doc", "text_hash", "pos",
                    F.when(F.col("total").isNull(), F.col("first")).otherwise(F.struct("doc", "text_hash", "pos") == F.col("first_row")).alias("first")))
    out = inner.unionByName(edge)
    return (out.filter("not first") if keep_first else out).drop("first")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, n_dropped, bitmap): only of documents that lose lines."""
    dropped = dropped_rows(docs, min_docs, min_chars, keep_first, id_col, text_col)
    # a document's positions, bounded by its own text
    gathered = dropped.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("positions"))

    def pack(batches):
        import pyarrow as pa
        import zlib
        schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("n_dropped", pa.int64()), ("bitmap", pa.binary())])
        for b in batches:
            maps = []
            for p in b.column(2):
                at = np.asarray(p.values)
                bits = np.ones(int(at.max()) // 8 * 8 + 8, bool)   # lines after the last bit are kept
                bits[at] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            yield arrays_to_batch(schema, [b.column(0), b.column(1), [len(p.values) for p in b.column(2)], maps])

    return gathered.mapInArrow(pack, "doc long, text_hash long, n_dropped long, bitmap binary")


def kept_text(text: str, bitmap: bytes | None) -> str:
    """The text without the lines that its bitmap drops."""
    if bitmap is None:
        return text
    import zlib
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).tolist()
    return "\n".join([x for x, keep in zip(lines, bits + [1] * (len(lines) - len(bits))) if keep])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row struct of all of docs' columns, n_lines, n_dropped, kept): one row for each row of docs."""
    text = text_of(docs, text_col)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text.alias("whole"),
                       F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"))
    both = rows.join(bitmaps, ["doc", "text_hash"], "left")

    @F.arrow_udf("string")
    def kept(whole: pa.Array, bitmap: pa.Array) -> pa.Array:
        return pa.array([kept_text(t, m) for t, m in zip(whole.to_pylist(), bitmap.to_pylist(), strict=True)], pa.string())

    return both.select("row", F.size(F.split("whole", "\n", -1)).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       kept("whole", "bitmap").alias("kept"))
