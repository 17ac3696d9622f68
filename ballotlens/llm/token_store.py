"""Token ids in files: context-mixed range-coded blocks, in ascending doc_id order.

``write`` range-partitions the documents by doc_id into parts of about
``part_bytes`` of text; rows of one id, or without an id, are told apart by
their texts, and equal rows by the input partition they come from, so no id
makes a part of its own grow.  Each part encodes its texts, appends the end id
to each, and codes its ids in runs of whole documents (of at most ``RUN_IDS``
ids, or one longer document) as blocks (``range_coder``).  A store is a folder
of two Parquet tables that Spark's committer writes, so a lost task leaves no
half files: ``blocks`` (part, run, row, payload) and ``docs`` (part, run, row,
doc_id, start within the part, n_tokens).  Parts are numbered in doc_id order.

``read`` decodes from these files alone: a run's blocks and documents meet in
one call, whatever its part's size, and a part's first id counts the ids of all
parts before it (one total a part, which bounds what the driver adds up).

Defined results: null text is the empty text (only the end id); rows without
doc_id come first; rows of one doc_id lie in the order of their texts' first 32
characters, then of a hash of the text; a very long text is a run of its own,
coded and decoded block by block; a damaged block raises an error; an empty
table gives a store without blocks; extra columns of any name stay behind.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.llm import bpe, pretokens, range_coder, word_ids
from ballotlens.llm.common import arrays_to_batch, id_and_text, slices, small_batches

END_ID = 2
RUN_IDS = 4 * range_coder.BLOCK_IDS      # what a task holds at once, if no document is longer


@lru_cache(maxsize=2)
def _library(path: str):
    """The vocabulary in a faster library, for texts on whose words both agree."""
    import tiktoken

    ranks = {b: i for i, b in bpe.load(path).bytes_of.items() if i not in set(bpe.load(path).special.values())}
    return tiktoken.Encoding("store", pat_str=pretokens.BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _words(path: str) -> word_ids.WordIds:
    return word_ids.WordIds(_library(path).encode_ordinary)


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of a text as the vocabulary file's library gives them."""
    own = bpe.load(path)
    if pretokens.is_latin(text) and not any(s in text for s in own.special):
        return _library(path).encode_to_numpy(text)
    return np.frombuffer(own.encode(text), "<u4")


def ids_of_texts(texts: list[str], path: str, end_id: int):
    """Ids of each text, with the end id; many short texts at once."""
    special = bpe.load(path).special
    for s, e in slices(texts):
        some = texts[s:e]
        many = [len(t) <= word_ids.LONG_TEXT and pretokens.is_latin(t) and not any(x in t for x in special) for t in some]
        found = iter(_words(path).encode([t.encode("latin-1") for t, m in zip(some, many) if m], end_id) if any(many) else ())
        for t, m in zip(some, many):
            yield next(found) if m else np.append(ids_of(t, path), np.uint32(end_id))


_ROWS = "kind string, part int, run long, row long, doc_id long, start long, n_tokens long, payload binary"


def _in_parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Rows in range partitions of (doc_id, text): as many as the session's
    shuffles have, more where those would hold over ``part_bytes`` of text."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes)
    # sampled keys stay short; an input partition's number, unlike a row's, survives a lost task
    by = ["doc_id", "head", "hash", "source"]
    keyed = rows.select("doc_id", "text", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("source"))
    more = (parts,) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()
    return keyed.repartitionByRange(*more, *by).sortWithinPartitions(*by).select("doc_id", "text")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
          part_bytes: int = 128 << 20, run_ids: int = RUN_IDS) -> None:
    """Writes the store at ``path``, a folder that all executors share."""
    small_batches(docs.sparkSession)
    rows = _in_parts(id_and_text(docs, id_col, text_col), part_bytes)

    def code(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()),
                            ("start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        waiting, n_waiting, row, run, start = [], 0, 0, 0, 0

        def blocks():
            """The waiting documents are a run."""
            nonlocal waiting, n_waiting, run
            coded = range_coder.encode(np.concatenate(waiting))
            n, none = len(coded), [None] * len(coded)
            out = arrays_to_batch(schema, [["blocks"] * n, [part] * n, [run] * n, list(range(n)), none, none, none, coded])
            waiting, n_waiting, run = [], 0, run + 1
            return out

        for b in batches:
            runs, starts, sizes = [], [], []
            for ids in ids_of_texts(b.column(1).to_pylist(), tokenizer, end_id):
                if n_waiting and n_waiting + len(ids) > run_ids:
                    yield blocks()
                waiting.append(ids)
                n_waiting += len(ids)
                runs.append(run)
                starts.append(start)
                sizes.append(len(ids))
                start += len(ids)
            n = len(runs)
            yield arrays_to_batch(schema, [["docs"] * n, [part] * n, runs, list(range(row, row + n)), b.column(0), starts, sizes, [None] * n])
            row += n
        if n_waiting:
            yield blocks()

    # one table in two folders, kind=blocks and kind=docs
    rows.mapInArrow(code, _ROWS).write.partitionBy("kind").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): decoded from the store's files."""
    small_batches(spark)
    # two reads: cogrouped sides mustn't share columns of one plan
    blocks = spark.read.schema(_ROWS).parquet(path).filter("kind = 'blocks'").select("part", "run", "row", "payload")
    rows = spark.read.schema(_ROWS).parquet(path).filter("kind = 'docs'").select("part", "run", "row", "doc_id", "start", "n_tokens")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()     # one row a part
    before, base = {}, 0
    for r in totals:
        before[r.part] = base
        base += r.n

    def decode(key, coded, docs):
        import pyarrow as pa
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        docs, coded = docs.sort_by("row"), coded.sort_by("row")
        ids = range_coder.decode(coded.column("payload").to_pylist()).astype("<u4")
        starts, sizes = np.asarray(docs.column("start")), np.asarray(docs.column("n_tokens"))
        if len(ids) != int(sizes.sum()):
            raise ValueError("a run's blocks don't hold its documents' ids")
        raw, ends = ids.tobytes(), np.cumsum(sizes)
        packed = pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())
        first = before[key[0].as_py()]
        return pa.Table.from_arrays([docs.column("doc_id"), pa.array(starts + first), docs.column("n_tokens"), packed], schema=schema)

    return blocks.groupBy("part", "run").cogroup(rows.groupBy("part", "run")).applyInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store's documents."""
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
