"""Exact duplicates by composable polynomial fingerprints.

1. A text's fingerprint is sum((byte + 1) * base^position), modulo four primes
   below 2^31.  Fingerprints compose: that of a text is the sum of its chunks'
   own, each shifted by base^(bytes before it).  Texts of more than one chunk
   are dealt out chunk by chunk, so that many tasks hash one huge document,
   and the chunks' terms add up in a grouped sum.
2. Rows group by (fingerprint, bytes); counts, the greatest doc_id and its row
   combine before the shuffle, so a text that a third of all rows hold costs
   one row a map task.
3. Texts whose fingerprint occurs more than once are compared chunk by chunk:
   the least and the greatest bytes of each (fingerprint, chunk) have to be the
   same.  Both are streamed through a grouped minimum and maximum, which holds
   two chunks of a group at a time and combines copies before the shuffle.
   Where they differ, unlike texts share a fingerprint: these rows are grouped
   by their SHA-256 as well.  The fingerprints that repeat are joined by Spark's
   choice, whatever their number.

Defined results: null counts as the empty text, and empty texts are equal; of
equal texts the row of the greatest doc_id stays (one without an id only if
none has one); of repeated rows of that id exactly one; texts of any length
are read whole; extra columns go no further; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.llm.common import lasting, small_batches, stored, temporary, text_of

# The greatest primes below 2^31 and a base for each
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1812433253, 1566083941, 1664525)
CHUNK = 1 << 16             # bytes; a sum of so many (byte + 1) * 31 bits fits 64 bits
NO_ID = -(2**63)            # stands for a null doc_id where ids are compared
PRINT = ["f1", "f2", "n_bytes"]
_TERMS = "h1 long, h2 long, h3 long, h4 long"


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """base^i modulo each prime, for every place of a chunk."""
    out = np.ones((len(PRIMES), CHUNK), np.uint64)
    for row, base, p in zip(out, BASES, PRIMES, strict=True):
        n = 1
        while n < CHUNK:
            row[n:2 * n] = row[:n] * np.uint64(pow(base, n, p)) % np.uint64(p)
            n *= 2
    return out


def terms(data: bytes, before: int = 0) -> list[int]:
    """The fingerprint of ``data``, shifted by the bytes ``before`` it."""
    whole, out = np.frombuffer(data, np.uint8), [0] * len(PRIMES)
    for start in range(0, len(whole), CHUNK):
        part = whole[start:start + CHUNK].astype(np.uint64) + np.uint64(1)
        sums = _powers()[:, :len(part)] @ part
        out = [(t + int(s) % p * pow(b, before + start, p)) % p for t, s, p, b in zip(out, sums, PRIMES, BASES, strict=True)]
    return out


def hashed(piece: Column, before: Column) -> Column:
    """Struct of the four terms of a piece of bytes."""
    @F.arrow_udf(_TERMS)
    def run(piece: pa.Array, before: pa.Array) -> pa.Array:
        rows = [terms(x, n) for x, n in zip(piece.to_pylist(), before.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(PRIMES))], ["h1", "h2", "h3", "h4"])

    return run(piece, before)


def _packed(h: Callable[[int], Column]) -> list[Column]:
    return [F.shiftleft(h(0), 31).bitwiseOR(h(1)).alias("f1"), F.shiftleft(h(2), 31).bitwiseOR(h(3)).alias("f2")]


def _named(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column]) -> DataFrame:
    text = normalise(text_of(docs, text_col))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.cast("binary").alias("body"), F.sha2(text, 256).alias("text_sha256"),
                       F.octet_length(text).cast("long").alias("n_bytes"))


def short_prints(named: DataFrame, chunk: int) -> DataFrame:
    """Texts of one chunk with their fingerprints, each where it is read."""
    short = named.filter(F.col("n_bytes") <= chunk).withColumn("h", hashed(F.col("body"), F.lit(0).cast("long")))
    return short.select("doc_id", "text_sha256", "n_bytes", "body", *_packed(lambda i: F.col("h")[f"h{i + 1}"]))


def long_pieces(named: DataFrame, chunk: int) -> DataFrame:
    """Longer texts as chunks, dealt to tasks one by one and hashed there."""
    rows = named.filter(F.col("n_bytes") > chunk).withColumn("rid", -1 - F.monotonically_increasing_id())
    n = F.ceil(F.col("n_bytes") / F.lit(chunk)).cast("int")
    pieces = (rows.withColumn("number", F.explode(F.sequence(F.lit(0), n - 1)))
              .select("rid", "doc_id", "text_sha256", "n_bytes", "number", F.substring("body", F.col("number") * chunk + 1, F.lit(chunk)).alias("piece")))
    dealt = pieces.repartition("rid", "number")
    return dealt.withColumn("h", hashed(F.col("piece"), F.col("number").cast("long") * chunk)).select("*", "h.*").drop("h")


def unlike(pieces: DataFrame) -> DataFrame:
    """Fingerprints that stand for more than one text; ``pieces`` have
    (f1, f2, n_bytes, number, piece).

    The grouping names the first key anew: Spark then deals pieces out once more
    after the join before, combines copies first and may split a hot group there.
    """
    least = (pieces.withColumn("g1", F.negative("f1")).groupBy("g1", "f2", "n_bytes", "number")
             .agg(F.min("piece").alias("least"), F.max("piece").alias("most")))
    return least.filter(F.col("least") != F.col("most")).select(F.negative("g1").alias("f1"), "f2", "n_bytes").distinct()


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return (rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"),
                                    F.max_by("rid", F.coalesce("doc_id", F.lit(NO_ID))).alias("keep_rid")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     normalise: Callable[[Column], Column] = lambda text: text, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of
    ``docs``; ``normalise`` maps the text column to the text that is compared."""
    spark = docs.sparkSession
    small_batches(spark)
    named = _named(docs, id_col, text_col, normalise)
    with temporary(spark):
        pieces = stored(long_pieces(named, chunk), "pieces")
        whole = (pieces.groupBy("rid", "doc_id", "text_sha256", "n_bytes")
                 .agg(*(F.sum(f"h{i + 1}").alias(f"s{i}") for i in range(len(PRIMES))))
                 .select("rid", "doc_id", "text_sha256", "n_bytes", *_packed(lambda i: F.col(f"s{i}") % PRIMES[i])))
        short = short_prints(named, chunk)
        rows = lasting(short.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text_sha256", *PRINT).unionByName(whole), "prints")
        repeated = lasting(_groups(rows, PRINT).filter("group_size > 1"), "repeated")
        again = repeated.select(*PRINT)
        in_short = short.join(again.filter(F.col("n_bytes") <= chunk), PRINT, "left_semi").select(*PRINT, F.lit(0).alias("number"), F.col("body").alias("piece"))
        long_again = rows.filter(F.col("n_bytes") > chunk).join(again, PRINT, "left_semi").select("rid", "f1", "f2")
        in_long = pieces.select("rid", "n_bytes", "number", "piece").join(long_again, "rid").select(*PRINT, "number", "piece")
        mixed = lasting(unlike(in_short.unionByName(in_long)), "unlike")
    # fingerprints of several texts: their rows are told apart by digest
    tagged = (rows.join(mixed.withColumn("apart", F.lit(True)), PRINT, "left")
              .withColumn("tag", F.when(F.col("apart"), F.col("text_sha256")).otherwise("")).drop("apart"))
    apart = _groups(rows.join(mixed, PRINT, "left_semi"), [*PRINT, "text_sha256"]).withColumnRenamed("text_sha256", "tag")
    groups = repeated.join(mixed, PRINT, "left_anti").withColumn("tag", F.lit("")).unionByName(apart)
    out = tagged.join(groups, [*PRINT, "tag"], "left")
    alone = F.col("group_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of repeated rows of
    the id that stays, which differ in other columns only, the least by them."""
    keep = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    columns = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), docs[id_col].cast("long").alias("_id"), F.sha2(text_of(docs, text_col), 256).alias("_sha"))
    same = rows["_id"].eqNullSafe(keep["_id"]) & (rows["_sha"] == keep["_sha"])
    return rows.join(keep, same, "left_semi").groupBy("_id", "_sha").agg(F.min("row").alias("row")).select("row.*")
