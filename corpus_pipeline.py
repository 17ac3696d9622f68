"""A corpus pipeline of the training-data operators over ``documents``.

STAGES are applied in order; each stage's result is written as Parquet under
the shared checkpoint folder and read again as the next one's ``docs``.  Every
stage works on all rows that its predecessor kept:

1. language: documents that the language models reject go (no letters, or
   farther from every learned language than any calibration document);
2. lines: of a line found in 10 or more documents only the first occurrence
   stays; documents that lose all their text that way go;
3. near_duplicates: of each class the document of least doc_id stays (one
   without an id only if none has one);
4. decontamination: documents that hold a benchmark item go;
5. bpe: ids of what is left, and the text decoded from them.

Stages 1 to 4 return the columns of ``documents`` (and any others that the
table has); ``n_chars`` follows a changed text.  Null texts count as empty:
the first stage rejects them.  Rows that share doc_id and text are one
document, of which stage 3 keeps one row, the least by all columns; unlike texts of one id, or without
an id, are documents of their own there.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.llm import bpe, decontamination, language_id, line_dedup, minhash
from ballotlens.llm.common import drop_stored, shared_path, temporary
from ballotlens.llm.queries import held_out, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.filter(~held_out(docs)))
    return language_id.predict(docs, model).filter(~F.col("rejected")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True)
    out = line_dedup.apply_bitmaps(docs, bitmaps).filter((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = minhash.first_documents(docs, threshold=0.8)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *minhash.document_key(docs))
    return rows.groupBy(*minhash.KEY).agg(F.min("row").alias("row")).join(first, minhash.KEY, "left_semi").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontaminate), ("bpe", encode)]

#: SQL can't express the language models, edit matching or the encoding; the
#: tests compare run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the stages' tables only the last one's input stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            drop_stored(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
