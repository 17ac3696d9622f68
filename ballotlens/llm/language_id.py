"""Language identification by interpolated Kneser-Ney character models.

Fitting: a bounded sample of labelled documents (about ``sample_docs`` of each
language, those whose hash of doc_id and text lies below the share that its
count of different documents allows; repeated rows are one) is cut into
character 4-grams, which Spark counts for each language.  From the counts the
driver builds each language's interpolated Kneser-Ney model (lower orders from
continuation counts) and stores them as sorted arrays of packed n-grams with a
column of log probabilities for each language.  All n-grams of the sample stay:
its documents bound the model, which goes to every task.

Scoring: whole texts; letters lower-cased, whatever lies between them one
space.  Each position's 4-gram is looked up once for all languages by binary
search, and where no language knows it, its shorter ends are.  The language of
least cross-entropy per character wins, ties to the first name.

Rejection: a second, disjoint sample of each language, if there are documents
left for one (the first always goes to the counts), calibrates how far above
its mean a document's cross-entropy lies, in units that widen for short texts.
A document farther out than any of those (``LEAST_LIMIT`` units at least) by
the factor ``slack`` is rejected, as is one without a letter: ordinary
documents of a learned language stay.

Defined results: null, empty and letterless texts are ``und`` with score 0;
rows without lang or text teach nothing; with nothing to learn from, every
prediction is ``und``; languages that fit equally well go to the first name;
languages without a second document reject nothing but letterless texts;
repeated rows each give their row; extra columns stay in the row's struct,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, forget_vocabularies, slices, small_batches, stored, temporary, text_of

ORDER = 4
SAMPLE_DOCS = 400          # documents of a language that are counted, and as many that calibrate
SLACK = 1.5
LEAST_LIMIT = 8.0          # a sample of few documents shows too little of what is usual
LOOKED_UP = 1 << 18        # positions looked up at once
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of many texts as one array of 16-bit codes, and where each
    text starts.  Each text: three blanks, then its words with one blank after
    each.  Characters beyond the first plane share codes by their low bits."""
    joined = "\n".join(t.lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], np.int64) + 1
    starts = np.cumsum(lengths) - lengths
    letter = _letters()[code]
    blank_after = np.empty(len(code) + 1, bool)      # a letter before, none here
    blank_after[0] = False
    blank_after[1:] = letter
    blank_after[:-1] &= ~letter
    keep = letter.copy()
    keep |= blank_after[:-1]
    values = np.where(letter, code & 0xFFFF, 32).astype(np.uint16)[keep]
    before = np.concatenate(([0], np.cumsum(keep)))
    ends = np.minimum(starts + lengths, len(code))
    sizes = before[ends] - before[np.minimum(starts, len(code))]
    if len(code) and letter[-1]:
        values = np.append(values, np.uint16(32))
        sizes[-1] += 1
    sizes = np.maximum(sizes, 0) + ORDER - 1
    at = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 32, np.uint16)
    pad = (at[:, None] + np.arange(ORDER - 1)).ravel()
    body = np.ones(len(out), bool)
    body[pad] = False
    out[body] = values
    return out, at


def grams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of each text's characters, and where each text starts."""
    wide = codes.astype(np.uint64)
    g = wide[ORDER - 1:].copy()
    for k in range(1, ORDER):
        g |= wide[ORDER - 1 - k:len(wide) - k] << np.uint64(16 * k)
    ends = np.append(at[1:], len(codes))
    keep = np.ones(len(codes), bool)
    keep[(at[:, None] + np.arange(ORDER - 1)).ravel()] = False   # a gram ends at each character after the padding
    sizes = ends - at - (ORDER - 1)
    return g[keep[ORDER - 1:]], np.cumsum(sizes) - sizes


class Model:
    """Sorted n-gram arrays with log probabilities, a column a language."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        per = [_lower_orders(*counts[x]) for x in langs]
        self.grams, self.contexts, self.back = [], [], []
        for n in range(1, ORDER + 1):
            every = np.unique(np.concatenate([p[n - 1][0] for p in per])) if per else np.array([], np.uint64)
            self.grams.append(every)
            self.contexts.append(np.unique(every >> np.uint64(16)))
        vocab = max(1, len(self.grams[0])) + 1
        probs = []
        for n in range(1, ORDER + 1):
            every, contexts = self.grams[n - 1], self.contexts[n - 1]
            table, back = np.zeros((len(every), len(langs))), np.ones((max(1, len(contexts)), len(langs)))
            for col, p in enumerate(per):
                g, c = p[n - 1]
                disc = _discount(c)
                ctx, inv = np.unique(g >> np.uint64(16), return_inverse=True)
                total = np.bincount(inv, c, len(ctx))
                back[np.searchsorted(contexts, ctx), col] = disc * np.bincount(inv, minlength=len(ctx)) / total
                table[np.searchsorted(every, g), col] = (c - disc) / total[inv]
            lower = 1.0 / vocab if n == 1 else probs[-1][np.searchsorted(self.grams[n - 2], every & np.uint64((1 << (16 * (n - 1))) - 1))]
            table += back[np.searchsorted(contexts, every >> np.uint64(16))] * lower if len(every) else 0
            probs.append(table)
            self.back.append(np.log(back).astype(np.float32))
        self.logp = [np.log(t).astype(np.float32) for t in probs]
        self.none = (self.back[0][0] + np.float32(-np.log(vocab))).astype(np.float32)
        self.limits: dict[str, tuple[float, float, float, float]] = {}

    def look_up(self, g: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probabilities (a row each) of the last character of n-grams."""
        if n == 0:
            return np.broadcast_to(self.none, (len(g), len(self.langs)))
        known, mask = self.grams[n - 1], np.uint64((1 << (16 * (n - 1))) - 1)
        at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
        out = self.logp[n - 1][at] if len(known) else np.zeros((len(g), len(self.langs)), np.float32)
        missed = np.flatnonzero(known[at] != g) if len(known) else np.arange(len(g))
        if len(missed):
            rest = g[missed]
            low = np.array(self.look_up(rest & mask, n - 1))
            if n > 1:
                context, ctx = self.contexts[n - 1], rest >> np.uint64(16)
                c = np.minimum(np.searchsorted(context, ctx), len(context) - 1)
                low += np.where((context[c] == ctx)[:, None], self.back[n - 1][c], 0)
            out[missed] = low
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each text and language; characters counted."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in slices(texts):
            codes, at = fold(texts[a:b])
            g, starts = grams(codes, at)
            n[a:b] = np.diff(np.append(starts, len(g)))
            own = np.repeat(np.arange(b - a), n[a:b])
            for k in range(0, len(g), LOOKED_UP):
                logp, who = self.look_up(g[k:k + LOOKED_UP]), own[k:k + LOOKED_UP]
                for x in range(len(self.langs)):
                    total[a:b, x] -= np.bincount(who, logp[:, x], b - a)
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        if not self.langs:
            return [(UND, 0.0, True)] * len(texts)
        h, n = self.cross_entropy([t or "" for t in texts])
        best = h.argmin(axis=1)
        out = []
        for i, k in enumerate(best):
            if n[i] == 0:
                out.append((UND, 0.0, True))
                continue
            lead = np.minimum((h[i] - h[i, k]) * n[i], 700)
            mean, spread, per_char, worst = self.limits.get(self.langs[k], (0.0, 1.0, 0.0, np.inf))
            far = (h[i, k] - mean) / (spread + per_char / np.sqrt(n[i]))
            out.append((self.langs[k], float(1 / np.exp(-lead).sum()), bool(far > worst)))
        return out


def _lower_orders(g: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of 4-grams, and continuation counts of 1- to 3-grams."""
    out = [(g, c.astype(np.float64))]
    for n in range(ORDER - 1, 0, -1):
        types = out[0][0] & np.uint64((1 << (16 * n)) - 1)
        out.insert(0, tuple(np.unique(types, return_counts=True)))
    return [(x, y.astype(np.float64)) for x, y in out]


def _discount(c: np.ndarray) -> float:
    """Kneser-Ney discount from how many n-grams were seen once and twice."""
    one, two = float((c == 1).sum()), float((c == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def _sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """lang, text, part (0: count, 1: calibrate): about ``sample_docs`` documents
    of each language for either part.  What is kept follows from a document's
    own hash and two numbers a language, so no group of rows meets in a task."""
    hashed = docs.filter("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    langs = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least"))
    below = lambda docs: F.least(F.lit(float(docs)) / F.col("n"), F.lit(0.9999 * docs / (2 * sample_docs))) * 2.0**63
    cuts = stored(langs.select("lang", "least", below(sample_docs).cast("long").alias("count"), below(2 * sample_docs).cast("long").alias("most")), "cuts")
    chosen = hashed.join(cuts, "lang").filter("h <= most or h = least")
    return chosen.select("lang", "text", "h", F.when((F.col("h") <= F.col("count")) | (F.col("h") == F.col("least")), 0).otherwise(1).alias("part")).dropDuplicates(["lang", "h"]).drop("h")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, slack: float = SLACK,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The languages' models from labelled rows, with calibrated limits."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    with temporary(docs.sparkSession):
        return _fit(stored(_sample(rows, sample_docs), "sample"), slack)


def _fit(sample: DataFrame, slack: float) -> Model:
    def count(batches):
        import pyarrow as pa
        forget_vocabularies()
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1).to_pylist()
            for x in sorted(set(langs)):
                codes, at = fold([t for t, y in zip(texts, langs, strict=True) if y == x])
                g, c = np.unique(grams(codes, at)[0], return_counts=True)
                yield arrays_to_batch(schema, [[x] * len(g), g.view(np.int64), c])

    counted = (sample.filter("part = 0").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = counted.toArrow()
    lang, gram, n = (table.column(k) for k in range(3))
    gram, n = np.asarray(gram).view(np.uint64), np.asarray(n)
    names = np.array(lang.to_pylist(), object)
    langs, counts = sorted(set(names)), {}
    for x in langs:
        own = np.flatnonzero(names == x)
        own = own[np.argsort(gram[own])]
        counts[x] = gram[own], n[own]
    model = Model(langs, counts)
    if langs:
        _calibrate(model, sample.filter("part = 1").select("lang", "text"), slack)
    return model


def _calibrate(model: Model, sample: DataFrame, slack: float) -> None:
    def measure(batches):
        import pyarrow as pa
        schema = pa.schema([("lang", pa.string()), ("h", pa.float64()), ("n", pa.int64())])
        for b in batches:
            h, n = model.cross_entropy(b.column(1).to_pylist())
            names = b.column(0).to_pylist()
            k = [model.langs.index(x) if x in model.langs else -1 for x in names]
            ok = [i for i in range(len(names)) if k[i] >= 0 and n[i]]
            yield arrays_to_batch(schema, [[names[i] for i in ok], [h[i, k[i]] for i in ok], [n[i] for i in ok]])

    found = sample.mapInArrow(measure, "lang string, h double, n long")
    by = Window.partitionBy("lang")
    # the sample is bounded, and so are its groups
    dev = (found.withColumn("mean", F.avg("h").over(by)).withColumn("per_char", F.sqrt(F.avg(F.pow(F.col("h") - F.col("mean"), 2) * F.col("n")).over(by)))
           .withColumn("spread", F.greatest(F.percentile_approx(F.abs(F.col("h") - F.col("mean")), 0.5).over(by), F.lit(0.01))))
    far = (F.col("h") - F.col("mean")) / (F.col("spread") + F.col("per_char") / F.sqrt("n"))
    for r in dev.groupBy("lang").agg(*(F.first(c).alias(c) for c in ("mean", "spread", "per_char")), F.max(far).alias("worst")).collect():
        model.limits[r["lang"]] = (r["mean"], r["spread"], r["per_char"], max(LEAST_LIMIT, r["worst"]) * slack)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row struct of all of docs' columns, lang_pred, score, rejected) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)    # bounded by the sample
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_of(docs, text_col).alias("text"))

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def score(text: pa.Array) -> pa.Array:
        forget_vocabularies()
        lang, sure, out = zip(*sent.value.predict(text.to_pylist())) if len(text) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(out, pa.bool_())], ["lang_pred", "score", "rejected"])

    return rows.select("row", score("text").alias("p")).select("row", "p.lang_pred", "p.score", "p.rejected")
