import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ballotlens.llm import language_id as li
from ballotlens.llm import queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty


def brute_log_prob(text_counts, vocab_grams, context, char):
    """Interpolated Kneser-Ney of the last character, straight from the definition."""
    def table(n):
        if n == li.ORDER:
            return text_counts
        longer = table(n + 1)
        return Counter(g[1:] for g in longer)
    def prob(n, ctx, c):
        if n == 0:
            return 1.0 / (vocab_grams + 1)
        t = table(n)
        disc = li._discount(np.array(list(t.values()), float))
        h = ctx[len(ctx) - n + 1:] if n > 1 else ""
        total = sum(v for g, v in t.items() if g[:-1] == h)
        lower = prob(n - 1, ctx, c)
        if not total:
            return lower
        kinds = sum(1 for g in t if g[:-1] == h)
        return max(t.get(h + c, 0) - disc, 0) / total + disc * kinds / total * lower
    return math.log(prob(li.ORDER, context, char))


def fit_local(texts):
    counts = {}
    for x, ts in texts.items():
        counts[x] = np.unique(li.grams(*li.fold(ts))[0], return_counts=True)
    return li.Model(sorted(texts), counts)


def test_fold_words_and_pads():
    codes, at = li.fold(["Ab, c!", "", "9", "é"])
    parts = ["".join(map(chr, codes[a:b])) for a, b in zip(at, [*at[1:], len(codes)])]
    assert parts == ["   ab c ", "   ", "   ", "   é "]


def test_model_as_definition():
    texts = {"x": ["abra cadabra", "bad cab"], "y": ["zap abba zip", "a"]}
    m = fit_local(texts)
    vocab = len({c for ts in texts.values() for t in ts for c in t + " "})
    for k, lang in enumerate(m.langs):
        counts = Counter()
        for t in texts[lang]:
            s = "   " + t + " "
            counts.update(s[i:i + 4] for i in range(len(s) - 3))
        for probe in ["abra zap q", "cadabra", "zzz", "é"]:
            s = "   " + probe + " "
            want = -sum(brute_log_prob(counts, vocab, s[i:i + 3], s[i + 3]) for i in range(len(s) - 3)) / (len(s) - 3)
            h, n = m.cross_entropy(["other", probe, ""])
            assert n.tolist()[1:] == [len(s) - 3, 0]
            assert abs(h[1, k] - want) < 1e-4


def test_awkward_rows(spark):
    texts = [None, "", "1 2 ...", "the cat and the dog " * 5, "la maison et le chat " * 5, "the cat " * 20_000, "漢字🙂xq" * 60] + ["the dog sat on the mat", "le chien et la table"] * 10
    langs = [None, "en", "en", None, None, None, None] + ["en", "fr"] * 10
    df = docs(spark, texts, langs)
    m = li.fit(df)
    got = {r.row.doc_id: r for r in li.predict(df.unionByName(df), m).collect()}
    assert m.langs == ["en", "fr"]
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "fr", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].rejected for i in range(3))
    assert got[6].rejected and got[6].lang_pred in m.langs
    none = li.fit(empty(spark))
    assert {r.lang_pred for r in li.predict(df, none).collect()} == {"und"}
    assert li.predict(empty(spark), m).count() == 0


def test_held_out_accuracy(spark):
    out = queries.op8_language_id(spark, SF_MID).join(queries.documents(spark, SF_MID).select("doc_id", "lang"), "doc_id")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("rejected").cast("int")).alias("r"),
                F.avg(F.when(F.col("held_out"), (F.col("lang") == F.col("lang_pred")).cast("int"))).alias("h")).first()
    assert r.a > 0.99 and r.h > 0.99 and r.r < 0.002, r


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_sample_is_bounded_whatever_ids_repeat(spark):
    unlike = rows_of(spark, [(None, f"text {i:05d}", "en") for i in range(4000)])
    parts = [r.part for r in li._sample(unlike, 10).collect()]
    assert 5 <= len(parts) <= 50 and {0, 1} == set(parts)
    alike = rows_of(spark, [(None, "same text", "en")] * 3000 + [(1, "une phrase", "fr")])
    assert sorted((r.lang, r.part) for r in li._sample(alike, 10).collect()) == [("en", 0), ("fr", 0)]
    few = rows_of(spark, [(i, f"text {i}", "en") for i in range(20)])
    assert li._sample(few, 400).count() == 20
    assert sorted(tuple(r) for r in li._sample(unlike.repartition(7), 10).collect()) == sorted(tuple(r) for r in li._sample(unlike, 10).collect())


def test_languages_of_one_document_are_learned(spark):
    rows = [(i, (chr(97 + i) + chr(98 + i)) * 30, f"l{i:02d}") for i in range(20)]
    m = li.fit(rows_of(spark, rows))
    assert m.langs == [x for _, _, x in rows]
    got = {r.row.doc_id: (r.lang_pred, r.rejected) for r in li.predict(rows_of(spark, rows), m).collect()}
    assert got == {i: (x, False) for i, _, x in rows}


def test_ties_go_to_the_first_name(spark):
    m = li.fit(rows_of(spark, [(1, "abc abd", "y"), (2, "abc abd", "x"), (3, "abc abd", "z")]))
    assert [p[0] for p in m.predict(["abc", "abd abc"])] == ["x", "x"]


def test_query_as_a_model_counted_in_plain_python(spark):
    """The query's predictions against a model from plain counts of its sample."""
    df = queries.documents(spark, SF_SMALL)
    texts = {}
    for r in li._sample(df.filter(~queries.held_out(df)).select("doc_id", "text", "lang"), li.SAMPLE_DOCS).filter("part = 0").collect():
        texts.setdefault(r.lang, []).append(r.text)
    plain = fit_local(texts)
    rows = df.collect()
    want = {r.doc_id: p[:2] for r, p in zip(rows, plain.predict([r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op8_language_id(spark, SF_SMALL).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
