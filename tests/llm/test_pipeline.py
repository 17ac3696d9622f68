import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ballotlens.llm import decontamination as dc
from ballotlens.llm import language_id as li
from ballotlens.llm import queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty
from test_lines import brute
from test_minhash import classes
from test_search import least_distance


def contaminated(text, items):
    """Brute force, with plain dynamic programming only where five words meet."""
    c = dc.canonical(text or "")
    words = set(zip(*(c.split()[k:] for k in range(3))))
    for item in items:
        if item in c:
            return True
        if words & set(zip(*(item.split()[k:] for k in range(3)))) and least_distance(item, c) <= int(0.05 * len(item)):
            return True
    return False


def test_run_as_brute_force(spark):
    rows = [r.asDict() for r in queries.documents(spark, SF_SMALL).collect()]
    items = [dc.canonical(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in rows}
    df = queries.documents(spark, SF_SMALL)
    rejected = {r.row.doc_id for r in li.predict(df, li.fit(df.filter(~queries.held_out(df)))).collect() if r.rejected}
    assert len(rejected) <= 2
    kept = {i: t for i, t in kept.items() if i not in rejected}
    cut = brute(list(kept.values()), list(kept), 10, True)
    kept = {i: t for i, t in cut.items() if t.strip() or t == kept[i]}
    first = classes(list(kept.values()), list(kept))
    kept = {i: t for i, t in kept.items() if first[i] == i}
    kept = {i: t for i, t in kept.items() if not contaminated(t, items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in cp.run(spark, SF_SMALL).collect()}
    assert got == {i: (library.encode(t, add_special_tokens=False).ids, t) for i, t in kept.items()}


def test_stages_return_the_columns_of_documents(spark):
    texts = [None, "", "1 2 3", *["the cat sat on the mat and the dog " + "abcdefgh"[i % 8] * (i + 1) for i in range(25)], "same line\nown words here"]
    texts += ["same line"] * 11
    df = docs(spark, texts, ["en"] * len(texts))
    same = df.unionByName(df)
    for name, stage in cp.STAGES[:-1]:
        for d in (same, empty(spark)):
            assert stage(spark, d, SF_SMALL).columns == d.columns, name
        assert stage(spark, empty(spark), SF_SMALL).count() == 0, name
    left = {r.doc_id: r for r in cp.lines(spark, df, SF_SMALL).collect()}
    assert left[28].text == "same line\nown words here" and left[28].n_chars == 24 and not set(range(29, 40)) & set(left)
    assert left[0].text is None and left[1].text == ""
    near = [r.doc_id for r in cp.near_duplicates(spark, same, SF_SMALL).collect()]
    assert len(near) == len(set(near)) and set(range(29, 40)) & set(near) == {29}


def test_unlike_documents_of_one_id_or_none_stay(spark):
    rows = [(None, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(20)), i) for i in range(9)] + [(3, "a b c d e f g", 9), (3, "h i j k l m n", 10), (3, "A b c d e f g", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = cp.near_duplicates(spark, df.unionByName(df), SF_SMALL).collect()
    assert sorted(r.n for r in got if r.n not in (9, 11)) == [*range(9), 10] and sum(r.n in (9, 11) for r in got) == 1


def test_clean_documents_stay(spark):
    """The first stage and the fourth leave ordinary documents alone."""
    df = queries.documents(spark, SF_MID)
    assert cp.language(spark, df, SF_MID).count() >= 0.995 * df.count()
    items = [dc.canonical(r.text) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in df.collect()} - {r.doc_id for r in cp.decontaminate(spark, df, SF_MID).collect()}
    hold = {r.doc_id for r in df.collect() if any(i in dc.canonical(r.text) for i in items)}
    assert hold <= gone and len(gone) <= len(hold) + 20
