import random
import re

import pytest

from ballotlens.llm import license_scan as ls
from ballotlens.llm import queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(s, label) for label, p in ls.PHRASES for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
    starts = [s for s, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_matching_statistics_as_definition():
    r = random.Random(1)
    for _ in range(60):
        seqs = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 9))] for _ in range(r.randint(1, 4))]
        auto = ls.Automaton(seqs)
        known = {tuple(s[i:j]): set() for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for t, s in enumerate(seqs):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    known[tuple(s[i:j])].add((t, j))
        text = [r.choice([b"a", b"b", b"c", b"x"]) for _ in range(60)]
        at = [i for i, w in enumerate(text) if w in auto.vocabulary]
        for i, n, state in auto.statistics(text, at):
            want = max(m for m in range(i + 2) if m == 0 or tuple(text[i + 1 - m:i + 1]) in known)
            assert n == want and auto.places[state] == known[tuple(text[i + 1 - n:i + 1])]


def test_fragments_as_definition():
    """Every match of a template that neither end can extend, templates within templates too."""
    r = random.Random(2)
    for _ in range(80):
        seqs = [" ".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 5))]
        seqs.append(seqs[0] + " " + seqs[-1])
        s = ls.Scanner(phrases=[], templates=[("x", t) for t in seqs], min_words=3)
        text = [r.choice([b"a", b"b", b"c", b"c", b"x"]) for _ in range(50)]
        want = set()
        for t, w in enumerate(s.words):
            for a in range(len(text)):
                for p in range(len(w)):
                    n = 0
                    while a + n < len(text) and p + n < len(w) and text[a + n] == w[p + n]:
                        n += 1
                    starts = a == 0 or p == 0 or text[a - 1] != w[p - 1]
                    if n and starts and (n >= 3 or n == len(w)):
                        want.add((t, a, a + n, p))
        assert set(s.fragments(text, [i for i, x in enumerate(text) if x in s.automaton.vocabulary])) == want


def test_finds_templates_with_gaps_and_edits():
    s = ls.Scanner()
    for label, t in (*ls.TEMPLATES, *ls.WHOLE_TEXTS):
        n, _, _, spans, score = s.scan(f"One two. {t.upper()}; three")[0], *s.scan(f"One two. {t.upper()}; three")[1:]
        assert any(x[0] == label and x[1] == 2 for x in spans) and score == 1
    t = ls.TEMPLATES[4][1].replace("free of charge", "totally free of charge").replace("person", "human")
    _, _, _, spans, score = s.scan("x " * 50 + t + " y" * 20)
    assert [x[0] for x in spans] == ["mit"] and 0.75 <= score < 1 and 49 <= spans[0][1] <= 51
    assert s.scan("the rights of any person to use this work as is")[3] == []


def test_whole_texts():
    """A whole licence with a name put in, reflowed and in part rewritten, is one find over its length."""
    s = ls.Scanner()
    for label, t in ls.WHOLE_TEXTS:
        words = re.findall(r"\S+", t)
        if len(words) < 60:
            continue
        r = random.Random(len(words))
        edited = words[:20] + ["Example", "Holders"] + [w if r.random() > 0.03 else "other" for w in words[20:]]
        spans = s.scan("A clean first line.\n" + "\n * ".join(edited) + "\nand code")[3]
        n = len(ls.words_of(t))
        whole = [x for x in spans if x[0] == label and x[2] - x[1] > 0.9 * n]
        assert whole and 0.75 <= max(x[3] for x in whole) < 1
    # half a text is no find of the whole; sentences of it that stand alone as templates are
    mit = dict(ls.WHOLE_TEXTS)["mit"]
    half = " ".join(mit.split()[:70])
    assert {x[0] for x in s.scan(half)[3]} == {"mit"} and all(x[2] - x[1] < 40 for x in s.scan(half)[3])


def test_templates_are_a_parameter(spark):
    got = ls.scan_documents(docs(spark, ["use it as you like it at home", "Released under the MIT License"]), templates=[("own", "use it as you like it")]).collect()
    assert {r.doc_id: r.labels for r in got} == {0: "own", 1: ""}


def test_long_and_repeated_texts():
    s = ls.Scanner()
    line = "Licensed under the Apache License, Version 2.0\n"
    n, starts, base, spans, score = s.scan(line * 2000 + "the of " * 50_000)
    assert n == 2000 * 8 + 100_000 and len(spans) == 2000 and not starts and not base and score == 1


def test_spark_awkward_rows(spark):
    texts = [None, "", "CC-BY cc by", "All rights reserved. ALL RIGHTS\nRESERVED", "GNU General Public License é", "cc  by" * 3, "ccby"]
    got = {r.doc_id: r for r in ls.scan_documents(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][1:6]) == brute_base(t)
        assert 0 <= got[i].score <= 1 and (got[i].score == 1 if got[i].n_base else True)
    assert ls.scan_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_base_as_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    got = queries.op5_license_scan(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:6]) == brute_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        for line, label in (("Apache License, Version 2.0", "apache-2.0"), ("Released under the MIT License", "mit"), ("CC BY-NC 4.0", "cc-by-nc-4.0")):
            assert (label in r.labels.split(",")) == (line in texts[r.doc_id])
