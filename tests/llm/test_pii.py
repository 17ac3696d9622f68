import hashlib
import random
import re

import pytest

from ballotlens.llm import pii, queries
from conftest import SF_MID, SF_SMALL
from helpers import docs, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_sum(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and check_sum(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_as_plain_patterns():
    r = random.Random(1)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", " ", "1", "255", "300", "0007", "4111 1111 1111 1111", "+49 (0)30 1234-567", "+", "é", "_", "%", "12.1.1.9", "\n", "(", ")"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a." * 100_000 + "@", "@" * 200_000, "+1" * 100_000, "1." * 100_000, "a1=" * 100_000, "1 " * 100_000, "a_at_" * 60_000, "(at)" * 60_000, "+((" * 60_000):
        spans = pii.base_spans(t)
        pii.candidates(t, spans)


def test_candidates_and_patterns():
    t = 'see key="ab12c9", tel: 555-0123-77 x@y.org at 7'
    base = pii.base_spans(t)
    assert [t[a:b] for a, b in pii.candidates(t, base)] == ["ab12c9", "555-0123-77"]
    assert pii.patterns(t, t.index("555")) == ["tel: _", 'key="ab00c0", tel: _']
    assert pii.patterns(t, t.index("ab12")) == ['see key="']


def made():
    """Phones after 'call me', some of them without a plus; other numbers after 'code'."""
    r = random.Random(2)
    texts = [f"word {i} call me +49 30 {r.randint(10**6, 10**7)} bye" for i in range(20)]
    texts += [f"word call me 0{r.randint(10**9, 10**10)} bye" for _ in range(4)]
    texts += [f"the code {r.randint(10**7, 10**8)} and the code q{r.randint(10**5, 10**6)}x" for _ in range(30)]
    return texts


def test_contexts_extract_unseen_identifiers(spark):
    texts = [*made(), None, "", "call me 12345", "call me password9", "call me 030-1234567", "a" * 100_000 + " call me 030/987654321"]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in pii.find_pii(df.unionByName(df.filter("doc_id = 0"))).collect()}
    n = len(made())
    for i, t in enumerate(texts):
        base = plain(t or "")
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        new = set(got[i].spans.split(",")) - set(got[i].base.split(",")) - {""}
        if 20 <= i < 24 or i in (n + 4, n + 5):
            start = t.index("call me ") + 8
            end = t.index(" bye") if "bye" in t else len(t)
            assert new == {f"phone:{start}:{end}"}
        else:
            assert not new
    assert pii.find_pii(df.unionByName(df)).count() == 2 * len(texts)
    assert pii.find_pii(empty(spark)).count() == 0


def reliability(seen, rounds):
    """The graph scores, straight from their definition."""
    edges, kinds, fit = {}, {}, {}
    for r in seen:
        for s in r["seen"]:
            for p in s["pattern"]:
                edges.setdefault(p, set()).add(s["value"])
                if s["kind"]:
                    kinds[p, s["value"]] = max(s["kind"], kinds.get((p, s["value"]), ""))
                fit[p, s["value"]] = max(s["suits"], fit.get((p, s["value"]), []))
    score: dict = {}
    for k in range(rounds):
        out = {}
        for p, values in edges.items():
            for kind in pii.KINDS:
                mass = sum(1.0 if kinds.get((p, v)) == kind else score.get((v, kind), 0.0) if (p, v) not in kinds and kind in fit[p, v] else 0.0 for v in values)
                if mass:
                    out[p, kind] = mass / (len(values) + pii.SMOOTHING)
        score = {}
        for (p, kind), x in out.items():
            if x >= 0.5:
                for v in edges[p]:
                    if (p, v) not in kinds and kind in fit[p, v]:
                        score[v, kind] = 1 - (1 - score.get((v, kind), 0.0)) * (1 - min(x, 0.999))
    return out


def test_scores_as_definition(spark):
    seen = pii.read_spans(docs(spark, made()))
    want = reliability([r.asDict(recursive=True) for r in seen.collect()], 3)
    got = pii.reliable_patterns(seen, 3, min_reliability=0.0)
    assert {round(r.reliability, 9) for r in got.collect()} == {round(max(x for (q, _), x in want.items() if q == p), 9) for p, _ in want}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_base_as_plain_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    got = queries.op4_personal_data(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_candidates_with_blanks_and_at_marks():
    cases = {"call (020) 7946 001 now": ["(020) 7946 001"], "card 4111 1111 1111 1112.": ["4111 1111 1111 1112"], "phone 555 123 4567": ["555 123 4567"],
             "john [at] example.com": ["john [at] example.com"], "mail john_at_example.com!": ["john_at_example.com"], "mail a.b(at)x-y.org, or": ["a.b(at)x-y.org"],
             "tel=(030) 12-34 x": ["(030) 12-34"], "12  34  567": [], "x12 34 567": [], "in 1999 and 2001": [], "at [at] 5": [], "a@b": ["a@b"], "12 34 567x": ["567x"][:0],
             "4111 1111 1111 1111 and 555 123 4567": ["555 123 4567"], "1 2\n3 4 5 6": ["3 4 5 6"], "joe@x.org [at] y.com 12345": ["12345"]}
    for text, want in cases.items():
        assert [text[a:b] for a, b in pii.candidates(text, pii.base_spans(text))] == want, text


def planted():
    """Contexts learned from seeds, and identifiers of other forms in them."""
    r = random.Random(3)
    texts = [f"note {i} reach me on +49 30 {r.randint(10**6, 10**7)} soon" for i in range(25)]
    texts += [f"note {i} write to user{i}x@mail{i}.example.org soon" for i in range(25)]
    hidden = {"phone": ["reach me on (020) 7946 001 soon", "reach me on 555 123 4567 soon"],
              "email": ["write to john [at] example.com soon", "write to mary_at_example.org soon", "write to jim(at)example.net soon"]}
    return texts, hidden


def test_planted_identifiers_are_found(spark):
    texts, hidden = planted()
    flat = [(k, t) for k, ts in hidden.items() for t in ts]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, texts + [t for _, t in flat])).collect()}
    for i, (kind, t) in enumerate(flat, len(texts)):
        head = "reach me on " if kind == "phone" else "write to "
        assert got[i] == f"{kind}:{len(head)}:{t.index(' soon')}", t


def brute_spans(texts):
    """The whole operator in plain Python, from its own parts' definitions."""
    seen = []
    for t in texts:
        base = pii.base_spans(t)
        own = [{"kind": k, "value": t[a:b].lower(), "suits": [k], "pattern": pii.patterns(t, a), "at": (a, b)} for a, b, k in base]
        own += [{"kind": None, "value": t[a:b].lower(), "suits": [k for k in pii.KINDS if pii.suits(k, t[a:b])], "pattern": pii.patterns(t, a), "at": (a, b)} for a, b in pii.candidates(t, base)]
        seen.append({"seen": own})
    best = {}
    for (p, kind), x in reliability(seen, pii.ROUNDS).items():
        if x >= pii.MIN_RELIABILITY and (p not in best or (-x, kind) < (-best[p][0], best[p][1])):
            best[p] = (x, kind)
    out = []
    for row in seen:
        spans = []
        for s in row["seen"]:
            found = [best[p] for p in s["pattern"] if p in best and best[p][1] in s["suits"]] if s["kind"] is None else [(1, s["kind"])]
            if found:
                spans.append((s["at"][0], pii.KINDS.index(max(found)[1]), s["at"][1]))
        out.append(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    return out


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_spans_as_brute_force(spark, sf):
    rows = queries.documents(spark, sf).collect()
    want = {r.doc_id: s for r, s in zip(rows, brute_spans([r.text or "" for r in rows]), strict=True)}
    assert {r.doc_id: r.spans for r in queries.op4_personal_data(spark, sf).collect()} == want


def test_passing_tables_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("ballotlens.llm.common.ensure_checkpoint_dir", lambda s: str(tmp_path))
    pii.find_pii(docs(spark, made())).count()
    assert len([p for p in tmp_path.iterdir() if not p.name.startswith("code")]) == 2      # what its result reads
