import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ballotlens.llm import bpe, queries, token_counts
from conftest import SF_SMALL
from helpers import docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'RE", "é", "ß", "1", "23", "ab", "the", " the", "ing", "...", "!", "Ᲊ", "漢字",
          "<|endoftext|>", "\t", "İ", "՘", "🙂", "́", "Σ", "ΟΔΟΣ ", "\x85", "\x1c"]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def made(seed, n, pieces=PIECES):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_texts_as_library(library):
    b = bpe.load(PATH)
    for t in made(1, 500):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(b.encode(t)) == want, repr(t)
        assert b.decode(b.encode(t)).decode() == library.decode(want, skip_special_tokens=False)


def test_long_words_as_library(library):
    b, r = bpe.load(PATH), random.Random(2)
    for _ in range(100):
        t = r.choice(["a", "ab", "the", "aab"]) * r.randint(1, 200) + "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 300)))
        assert ids(b.encode(t)) == library.encode(t, add_special_tokens=False).ids
        assert b.merge_long([b.byte_id[x] for x in t.encode()]) == ids(b.encode(t))


def test_leaves_cut_anywhere(library):
    b, r = bpe.load(PATH), random.Random(3)
    plain = [p for p in PIECES if p != "<|endoftext|>"]
    for t in made(4, 400, plain) + made(5, 200, ["a", "the", "ing", "é"]):
        if t:
            n = r.randint(1, 25)
            level = [b.encode_leaf(t[k:k + n]) for k in range(0, len(t), n)]
            while len(level) > 1:
                level = [b.join_leaves(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            assert ids(b"".join(level[0].ids)) == library.encode(t, add_special_tokens=False).ids, (t, n)


def test_remembered_results_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 3)
    b = bpe.ByteBpe(PATH)
    for t in made(6, 50):
        assert ids(b.encode(t)) == library.encode(t, add_special_tokens=False).ids
    assert max(len(b.kept), len(b.windows), len(b.kept.before)) <= 3


def test_spark_short_and_long(spark, library):
    texts = [None, "", "one two", "one two", "x" * 300, "a<|endoftext|>b " * 40, "the end of it " * 50] + made(7, 30)
    df = docs(spark, texts)
    df = df.unionByName(df.filter("doc_id = 5"))
    for leaf in (7, 10**6):
        got = sorted(((r.doc_id, r.n_tokens, ids(r.ids), r.decoded) for r in bpe.round_trip(df, PATH, leaf_chars=leaf).collect()), key=lambda r: r[0])
        want = []
        for i, t in enumerate(texts):
            e = library.encode(t or "", add_special_tokens=False).ids
            want += [(i, len(e), e, t or "")] * (2 if i == 5 else 1)
        assert got == want
    enc = bpe.encode_documents(df, PATH, leaf_chars=20)
    assert {r.decoded for r in bpe.decode_documents(enc, PATH).collect()} == {t or "" for t in texts}
    assert bpe.round_trip(empty(spark), PATH).count() == 0
    assert token_counts.count_tokens(empty(spark), WORDS).count() == 0


def test_counts_as_library(spark):
    library = Tokenizer.from_file(WORDS)
    c = token_counts.load(WORDS)
    for t in made(8, 800):
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    texts = [None, "", "abc " * 3000, "z" * 5000, "<|endoftext|> Ä"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs(spark, texts), WORDS, limit=2999).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2999)


def test_queries_as_library(spark, library):
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF_SMALL).collect()}
    for r in queries.op1_bpe_round_trip(spark, SF_SMALL).collect():
        e = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    words = Tokenizer.from_file(WORDS)
    for r in queries.op3_token_counts(spark, SF_SMALL).collect():
        assert r.n_tokens == len(words.encode(texts[r.doc_id], add_special_tokens=False).ids)
