import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ballotlens.llm import common, queries, token_store, word_ids
from ballotlens.llm import range_coder as rc
from conftest import SF_SMALL
from helpers import empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 13000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 65536, n), r.zipf(1.3, n) % 50257, np.zeros(n, int), np.resize(r.integers(0, 50257, 37), n), np.full(n, 65535)):
        blocks = rc.encode(ids)
        assert (rc.decode(blocks) == ids).all() and len(blocks) == -(-n // rc.BLOCK_IDS)
        if blocks:   # each block stands alone
            assert (rc.decode(blocks[-1:]) == ids[(len(blocks) - 1) * rc.BLOCK_IDS:]).all()


def test_coder_learns_and_notices_damage():
    ids = np.resize(np.arange(300) * 131 % 50257, 4096)
    block = rc.encode(ids)[0]
    assert len(block) < 0.3 * 2 * len(ids)
    for at in (3, 10, 40):
        with pytest.raises(ValueError):
            rc.decode([block[:at] + bytes([block[at] ^ 1]) + block[at + 1:]])
    for wrong in (-1, 1 << 24):
        with pytest.raises(ValueError):
            rc.encode(np.array([wrong]))


@pytest.mark.parametrize("n", [1, 4097, 9000])
def test_coder_ids_over_two_bytes(n):
    r = np.random.default_rng(n)
    wide = [r.integers(0, 1 << 24, n), r.zipf(1.3, n) % 200_000, np.full(n, (1 << 24) - 1), np.resize(r.integers(0, 150_000, 37), n)]
    for ids in wide:
        assert (rc.decode(rc.encode(ids)) == ids).all()
    narrow = r.integers(0, 50257, n)          # blocks of both widths side by side
    assert (rc.decode(rc.encode(wide[0]) + rc.encode(narrow)) == np.concatenate((wide[0], narrow))).all()


def test_order_zero_is_in_the_mix(monkeypatch):
    """A candidate that is frequent in the block is believed sooner."""
    r = np.random.default_rng(5)
    common, rare = r.integers(0, 4, 8000), r.integers(0, 50257, 8000)
    ids = np.where(r.random(8000) < 0.9, common, rare)
    with_zero = sum(map(len, rc.encode(ids)))
    monkeypatch.setattr(rc, "_LOG", np.zeros_like(rc._LOG))
    assert with_zero < sum(map(len, rc.encode(ids)))


def test_lanes_of_a_block_share_its_model(monkeypatch):
    """Few steps code many ids, and a lane knows what another one has seen."""
    r = np.random.default_rng(8)
    ids = np.concatenate([r.permutation(np.resize(r.integers(0, 50257, 2000), 1 << 14))] * 16)
    steps, look = [], rc._Model.look
    monkeypatch.setattr(rc._Model, "look", lambda self: steps.append(1) or look(self))
    blocks = rc.encode(ids)
    assert len(steps) <= 512 and sum(map(len, blocks)) < 1.6 * len(ids)
    assert (rc.decode(blocks) == ids).all() and len(steps) <= 1024


def test_words_as_library(monkeypatch):
    """Texts of many kinds of neighbours; words are looked up, not encoded again."""
    r, library = random.Random(3), Tokenizer.from_file(PATH)
    texts = ["".join(r.choice("  \n\t'''strevdmlA9é,.\0\xa0\x85²ª") for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["", "\0", "a\0", "'s", "'", "x'", " 's", "'ll're", "a" * 40, "\0" * 20, "", "漢字 it's", "x<|endoftext|>y", " the word" * 300]
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    asked = []
    own = word_ids.WordIds(lambda w: asked.append(w) or token_store._library(PATH).encode_ordinary(w))
    monkeypatch.setattr(token_store, "_words", lambda path: own)
    assert [ids.tolist() for ids in token_store.ids_of_texts(texts, PATH, 2)] == want
    assert asked.count(" word") == 1
    before = len(asked)
    assert [ids.tolist() for ids in token_store.ids_of_texts(texts, PATH, 2)] == want
    assert sum(len(w) <= word_ids.SHORT for w in asked[before:]) < before / 100       # two may share both places
    monkeypatch.setattr(word_ids, "PLACES", 4)        # words push each other out
    monkeypatch.setattr(word_ids, "KEPT_IDS", 50)
    own.forget()
    for k in range(0, len(texts), 100):
        assert [ids.tolist() for ids in token_store.ids_of_texts(texts[k:k + 100], PATH, 2)] == want[k:k + 100]
    monkeypatch.setattr(word_ids, "LONG_TEXT", 5)
    assert [ids.tolist() for ids in token_store.ids_of_texts(texts, PATH, 2)] == want


def want(rows, library):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return r[1]


@pytest.mark.parametrize("parts", [1, 7])
def test_store_as_library(spark, monkeypatch, parts):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "one", "one", "漢字 Ᲊ ΟΔΟΣ", "x<|endoftext|>y", "very long " * 5000, *("text %d here" % i for i in range(40))]
    rows = [(997 - 31 * i % 997, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "b"), (5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as row", "3 as kind", "4 as start")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = common.shared_path(spark, "store")
        token_store.write(df, path, PATH)
        got = sorted((tuple(r) for r in token_store.checksums(spark, path).collect()), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == want(rows, library)


def test_empty_store_and_query(spark):
    path = common.shared_path(spark, "store")
    token_store.write(empty(spark), path, PATH)
    assert token_store.checksums(spark, path).count() == 0
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF_SMALL).collect()]
    got = sorted((tuple(r) for r in queries.op7_token_store(spark, SF_SMALL).collect()), key=key)
    assert got == want(rows, Tokenizer.from_file(PATH))


def test_hot_ids_are_split(spark):
    """Most rows share an id, or have none, or are equal: parts and runs stay
    small, and the order is that of the whole table."""
    rows = [(7, f"text {i:03d} of one id") for i in range(120)] + [(None, f"text {i:03d} without one") for i in range(60)]
    rows += [(7, "text 500 often")] * 60 + [(3, "first"), (9, "last " * 400), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = common.shared_path(spark, "store")
    token_store.write(df, path, PATH, part_bytes=300, run_ids=40)
    stored = spark.read.parquet(path)
    per_part = [r.n for r in stored.filter("kind = 'docs'").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()]
    runs = stored.filter("kind = 'docs'").groupBy("part", "run").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
    assert len(per_part) > 8 and sorted(per_part)[-2] < sum(per_part) / 4
    assert all(r.n <= 40 or r.docs == 1 for r in runs) and max(r.n for r in runs) > 400
    got = sorted((tuple(r) for r in token_store.checksums(spark, path).collect()), key=key)
    assert got == want(rows, Tokenizer.from_file(PATH))
