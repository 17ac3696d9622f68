import os

from ballotlens.llm import common


def test_passing_tables_are_removed(spark):
    df = spark.range(5)
    with common.temporary(spark):
        a = common.stored(df, "a")
        with common.temporary(spark):
            b = common.stored(df, "b")
            kept = common.lasting(b, "kept")
        paths = [x.inputFiles()[0].removeprefix("file://") for x in (a, kept)]
        assert kept.count() == 5 and all(map(os.path.exists, paths))
    assert not any(map(os.path.exists, paths))
    c = common.lasting(df, "c")
    assert c.count() == 5


def test_slices_cover_texts_once():
    texts = ["a" * n for n in (0, 5, 3, 20, 0, 1, 9, 9)]
    got = list(common.slices(texts, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= 10 for a, b in got)
    assert list(common.slices([], 10)) == []


def test_vocabularies_are_forgotten():
    import gc
    import weakref

    import public_tokenizers

    from ballotlens.llm import bpe
    b = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    b.encode("some words to remember")
    seen = weakref.ref(b)
    del b
    common.forget_vocabularies()
    gc.collect()
    assert seen() is None and bpe.load.cache_info().currsize == 0
