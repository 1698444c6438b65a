"""Word hashes, bit maps and components against brute force."""

import numpy as np
import pytest

from veritext.llm import common


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_words_hash_alike_in_any_slice(monkeypatch, size):
    long_word = b"q" * 5000
    texts = [b"one two\tthree\x0bfour", None, b"", b"  ", "één zwei drei".encode(), long_word + b" x " + long_word + b"z", b"two ONE", b"tail"]
    want_h, want_n = common.hash_words(texts)
    monkeypatch.setattr(common, "_SLICE", size)
    got_h, got_n = common.hash_words(texts)
    assert (got_h == want_h).all() and got_n.tolist() == [len((t or b"").split()) for t in texts] == want_n.tolist()
    words = [w for t in texts for w in (t or b"").split()]
    same = {}
    for w, h in zip(words, got_h.tolist()):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    low = common.hash_words([b"ONE one \xc3\x89"], lower=True)[0]
    assert low[0] == low[1] != low[2]


def test_bitmap_misses_no_key(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) as key")
    has = common.Bitmap(spark, keys, "key").test()
    own = np.array([r.key for r in keys.collect()], dtype=np.int64)
    other = np.array([r.key for r in spark.range(5000, 8000).selectExpr("xxhash64(id) as key").collect()], dtype=np.int64)
    assert has(own).all() and has(other).mean() < 0.2
    assert not common.Bitmap(spark, keys.limit(0), "key").test()(own).any()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 20), (30, 30), (5, 40), (41, 40), (41, 42)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in common.connected_components(common.Scratch(spark, "t"), df, "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 20: 7, 5: 5, 40: 5, 41: 5, 42: 5}
    chain = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    assert {r.component for r in common.connected_components(common.Scratch(spark, "t"), chain, "t").collect()} == {0}
