"""Texts within texts, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from millrace.functions import grams
from millrace.operators import search


def test_grams_and_windows():
    r = random.Random(3)
    texts = [bytes(r.choice(b"abc") for _ in range(r.randrange(0, 60))) for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for k in (1, 3, 8):
        h = grams.grams(data, k)
        names = {}
        for i in range(len(data) - k + 1):
            assert names.setdefault(data[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(names.values())) == len(names)
    starts, at, h = grams.window_grams(data, offsets, 16, 5)
    assert starts.tolist() == [o + i for o, t in zip(offsets, texts) for i in range(len(t) - 15)]
    inside = {}
    for s, a, x in zip(starts, at, h):
        assert inside.setdefault(data[s : s + 16].tobytes(), (a - s, x)) == (a - s, x) and 0 <= a - s <= 11
    values = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert grams.least(values, 3).tolist() == [3, 1, 1, 1] and grams.least(values, 1).tolist() == values.tolist()


@pytest.mark.parametrize("bits", [1 << 16, 1 << 10])
def test_by_force(spark, monkeypatch, bits):
    monkeypatch.setattr(search, "MOST_BITS", bits)
    monkeypatch.setattr(grams, "PIECE", 200)
    r = random.Random(bits)
    word = lambda n: "".join(r.choice("ab é") for _ in range(n))
    texts = [word(r.randrange(0, 400)) for _ in range(60)]
    texts += [texts[3], texts[4] + texts[5], "ab" * 300, None, "", "\U0001f600 end"]
    needles = [t[i : i + r.randrange(0, 300)] for t in texts if t for i in [r.randrange(len(t))]] + ["", None, "b", "ab" * 40, "ab" * 40, "nowhere at all in any text", "nowhere", "\U0001f600", "x" * 300]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)] + [(1, texts[1], 0, ""), (None, texts[2], 0, "")], "doc_id int, text string, k int, T string")
    rows = spark.createDataFrame([(f"n{i}", t, 1) for i, t in enumerate(needles)] + [(None, texts[7], 1)], "item string, text string, data int")
    got = Counter(map(tuple, search.containing_texts(docs, rows, "item").collect()))
    want = Counter((a.item, b.doc_id) for a in rows.collect() for b in docs.collect() if a.text is not None and b.text is not None and a.text in b.text)
    assert got == want and got[("n1", 1)] == 2


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (3, None)], "doc_id int, text string")
    needles = spark.createDataFrame([(7, "quick brown fox jumps"), (9, None)], "item_id int, text string")
    f = search.containing_texts
    assert f(docs, needles, "item_id").collect() == [(7, 1)]
    assert f(docs.where("false"), needles, "item_id").count() == f(docs, needles.where("false"), "item_id").count() == f(docs, needles.where("item_id = 9"), "item_id").count() == 0
    assert f(docs, needles, "item_id").columns == ["item_id", "doc_id"]


def test_equal_texts_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(search, "_named", lambda rows, windows, table=None, f=search._named: (table is not None and read.append(rows.count())) or f(rows, windows, table))
    docs = spark.createDataFrame([(1, "xx abc"), (2, "xx abc"), (3, "abd"), (4, None)], "doc_id long, text string")
    needles = spark.createDataFrame([("a", "abc"), ("b", "ab"), ("c", "")], "key string, text string")
    got = sorted(map(tuple, search.containing_texts(docs, needles, "key").collect()))
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 3)] and read == [2]
