"""Repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import suffixes

SF = "/root/testdata/sf0.001"


def covered(texts, length, first=False):
    """For each text which bytes go. first: texts are in order, each different, and a window's first place stays."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out, known = [], set()
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in known if first else seen[w] > 1:
                gone[i : i + length] = b"\1" * length
            known.add(w)
        out.append(gone)
    return out


def figures(t, gone):
    kept = bytes(x for x, g in zip(t, gone) if not g)
    return len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def told(rows):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows.collect())


def corpus(seed, n=60, size=300):
    """Texts with shared passages, rims, repeats within a text and copies, over few signs."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abé\n") for _ in range(k))
    shared = [word(r.randrange(5, 120)) for _ in range(6)]
    out = []
    for i in range(n):
        t = "".join(r.choice([word(r.randrange(40)), r.choice(shared)[r.randrange(4) :], r.choice(shared)]) for _ in range(r.randrange(1, size // 40)))
        if i % 9 == 3:
            t = out[r.randrange(len(out))]
        if i % 7 == 4:
            t = out[-1][: len(out[-1]) // 2] + "X" + out[-1][len(out[-1]) // 2 :]
        out.append(t)
    return out


def test_factors_by_force():
    r = random.Random(1)
    for _ in range(40):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 6))]
        data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts])
        end = np.repeat(np.cumsum(sizes), sizes)
        raw = data.tobytes()

        def longest(i, others):
            best = 0
            for j in others:
                k = 0
                while i + k < end[i] and j + k < end[j] and raw[i + k] == raw[j + k]:
                    k += 1
                best = max(best, k)
            return best

        for least in (1, 3, 9):
            before, after = suffixes.factors(data, end, least)
            want = [(longest(i, range(i)), longest(i, range(i + 1, len(raw)))) for i in range(len(raw))]
            assert [(int(a), int(b)) for a, b in zip(before, after)] == [(a if a >= least else 0, b if b >= least else 0) for a, b in want]


def test_windows_of_equal_strings_have_equal_grams():
    r = random.Random(2)
    for length in (2, 5, 8, 16, 31):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 90))) for _ in range(30)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        names, seen = defaultdict(set), Counter()
        for text, begin, end, gram in suffixes.runs_of(data, offsets, length):
            for t, b, e, g in zip(text, begin, end, gram):
                windows = [data[p : p + length].tobytes() for p in range(b, e)]
                assert len(set(windows)) == len(windows) and offsets[t] <= b < e <= offsets[t + 1] - length + 1
                for w in windows:
                    names[w].add(int(g))
                    seen[w] += 1
        assert all(len(x) == 1 for x in names.values())
        assert seen == Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))


@pytest.mark.parametrize("hot", [2048, 1])
def test_by_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PIECE", 500)
    for seed, length in ((1, 16), (2, 40)):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, begin int, Digest string").repartition(3)
        raw = [t.encode() for t in texts]
        want = Counter((i, *figures(t, g)) for i, (t, g) in enumerate(zip(raw, covered(raw, length))))
        assert told(suffixes.without_repeats(docs, length)) == want
        want = Counter((i, *figures(t, g)) for i, (t, g) in enumerate(zip(raw, covered(raw, length, True))))
        assert told(suffixes.without_repeats(docs, length, "first")) == want


def test_odd_rows(spark):
    r = random.Random(7)
    long = "".join(r.choice("lorem ipsum") for _ in range(60_000))
    rows = [(1, None), (2, ""), (None, "short"), (3, "x" * 400), (4, "y" * 399), (5, "y" * 399), (6, "z" * 401), (7, long), (8, long + "!"), (9, "q" * 398 + "é"), (9, "q" * 398 + "é"), (None, long[100:900]), (10, "a" + "b" * 398 + "é"), (11, "b" * 398 + "éa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = [(t or "").encode() for _, t in rows]
    want = Counter((i, *figures(t, g)) for (i, _), t, g in zip(rows, raw, covered(raw, 400)))
    assert told(suffixes.without_repeats(docs)) == want
    assert suffixes.without_repeats(docs.where("false")).count() == 0
    assert suffixes.without_repeats(docs.where("doc_id < 3")).where("n_removed = 0 and n_spans = 0").count() == 2
    first = {(r.doc_id, r.n_removed) for r in suffixes.without_repeats(docs, keep="first").collect()}
    assert {(None, 0), (7, 800), (8, 60_000), (6, 400), (9, 0)} <= first
    with pytest.raises(ValueError):
        suffixes.repeats(docs, keep="last")


def test_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    raw = [(r.text or "").encode() for r in rows]
    want = Counter((r.doc_id, *figures(t, g)) for r, t, g in zip(rows, raw, covered(raw, 400)))
    got = suffixes.op13_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == want and sum(x[2] for x in want) > 0
