"""The pipeline against brute force, and the SQL of the queries that have one."""

from __future__ import annotations

import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from millrace.llm import common, mixing, queries, rules
from oracle import difference
from test_operators import all_spans, components_by_force, measured, water, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert difference(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def passes(text):
    n, chars, signs, dup, repeat, lines = measured(text)
    return not (n < 50 or 100 * repeat > 50 * n or chars < 2 * n or chars > 14 * n or 10 * signs > 3 * n or 100 * dup > 50 * lines)


def redacted(text):
    out, at = "", 0
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in all_spans(text)):
        if a > at or not at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def place(doc_id, text):
    """The built-in 64-bit hash of (doc_id, hash of text), its lower half."""
    inner = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<Q", inner), seed=xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)) & 0xFFFFFFFF


def mixed(docs):
    """(doc_id, text, source) -> copies of each, by walking each source's fine buckets in order."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    goal, out = water(dict(sizes)), {}
    width = (1 << 32) // mixing.COARSE // mixing.FINE
    for s in sizes:
        whole = int(goal[s] // sizes[s]) if sizes[s] else 0
        budget, threshold, upto = goal[s] - whole * sizes[s], 0, 0
        buckets = defaultdict(int)
        for d, t, x in docs:
            if x == s:
                buckets[place(d, t) // width] += len(words(t))
        for b in sorted(buckets):
            if upto + buckets[b] > budget:
                threshold = (b + (upto + buckets[b] - budget < budget - upto)) * width
                break
            upto += buckets[b]
        for d, t, x in docs:
            if x == s:
                out[d] = whole + (place(d, t) < threshold)
    return out


def by_tiktoken():
    """A text's ids as the tiktoken library gives them, little-endian."""
    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    return lambda text: (lambda ids: struct.pack(f"<{len(ids)}I", *ids))(plain.encode_ordinary(text))


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = [d for d in docs if passes(d[1])]
    first = {d: c for d, _, c in components_by_force([d[:2] for d in kept])}
    kept = [(d, redacted(t), s) for d, t, s in kept if first[d] == d]
    copies, encode = mixed(kept), by_tiktoken()
    want = Counter()
    for d, t, s in kept:
        ids = encode(t)
        want[(d, s, len(ids) // 4, hashlib.sha256(ids).hexdigest())] += copies[d]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "source", "n_tokens", "ids_sha256").collect())
    assert got == +want and len(got) > 20


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, copies without an id, columns of clashing names."""
    rng = random.Random(7)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    base, alone, secret = some(80), some(70), some(60) + ' password = "hunter2hunter2" ' + some(60)
    near = base.replace(base.split()[40], "changed")
    rows = [
        (1, base, "en", "a", 1), (2, near, "en", "a", 1), (2, near, "en", "a", 1), (None, base, "en", "b", None), (None, alone, None, None, 1), (None, alone + " tail", None, None, 1),
        (3, secret, "de", "b", 1), (4, None, None, "a", None), (5, "", "en", "a", 0), (6, "too short", "en", "a", 9), (7, some(60_000), "en", "c", 1), (8, some(90), None, None, None),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, failed int, key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, out, str(tmp_path)), name)
        seen.append(Counter((r["doc_id"], r["text"]) for r in out.collect()) if "text" in out.columns else None)
    assert seen[0] == Counter((d, t) for d, t, *_ in rows if passes(t or ""))
    assert {(d, t) for d, t in seen[1] if d is not None} == {(1, base), (3, secret), (7, rows[10][1]), (8, rows[11][1])} and sum(n for (d, _), n in seen[1].items() if d is None) == 1
    assert seen[2] == Counter({(d, redacted(t)): n for (d, t), n in seen[1].items()}) and "[secret]" in "".join(t for _, t in seen[2])
    assert set(seen[3]) <= set(seen[2]) and all(n <= 3 * seen[2][k] for k, n in seen[3].items())
    encode = by_tiktoken()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == Counter({(d, hashlib.sha256(encode(t)).hexdigest()): n for (d, t), n in seen[3].items()})
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "secret_scans", "mixing_sources", "byte_bpe"]
    assert set(rules.POLICIES) == {1, 2}
