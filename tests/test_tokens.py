"""Token counts as the library gives them for whole texts."""

from __future__ import annotations

import pytest

from millrace.operators import tokens

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")
ODD = [None, "", " ", "a", "x" * 5000, "  two  spaces \n\n and\tlines ", "é ß \U0001f600 中文 العربية", "<|endoftext|>", "a <|endoftext|> b <|endoftext|>", "<|STARTOFTEXT|> it's IT'S 'll", "the " * 3000, "123 4567 8.9 #!?"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("known", [1 << 15, 3])
def test_as_the_library_counts(spark, monkeypatch, name, known):
    monkeypatch.setattr(tokens, "KNOWN", known)
    whole = T.Tokenizer.from_file(P.path(name))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect() if known == 3 else []
    rows = [(r.doc_id, r.text, "k") for r in docs] + [(-i, t, "k") for i, t in enumerate(ODD)] + [(-3, "a", "k"), (None, "a", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Digest_ string").repartition(3)
    got = tokens.token_counts(df, P.path(name))
    assert got.columns == ["doc_id", "text", "Digest_", "n_tokens"]
    want = sorted((str(i), t, None if t is None else len(whole.encode(t, add_special_tokens=False).ids)) for i, t, _ in rows if t is not None)
    found = got.collect()
    assert sorted((str(r.doc_id), r.text, r.n_tokens) for r in found if r.text is not None) == want and [r.n_tokens for r in found if r.text is None] == [None]
    assert tokens.token_counts(df.where("false"), P.path(name)).count() == 0
