"""Exact token counts: each task encodes the segments that it meets once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..shared import ship, spread

#: Segments that a task keeps with their counts: as many, of so many characters at most (so some 20 MB).
KNOWN, KNOWN_CHARS = 1 << 17, 32


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Segments:
    """A text's segments as the tokenizer's model gets them, counted; None for a text that holds an added token, which parts it otherwise."""

    def __init__(self, path: str):
        self.whole = _tokenizer(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def of(self, text: str) -> Counter | None:
        own = self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text
        if any(a in text or a in own for a in self.added):
            return None
        return Counter(s for s, _ in self.whole.pre_tokenizer.pre_tokenize_str(own)) if self.whole.pre_tokenizer else Counter([own] if own else [])


def token_counts(rows: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """rows with the number of tokens of each text, as the tokenizer file's library counts them without special tokens; null for a null text.

    Texts are cut to segments by the tokenizer's own rules, once each. A task keeps the counts of segments that it
    has met, so frequent ones are encoded once, and what it keeps is bounded; nothing but rows is shuffled,
    which are dealt to all cores first. A text that holds an added token is encoded whole.
    """
    ship(rows.sparkSession)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segments = _Segments(path)
        model, known = segments.whole.model, {}

        def size(s: str) -> int:
            n = known.get(s)
            if n is None:
                n = len(model.tokenize(s))
                if len(s) <= KNOWN_CHARS and len(known) < KNOWN:
                    known[s] = n
            return n

        def tokens(data: str | None) -> int | None:
            if data is None:
                return None
            found = segments.of(data)
            return len(segments.whole.encode(data, add_special_tokens=False).ids) if found is None else sum(size(s) * k for s, k in found.items())

        for batch in batches:
            yield pd.Series([tokens(t) for t in batch], dtype="Int64")

    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != out.lower()]
    return spread(rows).select(*kept, F.pandas_udf(counted, "long")(F.col(f"`{text}`")).alias(out))
