"""Cutting a text where no token of a byte-level BPE with the usual pattern can cross.

The pattern takes an optional space with a run of letters, of digits or of other signs; white space
of more than one character ends one before a following word. So no match crosses from a non-space to
a space: ` ?\\S+` cuts a text more coarsely than the pattern and at some of the same places. Such a
segment is encoded once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACES}]"
SEGMENT = re.compile(f" ?[^{SPACES}]+|{SPACE}+(?![^{SPACES}])|{SPACE}+")
_AFTER_SPACE = [" " + c for c in SPACES] + ["\x00"]
_SPACE, _NONE = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_ASCII_AFTER_SPACE = [x for x in _AFTER_SPACE if x.isascii()]


def single_spaces(text: str) -> bool:
    """Whether all white space before a non-space is single spaces, so that each begins a segment."""
    return text[-1:] != " " and not any(pair in text for pair in (_ASCII_AFTER_SPACE if text.isascii() else _AFTER_SPACE))


def segments(text: str) -> list[str]:
    """The segments of a text, in order; joined they are the text. An empty first one is possible."""
    return text.replace(" ", "\x00 ").split("\x00") if single_spaces(text) else SEGMENT.findall(text)


def joined_ids(texts: list[str], known: Remembered) -> list[bytes]:
    """The ids of texts of single_spaces(): each word of them all is looked up once, the rest is gathering.

    Words are told apart in Arrow; `known` gives a segment's ids as 32-bit numbers.
    """
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    begin = words.offsets.to_numpy()
    coded = words.values.dictionary_encode()
    # strings are made at once; to_pylist() would make a scalar of each first
    spaced = pc.binary_join_element_wise(_NONE, coded.dictionary, _SPACE).to_numpy(zero_copy_only=False).tolist()
    entries = list(map(known.__getitem__, spaced))
    at = coded.indices.to_numpy().astype(np.int64)
    # a text's first word has no space before it
    at[begin[:-1]] = len(entries) + np.arange(len(texts))
    entries += [known[t.partition(" ")[0]] for t in texts]
    flat = np.frombuffer(b"".join(entries), "<u4")
    length = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
    first = np.cumsum(length) - length
    n = length[at]
    ends = np.cumsum(n)
    ids = flat[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]))]
    cut = np.concatenate([[0], ends])[begin].tolist()
    return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]


class Remembered(dict):
    """Text -> packed ids. A miss calls `encode`, which says whether the result is to be kept. Of more than
    `limit` entries the older half goes, but for those used since: a full memory becomes the old one,
    which is asked before `encode`."""

    def __init__(self, encode: Callable[[str], tuple[bytes, bool]], limit: int, longest: int = 64):
        super().__init__({"": b""})
        self.encode, self.half, self.longest, self.old = encode, limit // 2, longest, {}
        #: Entries put together of others; few are kept, as to put them together again costs little.
        self.composed = 0
    def keep(self, key: str, got: bytes) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
                self[""], self.composed = b"", 0
            self[key] = got

    def __missing__(self, key: str) -> bytes:
        got, keep = self.old.get(key), True
        if got is None:
            got, keep = self.encode(key)
        if keep:
            self.keep(key, got)
        return got

    def put_together(self, *parts: str) -> tuple[bytes, bool]:
        self.composed += 1
        return b"".join(map(self.__getitem__, parts)), self.composed < self.half // 4


#: ASCII characters that are neither letters, digits nor white space.
SIGNS = punctuation


def by_segment(word: Callable[[str], bytes], other: Callable[[str], bytes], limit: int) -> Remembered:
    """A memory of segments. `word` encodes an optional space with letters, `other` any other segment.

    Signs behind a letter up to the segment's end, and a single line break between non-spaces, are
    matches of their own: a segment with them is put together of what is known of its parts.
    """

    def encode(segment: str) -> tuple[bytes, bool]:
        if segment.isalpha() or segment[0] == " " and segment[1:].isalpha():
            return word(segment), True
        core = segment.rstrip(SIGNS)
        if core and len(core) < len(segment) and core[-1].isalpha():
            return known.put_together(core, segment[len(core) :])
        i = segment.find("\n")
        if 0 < i < len(segment) - 1 and not segment[i - 1].isspace() and not segment[i + 1].isspace():
            return known.put_together(segment[:i], "\n", segment[i + 1 :])
        return other(segment), True

    known = Remembered(encode, limit)
    return known
