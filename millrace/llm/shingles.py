"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once.

A word's hash is a polynomial in its bytes' random numbers, read off running sums over a block of
text, then mixed. A shingle's is a mixed sum of its words' hashes with a factor for each place. Two
different shingles agree by chance with probability about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
BLOCK_BYTES = 1 << 20
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
_LETTER = _mixed((_LOWER + _U(1)) * _U(0x9E3779B97F4A7C15))
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_PLACE = _mixed(np.arange(1, WORDS + 2, dtype=np.uint64) * _U(0x2545F4914F6CDD1D)) | _U(1)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, and where each begins. `starts`: where texts begin in it."""
    word = ~_BLANK[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < len(raw))]
    first[inner] = word[inner]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] |= word[inner - 1]
    end = np.flatnonzero(last) + 1
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=sums[1:])
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def _long(data: bytes) -> np.ndarray:
    """Word hashes of one long text, by blocks that end at blanks."""
    out, at = [], 0
    while at < len(data):
        stop = at + BLOCK_BYTES
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        out.append(word_hashes(np.frombuffer(data[at:stop], np.uint8), np.zeros(1, np.int64))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n >= WORDS:
        total = words[: n - WORDS + 1] * _PLACE[0]
        for k in range(1, WORDS):
            total = total + words[k : n - WORDS + 1 + k] * _PLACE[k]
    elif n:
        total = (words * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _U(n) * _PLACE[WORDS]
    else:
        return words
    x = np.sort(_mixed(total))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles: of WORDS words, or all words of a shorter text; A-Z count as a-z."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size + len(texts[j] or b"") <= BLOCK_BYTES):
            size += len(texts[j] or b"")
            j += 1
        if j == i:
            yield _set(_long(texts[i]))
            i += 1
            continue
        block = [t or b"" for t in texts[i:j]]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in block])])
        hashes, begin = word_hashes(np.frombuffer(b"".join(block), np.uint8), starts[:-1])
        cut = np.searchsorted(begin, starts)
        for k in range(len(block)):
            yield _set(hashes[cut[k] : cut[k + 1]])
        i = j
