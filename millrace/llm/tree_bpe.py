"""Byte-level BPE as a monoid: encode halves, join neighbours, decode up the same tree (operator 4).

Every text is halved until a part has at most LEAF_CHARS characters, and once at least. A node is a
stretch of text: where its segments (see segments.py) begin, and the ids of each. Two neighbours are
joined by encoding a window around their border anew: from the last segment of the left node that
nothing behind the border can change, segment by segment, until one begins where a segment of the
right node does. What follows such a cut depends on the text behind it alone, so from there on the
right node's ids stand, and so do those of the left node before the window. If the window ends
before, it is made four times as wide. The segments at a node's rims are left open until a join, or
the text's end, closes them.

Inside a segment longer than LEAF_BYTES the same holds for tokens. A sequence of tokens is the
encoding of its bytes exactly if each two neighbours are: their bytes, encoded together, give the two
again. (Merges go on within a token as they did alone as long as no merge crosses its borders, and
the first that did would do so with its two tokens alone.) A join encodes a window around the border
anew and takes it if its first and last token go with the tokens beyond; else it doubles the window.

Both joins are associative, as either result is the one encoding of the bytes joined. Segments that
were encoded before are remembered below the leaves.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import common
from .segments import SEGMENT, by_segment, segments

#: Parts of a text up to this many characters, and pieces of a segment up to this many bytes, are leaves.
LEAF_CHARS, LEAF_BYTES = 256, 32
#: Characters behind a border that a join looks at first, and ids that decoding looks up at once.
WINDOW, DECODED = 64, 256
#: Remembered segments and pieces in one Python worker; about 200 bytes each.
MEMORY = 1_000_000
#: The largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 << 20


class TreeBpe:
    """An encoder and decoder for a vocabulary of ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, memory: int = MEMORY):
        self.ranks, self.leaf_chars, self.leaf_bytes = ranks, leaf_chars, leaf_bytes
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        word = lambda s: pack(self.encode_bytes(s.encode()))
        self.known = by_segment(word, lambda s: b"".join(map(word, self.find(s))), memory)
        self.goes_with = lru_cache(1 << 17)(self._goes_with)
        self.joins = 0  # of nodes of texts, so far

    # bytes of one piece

    def merge(self, data: bytes) -> list[int]:
        """The plain rule: merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) > 128:
            return self.merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = ranks.get
        pairs = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same rule with a heap of pairs and a linked list of parts."""
        ranks, n = self.ranks, len(data)
        end, last, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop:
                continue
            live[j], end[i] = False, stop
            if stop < n:
                last[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := last[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one match. A match that is a token as a whole is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.node(data)

    def node(self, data: bytes) -> list[int]:
        """Encode both halves and join them."""
        n = len(data)
        if n > self.leaf_bytes:
            return self.join_tokens(self.node(data[: n >> 1]), self.node(data[n >> 1 :]))
        return self.merge(data)

    def _goes_with(self, left: int, right: int) -> bool:
        return self.merge(self.vocabulary[left] + self.vocabulary[right]) == [left, right]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if self.goes_with(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.vocabulary.__getitem__, left[a:] + right[:b])))
            if (not a or self.goes_with(left[a - 1], window[0])) and (b == len(right) or self.goes_with(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    # segments of a text

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as four bytes, lowest first."""
        n = len(text)
        if n < 2:
            return self.known[text]
        cuts, ids = self.join(text, self.tree(text, 0, n >> 1), n >> 1, self.tree(text, n >> 1, n), n)
        if None in ids:
            ends = [*cuts[1:], n]
            ids = [self.known[text[a:b]] if x is None else x for a, b, x in zip(cuts, ends, ids)]
        return b"".join(ids)

    def tree(self, text: str, start: int, end: int) -> tuple[list[int], list[bytes | None]]:
        """A node: where its segments begin and the ids of each, None for open ones at its rims."""
        if end - start > self.leaf_chars:
            middle = start + end >> 1
            return self.join(text, self.tree(text, start, middle), middle, self.tree(text, middle, end), end)
        parts, known = segments(text[start:end]), self.known
        if not parts[0]:
            del parts[0]
        ids = [known[x] for x in parts[1:-1]]
        cuts = list(accumulate(map(len, parts[:-1]), initial=start))
        first = [known[parts[0]] if not start and len(parts) > 1 else None]
        return cuts, first + ids + [None] if len(parts) > 1 else first

    def join(self, text: str, left: tuple, border: int, right: tuple, end: int) -> tuple[list[int], list[bytes | None]]:
        (a, x), (b, y), known = left, right, self.known
        self.joins += 1
        # The last segment of the left node ends at its border and may go on; all before stand,
        # but for one of white space, whose end depends on the character behind it.
        keep = len(a) - 1
        while keep > 0 and a[keep] >= border - 1:
            keep -= 1
        keep = max(keep - 1, 0)
        width = WINDOW
        while True:
            stop, at, j = min(border + width, end), a[keep], 0
            cuts, ids = [], []
            for part in SEGMENT.findall(text, at, stop):
                while j < len(b) and b[j] < at:
                    j += 1
                if j < len(b) and b[j] == at:
                    return a[:keep] + cuts + b[j:], x[:keep] + ids + y[j:]
                after = at + len(part)
                if after >= stop - 1 and stop < end:
                    break  # more text behind it could change this one
                cuts.append(at)
                ids.append(known[part] if after < end else None)
                at = after
            else:
                return a[:keep] + cuts, x[:keep] + ids
            width *= 4

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, joined pairwise up the tree; joins don't look at what they join."""
        numbers = memoryview(ids).cast("I") if struct.pack("=I", 1) == struct.pack("<I", 1) else struct.unpack(f"<{len(ids) // 4}I", ids)
        get, step = self.vocabulary.__getitem__, DECODED
        level = [b"".join(map(get, numbers[i : i + step])) for i in range(0, len(numbers), step)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_loaded: dict[tuple, TreeBpe] = {}


def loaded(data: bytes, pattern: str) -> TreeBpe:
    """One encoder for each vocabulary and Python worker, with what it remembers."""
    key = (sha256(data).digest(), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TreeBpe(read_ranks(data), pattern)
    return _loaded[key]


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes, too large to broadcast")
    return data


def with_ids(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """docs with the binary column `ids` (32-bit, little-endian) of each whole text, in place.

    Rows keep their columns, whatever their names; `ids` (and `decoded`, the bytes that the ids stand
    for) replace columns of those names. A null or empty text has no ids. Repeated rows are encoded
    each. With digests=True the columns `n_tokens`, `ids_sha256`, `decoded_sha256` come in place of
    the two binary ones. The vocabulary is read on the driver, at most VOCABULARY_BYTES, and broadcast.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    vocabulary = spark.sparkContext.broadcast(file_bytes(ranks_path))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    names = {f.name.lower() for f in added}
    kept = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(common.fresh(docs, "whole_text")[0]))
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() not in names] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value, pattern)
        for batch in batches:
            for part in _slices(batch):
                rows = [bpe.encode(x) if x else b"" for x in part.column(part.num_columns - 1).to_pylist()]
                if digests:
                    new = [pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([sha256(r).hexdigest() for r in rows]), pa.array([sha256(bpe.decode(r)).hexdigest() for r in rows])]
                else:
                    new = [pa.array(rows, pa.binary())] + ([pa.array([bpe.decode(r) for r in rows], pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns - 1)] + new, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def op4_tree_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
