"""Token ids in directly addressable codes, written as binary files and read back (operator 2).

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level 1 the next
chunk of the ids that have one, and so on. A bitmap beside each level says which ids go on, and a
rank directory (ones before every 512th bit) finds the place of the next chunk by one table look-up
and at most 64 bytes of counting. So any id is read without decoding those around it.

A file holds ids of documents in ascending doc_id order:

    blocks        "DAC1", ids (u32), levels (u32); for each level: chunks (u32), the chunks,
                  and, but for the last, the bitmap and its directory (u32 each)
    block table   for each block: byte offset (u64), first id (u64)
    index         doc ids (i64), null flags (u8), first ids of documents (u64)
    footer        blocks (u64), documents (u64), ids (u64), offset of the block table (u64), "DACEND01"

All numbers are little-endian.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import common
from .segments import by_segment, joined_ids, segments, single_spaces
from .tree_bpe import file_bytes

#: Ids in one block: bounds the memory of a writer and a reader.
BLOCK_IDS = 1 << 20
CHUNK_BITS, RANK_BITS = 8, 512
#: Characters that are encoded at a time, but for one longer text.
ENCODE_CHARS = 8 << 20
FOOTER = struct.Struct("<4Q8s")
END = b"DACEND01"


def encode_block(ids: np.ndarray) -> bytes:
    """One block of up to BLOCK_IDS ids (uint32)."""
    levels, rest = [], ids.astype("<u4")
    while True:
        goes_on = rest >> CHUNK_BITS > 0
        chunks = (rest & 0xFF).astype(np.uint8)
        if not goes_on.any():
            levels.append((chunks, None))
            break
        levels.append((chunks, goes_on))
        rest = rest[goes_on] >> CHUNK_BITS
    out = [b"DAC1", struct.pack("<2I", len(ids), len(levels))]
    for chunks, goes_on in levels:
        out += [struct.pack("<I", len(chunks)), chunks.tobytes()]
        if goes_on is not None:
            bits = np.packbits(goes_on, bitorder="little")
            per = np.add.reduceat(goes_on.astype(np.uint32), np.arange(0, len(goes_on), RANK_BITS))
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4").tobytes()]
    return b"".join(out)


class Block:
    """A block's bytes, addressed without decoding."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a block of directly addressable codes")
        self.n, levels = struct.unpack_from("<2I", data, 4)
        at, self.levels = 12, []
        for k in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            at += 4 + n
            bits = ranks = None
            if k + 1 < levels:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", -(-n // RANK_BITS), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """The id at place i: one chunk and one rank for each level it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            first = i // RANK_BITS * RANK_BITS >> 3
            head = int.from_bytes(bits[first : i >> 3].tobytes(), "little").bit_count()
            i = int(ranks[i // RANK_BITS]) + head + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
            shift += CHUNK_BITS
        return value

    def all(self) -> np.ndarray:
        """All ids, from the last level up."""
        above = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            if bits is not None:
                ids[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= above << CHUNK_BITS
            above = ids
        return above


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS):
        self.stream, self.block_ids, self.at = stream, block_ids, 0
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.table, self.docs, self.nulls, self.starts = [], [], [], []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as little-endian 32-bit numbers."""
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        first = self.n_ids - self.n_waiting
        while len(ids) >= self.block_ids or last and len(ids):
            now, ids = ids[: self.block_ids], ids[self.block_ids :]
            self.table.append((self.at, first))
            self._put(encode_block(now))
            first += len(now)
        self.waiting, self.n_waiting = [ids.tobytes()], len(ids)

    def close(self) -> None:
        self._flush(True)
        table_at = self.at
        self._put(np.array(self.table, "<u8").tobytes())
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.starts, "<u8").tobytes())
        self._put(FOOTER.pack(len(self.table), len(self.docs), self.n_ids, table_at, END))


class Reader:
    """Reads one file through a seekable stream of `size` bytes; holds its index and one block."""

    def __init__(self, stream, size: int):
        self.stream = stream
        blocks, docs, self.n_ids, self.table_at, end = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if end != END:
            raise ValueError("the file has no whole footer")
        self.table = np.frombuffer(self._read(self.table_at, 16 * blocks), "<u8").reshape(-1, 2)
        at = self.table_at + 16 * blocks
        self.docs = np.frombuffer(self._read(at, 8 * docs), "<i8")
        self.nulls = np.frombuffer(self._read(at + 8 * docs, docs), "u1")
        self.starts = np.frombuffer(self._read(at + 9 * docs, 8 * docs), "<u8")
        self._block = (-1, None)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return bytes(self.stream.read(n))

    def block(self, k: int) -> Block:
        if self._block[0] != k:
            end = int(self.table[k + 1, 0]) if k + 1 < len(self.table) else self.table_at
            self._block = (k, Block(self._read(int(self.table[k, 0]), end - int(self.table[k, 0]))))
        return self._block[1]

    def token(self, i: int) -> int:
        """The id at place i of the file."""
        k = int(np.searchsorted(self.table[:, 1], i, "right")) - 1
        return self.block(k)[i - int(self.table[k, 1])]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first place and ids, in the file's order, block by block."""
        k, held, first = 0, np.zeros(0, np.uint32), 0
        ends = [*self.starts[1:].tolist(), self.n_ids]
        for doc, null, start, end in zip(self.docs.tolist(), self.nulls.tolist(), self.starts.tolist(), ends):
            if first + len(held) < end:
                parts = [held[start - first :]]
                first, have = start, len(parts[0])
                while first + have < end:
                    parts.append(self.block(k).all())
                    have += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield None if null else doc, start, held[start - first : end - first]


def cuts_at_segments(config: dict) -> bool:
    """Whether a tokenizer (its file's content) gives a text's ids as those of its segments, one after the other.

    So it is for byte-level BPE with the usual pattern, whose matches don't cross a segment's border,
    if nothing changes the text before, adds ids after or chooses by chance, and added tokens take
    what they stand for and nothing around it.
    """
    split, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    still = not any(config.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "unk_token"))
    exact = not any(t.get(k) for t in config.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and still and whole and exact


def library_encoder(tokenizer_json: str, memory: int = 1_000_000, added: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Texts to packed ids by the tokenizers library.

    Strings of special tokens are ordinary text or, if `added`, the added tokens, as in the library's
    default call: they cut the text before the pattern does. A tokenizer that cuts_at_segments() sees
    each distinct segment once: a word, which the pattern doesn't cut, goes to its model at once, in
    the letters that stand for its bytes, any other segment to the whole tokenizer. Any other
    tokenizer is given whole texts.
    """
    from tokenizers import Tokenizer

    config = json.loads(tokenizer_json)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = not added
    if not cuts_at_segments(config):
        return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    # The byte-level alphabet: printable characters of Latin-1 stand for themselves, other bytes for 256 and up.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: b for b in own} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in own)}
    plain = Tokenizer.from_str(tokenizer_json)
    plain.encode_special_tokens = True
    tokenize, blank = plain.model.tokenize, chr(letters[ord(" ")])
    pack = [struct.Struct(f"<{n}I").pack for n in range(65)]

    def word(s: str) -> bytes:
        # an ASCII letter stands for itself
        ids = [x.id for x in tokenize(blank + s[1:] if s[0] == " " and s.isascii() else s if s.isascii() else s.encode().decode("latin-1").translate(letters))]
        return pack[len(ids)](*ids) if len(ids) <= 64 else struct.pack(f"<{len(ids)}I", *ids)

    other = lambda s: np.array(plain.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    known = by_segment(word, other, memory)
    ordinary = lambda text: b"".join(map(known.__getitem__, segments(text)))
    ids = {t["content"]: struct.pack("<I", t["id"]) for t in config.get("added_tokens") or [] if t["content"] and added}
    cut = re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None

    def encode(text: str) -> bytes:
        out, at = [], 0
        for m in cut.finditer(text) if cut else ():
            out += [ordinary(text[at : m.start()]), ids[m[0]]]
            at = m.end()
        return b"".join([*out, ordinary(text[at:])])

    def every(texts: list[str]) -> list[bytes]:
        simple = [k for k, t in enumerate(texts) if t and single_spaces(t) and not any(x in t for x in ids)]
        done = dict(zip(simple, joined_ids([texts[k] for k in simple], known))) if simple else {}
        return [done[k] if k in done else encode(t) for k, t in enumerate(texts)]

    return every


_encoders: dict[tuple[int, bool], Callable[[list[str]], list[bytes]]] = {}


#: Schemes of file systems that both Arrow and Spark open, with Arrow's name for each.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark, folder: str) -> str:
    """A folder as a URI that Arrow opens. One without a scheme lies in Spark's default file system.

    Spark alone can open some others, such as viewfs; they are refused before anything is written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme, _, rest = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().partition(":")
    if scheme not in SCHEMES:
        raise ValueError(f"token files can't be written under {folder}: Arrow has no file system for {scheme}")
    return f"{SCHEMES[scheme]}://{rest.removeprefix('//')}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clear(uri: str) -> None:
    """Remove what attempts that failed have left."""
    from pyarrow import fs

    files, base = _filesystem(uri)
    for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith(".part-"):
            files.delete_file(f.path)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of some batches at a time: the more texts, the fewer words are looked up again."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            docs += some.column(0).to_pylist()
            texts += (new := some.column(1).to_pylist())
            held += sum(map(len, new))
            if held >= ENCODE_CHARS or len(docs) >= 1 << 16:
                yield docs, texts
                docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, added: bool = True) -> DataFrame:
    """Encode every whole text, append end_id, write ids to files under `folder` in ascending doc_id order.

    Returns the written files: part, path, n_docs, n_tokens (with end ids), first_token (of all ids
    before the file). Strings of added tokens in a text stand for these, or are ordinary text if `added` is false. A null or empty text has only its end id. Null doc_ids come first, rows of one
    doc_id in order of their texts' hashes; repeated rows are each written. An empty table gives no files.
    A file appears under its name only when whole, so a task run again replaces it by the same bytes;
    what failed attempts leave is removed. Ranges are bounded by a sample of ids and texts' hashes.
    `folder` must be in a file system that Arrow opens, see qualified(), and executors share.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    folder = qualified(spark, folder)
    tokenizer = spark.sparkContext.broadcast(file_bytes(tokenizer_path))
    wanted = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash")]
    ordered = wanted.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    schema = "part int, path string, n_docs long, n_tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        data = tokenizer.value
        if (key := (zlib.crc32(data), added)) not in _encoders:
            _encoders.clear()
            _encoders[key] = library_encoder(data.decode(), added=added)
        encode, end = _encoders[key], struct.pack("<I", end_id)
        context = TaskContext.get()
        part = context.partitionId()
        path, own = f"{base}/part-{part:06d}.dac", f"{base}/.part-{part:06d}.{context.taskAttemptId()}"
        writer = stream = None
        try:
            for docs, texts in _together(batches):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    stream = files.open_output_stream(own)
                    writer = Writer(stream)
                for doc, ids in zip(docs, encode(texts)):
                    writer.add(doc, ids + end)
            if writer is not None:
                writer.close()
        except BaseException:
            if stream is not None:
                stream.close()
                files.delete_file(own)
            raise
        if writer is not None:
            stream.close()
            files.move(own, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_ids]})

    manifest = common.saved(ordered.mapInArrow(write, schema), "manifest")
    _clear(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of written files: doc_id, start (of all ids), n_tokens, ids_crc32, middle_id and, if asked for, ids.

    middle_id is the id at n_tokens / 2, addressed alone, without the ids around it; where it differs
    from what decoding the whole block gives, the file is damaged and an error is raised. A task reads
    about one file: files are dealt by range of their numbers.
    """
    spark = manifest.sparkSession
    common.prepare(spark)
    folder = qualified(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, middle_id long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(path) as stream:
                    rows, held = [], 0
                    reader = Reader(stream, stream.size())
                    for doc, start, ids in reader.documents():
                        data = ids.astype("<u4").tobytes()
                        middle = reader.token(start + len(ids) // 2) if len(ids) else None
                        if len(ids) and middle != int(ids[len(ids) // 2]):
                            raise ValueError(f"{path}: the id at {start + len(ids) // 2} is {middle} addressed alone and {ids[len(ids) // 2]} in its block")
                        rows.append((doc, base + start, len(ids), zlib.crc32(data), middle) + ((data,) if with_ids else ()))
                        held += len(data)
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield _rows(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    n_files = manifest.count()
    return manifest.repartitionByRange(max(n_files, 1), "part").select("path", "first_token").mapInArrow(read, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32", "middle_id"], [pa.int64()] * 5
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op2_dac_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's place, count and checksum in the token files, read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = common.shared_dir(spark, "dac")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, added=True), folder, with_ids=False)
