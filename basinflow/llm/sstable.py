"""Token ids in sorted-string-table files.

A file holds documents in ascending identifier order:

    data blocks | block index | Bloom filter | footer

A data block is a run of entries (about BLOCK bytes before compression, one entry at least). An
entry is: bytes shared with the previous key, bytes not shared, length of the value (three
varints), the rest of the key, the value. Every RESTART entries the whole key is written, and the
block ends with the offsets of these entries, so a lookup searches them by bisection. A block is
stored with zstd behind its crc32. The block index has each block's last key and place; the
Bloom filter has ten bits a key; the footer has the places of both, counts and a magic number.
Keys are 8 bytes, big endian with the sign bit flipped, so that byte order is numeric order; a
null identifier is the empty key, which sorts first. Values are the ids as little-endian
unsigned 16-bit integers (32-bit if the vocabulary needs it).

Repeated identifiers are kept side by side, ordered by text, and may fill several files; a lookup gives
the first. A null text has only the end id. Extra columns are neither read nor written. An empty table gives no
files. Files go to a folder that all machines share; a task writes under a temporary name and
renames, so a repeated task replaces its file by an equal one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import WordCache, pre_tokens, text_slices
from basinflow.llm.common import COPY, numbered, small_batches

MAGIC, RESTART, BLOCK, FILE = b"SSTids01", 16, 64 << 10, 16 << 20
FOOTER = struct.Struct("<QQQQQQI4x8s")
PROBES, BITS = 7, 10
#: New pre-tokens that are encoded in one call.
JOINED = 4000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [((a + i * b) & (2**64 - 1)) % bits for i in range(PROBES)]


class Writer:
    """One file in memory; keys must come in ascending order."""

    def __init__(self, width: int):
        self.width, self.out, self.index, self.keys = width, bytearray(), [], []
        self.docs = self.ids = 0
        self.start()

    def start(self) -> None:
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.docs, self.ids = self.docs + 1, self.ids + len(value) // self.width
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        import zstandard

        if self.n:
            plain = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            packed = zstandard.ZstdCompressor(level=1).compress(plain)
            self.index.append((self.last, len(self.out), len(packed) + 4))
            self.out += struct.pack("<I", zlib.crc32(packed)) + packed
            self.start()

    def finish(self) -> bytes:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.out)
        return bytes(self.out) + index + bytes(bloom) + FOOTER.pack(at, len(index), at + len(index), bits, self.docs, self.ids, self.width, MAGIC)


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        at, n, self.bloom, self.bits, self.docs, self.ids, self.width, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a table of ids")
        self.index, end = [], at + n
        while at < end:
            k, at = read_varint(data, at)
            key, at = data[at : at + k], at + k
            place, at = read_varint(data, at)
            size, at = read_varint(data, at)
            self.index.append((key, place, size))

    def plain(self, i: int) -> tuple[bytes, list[int]]:
        import zstandard

        _, at, n = self.index[i]
        packed = self.data[at + 4 : at + n]
        if zlib.crc32(packed) != struct.unpack_from("<I", self.data, at)[0]:
            raise ValueError(f"block {i} is damaged")
        plain = zstandard.ZstdDecompressor().decompress(packed)
        n = struct.unpack_from("<I", plain, len(plain) - 4)[0]
        end = len(plain) - 4 * (n + 1)
        return plain[:end], list(struct.unpack_from(f"<{n}I", plain, end))

    @staticmethod
    def entries(plain: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(plain):
            shared, at = read_varint(plain, at)
            rest, at = read_varint(plain, at)
            size, at = read_varint(plain, at)
            key = key[:shared] + plain[at : at + rest]
            at += rest
            yield key, plain[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.entries(self.plain(i)[0])

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, by Bloom filter, bisection over the blocks, then over restarts."""
        key = key_of(doc_id)
        if any(not self.data[self.bloom + (p >> 3)] >> (p & 7) & 1 for p in bloom_places(key, self.bits)):
            return None
        i = bisect_left([k for k, _, _ in self.index], key)
        if i == len(self.index):
            return None
        plain, restarts = self.plain(i)
        first = bisect_left(restarts, key, key=lambda at: next(self.entries(plain, at))[0])
        for k, value in self.entries(plain, restarts[max(0, first - 1)]):
            if k == key:
                return np.frombuffer(value, f"<u{self.width}")
            if k > key:
                return None
        return None


class Encoder:
    """The tokenizer's ids of whole texts. Its pre-tokens do not depend on their neighbours, so
    each distinct one is encoded once by the library and kept; texts with the literal of an added
    token (such as the end of text) are encoded whole by the library."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.model, self.pattern, self.cache = Tokenizer.from_file(path), pattern, WordCache()
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"

        # Bytes of each token, if the vocabulary writes a byte as one character.
        tokens = self.model.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(tokens.values()) + 1, np.int64) if "ByteLevel" in str(type(self.model.pre_tokenizer)) else None
        if self.lengths is not None:
            for token, i in tokens.items():
                self.lengths[i] = 0 if token in self.added else len(token)

    def as_one_text(self, words: list[str]) -> list[bytes]:
        """Ids of words that the library splits apart again when they follow each other: one call for
        all of them, cut where the tokens' bytes reach the end of a word. A word without a space in
        front gets a line end there, which is a token of its own. Empty if a cut falls into a token."""
        pieces = [w if w[0] == " " else "\n" + w for w in words]
        ids = np.array(self.model.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        reach = np.cumsum(self.lengths[ids])
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in pieces])
        cuts = np.searchsorted(reach, ends)
        if len(ids) == 0 or cuts[-1] != len(ids) - 1 or (reach[cuts] != ends).any():
            return []
        ends = self.width * (cuts + 1)
        starts = np.concatenate([[0], ends[:-1]]) + self.width * np.array([p[0] == "\n" for p in pieces])
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(starts.tolist(), ends.tolist())]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        whole = [t is not None and any(x in t for x in self.added) for t in texts]
        split = [[] if w else pre_tokens(t or "", self.pattern) for t, w in zip(texts, whole)]
        coded = self.cache.coded(split, self.words)
        return [np.array(self.model.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() if w else ids for t, ids, w in zip(texts, coded, whole)]

    def words(self, new: list[str]) -> list[bytes]:
        apart = [w for w in new if w.isspace()] if self.lengths is not None else new
        known = {}
        if len(apart) < len(new):
            together = [w for w in new if not w.isspace()] if apart else new
            for k in range(0, len(together), JOINED):
                part = together[k : k + JOINED]
                found = self.as_one_text(part)
                if found and len(part) == len(new):
                    return found
                known.update(zip(part, found))
                apart += part if not found else []
        for k in range(0, len(apart), JOINED):
            part = apart[k : k + JOINED]
            known.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)))
        return [known[w] for w in new]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, pattern)


def write(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode all documents and write the files below folder (a URI that all machines reach).

    Returns the manifest in file order: path, docs, ids and the number of ids in earlier files. It
    has one row per file (FILE bytes), which is all that reaches the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        to, base = fs.FileSystem.from_uri(folder)
        to.create_dir(base, recursive=True)
        coder, part, count = encoder(path, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype).tobytes()
        now = Writer(coder.width)

        def save():
            name = f"ids-{part:06d}-{count:05d}.sst"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with to.open_output_stream(temporary) as f:
                f.write(now.finish())
            to.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([count], pa.int32()), "name": [name], "docs": [now.docs], "ids": [now.ids]})

        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                for doc, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), coder.batch(texts)):
                    now.add(key_of(doc), ids + end)
                    if len(now.out) >= FILE:
                        yield save()
                        now, count = Writer(coder.width), count + 1
        if now.docs:
            yield save()

    rows = numbered(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), COPY)
    placed = rows.repartitionByRange("doc_id", COPY).sortWithinPartitions("doc_id", COPY).select("doc_id", "text")
    files = sorted(placed.mapInArrow(run, "part int, n int, name string, docs long, ids long").collect())
    out, before = [], 0
    for f in files:
        out.append({"path": f"{folder}/{f['name']}", "docs": f["docs"], "ids": f["ids"], "before": before})
        before += f["ids"]
    return out


def read(spark, manifest: list[dict]) -> DataFrame:
    """All documents of the files: doc_id, start (ids of all documents before it), n_tokens (with
    the end id) and ids as little-endian unsigned 32-bit integers in one binary value."""
    small_batches(spark)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    table = Reader(f.read())
                for i in range(len(table.index)):
                    docs, starts, counts, ids = [], [], [], []
                    for key, value in table.entries(table.plain(i)[0]):
                        wide = np.frombuffer(value, f"<u{table.width}").astype("<u4")
                        docs.append(id_of(key))
                        starts.append(start)
                        counts.append(len(wide))
                        ids.append(wide.tobytes())
                        start += len(wide)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame([(f["path"], f["before"]) for f in manifest], "path string, before long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
