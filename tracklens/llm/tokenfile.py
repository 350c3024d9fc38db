"""Token files: concatenated ids, with Elias-Fano coded document boundaries and document ids in a footer.

    magic | ids (2 or 4 bytes each) | boundaries | document ids | head | length of head (8 bytes) | magic

Elias-Fano keeps n ascending values below u in about n * (2 + log2(u / n)) bits: the low bits of each value in
a packed array, the high bits in unary in a bit vector. A directory of ones per block answers select(i), the
i-th boundary, without a table of 64-bit offsets, so one document is read by two selects and one ranged read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder, vocabulary
from .common import sliced
from .packing import binaries, with_end

MAGIC = b"TLTOKEN1"
#: Ids that a reader holds at once, but for a longer document.
READ_IDS = 2_000_000
BLOCK = 64  # bytes of the bit vector for each entry of the directory


class EliasFano:
    """Ascending whole numbers from 0 on; values may repeat."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes) -> None:
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(np.frombuffer(high, dtype=np.uint8)).astype(np.int64)
        pad = -len(ones) % BLOCK
        per_block = np.append(ones, np.zeros(pad, dtype=np.int64)).reshape(-1, BLOCK).sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32 if n < 2**32 else np.uint64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"")
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must ascend")
        l = max(0, (int(v[-1]) // n).bit_length() - 1)  # noqa: E741
        low = np.zeros((n, l), dtype=np.uint8)
        for k in range(l):
            low[:, k] = (v >> np.uint64(k)) & np.uint64(1)
        at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        high[at] = 1
        return cls(n, l, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8, count=min(BLOCK, len(self.high) - block * BLOCK), offset=block * BLOCK), bitorder="little")
        at = block * BLOCK * 8 + int(np.flatnonzero(bits)[i - int(self.before[block])])
        a, b = i * self.l, (i + 1) * self.l
        low = (int.from_bytes(self.low[a // 8 : -(-b // 8)], "little") >> (a % 8)) & ((1 << self.l) - 1)
        return ((at - i) << self.l) | low

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)
        low = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")[: self.n * self.l].reshape(self.n, self.l)
        for k in range(self.l):
            out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.l, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, l, a, b = struct.unpack_from("<QQQQ", data)  # noqa: E741
        return cls(n, l, data[32 : 32 + a], data[32 + a : 32 + a + b])


class Writer:
    """One file; ids are written as they come, the footer at the end. The file has its name only when it is whole."""

    def __init__(self, uri: str, width: int) -> None:
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.width, self.lens, self.keys, self.nulls = width, [], [], 0
        self.out = self.files.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)

    def add(self, keys: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.nulls += keys.null_count
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        self.lens.append(np.diff(offsets))
        self.out.write(np.ascontiguousarray(flat, dtype=self.kind).tobytes())

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.concatenate(self.lens)) if self.lens else np.zeros(0, dtype=np.int64)
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, dtype=np.int64)
        base = int(keys[0]) if len(keys) else 0
        bounds = EliasFano.of(np.concatenate([[0], ends])).to_bytes()
        own = EliasFano.of(keys.astype(np.uint64) - np.uint64(base % 2**64)).to_bytes()
        docs, ids = len(ends), int(ends[-1]) if len(ends) else 0
        head = json.dumps({"docs": docs, "ids": ids, "width": self.width, "nulls": self.nulls, "base": base, "bounds": len(bounds), "keys": len(own)}).encode()
        self.out.write(bounds + own + head + struct.pack("<Q", len(head)) + MAGIC)
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        return docs, ids


class Reader:
    """One file: all documents in order, or one by its place."""

    def __init__(self, uri: str) -> None:
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        n, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.head = json.loads(self.file.read_at(n, size - 16 - n))
        a, b = self.head["bounds"], self.head["keys"]
        at = size - 16 - n - a - b
        self.bounds = EliasFano.from_bytes(self.file.read_at(a, at))
        self.keys = EliasFano.from_bytes(self.file.read_at(b, at + a))
        self.kind = {2: "<u2", 4: "<u4"}[self.head["width"]]

    def ids(self, first: int, last: int) -> np.ndarray:
        w = self.head["width"]
        return np.frombuffer(self.file.read_at((last - first) * w, len(MAGIC) + first * w), dtype=self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def key_list(self) -> list[int | None]:
        own = (self.keys.values() + np.uint64(self.head["base"] % 2**64)).astype(np.int64).tolist()
        return [None] * self.head["nulls"] + own

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """Keys, boundaries and ids of documents, about READ_IDS ids at a time."""
        bounds, keys, a = self.bounds.values().astype(np.int64), self.key_list(), 0
        while a < self.head["docs"]:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + READ_IDS, side="right")) - 1)
            b = min(b, self.head["docs"])
            yield keys[a:b], bounds[a : b + 1], self.ids(int(bounds[a]), int(bounds[b]))
            a = b


MANIFEST = "file string, docs bigint, ids bigint, first bigint"


def write(df: DataFrame, path: str, out_dir: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encodes the whole texts, end id appended, into token files in ascending order of key, and returns the manifest.

    One file for each range of keys; null keys come first, rows of equal key in the order of their texts' hashes;
    a null or empty text is the end id alone. An empty table has no files. The driver gets one row for each file.
    """
    spark, raw = df.sparkSession, vocabulary(df, path)
    tie = F.xxhash64(F.col(text))
    order = [F.col(key).asc_nulls_first(), tie]
    rows = df.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(raw.value), TaskContext.get().partitionId()
        out, name = None, f"{out_dir}/{part:06d}-{uuid.uuid4().hex}.tok"  # a task that runs again writes a file of its own
        for batch, texts in sliced(batches, text):
            if not texts:
                continue
            out = out or Writer(name, 2 if max(own.size, end_id + 1) <= 1 << 16 else 4)
            out.add(batch.column(batch.schema.get_field_index(key)), *with_end(*own.encode(texts), end_id))
        if out:
            docs, ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [docs], "ids": [ids]})

    found = sorted(map(tuple, rows.mapInArrow(run, "part bigint, file string, docs bigint, ids bigint").collect()))
    first, made = 0, []
    for _, name, docs, ids in found:
        made.append((name, docs, ids, first))
        first += ids
    spark.createDataFrame(made, MANIFEST).coalesce(1).write.json(f"{out_dir}/manifest")
    return spark.createDataFrame(made, MANIFEST).repartition(max(1, len(made)))


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the files: key, start (ids before it in all files), n_tokens, tokens (little-endian unsigned 32-bit ids)."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for keys, bounds, ids in Reader(row["file"]).documents():
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(row["first"] + bounds[:-1]), pa.array(np.diff(bounds)), binaries(ids, bounds - bounds[0])], names=schema.names)

    return manifest.select("file", "first").mapInArrow(run, schema)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{out_dir}/manifest")
