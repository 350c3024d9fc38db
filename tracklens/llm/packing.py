"""Packing by power-of-two decomposition.

A document's tokens, its end id included, are cut into pieces whose lengths are the powers of two that add up
to its length: as many full pieces as fit, then one piece for each binary digit of the rest. Every piece is a
sequence of its own, so no sequence crosses documents and none is padded; sequences of equal length share a
bucket and can be batched together. Narrow: no exchange, nothing gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import encoder, vocabulary
from .common import sliced

MOST = 1024
END_ID = 0
#: Rows of one output batch.
OUT_ROWS = 20_000


def piece_lengths(tokens: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces, document by document, longest first, and the number of pieces of each document."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    powers = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    counts = np.stack([tokens // most, *((tokens % most) // p % 2 for p in powers[1:])], axis=1)
    return np.repeat(np.tile(powers, len(tokens)), counts.ravel()), counts.sum(axis=1)


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(flat, offsets[1:], end_id), offsets + np.arange(len(offsets))


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of ids as packed little-endian unsigned 32-bit integers."""
    data = np.ascontiguousarray(flat, dtype="<u4")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(data)])


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """A row for each piece: key, start, length, tokens, doc_tokens, sequence_id, offset, bucket.

    tokens: little-endian unsigned 32-bit ids; bucket: log2 of the length. A null or empty text is the end id
    alone, one piece of length 1. Repeated rows give pieces of their own; a null key is passed on. sequence_id
    counts the pieces of a partition after the partition's number in the higher bits: unique, and the same
    when a lost task runs again. Other columns of df are left out.
    """
    raw = vocabulary(df, path)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("tokens", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("bucket", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sequence = encoder(raw.value), TaskContext.get().partitionId() << 40
        for batch, texts in sliced(batches, text):
            flat, offsets = with_end(*own.encode(texts), end_id)
            tokens = np.diff(offsets)
            lengths, pieces = piece_lengths(tokens, most)
            ends = np.cumsum(lengths)
            doc = np.repeat(np.arange(len(texts)), pieces)
            start = ends - lengths - offsets[:-1][doc]
            bounds = np.concatenate([[0], ends])
            for a in range(0, len(lengths), OUT_ROWS):
                b = min(a + OUT_ROWS, len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index(key)).take(pa.array(doc[a:b])),
                        pa.array(start[a:b]),
                        pa.array(lengths[a:b].astype(np.int64)),
                        binaries(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]),
                        pa.array(tokens[doc[a:b]]),
                        pa.array(sequence + np.arange(a, b)),
                        pa.array(np.zeros(b - a, dtype=np.int64)),
                        pa.array(np.log2(lengths[a:b]).astype(np.int32)),
                    ],
                    names=schema.names,
                )
            sequence += len(lengths)

    return df.select(key, text).mapInArrow(run, schema)
