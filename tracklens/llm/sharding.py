"""Contiguous shards of near equal bytes, cut from global prefix sums.

Documents are put in ascending order of doc_id by a range exchange of three narrow columns; the texts stay
where they are. Each range has one total, the driver adds up the totals (one row per range), and every
document's first byte in the whole corpus follows from its range's base and a running sum inside the range.
A document whose first byte is s goes to shard floor(s * n / total): every shard has total / n bytes, give or
take one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

SHARDS = 24
#: Bytes that a record has besides its text.
RECORD_BYTES = 8


def ordered(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows in ranges of ascending (key, tie), nulls first, kept in the shared checkpoint folder: the ranges are the same each time they are read."""
    return df.repartitionByRange(F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first()).checkpoint()


def shard_by_bytes(df: DataFrame, key: str = "doc_id", size: str = "size", shards: int = SHARDS, tie: str | None = None) -> DataFrame:
    """df with `shard` (int) and `slot` (long): contiguous in `key`, bytes near equal, slots gapless from 0 in each shard.

    size: a long column, 0 or more. Rows of equal key are ordered by `tie` (size, if none is given); a null key
    comes first. Rows are never dropped; with fewer rows than shards some shards stay empty, and an empty table
    gives an empty result. Columns that are named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    part, first = free(df, "part", "first")
    rows = ordered(df, key, tie or size).withColumn(part, F.spark_partition_id())
    totals = sorted((r[0], r[1], r[2]) for r in rows.groupBy(part).agg(F.sum(size), F.count(F.lit(1))).collect())  # a row per range
    base, byte, row = {}, 0, 0
    for p, b, n in totals:
        base[p] = (byte, row)
        byte, row = byte + (b or 0), row + n
    total = max(byte, 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, row = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {batch.schema.field(i).name: batch.column(i) for i in range(batch.num_columns)}
            if byte is None:
                byte, row = base[column[part][0].as_py()]
            sizes = column[size].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = byte + np.cumsum(sizes) - sizes
            # start * shards can pass 2**63 only beyond 10**17 bytes; Python's whole numbers take over there
            shard = start * shards // total if total < 2**63 // max(shards, 1) else np.array([int(s) * shards // total for s in start], dtype=np.int64)
            column["shard"] = pa.array(np.minimum(shard, shards - 1).astype(np.int32))
            column["slot"] = pa.array(row + np.arange(len(sizes), dtype=np.int64))
            byte, row = int(start[-1] + sizes[-1]), row + len(sizes)
            del column[part]
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", shard int, slot bigint"
    numbered = rows.mapInArrow(placed, schema)
    starts = {r[0]: r[1] for r in numbered.groupBy("shard").agg(F.min("slot")).collect()}  # a row per shard
    small = spark.createDataFrame([(int(k), int(v)) for k, v in starts.items()], f"shard int, {first} bigint")
    return numbered.join(F.broadcast(small), "shard").select(*df.columns, "shard", (F.col("slot") - F.col(first)).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_by_bytes(slim, "doc_id", "size", shards, tie="text_crc32")
