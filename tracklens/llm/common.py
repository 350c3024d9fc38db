"""What several corpus operators share: tables, the shared folder, batches of whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one numpy pass holds at a time; a longer text is a pass of its own.
PASS_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more rows than this, and more than one in HOT_KEYS of all rows, is dealt over several tasks; so HOT_KEYS bounds their number.
HOT_ROWS, HOT_KEYS = 500, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a local master gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tracklens-")
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there when executors are lost."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in a folder of their own in the shared folder, removed together once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, fresh_dir(spark, name), 0

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with a table that has one row for each of the keys.

    Rows of a hot key are dealt over as many tasks as they fill, by the hash of their columns, and the table's row
    goes to each of them. The driver gets the hot keys, HOT_KEYS at most. counts: (keys, n), where it is known.
    """
    total = rows.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int")).collect() if total > most else []
    if not hot:
        return rows.join(table, keys, how)
    part, parts = free(rows.join(table, keys).limit(0), "part", "parts")
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), T.StructField(parts, T.IntegerType())])
    dealt = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in hot], schema))  # at most HOT_KEYS rows
    n = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(dealt, keys, "left").withColumn(part, F.pmod(F.xxhash64(*rows.columns), n).cast("int")).drop(parts)
    right = table.join(dealt, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return left.join(right, [*keys, part], how).drop(part)


def passes(texts: list[str | None], most: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > most:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def sliced(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches cut to passes, each with its texts; null texts are empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        for a, b in passes(texts):
            yield batch.slice(a, b - a), [t or "" for t in texts[a:b]]


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, made of the given ones by appending underscores."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(df: DataFrame, **more: T.DataType) -> T.StructType:
    """df's schema without the named columns, and those at the end."""
    gone = {k.lower() for k in more}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in gone] + [T.StructField(k, v) for k, v in more.items()])


def appended(batch: pa.RecordBatch, schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    """batch with the columns added or replaced, in the order of schema."""
    own = {batch.schema.field(i).name: batch.column(i) for i in range(batch.num_columns)}
    own |= columns
    return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in schema], schema=schema)
