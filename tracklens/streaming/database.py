"""Upserts into a database over Python's DB-API: a data source that writes to a staging table and merges once.

Tasks put their rows into {table}_staging under a mark of their own and report it; commit merges the reported marks into
the table by key and notes (stream, batch) in {table}_batches, in one transaction; rows of failed, repeated or
aborted attempts carry marks that nobody reports and are removed. A batch that was merged before is not merged again.

The SQL is what PostgreSQL and SQLite share (INSERT ... ON CONFLICT DO UPDATE). Options: module (the driver's Python module),
dsn, table, key (columns joined by commas), stream, batch, rows (a statement).
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.kept import stream_id

#: SQL types of Spark's.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "string": "TEXT", "boolean": "BOOLEAN", "float": "REAL"}


@dataclass
class Written(WriterCommitMessage):
    mark: str
    rows: int


class UpsertWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        o = self.options = options
        self.names, self.kinds = schema.names, [f.dataType.simpleString() for f in schema.fields]
        self.table, self.key = o["table"], [k.strip() for k in o["key"].split(",")]
        self.stream, self.batch, self.run = o.get("stream", ""), int(o.get("batch", -1)), uuid.uuid4().hex
        with closing(self.connected()) as db:
            columns = [f"{n} {TYPES.get(k, 'TEXT')}" for n, k in zip(self.names, self.kinds)]
            db.cursor().execute(f"CREATE TABLE IF NOT EXISTS {self.table} ({', '.join(columns)}, PRIMARY KEY ({', '.join(self.key)}))")
            db.cursor().execute(f"CREATE TABLE IF NOT EXISTS {self.table}_staging (run TEXT, mark TEXT, {', '.join(columns)})")
            db.cursor().execute(f"CREATE TABLE IF NOT EXISTS {self.table}_batches (stream TEXT, batch BIGINT, PRIMARY KEY (stream, batch))")
            db.commit()

    def connected(self) -> Any:
        module = importlib.import_module(self.options["module"])
        self.hole = "?" if module.paramstyle == "qmark" else "%s"
        return module.connect(self.options["dsn"])

    def execute(self, db: Any, sql: str, values: tuple = ()) -> Any:
        cursor = db.cursor()
        cursor.execute(sql.replace("?", self.hole), values)
        return cursor

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        mark, n, some = f"{self.run}-{task.partitionId()}-{task.taskAttemptId()}", 0, []
        with closing(self.connected()) as db:
            sql = f"INSERT INTO {self.table}_staging VALUES ({', '.join([self.hole] * (len(self.names) + 2))})"
            for row in iterator:
                some.append((self.run, mark, *row))
                n += 1
                if len(some) >= int(self.options.get("rows", 1000)):
                    db.cursor().executemany(sql, some)
                    some = []
            if some:
                db.cursor().executemany(sql, some)
            db.commit()
        return Written(mark, n)

    def commit(self, messages: list[Written | None]) -> None:
        with closing(self.connected()) as db:
            before = self.batch >= 0 and self.execute(db, f"SELECT 1 FROM {self.table}_batches WHERE stream = ? AND batch = ?", (self.stream, self.batch)).fetchone()
            if not before:
                columns, rest = ", ".join(self.names), [n for n in self.names if n not in self.key]
                update = f"DO UPDATE SET {', '.join(f'{n} = excluded.{n}' for n in rest)}" if rest else "DO NOTHING"
                for m in messages:
                    if m is not None:
                        self.execute(db, f"INSERT INTO {self.table} ({columns}) SELECT {columns} FROM {self.table}_staging WHERE mark = ? ON CONFLICT ({', '.join(self.key)}) {update}", (m.mark,))
                if self.batch >= 0:
                    self.execute(db, f"INSERT INTO {self.table}_batches VALUES (?, ?)", (self.stream, self.batch))
            self.execute(db, f"DELETE FROM {self.table}_staging WHERE run = ?", (self.run,))
            db.commit()

    def abort(self, messages: list[Written | None]) -> None:
        with closing(self.connected()) as db:
            self.execute(db, f"DELETE FROM {self.table}_staging WHERE run = ?", (self.run,))
            db.commit()


class Upsert(DataSource):
    @classmethod
    def name(cls) -> str:
        return "database_upsert"

    def writer(self, schema: StructType, overwrite: bool) -> UpsertWriter:
        return UpsertWriter(schema, dict(self.options))


def upserted(df: DataFrame, module: str, dsn: str, table: str, key: tuple[str, ...], at: str, stream: str, batch: int) -> None:
    """Merges df's last row of each key into the table, unless (stream, batch) was merged before."""
    df.sparkSession.dataSource.register(Upsert)
    last = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*df.columns))
    rows = df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    options = {"module": module, "dsn": dsn, "table": table, "key": ",".join(key), "stream": stream, "batch": str(batch)}
    rows.write.format("database_upsert").options(**options).mode("append").save()


def database(module: str, dsn: str, table: str, key: tuple[str, ...], at: str = "assessed_at"):
    """A sink for foreachBatch: each batch of each stream is merged once."""
    return lambda df, n: upserted(df, module, dsn, table, key, at, stream_id(df.sparkSession), n)
