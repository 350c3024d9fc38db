"""Keyed tables that are kept between jobs: versions of a list of Parquet folders, laid over each other by key.

A version is one small JSON file that names its parts. A writer writes its rows as a part of their own, then makes the
next version with a create that fails if somebody else was first; then it reads the newest version and tries again, so
no writer's rows are lost and none waits for another. What a (stream, batch) has written is written once: a batch
that is tried again finds itself in the versions and leaves the table as it is; a new run of a stream has another name.
compact() puts the parts of one version in place of one, and keeps those that came since.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tries of a writer that others always overtake.
TRIES = 50


class Overtaken(RuntimeError):
    """Other writers came first each time."""


@dataclass(frozen=True)
class Part:
    """A folder of rows; of rows with one key those of the part with the highest place stand."""

    name: str
    place: int
    stream: str = ""
    batch: int = -1


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[Part, ...]
    #: The last batch of each stream, which stays when its part is compacted.
    done: dict[str, int]
    at: int = 0


class KeptTable:
    """A keyed table under root, a folder that driver and executors share.

    key: its columns. at: the column that orders rows of one key within a part, the last stands. Columns of the first
    rows written are the table's; later rows must have them. Keys may be null; equal keys are one row.
    """

    def __init__(self, spark: SparkSession, root: str, key: tuple[str, ...], at: str | None = None) -> None:
        self.spark, self.root, self.key, self.at = spark, root.rstrip("/"), key, at
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions ---------------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self, number: int | None = None) -> Version:
        """That version, or the newest; 0 is the empty table."""
        number = max(self.versions(), default=0) if number is None else number
        if number == 0:
            return Version(0, (), {})
        stream = self._fs.open(self._path(f"{self.root}/versions/{number:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        d = json.loads(text)
        return Version(d["number"], tuple(Part(**p) for p in d["parts"]), d["done"], d["at"])

    def _commit(self, v: Version) -> bool:
        """Makes version v, unless it's there already."""
        folder, name = f"{self.root}/versions", f"{v.number:010d}.json"
        ready = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(ready)
        out.write(bytearray(json.dumps(asdict(v)).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a rename would replace a file here; a link never does
                own = self._fs.makeQualified(ready).toUri().getPath()
                os.link(own, f"{os.path.dirname(own)}/{name}")
            else:
                rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs
                context = rename.FileContext.getFileContext(ready.toUri() if ready.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(getattr(rename, "Options$Rename"), 0)
                context.rename(ready, self._path(f"{folder}/{name}"), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(ready, False)

    def _next(self, change) -> Version:
        """change(version) gives (parts, done) of the next version, or None to leave the table as it is."""
        for _ in range(TRIES):
            now = self.version()
            new = change(now)
            if new is None:
                return now
            v = Version(now.number + 1, *new, at=int(self.spark.sparkContext._jvm.System.currentTimeMillis()))
            if self._commit(v):
                return v
        raise Overtaken(f"{self.root}: overtaken {TRIES} times")

    # -- rows -------------------------------------------------------------------------------------------------

    def _written(self, rows: DataFrame, name: str) -> None:
        rows.write.parquet(f"{self.root}/parts/part={name}")

    def _last(self, rows: DataFrame, *order) -> DataFrame:
        """The last row of each key."""
        rest = [F.col(self.at).desc_nulls_last()] if self.at else []
        w = Window.partitionBy(*self.key).orderBy(*order, *rest, F.xxhash64(*(c for c in rows.columns if not c.startswith("_place"))))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def upsert(self, rows: DataFrame, stream: str = "", batch: int = -1) -> Version:
        """Lays rows over the table. A batch (from 0 on) of a stream that is in the table already changes nothing."""
        if batch >= 0 and batch <= self.version().done.get(stream, -1):
            return self.version()
        name = uuid.uuid4().hex
        self._written(self._last(rows), name)

        def change(now: Version):
            if batch >= 0 and batch <= now.done.get(stream, -1):
                return None
            part = Part(name, max((p.place for p in now.parts), default=0) + 1, stream, batch)
            return (*now.parts, part), now.done | ({stream: batch} if batch >= 0 else {})

        v = self._next(change)
        if all(p.name != name for p in v.parts):
            self._fs.delete(self._path(f"{self.root}/parts/part={name}"), True)
        return v

    def read(self, version: int | Version | None = None, having: DataFrame | None = None) -> DataFrame | None:
        """The rows of that version, or of the newest; None where nothing was written yet. having: only rows that match it by its columns."""
        v = version if isinstance(version, Version) else self.version(version)
        if not v.parts:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/parts").option("mergeSchema", "false").parquet(*(f"{self.root}/parts/part={p.name}" for p in v.parts))
        if having is not None:
            rows = rows.join(having.distinct(), [*having.columns], "left_semi")
        if len(v.parts) == 1:
            return rows.drop("part")
        place = F.create_map(*(F.lit(x) for p in v.parts for x in (p.name, p.place)))[F.col("part")]
        return self._last(rows.withColumn("_place", place).drop("part"), F.col("_place").desc()).drop("_place")

    def rows_of(self, stream: str, batch: int) -> DataFrame | None:
        """What a batch has written, as long as it's not compacted."""
        name = next((p.name for p in self.version().parts if (p.stream, p.batch) == (stream, batch)), None)
        return None if name is None else self.spark.read.parquet(f"{self.root}/parts/part={name}")

    def compact(self) -> Version:
        """One part in place of those of the newest version; parts that others write meanwhile stay on top of it."""
        before = self.version()
        if len(before.parts) < 2:
            return before
        name = uuid.uuid4().hex
        self._written(self.read(before), name)

        def change(now: Version):
            if now.parts[: len(before.parts)] != before.parts:
                return None  # somebody else compacted them
            return (Part(name, before.parts[-1].place), *now.parts[len(before.parts) :]), now.done

        v = self._next(change)
        if all(p.name != name for p in v.parts):
            self._fs.delete(self._path(f"{self.root}/parts/part={name}"), True)
        return v

    def forget(self, keep: int = 10) -> None:
        """Removes all but the last `keep` versions and the parts that only they name. Not while a writer may be between part and version."""
        numbers = self.versions()
        stay = {p.name for n in numbers[-keep:] for p in self.version(n).parts}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n:010d}.json"), False)
        for folder in self._names("parts"):
            if folder.removeprefix("part=") not in stay:
                self._fs.delete(self._path(f"{self.root}/parts/{folder}"), True)


def stream_id(spark: SparkSession, default: str = "batch") -> str:
    """The id of the streaming query that runs this batch: it stays with a checkpoint, and a new checkpoint has another."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or default

