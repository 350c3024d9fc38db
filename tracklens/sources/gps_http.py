"""GPS tracks from an HTTP service: GET {url}/v1/drivers/{driver_id}/gps?start=…&end=… gives a JSON list of points.

Two forms. `gps_http` is a data source: drivers and times come from options or from filters on driver_id and ts, which
are pushed into the requests; a partition is some drivers' requests of one slice of time; it reads batches and streams.
fetch_tracks() takes the requests as rows (driver_id, start, end), one for each order, say: any number of them, dealt
over the tasks like any other rows.

A request is tried again after a wait that doubles while the service is down, busy or answers with a server error; an
answer that says the request is wrong, or that isn't a JSON list, fails at once. Points without a time or place are left out.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FIELDS = "driver_id bigint, ts bigint, seq int, lat double, lon double, speed double, heading double"
#: Other names of a point's fields; the first that is there counts.
NAMES = {"lat": ("lat",), "lon": ("lon",), "speed": ("speed_mps", "speed"), "heading": ("heading_deg", "heading", "course")}


def seconds(text: str) -> int:
    """Whole seconds since 1970 of an ISO time; without a zone it is UTC."""
    t = datetime.fromisoformat(text.strip())
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() // 1)


def iso(ts: int) -> str:
    return datetime.fromtimestamp(ts, UTC).isoformat()


@dataclass(frozen=True)
class Service:
    url: str
    api_key: str = ""
    tries: int = 4
    wait: float = 0.5
    timeout: float = 10.0

    def get(self, driver: int, start: int, end: int) -> list[dict[str, Any]]:
        query = urllib.parse.urlencode({"start": iso(start), "end": iso(end)})
        ask = urllib.request.Request(f"{self.url.rstrip('/')}/v1/drivers/{driver}/gps?{query}", headers={"X-API-Key": self.api_key})
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
                    found = json.load(answer)
                if not isinstance(found, list):
                    raise ValueError("a GPS answer must be a JSON list")
                return found
            except urllib.error.HTTPError as e:
                if (e.code < 500 and e.code != 429) or k == self.tries - 1:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == self.tries - 1:
                    raise
            time.sleep(self.wait * 2**k)
        return []

    def points(self, driver: int, start: int, end: int) -> Iterator[tuple]:
        """Rows of FIELDS, start <= ts < end, in the service's order."""
        for seq, p in enumerate(self.get(driver, start, end)):
            if not p.get("ts") or p.get("lat") is None or p.get("lon") is None:
                continue
            ts = seconds(p["ts"])
            if start <= ts < end:
                value = {k: next((float(p[n]) for n in names if p.get(n) is not None), None) for k, names in NAMES.items()}
                yield driver, ts, seq, value["lat"], value["lon"], value["speed"], value["heading"]


@dataclass
class Slice(InputPartition):
    drivers: tuple[int, ...]
    start: int
    end: int


def sliced(drivers: Iterable[int], start: int, end: int, length: int, most: int) -> list[Slice]:
    """Partitions of at most `most` drivers and `length` seconds."""
    ids = sorted(set(drivers))
    blocks = [tuple(ids[i : i + most]) for i in range(0, len(ids), most)]
    return [Slice(b, t, min(t + length, end)) for t in range(start, end, length) for b in blocks]


class GpsReader(DataSourceReader):
    def __init__(self, service: Service, options: dict[str, str]) -> None:
        self.service, self.options = service, options
        self.drivers: set[int] | None = {int(d) for d in options["drivers"].split(",")} if options.get("drivers") else None
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", time.time()))

    def pushFilters(self, filters):
        """Takes filters on driver_id and ts over; what it takes is exact, all others are Spark's."""
        for f in filters:
            at, value = (f.attribute[0] if getattr(f, "attribute", None) else None), getattr(f, "value", None)
            if at == "driver_id" and isinstance(f, EqualTo | In):
                asked = {int(value)} if isinstance(f, EqualTo) else {int(v) for v in value}
                self.drivers = asked if self.drivers is None else self.drivers & asked
            elif at == "ts" and isinstance(f, GreaterThanOrEqual):
                self.start = max(self.start, int(value))
            elif at == "ts" and isinstance(f, GreaterThan):
                self.start = max(self.start, int(value) + 1)
            elif at == "ts" and isinstance(f, LessThanOrEqual):
                self.end = min(self.end, int(value) + 1)
            elif at == "ts" and isinstance(f, LessThan):
                self.end = min(self.end, int(value))
            else:
                yield f

    def partitions(self):
        if self.drivers is None:
            raise ValueError("name drivers, by the option or by a filter on driver_id")
        return sliced(self.drivers, self.start, self.end, int(self.options.get("slice", 86_400)), int(self.options.get("drivers_a_task", 100))) or [Slice((), 0, 0)]

    def read(self, partition: Slice):
        for d in partition.drivers:
            yield from self.service.points(d, partition.start, partition.end)


class GpsStreamReader(DataSourceStreamReader):
    """New points by time: a batch has the times from the last one's end up to `lag` seconds ago."""

    def __init__(self, service: Service, options: dict[str, str]) -> None:
        self.service, self.options = service, options
        self.drivers = {int(d) for d in options["drivers"].split(",")}

    def initialOffset(self):
        return {"ts": int(self.options.get("start", 0))}

    def latestOffset(self):
        until = int(self.options["end"]) if "end" in self.options else int(time.time())
        return {"ts": max(int(self.options.get("start", 0)), until - int(self.options.get("lag", 60)))}

    def partitions(self, start, end):
        return sliced(self.drivers, start["ts"], end["ts"], int(self.options.get("slice", 86_400)), int(self.options.get("drivers_a_task", 100)))

    def commit(self, end):
        pass

    def read(self, partition: Slice):
        for d in partition.drivers:
            yield from self.service.points(d, partition.start, partition.end)


class GpsHttp(DataSource):
    """Options: url, api_key, drivers (ids joined by commas), start and end (seconds; end is not included), slice (seconds), drivers_a_task, tries, wait, timeout; lag for streams."""

    @classmethod
    def name(cls) -> str:
        return "gps_http"

    def schema(self) -> str:
        return FIELDS

    def _service(self) -> Service:
        o = self.options
        return Service(o["url"], o.get("api_key", ""), int(o.get("tries", 4)), float(o.get("wait", 0.5)), float(o.get("timeout", 10)))

    def reader(self, schema: StructType) -> GpsReader:
        return GpsReader(self._service(), dict(self.options))

    def streamReader(self, schema: StructType) -> GpsStreamReader:
        return GpsStreamReader(self._service(), dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GpsHttp)


def fetch_tracks(asks: DataFrame, service: Service) -> DataFrame:
    """FIELDS of each asked (driver_id, start, end), end not included; equal asks are asked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ask in zip(*(c.to_pylist() for c in b.columns)):
                rows = list(service.points(*ask))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=[f.split()[0] for f in FIELDS.split(", ")])

    return asks.select("driver_id", "start", "end").where("driver_id is not null and start < end").distinct().mapInArrow(run, FIELDS)


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
