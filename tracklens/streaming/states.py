"""Live states of devices, chats, drivers, baselines, outcomes and anomalies, each equal to its batch fold.

Two kinds of state. Ordered folds depend on the order of rows: a key's rows wait in a list until they are `late` seconds behind its
newest one, then they go into its value by (ts, id), so rows may arrive in any order within that time, and twice. What
comes later than that is counted and left out. After each batch a key's result has all its rows, the waiting
ones too. Windows of distinct orders don't depend on order: they are a map from order to time, pruned as time goes on.

Waiting rows lie in packs of up to PACK, a single pack beside the value, so most keys are one read and one write; a list of single
rows costs a look at the whole list for each row that is put.

A state that gets no rows for `days` is dropped. A stream begins with the states of a batch table where one is given (initial).
start() runs a stream into a kept table by key; a stream that is started again goes on from its checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import Baseline
from . import sinks

DAY_MS = 86_400_000
#: Waiting rows of an element of the list state.
PACK = 10_000


class Fold:
    """One ordered fold: row has the columns after ts and id, value the state, out the result's columns after the key and newest."""

    row: str
    value: str
    out: str

    def step(self, value: tuple | None, r: Row) -> tuple:
        raise NotImplementedError

    def results(self, value: tuple | None, rows: list[Row]) -> Iterator[tuple]:
        """Of a key, from its settled value and the rows that are new to it or wait: by default one, that after all of them."""
        for r in rows:
            value = self.step(value, r)
        if value is not None:
            yield self.result(value)

    def result(self, value: tuple) -> tuple:
        raise NotImplementedError


class Ordered(StatefulProcessor):
    """Runs a Fold for each key."""

    def __init__(self, fold: Fold, keys: list[str], late: int, days: int) -> None:
        self.fold, self.late, self.days = fold, late, days
        self.columns = [*keys, "newest", "dropped", *names(fold.out)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.days * DAY_MS
        self.settled = handle.getValueState("settled", f"upto bigint, newest bigint, dropped bigint, packs int, few binary, {self.fold.value}", ttl)
        self.waiting = handle.getListState("waiting", "rows binary", ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.settled.update((r["upto"], r["upto"], 0, 0, None, *(r[n] for n in names(self.fold.value))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fields = ["ts", "id", *names(self.fold.row)]
        held = self.settled.get()
        upto, newest, dropped, packs, few = held[:5] if held is not None else (None, None, 0, 0, None)
        value = tuple(held[5:]) if held is not None and upto is not None else None
        make = Row(*fields)
        parts = [pack[0] for pack in self.waiting.get()] if packs else [few] if few is not None else []
        waiting = {(r[0], r[1]): make(*r) for part in parts for r in pickle.loads(part)}
        places: list[int] = []
        for r in rows:
            places = places or [r.__fields__.index(n) for n in fields]
            own = make(*(r[k] for k in places))
            if upto is not None and own[0] <= upto:
                dropped += 1
            else:
                waiting[own[0], own[1]] = own
        newest = max([t for t, _ in waiting] + ([newest] if newest is not None else []), default=None)
        ahead = [waiting[k] for k in sorted(waiting)]
        out = [tuple(x) for x in self.fold.results(value, ahead)]
        rest = [r for r in ahead if r[0] > newest - self.late]
        for r in ahead[: len(ahead) - len(rest)]:
            value, upto = self.fold.step(value, r), r[0]
        empty = (None,) * len(names(self.fold.value))
        parts = [bytearray(pickle.dumps([tuple(r) for r in rest[i : i + PACK]])) for i in range(0, len(rest), PACK)]
        few, many = (parts[0], 0) if len(parts) == 1 else (None, len(parts))
        self.settled.update((upto, newest, dropped, many, few, *(value if value is not None else empty)))
        if many:
            self.waiting.put([(part,) for part in parts])
        elif packs:
            self.waiting.clear()
        for x in out:
            yield Row(**dict(zip(self.columns, (*key, newest, dropped, *x))))

    def close(self) -> None:
        pass


class Orders(StatefulProcessor):
    """A key's orders of the last `window` seconds up to its newest row: how many, and the sum of their marks."""

    def __init__(self, keys: list[str], window: int, days: int) -> None:
        self.keys, self.window, self.days = keys, window, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts bigint", self.days * DAY_MS)
        self.orders = handle.getMapState("orders", "id bigint", "ts bigint, mark int", self.days * DAY_MS)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._put(initialState["newest"], {o["id"]: (o["ts"], o["mark"]) for o in initialState["orders"]})

    def _put(self, newest: int, new: dict[int, tuple[int, int]]) -> tuple[int, dict[int, tuple[int, int]]]:
        before = self.newest.get()
        newest = max(newest, before[0]) if before is not None else newest
        held = {k[0]: tuple(v) for k, v in self.orders.iterator()} if before is not None else {}
        for k, v in new.items():
            if k not in held or held[k] < v:  # of an order's rows the last counts
                held[k] = v
                self.orders.updateValue((k,), v)
        for k in [k for k, (ts, _) in held.items() if ts < newest - self.window]:
            del held[k]
            self.orders.removeKey((k,))
        self.newest.update((newest,))
        return newest, held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, tuple[int, int]] = {}
        for r in rows:
            new[r["id"]] = max(new.get(r["id"], (r["ts"], r["mark"])), (r["ts"], r["mark"]))
        newest, held = self._put(max(ts for ts, _ in new.values()), new)
        yield Row(**dict(zip(self.keys, key)), newest=newest, orders=len(held), marked=sum(m for _, m in held.values()))

    def close(self) -> None:
        pass


def names(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[at:k].split()[0])
            at = k + 1
    return out


# -- folds --------------------------------------------------------------------------------------------------------


class Average(Fold):
    """A moving average of x, from `start` or the first x on; rows without x don't count."""

    row, value, out = "x double", "v double, n bigint", "value double, n bigint"

    def __init__(self, alpha: float, start: float | None = None) -> None:
        self.alpha, self.start = alpha, start

    def step(self, value, r):
        v, n = value or (self.start, 0)
        if r["x"] is None:
            return v, n
        return (r["x"] if v is None else self.alpha * r["x"] + (1 - self.alpha) * v), n + 1

    def result(self, value):
        return value


class Recoverability(Average):
    """A market's and head's recoverability (the head is in the key): a moving average from the head's static value on, within 0 and 1."""

    row = "head string, x double"

    def __init__(self, alpha: float, static: dict[str, float]) -> None:
        super().__init__(alpha)
        self.static = static

    def step(self, value, r):
        return super().step(value or (float(self.static[r["head"]]), 0), r)

    def result(self, value):
        return min(1.0, max(0.0, value[0])), value[1]


class Device(Fold):
    """A device's risk: the moving average from the first row on that told of one, 0 before; sightings, and who had it last."""

    row = "instant double, told boolean, driver_id bigint, user_id bigint"
    value = "v double, sightings bigint, instant double, driver_id bigint, user_id bigint"
    out = "ewma_risk double, sightings bigint, last_instant double, last_driver_id bigint, last_user_id bigint"

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def step(self, value, r):
        v, n = value[:2] if value else (None, 0)
        if v is not None:
            v = self.alpha * r["instant"] + (1 - self.alpha) * v
        elif r["told"]:
            v = r["instant"]
        return v, n + 1, r["instant"], r["driver_id"], r["user_id"]

    def result(self, value):
        return (value[0] if value[0] is not None else 0.0, *value[1:])


class Chat(Fold):
    """An order's chat: flags joined by or, the highest score, the first driver and source."""

    row = "driver_id bigint, persuasion boolean, cash boolean, forced boolean, score double, source string"
    value = out = row

    def step(self, value, r):
        a = value or (r["driver_id"], False, False, False, None, r["source"])
        top = r["score"] if a[4] is None else a[4] if r["score"] is None else max(a[4], r["score"])
        return a[0], a[1] or bool(r["persuasion"]), a[2] or bool(r["cash"]), a[3] or bool(r["forced"]), top, a[5]

    def result(self, value):
        return value


class Baselines(Fold):
    """An entity's baseline of one head (key: kind, entity, head), as history.Baseline walks it."""

    row = "kind string, head string, s double"
    value = "n bigint, ewma double, base double, thr double, active boolean, times array<bigint>, scores array<double>"
    out = "samples bigint, ewma double, baseline double, armed_thr double, active boolean, window_size int"

    def __init__(self, policy: dict[str, Any]) -> None:
        self.b, self.limits = policy["baselines"], policy["thresholds"]

    def step(self, value, r):
        size = int(self.b["pair_window_n"] if r["kind"] == "pair" else self.b["window_n"])
        one = Baseline(self.b, size, float(self.limits.get(r["head"], 0.75)))
        if value:
            one.n, one.ewma, one.base, one.thr, one.active = value[:5]
            one.window = list(zip(value[5], value[6]))
        one.add(r["ts"], r["s"])
        return one.n, one.ewma, one.base, one.thr, one.active, [t for t, _ in one.window], [s for _, s in one.window]

    def result(self, value):
        return (*value[:5], len(value[5]))


class Anomaly(Fold):
    """z of each row's x against the last values before it: an entity's own (peers: False), or those of other entities in a cohort."""

    row = "entity string, x double"
    value = "ids array<bigint>, entities array<string>, xs array<double>"
    out = "order_id bigint, z double"

    def __init__(self, policy: dict[str, Any], peers: bool) -> None:
        a = policy["anomaly"]
        self.peers, self.most, self.least, self.epsilon = peers, int(a["peer_window_n" if peers else "window_n"]), int(a["min_support"]), float(a["epsilon"])
        self.held = (3 if peers else 2) * self.most

    def step(self, value, r):
        ids, entities, xs = value or ([], [], [])
        return [*ids, r["id"]][-self.held :], [*entities, r["entity"]][-self.held :], [*xs, r["x"]][-self.held :]

    def results(self, value, rows):
        for r in rows:
            ids, entities, xs = value or ([], [], [])
            last = [x for i, e, x in zip(ids, entities, xs) if i != r["id"] and not (self.peers and e == r["entity"])][-self.most :]
            z = None
            if len(last) >= self.least:
                middle = _median(last)
                z = 0.6745 * (r["x"] - middle) / max(_median([abs(x - middle) for x in last]), self.epsilon)
            yield r["id"], z
            value = self.step(value, r)


def _median(xs: list[float]) -> float:
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2.0


# -- streams ------------------------------------------------------------------------------------------------------


def ordered(rows: DataFrame, keys: list[str], fold: Fold, late: int, days: int = 90, initial: DataFrame | None = None) -> DataFrame:
    """keys, newest, dropped and the fold's results. rows: keys, ts, id and the fold's row columns. initial: keys, upto (times up to it are in) and the fold's value columns."""
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    asked = rows.withColumns({"ts": F.col("ts").cast("bigint"), "id": F.col("id").cast("bigint")}).select(*dict.fromkeys([*keys, "ts", "id", *names(fold.row)]))
    out = ", ".join([*kinds, "newest bigint", "dropped bigint", fold.out])
    return asked.groupBy(*keys).transformWithState(Ordered(fold, keys, late, days), out, "Update", "processingTime", initial.groupBy(*keys) if initial is not None else None)


def windowed_orders(rows: DataFrame, keys: list[str], window: int, days: int = 30, initial: DataFrame | None = None) -> DataFrame:
    """keys, newest, orders and marked of each key: distinct orders (id) of the last `window` seconds, and how many of them are marked. initial: keys, newest, orders (id, ts, mark)."""
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    asked = rows.select(*keys, F.col("ts").cast("bigint").alias("ts"), F.col("id").cast("bigint").alias("id"), F.col("mark").cast("int").alias("mark"))
    out = ", ".join([*kinds, "newest bigint", "orders int", "marked int"])
    return asked.groupBy(*keys).transformWithState(Orders(keys, window, days), out, "Update", "processingTime", initial.groupBy(*keys) if initial is not None else None)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(df: DataFrame, root: str, key: tuple[str, ...], checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Runs a stream of states into the kept table under root by key, until what is there has been read. State lies in RocksDB; batches without rows aren't run."""
    needed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    write = sink or sinks.keyed(root, key, "newest")
    with settings(df.sparkSession, needed):
        return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
