"""Entity history: trailing windows, chains, device graph, chat, last-n histories and keyed folds.

Times are whole seconds since 1970. Trailing windows are range frames over an entity's rows; folds are
aggregates over an entity's rows in (ts, order) order, so their result doesn't depend on arrival.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import clip, let

DAY = 86400


# -- marketplace funnel -----------------------------------------------------------------------------------------


def entities(driver: Column, user: Column) -> Column:
    """Entity keys of an order: its driver, and with a user also the user and the pair."""
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("entity"))
    d, u = driver.cast("string"), user.cast("string")
    with_user = F.array(one("user", F.concat(F.lit("user:"), u)), one("pair", F.concat(F.lit("pair:"), d, F.lit(":"), u)))
    return F.concat(F.array(one("driver", F.concat(F.lit("driver:"), d))), F.when(user.isNotNull(), with_user).otherwise(F.array().cast("array<struct<kind:string,entity:string>>")))


def funnel_rates(a: Column, c: Column, k: Column, w: Column) -> dict[str, Column]:
    """accept_cancel_rate, completion_rate and with_cause_fraction of counts; without cancels every cancel has a cause."""
    one = F.lit(1)
    return {"accept_cancel_rate": c / F.greatest(a, one), "completion_rate": k / F.greatest(k + c, one), "with_cause_fraction": F.when(c == 0, 1.0).otherwise(F.least(F.greatest(w, F.lit(0)), c) / F.greatest(c, one))}


def market_signals(a: Column, c: Column, k: Column, w: Column, policy: dict[str, Any]) -> Column:
    b = policy["abuse"]
    r, n = funnel_rates(a, c, k, w), b["marketplace_min_support"]
    acr, cr, wcf = r["accept_cancel_rate"], r["completion_rate"], r["with_cause_fraction"]
    thr = b["accept_cancel_rate_threshold"]
    least = round(thr * 0.8, 12)  # 0.36 for 0.45, as decimals have it: the product of doubles is a little more, which 9 of 25 don't reach
    return F.array_compact(
        F.array(
            F.when((a >= n) & (acr >= thr), "high_accept_cancel_rate"),
            F.when((k + c >= n) & (cr <= b["completion_rate_floor"]), "low_completion_rate"),
            F.when((c >= n) & (wcf <= b["with_cause_fraction_floor"]) & (acr >= least), "cancel_without_cause_heavy"),
        )
    )


def latest_events(events: DataFrame) -> DataFrame:
    """One row for each (entity, order, kind): the last one; of equally late ones that with a cause."""
    w = Window.partitionBy("driver_id", "order_id", "kind").orderBy(F.col("ts").desc(), F.col("with_cause").desc_nulls_last(), F.xxhash64(*events.columns))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def funnel_totals(events: DataFrame, by: list[str], policy: dict[str, Any]) -> DataFrame:
    """accepts, cancels, completes, with_cause, rates and signals of each group; one exchange after a partial aggregate."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(kind + "s")
    g = events.groupBy(*by).agg(n("accept"), n("cancel"), n("complete"), F.sum(F.when((F.col("kind") == "cancel") & F.col("with_cause"), 1).otherwise(0)).alias("with_cause"))
    cols = [F.col(x) for x in ("accepts", "cancels", "completes", "with_cause")]
    return g.withColumns(funnel_rates(*cols)).withColumn("signals", market_signals(*cols, policy))


def trailing_funnel(events: DataFrame, window_s: int, policy: dict[str, Any], entity: str = "driver_id") -> DataFrame:
    """For each cancel: counts of the entity's window_s seconds up to it without the order's own rows, rates, signals, cancels an hour."""
    w = Window.partitionBy(entity).orderBy("ts").rangeBetween(-window_s, 0)
    own = Window.partitionBy(entity, "order_id").orderBy("ts").rangeBetween(-window_s, 0)
    c = lambda kind, cause=False: F.when((F.col("kind") == kind) & (F.col("with_cause") if cause else F.lit(True)), 1).otherwise(0)
    count = lambda x: (F.sum(x).over(w) - F.sum(x).over(own)).cast("bigint")
    out = events.withColumns({"accepts": count(c("accept")), "cancels": count(c("cancel")), "completes": count(c("complete")), "with_cause_n": count(c("cancel", True))}).where("kind = 'cancel'")
    cols = [F.col(x) for x in ("accepts", "cancels", "completes", "with_cause_n")]
    out = out.withColumns(funnel_rates(*cols)).withColumn("market_signals", market_signals(*cols, policy))
    return out.withColumn("cancel_rate", F.col("cancels") / F.greatest(F.lit(window_s / 3600.0), F.lit(1.0)))


def trailing(asks: DataFrame, rows: DataFrame, by: list[str], window_s: int, counts: dict[str, Column]) -> DataFrame:
    """asks (order_id, at, and the key columns) with, for each name of counts, the key's rows (order_id, ts, key columns) of the window_s seconds up to it where that holds, without the order's own.

    A key's rows are laid out by stretches of window_s seconds, each with the one before, so a hot key is many tasks.
    """
    flags = [F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in counts.items()]
    home = F.floor(F.col("_t") / window_s)
    a = asks.select("order_id", *by, F.col("at").alias("_t"), F.lit(True).alias("_ask"), *(F.lit(0).alias(n) for n in counts)).withColumn("_s", home)
    r = rows.select("order_id", *by, F.col("ts").alias("_t"), F.lit(False).alias("_ask"), *flags).withColumn("_s", F.explode(F.array(home, home + 1)))
    w = Window.partitionBy(*by, "_s").orderBy("_t").rangeBetween(-window_s, 0)
    own = Window.partitionBy(*by, "_s", "order_id").orderBy("_t").rangeBetween(-window_s, 0)
    out = a.unionByName(r).withColumns({f"_{n}": (F.sum(n).over(w) - F.sum(n).over(own)).cast("bigint") for n in counts}).where("_ask")
    return asks.join(out.select("order_id", *(F.col(f"_{n}").alias(n) for n in counts)), "order_id")


def chain_counts(cancels: DataFrame, window_s: int) -> DataFrame:
    """chain: distinct other orders that the driver cancelled in the window_s seconds up to each cancel."""
    w = Window.partitionBy("driver_id").orderBy("ts").rangeBetween(-window_s, 0)
    return cancels.withColumn("chain", F.size(F.array_except(F.collect_set("order_id").over(w), F.array("order_id"))))


# -- device graph -----------------------------------------------------------------------------------------------


def edge_state(edges: DataFrame) -> DataFrame:
    """sightings, first_seen and last_seen of each (device, kind, entity)."""
    return edges.groupBy("device_id", "entity_kind", "entity_id").agg(F.count(F.lit(1)).alias("sightings"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def graph_signals(asks: DataFrame, edges: DataFrame, as_of: int, policy: dict[str, Any]) -> DataFrame:
    """asks (order_id, device_id, driver_id, user_id) with graph_signals and graph_counts, the device graph's for device and driver and, where both were seen on the device, shared_device_pair."""
    g = device_graph(edges, as_of, policy).select("device_id", "driver_id", F.col("signals").alias("_g"))
    pair = shared_pairs(edges, asks.where("user_id is not null"), as_of, policy).select("device_id", "driver_id", "user_id", F.lit("shared_device_pair").alias("_p"))
    j = asks.join(g, ["device_id", "driver_id"], "left").join(pair, ["device_id", "driver_id", "user_id"], "left")
    return j.select("order_id", F.array_compact(F.concat(F.coalesce("_g", F.array().cast("array<string>")), F.array("_p"))).alias("graph_signals"))


def device_graph(edges: DataFrame, as_of: int, policy: dict[str, Any]) -> DataFrame:
    """For each device and driver on it: counts over edges of the last days, and the signals they give. Aggregates and equi-joins only."""
    g = policy["device_graph"]
    live = edge_state(edges.where(F.col("ts") <= as_of)).where(F.col("last_seen") >= as_of - g["window_days"] * DAY)
    n = lambda kind: F.sum(F.when(F.col("entity_kind") == kind, 1).otherwise(0))
    s = lambda kind: F.sum(F.when(F.col("entity_kind") == kind, F.col("sightings")).otherwise(0))
    device = live.groupBy("device_id").agg(n("driver").alias("drivers"), n("user").alias("users"), s("driver").alias("driver_sightings"), s("user").alias("user_sightings"))
    driver = live.where("entity_kind = 'driver'").groupBy(F.col("entity_id").alias("driver_id")).agg(F.count(F.lit(1)).alias("devices"), F.sum("sightings").alias("device_sightings"))
    pair = live.where("entity_kind = 'driver'").select("device_id", F.col("entity_id").alias("driver_id"))
    out = pair.join(device, "device_id").join(driver, "driver_id")
    k = g["min_support"]
    return out.withColumn(
        "signals",
        F.array_compact(
            F.array(
                F.when((F.col("driver_sightings") + F.col("user_sightings") >= k) & (F.col("drivers") >= g["max_drivers_per_device"]), "multi_account_device"),
                F.when((F.col("driver_sightings") + F.col("user_sightings") >= k) & (F.col("users") >= g["max_users_per_device"]), "multi_user_device"),
                F.when((F.col("device_sightings") >= k) & (F.col("devices") >= g["max_devices_per_driver"]), "device_hopping"),
            )
        ),
    )


def shared_pairs(edges: DataFrame, pairs: DataFrame, as_of: int, policy: dict[str, Any]) -> DataFrame:
    """(device, driver, user) of the asked pairs (driver_id, user_id) seen on the same device in the last days, each at least so often."""
    g = policy["device_graph"]
    live = edge_state(edges.where(F.col("ts") <= as_of)).where((F.col("last_seen") >= as_of - g["window_days"] * DAY) & (F.col("sightings") >= g["shared_pair_min_sightings"]))
    d = live.where("entity_kind = 'driver'").select("device_id", F.col("entity_id").alias("driver_id"))
    u = live.where("entity_kind = 'user'").select("device_id", F.col("entity_id").alias("user_id"))
    return pairs.select("driver_id", "user_id").distinct().join(d, "driver_id").join(u, ["device_id", "user_id"])


# -- chat -------------------------------------------------------------------------------------------------------


def merge_chat(signals: DataFrame) -> DataFrame:
    """One row for each order: flags joined by or, the highest score, the first source, the last time."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return signals.groupBy("order_id").agg(F.min_by("driver_id", "ts").alias("driver_id"), flag("persuasion"), flag("cash"), flag("forced"), F.max("score").alias("score"), F.min_by("source", "ts").alias("source"), F.max("ts").alias("ts"))


def risky_chats(chats: DataFrame, window_s: int, least: float) -> DataFrame:
    """repeats: the driver's earlier chats (one an order) of the last window_s seconds with at least so much risk, itself not among them."""
    found = trailing(chats.select("order_id", "driver_id", F.col("ts").alias("at")), chats, ["driver_id"], window_s, {"repeats": F.col("risk") >= least})
    return chats.join(found.select("order_id", "repeats"), "order_id")


# -- folds ------------------------------------------------------------------------------------------------------


def memory(alpha: float) -> int:
    """Rows after which a moving average has forgotten what was before, to the last digit of a double."""
    return 1 if alpha >= 1 else int(math.ceil(math.log(1e-17) / math.log(1 - alpha)))


def folded(rows: DataFrame, keys: list[str], x: str, alpha: float, start: Column | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """value (moving average, the first x or `start` to begin with), n and the last x of each key, in `order`.

    Only a key's last rows count, as many as the average remembers; they are picked before the exchange, so a key with
    very many rows makes no long array.
    """
    rows = rows.where(F.col(x).isNotNull())
    count = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    late = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= memory(alpha))
    begin = (start if start is not None else F.lit(None)).cast("double")
    g = late.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(x).cast("double").alias("x")))).alias("h")).withColumn("start", begin)
    fold = F.aggregate("h", F.col("start"), lambda v, r: F.when(v.isNull(), r["x"]).otherwise(alpha * r["x"] + (1 - alpha) * v))
    return g.join(count, keys).select(*keys, fold.alias("value"), "n", F.element_at("h", -1)["x"].alias("last_x"))


def previous_average(rows: DataFrame, key: str, x: str, alpha: float, order: tuple[str, str]) -> DataFrame:
    """rows with prev, the key's moving average before each row by order (seconds, id); null before the first.

    Keys are cut into stretches that start with as many rows of the one before as the average remembers.
    """
    n = memory(alpha)
    placed = stretches(rows.withColumns({"_ts": F.col(order[0]), "_id": F.col(order[1])}), key, n, ("_ts", "_id"))
    before = F.collect_list(F.col(x).cast("double")).over(Window.partitionBy(key, "_s").orderBy("_ts", "_id").rowsBetween(-n, -1))
    fold = F.aggregate("_h", F.lit(None).cast("double"), lambda v, y: F.when(v.isNull(), y).otherwise(alpha * y + (1 - alpha) * v))
    return placed.withColumn("_h", before).where("_own").withColumn("prev", fold).select(*rows.columns, "prev")


def device_states(rows: DataFrame, alpha: float) -> DataFrame:
    """rows (device_id, order_id, ts, instant, told) with ewma_risk after each: the device's moving average from the first row on that told of a risk; 0 before. A device is cut into stretches."""
    n = memory(alpha)
    first = rows.where("told").groupBy("device_id").agg(F.min(F.struct("ts", "order_id")).alias("_first"))
    begun = rows.join(first, "device_id", "left").withColumn("_b", F.struct("ts", "order_id") >= F.col("_first")).drop("_first")
    placed = stretches(begun, "device_id", n)
    late = F.collect_list(F.when(F.col("_b"), F.col("instant"))).over(Window.partitionBy("device_id", "_s").orderBy("ts", "order_id").rowsBetween(-n, 0))
    fold = F.aggregate("_h", F.lit(None).cast("double"), lambda v, y: F.when(v.isNull(), y).otherwise(alpha * y + (1 - alpha) * v))
    return placed.withColumn("_h", late).where("_own").withColumn("ewma_risk", F.coalesce(fold, F.lit(0.0))).select(*rows.columns, "ewma_risk")


def outcome_signal(outcome: Column) -> Column:
    """1 for won, blocked and actioned, 0 for lost; an unknown outcome fails."""
    return F.when(outcome.isin("clawback_won", "payout_blocked", "account_actioned"), 1.0).when(outcome == "clawback_lost", 0.0).otherwise(F.raise_error(F.concat(F.lit("unknown outcome: "), F.coalesce(outcome, F.lit("null")))).cast("double"))


def recoverability(outcomes: DataFrame, policy: dict[str, Any], keys: tuple[str, ...] = ("region", "head")) -> DataFrame:
    """Learned recoverability of each market and head: repeated outcomes count once, the fold starts at the static value."""
    e = policy["ear"]
    once = outcomes.dropDuplicates(["order_id", "outcome", "ts"]).withColumn("signal", outcome_signal(F.col("outcome")))
    table = F.create_map(*(F.lit(x) for k, v in e["recoverability"].items() for x in (k, float(v))))
    t = folded(once, [*keys], "signal", float(e["outcome_ewma_alpha"]), table[F.col("head")], ("ts", "order_id"))
    return t.select(*keys, clip(F.col("value")).alias("value"), F.col("n").alias("n_updates"))


def mad_z(x: Column, sample: Column, epsilon: float) -> Column:
    """Modified z-score of x against a sample array; null without one."""
    spread = lambda s, med: let(F.array_sort(F.transform(s, lambda v: F.abs(v - med))), _median)
    z = let(F.array_sort(sample), lambda s: let(_median(s), lambda med: 0.6745 * (x - med) / F.greatest(spread(s, med), F.lit(epsilon))))
    return F.when(F.size(sample) > 0, z)


def _median(s: Column) -> Column:
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


#: Rows of a stretch, without what it takes over from the one before.
STRETCH = 20_000


def stretches(rows: DataFrame, by: str, before: int, order: tuple[str, str] = ("ts", "order_id")) -> DataFrame:
    """rows by order (seconds, id) in stretches `_s` of each key, every stretch with the `before` rows ahead of it too; `_own` marks a row's own stretch.

    A row's place in its key is its place in the day plus the days' counts so far, so no task sorts a whole key.
    """
    ts = order[0]
    days = rows.groupBy(by, F.floor(F.col(ts) / DAY).alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    days = days.select(by, "_day", (F.sum("_c").over(Window.partitionBy(by).orderBy("_day")) - F.col("_c")).alias("_first"))
    placed = rows.withColumn("_day", F.floor(F.col(ts) / DAY)).withColumn("_k", F.row_number().over(Window.partitionBy(by, "_day").orderBy(*order)) - 1)
    # merged, as a broadcast would leave the rows dealt by the bare key
    placed = placed.join(days.hint("merge"), [by, "_day"]).withColumn("_p", F.col("_first") + F.col("_k"))
    home, later = F.floor(F.col("_p") / STRETCH), F.floor((F.col("_p") + before) / STRETCH)
    return placed.withColumn("_s", F.explode(F.sequence(home, later))).withColumn("_own", F.col("_s") == home).drop("_day", "_k", "_first", "_p")


def anomalies(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """rows (entity, cohort, order_id, ts, x) with z_self, z_peer, signals: x against the entity's last values and its cohort's.

    Own values: of the last 2n rows before, those of other orders, n at most. Peers: of the cohort's last 3m
    rows before, those of other entities and orders, m at most. Frames are bounded, and entities and cohorts are cut
    into stretches that start with as many rows of the one before (see stretches), so a hot one is many tasks.
    """
    a = policy["anomaly"]
    n, m = int(a["window_n"]), int(a["peer_window_n"])
    df = against(rows, "entity", 2 * n, n, False, policy, "z_self")
    df = against(df, "cohort", 3 * m, m, True, policy, "z_peer")
    t = float(a["z_threshold"])
    return df.withColumn("signals", F.array_compact(F.array(F.when(F.col("z_self") >= t, "anomaly_self"), F.when(F.col("z_peer") >= t, "anomaly_peer"))))


def against(rows: DataFrame, by: str, frame: int, most: int, peers: bool, policy: dict[str, Any], out: str) -> DataFrame:
    """rows with their modified z-score `out` against up to `most` of the `frame` rows before in their key, those of other orders and for peers of other entities too; null below the least support.

    Stretches are walked in order over Arrow batches; the rows of a frame are held from batch to batch, medians are taken of many rows at once.
    """
    least, epsilon = max(1, int(policy["anomaly"]["min_support"])), float(policy["anomaly"]["epsilon"])
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    placed = stretches(rows, by, frame).repartition(F.col(by), F.col("_s")).sortWithinPartitions(by, "_s", "ts", "order_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            part = [*dict.fromkeys([by, "_s", "entity", "order_id", "x"])]
            both = new.select(part) if held is None else pa.concat_tables([held, new.select(part)])
            skip = both.num_rows - new.num_rows
            held = both.slice(max(0, both.num_rows - frame))
            code = lambda c: both.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            key, stretch, entity, order = code(by), both.column("_s").to_numpy(), code("entity"), code("order_id")
            x = both.column("x").to_numpy().astype(np.float64)
            new_ = np.concatenate([[True], (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])]) if len(x) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(new_, np.arange(len(x)), 0))
            own = new.column("_own").to_numpy()
            mine = np.flatnonzero(own) + skip
            z = np.full(len(mine), np.nan)
            for k in range(0, len(mine), 2000):
                i = mine[k : k + 2000]
                at = i[:, None] - np.arange(1, frame + 1)[None, :]
                counts = at >= begin[i][:, None]
                at = np.maximum(at, 0)
                counts &= order[at] != order[i][:, None]
                if peers:
                    counts &= entity[at] != entity[i][:, None]
                counts &= np.cumsum(counts, axis=1) <= most
                n, values = counts.sum(axis=1), x[at]
                line, left, right = np.arange(len(i)), np.maximum(n - 1, 0) // 2, np.minimum(n // 2, frame - 1)

                def middle(v: np.ndarray) -> np.ndarray:
                    v = np.sort(np.where(counts, v, np.inf), axis=1)  # noqa: B023
                    return (v[line, left] + v[line, right]) / 2.0  # noqa: B023

                with np.errstate(invalid="ignore"):
                    med = middle(values)
                    one = 0.6745 * (x[i] - med) / np.maximum(middle(np.abs(values - med[:, None])), epsilon)
                z[k : k + 2000] = np.where(n >= least, one, np.nan)
            found = new.select(names).filter(pa.array(own)).append_column(out, pa.array(z, type=pa.float64(), mask=np.isnan(z)))
            yield from found.combine_chunks().to_batches()

    return placed.select(*names, "_s", "_own").mapInArrow(run, schema)


def order_anomalies(rows: DataFrame, features: list[str], policy: dict[str, Any]) -> DataFrame:
    """order_id, anomaly_signals (in the order they first occur over the features) and anomaly_top (the highest z) of rows (order_id, entity, cohort, ts, a column a feature).

    Null features are neither judged nor remembered; a row without entity or cohort has nobody to be held against.
    """
    parts = F.array(*(F.struct(F.lit(k).alias("f"), F.col(n).cast("double").alias("x")) for k, n in enumerate(features)))
    alone = F.concat(F.lit("row|"), F.col("order_id").cast("string"))
    key = lambda c: F.coalesce(F.concat(F.col("f").cast("string"), F.lit("|"), F.col(c)), alone).alias(c)
    long = rows.select("order_id", "ts", "entity", "cohort", F.inline(parts)).where("x is not null").select("order_id", "ts", "f", "x", key("entity"), key("cohort"))
    g = anomalies(long, policy).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("f", "signals"))).alias("s"), F.max(F.greatest("z_self", "z_peer")).alias("anomaly_top"))
    return g.select("order_id", F.array_distinct(F.flatten(F.transform("s", lambda v: v["signals"]))).alias("anomaly_signals"), "anomaly_top")


# -- entity baselines -------------------------------------------------------------------------------------------


class Baseline:
    """One entity's state for one head, score by score."""

    def __init__(self, b: dict[str, Any], size: int, live: float) -> None:
        self.b, self.size, self.live = b, max(1, size), live
        self.window: list[tuple[int, float]] = []
        self.n, self.ewma, self.base, self.thr, self.active = 0, 0.0, None, None, False

    def add(self, ts: int, s: float) -> None:
        b = self.b
        self.window = [x for x in [*self.window, (ts, s)] if x[0] >= ts - int(b["max_age_days"]) * DAY][-self.size :]
        self.ewma = s if not self.n else b["ewma_alpha"] * s + (1 - b["ewma_alpha"]) * self.ewma
        self.n += 1
        limit = self.live if self.base is None else self.thr
        low = [x for _, x in self.window if x < limit]
        full, many = len(self.window) >= self.size, self.n >= int(b["min_ewma_samples"])
        if (full and len(low) / self.size >= b["under_fraction"]) or (many and self.ewma < limit - b["ewma_delta"]):
            candidate = reduce(add, low) / len(low) if low else self.ewma  # added one by one, as a query does; sum() compensates
            # armed once; later only a clearly lower candidate counts
            if self.base is None or candidate < self.base - b["refresh_epsilon"]:
                self.base, self.thr = candidate, self.live
        above = None if self.base is None else self.base + b["above_epsilon"]
        self.active = above is not None and many and self.ewma > above and full and sum(x > above for _, x in self.window) / self.size >= b["above_fraction"]


def baseline_steps(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """rows (kind, entity, head, order_id, ts, s) with samples, ewma, baseline, armed_thr, active, window_size after each; rows without a kind pass through.

    A score joins the window, which drops rows older than the age limit and beyond the length; the moving average
    follows. An entity that stays under the threshold is armed, once, with a baseline; later candidates can only lower
    it. An entity is active for discounts while it stays above its baseline. States depend on all scores before, so an
    entity's are walked in order, one at a time, by the task that has them; nothing but its window is held.
    """
    b, limits = policy["baselines"], policy["thresholds"]
    more = (("samples", "bigint"), ("ewma", "double"), ("baseline", "double"), ("armed_thr", "double"), ("active", "boolean"), ("window_size", "int"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in more)])
    split = F.coalesce(F.concat_ws("|", "kind", "entity", "head"), F.lit(""))
    dealt = rows.withColumn("_d", F.when(F.col("kind").isNull(), F.xxhash64("order_id")).otherwise(F.xxhash64(split)))
    dealt = dealt.repartition("_d").sortWithinPartitions("kind", "entity", "head", "ts", "order_id").drop("_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("kind", "entity", "head", "ts", "s")}
            out: list[list[Any]] = [[] for _ in more]
            for kind, entity, head, ts, s in zip(*col.values(), strict=True):
                if kind is None or s is None:
                    found: tuple = (None,) * len(more)
                else:
                    if at != (kind, entity, head):
                        at, state = (kind, entity, head), Baseline(b, int(b["pair_window_n"] if kind == "pair" else b["window_n"]), float(limits.get(head, 0.75)))
                    state.add(ts, s)
                    found = (state.n, state.ewma, state.base, state.thr, state.active, len(state.window))
                for o, v in zip(out, found, strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=[*batch.schema.names, *(n for n, _ in more)])

    return dealt.mapInArrow(run, schema)


def baseline_state(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """State of each (kind, entity, head) after its last score."""
    steps = baseline_steps(rows, policy)
    last = F.max(F.struct("samples", "ewma", "baseline", "armed_thr", "active", "window_size")).alias("v")
    g = steps.groupBy("kind", "entity", "head").agg(last)
    return g.select("kind", "entity", "head", "v.*", F.col("v.armed_thr").isNotNull().alias("armed"))


def baseline_modes(policy: dict[str, Any]) -> dict[str, str]:
    """Mode of each head whose baselines count."""
    from ..functions.policy import HEADS, section

    if policy["baselines"]["mode"] == "off":
        return {}
    modes = {h: section(policy, h, "mode") for h in HEADS if policy["baselines"]["heads"].get(h, {}).get("enabled", True)}
    return {h: m for h, m in modes.items() if m != "off"}


def active_baselines(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """order_id and on_<head> of rows (order_id, driver_id, user_id, ts, score_<head>): the active baselines of the order's entities, the pair's first, then the driver's and the user's, after they took the order's scores in."""
    heads = list(baseline_modes(policy))
    score = F.array(*(F.struct(F.lit(h).alias("head"), F.col(f"score_{h}").alias("s")) for h in heads))
    each = rows.select("order_id", "ts", F.inline(entities(F.col("driver_id"), F.col("user_id"))), score.alias("_s")).select("order_id", "ts", "kind", "entity", F.inline("_s"))
    rank = F.when(F.col("kind") == "pair", 0).when(F.col("kind") == "driver", 1).otherwise(2)
    on = lambda h: F.array_sort(F.collect_list(F.when(F.col("head") == h, F.struct(rank.alias("k"), "kind", "baseline", "armed_thr")))).alias(f"on_{h}")
    return baseline_steps(each, policy).where("active").groupBy("order_id").agg(*map(on, heads))


def with_baselines(df: DataFrame, found: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """df with its scores discounted and baseline_reasons, by active_baselines().

    Of an order's active entities the first one's baseline gives the band; a score strictly inside of it is discounted
    where the head's mode is apply, and only noted where it is shadow.
    """
    from ..functions.policy import section

    modes = baseline_modes(policy)
    if not modes:
        return df.withColumn("baseline_reasons", F.array().cast("array<string>"))
    df = df.join(found, "order_id", "left")
    eps = float(policy["baselines"]["above_epsilon"])
    first = lambda h, c: F.get(F.col(f"on_{h}"), 0)[c]
    band = {h: F.coalesce((F.col(f"score_{h}") > first(h, "baseline") + eps) & (F.col(f"score_{h}") < first(h, "armed_thr")), F.lit(False)) for h in modes}

    def notes(h: str) -> Column:
        word = F.lit("baseline_discount:" if modes[h] == "apply" else "baseline_shadow:")
        return F.when(band[h], F.transform(f"on_{h}", lambda x: F.concat(word, x["kind"]))).otherwise(F.array().cast("array<string>"))

    cut = {f"score_{h}": F.when(band[h], clip(F.col(f"score_{h}") * float(section(policy, h, "discount")))).otherwise(F.col(f"score_{h}")) for h in modes if modes[h] == "apply"}
    return df.withColumns({"baseline_reasons": F.array_distinct(F.concat(*map(notes, modes))), **cut}).drop(*(f"on_{h}" for h in modes))


def baseline_query(states: DataFrame, where: list[Column], after: int | None = None, limit: int = 100) -> DataFrame:
    """States that meet all conditions, updated after a cursor if one is given, the last updated first; 1 to 5000 of them."""
    for c in where:
        states = states.where(c)
    if after is not None:
        states = states.where(F.col("updated_at") > after)
    return states.orderBy(F.col("updated_at").desc(), "entity").limit(max(1, min(5000, limit)))
