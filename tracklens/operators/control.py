"""Control plane: review tickets, validated keyed tables, the audit trail, and the ladders that tune thresholds.

Tables in, tables out; a table is whatever the caller reads and writes. Where a key is written again the new row
replaces the old one. All markets and heads are decided by one plan, not one after the other.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import market
from ..functions.policy import BOUNDS, HEADS
from ..functions.scoring import ratio
from . import search

MARKET = ("region", "city")


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, whose reading fails with the message of the first rule that a row breaks."""
    bad = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules.items()))
    first = rows.columns[0]
    kind = rows.schema[first].dataType
    return rows.withColumn(first, F.when(bad.isNotNull(), F.raise_error(bad).cast(kind)).otherwise(F.col(first)))


def normal(rows: DataFrame, *codes: str) -> DataFrame:
    return rows.withColumns({c: market(F.col(c)) for c in codes or MARKET})


def replaced(table: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """table with rows laid over it by key; rows have one row a key."""
    return table.join(rows.select(*key), [*key], "left_anti").unionByName(rows)


# -- tickets ----------------------------------------------------------------------------------------------------


def new_tickets(reasoned: DataFrame, tickets: DataFrame, now: int) -> DataFrame:
    """Open tickets for reasoned rows (order_id, region, city, heads, sampling_reason, priority, day): one an order and day, none without heads or where there is one already."""
    once = Window.partitionBy("order_id", "day").orderBy(F.col("priority").desc(), "sampling_reason")
    rows = reasoned.where(F.size("heads") > 0).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    rows = rows.join(tickets.select("order_id", "day"), ["order_id", "day"], "left_anti")
    ticket = F.substring(F.sha2(F.concat_ws("|", F.col("order_id").cast("string"), "day"), 256), 1, 32)
    return normal(rows).select(ticket.alias("ticket_id"), "order_id", *MARKET, "heads", "sampling_reason", "priority", F.lit("open").alias("status"), "day", F.lit(now).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("labeled_at"))


def mark_labelled(tickets: DataFrame, labelled: DataFrame, now: int) -> DataFrame:
    """tickets, the open ones of labelled orders closed."""
    hit = labelled.select("order_id").distinct().withColumn("_hit", F.lit(True))
    j = tickets.join(hit, "order_id", "left").withColumn("_close", F.col("_hit").isNotNull() & (F.col("status") == "open"))
    return j.withColumns({"status": F.when(F.col("_close"), "labeled").otherwise(F.col("status")), "labeled_at": F.when(F.col("_close"), F.lit(now)).otherwise(F.col("labeled_at"))}).select(*tickets.columns)


def list_tickets(tickets: DataFrame, status: str | None = None, day: str | None = None, limit: int = 100) -> DataFrame:
    """The most urgent tickets, the newest first of equals."""
    rows = tickets.where(F.lit(True) if status is None else F.col("status") == status).where(F.lit(True) if day is None else F.col("day") == day)
    return rows.orderBy(F.col("priority").desc(), F.col("created_at").desc(), "ticket_id").limit(limit)


def day_counts(tickets: DataFrame) -> DataFrame:
    """day and n of open and labelled tickets."""
    return tickets.where(F.col("status").isin("open", "labeled")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def head_counts(tickets: DataFrame) -> DataFrame:
    """day, head and n: a ticket counts for each known head of it."""
    rows = tickets.where(F.col("status").isin("open", "labeled")).select("day", F.explode("heads").alias("head")).where(F.col("head").isin(*HEADS))
    return rows.groupBy("day", "head").agg(F.count(F.lit(1)).alias("n"))


# -- keyed tables -----------------------------------------------------------------------------------------------


def upsert_forecast(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Supply forecasts by market and interval; negative supply and a demand that isn't positive fail."""
    good = checked(normal(rows), {"supply must be >= 0": F.col("supply") >= 0, "demand must be > 0": F.col("demand") > 0})
    return replaced(table, good, (*MARKET, "start_ts", "end_ts"))


def upsert_hardgate(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Caps of enforcements by market and window."""
    good = checked(normal(rows), {"window must be hour, day or week": F.col("window").isin("hour", "day", "week"), "cap must be >= 0": F.col("cap") >= 0})
    return replaced(table, good, (*MARKET, "window"))


def record_clawback(table: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Clawbacks (region, city, ttl_minutes, reason) as of now, in place of the market's earlier one."""
    new = normal(rows).select(*MARKET, (F.lit(now) + F.col("ttl_minutes") * 60).cast("bigint").alias("until_ts"), "reason")
    return replaced(table, new, MARKET)


def save_overlay(table: DataFrame, rows: DataFrame, bounds: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Overlay values (region, city, path, value) in place of their markets' whole overlays; a value without a bound or outside of it fails."""
    limits = F.create_map(*(F.lit(x) for k, (a, b) in bounds.items() for x in (k, F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")))))
    own = F.try_element_at(limits, F.col("path"))
    good = checked(normal(rows), {"region is required": F.col("region") != "", "no bound for a path": own.isNotNull(), "value out of bounds": F.col("value").between(own["a"], own["b"])})
    return table.join(good.select(*MARKET).distinct(), [*MARKET], "left_anti").unionByName(good)


def drop_overlay(table: DataFrame, region: str, city: str = "") -> DataFrame:
    return table.where((F.col("region") != region.strip().upper()) | (F.col("city") != city.strip().upper()))


def overlay_keys(table: DataFrame) -> DataFrame:
    return table.select(*MARKET).distinct()


def newest(rows: DataFrame, at: str, limit: int, *tie: str) -> DataFrame:
    """The newest rows of a store: forecasts, audit entries, metrics, runs, outcomes."""
    return rows.orderBy(F.col(at).desc(), *tie).limit(limit)


def recoverability_of(table: DataFrame, region: str, city: str) -> DataFrame:
    return table.where((F.col("region") == region.strip().upper()) & (F.col("city") == city.strip().upper()))


# -- audit ------------------------------------------------------------------------------------------------------


def audit_rows(decisions: DataFrame, actor: str, now: int) -> DataFrame:
    """Audit entries (at, actor, action, region, city, path, decision, reason) of decisions; appended, never changed."""
    return normal(decisions).select(F.lit(now).cast("bigint").alias("at"), F.lit(actor).alias("actor"), "action", *MARKET, F.concat(F.lit("thresholds."), F.col("head")).alias("path"), "decision", "reason")


def last_applied(audit: DataFrame, most: int = 20) -> DataFrame:
    """Each market's and path's last apply among the market's `most` newest ones."""
    w = Window.partitionBy(*MARKET).orderBy(F.col("at").desc(), "path")
    recent = audit.where("action = 'apply'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return recent.groupBy(*MARKET, "path").agg(F.max("at").alias("applied_at"))


# -- tuning -----------------------------------------------------------------------------------------------------


def markets_of(assessments: DataFrame) -> DataFrame:
    """Markets with a region, and when each was first seen."""
    return normal(assessments).where("region <> ''").groupBy(*MARKET).agg(F.min("assessed_at").alias("first_seen"))


def projected_flags(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """projected of each (region, city, head, grid_idx): scores from the candidate threshold on. Rows are counted by grid cell first."""
    t = F.array(*map(F.lit, thresholds))
    counted = scores.groupBy(*MARKET, "head", F.size(F.filter(t, lambda x: x <= F.col("score"))).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.select(*MARKET, "head", "cell", "n", F.posexplode(t).alias("grid_idx", "threshold"))
    return each.groupBy(*MARKET, "head", "grid_idx").agg(F.sum(F.when(F.col("cell") > F.col("grid_idx"), F.col("n")).otherwise(0)).cast("bigint").alias("projected"))


def heads_frame(df: DataFrame) -> DataFrame:
    """The three heads, one a row."""
    return df.sparkSession.createDataFrame([(h,) for h in HEADS], "head string")


def tuned_overlays(table: DataFrame, values: DataFrame) -> DataFrame:
    """The overlay table after tuning set values (region, city, path, value); a market's other values stay."""
    return replaced(table, values.select(*MARKET, "path", "value"), (*MARKET, "path"))


def caps_left(projected: DataFrame, caps: DataFrame) -> DataFrame:
    """projected (region, city, projected) against the first cap that the market has of hour, day and week: within, and which cap is breached."""
    of = lambda w: F.max(F.when(F.col("window") == w, F.col("cap")))
    one = caps.groupBy(*MARKET).agg(of("hour").alias("hour"), of("day").alias("day"), of("week").alias("week"))
    which = F.when(F.col("hour").isNotNull(), "hour").when(F.col("day").isNotNull(), "day").when(F.col("week").isNotNull(), "week")
    cap = F.coalesce("hour", "day", "week")
    return projected.join(one, [*MARKET], "left").select(*MARKET, "projected", (cap.isNull() | (F.col("projected") <= cap)).alias("within"), F.when(F.col("projected") > cap, F.concat(F.lit("breaches_"), which, F.lit("_cap"))).alias("breach"))


# -- reports ----------------------------------------------------------------------------------------------------


def ear_delta(learned: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """Static against learned recoverability of each market (region) and head of (region, head, value, n_updates), and whether the market is ready to apply it."""
    e = policy["ear"]
    static = F.create_map(*(F.lit(x) for h in HEADS for x in (h, float(e["recoverability"][h]))))
    ready = F.col("n_updates") >= int(e["min_updates_apply"])
    w = Window.partitionBy("region")
    out = learned.withColumns({"static": static[F.col("head")], "apply_ready": ready})
    out = out.withColumn("market_ready", F.min(F.when(F.col("n_updates") > 0, F.col("apply_ready"))).over(w))
    return out.select("region", "head", "static", F.col("value").alias("learned"), (F.col("value") - F.col("static")).alias("delta"), "n_updates", "apply_ready", F.coalesce("market_ready", F.lit(False)).alias("market_ready"), F.when(F.col("apply_ready"), F.col("value")).otherwise(F.col("static")).alias("would_use"))


def presence_counts(df: DataFrame, *columns: str) -> DataFrame:
    """field, class, n, share of each class; blank counts as unknown."""
    known = lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", "unknown").otherwise(F.trim(F.col(c)))
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), known(c).alias("class")) for c in columns))))
    g = long.groupBy("field", "class").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field")))


def strata_report(rows: DataFrame) -> DataFrame:
    """n and mean offline score of each stratum of (stratum, score)."""
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def train_quality(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """precision, recall and mean absolute error of each head of (head, label, predicted)."""
    y, p = F.col("label") >= 0.5, F.col("predicted") >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = rows.groupBy("head").agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), F.avg(F.abs(F.col("label") - F.col("predicted"))).alias("mae"))
    return g.select("head", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "mae")


def infer_head(scores: dict[str, Column], flags: dict[str, Column]) -> Column:
    """The head with the highest score among the flagged ones, among all if none is; the first of equals."""
    any_ = F.lit(False)
    for h in HEADS:
        any_ = any_ | (flags[h] == 1)
    items = F.array(*(F.struct(F.when(any_ & (flags[h] != 1), F.lit(-1.0)).otherwise(scores[h]).alias("s"), F.lit(-k).alias("k"), F.lit(h).alias("h")) for k, h in enumerate(HEADS)))
    return F.array_max(items)["h"]
