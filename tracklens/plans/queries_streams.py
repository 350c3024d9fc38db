"""Registered queries of live states: streams over the given tables' events, stopped and started again, against the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.policy import DEFAULTS
from ..operators import history
from ..sources import fixtures
from ..sources.kept import KeptTable
from ..sources.shared import fresh_dir
from ..streaming import states
from . import queries_history as batch
from .queries_tracks import ORACLE as TRACKS
from .queries_tracks import r6
from .twins import on_views

QUERIES, ORACLE = {}, {}
WEEK = 7 * 86400
#: Parts of the time that arrive one after the other.
PARTS = 3
#: Rows of all parts for each file of a part, which many tasks write and read.
ROWS = 500_000


def register(name: str, sql: str | None = None, same_as: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql or same_as:
            ORACLE[name] = on_views(sql) if sql else (batch.ORACLE | TRACKS)[same_as]
        return f

    return keep


def arrived(spark, rows, key: tuple[str, ...], stream):
    """The kept table of a stream's results over rows (with ts and id), which come in PARTS + 2 batches: a fifth of the rows a
    part late, a seventh twice. After the second batch the stream is stopped and started again. stream: (live rows, seconds
    that rows come late at most) -> DataFrame."""
    root = fresh_dir(spark, "live")
    low, high, n = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    files = max(1, n // ROWS)
    width = (high - low) // PARTS + 1
    part = F.floor((F.col("ts") - low) / width).cast("int") + F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, 1).otherwise(0)
    again = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)) == 0, F.array(part, part + 1)).otherwise(F.array(part))
    dealt = rows.withColumn("_part", F.explode(again)).persist()
    for k in range(PARTS + 2):
        dealt.where(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(f"{root}/in")
        if k in (1, PARTS + 1):
            live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
            states.start(stream(live, 3 * width), f"{root}/table", key, f"{root}/checkpoint").awaitTermination()
    dealt.unpersist()
    return KeptTable(spark, f"{root}/table", key, "newest").read()


@register("live_devices", same_as="device_ewma")
def live_devices(spark, sf_dir):
    rows = fixtures.device_risks(spark, sf_dir).select("device_id", "ts", F.col("event_id").alias("id"), F.col("risk").alias("instant"), F.lit(True).alias("told"), (F.col("event_id") % 9).alias("driver_id"), F.lit(None).cast("bigint").alias("user_id"))
    t = arrived(spark, rows, ("device_id",), lambda live, late: states.ordered(live, ["device_id"], states.Device(DEFAULTS["device_integrity"]["ewma_alpha"]), late))
    return t.select("device_id", r6("ewma_risk"), "sightings", r6("last_instant"))


@register("live_outcomes", same_as="recoverability_ewma")
def live_outcomes(spark, sf_dir):
    e = DEFAULTS["ear"]
    rows = fixtures.outcomes(spark, sf_dir).select("region", "head", "ts", F.col("order_id").alias("id"), history.outcome_signal(F.col("outcome")).alias("x"))
    t = arrived(spark, rows, ("region", "head"), lambda live, late: states.ordered(live, ["region", "head"], states.Recoverability(float(e["outcome_ewma_alpha"]), e["recoverability"]), late))
    return t.select("region", "head", r6("value"), F.col("n").alias("n_updates"))


_CHATS = "SELECT driver_id * 100 + event_id % 7 AS order_id, any_value(driver_id) AS driver_id, bool_or(event_type = 'view') AS persuasion, bool_or(event_type = 'click') AS cash, bool_or(event_type = 'error') AS forced, max(least(1.0, value / 1000.0)) AS score, max(ts) AS ts FROM v_events GROUP BY 1"


@register("live_chats", f"SELECT order_id, driver_id, persuasion, cash, forced, round(score, 6) AS score, ts FROM ({_CHATS})")
def live_chats(spark, sf_dir):
    rows = batch.raw_chats(spark, sf_dir)
    t = arrived(spark, rows, ("order_id",), lambda live, late: states.ordered(live, ["order_id"], states.Chat(), late, days=30))
    return t.select("order_id", "driver_id", "persuasion", "cash", "forced", r6("score"), F.col("newest").alias("ts"))


@register("live_chat_repeats", f"c AS (SELECT driver_id, event_id, ts, greatest(least(1.0, value / 1000.0), CASE event_type WHEN 'error' THEN 0.9 WHEN 'click' THEN 0.85 WHEN 'view' THEN 0.7 ELSE 0 END) >= 0.55 AS risky, max(ts) OVER (PARTITION BY driver_id) AS newest FROM v_events) SELECT driver_id, count(*)::INT AS chats, count(*) FILTER (risky)::INT AS repeats FROM c WHERE ts >= newest - {WEEK} GROUP BY 1")
def live_chat_repeats(spark, sf_dir):
    risk = scoring.chat_instant(F.col("score"), F.col("forced"), F.col("cash"), F.col("persuasion"))
    rows = batch.raw_chats(spark, sf_dir).select("driver_id", "ts", "id", (risk >= DEFAULTS["chat_signals"]["risk_threshold"]).cast("int").alias("mark"))
    t = arrived(spark, rows, ("driver_id",), lambda live, late: states.windowed_orders(live, ["driver_id"], WEEK))
    return t.select("driver_id", F.col("orders").alias("chats"), F.col("marked").alias("repeats"))


@register("live_chains", f"SELECT driver_id, count(DISTINCT order_id)::INT AS chain FROM (SELECT *, max(ts) OVER (PARTITION BY driver_id) AS newest FROM v_funnel WHERE kind = 'cancel') WHERE ts >= newest - {WEEK} GROUP BY 1")
def live_chains(spark, sf_dir):
    rows = fixtures.funnel(spark, sf_dir).where("kind = 'cancel'").select("driver_id", "ts", F.col("order_id").alias("id"), F.lit(0).alias("mark"))
    t = arrived(spark, rows, ("driver_id",), lambda live, late: states.windowed_orders(live, ["driver_id"], WEEK))
    return t.select("driver_id", F.col("orders").alias("chain"))


@register("live_funnel", f"f AS (SELECT *, max(ts) OVER (PARTITION BY driver_id, kind) AS newest FROM v_funnel) SELECT driver_id, kind, count(*)::INT AS n, count(*) FILTER (with_cause)::INT AS with_cause FROM f WHERE ts >= newest - {WEEK} GROUP BY 1, 2")
def live_funnel(spark, sf_dir):
    rows = fixtures.funnel(spark, sf_dir).select("driver_id", "kind", "ts", F.col("order_id").alias("id"), F.col("with_cause").cast("int").alias("mark"))
    t = arrived(spark, rows, ("driver_id", "kind"), lambda live, late: states.windowed_orders(live, ["driver_id", "kind"], WEEK))
    return t.select("driver_id", "kind", F.col("orders").alias("n"), F.col("marked").alias("with_cause"))


@register("live_baselines", same_as="baseline_state")
def live_baselines(spark, sf_dir):
    rows = fixtures.scores(spark, sf_dir).select(F.lit("driver").alias("kind"), F.col("entity").cast("string").alias("entity"), F.lit("cancel_abuse").alias("head"), "ts", F.col("order_id").alias("id"), F.col("cancel_abuse").alias("s"))
    keys = ["kind", "entity", "head"]
    t = arrived(spark, rows, tuple(keys), lambda live, late: states.ordered(live, keys, states.Baselines(DEFAULTS), late))
    return t.select("entity", "samples", r6("ewma"), r6("baseline"), "armed_thr", F.col("armed_thr").isNotNull().alias("armed"), "active", "window_size")


@register("live_anomalies", f"a AS (SELECT event_id AS order_id, driver_id AS entity, ts, value AS x FROM v_events), f AS (SELECT *, list(x) OVER (PARTITION BY entity ORDER BY ts, order_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS own FROM a) SELECT order_id, round({batch._Z.format('own')}, 6) AS z_self FROM f")
def live_anomalies(spark, sf_dir):
    rows = fixtures.events(spark, sf_dir).select(F.col("driver_id").cast("string").alias("entity"), "ts", F.col("event_id").alias("id"), F.col("value").alias("x"))
    t = arrived(spark, rows, ("order_id",), lambda live, late: states.ordered(live, ["entity"], states.Anomaly(DEFAULTS, False), late))
    return t.select("order_id", r6("z", "z_self"))
