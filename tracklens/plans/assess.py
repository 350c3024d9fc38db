"""Orders and pings in, assessments out: one plan for all orders."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.geo import cohort
from ..functions.policy import HEADS
from ..operators import history as past
from ..operators import tracks
from ..sources.shared import Work


@dataclass
class History:
    """What is known besides an order and its track; what is None is left out.

    events: order_id, driver_id, user_id, ts, kind (accept, cancel, complete), with_cause. edges: device_id, entity_kind,
    entity_id, ts, seen as of `as_of`. chats: order_id, driver_id, persuasion, cash, forced, score, source, ts.
    anomalies, baselines: whether orders are held against those before them. calibrators, recoverability: tables of the
    control plane by region, city and head.
    """

    events: DataFrame | None = None
    edges: DataFrame | None = None
    as_of: int = 0
    chats: DataFrame | None = None
    anomalies: bool = False
    baselines: bool = False
    calibrators: DataFrame | None = None
    recoverability: DataFrame | None = None


def signals(orders: DataFrame, h: History, policy: dict[str, Any]) -> DataFrame:
    """order_id and a column for each signal that the order's driver, user, device and chats give, from orders and histories alone."""
    a, c = policy["abuse"], policy["chat_signals"]
    out = orders.select("order_id")
    if h.events is not None:
        window = int(a["cancel_stats_window_minutes"]) * 60
        kind = lambda k: F.col("kind") == k
        counts = {"accepts": kind("accept"), "cancels": kind("cancel"), "completes": kind("complete"), "with_cause_n": kind("cancel") & F.col("with_cause")}
        asks = orders.select("order_id", "driver_id", "user_id", F.col("cancel_ts").alias("at"))
        seen = past.trailing(asks, h.events, ["driver_id"], window, counts).drop("user_id", "at")
        pair = past.trailing(asks.where("user_id is not null"), h.events, ["driver_id", "user_id"], window, {"pair_cancel_count": kind("cancel")}).select("order_id", "pair_cancel_count")
        chain = past.trailing(asks, h.events.where("kind = 'cancel'").groupBy("driver_id", "order_id").agg(F.max("ts").alias("ts")), ["driver_id"], int(a["chain_lookback_minutes"]) * 60, {"chained": F.lit(True)}).select("order_id", "chained")
        cols = [F.col(x) for x in ("accepts", "cancels", "completes", "with_cause_n")]
        seen = seen.withColumns(past.funnel_rates(*cols)).withColumn("market_signals", past.market_signals(*cols, policy)).drop("driver_id")
        seen = seen.withColumns({"driver_cancel_count": F.col("cancels"), "driver_cancel_rate": F.col("cancels") / max(window / 3600.0, 1.0)}).drop("completes", "with_cause_n", "cancels")
        out = out.join(seen, "order_id", "left").join(pair, "order_id", "left").join(chain, "order_id", "left")
    if h.edges is not None:
        asks = orders.select("order_id", "device_id", F.col("driver_id").cast("bigint").alias("driver_id"), F.col("user_id").cast("bigint").alias("user_id"))
        out = out.join(past.graph_signals(asks, h.edges, h.as_of, policy), "order_id", "left")
    if "device_score" in orders.columns:
        d = policy["device_integrity"]
        flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in orders.columns else F.lit(False)
        spoof, fake, emulator, rooted = (flag("device_" + n) for n in ("spoof", "fake_app", "emulator", "rooted"))
        told = F.col("device_score").isNotNull() | spoof | fake | emulator | rooted
        rows = orders.where("device_id is not null").select("order_id", "device_id", F.col("cancel_ts").alias("ts"), scoring.device_instant(F.col("device_score"), spoof, fake, emulator, rooted).alias("instant"), told.alias("told"), spoof.alias("spoof"), fake.alias("fake"), emulator.alias("emulator"), rooted.alias("rooted"))
        rows = past.device_states(rows, float(d["ewma_alpha"])).withColumns(scoring.device_effect(F.col("instant"), F.col("ewma_risk"), F.col("spoof") | F.col("emulator"), policy))
        names = [("spoof", "device_spoof_suspected"), ("fake", "device_fake_app"), ("emulator", "device_emulator"), ("rooted", "device_rooted")]
        why = F.array_compact(F.array(F.lit("device_integrity"), *(F.when(F.col(n), w) for n, w in names)))
        out = out.join(rows.select("order_id", "device_risk", "device_fires", "device_bonus", "device_gps_multiplier", F.when(F.col("device_fires"), why).alias("device_reasons")), "order_id", "left")
    if h.chats is not None:
        risk = scoring.chat_instant(F.col("score"), F.col("forced"), F.col("cash"), F.col("persuasion"))
        chats = past.merge_chat(h.chats).withColumn("chat_risk", risk)
        asks = orders.select("order_id", "driver_id", F.col("cancel_ts").alias("at"))
        repeats = past.trailing(asks, chats, ["driver_id"], int(c["window_minutes"]) * 60, {"chat_repeats": F.col("chat_risk") >= float(c["risk_threshold"])}).select("order_id", "chat_repeats")
        out = out.join(chats.select("order_id", "chat_risk", F.col("forced").alias("chat_forced"), F.col("cash").alias("chat_cash"), F.col("persuasion").alias("chat_persuasion")), "order_id", "left").join(repeats, "order_id", "left")
    return out


def with_signals(df: DataFrame, found: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """Geometry with the signals, and what they mean for it: the device's damping of the stop confidence, the chain of drivers, the chat's bonus."""
    df = df.join(found, "order_id", "left")
    if "chained" in df.columns:
        drivers = F.size(F.array_distinct(F.concat(F.array(F.col("driver_id").cast("bigint")), F.coalesce("reassign_drivers", F.array().cast("array<bigint>"))))) if "reassign_drivers" in df.columns else F.lit(1)
        df = df.withColumn("driver_chain_count", F.greatest(drivers, F.coalesce("chained", F.lit(0)) + 1)).drop("chained")
    if "device_gps_multiplier" in df.columns:
        df = df.withColumn("stop_confidence", scoring.clip(F.col("stop_confidence") * F.coalesce("device_gps_multiplier", F.lit(1.0))))
    if "chat_risk" in df.columns:
        c = policy["chat_signals"]
        risk, repeats = F.coalesce("chat_risk", F.lit(0.0)), F.coalesce("chat_repeats", F.lit(0))
        stalled = F.coalesce(F.col("no_progress") | F.col("wrong_direction"), F.lit(False))
        fires = risk >= float(c["risk_threshold"])
        why = [(fires, "chat_force_cancel"), (fires & F.col("chat_forced"), "chat_rider_forced_cancel"), (fires & F.col("chat_cash"), "chat_cash_offline_suggested"), (fires & F.col("chat_persuasion"), "chat_persuasion_suspected"), (fires & stalled, "force_cancel_with_stall"), (repeats >= int(c["repeat_min_count"]), "repeat_force_cancel")]
        df = df.withColumns({"chat_risk": risk, "chat_bonus": scoring.chat_bonus(risk, stalled, repeats, policy), "chat_reasons": F.array_compact(F.array(*(F.when(when, F.lit(text)) for when, text in why)))})
    return df


def final_reasons(df: DataFrame, policy: dict[str, Any]) -> Column:
    """Rules, sequence, integrity, progress, stage, what is wrong with the track, baselines."""
    note = lambda when, text: F.when(when, F.lit(text))
    lost = note(F.col("gps_unavailable"), "gps_unavailable") if "gps_unavailable" in df.columns else F.lit(None).cast("string")
    return F.concat(
        "rule_reasons",
        F.array_compact(F.array(F.col("sequence_reason"))),
        F.array_compact(F.array(note(F.col("teleport"), "gps_teleport"), note(F.col("speed_spike"), "gps_impossible_speed"))),
        "progress_reasons",
        F.array(F.concat(F.lit("stage:"), F.col("cancel_stage"))),
        F.array_compact(F.array(lost, note(F.col("gps_sparse"), "gps_sparse"), note(F.col("max_gap_minutes") > float(policy["gps"]["max_gap_minutes"]), "gps_gaps"))),
        *(["model_reasons"] if "model_reasons" in df.columns else []),
        *(["baseline_reasons"] if "baseline_reasons" in df.columns else []),
    )


def with_anomalies(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """df with its abuse score and reasons raised by what is out of line with the driver's last orders or the cohort's."""
    a = policy["anomaly"]
    if a["mode"] == "off":
        return df
    acr = F.when(F.col("accepts") >= 1, F.col("accept_cancel_rate")) if "accepts" in df.columns else F.lit(None).cast("double")
    rate = F.col("driver_cancel_rate") if "driver_cancel_rate" in df.columns else F.lit(None).cast("double")
    values = {"cancel_abuse": F.col("abuse_score"), "cancel_rate": rate, "accept_cancel_rate": acr}
    features = [n for n in values if n in a["features"]]
    peers = cohort(*(F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("city_code", "region_code")))
    rows = df.select("order_id", F.concat(F.lit("driver:"), F.col("driver_id").cast("string")).alias("entity"), peers.alias("cohort"), F.col("cancel_ts").alias("ts"), *(values[n].alias(n) for n in features))
    df = df.join(past.order_anomalies(rows, features, policy), "order_id", "left").withColumn("anomaly_signals", F.coalesce("anomaly_signals", F.array().cast("array<string>")))
    fires = F.size("anomaly_signals") > 0
    notes = F.col("anomaly_signals") if a["mode"] == "apply" else F.transform("anomaly_signals", lambda x: F.concat(F.lit("anomaly_shadow:"), x))
    bonus = float(a["abuse_bonus"]) if a["mode"] == "apply" else 0.0
    return df.withColumns({"abuse_score": F.when(fires, F.least(F.lit(1.0), F.col("abuse_score") + bonus)).otherwise(F.col("abuse_score")), "abuse_reasons": F.array_distinct(F.concat("abuse_reasons", notes))})


def score(df: DataFrame, policy: dict[str, Any], history: History | None = None, work: Work | None = None) -> DataFrame:
    """Scores, flags, reasons, revenue at risk, routing and evidence, from geometry and whatever signals df has columns for.

    ml_<head> columns are blended in where df has them. raw_<head> are the blended scores before baselines and calibration.
    Histories of anomalies and baselines are walked on a few columns of tables of work, which they need, and joined by order_id.
    """
    h = history or History()
    df = scoring.abuse(df, policy)
    if h.anomalies:
        df = with_anomalies(work.kept(df, "abuse"), policy)
    df = scoring.rules(scoring.theft(df, policy), policy)
    ml = lambda x: F.col(f"ml_{x}") if f"ml_{x}" in df.columns else F.lit(None).cast("double")
    df = df.withColumns({f"score_{x}": scoring.blend(F.col(f"rule_{x}"), ml(x), x, policy) for x in HEADS})
    df = df.withColumns({f"raw_{x}": F.col(f"score_{x}") for x in HEADS})
    if h.baselines:
        df = work.kept(df, "scores")
        rows = df.select("order_id", "driver_id", "user_id", F.col("cancel_ts").alias("ts"), *(f"score_{x}" for x in HEADS))
        df = past.with_baselines(df, past.active_baselines(rows, policy) if past.baseline_modes(policy) else rows, policy)
    if h.calibrators is not None and policy["calibration"]["mode"] == "apply":
        for x in HEADS:  # a calibrated score stands for the raw one, discounted or not
            one = scoring.with_calibrators(df.withColumns({"score": F.col(f"raw_{x}"), "head": F.lit(x), "region": F.col("region_code"), "city": F.col("city_code")}), h.calibrators, ("region", "city", "head"))
            df = one.withColumn(f"score_{x}", F.when(F.col("skip_reason").isNull(), F.col("calibrated")).otherwise(F.col(f"score_{x}"))).drop("score", "head", "region", "city", "calibrated", "skip_reason")
    if h.recoverability is not None:
        df = scoring.with_recoverability(df.withColumns({"region": F.col("region_code"), "city": F.col("city_code")}), h.recoverability, policy).drop("region", "city")
    df = scoring.thresholds(df, policy)
    df = df.withColumn("reasons", final_reasons(df, policy))
    df = scoring.routing(scoring.revenue_at_risk(df, policy), policy)
    return scoring.evidence(df).withColumn("provisional", F.col("gps_sparse"))


def assess(orders: DataFrame, pings: DataFrame, policy: dict[str, Any], key: str = "track_id", history: History | None = None) -> DataFrame:
    """Every order assessed, against its histories where they are given; an order without pings or stops has an empty track and unknown stage. order_id is unique.

    Runs when it is called: geometry, then abuse, then scores are tables in the shared folder while it runs, so each
    part is planned by itself and computed once; the result is a table there that stays.
    """
    work = Work(orders.sparkSession, "assess")
    df = work.kept(tracks.geometry(orders, pings, policy, key).drop("track"), "geometry")
    if history is not None:
        df = with_signals(df, signals(orders, history, policy), policy)
    out = Work(orders.sparkSession, "assessed").kept(score(df, policy, history, work), "assessments")
    work.clear()
    return out
