"""Rule scores of the three heads, blending, revenue at risk, routing and evidence, as column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import HEADS


def col_or(df: DataFrame, name: str, default: Any, kind: str) -> Column:
    """A column, or a constant where df has none of that name; nulls get the constant too."""
    value = (F.array(*map(F.lit, default)) if isinstance(default, list) else F.lit(default)).cast(kind)
    return F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def lerp(a: float | Column, b: float | Column, t: Column) -> Column:
    return F.lit(a) + (F.lit(b) - F.lit(a)) * t


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def additive(parts: list[tuple[Column, Column | float, str | Column | None]]) -> tuple[Column, Column]:
    """Sum of the weights whose condition holds, at most 1, and their reasons in this order, each once; a reason may be an array of them."""
    total, reasons = F.lit(0.0), []
    for when, weight, why in parts:
        on = F.coalesce(when, F.lit(False))
        total = total + F.when(on, weight if isinstance(weight, Column) else F.lit(float(weight))).otherwise(0.0)
        if why is not None:
            reasons.append(F.when(on, why if isinstance(why, Column) else F.array(F.lit(why))).otherwise(F.array().cast("array<string>")))
    return F.least(F.lit(1.0), total), F.array_distinct(F.concat(*reasons))


CLOSED = ("CANCELLED", "CANCELED", "COMPLETED", "DELIVERED", "DONE")


def still_active(status: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(status, F.lit("")))).isin(*CLOSED)


# Weights of the signals that the policy doesn't set (0.5, 0.25; 0.34, 0.33), and of evidence below.
def abuse(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """abuse_score and abuse_reasons; signals that df has no column for are absent."""
    a = policy["abuse"]
    has = lambda name, what: F.array_contains(col_or(df, name, [], "array<string>"), what)
    told = lambda name, fallback: col_or(df, name, [fallback], "array<string>")
    rate, count = col_or(df, "driver_cancel_rate", 0.0, "double"), col_or(df, "driver_cancel_count", 0, "bigint")
    parts = [
        (still_active(F.col("order_status")), 0.5, "order_still_active_after_driver_cancel"),
        (col_or(df, "n_reassign", 0, "int") + 1 >= 3, 0.25, "multi_cancel_pattern"),
        (col_or(df, "driver_chain_count", 1, "bigint") >= 3, 0.25, "driver_chain_pattern"),
        (F.col("near_dest"), 0.25, "cancel_near_destination"),
        (F.col("after_pickup"), a["cancel_after_pickup_bonus"], "cancel_after_pickup"),
        (F.col("no_progress"), a["no_progress_bonus"], "no_progress_to_pickup"),
        (F.col("wrong_direction"), a["wrong_direction_bonus"], "wrong_direction"),
        ((count >= a["cancel_rate_min_count"]) & (rate >= a["cancel_rate_threshold"]), a["cancel_rate_bonus"], "high_cancel_rate"),
        (has("market_signals", "high_accept_cancel_rate"), a["accept_cancel_rate_bonus"], "high_accept_cancel_rate"),
        (has("market_signals", "low_completion_rate"), a["low_completion_rate_bonus"], "low_completion_rate"),
        (has("market_signals", "cancel_without_cause_heavy"), a["without_cause_bonus"], "cancel_without_cause_heavy"),
        (col_or(df, "pair_cancel_count", 0, "bigint") >= a["pair_cancel_min"], a["pair_density_bonus"], "pair_cancel_density"),
        (col_or(df, "device_bonus", 0.0, "double") > 0, col_or(df, "device_bonus", 0.0, "double"), told("device_reasons", "device_integrity")),
        (has("graph_signals", "multi_account_device"), a["multi_account_device_bonus"], "multi_account_device"),
        (has("graph_signals", "multi_user_device"), a["multi_user_device_bonus"], "multi_user_device"),
        (has("graph_signals", "device_hopping"), a["device_hopping_bonus"], "device_hopping"),
        (has("graph_signals", "shared_device_pair"), a["shared_device_pair_bonus"], "shared_device_pair"),
        (col_or(df, "chat_bonus", 0.0, "double") > 0, col_or(df, "chat_bonus", 0.0, "double"), told("chat_reasons", "chat_force_cancel")),
    ]
    score, reasons = additive(parts)
    return df.withColumns({"abuse_score": score, "abuse_reasons": reasons})


def theft(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """theft_score and theft_reasons."""
    t = policy["theft"]
    food = F.upper(F.trim("category")).isin(*[c.upper() for c in t["food_categories"]])
    alone = F.coalesce(F.col("next_driver_no_order"), F.lit(False))
    score, reasons = additive(
        [
            (food, 0.34, "food_category"),
            (F.col("order_value") >= t["high_value_amount"], 0.33, "high_value"),
            (alone, 0.33, "next_driver_no_order"),
            (food & F.col("after_pickup"), t["cancel_after_pickup_bonus"], "cancel_after_pickup"),
            ((F.col("cancel_stage") == "near_dropoff") & alone, t["near_dropoff_no_order_bonus"], "near_dropoff_no_order"),
        ]
    )
    return df.withColumns({"theft_score": score, "theft_reasons": reasons})


def rules(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """rule_<head> and rule_reasons, from stop, sequence and dwell, the replacement and the two feature scores."""
    w = float(policy["sequence"]["offline_weight"])
    base = (F.col("stop_confidence") + w * F.col("sequence_score") + F.col("dwell_fraction")) / (2.0 + w)
    has = F.col("replacement_order_id").isNotNull()
    invalid = has & ~F.col("replacement_valid")
    offline = F.when(~has, F.greatest(base, 0.5 * base + 0.35)).when(invalid, F.least(F.lit(1.0), base + 0.15)).otherwise(base)
    angry = F.col("abuse_score") + F.when(invalid & (F.col("abuse_score") >= 0.5), 0.1).otherwise(0.0)
    return df.withColumns({"rule_cancelled_offline": clip(offline), "rule_cancel_abuse": clip(angry), "rule_selective_theft": clip(F.col("theft_score")), "rule_reasons": F.concat("abuse_reasons", "theft_reasons", "replacement_reasons")})


def blend(rule: Column, ml: Column, head: str, policy: dict[str, Any]) -> Column:
    """Weighted mean of rule and model; the rule alone without a model or weight."""
    b = policy["blend"][head]
    r, m = float(b["rule_weight"]), float(b["ml_weight"])
    return rule if m <= 0 or r + m <= 0 else F.when(ml.isNull(), rule).otherwise((r * rule + m * ml) / (r + m))


def calibrated(p: Column, method: Column, a: Column, b: Column, xs: Column, ys: Column) -> Column:
    """Platt's sigmoid, or linear interpolation between an isotonic fit's thresholds; unchanged without a method."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda x: x <= p))
    x0, x1 = F.get(xs, k - 1), F.get(xs, k)
    y0, y1 = F.get(ys, k - 1), F.get(ys, k)
    line = F.when(k == 0, F.get(ys, 0)).when(k >= n, F.element_at(ys, -1)).otherwise(y0 + (y1 - y0) * (p - x0) / F.greatest(x1 - x0, F.lit(1e-12)))
    return F.when(method == "platt", clip(1 / (1 + F.exp(-(a * p + b))))).when(method == "isotonic", clip(line)).otherwise(p)


def thresholds(df: DataFrame, policy: dict[str, Any], prefix: str = "score_") -> DataFrame:
    """flag_<head>: 1 from the head's threshold on; a head without one needs 1."""
    return df.withColumns({f"flag_{h}": (F.col(prefix + h) >= float(policy["thresholds"].get(h, 1.0))).cast("int") for h in HEADS})


def revenue_at_risk(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """ear_<head>, ear_total and attention_score; recover_<head> columns replace the static recoverability."""
    e = policy["ear"]
    part = {h: F.col("order_value") * F.col(f"score_{h}") * col_or(df, f"recover_{h}", float(e["recoverability"][h]), "double") for h in HEADS}
    df = df.withColumns({f"ear_{h}": x for h, x in part.items()})
    df = df.withColumn("ear_total", sum((F.col(f"ear_{h}") for h in HEADS), F.lit(0.0)))
    return df.withColumn("attention_score", sum((float(e["attention_weights"][h]) * F.col(f"ear_{h}") for h in HEADS), F.lit(0.0)))


def recoverability(learned: Column, updates: Column, head: str, policy: dict[str, Any]) -> Column:
    """The learned value once it counts (mode apply and enough updates), else the static one."""
    e = policy["ear"]
    static = F.lit(float(e["recoverability"][head]))
    return F.when(F.lit(e["mode"] == "apply") & (updates >= int(e["min_updates_apply"])), F.coalesce(learned, static)).otherwise(static)


def routing(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """priority (P1, P2, skip) and queue, from flags and attention."""
    r = policy["routing"]
    flagged = sum((F.col(f"flag_{h}") for h in HEADS), F.lit(0)) > 0
    at, p1, p2 = F.col("attention_score"), float(r["p1_attention_min"]), float(r["p2_attention_min"])
    priority = F.when(~flagged & (at < p2), "skip").when((at >= p1) | (flagged & (at >= p2)), "P1").otherwise("P2")
    name = {"selective_theft": "theft", "cancelled_offline": "offline", "cancel_abuse": "abuse"}
    queue = F.coalesce(*(F.when(F.col(f"flag_{h}") == 1, F.lit(name.get(h, "mixed"))) for h in r["prefer_flag_order"]), F.lit("low_signal"))
    return df.withColumns({"priority": priority, "queue": queue})


def evidence(df: DataFrame, limit: int = 8) -> DataFrame:
    """evidence: the heaviest candidates (feature, value as text, number, head, weight), equal weights in the order below, each feature once. Signals that df has no column for are absent."""
    text = lambda c: c.cast("string")
    r4 = lambda c: F.bround(c, 4)
    none = F.lit(None).cast("double")

    def item(name: str, head: str, weight: Column, number: Column | None = None, value: Column | None = None, when: Column | None = None) -> Column:
        number = none if number is None else number.cast("double")
        own = F.struct(F.lit(name).alias("feature"), text(value if value is not None else number).alias("value"), number.alias("number"), F.lit(head).alias("head"), weight.cast("double").alias("weight"))
        return own if when is None else F.when(F.coalesce(when, F.lit(False)), own)

    has = lambda *names: all(n in df.columns for n in names)
    chain, pair = col_or(df, "driver_chain_count", 1, "bigint"), col_or(df, "pair_cancel_count", 0, "bigint")
    one = F.lit(1.0)
    fixed = [
        item("cancel_stage", "cancel_abuse", F.when(F.col("cancel_stage") == "unknown", 0.05).otherwise(0.2), value=F.col("cancel_stage")),
        item("final_stop_confidence", "cancelled_offline", F.col("stop_confidence"), r4(F.col("stop_confidence"))),
        item("driver_chain_count", "cancel_abuse", F.least(one, chain / 5.0), chain),
        item("pair_cancel_count", "cancel_abuse", F.least(one, pair / 5.0), pair),
    ]
    if has("driver_cancel_rate"):
        fixed.append(item("entity_cancel_rate", "cancel_abuse", F.least(one, F.col("driver_cancel_rate") / 4.0), r4(F.col("driver_cancel_rate")), when=F.col("driver_cancel_rate").isNotNull()))
    if has("accept_cancel_rate", "completion_rate"):
        fixed.append(item("accept_cancel_rate", "cancel_abuse", F.col("accept_cancel_rate"), r4(F.col("accept_cancel_rate")), when=F.col("accept_cancel_rate").isNotNull()))
        fixed.append(item("completion_rate", "cancel_abuse", F.greatest(F.lit(0.0), 1 - F.col("completion_rate")), r4(F.col("completion_rate")), when=F.col("completion_rate").isNotNull()))
    if has("device_risk", "device_fires"):
        fixed.append(item("device_integrity", "cancel_abuse", F.col("device_risk"), r4(F.col("device_risk")), F.to_json(F.struct(r4(F.col("device_risk")).alias("effective_risk"), F.col("device_reasons"))), F.col("device_fires")))
    if has("graph_signals"):
        fixed.append(item("device_graph", "cancel_abuse", F.least(one, 0.25 * F.size("graph_signals")), F.size("graph_signals"), F.to_json("graph_signals"), F.size("graph_signals") > 0))
    if has("chat_risk", "chat_bonus"):
        fixed.append(item("chat_force_cancel", "cancel_abuse", F.col("chat_risk"), r4(F.col("chat_risk")), F.to_json("chat_reasons"), F.col("chat_bonus") > 0))
    if has("anomaly_signals", "anomaly_top"):
        fixed.append(item("entity_anomaly", "cancel_abuse", F.coalesce(F.least(one, F.col("anomaly_top") / 6.0), F.lit(0.5)), F.col("anomaly_top"), F.to_json("anomaly_signals"), F.size("anomaly_signals") > 0))
    fixed += [
        item("wrong_direction", "cancel_abuse", F.lit(0.8), F.col("away_fraction"), when=F.col("wrong_direction")),
        item("no_progress_to_pickup", "cancel_abuse", F.lit(0.7), F.col("progress_ratio"), when=F.col("no_progress")),
        item("gps_integrity", "cancelled_offline", F.lit(0.6), F.col("max_jump_m"), F.to_json(F.struct("max_jump_m", "max_speed_mps")), F.col("teleport") | F.col("speed_spike")),
        item("stop_presence", "cancelled_offline", F.lit(0.35), F.col("min_pts"), F.to_json(F.struct("dwell_target_s", "gap_median", "min_pts", "drop_min_pts", *[c for c in ("place_class", "vehicle_class") if has(c)]))),
    ]
    reason = lambda head: lambda x: F.struct(x.alias("feature"), F.lit("true").alias("value"), none.alias("number"), F.lit(head).alias("head"), F.lit(0.5).alias("weight"))
    drop = F.array_compact(F.array(item("dropoff_dist_m", "cancel_abuse", F.lit(0.3), F.bround("dropoff_dist_m", 3), when=F.col("dropoff_dist_m").isNotNull())))
    every = F.concat(F.array_compact(F.array(*fixed)), F.transform("abuse_reasons", reason("cancel_abuse")), F.transform("theft_reasons", reason("selective_theft")), drop)
    ranked = F.array_sort(F.transform(every, lambda x, i: F.struct((-F.round(x["weight"], 9)).alias("w"), i.alias("i"), x.alias("x"))))
    first = lambda r: lambda names: F.filter(r, lambda a, i: F.array_position(names, a["x"]["feature"]) == i + 1)
    once = let(ranked, lambda r: let(F.transform(r, lambda a: a["x"]["feature"]), first(r)))
    return df.withColumn("evidence", F.transform(F.slice(once, 1, limit), lambda a: a["x"]))


def operating_point(ratio_: Column, cfg: dict[str, Any]) -> dict[str, Column]:
    """Precision and recall bounds at a supply/demand ratio: peak, surplus or a line between; the fallback without one."""
    r = F.least(F.lit(cfg["ratio_max"]), F.greatest(F.lit(cfg["ratio_min"]), ratio_))
    p, s = cfg["peak"], cfg["surplus"]
    t = (r - p["ratio"]) / (s["ratio"] - p["ratio"])
    out = {k: F.when(ratio_.isNull(), float(cfg["fallback"][k])).when(r <= p["ratio"], float(p[k])).when(r >= s["ratio"], float(s[k])).otherwise(lerp(float(p[k]), float(s[k]), t)) for k in cfg["fallback"]}
    return out | {"regime": F.when(ratio_.isNull(), "fallback").when(r <= p["ratio"], "peak").when(r >= s["ratio"], "surplus").otherwise("mid")}


def score_band(score: Column, threshold: Column | float, delta: float) -> Column:
    t = F.lit(threshold)
    return F.when(score < t - delta, "low").when(score > t + delta, "high").otherwise("mid")


def with_recoverability(df: DataFrame, learned: DataFrame, policy: dict[str, Any], on: tuple[str, ...] = ("region", "city")) -> DataFrame:
    """df with recover_<head>, live values of its market: learned ones (on, head, value, n_updates) where they count, else the static ones; markets with a null code have these."""
    wide = learned.groupBy(*on).agg(*(F.max(F.when(F.col("head") == h, F.struct("value", "n_updates"))).alias("_" + h) for h in HEADS))
    j = df.join(wide, [*on], "left")
    return j.withColumns({f"recover_{h}": recoverability(F.col(f"_{h}.value"), F.col(f"_{h}.n_updates"), h, policy) for h in HEADS}).drop(*("_" + h for h in HEADS))


def with_calibrators(df: DataFrame, table: DataFrame, on: tuple[str, ...] = ("region", "head")) -> DataFrame:
    """df with calibrated, its score by the calibrator of its market and head (method, a, b, xs, ys), and skip_reason `missing` where there is none. Codes are compared upper-cased; no wider market is tried."""
    keys = [f"_{c}" for c in on]
    own = lambda c: F.col(c) if c == "head" else F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    t = table.select(*(own(c).alias(k) for c, k in zip(on, keys, strict=True)), *(F.col(c).alias("_" + c) for c in ("method", "a", "b", "xs", "ys")))
    j = df.withColumns({k: own(c) for c, k in zip(on, keys, strict=True)}).join(t, keys, "left")
    value = calibrated(F.col("score"), F.col("_method"), F.col("_a"), F.col("_b"), F.col("_xs"), F.col("_ys"))
    return j.withColumns({"calibrated": value, "skip_reason": F.when(F.col("_method").isNull(), "missing")}).drop(*keys, "_method", "_a", "_b", "_xs", "_ys")


# -- device and chat signals ----------------------------------------------------------------------------------


#: What each suspicion stands for, in the order of their reasons.
DEVICE_FLAGS = {"spoof_suspected": 0.85, "fake_app": 0.80, "emulator": 0.75, "rooted": 0.55}
CHAT_FLAGS = {"rider_forced_cancel": 0.90, "cash_offline_suggested": 0.85, "persuasion_suspected": 0.70}


def _signals(raw: Column, flags: dict[str, str | None], score: str) -> dict[str, Column]:
    """Flags and a 0..1 score of a JSON object; a flag may have another name too, an empty score is none."""
    cell = lambda k: F.get_json_object(raw, "$." + k)
    on = lambda k: F.coalesce(F.lower(F.trim(cell(k))).isin("1", "true", "yes", "y"), F.lit(False))
    out = {k: on(k) | on(other) if other else on(k) for k, other in flags.items()}
    return out | {score: clip(F.nullif(F.trim(cell(score)), F.lit("")).cast("double"))}


def normal_device(raw: Column) -> dict[str, Column]:
    """Device signals of a JSON object."""
    return _signals(raw, {"spoof_suspected": None, "fake_app": "tampered_app", "emulator": None, "rooted": "jailbroken"}, "risk_score")


def normal_chat(raw: Column) -> dict[str, Column]:
    """Chat signals of a JSON object."""
    return _signals(raw, {"rider_forced_cancel": "force_cancel", "cash_offline_suggested": "pay_cash_suggested", "persuasion_suspected": None}, "signal_score")


def device_risk_of(x: dict[str, Column]) -> Column:
    return device_instant(x["risk_score"], *(x[k] for k in DEVICE_FLAGS))


def chat_risk_of(x: dict[str, Column]) -> Column:
    return chat_instant(x["signal_score"], *(x[k] for k in CHAT_FLAGS))


def device_instant(vendor: Column, spoof: Column, fake: Column, emulator: Column, root: Column) -> Column:
    """Highest of the vendor's risk and what each suspicion stands for."""
    on = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    return F.greatest(clip(F.coalesce(vendor, F.lit(0.0))), *(on(c, w) for c, w in zip((spoof, fake, emulator, root), DEVICE_FLAGS.values(), strict=True)))


def ewma(previous: Column, x: Column, alpha: float) -> Column:
    return F.when(previous.isNull(), x).otherwise(alpha * x + (1 - alpha) * previous)


def device_effect(instant: Column, smoothed: Column, spoof_or_emulator: Column, policy: dict[str, Any]) -> dict[str, Column]:
    d = policy["device_integrity"]
    risk = F.greatest(instant, smoothed)
    fires = risk >= d["risk_threshold"]
    return {"device_risk": risk, "device_fires": fires, "device_bonus": F.when(fires, d["abuse_bonus_scale"] * risk).otherwise(0.0), "device_gps_multiplier": F.when(spoof_or_emulator, F.greatest(F.lit(0.0), 1 - d["gps_dampen"] * risk)).otherwise(1.0)}


def chat_instant(vendor: Column, forced: Column, cash: Column, persuasion: Column) -> Column:
    on = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    return F.greatest(clip(F.coalesce(vendor, F.lit(0.0))), *(on(c, w) for c, w in zip((forced, cash, persuasion), CHAT_FLAGS.values(), strict=True)))


def chat_bonus(risk: Column, stalled: Column, repeats: Column, policy: dict[str, Any]) -> Column:
    """Bonus of a risky chat, more if the trip stalled; repeats add theirs even alone."""
    c = policy["chat_signals"]
    fires = risk >= c["risk_threshold"]
    return F.when(fires, c["abuse_bonus_scale"] * risk + F.when(stalled, c["stall_combo_bonus"]).otherwise(0.0)).otherwise(0.0) + F.when(repeats >= c["repeat_min_count"], c["repeat_bonus"]).otherwise(0.0)
