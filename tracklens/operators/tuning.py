"""Threshold tuning of all markets and heads in one plan.

A candidate is a threshold of the grid with a blend: the scores as they are, or rule and model weighed anew. Every order is
counted once by the grid cell that each blend's score falls in; of these counts all candidates' confusions and
projected flags are sums, so no candidate costs a pass of its own. A market is a region and city, and a region with
an empty city has all orders of its cities.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import BOUNDS, HEADS, OPERATING_POINT
from ..functions.scoring import operating_point, ratio
from ..sources.shared import Work
from . import quality, sampling, search
from .control import MARKET, heads_frame, normal

#: Rule weights and attention floors that are tried.
RULE_WEIGHTS, P1_FLOORS = (0.4, 0.6, 0.8), (50.0, 150.0, 200.0, 400.0)
#: The head whose blend is searched.
BLENDED = HEADS[0]


def blends(columns: list[str], bounds: dict[str, tuple[float, float]]) -> list[tuple[float, float]]:
    """(rule weight, model weight) candidates within bounds, where there are rule and model scores."""
    keys = [f"blend.{BLENDED}.{w}" for w in ("rule_weight", "ml_weight")]
    if any(k not in bounds for k in keys) or not {f"rule_{BLENDED}", f"ml_{BLENDED}"} <= set(columns):
        return []
    inside = lambda k, v: bounds[k][0] <= v <= bounds[k][1]
    return [(w, round(1 - w, 4)) for w in RULE_WEIGHTS if inside(keys[0], w) and inside(keys[1], round(1 - w, 4))]


def candidate_scores(scores: DataFrame, weights: list[tuple[float, float]], policy: dict[str, Any]) -> DataFrame:
    """order_id, region, city, head, blend (0: as it is), score, pattern of each order, head and blend."""
    has = lambda c: F.col(c) if c in scores.columns else F.lit(None).cast("double")
    reasons = F.col("reasons") if "reasons" in scores.columns else None
    rows = []
    for h in HEADS:
        of = lambda blend, k, h=h: F.struct(F.lit(h).alias("head"), F.lit(k).alias("blend"), quality.resolved_score(F.col(h), has(f"raw_{h}"), has(f"rule_{h}"), has(f"ml_{h}"), blend).alias("score"), sampling.in_pattern(h, policy, F.col(h), reasons).alias("pattern"))
        rows.append(of(None, 0))
        if h == BLENDED:
            rows += [of({"rule_weight": r, "ml_weight": m}, k) for k, (r, m) in enumerate(weights, 1)]
    return normal(scores).where("region <> ''").select("order_id", *MARKET, F.inline(F.array(*rows)))


def to_markets(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """rows under each market that they belong to: their own, and their region's if that is one."""
    each = F.array_distinct(F.array(F.struct("region", "city"), F.struct("region", F.lit("").alias("city"))))
    return rows.select(*(c for c in rows.columns if c not in MARKET), F.inline(each)).join(markets, [*MARKET], "left_semi")


def confusions(cells: DataFrame, thresholds: Column, by: tuple[str, ...]) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of each group of by and threshold, from counts (cell, label, n)."""
    each = cells.select(*by, "cell", "label", "n", F.posexplode(thresholds).alias("grid_idx", "threshold"))
    flag = F.col("cell") > F.col("grid_idx")
    n = lambda f, y: F.sum(F.when((flag if f else ~flag) & (F.col("label") == y), F.col("n")).otherwise(0)).cast("bigint")
    g = each.groupBy(*by, "grid_idx", "threshold").agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(False, 0).alias("tn"))
    return g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def own_thresholds(markets: DataFrame, overlays: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """region, city, head, threshold_now of each market and head: the city's overlay, else the region's, else the policy's."""
    base = F.create_map(*(F.lit(x) for h in HEADS for x in (h, float(policy["thresholds"].get(h, 0.75)))))
    own = normal(overlays).where(F.col("path").startswith("thresholds.")).select(*MARKET, F.substring_index("path", ".", -1).alias("head"), "value")
    wide = own.where("city = ''").select("region", "head", F.col("value").alias("_wide"))
    j = markets.join(F.broadcast(heads_frame(markets))).join(own, [*MARKET, "head"], "left").join(wide, ["region", "head"], "left")  # three heads
    return j.select(*MARKET, "head", F.coalesce("value", "_wide", base[F.col("head")]).alias("threshold_now"))


def regimes(markets: DataFrame, forecast: DataFrame | None, clawbacks: DataFrame | None, at: int, cfg: dict[str, Any]) -> DataFrame:
    """region, city, supply_ratio, regime and the operating point's bounds of each market at a time; a clawback is a peak."""
    asks = markets.select(F.concat_ws("|", *MARKET).alias("id"), *MARKET, F.lit(at).cast("bigint").alias("at"))
    found = asks.withColumn("ratio", F.lit(None).cast("double")) if forecast is None else search.active_forecast(asks, normal(forecast))
    back = F.lit(False)
    if clawbacks is not None:
        live = normal(clawbacks).where(F.col("until_ts") > at).select(*MARKET, F.lit(True).alias("_back")).distinct()
        found, back = found.join(live, [*MARKET], "left"), F.coalesce("_back", F.lit(False))
    asked = F.when(back, float(cfg["peak"]["ratio"])).otherwise(F.col("ratio"))
    point = operating_point(asked, cfg)
    clipped = F.greatest(F.lit(float(cfg["ratio_min"])), F.least(F.lit(float(cfg["ratio_max"])), asked))
    return found.select(*MARKET, clipped.alias("supply_ratio"), F.when(back, "clawback_peak").otherwise(point["regime"]).alias("regime"), *(point[k].alias(k) for k in cfg["fallback"]))


def tune(
    scores: DataFrame, labels: DataFrame, caps: DataFrame, applied: DataFrame, policy: dict[str, Any], now: int, cooldown_minutes: int = 60, min_lift: float = 0.01, step: float = 0.05,
    overlays: DataFrame | None = None, forecast: DataFrame | None = None, clawbacks: DataFrame | None = None, at: int | None = None, cfg: dict[str, Any] = OPERATING_POINT, bounds: dict[str, tuple[float, float]] = BOUNDS,
) -> DataFrame:
    """A decision for each market and head: the candidate with the most holdout recall of the pattern cohort within all gates.

    scores: order_id, region, city, a score a head and maybe raw_, rule_, ml_ scores and reasons. labels: order_id and a label a
    head. caps: region, city, window, cap; halved while a clawback (region, city, until_ts) is on, and the shortest window's
    counts. applied: last_applied(). overlays: region, city, path, value. The first rung that holds decides: too few
    labels, no candidate within gates and caps, too little lift over the market's own threshold, cooldown, else apply.
    Of equal candidates the one with more precision, then the first blend, then the lowest threshold. The model's blend and
    the attention floor are searched where there are enough labels.
    """
    learn = policy["learning"]
    low, high = bounds["thresholds." + HEADS[0]]
    grid = [round(t, 4) for t in search.grid(low, high, step)]
    t = F.array(*map(F.lit, grid))
    cell = F.size(F.filter(t, lambda x: x <= F.col("score"))).alias("cell")
    weights = blends(scores.columns, bounds)
    by = (*MARKET, "head")
    markets = normal(scores).where("region <> ''").select(*MARKET).distinct()
    long = candidate_scores(scores, weights, policy)

    known = quality.holdout_split(quality.by_head(labels, "label", "order_id").where("label is not null"), 0.3)
    held_out = known.agg(F.coalesce(F.bool_or("holdout"), F.lit(False)).alias("_some"))  # one row
    pairs = to_markets(long.where("pattern").join(known, ["order_id", "head"]), markets)
    counted = pairs.groupBy(*by, "blend", "holdout", cell, "label").agg(F.count(F.lit(1)).alias("n"))
    every = confusions(counted, t, (*by, "blend", "holdout"))

    current = pairs.where("blend = 0").join(own_thresholds(markets, overlays if overlays is not None else no_overlays(scores), policy), [*by])
    current = quality.confusion(current, F.col("score") >= F.col("threshold_now"), *by, "holdout").withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    of = lambda c, held: F.coalesce(F.max(F.when(F.col("holdout") == held, F.col(c))), F.lit(0))
    own = current.groupBy(*by).agg(of("n", False).alias("support"), of("recall", True).alias("_held"), of("recall", False).alias("_train"))

    ok = (F.col("precision") + search.SLACK >= float(learn["target_precision"])) & (F.col("recall") + search.SLACK >= float(learn["min_pattern_recall"]))
    good = every.where(ok).join(own.select(*by, "support"), [*by]).where((F.col("blend") == 0) | (F.col("support") >= int(learn["blend_search_min_support"])))
    train = good.where("not holdout").select(*by, "blend", "grid_idx")
    judged = good.crossJoin(F.broadcast(held_out)).where(F.col("holdout") == F.col("_some")).join(train, [*by, "blend", "grid_idx"])
    flagged = to_markets(long.groupBy(*by, "blend", cell).agg(F.count(F.lit(1)).alias("n")), markets)
    flagged = flagged.select(*by, "blend", "cell", "n", F.posexplode(t).alias("grid_idx", "_t")).groupBy(*by, "blend", "grid_idx").agg(F.sum(F.when(F.col("cell") > F.col("grid_idx"), F.col("n")).otherwise(0)).cast("bigint").alias("projected"))
    limits = normal(caps)
    if clawbacks is not None:
        limits = search.effective_caps(limits, normal(clawbacks), now).select(*MARKET, "window", F.col("effective_cap").alias("cap"))
    judged = judged.join(flagged, [*by, "blend", "grid_idx"], "left").join(search.first_cap(limits), [*MARKET], "left").where(F.col("cap").isNull() | (F.col("projected") <= F.col("cap")))
    best = judged.groupBy(*by).agg(F.max_by(F.struct("threshold", "blend", "recall", "precision", "projected"), F.struct("recall", "precision", -F.col("blend"), -F.col("grid_idx"))).alias("best"))

    last = applied.select(*MARKET, F.regexp_replace("path", "^thresholds[.]", "").alias("head"), "applied_at")
    thresholds = own_thresholds(markets, overlays if overlays is not None else no_overlays(scores), policy)
    d = thresholds.join(own, [*by], "left").join(best, [*by], "left").join(last, [*by], "left").join(regimes(markets, forecast, clawbacks, now if at is None else at, cfg), [*MARKET], "left")
    d = d.crossJoin(F.broadcast(held_out)).withColumn("recall_now", F.coalesce(F.when(F.col("_some"), F.col("_held")).otherwise(F.col("_train")), F.lit(0.0)))
    lift = F.col("best.recall") - F.col("recall_now")
    support = F.coalesce("support", F.lit(0)).cast("bigint")
    d = d.withColumns({
        "support": support,
        "lift": lift,
        "reason": F.when(support < int(learn["min_pattern_support"]), "insufficient_pattern_labels")
        .when(F.col("best").isNull(), "no_candidate_in_gates")
        .when(lift < min_lift, "holdout_pattern_recall_lift_below_min")
        .when(F.col("applied_at") > now - cooldown_minutes * 60, "cooldown")
        .otherwise("holdout_pattern_recall_lift"),
    })
    action = F.when(F.col("reason") == "holdout_pattern_recall_lift", "apply").when(F.col("reason").isin("cooldown", "holdout_pattern_recall_lift_below_min"), "suggest").otherwise("reject")
    found, blend = action != "reject", F.col("best.blend")
    weight = lambda k: F.when(found & (blend > 0), F.element_at(F.array(F.lit(None).cast("double"), *(F.lit(w[k]) for w in weights)), blend + 1))
    floors = [p for p in P1_FLOORS if bounds.get("routing.p1_attention_min", (1, 0))[0] <= p <= bounds.get("routing.p1_attention_min", (1, 0))[1]]
    p1 = F.when(found & (support >= int(learn["blend_search_min_support"])), F.lit(floors[0] if floors else None).cast("double"))
    return d.select(
        *by, "support", action.alias("action"), F.when(action == "apply", "accepted").otherwise("rejected").alias("decision"), "reason", F.when(found, F.col("best.threshold")).alias("threshold"),
        weight(0).alias("rule_weight"), weight(1).alias("ml_weight"), p1.alias("p1_attention_min"), F.when(found, F.col("lift")).alias("recall_lift"), "threshold_now", "recall_now", "regime", "supply_ratio", *(k for k in cfg["fallback"]),
    )


def retune(orders: DataFrame, pings: DataFrame, labels: DataFrame, caps: DataFrame, applied: DataFrame, policy: dict[str, Any], now: int, bounds: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """One decision a market on the radius and density of clusters: from cached tracks to the decision in one plan.

    orders: the newest cached order of each id, with region and city; pings: their tracks; labels: order_id and
    cancelled_offline, 0 or 1. Labelled orders alone are replayed, under every candidate of the policy's grid within bounds
    and as the policy has it now. A candidate needs enough labels of the pattern cohort, precision and recall on the
    held-out part, and projected flags within the market's cap; the one with most recall, then precision, then the first is
    the best. applied: region, city, applied_at.
    """
    c, learn = policy["dbscan_retune"], policy["learning"]
    need = max(int(c["min_labeled"]), int(learn["min_pattern_support"]))
    now_at = (int(policy["dbscan"]["clustering_radius_m"]), int(policy["dbscan"]["min_pts"]))
    grid = search.retune_grid(policy, bounds)
    known = labels.where(f"{BLENDED} is not null").select("order_id", F.col(BLENDED).alias("label"))
    mine = orders.join(known.select("order_id").distinct(), "order_id", "left_semi")
    tried = search.replay(mine, pings, policy, [*grid, now_at] if now_at not in grid else grid)
    own = normal(mine).where("region <> ''").select("order_id", *MARKET)
    markets = own.select(*MARKET).distinct()
    rows = quality.holdout_split(tried.join(own, "order_id").join(known, "order_id"), float(c["holdout_fraction"]))
    rows = to_markets(rows.withColumns({"pattern": sampling.in_pattern(BLENDED, policy, F.col("score")), "flag": F.col("score") >= float(policy["thresholds"][BLENDED])}), markets)
    work = Work(orders.sparkSession, "retune")
    rows = work.kept(rows.select("order_id", *MARKET, "radius", "points", "holdout", "label", "pattern", "flag"), "labelled")
    held_out = rows.agg(F.coalesce(F.bool_or("holdout"), F.lit(False)).alias("_some"))  # one row
    by = (*MARKET, "radius", "points")
    judged = quality.confusion(rows.where("pattern"), F.col("flag"), *by, "holdout").withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    judged = judged.crossJoin(F.broadcast(held_out))
    train = judged.where(~F.col("holdout") & (F.col("n") >= need)).select(*by)
    judged = judged.where(F.col("holdout") == F.col("_some"))
    flags = rows.groupBy(*by).agg(F.sum(F.col("flag").cast("int")).alias("projected"))
    ok = (F.col("precision") + search.SLACK >= float(learn["target_precision"])) & (F.col("recall") + search.SLACK >= float(learn["min_pattern_recall"]))
    place = F.create_map(*(F.lit(x) for k, (r, n) in enumerate(grid) for x in (f"{r}|{n}", k)))
    good = judged.where(ok).join(train, [*by]).join(flags, [*by]).join(search.first_cap(normal(caps)), [*MARKET], "left").where(F.col("cap").isNull() | (F.col("projected") <= F.col("cap")))
    good = good.withColumn("_k", place[F.concat_ws("|", "radius", "points")]).where("_k is not null")
    best = good.groupBy(*MARKET).agg(F.max_by(F.struct("radius", "points", "recall", "precision"), F.struct("recall", "precision", -F.col("_k"))).alias("best"))
    current = judged.where((F.col("radius") == now_at[0]) & (F.col("points") == now_at[1])).select(*MARKET, F.col("recall").alias("recall_now"))
    labelled = to_markets(own, markets).groupBy(*MARKET).agg(F.count(F.lit(1)).alias("n"))
    j = labelled.join(best, [*MARKET], "left").join(current, [*MARKET], "left").join(normal(applied).select(*MARKET, "applied_at"), [*MARKET], "left")
    lift = F.col("best.recall") - F.coalesce("recall_now", F.lit(0.0))
    reason = (
        F.when(F.lit(c["mode"] == "off"), "mode_off")
        .when(F.col("n") < need, "insufficient_labeled_cache")
        .when(F.lit(not grid), "empty_grid")
        .when(F.col("best").isNull(), "no_candidate_in_gates")
        .when(lift + search.SLACK < float(c["min_recall_lift"]), "insufficient_recall_lift")
        .when(F.col("applied_at") > now - int(c["cooldown_minutes"]) * 60, "cooldown")
        .when(F.lit(c["mode"] == "shadow"), "shadow_no_write")
        .otherwise("holdout_pattern_recall_lift")
    )
    decision = F.when(F.col("reason") == "holdout_pattern_recall_lift", "applied").when(F.col("reason") == "shadow_no_write", "shadow").when(F.col("reason") == "mode_off", "skipped").otherwise("rejected")
    decided = j.withColumn("reason", reason).select(*MARKET, "n", decision.alias("decision"), "reason", F.col("best.radius").alias("radius"), F.col("best.points").alias("points"), lift.alias("recall_lift"))
    out = Work(orders.sparkSession, "retuned").kept(decided, "decisions")
    work.clear()
    return out


def no_overlays(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "region string, city string, path string, value double")


def tuned_values(decisions: DataFrame) -> DataFrame:
    """region, city, path, value of what applied decisions set."""
    head = F.col("head")
    one = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    values = F.array(
        one(F.concat(F.lit("thresholds."), head), F.col("threshold")), one(F.concat(F.lit("blend."), head, F.lit(".rule_weight")), F.col("rule_weight")),
        one(F.concat(F.lit("blend."), head, F.lit(".ml_weight")), F.col("ml_weight")), one(F.lit("routing.p1_attention_min"), F.col("p1_attention_min")),
    )
    return decisions.where("action = 'apply'").select(*MARKET, F.inline(F.filter(values, lambda v: v["value"].isNotNull()))).groupBy(*MARKET, "path").agg(F.max("value").alias("value"))
