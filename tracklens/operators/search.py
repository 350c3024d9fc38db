"""Threshold and clustering search, operating points, forecasts and caps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import market
from ..functions.scoring import ratio
from ..sources.shared import Work
from . import quality

SLACK = 1e-12


def grid(low: float, high: float, step: float = 0.05) -> list[float]:
    n = int(round((high - low) / step))
    return [round(low + k * step, 10) for k in range(n + 1)]


def threshold_candidates(pairs: DataFrame, thresholds: list[float], by: tuple[str, ...] = ("head", "holdout")) -> DataFrame:
    """Confusion of each group and candidate threshold. The grid is a short literal array, exploded after scores are
    counted by grid cell, so rows of the data are not multiplied."""
    t = F.array(*map(F.lit, thresholds))
    cell = F.size(F.filter(t, lambda x: x <= F.col("score")))
    counted = pairs.groupBy(*by, cell.alias("cell"), "label").agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("c", F.explode(F.transform(t, lambda x, i: F.struct(i.alias("grid_idx"), x.alias("threshold")))))
    flag = F.col("cell") > F.col("c.grid_idx")
    n = lambda f, y: F.sum(F.when((flag if f else ~flag) & (F.col("label") == y), F.col("n")).otherwise(0)).cast("bigint")
    g = each.groupBy(*by, "c.grid_idx", "c.threshold").agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"))
    return g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def best_threshold(candidates: DataFrame, min_precision: float, min_recall: float) -> DataFrame:
    """Each head's best candidate that passes both gates on both splits: most holdout recall, then precision, then the first."""
    ok = (F.col("precision") + SLACK >= min_precision) & (F.col("recall") + SLACK >= min_recall)
    good = candidates.where(ok)
    train = good.where("not holdout").select("head", "grid_idx")
    held = good.where("holdout").join(train, ["head", "grid_idx"])
    w = Window.partitionBy("head").orderBy(F.col("recall").desc(), F.col("precision").desc(), "grid_idx")
    return held.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("head", "threshold", "precision", "recall")


def active_forecast(asks: DataFrame, forecast: DataFrame) -> DataFrame:
    """asks (id, region, city, at; id unique) with the forecast whose interval holds `at`: the city's own row first, then the region's; the last ingested of several.

    Intervals are laid out by day, so asks meet only the intervals of their market and day, in as many tasks as there
    are regions times days; of what fits the best is taken by one aggregate.
    """
    days = F.explode(F.sequence(F.floor(F.col("start_ts") / 86400), F.floor((F.col("end_ts") - 1) / 86400)))
    f = forecast.select("region", market(F.col("city")).alias("fc"), "start_ts", "end_ts", "supply", "demand", "ingested_at").where("end_ts > start_ts").withColumn("day", days)
    a = asks.select("id", "region", market(F.col("city")).alias("ac"), "at", F.floor(F.col("at") / 86400).alias("day"))
    fits = ((F.col("fc") == "") | (F.col("fc") == F.col("ac"))) & (F.col("start_ts") <= F.col("at")) & (F.col("at") < F.col("end_ts"))
    best = F.max_by(F.struct("supply", "demand"), F.struct((F.col("fc") != "").alias("own"), "ingested_at", "start_ts")).alias("f")
    found = a.join(f, ["region", "day"]).where(fits).groupBy("id").agg(best)
    return asks.join(found, "id", "left").select("id", "region", "city", "at", F.col("f.supply").alias("supply"), F.col("f.demand").alias("demand"), supply_ratio(F.col("f.supply"), F.col("f.demand")).alias("ratio"))


def supply_ratio(supply: Column, demand: Column) -> Column:
    return F.when(demand > 0, supply / F.when(demand > 0, demand))


def effective_caps(caps: DataFrame, clawbacks: DataFrame, now: int) -> DataFrame:
    """caps (region, city, window, cap) with effective_cap: half, rounded down, while a clawback of the market is active."""
    live = clawbacks.groupBy("region", "city").agg((F.max("until_ts") > now).alias("clawback"))
    on = F.coalesce("clawback", F.lit(False))
    return caps.join(live, ["region", "city"], "left").select("region", "city", "window", "cap", on.alias("clawback_active"), F.when(on, F.floor(F.col("cap") * 0.5)).otherwise(F.col("cap")).cast("bigint").alias("effective_cap"))


def first_cap(caps: DataFrame) -> DataFrame:
    """The cap that counts in each market: the hour's, else the day's, else the week's."""
    of = lambda w: F.max(F.when(F.col("window") == w, F.col("cap")))
    return caps.groupBy("region", "city").agg(F.coalesce(of("hour"), of("day"), of("week")).alias("cap"))


def resolved_policy(markets: DataFrame, region: DataFrame, city: DataFrame, base: dict[str, float]) -> DataFrame:
    """markets (region_code, city_code) with each parameter of base: the city's overlay, else the region's, else base.

    Overlay tables hold one row a market and are joined by broadcast only as Spark's own size limit allows."""
    r = region.select("region_code", *(F.col(p).alias("r_" + p) for p in base))
    c = city.select("region_code", "city_code", *(F.col(p).alias("c_" + p) for p in base))
    j = markets.join(r, "region_code", "left").join(c, ["region_code", "city_code"], "left")
    return j.select("region_code", "city_code", *(F.coalesce(F.col("c_" + p), F.col("r_" + p), F.lit(v)).alias(p) for p, v in base.items()))


def guardrail_violations(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """values (region_code, path, value) that have no bound or lie outside of it."""
    j = values.join(bounds, "path", "left")
    why = F.when(F.col("low").isNull(), "unbounded").when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), "out_of_bounds")
    return j.withColumn("violation", why).where("violation is not null").select("region_code", "path", "value", "violation")


def retune_grid(policy: dict[str, Any], bounds: dict[str, tuple[float, float]]) -> list[tuple[int, int]]:
    """(radius, points) of the policy's grid within bounds; a value without a bound is allowed."""
    g = policy["dbscan_retune"]["grid"]
    inside = lambda path, v: path not in bounds or bounds[path][0] <= v <= bounds[path][1]
    return [(r, n) for r in g["clustering_radius_m"] if inside("dbscan.clustering_radius_m", r) for n in g["min_pts"] if inside("dbscan.min_pts", n)]


def retune_candidates(orders: DataFrame, pings: DataFrame, policy: dict[str, Any], grid: list[tuple[int, int]]) -> DataFrame:
    """order_id, radius, points and stop_confidence of every order under every candidate; a track's distances are computed once for all of them."""
    from . import tracks

    found = tracks.measured(orders, pings, policy, ("grid",), grid=grid).select("order_id", F.posexplode("grid").alias("_c", "stop_confidence"))
    at = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in grid)), F.col("_c") + 1)
    return found.select("order_id", at(0).alias("radius"), at(1).alias("points"), "stop_confidence")


def replay(orders: DataFrame, pings: DataFrame, policy: dict[str, Any], grid: list[tuple[int, int]]) -> DataFrame:
    """order_id, radius, points and score, the offline head's, of every order under every candidate.

    What doesn't hang on the clustering (window, dwells, sequence, integrity) is computed once an order, and so are a track's
    distances; confidences, the replacement's verdict and the score are a candidate's own. ml_cancelled_offline is blended
    in where orders have it. Runs when it is called.
    """
    from ..functions import scoring
    from . import tracks

    df = tracks.resolve_window(tracks.attach(orders, pings, policy), policy)
    for step in (tracks.presence_scale, tracks.dwell_fraction, tracks.visits, tracks.sequence, tracks.integrity):
        df = step(df, policy)
    work = Work(orders.sparkSession, "replay")
    df = tracks.grid_confidences(work.kept(df, "tracks"), policy, grid).drop("track")
    none = F.array().cast("array<string>")
    if "replacement_order_id" in orders.columns:
        df = tracks.replacement(df, policy)
    else:
        df = df.withColumns({"replacement_order_id": F.lit(None).cast("string"), "replacement_valid": F.lit(False), "replacement_reasons": none})
    df = df.withColumns({"stop_confidence": scoring.clip(F.col("stop_confidence") * F.col("gps_multiplier")), "abuse_score": F.lit(0.0), "theft_score": F.lit(0.0), "abuse_reasons": none, "theft_reasons": none})
    ml = F.col("ml_cancelled_offline") if "ml_cancelled_offline" in orders.columns else F.lit(None).cast("double")
    scored = scoring.rules(df, policy).select("order_id", "radius", "points", scoring.blend(F.col("rule_cancelled_offline"), ml, "cancelled_offline", policy).alias("score"))
    out = Work(orders.sparkSession, "replayed").kept(scored, "scores")
    work.clear()
    return out
