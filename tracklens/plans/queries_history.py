"""Registered queries over entity history, quality, search, sampling and stored assessments, each with its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..functions.policy import BOUNDS, DEFAULTS, HEADS, OPERATING_POINT, PROMOTION
from ..operators import calibration, history, quality, sampling, search, store
from ..sources import fixtures
from .queries_tracks import r6
from .twins import on_views, rates, signals

QUERIES, ORACLE = {}, {}
WEEK = 7 * 86400


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = on_views(sql)
        return f

    return keep


def joined(c: str):
    return F.array_join(c, ",")


@register("marketplace_funnel", f"SELECT driver_id, accepts, cancels, completes, with_cause, {rates('accepts', 'cancels', 'completes', 'with_cause')}, {signals('accepts', 'cancels', 'completes', 'with_cause')} FROM (SELECT driver_id, count(*) FILTER (kind = 'accept') AS accepts, count(*) FILTER (kind = 'cancel') AS cancels, count(*) FILTER (kind = 'complete') AS completes, count(*) FILTER (kind = 'cancel' AND with_cause) AS with_cause FROM v_funnel GROUP BY 1)")
def marketplace_funnel(spark, sf_dir):
    t = history.funnel_totals(fixtures.funnel(spark, sf_dir), ["driver_id"], DEFAULTS)
    return t.select("driver_id", "accepts", "cancels", "completes", "with_cause", r6("accept_cancel_rate"), r6("completion_rate"), r6("with_cause_fraction"), joined("signals").alias("signals"))


@register("funnel_trailing", f"SELECT order_id, driver_id, accepts, cancels, completes, with_cause_n, round(cancels / 168.0, 6) AS cancel_rate, {rates('accepts', 'cancels', 'completes', 'with_cause_n')}, {signals('accepts', 'cancels', 'completes', 'with_cause_n')} FROM (SELECT a.order_id, a.driver_id, count(b.order_id) FILTER (b.kind = 'accept') AS accepts, count(b.order_id) FILTER (b.kind = 'cancel') AS cancels, count(b.order_id) FILTER (b.kind = 'complete') AS completes, count(b.order_id) FILTER (b.kind = 'cancel' AND b.with_cause) AS with_cause_n FROM v_funnel a LEFT JOIN v_funnel b ON a.driver_id = b.driver_id AND b.ts BETWEEN a.ts - {WEEK} AND a.ts AND b.order_id <> a.order_id WHERE a.kind = 'cancel' GROUP BY 1, 2)")
def funnel_trailing(spark, sf_dir):
    t = history.trailing_funnel(fixtures.funnel(spark, sf_dir), WEEK, DEFAULTS)
    return t.select("order_id", "driver_id", "accepts", "cancels", "completes", "with_cause_n", r6("cancel_rate"), r6("accept_cancel_rate"), r6("completion_rate"), r6("with_cause_fraction"), joined("market_signals").alias("signals"))


@register("entity_explode", "SELECT kind, count(*) AS rows, count(DISTINCT entity) AS entities FROM (SELECT 'driver' AS kind, 'driver:' || driver_id AS entity FROM v_funnel UNION ALL SELECT 'user', 'user:' || user_id FROM v_funnel WHERE user_id IS NOT NULL UNION ALL SELECT 'pair', 'pair:' || driver_id || ':' || user_id FROM v_funnel WHERE user_id IS NOT NULL) GROUP BY 1")
def entity_explode(spark, sf_dir):
    e = fixtures.funnel(spark, sf_dir).select(F.inline(history.entities(F.col("driver_id"), F.col("user_id"))))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity").alias("entities"))


@register("driver_chain_distinct", f"SELECT a.order_id, a.driver_id, CAST(count(DISTINCT b.order_id) AS INTEGER) AS chain FROM v_funnel a LEFT JOIN v_funnel b ON b.kind = 'cancel' AND a.driver_id = b.driver_id AND b.ts BETWEEN a.ts - {WEEK} AND a.ts AND b.order_id <> a.order_id WHERE a.kind = 'cancel' GROUP BY 1, 2")
def driver_chain_distinct(spark, sf_dir):
    return history.chain_counts(fixtures.funnel(spark, sf_dir).where("kind = 'cancel'"), WEEK).select("order_id", "driver_id", "chain")


@register("device_edges", "SELECT device_id, entity_kind, entity_id, count(*) AS sightings, min(ts) AS first_seen, max(ts) AS last_seen FROM v_edges GROUP BY 1, 2, 3")
def device_edges(spark, sf_dir):
    return history.edge_state(fixtures.edges(spark, sf_dir))


AS_OF = 1706745600  # 2024-02-01
_LIVE = f"live AS (SELECT device_id, entity_kind, entity_id, count(*) AS sightings, max(ts) AS last_seen FROM v_edges WHERE ts <= {AS_OF} GROUP BY 1, 2, 3 HAVING max(ts) >= {AS_OF} - 30 * 86400)"


@register("device_graph_signals", f"""{_LIVE},
dev AS (SELECT device_id, count(*) FILTER (entity_kind = 'driver') AS drivers, count(*) FILTER (entity_kind = 'user') AS users, CAST(coalesce(sum(sightings) FILTER (entity_kind = 'driver'), 0) AS BIGINT) AS driver_sightings, CAST(coalesce(sum(sightings) FILTER (entity_kind = 'user'), 0) AS BIGINT) AS user_sightings FROM live GROUP BY 1),
drv AS (SELECT entity_id AS driver_id, count(*) AS devices, CAST(sum(sightings) AS BIGINT) AS device_sightings FROM live WHERE entity_kind = 'driver' GROUP BY 1)
SELECT l.device_id, l.entity_id AS driver_id, drivers, users, devices, array_to_string(list_filter([CASE WHEN driver_sightings >= 3 AND drivers >= 3 THEN 'multi_account_device' END, CASE WHEN user_sightings >= 3 AND users >= 3 THEN 'multi_user_device' END, CASE WHEN device_sightings >= 3 AND devices >= 4 THEN 'device_hopping' END], lambda x: x IS NOT NULL), ',') AS signals
FROM live l JOIN dev USING (device_id) JOIN drv ON drv.driver_id = l.entity_id WHERE l.entity_kind = 'driver'""")
def device_graph_signals(spark, sf_dir):
    g = history.device_graph(fixtures.edges(spark, sf_dir), AS_OF, DEFAULTS)
    return g.select("device_id", "driver_id", "drivers", "users", "devices", joined("signals").alias("signals"))


@register("shared_device_pairs", f"{_LIVE} SELECT d.device_id, d.entity_id AS driver_id, u.entity_id AS user_id FROM live d JOIN live u ON d.device_id = u.device_id AND d.entity_kind = 'driver' AND u.entity_kind = 'user' JOIN (SELECT DISTINCT driver_id, user_id FROM v_funnel) p ON p.driver_id = d.entity_id AND p.user_id = u.entity_id")
def shared_device_pairs(spark, sf_dir):
    return history.shared_pairs(fixtures.edges(spark, sf_dir), fixtures.funnel(spark, sf_dir), AS_OF, DEFAULTS).select("device_id", "driver_id", "user_id")


@register("device_ewma", "SELECT device_id, round(list_reduce(list(risk ORDER BY ts, event_id), lambda a, x: 0.4 * x + 0.6 * a), 6) AS ewma_risk, count(*) AS sightings, round(arg_max(risk, (ts, event_id)), 6) AS last_instant FROM v_device GROUP BY 1")
def device_ewma(spark, sf_dir):
    t = history.folded(fixtures.device_risks(spark, sf_dir), ["device_id"], "risk", DEFAULTS["device_integrity"]["ewma_alpha"], order=("ts", "event_id"))
    return t.select("device_id", r6("value", "ewma_risk"), F.col("n").alias("sightings"), r6("last_x", "last_instant"))


@register("recoverability_ewma", "SELECT region, head, round(list_reduce(list_prepend(CASE head WHEN 'cancelled_offline' THEN 1.0 WHEN 'cancel_abuse' THEN 0.4 ELSE 0.8 END::DOUBLE, list(CASE outcome WHEN 'clawback_won' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ts, order_id)), lambda a, x: 0.05 * x + 0.95 * a), 6) AS value, count(*) AS n_updates FROM v_outcomes GROUP BY 1, 2")
def recoverability_ewma(spark, sf_dir):
    return history.recoverability(fixtures.outcomes(spark, sf_dir), DEFAULTS).select("region", "head", r6("value"), "n_updates")


_Z = "CASE WHEN len({0}) >= 8 THEN 0.6745 * (x - list_aggregate({0}, 'median')) / greatest(list_aggregate(list_transform({0}, lambda v: abs(v - list_aggregate({0}, 'median'))), 'median'), 0.001) END"


@register("entity_mad_anomaly", f"""a AS (SELECT event_id AS order_id, driver_id AS entity, event_id % 5 AS cohort, ts, value AS x FROM v_events),
f AS (SELECT *, list(x) OVER (PARTITION BY entity ORDER BY ts, order_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS own, list({{'e': entity, 'x': x}}) OVER (PARTITION BY cohort ORDER BY ts, order_id ROWS BETWEEN 600 PRECEDING AND 1 PRECEDING) AS peer FROM a),
g AS (SELECT *, list_transform(list_filter(peer, lambda r: r.e <> entity), lambda r: r.x)[-200:] AS peers FROM f),
h AS (SELECT *, {_Z.format('own')} AS zs, {_Z.format('peers')} AS zp FROM g)
SELECT order_id, entity, round(zs, 6) AS z_self, round(zp, 6) AS z_peer, array_to_string(list_filter([CASE WHEN zs >= 3 THEN 'anomaly_self' END, CASE WHEN zp >= 3 THEN 'anomaly_peer' END], lambda x: x IS NOT NULL), ',') AS signals FROM h""")
def entity_mad_anomaly(spark, sf_dir):
    e = fixtures.events(spark, sf_dir)
    rows = e.select(F.col("driver_id").alias("entity"), (F.col("event_id") % 5).alias("cohort"), F.col("event_id").alias("order_id"), "ts", F.col("value").alias("x"))
    return history.anomalies(rows, DEFAULTS).select("order_id", "entity", r6("z_self"), r6("z_peer"), joined("signals").alias("signals"))


@register("label_metrics", "SELECT *, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM (SELECT head, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall, tp + fn AS support, (tp + fp) / (tp + fp + fn + tn) AS flag_rate FROM (SELECT head, count(*) FILTER (score >= 0.75 AND label = 1) AS tp, count(*) FILTER (score >= 0.75 AND label = 0) AS fp, count(*) FILTER (score < 0.75 AND label = 1) AS fn, count(*) FILTER (score < 0.75 AND label = 0) AS tn FROM v_pairs GROUP BY 1))")
def label_metrics(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return quality.confusion(p, F.col("score") >= quality.threshold_of(F.col("head"), DEFAULTS["thresholds"]), "head").withColumn("f1", F.round("f1", 6))


def pairs(spark, sf_dir):
    return quality.labelled(fixtures.scores(spark, sf_dir), fixtures.labels(spark, sf_dir))


@register("holdout_buckets", "SELECT order_id, head, ('0x' || substr(sha256(CAST(order_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.3 AS holdout FROM v_pairs")
def holdout_buckets(spark, sf_dir):
    return quality.holdout_split(pairs(spark, sf_dir), 0.3).select("order_id", "head", "holdout")


@register("ece_bins", "SELECT head, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy FROM v_pairs GROUP BY 1, 2")
def ece_bins(spark, sf_dir):
    return quality.calibration_bins(pairs(spark, sf_dir), 10, "head").select("head", "bin", "n", r6("confidence"), r6("accuracy"))


@register("calibration_error", "SELECT head, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT head, least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(label) AS a FROM v_pairs GROUP BY 1, 2) GROUP BY 1")
def calibration_error(spark, sf_dir):
    return quality.calibration_error(pairs(spark, sf_dir), 10, "head").select("head", r6("ece"), "n")


@register("baseline_predictors", "SELECT predictor, head, count(*) FILTER (guess AND label = 1) AS tp, count(*) FILTER (guess AND label = 0) AS fp FROM (SELECT 'model' AS predictor, head, score >= 0.75 AS guess, label FROM v_pairs UNION ALL SELECT 'always', head, true, label FROM v_pairs UNION ALL SELECT 'never', head, false, label FROM v_pairs) GROUP BY 1, 2")
def baseline_predictors(spark, sf_dir):
    p = quality.predictors(pairs(spark, sf_dir).withColumn("flag", F.col("score") >= 0.75))
    return quality.confusion(p, F.col("guess"), "predictor", "head").select("predictor", "head", "tp", "fp")


@register("promotion_gates", "SELECT *, round((challenger_caught - champion_caught) / champion_caught, 6) AS catch_lift FROM (SELECT count(DISTINCT order_id) AS assessed, round(sum(order_value) FILTER (score >= 0.7 AND score < 0.75), 4) AS challenger_only, 0.0::DOUBLE AS champion_only, round(sum(order_value) FILTER (score >= 0.7), 4) AS challenger_caught, round(sum(order_value) FILTER (score >= 0.75), 4) AS champion_caught FROM v_heads)")
def promotion_gates(spark, sf_dir):
    h = quality.by_head(fixtures.scores(spark, sf_dir), "score", "order_id", "order_value")
    p = quality.promotion(h.withColumns({"champion": F.col("score") >= 0.75, "challenger": F.col("score") >= 0.70}), PROMOTION)
    return p.select("assessed", *(F.round(c, 4).alias(c) for c in ("challenger_only", "champion_only", "challenger_caught", "champion_caught")), r6("catch_lift"))


@register("fill_report", "SELECT 'category' AS field, count(*) AS n, 1.0::DOUBLE AS share FROM v_orders UNION ALL SELECT 'replacement_order_id', count(*), round(avg(replaced::INT), 6) FROM v_orders")
def fill_report(spark, sf_dir):
    return quality.fill_report(fixtures.orders(spark, sf_dir), ["category", "replacement_order_id"]).select("field", "n", r6("share"))


_CAND = """cell AS (SELECT p.head, ('0x' || substr(sha256(CAST(order_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.3 AS holdout, g.i AS grid_idx, round(0.5 + 0.05 * g.i, 10) AS threshold, count(*) FILTER (score >= round(0.5 + 0.05 * g.i, 10) AND label = 1) AS tp, count(*) FILTER (score >= round(0.5 + 0.05 * g.i, 10) AND label = 0) AS fp, count(*) FILTER (score < round(0.5 + 0.05 * g.i, 10) AND label = 1) AS fn FROM v_pairs p CROSS JOIN range(10) g(i) GROUP BY 1, 2, 3, 4)"""


@register("threshold_search", f"{_CAND} SELECT head, holdout, CAST(grid_idx AS INTEGER) AS grid_idx, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE, 6) AS recall FROM cell")
def threshold_search(spark, sf_dir):
    c = search.threshold_candidates(quality.holdout_split(pairs(spark, sf_dir), 0.3), search.grid(0.5, 0.95))
    return c.select("head", "holdout", "grid_idx", "tp", "fp", "fn", r6("precision"), r6("recall"))


@register("threshold_best", f"{_CAND}, q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall FROM cell), ok AS (SELECT * FROM q WHERE precision >= 0.05 AND recall >= 0.05) SELECT head, threshold::DOUBLE AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT h.*, row_number() OVER (PARTITION BY h.head ORDER BY h.recall DESC, h.precision DESC, h.grid_idx) AS k FROM ok h JOIN ok t ON NOT t.holdout AND h.holdout AND t.head = h.head AND t.grid_idx = h.grid_idx) WHERE k = 1")
def threshold_best(spark, sf_dir):
    c = search.threshold_candidates(quality.holdout_split(pairs(spark, sf_dir), 0.3), search.grid(0.5, 0.95))
    return search.best_threshold(c, 0.05, 0.05).select("head", "threshold", r6("precision"), r6("recall"))


@register("operating_points", "SELECT region, d, round(supply / demand, 6) AS ratio, CASE WHEN r <= 0.8 THEN 'peak' WHEN r >= 1.2 THEN 'surplus' ELSE 'mid' END AS regime, round(CASE WHEN r <= 0.8 THEN 0.85 WHEN r >= 1.2 THEN 0.70 ELSE 0.85 + (0.70 - 0.85) * (r - 0.8) / 0.4 END::DOUBLE, 6) AS min_precision FROM (SELECT *, least(2.0, greatest(0.5, supply / demand)) AS r FROM v_forecast)")
def operating_points(spark, sf_dir):
    f = fixtures.forecast(spark, sf_dir)
    ratio = search.supply_ratio(F.col("supply"), F.col("demand"))
    point = scoring.operating_point(ratio, OPERATING_POINT)
    return f.select("region", F.col("d").cast("bigint").alias("d"), F.round(ratio, 6).alias("ratio"), point["regime"].alias("regime"), F.round(point["min_precision"], 6).alias("min_precision"))


@register("forecast_asof", "SELECT e.event_id AS id, e.event_id % 5 AS region, round(f.supply / f.demand, 6) AS ratio FROM v_events e LEFT JOIN v_forecast f ON f.region = e.event_id % 5 AND e.ts >= f.start_ts AND e.ts < f.end_ts")
def forecast_asof(spark, sf_dir):
    e = fixtures.events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("region"), F.lit("").alias("city"), F.col("ts").alias("at"))
    f = fixtures.forecast(spark, sf_dir).withColumns({"city": F.lit(""), "ingested_at": F.col("start_ts")})
    return search.active_forecast(e, f).select("id", "region", r6("ratio"))


@register("effective_caps", "SELECT n_regionkey AS region, upper(n_name) AS city, 10 + n_nationkey AS cap, n_nationkey % 3 = 0 AS clawback_active, CAST(CASE WHEN n_nationkey % 3 = 0 THEN floor((10 + n_nationkey) * 0.5) ELSE 10 + n_nationkey END AS BIGINT) AS effective_cap FROM nation")
def effective_caps(spark, sf_dir):
    n = fixtures.table(spark, sf_dir, "nation").withColumn("city", geo.market(F.col("n_name")))
    caps = n.select(F.col("n_regionkey").alias("region"), "city", F.lit("day").alias("window"), (F.col("n_nationkey") + 10).alias("cap"))
    claw = n.where("n_nationkey % 3 = 0").select(F.col("n_regionkey").alias("region"), "city", F.lit(100).alias("until_ts"))
    return search.effective_caps(caps, claw, 50).select("region", "city", "cap", "clawback_active", "effective_cap")


@register("policy_resolved", "SELECT upper(r_name) AS region_code, upper(n_name) AS city_code, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 0.9 END, CASE WHEN r_regionkey % 2 = 0 THEN 0.8 END, 0.75)::DOUBLE AS threshold FROM nation JOIN region ON n_regionkey = r_regionkey")
def policy_resolved(spark, sf_dir):
    m = fixtures.markets(spark, sf_dir)
    r = fixtures.table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(geo.market(F.col("r_name")).alias("region_code"), F.lit(0.8).alias("threshold"))
    c = m.where("nation % 4 = 0").select("region_code", "city_code", F.lit(0.9).alias("threshold"))
    return search.resolved_policy(m, r, c, {"threshold": 0.75})


@register("guardrail_violations", "SELECT upper(r_name) AS region_code, 'dbscan.min_pts' AS path, r_regionkey * 10.0::DOUBLE AS value, 'out_of_bounds' AS violation FROM region WHERE r_regionkey * 10 < 3 OR r_regionkey * 10 > 30 UNION ALL SELECT upper(r_name), 'dwell.place_factors.curb', 1.0::DOUBLE, 'unbounded' FROM region")
def guardrail_violations(spark, sf_dir):
    r = fixtures.table(spark, sf_dir, "region").select(geo.market(F.col("r_name")).alias("region_code"), "r_regionkey")
    values = r.select("region_code", F.lit("dbscan.min_pts").alias("path"), (F.col("r_regionkey") * 10.0).alias("value")).unionByName(r.select("region_code", F.lit("dwell.place_factors.curb").alias("path"), F.lit(1.0).alias("value")))
    bounds = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in BOUNDS.items()], "path string, low double, high double")
    return search.guardrail_violations(values, bounds)


@register("score_bands", "SELECT head, CASE WHEN score < 0.75 - 0.1 THEN 'low' WHEN score > 0.75 + 0.1 THEN 'high' ELSE 'mid' END AS band, count(*) AS n FROM v_heads GROUP BY 1, 2")
def score_bands(spark, sf_dir):
    h = quality.by_head(fixtures.scores(spark, sf_dir), "score", "order_id")
    return h.groupBy("head", scoring.score_band(F.col("score"), 0.75, 0.1).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_REASON = "reasoned AS (SELECT *, CASE WHEN cancelled_offline >= 0.85 OR cancel_abuse >= 0.70 OR selective_theft >= 0.70 THEN 'pattern_mass' WHEN abs(cancelled_offline - 0.75) <= 0.1 OR abs(cancel_abuse - 0.75) <= 0.1 OR abs(selective_theft - 0.75) <= 0.1 THEN 'uncertainty' END AS ticket_reason FROM v_scores)"


@register("ticket_inline_reason", f"{_REASON} SELECT order_id, ticket_reason, CASE ticket_reason WHEN 'pattern_mass' THEN 90 WHEN 'uncertainty' THEN 80 ELSE 0 END AS priority FROM reasoned")
def ticket_inline_reason(spark, sf_dir):
    return sampling.inline_reason(fixtures.scores(spark, sf_dir), DEFAULTS).select("order_id", "ticket_reason", F.coalesce("priority", F.lit(0)).alias("priority"))


@register("ticket_soft_cap", f"{_REASON} SELECT day, order_id FROM (SELECT CAST(make_timestamp(ts * 1000000)::DATE AS VARCHAR) AS day, order_id, row_number() OVER (PARTITION BY make_timestamp(ts * 1000000)::DATE ORDER BY ts, order_id) AS k FROM reasoned WHERE ticket_reason IS NOT NULL) WHERE k <= 30")
def ticket_soft_cap(spark, sf_dir):
    r = sampling.inline_reason(fixtures.scores(spark, sf_dir), DEFAULTS).withColumn("day", geo.day_key(F.col("ts")))
    return sampling.inline_tickets(r, DEFAULTS).select("day", "order_id")


@register("unlabeled_antijoin", "SELECT order_id FROM v_scores WHERE order_id NOT IN (SELECT doc_id FROM labels) AND order_id % 7 <> 0")
def unlabeled_antijoin(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    return sampling.unlabelled(s, fixtures.labels(spark, sf_dir), s.where("order_id % 7 = 0")).select("order_id")


@register("latest_assessment", "SELECT order_id, policy_hash, generation, assessed_at FROM (SELECT *, max(generation) OVER (PARTITION BY order_id) AS g FROM v_generations) WHERE generation = g")
def latest_assessment(spark, sf_dir):
    return store.latest_all(fixtures.generations(spark, sf_dir)).select("order_id", "policy_hash", "generation", "assessed_at")


@register("latest_one", "SELECT order_id, policy_hash, generation FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY generation DESC, assessed_at DESC, policy_hash DESC) AS k FROM v_generations) WHERE k = 1")
def latest_one(spark, sf_dir):
    return store.latest(fixtures.generations(spark, sf_dir)).select("order_id", "policy_hash", "generation")


@register("next_generation", "SELECT order_id, max(generation) + 1 AS next_generation FROM v_generations GROUP BY 1")
def next_generation(spark, sf_dir):
    g = fixtures.generations(spark, sf_dir)
    return store.next_generation(g, g)


@register("generation_provisional", "SELECT order_id, policy_hash, generation FROM v_generations WHERE generation < 3 AND order_id % 3 = 2")
def generation_provisional(spark, sf_dir):
    g = fixtures.generations(spark, sf_dir)
    return store.mark_provisional(g, g.where("generation = 3").select("order_id", "generation").distinct()).select("order_id", "policy_hash", "generation")


@register("feedback_lww", "SELECT user_id AS order_id, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) WHERE k = 1")
def feedback_lww(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), F.col("event_type").alias("label"), F.col("ts").alias("created_at"))
    return store.last_write(e).select("order_id", "label")


@register("pending_requests", "SELECT DISTINCT order_id FROM v_generations WHERE order_id % 10 <> 0")
def pending_requests(spark, sf_dir):
    g = fixtures.generations(spark, sf_dir)
    return store.missing(g.withColumn("policy_hash", F.lit("p2")).select("order_id", "policy_hash").distinct(), g, ("order_id", "policy_hash")).select("order_id")


@register("lineage_hash", "SELECT order_id, sha256(order_id || '|' || assign_ts || '|' || cancel_ts) AS lineage_id FROM v_orders")
def lineage_hash(spark, sf_dir):
    event = lambda c: F.struct(F.when(F.col("order_id") % 2 == 0, F.col(c).cast("string")).alias("ts"), F.col(c).cast("string").alias("timestamp"))
    return fixtures.orders(spark, sf_dir).select("order_id", geo.lineage_id(F.col("order_id"), F.array(event("cancel_ts"), event("assign_ts"))).alias("lineage_id"))


@register("canary_cohort", "SELECT order_id, ('0x' || substr(sha256(CAST(order_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 5 AS in_canary FROM v_orders")
def canary_cohort(spark, sf_dir):
    return fixtures.orders(spark, sf_dir).select("order_id", (geo.hash_share(F.col("order_id")) % 100 < int(PROMOTION["canary_pct"])).alias("in_canary"))


@register("pattern_cohort", "SELECT count(*) FILTER (cancelled_offline >= 0.85) AS cancelled_offline, count(*) FILTER (cancel_abuse >= 0.70) AS cancel_abuse, count(*) FILTER (selective_theft >= 0.70) AS selective_theft FROM v_scores")
def pattern_cohort(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    return s.agg(*(F.sum(F.when(sampling.in_pattern(h, DEFAULTS, F.col(h)), 1).otherwise(0)).cast("bigint").alias(h) for h in HEADS))


@register("blended_scores", "SELECT order_id, round(0.6 * cancelled_offline + 0.4 * cancel_abuse, 6) AS blended FROM v_scores")
def blended_scores(spark, sf_dir):
    return fixtures.scores(spark, sf_dir).select("order_id", F.round(scoring.blend(F.col("cancelled_offline"), F.col("cancel_abuse"), "cancelled_offline", DEFAULTS), 6).alias("blended"))


@register("funnel_rollup", "SELECT coalesce(region_code, '*') AS region_code, coalesce(city_code, '*') AS city_code, count(*) FILTER (kind = 'cancel') AS cancels, count(DISTINCT driver_id) AS drivers FROM (SELECT f.*, upper(r_name) AS region_code, upper(n_name) AS city_code FROM v_funnel f JOIN nation ON n_nationkey = f.driver_id % 25 JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (region_code, city_code)")
def funnel_rollup(spark, sf_dir):
    f = fixtures.funnel(spark, sf_dir).withColumn("nation", F.col("driver_id") % 25).join(fixtures.markets(spark, sf_dir), "nation")
    g = f.rollup("region_code", "city_code").agg(F.sum(F.when(F.col("kind") == "cancel", 1).otherwise(0)).cast("bigint").alias("cancels"), F.countDistinct("driver_id").alias("drivers"))
    return g.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("region_code", "city_code")})


@register("bearing_error", "SELECT order_id, round(b, 6) AS course, round(least(d, 360 - d), 6) AS error FROM (SELECT *, abs(90 - b) % 360 AS d FROM (SELECT order_id, (degrees(atan2(sin(radians(121.08 - lon)) * cos(radians(14.65::DOUBLE)), cos(radians(lat)) * sin(radians(14.65::DOUBLE)) - sin(radians(lat)) * cos(radians(14.65::DOUBLE)) * cos(radians(121.08 - lon)))) + 360) % 360 AS b FROM v_orders JOIN v_pings USING (track_id) WHERE seq = 100 * (order_id % 100000)))")
def bearing_error(spark, sf_dir):
    o = fixtures.orders(spark, sf_dir).select("order_id", "track_id", (100 * (F.col("order_id") % 100_000)).alias("seq"))
    p = fixtures.pings(spark, sf_dir).join(o, ["track_id", "seq"])
    b = geo.bearing(F.col("lat"), F.col("lon"), F.lit(14.65), F.lit(121.08))
    return p.select("order_id", F.round(b, 6).alias("course"), F.round(geo.heading_error(F.lit(90.0), b), 6).alias("error"))


@register("device_effects", "SELECT device_id, round(greatest(i, e), 6) AS device_risk, greatest(i, e) >= 0.7 AS device_fires, round(CASE WHEN greatest(i, e) >= 0.7 THEN 0.35 * greatest(i, e) ELSE 0 END, 6) AS device_bonus FROM (SELECT device_id, list_reduce(list(risk ORDER BY ts, event_id), lambda a, x: 0.4 * x + 0.6 * a) AS e, arg_max(risk, (ts, event_id)) AS i FROM v_device GROUP BY 1)")
def device_effects(spark, sf_dir):
    t = history.folded(fixtures.device_risks(spark, sf_dir), ["device_id"], "risk", DEFAULTS["device_integrity"]["ewma_alpha"], order=("ts", "event_id"))
    t = t.withColumns(scoring.device_effect(F.col("last_x"), F.col("value"), F.lit(False), DEFAULTS))
    return t.select("device_id", r6("device_risk"), "device_fires", r6("device_bonus"))


@register("chat_merge", "SELECT driver_id * 100 + event_id % 7 AS order_id, any_value(driver_id) AS driver_id, bool_or(event_type = 'view') AS persuasion, bool_or(event_type = 'click') AS cash, bool_or(event_type = 'error') AS forced, round(max(least(1.0, value / 1000.0)), 6) AS score, max(ts) AS ts FROM v_events GROUP BY 1")
def chat_merge(spark, sf_dir):
    return chats(spark, sf_dir).select("order_id", "driver_id", "persuasion", "cash", "forced", r6("score"), "ts")


def raw_chats(spark, sf_dir):
    """A row for each message (id): its order's, with flags, score and time."""
    e = fixtures.events(spark, sf_dir)
    kind = lambda k: F.col("event_type") == k
    return e.select((F.col("driver_id") * 100 + F.col("event_id") % 7).alias("order_id"), "driver_id", kind("view").alias("persuasion"), kind("click").alias("cash"), kind("error").alias("forced"), F.least(F.lit(1.0), F.col("value") / 1000.0).alias("score"), F.lit("app").alias("source"), "ts", F.col("event_id").alias("id"))


def chats(spark, sf_dir):
    return history.merge_chat(raw_chats(spark, sf_dir).drop("id"))


@register("chat_risk", "SELECT a.order_id, round(a.risk, 6) AS risk, CAST(count(b.order_id) AS BIGINT) AS repeats, round(CASE WHEN a.risk >= 0.55 THEN 0.4 * a.risk ELSE 0 END + CASE WHEN count(b.order_id) >= 3 THEN 0.2 ELSE 0 END, 6) AS bonus FROM (SELECT *, greatest(score, CASE WHEN forced THEN 0.9 ELSE 0 END, CASE WHEN cash THEN 0.85 ELSE 0 END, CASE WHEN persuasion THEN 0.7 ELSE 0 END) AS risk FROM c) a LEFT JOIN (SELECT *, greatest(score, CASE WHEN forced THEN 0.9 ELSE 0 END, CASE WHEN cash THEN 0.85 ELSE 0 END, CASE WHEN persuasion THEN 0.7 ELSE 0 END) AS risk FROM c) b ON a.driver_id = b.driver_id AND b.ts BETWEEN a.ts - 604800 AND a.ts AND b.order_id <> a.order_id AND b.risk >= 0.55 GROUP BY a.order_id, a.risk")
def chat_risk(spark, sf_dir):
    c = chats(spark, sf_dir).withColumn("risk", scoring.chat_instant(F.col("score"), F.col("forced"), F.col("cash"), F.col("persuasion")))
    t = history.risky_chats(c, 7 * 86400, DEFAULTS["chat_signals"]["risk_threshold"])
    return t.select("order_id", r6("risk"), F.col("repeats").cast("bigint").alias("repeats"), F.round(scoring.chat_bonus(F.col("risk"), F.lit(False), F.col("repeats"), DEFAULTS), 6).alias("bonus"))


ORACLE["chat_risk"] = ORACLE["chat_risk"].replace("SELECT a.order_id", ", c AS (SELECT driver_id * 100 + event_id % 7 AS order_id, any_value(driver_id) AS driver_id, bool_or(event_type = 'view') AS persuasion, bool_or(event_type = 'click') AS cash, bool_or(event_type = 'error') AS forced, max(least(1.0, value / 1000.0)) AS score, max(ts) AS ts FROM v_events GROUP BY 1) SELECT a.order_id", 1)


@register("calibrators")
def calibrators(spark, sf_dir):
    rows = calibration.fit(pairs(spark, sf_dir).select("order_id", "head", "score", "label"), DEFAULTS)
    return spark.createDataFrame([(r["head"], r["n"], r["decision"], r["method"], r["ece"]) for r in rows], "head string, n bigint, decision string, method string, ece double")
