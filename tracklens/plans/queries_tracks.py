"""Registered queries over tracks and whole assessments, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import DEFAULTS, HEADS, merged
from ..operators import history, quality, search, tracks, tuning
from ..sources import fixtures
from . import assess
from .twins import BASELINES, EVIDENCE_SQL, distance, on_heads, on_tracks, on_views

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def money(name: str):
    """An amount at ten decimals, one more than a product of amount, score and weights has, so none lies halfway between two."""
    return F.round(F.col(name), 10).alias(name)


def r6(name: str, alias: str | None = None):
    """A number at six decimals, rounded as a double as the twins round it: F.round(x, 6) takes the decimals of its text, which has 323 of 640 a millionth higher."""
    return (F.round(F.col(name).cast("double") * 1e6, 0) / 1e6).alias(alias or name.split(".")[-1])


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = fixtures.orders(spark, sf_dir), fixtures.pings(spark, sf_dir)
    return tracks.resolve_window(tracks.attach(o, p, DEFAULTS), DEFAULTS)


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.geometry(fixtures.orders(spark, sf_dir), fixtures.pings(spark, sf_dir), DEFAULTS)


#: The policy of whole assessments over the derived orders: histories that short for baselines and graph edges to count.
LIVE = merged(DEFAULTS, {"device_graph": {"window_days": 365}, "anomaly": {"window_n": 6, "peer_window_n": 40, "min_support": 4}, "baselines": {"window_n": 4, "pair_window_n": 2, "max_age_days": 4000, "min_ewma_samples": 4, "under_fraction": 0.7, "above_fraction": 0.5, "above_epsilon": 0.02}})
AS_OF = 801964800  # 1995-06-01


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = assess.History(events=fixtures.order_events(spark, sf_dir), edges=fixtures.order_edges(spark, sf_dir), as_of=AS_OF, chats=fixtures.order_chats(spark, sf_dir), anomalies=True, baselines=True)
    return assess.assess(fixtures.orders(spark, sf_dir), fixtures.pings(spark, sf_dir), LIVE, history=history)


@register("gps_window_expand", on_tracks("SELECT order_id, window_start, window_end, expanded, CAST(point_count AS INTEGER) AS point_count, round(max_gap_minutes, 6) AS max_gap_minutes, point_count < 20 OR max_gap_minutes > 45 AS gps_sparse FROM win JOIN prof USING (order_id)"))
def gps_window_expand(spark, sf_dir):
    return windowed(spark, sf_dir).select("order_id", "window_start", "window_end", "expanded", "point_count", r6("max_gap_minutes"), "gps_sparse")


@register("track_gap_profile", on_tracks("SELECT order_id, CAST(point_count AS INTEGER) AS point_count, round(max_gap_minutes, 6) AS max_gap_minutes, round(gap_median, 6) AS gap_median FROM prof"))
def track_gap_profile(spark, sf_dir):
    return tracks.presence_scale(windowed(spark, sf_dir), DEFAULTS).select("order_id", "point_count", r6("max_gap_minutes"), r6("gap_median"))


@register("presence_autoscale", on_tracks("SELECT order_id, round(gap_median, 6) AS gap_median, round(target, 6) AS dwell_target_s, min_pts, drop_min_pts FROM pres"))
def presence_autoscale(spark, sf_dir):
    return tracks.presence_scale(windowed(spark, sf_dir), DEFAULTS).select("order_id", r6("gap_median"), r6("dwell_target_s"), "min_pts", "drop_min_pts")


@register("stop_confidence", on_tracks("SELECT w.order_id, round(max(CASE WHEN stop_idx = 0 THEN confidence END), 6) AS pickup_confidence, round(max(CASE WHEN stop_idx = ns - 1 THEN confidence END), 6) AS drop_confidence, round(coalesce(avg(confidence), 0), 6) AS stop_confidence FROM win w LEFT JOIN conf USING (order_id) GROUP BY 1"))
def stop_confidence(spark, sf_dir):
    df = tracks.measured(fixtures.orders(spark, sf_dir), fixtures.pings(spark, sf_dir), DEFAULTS, ("stops",))
    return df.select("order_id", F.round(F.get("confidences", 0), 6).alias("pickup_confidence"), F.round(F.try_element_at("confidences", F.lit(-1)), 6).alias("drop_confidence"), r6("stop_confidence"))


@register("dbscan_membership", on_tracks("SELECT tp.order_id, count(*) AS pings, count(d.rn) AS clustered, count(c.rn) AS cores FROM tp LEFT JOIN dense d ON d.order_id = tp.order_id AND d.rn = tp.rn LEFT JOIN core c ON c.order_id = tp.order_id AND c.rn = tp.rn GROUP BY 1"))
def dbscan_membership(spark, sf_dir):
    df = tracks.measured(fixtures.orders(spark, sf_dir), fixtures.pings(spark, sf_dir), DEFAULTS, ("clusters",))
    return df.where("point_count > 0").select("order_id", F.col("point_count").cast("bigint").alias("pings"), "clustered", "cores")


@register("stop_visits", on_tracks("SELECT order_id, coalesce(pickup_ts, -1) AS pickup_ts, coalesce(drop_ts, -1) AS drop_ts, drop_before, both_visited, order_ok, CAST(len(mid) AS INTEGER) AS middles_hit FROM seqr"))
def stop_visits(spark, sf_dir):
    return tracks.visits(windowed(spark, sf_dir), DEFAULTS).select("order_id", F.coalesce("pickup_ts", F.lit(-1)).alias("pickup_ts"), F.coalesce("drop_ts", F.lit(-1)).alias("drop_ts"), "drop_before", "both_visited", "order_ok", "middles_hit")


@register("sequence_resolution", on_tracks("SELECT order_id, round(path_score, 6) AS path_score, round(sequence_score, 6) AS sequence_score, sequence_reason FROM seqr"))
def sequence_resolution(spark, sf_dir):
    return tracks.sequence(tracks.visits(windowed(spark, sf_dir), DEFAULTS), DEFAULTS).select("order_id", r6("path_score"), r6("sequence_score"), "sequence_reason")


@register("dwell_runs", on_heads("SELECT order_id, dwell_pickup, dwell_drop, round(dwell_fraction, 6) AS dwell_fraction FROM dwf"))
def dwell_runs(spark, sf_dir):
    df = tracks.dwell_fraction(tracks.presence_scale(windowed(spark, sf_dir), DEFAULTS), DEFAULTS)
    return df.select("order_id", F.get("dwell", 0).alias("dwell_pickup"), F.element_at("dwell", -1).alias("dwell_drop"), r6("dwell_fraction"))


@register("cancel_stage", on_tracks("SELECT g.order_id, round(m, 3) AS merchant_dist_m, round(d, 3) AS dropoff_dist_m, cancel_stage, cancel_stage IN ('at_merchant', 'en_route', 'near_dropoff') AND NOT drop_before AS after_pickup, coalesce(d <= 400, false) AS near_dest FROM stg g JOIN seqr USING (order_id)"))
def cancel_stage(spark, sf_dir):
    df = tracks.stage(tracks.visits(windowed(spark, sf_dir), DEFAULTS), DEFAULTS)
    return df.select("order_id", F.round("merchant_dist_m", 3).alias("merchant_dist_m"), F.round("dropoff_dist_m", 3).alias("dropoff_dist_m"), "cancel_stage", "after_pickup", "near_dest")


@register("pickup_progress", on_tracks("SELECT order_id, round(progress_ratio, 6) AS progress_ratio, measured AND progress_ratio < 0.15 AND coalesce(d0 > 200, false) AS no_progress, wrong AS wrong_direction, round(away_fraction, 6) AS away_fraction FROM prog"))
def pickup_progress(spark, sf_dir):
    return tracks.progress(windowed(spark, sf_dir), DEFAULTS).select("order_id", r6("progress_ratio"), "no_progress", "wrong_direction", r6("away_fraction"))


@register("track_integrity", on_tracks("SELECT order_id, round(max_jump_m, 3) AS max_jump_m, round(max_speed_mps, 3) AS max_speed_mps, max_jump_m >= 2000 AS teleport, max_speed_mps >= 55 AS speed_spike FROM integ"))
def track_integrity(spark, sf_dir):
    df = tracks.integrity(windowed(spark, sf_dir), DEFAULTS)
    return df.select("order_id", F.round("max_jump_m", 3).alias("max_jump_m"), F.round("max_speed_mps", 3).alias("max_speed_mps"), "teleport", "speed_spike")


@register("replacement_verdict", on_heads("SELECT order_id, reached AS reached_destination, round(delay, 6) AS delay_min, round(similarity, 6) AS route_similarity, valid AS replacement_valid FROM repv"))
def replacement_verdict(spark, sf_dir):
    return geometry(spark, sf_dir).select("order_id", "reached_destination", r6("replacement_delay_min", "delay_min"), r6("route_similarity"), "replacement_valid")


@register("head_scores", on_heads("SELECT order_id, round(abuse_score, 6) AS abuse_score, round(theft_score, 6) AS theft_score, round(s_offline, 6) AS score_cancelled_offline, round(s_abuse, 6) AS score_cancel_abuse, round(s_theft, 6) AS score_selective_theft, f_offline AS flag_cancelled_offline, f_abuse AS flag_cancel_abuse, f_theft AS flag_selective_theft FROM money"))
def head_scores(spark, sf_dir):
    df = assessed(spark, sf_dir)
    return df.select("order_id", r6("abuse_score"), r6("theft_score"), *(r6(f"score_{h}") for h in HEADS), *(f"flag_{h}" for h in HEADS))


@register("ear_attention", on_heads("SELECT order_id, round(e_offline, 10) AS ear_cancelled_offline, round(e_abuse, 10) AS ear_cancel_abuse, round(e_theft, 10) AS ear_selective_theft, round(ear_total, 10) AS ear_total, round(attention, 10) AS attention_score FROM final"))
def ear_attention(spark, sf_dir):
    return assessed(spark, sf_dir).select("order_id", *map(money, (*(f"ear_{h}" for h in HEADS), "ear_total", "attention_score")))


@register("routing_queue", on_heads("SELECT priority, queue, count(*) AS orders, round(sum(attention), 3) AS attention FROM routed GROUP BY 1, 2"))
def routing_queue(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("priority", "queue").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("attention_score"), 3).alias("attention"))


@register("assessments", on_heads("SELECT order_id, cancel_stage, gps_sparse AS provisional, round(s_offline, 6) AS score_cancelled_offline, round(s_abuse, 6) AS score_cancel_abuse, round(s_theft, 6) AS score_selective_theft, round(attention, 10) AS attention_score, priority, queue FROM routed"))
def assessments(spark, sf_dir):
    return assessed(spark, sf_dir).select("order_id", "cancel_stage", "provisional", *(r6(f"score_{h}") for h in HEADS), money("attention_score"), "priority", "queue")


_REASONS = "SELECT order_id, CAST(unnest(range(len(reasons))) AS INTEGER) AS place, unnest(reasons) AS reason FROM routed"


@register("assessment_reasons", on_heads(_REASONS))
def assessment_reasons(spark, sf_dir):
    return assessed(spark, sf_dir).select("order_id", F.posexplode_outer("reasons").alias("place", "reason"))


@register("evidence_topk", on_heads(EVIDENCE_SQL))
def evidence_topk(spark, sf_dir):
    e = assessed(spark, sf_dir).select("order_id", F.posexplode_outer("evidence").alias("place", "e"))
    return e.select("order_id", "place", F.col("e.feature").alias("feature"), F.col("e.head").alias("head"), F.round("e.weight", 6).alias("weight"))


@register("reason_counts", on_heads("SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM routed) GROUP BY 1"))
def reason_counts(spark, sf_dir):
    return assessed(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_REPLAY = """cdt(radius, points) AS (VALUES (30, 5), (50, 7), (80, 15)),
rnear AS (SELECT c.radius, c.points, a.order_id, a.rn, a.lat, a.lon, count(*) AS n FROM tp a JOIN tp b ON a.order_id = b.order_id JOIN cdt c ON """ + distance("a.lat", "a.lon", "b.lat", "b.lon") + """ <= c.radius GROUP BY ALL),
rpts AS (SELECT c.radius, c.points, p.order_id, p.drop_min_pts, CASE WHEN gaps >= 3 THEN CAST(least(30, greatest(3, round_even(c.points * (target / 120.0::DOUBLE * (5.0 / least(30.0, greatest(1.0, gap_median)))::DOUBLE), 0))) AS INTEGER) ELSE c.points END AS k FROM pres p CROSS JOIN cdt c),
rcore AS (SELECT n.* FROM rnear n JOIN rpts r USING (radius, points, order_id) WHERE n.n >= r.k),
rdense AS (SELECT DISTINCT b.radius, b.points, a.order_id, a.rn FROM tp a JOIN rcore b ON a.order_id = b.order_id AND """ + distance("a.lat", "a.lon", "b.lat", "b.lon") + """ <= b.radius),
rtier AS (SELECT c.radius, c.points, ps.order_id, ps.stop_idx, any_value(ps.ns) AS ns, count(*) FILTER (dist < 150) AS n1, count(*) FILTER (dist < 150 AND d.rn IS NOT NULL) AS c1, count(*) FILTER (dist < 400) AS n2, count(*) FILTER (dist < 400 AND d.rn IS NOT NULL) AS c2, count(*) FILTER (dist < 800) AS n3, count(*) FILTER (dist < 800 AND d.rn IS NOT NULL) AS c3
  FROM ps CROSS JOIN cdt c LEFT JOIN rdense d ON d.radius = c.radius AND d.points = c.points AND d.order_id = ps.order_id AND d.rn = ps.rn GROUP BY 1, 2, 3, 4),
rconf AS (SELECT radius, points, t.order_id, CASE WHEN var = 3 AND stop_idx = ns - 1 AND coalesce(visits, 1) = 1 THEN 0.5 ELSE 1 END * CASE WHEN n1 > drop_min_pts THEN c1 / n1 WHEN n2 > drop_min_pts THEN c2 / n2 * 0.6 WHEN n3 > drop_min_pts THEN c3 / n3 * 0.2 ELSE 0 END::DOUBLE AS c FROM rtier t JOIN rpts r USING (radius, points, order_id) JOIN v_orders USING (order_id) LEFT JOIN home USING (order_id))"""


@register("retune_replay", on_tracks(_REPLAY + "SELECT radius, points, w.order_id, round(coalesce(avg(c), 0), 6) AS stop_confidence FROM win w CROSS JOIN cdt LEFT JOIN rconf USING (radius, points, order_id) GROUP BY 1, 2, 3"))
def retune_replay(spark, sf_dir):
    t = search.retune_candidates(fixtures.orders(spark, sf_dir), fixtures.pings(spark, sf_dir), DEFAULTS, [(30, 5), (50, 7), (80, 15)])
    return t.select("radius", "points", "order_id", r6("stop_confidence"))


_RETUNE = {"learning": {"min_pattern_support": 3, "target_precision": 0.02, "min_pattern_recall": 0.1, "pattern_strata": {"cancelled_offline": {"score_min": 0.4}}}, "thresholds": {"cancelled_offline": 0.6}, "dbscan_retune": {"min_labeled": 3, "min_recall_lift": 0.0, "grid": {"clustering_radius_m": [30, 50, 80], "min_pts": [5, 7, 15]}}}


@register("retune_decisions", on_heads(_REPLAY.replace("cdt(radius, points) AS (VALUES (30, 5), (50, 7), (80, 15))", "cdt(radius, points) AS (SELECT * FROM (VALUES (30), (50), (80)) a(r), (VALUES (5), (7), (15)) b(p))") + """,
rs AS (SELECT radius, points, order_id, avg(c) AS conf, arg_max(c, stop_idx) AS last FROM (SELECT t.radius, t.points, t.order_id, t.stop_idx, CASE WHEN var = 3 AND stop_idx = ns - 1 AND coalesce(visits, 1) = 1 THEN 0.5 ELSE 1 END * CASE WHEN n1 > drop_min_pts THEN c1 / n1 WHEN n2 > drop_min_pts THEN c2 / n2 * 0.6 WHEN n3 > drop_min_pts THEN c3 / n3 * 0.2 ELSE 0 END::DOUBLE AS c FROM rtier t JOIN rpts r USING (radius, points, order_id) JOIN v_orders USING (order_id) LEFT JOIN home USING (order_id)) GROUP BY 1, 2, 3),
rb AS (SELECT radius, points, order_id, rep.replaced, (least(1.0, greatest(0.0, coalesce(conf, 0) * CASE WHEN max_jump_m >= 2000 OR max_speed_mps >= 55 THEN 0.5 ELSE 1.0 END)) + 1.5 * sequence_score + dwell_fraction) / 3.5 AS b, NOT (coalesce(last >= 0.75, false) OR dwell_drop) OR delay <= 180 OR similarity >= 0.7 AS valid
  FROM (SELECT order_id, radius, points FROM win CROSS JOIN cdt) LEFT JOIN rs USING (radius, points, order_id) JOIN integ USING (order_id) JOIN seqr USING (order_id) JOIN dwf USING (order_id) JOIN rep USING (order_id)),
ro AS (SELECT radius, points, order_id, 'R' || (order_id % 2) AS region, greatest(0.0, least(1.0, CASE WHEN NOT replaced THEN greatest(b, 0.5 * b + 0.35) WHEN NOT coalesce(valid, false) THEN least(1.0, b + 0.15) ELSE b END)) AS s, l.label, ('0x' || substr(sha256(CAST(order_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.3 AS holdout FROM rb JOIN v_labels l USING (order_id) WHERE l.head = 'cancelled_offline' AND l.label IS NOT NULL),
rm AS (SELECT region, radius, points, holdout, count(*) AS n, count(*) FILTER (s >= 0.6 AND label = 1) AS tp, count(*) FILTER (s >= 0.6) AS pos, count(*) FILTER (label = 1) AS real FROM ro WHERE s >= 0.4 GROUP BY 1, 2, 3, 4),
rq AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE tp / pos END AS p, CASE WHEN real = 0 THEN 0 ELSE tp / real END AS r FROM rm),
rg AS (SELECT h.*, row_number() OVER (PARTITION BY h.region ORDER BY h.r DESC, h.p DESC, h.radius, h.points) AS k FROM rq h JOIN rq t ON (t.region, t.radius, t.points) = (h.region, h.radius, h.points) AND NOT t.holdout AND t.n >= 3 JOIN (SELECT region, radius, points, count(*) FILTER (s >= 0.6) AS projected FROM ro GROUP BY 1, 2, 3) f ON (f.region, f.radius, f.points) = (h.region, h.radius, h.points) JOIN (SELECT 'R' || (o_orderkey % 2) AS region, count(*) // 40 AS cap FROM orders GROUP BY 1) c ON c.region = h.region WHERE h.holdout AND h.p + 1e-12 >= 0.02 AND h.r + 1e-12 >= 0.1 AND projected <= cap),
rn AS (SELECT region, count(DISTINCT order_id) AS n FROM ro GROUP BY 1)
SELECT rn.region, rn.n, CASE WHEN rn.n < 3 THEN 'insufficient_labeled_cache' WHEN g.radius IS NULL THEN 'no_candidate_in_gates' WHEN g.r - coalesce(b.r, 0) + 1e-12 < 0 THEN 'insufficient_recall_lift' ELSE 'shadow_no_write' END AS reason, g.radius::INT AS radius, g.points::INT AS points, round(g.r - coalesce(b.r, 0), 6) AS recall_lift
FROM rn LEFT JOIN (SELECT * FROM rg WHERE k = 1) g ON g.region = rn.region LEFT JOIN (SELECT * FROM rq WHERE holdout AND radius = 50 AND points = 7) b ON b.region = rn.region"""))
def retune_decisions(spark, sf_dir):
    """From orders, pings and labels to a decision in each of two markets, capped at a fortieth of the orders."""
    k = F.col("order_id")
    own = {"region": F.concat(F.lit("r"), (k % 2).cast("string")), "city": F.lit(None).cast("string")}
    caps = fixtures.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("R"), (F.col("o_orderkey") % 2).cast("string")).alias("region")).agg(F.floor(F.count(F.lit(1)) / 40).alias("cap")).withColumns({"city": F.lit(""), "window": F.lit("day")})
    none = spark.createDataFrame([], "region string, city string, applied_at bigint")
    t = tuning.retune(fixtures.orders(spark, sf_dir).withColumns(own), fixtures.pings(spark, sf_dir), fixtures.labels(spark, sf_dir), caps, none, merged(DEFAULTS, _RETUNE), 0)
    return t.select("region", "n", "reason", "radius", "points", r6("recall_lift"))


@register("baseline_state", on_views(BASELINES.format(source="SELECT 'driver' AS kind, CAST(entity AS VARCHAR) AS entity, head, ts, order_id, score AS s FROM v_heads WHERE head = 'cancel_abuse'", wide=20, pair=8, age=90, samples=10, under=0.9, above=0.9, eps=0.1) + "\nSELECT entity, n AS samples, round(e, 6) AS ewma, round(b, 6) AS baseline, thr AS armed_thr, thr IS NOT NULL AS armed, active, CAST(len(w) AS INTEGER) AS window_size FROM (SELECT *, max(n) OVER (PARTITION BY entity) AS top FROM steps) WHERE n = top", recursive=True))
def baseline_state(spark, sf_dir):
    s = quality.by_head(fixtures.scores(spark, sf_dir), "s", "order_id", F.col("entity").cast("string").alias("entity"), "ts").where("head = 'cancel_abuse'")
    t = history.baseline_state(s.withColumn("kind", F.lit("driver")), DEFAULTS)
    return t.select("entity", "samples", r6("ewma"), r6("baseline"), "armed_thr", "armed", "active", "window_size")
