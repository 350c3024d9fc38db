"""Registered queries of readers, stores, tickets, tuning ladders and reports, each with its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..functions.policy import BOUNDS, DEFAULTS, HEADS, merged
from ..operators import control, history, models, quality, sampling, search, store, tuning
from ..sources import fixtures, readers
from ..sources.shared import fresh_dir
from ..streaming import sinks
from .queries_tracks import r6
from .twins import on_views

QUERIES, ORACLE = {}, {}
NOW = 1706745600  # 2024-02-01


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = on_views(sql)
        return f

    return keep


# -- files in and out -----------------------------------------------------------------------------------------------


def _order_cells(spark, sf_dir):
    """Orders as the cells of a CSV file: times with and without zone, blanks, events as JSON."""
    o = fixtures.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    time = lambda ts, zone: F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss") if zone else F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")
    at = geo.epoch(F.col("o_orderdate"))
    return o.select(
        k.cast("string").alias("order_display_id"), (k % 200).cast("string").alias("driver_id"), F.concat(time(at, True), F.when(k % 2 == 0, "Z").otherwise("+08:00")).alias("assign_ts"), time(at + 4800, False).alias("cancel_ts"),
        F.when(k % 5 == 0, "14.5|121.0").otherwise("14.5|121.0,14.6|121.1").alias("latlong"), F.lit("2").alias("path_point_num"), F.lit(" CANCELLED ").alias("order_status"), F.when(k % 3 == 0, "FOOD").otherwise(" ").alias("category"),
        F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("order_value"), F.lit("PHP").alias("currency"), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "0").otherwise("").alias("next_driver_no_order"),
        F.when(k % 6 == 0, '[{"driver_id": 7, "ts": "2024-01-01"}, {"driver_id": 8}]').otherwise("").alias("reassign_cancel_events"), F.when(k % 7 == 0, "1").when(k % 7 == 1, "0").otherwise("").alias("label_cancel_abuse"), F.col("o_custkey").cast("string").alias("user_id"),
    )


@register("csv_orders", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderkey % 200 AS driver_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) - CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 28800 END AS assign_ts, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 4800 AS cancel_ts, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END::INT AS stops, 'CANCELLED' AS order_status, CASE WHEN o_orderkey % 3 = 0 THEN 'FOOD' END AS category, round(o_totalprice::DOUBLE, 2) AS order_value, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS next_driver_no_order, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END::INT AS n_reassign, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INT AS label_cancel_abuse, CAST(o_custkey AS VARCHAR) AS user_id FROM orders")
def csv_orders(spark, sf_dir):
    path = fresh_dir(spark, "orders-csv")
    _order_cells(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_orders(spark, path).select("order_id", "driver_id", "assign_ts", "cancel_ts", F.size("stops").alias("stops"), "order_status", "category", F.round("order_value", 2).alias("order_value"), "next_driver_no_order", "n_reassign", "label_cancel_abuse", "user_id")


@register("csv_pings", "SELECT track_id, count(*) AS pings, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(lat), 4) AS lat, round(sum(lon), 4) AS lon, count(CASE WHEN seq % 3 > 0 THEN 1 END) AS speeds, true AS in_order FROM v_pings GROUP BY 1")
def csv_pings(spark, sf_dir):
    path = fresh_dir(spark, "pings-csv")
    p = fixtures.pings(spark, sf_dir).select(F.col("track_id").alias("driver_id"), "lat", "lon", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(F.col("seq") % 3 > 0, F.col("speed")).alias("speed_mps"), "seq")
    p.repartitionByRange(6, "driver_id").sortWithinPartitions("driver_id", "ts", "seq").drop("seq").write.option("header", True).csv(path)
    read = readers.read_pings(spark, path)
    order = F.forall(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ts"))), lambda x: x["ts"]), lambda t: t.isNotNull())
    g = read.groupBy("track_id").agg(F.count(F.lit(1)).alias("pings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("lon"), 4).alias("lon"), F.count("speed").alias("speeds"), F.countDistinct("seq").alias("d"), F.array_sort(F.collect_list(F.struct("seq", "ts"))).alias("s"), order.alias("o"))
    rising = F.transform("s", lambda x: x["ts"]) == F.array_sort(F.transform("s", lambda x: x["ts"]))
    return g.select("track_id", "pings", "first_ts", "last_ts", "lat", "lon", "speeds", (rising & (F.col("d") == F.col("pings"))).alias("in_order"))


@register("points_json", "SELECT track_id, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(speed), 6) AS speed FROM v_pings GROUP BY 1")
def points_json(spark, sf_dir):
    track = F.array_sort(F.collect_list(F.struct("ts", "seq", "lat", "lon", "speed", "heading"))).alias("track")
    packed = readers.pings_to_json(fixtures.pings(spark, sf_dir).groupBy("track_id").agg(track))
    return readers.pings_from_json(packed).groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("speed"), 6).alias("speed"))


_U = "('0x' || substr(sha256('3:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_TEMPLATES = f"sc AS (SELECT id, CASE WHEN u < 0.20 THEN 'theft_dwell' WHEN u < 0.45 THEN 'plain_offline' WHEN u < 0.60 THEN 'abuse_chain' WHEN u < 0.90 THEN 'clean_cancel' ELSE 'gps_sparse' END AS template FROM (SELECT range AS id, {_U} AS u FROM range(3000)))"


@register("scenarios", f"{_TEMPLATES} SELECT id, template, (template = 'plain_offline')::INT AS label_cancelled_offline, (template = 'abuse_chain')::INT AS label_cancel_abuse, (template = 'theft_dwell')::INT AS label_selective_theft, CASE template WHEN 'theft_dwell' THEN 40 WHEN 'plain_offline' THEN 25 WHEN 'abuse_chain' THEN 20 WHEN 'clean_cancel' THEN 12 ELSE 2 END::INT AS n_pings FROM sc")
def scenarios(spark, sf_dir):
    return readers.scenarios(spark, 3000, 3).select("id", "template", *(f"label_{h}" for h in HEADS), "n_pings")


@register("shard_manifest", f"{_TEMPLATES} SELECT CAST(id // 700 AS INT) AS shard, count(*) AS n FROM sc GROUP BY 1")
def shard_manifest(spark, sf_dir):
    path = fresh_dir(spark, "shards")
    s = readers.scenarios(spark, 3000, 3)
    readers.write_shards(s.where("id < 1400"), path, 700)
    return readers.write_shards(s.where("id >= 700"), path, 700)  # the second shard replaces itself


@register("jsonl_sink", "SELECT order_id, round(cancel_abuse, 6) AS cancel_abuse FROM v_scores")
def jsonl_sink(spark, sf_dir):
    path = fresh_dir(spark, "jsonl")
    s = fixtures.scores(spark, sf_dir).select("order_id", "cancel_abuse")
    write = sinks.fanout(sinks.jsonl(path), sinks.ledger(path + "-ledger"))
    write(s.where("order_id % 2 = 0"), 0)
    write(s.where("order_id % 2 = 1"), 1)
    write(s.where("order_id % 2 = 1"), 1)  # tried again
    return spark.read.schema("order_id bigint, cancel_abuse double").json(path).select("order_id", r6("cancel_abuse"))


@register("published_assessments", "SELECT order_id, policy_hash, generation, generation < max(generation) OVER (PARTITION BY order_id) AS provisional FROM v_generations")
def published_assessments(spark, sf_dir):
    root = fresh_dir(spark, "published")
    g = fixtures.generations(spark, sf_dir)
    write = sinks.publish(root, sinks.jsonl(root + "-stream"))
    for n in (1, 2, 2, 3, 1):  # two of the batches are tried again
        write(g.where(F.col("generation") == n), n)
    return sinks.read_keyed(spark, f"{root}/assessments", store.KEY).select("order_id", "policy_hash", "generation", "provisional")


@register("published_tickets", "r AS (SELECT order_id, ts + 60 AS made, CASE WHEN cancelled_offline >= 0.85 OR cancel_abuse >= 0.70 OR selective_theft >= 0.70 THEN 'pattern_mass' WHEN abs(cancelled_offline - 0.75) <= 0.1 OR abs(cancel_abuse - 0.75) <= 0.1 OR abs(selective_theft - 0.75) <= 0.1 THEN 'uncertainty' END AS why FROM v_scores), d AS (SELECT *, CAST(make_timestamp(made * 1000000)::DATE AS VARCHAR) AS day FROM r WHERE why IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY order_id % 2, made, order_id) AS k FROM d) SELECT order_id, day, why AS sampling_reason, CASE why WHEN 'pattern_mass' THEN 90 ELSE 80 END::INT AS priority FROM k WHERE k <= 30")
def published_tickets(spark, sf_dir):
    """Tickets as publishing makes them from first assessments, those of even orders first; the second batch is tried twice. Read from the stream of tickets."""
    root = fresh_dir(spark, "published")
    g = fixtures.generations(spark, sf_dir).where("generation = 1 and policy_hash = 'p1'")
    write = sinks.publish(root, sinks.jsonl(root + "-stream"), sinks.jsonl(root + "-tickets"), DEFAULTS, NOW)
    for n in (0, 1, 1):
        write(g.where(F.col("order_id") % 2 == n), n)
    return spark.read.schema("order_id bigint, day string, sampling_reason string, priority int").json(root + "-tickets").select("order_id", "day", "sampling_reason", "priority")


@register("gps_cache", "c AS (SELECT order_id, 1 AS generation, 'M' || (order_id % 3) AS market, 1706745600 - (order_id % 40) * 86400 AS ts FROM v_scores), n AS (SELECT order_id, 1 + (order_id % 2)::INT AS generation, 'M' || (order_id % 3) AS market, 1706745600 AS ts, order_id % 5 AS points FROM v_scores WHERE order_id % 2 = 0 OR order_id % 3 = 0), t AS (SELECT order_id, generation, market, ts FROM c WHERE ts >= 1706745600 - 30 * 86400 AND (order_id, generation) NOT IN (SELECT (order_id, generation) FROM n WHERE points > 0) UNION ALL SELECT order_id, generation, market, ts FROM n WHERE points > 0) SELECT order_id, generation::INT AS generation, ts FROM (SELECT *, max(generation) OVER (PARTITION BY order_id) AS g FROM t WHERE market = 'M1') WHERE generation = g")
def gps_cache(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    k = F.col("order_id")
    row = lambda g, ts, n: (k, g.cast("int").alias("generation"), F.concat(F.lit("M"), (k % 3).cast("string")).alias("market"), ts.cast("bigint").alias("ts"), F.array_repeat(F.lit(1.0), n.cast("int")).alias("points"))
    old = s.select(*row(F.lit(1), F.lit(NOW) - (k % 40) * 86400, F.lit(3)))
    new = s.where("order_id % 2 = 0 or order_id % 3 = 0").select(*row(1 + k % 2, F.lit(NOW), k % 5))
    return store.latest_in_market(store.cached(old, new, NOW, 30), "M1").select("order_id", "generation", "ts")


@register("assessment_generations", "SELECT order_id, policy_hash, generation, CAST(row_number() OVER (PARTITION BY order_id ORDER BY generation, assessed_at, policy_hash, model_version) AS INT) AS place FROM v_generations WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def assessment_generations(spark, sf_dir):
    g = fixtures.generations(spark, sf_dir)
    return store.generations(g, fixtures.orders(spark, sf_dir)).select("order_id", "policy_hash", "generation", "place")


# -- scalars ----------------------------------------------------------------------------------------------------------


@register("lineage_summary", "SELECT order_id, 2 AS events, CAST(assign_ts AS VARCHAR) || ',' || CAST(cancel_ts AS VARCHAR) AS times, 'assign,' || CASE WHEN order_id % 2 = 0 THEN 'cancel' ELSE '' END AS types, sha256(order_id || '|' || CASE WHEN order_id % 7 = 0 THEN '' ELSE assign_ts || '|' || cancel_ts END) AS lineage_id FROM v_orders")
def lineage_summary(spark, sf_dir):
    o = fixtures.orders(spark, sf_dir)
    event = lambda ts, a, b: F.struct(ts.cast("string").alias("ts"), F.lit(None).cast("string").alias("timestamp"), a.cast("string").alias("type"), b.cast("string").alias("event_type"))
    events = F.array(event(F.col("cancel_ts"), F.lit(None), F.when(F.col("order_id") % 2 == 0, "cancel")), event(F.col("assign_ts"), F.lit("assign"), F.lit("x")))
    o = o.withColumn("events", events)
    s = geo.lineage_summary(F.col("events"))
    chain = F.when(F.col("order_id") % 7 == 0, F.slice("events", 1, 0)).otherwise(F.col("events"))
    types = F.array_sort(F.transform(s["types"], lambda t: F.coalesce(t, F.lit("~"))))
    return o.select("order_id", s["count"].alias("events"), F.array_join(s["times"], ",").alias("times"), F.array_join(F.transform(types, lambda t: F.when(t == "~", "").otherwise(t)), ",").alias("types"), geo.lineage_id(F.col("order_id"), chain).alias("lineage_id"))


@register("cohort_keys", "SELECT order_id, CASE WHEN order_id % 3 = 0 THEN 'city:C' || (order_id % 5) WHEN order_id % 3 = 1 THEN 'region:r' || region ELSE 'cohort:global' END AS cohort FROM v_scores")
def cohort_keys(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    k = F.col("order_id")
    city = F.when(k % 3 == 0, F.concat(F.lit(" C"), (k % 5).cast("string"))).otherwise("  ")
    region = F.when(k % 3 == 1, F.concat(F.lit("r"), F.col("region").cast("string")))
    return s.select("order_id", geo.cohort(city, region).alias("cohort"))


@register("open_orders", "SELECT o_orderkey AS order_id, o_orderkey % 3 = 2 AS active FROM orders")
def open_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, " cancelled").when(k % 3 == 1, "Done ").otherwise(F.when(k % 2 == 0, "PICKED").otherwise(F.lit(None)))
    return fixtures.table(spark, sf_dir, "orders").select(k.alias("order_id"), scoring.still_active(status).alias("active"))


@register("pattern_heads", "SELECT order_id, array_to_string(list_filter([CASE WHEN cancelled_offline >= 0.9 THEN 'cancelled_offline' END, CASE WHEN cancel_abuse >= 0.70 OR order_id % 4 = 0 THEN 'cancel_abuse' END, CASE WHEN selective_theft >= 0.70 THEN 'selective_theft' END], lambda x: x IS NOT NULL), ',') AS heads FROM v_scores")
def pattern_heads(spark, sf_dir):
    p = sampling.with_strata(DEFAULTS, {"cancelled_offline": {"score_min": 0.9}, "cancel_abuse": {"score_min": 0.7, "reason_any": ["multi_cancel_pattern"]}, "unknown": {"score_min": 0.0}})
    s = fixtures.scores(spark, sf_dir).withColumn("reasons", F.when(F.col("order_id") % 4 == 0, F.array(F.lit("x"), F.lit("multi_cancel_pattern"))).otherwise(F.array(F.lit("y"))))
    return s.select("order_id", F.array_join(sampling.pattern_heads(p, {h: F.col(h) for h in HEADS}, F.col("reasons")), ",").alias("heads"))


@register("inferred_heads", "SELECT order_id, CASE WHEN greatest(a, b, c) = a THEN 'cancelled_offline' WHEN greatest(a, b, c) = b THEN 'cancel_abuse' ELSE 'selective_theft' END AS head FROM (SELECT order_id, CASE WHEN o + p + q > 0 AND o = 0 THEN -1 ELSE cancelled_offline END AS a, CASE WHEN o + p + q > 0 AND p = 0 THEN -1 ELSE cancel_abuse END AS b, CASE WHEN o + p + q > 0 AND q = 0 THEN -1 ELSE selective_theft END AS c FROM (SELECT *, (cancelled_offline >= 0.75)::INT AS o, (cancel_abuse >= 0.75 AND order_id % 2 = 0)::INT AS p, (selective_theft >= 0.95)::INT AS q FROM v_scores))")
def inferred_heads(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    flags = {"cancelled_offline": (F.col("cancelled_offline") >= 0.75).cast("int"), "cancel_abuse": ((F.col("cancel_abuse") >= 0.75) & (F.col("order_id") % 2 == 0)).cast("int"), "selective_theft": (F.col("selective_theft") >= 0.95).cast("int")}
    return s.select("order_id", control.infer_head({h: F.col(h) for h in HEADS}, flags).alias("head"))


@register("device_chat_norm", "SELECT event_id, round(greatest(CASE WHEN event_id % 9 = 0 THEN NULL ELSE least(1.0, event_id % 13 / 10.0) END, CASE WHEN event_id % 11 = 0 THEN 0.80 ELSE 0 END, CASE WHEN event_id % 7 = 0 THEN 0.55 ELSE 0 END)::DOUBLE, 6) AS device_risk, round(greatest(CASE WHEN event_id % 5 = 0 THEN 0.85 ELSE 0 END, CASE WHEN event_id % 6 = 0 THEN 0.90 ELSE 0 END, CASE WHEN event_id % 8 = 0 THEN 0.30 END)::DOUBLE, 6) AS chat_risk FROM events")
def device_chat_norm(spark, sf_dir):
    k = F.col("event_id")
    e = fixtures.events(spark, sf_dir)
    raw = F.struct(F.when(k % 9 != 0, ((k % 13) / 10.0).cast("string")).otherwise("").alias("risk_score"), F.when(k % 11 == 0, "Yes").alias("tampered_app"), F.when(k % 7 == 0, "1").otherwise("no").alias("jailbroken"))
    chat = F.struct(F.when(k % 5 == 0, "true").alias("pay_cash_suggested"), F.when(k % 6 == 0, "y").alias("force_cancel"), F.when(k % 8 == 0, "0.3").alias("signal_score"))
    e = e.select("event_id", F.to_json(raw).alias("d"), F.to_json(chat).alias("c"))
    return e.select("event_id", F.round(scoring.device_risk_of(scoring.normal_device(F.col("d"))), 6).alias("device_risk"), F.round(scoring.chat_risk_of(scoring.normal_chat(F.col("c"))), 6).alias("chat_risk"))


@register("recoverability_live", "l AS (SELECT region, head, round(list_reduce(list_prepend(CASE head WHEN 'cancelled_offline' THEN 1.0 WHEN 'cancel_abuse' THEN 0.4 ELSE 0.8 END::DOUBLE, list(CASE outcome WHEN 'clawback_won' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ts, order_id)), lambda a, x: 0.05 * x + 0.95 * a), 9) AS value, count(*) AS n FROM v_outcomes GROUP BY 1, 2), s AS (SELECT *, CASE head WHEN 'cancelled_offline' THEN 1.0 WHEN 'cancel_abuse' THEN 0.4 ELSE 0.8 END::DOUBLE AS static FROM l) SELECT region, head, static, round(value, 6) AS learned, round(value - static, 6) AS delta, n AS n_updates, n >= 150 AS apply_ready, bool_and(n >= 150) OVER (PARTITION BY region) AS market_ready, round(CASE WHEN n >= 150 THEN value ELSE static END, 6) AS would_use FROM s")
def recoverability_live(spark, sf_dir):
    p = merged(DEFAULTS, {"ear": {"mode": "apply", "min_updates_apply": 150}})
    t = control.ear_delta(history.recoverability(fixtures.outcomes(spark, sf_dir), p), p)
    use = F.coalesce(*(F.when(F.col("head") == h, scoring.recoverability(F.col("learned"), F.col("n_updates"), h, p)) for h in HEADS))
    return t.select("region", "head", "static", r6("learned"), r6("delta"), "n_updates", "apply_ready", "market_ready", F.round(use, 6).alias("would_use"))


@register("recoverability_joined", "l AS (SELECT region, head, list_reduce(list_prepend(CASE head WHEN 'cancelled_offline' THEN 1.0 WHEN 'cancel_abuse' THEN 0.4 ELSE 0.8 END::DOUBLE, list(CASE outcome WHEN 'clawback_won' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ts, order_id)), lambda a, x: 0.05 * x + 0.95 * a) AS value FROM v_outcomes GROUP BY 1, 2) SELECT s.order_id, round(coalesce(max(l.value) FILTER (l.head = 'cancelled_offline'), 1.0), 6) AS cancelled_offline, round(coalesce(max(l.value) FILTER (l.head = 'cancel_abuse'), 0.4), 6) AS cancel_abuse, round(coalesce(max(l.value) FILTER (l.head = 'selective_theft'), 0.8), 6) AS selective_theft FROM v_scores s LEFT JOIN l ON l.region = s.region AND s.order_id % 4 > 0 GROUP BY 1")
def recoverability_joined(spark, sf_dir):
    p = merged(DEFAULTS, {"ear": {"mode": "apply", "min_updates_apply": 1}})
    rows = fixtures.scores(spark, sf_dir).select("order_id", F.when(F.col("order_id") % 4 > 0, F.col("region")).alias("region"))
    out = scoring.with_recoverability(rows, history.recoverability(fixtures.outcomes(spark, sf_dir), p), p, ("region",))
    return out.select("order_id", *(F.round(f"recover_{h}", 6).alias(h) for h in HEADS))


_CAL = "CASE WHEN order_id % 5 = 4 THEN NULL WHEN order_id % 5 < 2 THEN 1 / (1 + exp(-(4.0 * cancel_abuse - 2.0))) ELSE CASE WHEN cancel_abuse <= 0.2 THEN 0.1 WHEN cancel_abuse >= 0.8 THEN 0.9 WHEN cancel_abuse < 0.5 THEN 0.1 + 0.2 * (cancel_abuse - 0.2) / 0.3 ELSE 0.3 + 0.6 * (cancel_abuse - 0.5) / 0.3 END END"


@register("calibrated_scores", f"SELECT order_id, round(coalesce({_CAL}, cancel_abuse)::DOUBLE, 6) AS score, CASE WHEN order_id % 5 = 4 THEN 'missing' END AS skip_reason FROM v_scores")
def calibrated_scores(spark, sf_dir):
    table = spark.createDataFrame([(f"R{r}", "cancel_abuse", "platt", 4.0, -2.0, [0.0], [0.0]) for r in (0, 1)] + [(f"R{r}", "cancel_abuse", "isotonic", None, None, [0.2, 0.5, 0.8], [0.1, 0.3, 0.9]) for r in (2, 3)], "region string, head string, method string, a double, b double, xs array<double>, ys array<double>")
    s = fixtures.scores(spark, sf_dir).select("order_id", F.concat(F.lit("r"), (F.col("order_id") % 5).cast("string")).alias("region"), F.lit("cancel_abuse").alias("head"), F.col("cancel_abuse").alias("score"))
    return scoring.with_calibrators(s, table).select("order_id", F.round("calibrated", 6).alias("score"), "skip_reason")


# -- tickets -----------------------------------------------------------------------------------------------------------

_T = """tk AS (SELECT order_id, day, heads, why, priority, CASE WHEN order_id % 6 = 0 THEN 'labeled' ELSE 'open' END AS status FROM (
  SELECT order_id, CAST(make_timestamp(ts * 1000000)::DATE AS VARCHAR) AS day, CASE WHEN order_id % 4 = 0 THEN ['cancel_abuse', 'selective_theft'] ELSE ['cancel_abuse'] END AS heads, CASE WHEN order_id % 3 = 0 THEN 'pattern_mass' ELSE 'uncertainty' END AS why, CASE WHEN order_id % 3 = 0 THEN 90 ELSE 80 END AS priority
  FROM v_scores WHERE cancel_abuse >= 0.7 AND order_id % 9 > 0 AND order_id % 10 > 0))"""


def _tickets(spark, sf_dir):
    """Tickets for scores in the pattern; a tenth of the orders have one already, a ninth no heads, one in six is labelled since."""
    s = fixtures.scores(spark, sf_dir).where("cancel_abuse >= 0.7")
    k = F.col("order_id")
    heads = F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 4 == 0, F.array(F.lit("cancel_abuse"), F.lit("selective_theft"))).otherwise(F.array(F.lit("cancel_abuse")))
    rows = s.select("order_id", F.lit(" r1").alias("region"), F.lit(None).cast("string").alias("city"), heads.alias("heads"), F.when(k % 3 == 0, "pattern_mass").otherwise("uncertainty").alias("sampling_reason"), F.when(k % 3 == 0, 90).otherwise(80).alias("priority"), geo.day_key(F.col("ts")).alias("day"))
    again = rows.unionByName(rows.where("order_id % 5 = 0").withColumns({"priority": F.lit(10), "sampling_reason": F.lit("quota_fill")}))
    have = rows.where("order_id % 10 = 0").select("order_id", "day")
    return control.mark_labelled(control.new_tickets(again, have, NOW), s.where("order_id % 6 = 0"), NOW + 60)


@register("tickets_created", f"{_T} SELECT order_id, 'R1' AS region, '' AS city, day, array_to_string(heads, ',') AS heads, why AS sampling_reason, priority, status, CASE WHEN status = 'labeled' THEN 1706745660 END::BIGINT AS labeled_at FROM tk")
def tickets_created(spark, sf_dir):
    return _tickets(spark, sf_dir).select("order_id", "region", "city", "day", F.array_join("heads", ",").alias("heads"), "sampling_reason", "priority", "status", "labeled_at")


@register("tickets_listed", f"{_T} SELECT order_id, priority FROM tk WHERE status = 'open' AND priority = 90 ORDER BY sha256(order_id || '|' || day) LIMIT 20")
def tickets_listed(spark, sf_dir):
    t = _tickets(spark, sf_dir).where("priority = 90")
    return control.list_tickets(t, "open", limit=20).select("order_id", "priority")


@register("ticket_day_counts", f"{_T} SELECT day, count(*) AS n FROM tk GROUP BY 1")
def ticket_day_counts(spark, sf_dir):
    return control.day_counts(_tickets(spark, sf_dir))


@register("ticket_head_counts", f"{_T} SELECT day, unnest(heads) AS head, count(*) AS n FROM tk GROUP BY 1, 2")
def ticket_head_counts(spark, sf_dir):
    return control.head_counts(_tickets(spark, sf_dir))


@register("bias_hints", "m AS (SELECT head, region, count(*) FILTER (score >= 0.75 AND label = 1) AS tp, count(*) FILTER (score >= 0.75 AND label = 0) AS fp, count(*) FILTER (score < 0.75 AND label = 1) AS fn FROM v_pairs GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY region DESC) AS k FROM m) SELECT head, CASE WHEN tp / greatest(1, tp + fp) < 0.7 AND fp > 0 THEN 'bias_fp' ELSE 'bias_fn' END AS hint FROM n WHERE k = 1 AND tp + fn >= 5 AND ((tp / greatest(1, tp + fp) < 0.7 AND fp > 0) OR (tp / greatest(1, tp + fn) < 0.5 AND fn > 0))")
def bias_hints(spark, sf_dir):
    p = quality.labelled(fixtures.scores(spark, sf_dir), fixtures.labels(spark, sf_dir))
    m = quality.confusion(p, F.col("score") >= 0.75, "head", "region").withColumn("computed_at", F.col("region"))
    return sampling.bias_hints(m)


@register("inline_reason_full", "SELECT order_id, CASE WHEN cancelled_offline >= 0.75 AND cancel_abuse < 0.75 OR cancelled_offline < 0.75 AND cancel_abuse >= 0.75 THEN 'disagreement' WHEN cancelled_offline >= 0.85 OR selective_theft >= 0.70 OR cancel_abuse >= 0.70 THEN 'pattern_mass' WHEN abs(cancelled_offline - 0.75) <= 0.1 OR abs(selective_theft - 0.75) <= 0.1 OR abs(cancel_abuse - 0.75) <= 0.1 THEN 'uncertainty' WHEN cancelled_offline < 0.75 THEN 'bias_fn' END AS ticket_reason FROM v_scores")
def inline_reason_full(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir).withColumns({**{f"rule_{h}": F.col("cancelled_offline") for h in HEADS}, **{f"ml_{h}": F.col("cancel_abuse") if h == "cancelled_offline" else F.lit(None).cast("double") for h in HEADS}})
    return sampling.inline_reason(s, DEFAULTS, "rule_", "ml_", {"cancelled_offline": "bias_fn"}).select("order_id", "ticket_reason")


# -- stores ------------------------------------------------------------------------------------------------------------


@register("forecast_store", "SELECT 'R' || region AS region, CASE WHEN d % 2 = 0 THEN 'X' ELSE '' END AS city, start_ts, CASE WHEN d < 10 THEN supply + 1 ELSE supply END AS supply FROM v_forecast")
def forecast_store(spark, sf_dir):
    f = fixtures.forecast(spark, sf_dir).select(F.concat(F.lit("r"), F.col("region").cast("string")).alias("region"), F.when(F.col("d") % 2 == 0, " x").alias("city"), "start_ts", "end_ts", "supply", "demand", "d")
    table = control.upsert_forecast(control.normal(f.limit(0)), f)
    return control.upsert_forecast(table, f.where("d < 10").withColumn("supply", F.col("supply") + 1)).select("region", "city", "start_ts", "supply")


@register("hardgate_store", "SELECT 'R' || r_regionkey AS region, '' AS city, w AS \"window\", CAST(CASE WHEN w = 'day' THEN 100 ELSE 10 END AS INT) AS cap FROM region, (VALUES ('hour'), ('day')) t(w)")
def hardgate_store(spark, sf_dir):
    r = fixtures.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("region"), F.lit(None).cast("string").alias("city"))
    gate = lambda w, n: r.select("region", "city", F.lit(w).alias("window"), F.lit(n).alias("cap"))
    table = control.upsert_hardgate(control.normal(gate("hour", 1).limit(0)), gate("hour", 10).unionByName(gate("day", 5)))
    return control.upsert_hardgate(table, gate("day", 100))


@register("clawback_store", "SELECT 'R' || r_regionkey AS region, '' AS city, CASE WHEN r_regionkey % 2 = 0 THEN 1706745600 + 7200 ELSE 1706745600 + 3600 END::BIGINT AS until_ts FROM region")
def clawback_store(spark, sf_dir):
    r = fixtures.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("region"), F.lit("").alias("city"), F.lit("x").alias("reason"), F.col("r_regionkey").alias("k"))
    first = control.record_clawback(spark.createDataFrame([], "region string, city string, until_ts bigint, reason string"), r.withColumn("ttl_minutes", F.lit(60)), NOW)
    return control.record_clawback(first, r.where("k % 2 = 0").withColumn("ttl_minutes", F.lit(120)), NOW).select("region", "city", "until_ts")


@register("overlay_store", "SELECT 'R' || r_regionkey AS region, path, CASE WHEN r_regionkey = 1 THEN 0.9 ELSE value END::DOUBLE AS value FROM region, (VALUES ('thresholds.cancel_abuse', 0.8), ('dbscan.min_pts', 9.0)) t(path, value) WHERE r_regionkey <> 4 AND (r_regionkey <> 1 OR path = 'thresholds.cancel_abuse')")
def overlay_store(spark, sf_dir):
    r = fixtures.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("region"), F.lit("").alias("city"))
    rows = r.select("region", "city", F.inline(F.array(F.struct(F.lit("thresholds.cancel_abuse").alias("path"), F.lit(0.8).alias("value")), F.struct(F.lit("dbscan.min_pts").alias("path"), F.lit(9.0).alias("value")))))
    table = control.save_overlay(rows.limit(0), rows)
    table = control.save_overlay(table, rows.where("region = 'r1' and path like 'thr%'").withColumn("value", F.lit(0.9)))
    return control.drop_overlay(table, "R4").select("region", "path", "value")


@register("audit_last_apply", "a AS (SELECT 'R' || (event_id % 3) AS region, CASE event_id % 2 WHEN 0 THEN 'cancel_abuse' ELSE 'selective_theft' END AS head, ts AS t, event_id % 5 AS k FROM v_events WHERE event_id % 7 < 3) SELECT region, 'thresholds.' || head AS path, max(t) AS applied_at FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t DESC, head) AS n FROM a WHERE k > 1) WHERE n <= 20 GROUP BY 1, 2")
def audit_last_apply(spark, sf_dir):
    e = fixtures.events(spark, sf_dir).where("event_id % 7 < 3")
    k = F.col("event_id")
    d = e.select(F.concat(F.lit("r"), (k % 3).cast("string")).alias("region"), F.lit("").alias("city"), F.when(k % 2 == 0, "cancel_abuse").otherwise("selective_theft").alias("head"), F.when(k % 5 > 1, "apply").otherwise("suggest").alias("action"), F.lit("x").alias("decision"), F.lit("y").alias("reason"), F.col("ts").alias("t"))
    audit = control.audit_rows(d, "tuner", 0).drop("at")
    at = d.select("t", *(geo.market(F.col(c)).alias(c) for c in ("region", "city")), F.concat(F.lit("thresholds."), F.col("head")).alias("path"), "action")
    return control.last_applied(at.withColumnRenamed("t", "at").select("at", "action", "region", "city", "path").unionByName(audit.limit(0).withColumn("at", F.lit(0).cast("bigint")).select("at", "action", "region", "city", "path"))).select("region", "path", "applied_at")


@register("newest_outcomes", "SELECT order_id, outcome FROM v_outcomes ORDER BY ts DESC, order_id LIMIT 25")
def newest_outcomes(spark, sf_dir):
    return control.newest(fixtures.outcomes(spark, sf_dir), "ts", 25, "order_id").select("order_id", "outcome")


@register("label_cache_join", "SELECT s.order_id, 1 + (s.order_id % 2)::INT AS generation, l.label FROM v_scores s JOIN v_labels l ON l.order_id = s.order_id AND l.head = 'cancelled_offline' WHERE s.order_id % 4 > 0")
def label_cache_join(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir).where("order_id % 4 > 0").withColumns({"generation": (1 + F.col("order_id") % 2).cast("int"), "market": F.lit("M")})
    both = s.unionByName(s.where("order_id % 2 = 1").withColumn("generation", F.lit(1)))
    cache = store.latest_in_market(both, "M")
    return cache.select("order_id", "generation").join(quality.by_head(fixtures.labels(spark, sf_dir), "label", "order_id").where("head = 'cancelled_offline' and label is not null"), "order_id").select("order_id", "generation", "label")


# -- tuning ------------------------------------------------------------------------------------------------------------

_LEARN = {"learning": {"min_pattern_support": 3, "target_precision": 0.02, "min_pattern_recall": 0.2, "blend_search_min_support": 6}}
_AT = 1704067200 + 10 * 86400 + 3600
_TUNE = """ts AS (SELECT *, 'R' || (order_id % 2) AS own, CASE order_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'B' END AS town FROM v_scores),
mk AS (SELECT DISTINCT own AS region, town AS city FROM ts),
bl AS (SELECT 0 AS blend, 1.0::DOUBLE AS rw, 0.0::DOUBLE AS mw UNION ALL SELECT * FROM (VALUES (1, 0.4::DOUBLE, 0.6::DOUBLE), (2, 0.6, 0.4), (3, 0.8, 0.2))),
pt AS (SELECT order_id, own, town, 'cancelled_offline' AS head, blend, CASE WHEN blend = 0 THEN cancelled_offline WHEN order_id % 4 = 0 THEN cancelled_offline ELSE (rw * cancelled_offline + mw * cancel_abuse) / (rw + mw) END AS score, cancelled_offline >= 0.85 AS pattern FROM ts, bl
  UNION ALL SELECT order_id, own, town, 'cancel_abuse', 0, cancel_abuse, cancel_abuse >= 0.70 FROM ts UNION ALL SELECT order_id, own, town, 'selective_theft', 0, selective_theft, selective_theft >= 0.70 FROM ts),
pm AS (SELECT region, city, order_id, head, blend, score, pattern FROM pt JOIN mk ON mk.region = pt.own AND (mk.city = pt.town OR mk.city = '')),
pp AS (SELECT pm.*, l.label, ('0x' || substr(sha256(CAST(pm.order_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.3 AS holdout FROM pm JOIN v_labels l USING (order_id, head) WHERE pattern),
gr AS (SELECT i, round(0.5 + 0.05 * i, 4) AS thr FROM range(10) t(i)),
ov AS (SELECT 'R' || (r_regionkey % 2) AS region, ['', 'A', 'B', '', 'A'][r_regionkey + 1] AS city, CASE r_regionkey % 2 WHEN 0 THEN 'cancelled_offline' ELSE 'cancel_abuse' END AS head, round(0.6 + 0.05 * r_regionkey, 2) AS value FROM region),
hd AS (SELECT * FROM (VALUES ('cancelled_offline'), ('cancel_abuse'), ('selective_theft')) h(head)),
th AS (SELECT mk.region, mk.city, hd.head, coalesce(o.value, w.value, 0.75)::DOUBLE AS now_at FROM mk CROSS JOIN hd LEFT JOIN ov o ON o.region = mk.region AND o.city = mk.city AND o.head = hd.head LEFT JOIN ov w ON w.region = mk.region AND w.city = '' AND w.head = hd.head),
cu AS (SELECT region, city, head, count(*) FILTER (NOT holdout) AS support, coalesce(count(*) FILTER (holdout AND label = 1 AND score >= now_at) / nullif(count(*) FILTER (holdout AND label = 1), 0), 0) AS now FROM pp JOIN th USING (region, city, head) WHERE blend = 0 GROUP BY 1, 2, 3),
cd AS (SELECT region, city, head, blend, holdout, i, any_value(thr) AS thr, count(*) FILTER (score >= thr AND label = 1) AS tp, count(*) FILTER (score >= thr AND label = 0) AS fp, count(*) FILTER (score < thr AND label = 1) AS fn FROM pp, gr GROUP BY 1, 2, 3, 4, 5, 6),
cq AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM cd JOIN cu USING (region, city, head) WHERE blend = 0 OR support >= 6),
ok AS (SELECT * FROM cq WHERE p + 1e-12 >= 0.02 AND r + 1e-12 >= 0.2),
pj AS (SELECT region, city, head, blend, i, count(*) FILTER (score >= thr) AS projected FROM pm, gr GROUP BY 1, 2, 3, 4, 5),
cp AS (SELECT own AS region, town AS city, CASE WHEN own = 'R1' AND town = 'B' THEN count(*) // 4 // 2 ELSE count(*) // 4 END AS cap FROM ts WHERE town <> '' GROUP BY 1, 2),
be AS (SELECT * FROM (SELECT h.region, h.city, h.head, h.thr, h.blend, h.r, row_number() OVER (PARTITION BY h.region, h.city, h.head ORDER BY h.r DESC, h.p DESC, h.blend, h.i) AS k FROM ok h JOIN ok t ON (t.region, t.city, t.head, t.blend, t.i) = (h.region, h.city, h.head, h.blend, h.i) AND NOT t.holdout AND h.holdout JOIN pj ON (pj.region, pj.city, pj.head, pj.blend, pj.i) = (h.region, h.city, h.head, h.blend, h.i) LEFT JOIN cp ON cp.region = h.region AND cp.city = h.city WHERE cp.cap IS NULL OR projected <= cp.cap) WHERE k = 1),
fc AS (SELECT 'R' || region AS region, supply / demand AS ratio FROM v_forecast WHERE start_ts <= 1704934800 AND 1704934800 < end_ts),
ru AS (SELECT m.region, m.city, m.head, coalesce(support, 0) AS support, thr, be.blend, now_at, coalesce(now, 0) AS now, be.r - coalesce(now, 0) AS lift,
    CASE WHEN coalesce(support, 0) < 3 THEN 'insufficient_pattern_labels' WHEN be.thr IS NULL THEN 'no_candidate_in_gates' WHEN be.r - coalesce(now, 0) < 0.01 THEN 'holdout_pattern_recall_lift_below_min' WHEN m.region = 'R0' AND m.city = 'A' AND m.head = 'cancel_abuse' THEN 'cooldown' ELSE 'holdout_pattern_recall_lift' END AS reason,
    CASE WHEN m.region = 'R1' AND m.city = 'B' THEN 'clawback_peak' WHEN ratio IS NULL THEN 'fallback' WHEN greatest(0.5, ratio) <= 0.8 THEN 'peak' WHEN ratio >= 1.2 THEN 'surplus' ELSE 'mid' END AS regime,
    CASE WHEN m.region = 'R1' AND m.city = 'B' THEN 0.8 ELSE least(2.0, greatest(0.5, ratio)) END::DOUBLE AS supply_ratio
  FROM th m LEFT JOIN cu USING (region, city, head) LEFT JOIN be USING (region, city, head) LEFT JOIN fc ON fc.region = m.region),
du AS (SELECT *, reason NOT IN ('insufficient_pattern_labels', 'no_candidate_in_gates') AS found FROM ru)"""


@register("tuner_decisions", f"{_TUNE} SELECT region, city, head, support, CASE reason WHEN 'holdout_pattern_recall_lift' THEN 'apply' WHEN 'cooldown' THEN 'suggest' WHEN 'holdout_pattern_recall_lift_below_min' THEN 'suggest' ELSE 'reject' END AS action, reason, CASE WHEN found THEN thr END::DOUBLE AS threshold, CASE WHEN found AND blend > 0 THEN [0.4, 0.6, 0.8][blend] END::DOUBLE AS rule_weight, CASE WHEN found AND support >= 6 THEN 50.0 END::DOUBLE AS p1_attention_min, round(CASE WHEN found THEN lift END, 6) AS recall_lift, now_at AS threshold_now, round(now, 6) AS recall_now, regime, round(supply_ratio, 6) AS supply_ratio FROM du")
def tuner_decisions(spark, sf_dir):
    return _tuned(spark, sf_dir).select("region", "city", "head", "support", "action", "reason", "threshold", "rule_weight", "p1_attention_min", r6("recall_lift"), "threshold_now", r6("recall_now"), "regime", r6("supply_ratio"))


def _tuned(spark, sf_dir):
    """Scores in six markets, two of them whole regions; caps from their counts, overlays from the region table, a clawback and a fresh apply."""
    k = F.col("order_id")
    s = fixtures.scores(spark, sf_dir).withColumns({"region": F.concat(F.lit("r"), (k % 2).cast("string")), "city": F.when(k % 3 == 1, " a").when(k % 3 == 2, "b")})
    s = s.withColumns({"rule_cancelled_offline": F.col("cancelled_offline"), "ml_cancelled_offline": F.when(k % 4 != 0, F.col("cancel_abuse"))})
    caps = s.where("city is not null").groupBy("region", "city").agg(F.floor(F.count(F.lit(1)) / 4).alias("cap")).withColumn("window", F.lit("day"))
    r = fixtures.table(spark, sf_dir, "region").withColumn("k", F.col("r_regionkey").cast("int"))
    one = F.concat(F.lit("R"), (F.col("k") % 2).cast("string")).alias("region")
    overlays = r.select(one, F.element_at(F.array(*map(F.lit, ("", "A", "B", "", "A"))), F.col("k") + 1).alias("city"), F.when(F.col("k") % 2 == 0, "thresholds.cancelled_offline").otherwise("thresholds.cancel_abuse").alias("path"), F.round(0.6 + 0.05 * F.col("k"), 2).alias("value"))
    clawbacks = r.where("k = 1").select(one, F.lit("b").alias("city"), F.lit(NOW + 60).alias("until_ts"))
    applied = r.where("k = 2").select(one, F.lit("A").alias("city"), F.lit("thresholds.cancel_abuse").alias("path"), F.lit(NOW - 600).alias("applied_at"))
    f = fixtures.forecast(spark, sf_dir).select(F.concat(F.lit("r"), F.col("region").cast("string")).alias("region"), F.lit("").alias("city"), "start_ts", "end_ts", "supply", "demand", F.lit(0).alias("ingested_at"))
    return tuning.tune(s, fixtures.labels(spark, sf_dir), caps, applied, merged(DEFAULTS, _LEARN), NOW, overlays=overlays, forecast=f, clawbacks=clawbacks, at=_AT)


@register("tuned_overlays", f"{_TUNE}, ap AS (SELECT * FROM du WHERE reason = 'holdout_pattern_recall_lift'), nw AS (SELECT region, city, 'thresholds.' || head AS path, thr::DOUBLE AS value FROM ap UNION ALL SELECT region, city, 'blend.' || head || '.rule_weight', [0.4, 0.6, 0.8][blend] FROM ap WHERE blend > 0 UNION ALL SELECT region, city, 'blend.' || head || '.ml_weight', [0.6, 0.4, 0.2][blend] FROM ap WHERE blend > 0 UNION ALL SELECT DISTINCT region, city, 'routing.p1_attention_min', 50.0 FROM ap WHERE support >= 6), od AS (SELECT region, city, 'thresholds.' || head AS path, value FROM ov UNION ALL SELECT region, city, 'dbscan.min_pts', 9.0 FROM ov WHERE city = '') SELECT region, city, path, value::DOUBLE AS value FROM nw UNION ALL SELECT region, city, path, value::DOUBLE FROM od WHERE (region, city, path) NOT IN (SELECT (region, city, path) FROM nw)")
def tuned_overlays(spark, sf_dir):
    r = fixtures.table(spark, sf_dir, "region").withColumn("k", F.col("r_regionkey").cast("int"))
    one = F.concat(F.lit("R"), (F.col("k") % 2).cast("string")).alias("region")
    old = r.select(one, F.element_at(F.array(*map(F.lit, ("", "A", "B", "", "A"))), F.col("k") + 1).alias("city"), F.when(F.col("k") % 2 == 0, "thresholds.cancelled_offline").otherwise("thresholds.cancel_abuse").alias("path"), F.round(0.6 + 0.05 * F.col("k"), 2).alias("value"))
    old = old.unionByName(old.where("city = ''").withColumns({"path": F.lit("dbscan.min_pts"), "value": F.lit(9.0)}))
    return control.tuned_overlays(old, tuning.tuned_values(_tuned(spark, sf_dir))).select("region", "city", "path", "value")


@register("cap_breaches", "SELECT region, projected, CASE region WHEN 'R0' THEN projected <= 10 WHEN 'R1' THEN projected <= 100000 ELSE true END AS within, CASE WHEN region = 'R0' AND projected > 10 THEN 'breaches_hour_cap' END AS breach FROM (SELECT 'R' || region AS region, count(*) FILTER (cancel_abuse >= 0.75) AS projected FROM v_scores GROUP BY 1)")
def cap_breaches(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir).select(F.concat(F.lit("R"), F.col("region").cast("string")).alias("region"), F.lit("").alias("city"), F.lit("cancel_abuse").alias("head"), F.col("cancel_abuse").alias("score"))
    p = control.projected_flags(s, [0.75]).select("region", "city", "projected")
    caps = spark.createDataFrame([("R0", "", "hour", 10), ("R0", "", "day", 100000), ("R1", "", "week", 100000)], "region string, city string, window string, cap int")
    return control.caps_left(p, caps).select("region", "projected", "within", "breach")


# -- reports -----------------------------------------------------------------------------------------------------------


@register("presence_counts", "p AS (SELECT order_id, CASE order_id % 4 WHEN 0 THEN 'curb' WHEN 1 THEN 'unknown' WHEN 2 THEN 'apartment' ELSE 'unknown' END AS place, CASE WHEN order_id % 3 = 0 THEN 'semi' ELSE 'unknown' END AS vehicle FROM v_scores), u AS (SELECT 'place_class' AS field, place AS class FROM p UNION ALL SELECT 'vehicle_class', vehicle FROM p) SELECT field, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY field), 6) AS share FROM u GROUP BY 1, 2")
def presence_counts(spark, sf_dir):
    k = F.col("order_id")
    s = fixtures.scores(spark, sf_dir).select(F.when(k % 4 == 0, " curb").when(k % 4 == 1, "unknown").when(k % 4 == 2, "apartment").alias("place_class"), F.when(k % 3 == 0, "semi").otherwise(" ").alias("vehicle_class"))
    return control.presence_counts(s, "place_class", "vehicle_class").select("field", "class", "n", r6("share"))


@register("dwell_nudges", "x AS (SELECT CASE order_id % 3 WHEN 0 THEN 'curb' WHEN 1 THEN 'apartment' ELSE 'unknown' END AS place_class, score >= CASE WHEN order_id % 3 = 0 THEN 0.3 ELSE 0.99 END AS flag, label FROM v_pairs WHERE head = 'cancelled_offline'), g AS (SELECT place_class, count(*) AS n, avg(CASE WHEN flag AND label = 0 THEN 1.0 ELSE 0.0 END) AS fp, avg(CASE WHEN NOT flag AND label = 1 THEN 1.0 ELSE 0.0 END) AS fn, CASE place_class WHEN 'curb' THEN 0.85 WHEN 'apartment' THEN 1.35 ELSE 1.0 END::DOUBLE AS f FROM x GROUP BY 1) SELECT place_class, n, round(fp, 6) AS fp_rate, round(fn, 6) AS fn_rate, f AS factor, round(CASE WHEN n >= 10 AND place_class <> 'unknown' AND fp >= 0.25 AND fp > fn THEN f * 1.1 WHEN n >= 10 AND place_class <> 'unknown' AND fn >= 0.25 AND fn > fp THEN f * 0.9 ELSE f END, 3) AS suggested FROM g")
def dwell_nudges(spark, sf_dir):
    p = quality.labelled(fixtures.scores(spark, sf_dir), fixtures.labels(spark, sf_dir)).where("head = 'cancelled_offline'")
    k = F.col("order_id")
    p = p.select(F.when(k % 3 == 0, "curb").when(k % 3 == 1, "apartment").alias("place_class"), (F.col("score") >= F.when(k % 3 == 0, 0.3).otherwise(0.99)).alias("flag"), "label")
    return quality.dwell_nudges(p, DEFAULTS["dwell"]["place_factors"]).select("place_class", "n", r6("fp_rate"), r6("fn_rate"), "factor", "suggested")


@register("floor_violations", "SELECT head, round(p, 6) AS precision, round(r, 6) AS recall FROM (SELECT head, count(*) FILTER (score >= 0.75 AND label = 1) / greatest(1, count(*) FILTER (score >= 0.75)) AS p, count(*) FILTER (score >= 0.75 AND label = 1) / greatest(1, count(*) FILTER (label = 1)) AS r FROM v_pairs GROUP BY 1) WHERE p < 0.3 OR r < 0.1 UNION ALL SELECT 'selective_theft', NULL, NULL")
def floor_violations(spark, sf_dir):
    p = quality.labelled(fixtures.scores(spark, sf_dir), fixtures.labels(spark, sf_dir))
    floors = spark.createDataFrame([(h, 0.3, 0.1) for h in HEADS], "head string, min_precision double, min_recall double")
    return quality.floor_violations(quality.confusion(p, F.col("score") >= 0.75, "head"), floors).select("head", r6("precision"), r6("recall"))


@register("shadow_money", "SELECT head, round(sum(order_value) FILTER (score >= 0.7 AND NOT score >= 0.75), 4) AS shadow_only, round(sum(order_value) FILTER (score >= 0.75), 4) AS both, count(*) AS n FROM v_heads GROUP BY 1")
def shadow_money(spark, sf_dir):
    h = quality.by_head(fixtures.scores(spark, sf_dir), "score", "order_id", "order_value").withColumns({"champion": F.col("score") >= 0.75, "challenger": F.col("score") >= 0.70})
    return models.shadow_money(h).select("head", F.round("shadow_only", 4).alias("shadow_only"), F.round("both", 4).alias("both"), "n")


@register("shadow_rows", "SELECT order_id, round(0.6 * cancelled_offline + 0.4 * cancel_abuse, 6) AS champion, round(0.6 * cancelled_offline + 0.4 * selective_theft, 6) AS shadow, 0.6 * cancelled_offline + 0.4 * cancel_abuse >= 0.75 AS champion_flag, 0.6 * cancelled_offline + 0.4 * selective_theft >= 0.75 AS shadow_flag FROM v_scores")
def shadow_rows(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    s = s.withColumns({f"rule_{h}": F.col("cancelled_offline") for h in HEADS} | {f"m1_{h}": F.col("cancel_abuse") for h in HEADS} | {f"m2_{h}": F.col("selective_theft") for h in HEADS})
    rows = models.shadow_rows(s, "m1_", {"m2": "m2_"}, DEFAULTS).where("head = 'cancelled_offline'")
    return rows.select("order_id", r6("champion_score", "champion"), r6("shadow_score", "shadow"), F.col("champion").alias("champion_flag"), F.col("challenger").alias("shadow_flag"))


@register("holdout_strata", "SELECT event_type AS stratum, count(*) AS n, round(avg(((event_id * 7919) % 1000) / 1000.0::DOUBLE), 6) AS mean_score FROM v_events GROUP BY 1")
def holdout_strata(spark, sf_dir):
    e = fixtures.events(spark, sf_dir).select("event_id", F.col("event_type").alias("stratum")).join(fixtures.scores(spark, sf_dir).select(F.col("order_id").alias("event_id"), F.col("cancelled_offline").alias("score")), "event_id")
    return control.strata_report(e).select("stratum", "n", r6("mean_score"))


@register("backtest", "SELECT head, CASE head WHEN 'cancelled_offline' THEN score >= 0.85 ELSE score >= 0.7 END AS pattern, count(*) FILTER (score >= 0.75 AND label = 1) AS tp, count(*) FILTER (score >= 0.75 AND label = 0) AS fp, count(*) FILTER (score < 0.75 AND label = 1) AS fn, count(*) FILTER (score < 0.75 AND label = 0) AS tn FROM v_pairs GROUP BY 1, 2")
def backtest(spark, sf_dir):
    p = quality.labelled(fixtures.scores(spark, sf_dir), fixtures.labels(spark, sf_dir))
    pattern = F.coalesce(*(F.when(F.col("head") == h, sampling.in_pattern(h, DEFAULTS, F.col("score"))) for h in HEADS))
    return quality.confusion(p.withColumn("pattern", pattern), F.col("score") >= 0.75, "head", "pattern").select("head", "pattern", "tp", "fp", "fn", "tn")


@register("markets_seen", "SELECT 'R' || region AS region, CASE WHEN order_id % 2 = 0 THEN 'C' ELSE '' END AS city, min(ts) AS first_seen FROM v_scores WHERE region > 0 GROUP BY 1, 2")
def markets_seen(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir).select(F.when(F.col("region") > 0, F.concat(F.lit(" r"), F.col("region").cast("string"))).alias("region"), F.when(F.col("order_id") % 2 == 0, "c ").alias("city"), F.col("ts").alias("assessed_at"))
    return control.markets_of(s)


@register("market_metrics", "SELECT head, count(*) FILTER (score >= 0.75 AND label = 1) AS tp, count(*) FILTER (score >= 0.75 AND label = 0) AS fp, count(*) FILTER (score < 0.75 AND label = 1) AS fn FROM v_pairs WHERE region = 2 GROUP BY 1")
def market_metrics(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir).withColumn("region", F.concat(F.lit("r"), F.col("region").cast("string")))
    p = quality.labelled(quality.in_market(s, "R2"), fixtures.labels(spark, sf_dir))
    return quality.confusion(p, F.col("score") >= 0.75, "head").select("head", "tp", "fp", "fn")


@register("resolved_scores", "SELECT order_id, round(CASE WHEN order_id % 3 = 0 THEN cancelled_offline WHEN order_id % 3 = 1 THEN cancel_abuse ELSE 0.4 * selective_theft + 0.6 * cancel_abuse END, 6) AS score FROM v_scores")
def resolved_scores(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir)
    k = F.col("order_id")
    raw = F.when(k % 3 == 1, F.col("cancel_abuse"))
    plain = quality.resolved_score(F.col("cancelled_offline"), raw, F.col("selective_theft"), F.col("cancel_abuse"), None)
    over = quality.resolved_score(F.col("cancelled_offline"), raw, F.col("selective_theft"), F.col("cancel_abuse"), {"rule_weight": 0.4, "ml_weight": 0.6})
    return s.select("order_id", F.round(F.when(k % 3 == 2, over).otherwise(plain), 6).alias("score"))


@register("teacher_labels", "SELECT order_id, head, CASE WHEN ('0x' || substr(sha256('5:' || head || ':' || order_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 1 - (score >= 0.75)::INT ELSE (score >= 0.75)::INT END::INT AS label FROM v_heads")
def teacher_labels(spark, sf_dir):
    h = quality.by_head(fixtures.scores(spark, sf_dir), "score", "order_id").withColumn("flag", (F.col("score") >= 0.75).cast("int"))
    return models.teacher_labels(h, 0.1, 5).select("order_id", "head", "label")


@register("train_quality", "SELECT head, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(mae, 6) AS mae FROM (SELECT head, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, avg(abs(label - score)) AS mae FROM v_pairs GROUP BY 1)")
def train_quality(spark, sf_dir):
    p = quality.labelled(fixtures.scores(spark, sf_dir), fixtures.labels(spark, sf_dir)).withColumnRenamed("score", "predicted")
    return control.train_quality(p).select("head", r6("precision"), r6("recall"), r6("mae"))


@register("device_previous", "SELECT event_id, round(list_reduce(h, lambda a, x: 0.4 * x + 0.6 * a), 6) AS prev FROM (SELECT event_id, list(risk) OVER (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM v_device)")
def device_previous(spark, sf_dir):
    t = history.previous_average(fixtures.device_risks(spark, sf_dir), "device_id", "risk", DEFAULTS["device_integrity"]["ewma_alpha"], ("ts", "event_id"))
    return t.select("event_id", r6("prev"))


@register("baseline_listing", "SELECT entity, samples FROM (SELECT entity, count(*) AS samples FROM v_scores GROUP BY 1) WHERE samples >= 12 AND entity % 2 = 0 ORDER BY samples DESC, entity LIMIT 15")
def baseline_listing(spark, sf_dir):
    s = fixtures.scores(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("samples")).withColumn("updated_at", F.col("samples"))
    return history.baseline_query(s, [F.col("entity") % 2 == 0, F.col("samples") >= 12], limit=15).select("entity", "samples")
