"""DuckDB statements that compute the registered queries independently, over the same tables."""

from __future__ import annotations

VIEWS = """
v_orders AS (
  SELECT *, assign_ts + CASE tpl WHEN 3 THEN 900 WHEN 5 THEN 7200 ELSE 4800 END AS cancel_ts, CASE WHEN var = 6 THEN -(driver_id + 1) ELSE order_id END AS track_id,
    ['curb', 'apartment', NULL, 'commercial', 'residential', 'weird', 'unknown'][var + 1] AS place, ['two_wheel', NULL, 'semi', 'walker', 'box_truck', 'van_pickup', 'large_4w'][(var + tpl) % 7 + 1] AS vehicle,
    CASE var WHEN 1 THEN [0, 9, 19] WHEN 2 THEN [0, 12, 6, 19] WHEN 3 THEN [0, 19, 0] WHEN 4 THEN [0, 6, 9, 12, 19] ELSE [0, 19] END AS ks, CASE var WHEN 0 THEN [0, 19] WHEN 1 THEN [19] ELSE [0] END AS rks,
    'C' || (user_id % 25) AS city, user_id % 60 AS device_id FROM (
    SELECT o_orderkey AS order_id, CAST(o_orderkey % 9 AS INTEGER) AS tpl, CAST((o_orderkey // 9) % 7 AS INTEGER) AS var, o_custkey AS user_id, o_orderkey % 200 AS driver_id,
           CAST(floor(epoch(o_orderdate)) AS BIGINT) + (o_orderkey % 1440) * 60 AS assign_ts,
           o_totalprice / 500.0 AS order_value, CASE WHEN o_orderkey % 9 <= 4 THEN 'FOOD' ELSE 'HAUL' END AS category,
           o_orderkey % 9 IN (0, 1) AS alone, CASE WHEN o_orderkey % 9 = 2 THEN 3 ELSE 0 END AS n_reassign,
           o_orderpriority IN ('1-URGENT', '2-HIGH') AS replaced
    FROM orders WHERE o_orderstatus = 'F')),
v_stops AS (
  SELECT order_id, ns, stop_idx, 14.55::DOUBLE + (k / 19.0::DOUBLE) * (14.65::DOUBLE - 14.55::DOUBLE) + CASE WHEN var = 4 AND stop_idx = 2 THEN 0.01 ELSE 0.0 END::DOUBLE AS slat, 121.02::DOUBLE + (k / 19.0::DOUBLE) * (121.08::DOUBLE - 121.02::DOUBLE) AS slon
  FROM (SELECT order_id, var, CAST(len(ks) AS INTEGER) AS ns, CAST(unnest(range(len(ks))) AS INTEGER) AS stop_idx, unnest(ks) AS k FROM v_orders)),
v_pings AS (
  SELECT track_id, assign_ts + i * 120 AS ts, i + 100 * (order_id % 100000) AS seq,
    CASE WHEN outl THEN lat0 - (k % 3) * 0.0006::DOUBLE ELSE lat0 + (i % 5) * 0.00001::DOUBLE END AS lat,
    CASE WHEN outl THEN lon0 + (k // 3 + 1) * 0.0006::DOUBLE ELSE lon0 + (i % 3) * 0.00001::DOUBLE END AS lon,
    CASE WHEN tpl IN (0, 6) THEN 0.2 WHEN tpl = 2 THEN 1.0 WHEN tpl = 3 THEN 5.0 WHEN tpl = 4 THEN 0.0
         WHEN tpl = 5 AND i BETWEEN 20 AND 39 THEN 8.0 ELSE 0.3 END::DOUBLE AS speed,
    CASE WHEN tpl = 3 THEN CASE var WHEN 0 THEN 180.0 WHEN 1 THEN 0.0 WHEN 2 THEN 90.0 END END::DOUBLE AS heading
  FROM (SELECT *, i // 4 AS k, tpl IN (7, 8) AND i % 4 = 0 AS outl,
      CASE WHEN tpl = 3 AND var = 2 THEN 14.56::DOUBLE - i * 0.0002::DOUBLE WHEN tpl = 3 THEN 14.56 WHEN tpl = 5 AND i BETWEEN 20 AND 39 THEN 14.55 + ((i - 20) / 19.0::DOUBLE) * (14.65::DOUBLE - 14.55::DOUBLE)
           WHEN tpl = 5 AND i >= 40 THEN 14.65 WHEN tpl = 6 AND i = 20 THEN 14.55::DOUBLE + 0.05::DOUBLE WHEN tpl = 7 THEN 14.55::DOUBLE + 0.0022::DOUBLE
           WHEN tpl = 8 THEN 14.55::DOUBLE + 0.0054::DOUBLE ELSE 14.55 END::DOUBLE AS lat0,
      CASE WHEN tpl = 5 AND i BETWEEN 20 AND 39 THEN 121.02 + ((i - 20) / 19.0::DOUBLE) * (121.08::DOUBLE - 121.02::DOUBLE)
           WHEN tpl = 5 AND i >= 40 THEN 121.08 ELSE 121.02 END::DOUBLE AS lon0
    FROM (SELECT *, unnest(range([40, 25, 20, 12, 2, 60, 40, 40, 40][tpl + 1])) AS i FROM v_orders WHERE NOT (tpl = 4 AND var = 0)))),
v_events AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS driver_id, event_id % 25 AS user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
v_funnel AS (
  SELECT event_id AS order_id, ts, driver_id, user_id, CASE event_type WHEN 'signup' THEN 'accept' WHEN 'purchase' THEN 'complete' ELSE 'cancel' END AS kind,
         coalesce(k % 3 = 0, false) AS with_cause FROM v_events WHERE event_type IN ('signup', 'purchase', 'error')),
v_edges AS (
  SELECT event_id % 60 AS device_id, 'driver' AS entity_kind, driver_id AS entity_id, ts FROM v_events
  UNION ALL SELECT event_id % 60, 'user', user_id, ts FROM v_events WHERE event_type = 'purchase'),
v_device AS (SELECT event_id % 60 AS device_id, event_id, ts, least(1.0, value / 400.0) AS risk FROM v_events),
v_scores AS (
  SELECT event_id AS order_id, driver_id AS entity, ts, event_id % 5 AS region, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS cancelled_offline,
         ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS cancel_abuse, ((event_id * 1299709) % 1000) / 1000.0::DOUBLE AS selective_theft, value AS order_value FROM v_events),
v_heads AS (
  SELECT order_id, entity, ts, region, order_value, 'cancelled_offline' AS head, cancelled_offline AS score FROM v_scores
  UNION ALL SELECT order_id, entity, ts, region, order_value, 'cancel_abuse', cancel_abuse FROM v_scores
  UNION ALL SELECT order_id, entity, ts, region, order_value, 'selective_theft', selective_theft FROM v_scores),
v_labels AS (
  SELECT doc_id AS order_id, 'cancelled_offline' AS head, quality AS label FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'cancel_abuse', toxic FROM labels WHERE toxic IS NOT NULL),
v_pairs AS (SELECT h.*, l.label FROM v_heads h JOIN v_labels l USING (order_id, head)),
v_outcomes AS (
  SELECT event_id AS order_id, CASE event_type WHEN 'purchase' THEN 'clawback_won' ELSE 'clawback_lost' END AS outcome, event_id % 5 AS region,
         ['cancelled_offline', 'cancel_abuse', 'selective_theft'][CAST(event_id % 3 AS INTEGER) + 1] AS head, ts, value AS amount
  FROM v_events WHERE event_type IN ('purchase', 'error')),
v_forecast AS (
  SELECT r_regionkey::BIGINT AS region, d, 1704067200 + d * 86400 AS start_ts, 1704067200 + (d + 1) * 86400 AS end_ts, (50 + d % 40)::DOUBLE AS supply,
         CASE WHEN d % 7 = 0 THEN 120.0 ELSE 60.0 END::DOUBLE AS demand FROM region, range(30) t(d)),
v_generations AS (
  SELECT order_id, unnest(CASE WHEN order_id % 10 = 0 THEN ['p1', 'p2'] ELSE ['p1'] END) AS policy_hash, 'rules' AS model_version, generation,
         cancelled_offline, cancel_abuse, selective_theft, ts + generation * 60 AS assessed_at, false AS provisional
  FROM (SELECT *, unnest(range(1, CAST(2 + order_id % 3 AS BIGINT)))::INTEGER AS generation FROM v_scores))"""


def distance(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371.0::DOUBLE * 1000.0 * atan2(sqrt(sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2), "
        f"sqrt(1 - (sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2))))"
    )


_MATCHES = "m0 AS (SELECT order_id, min(rn) AS rn FROM ps WHERE stop_idx = 0 AND dist <= 150 GROUP BY 1),\n" + "".join(
    f"m{k} AS (SELECT ps.order_id, min(ps.rn) AS rn FROM ps JOIN m{k - 1} b ON b.order_id = ps.order_id AND ps.rn > b.rn WHERE stop_idx = {k} AND dist <= 150 GROUP BY 1),\n" for k in range(1, 5)
)
_BEARING = "(degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))) + 360) % 360"
_COURSE = _BEARING.format(lat1="lat", lon1="lon", lat2="14.55::DOUBLE", lon2="121.02::DOUBLE")

TRACKS = f"""
base AS (SELECT *, least(assign_ts, cancel_ts - 10800) AS b0, cancel_ts + 300 AS b1 FROM v_orders),
bp AS (SELECT b.order_id, p.ts, lag(p.ts) OVER (PARTITION BY b.order_id ORDER BY p.ts, p.seq) AS prev FROM base b JOIN v_pings p ON p.track_id = b.track_id AND p.ts BETWEEN b.b0 AND b.b1),
bs AS (SELECT b.order_id, count(bp.ts) AS n, CASE WHEN count(bp.ts) = 0 THEN any_value(b1 - b0) ELSE greatest(coalesce(max(bp.ts - prev), 0), min(bp.ts) - any_value(b0), any_value(b1) - max(bp.ts)) END / 60.0 AS gap
       FROM base b LEFT JOIN bp USING (order_id) GROUP BY 1),
win AS (SELECT base.*, (n < 20 OR gap > 45) AS expanded, CASE WHEN n < 20 OR gap > 45 THEN b0 + (b1 - b0) // 2 - 43200 ELSE b0 END AS window_start,
        CASE WHEN n < 20 OR gap > 45 THEN b0 + (b1 - b0) // 2 + 43200 ELSE b1 END AS window_end FROM base JOIN bs USING (order_id)),
tp AS (SELECT w.order_id, p.ts, p.seq, p.lat, p.lon, p.speed, p.heading, row_number() OVER x AS rn, lag(p.ts) OVER x AS prev, lag(p.lat) OVER x AS plat, lag(p.lon) OVER x AS plon
       FROM win w JOIN v_pings p ON p.track_id = w.track_id AND p.ts BETWEEN w.window_start AND w.window_end WINDOW x AS (PARTITION BY w.order_id ORDER BY p.ts, p.seq)),
prof AS (SELECT w.order_id, count(tp.ts) AS point_count, CASE WHEN count(tp.ts) = 0 THEN any_value(window_end - window_start) ELSE greatest(coalesce(max(tp.ts - prev), 0), min(tp.ts) - any_value(window_start), any_value(window_end) - max(tp.ts)) END / 60.0 AS max_gap_minutes,
         quantile_cont(CASE WHEN tp.ts - prev > 0 AND tp.ts - prev <= 2700 THEN (tp.ts - prev)::DOUBLE END, 0.5) AS gap_median, count(CASE WHEN tp.ts - prev > 0 AND tp.ts - prev <= 2700 THEN 1 END) AS gaps,
         any_value(least(600.0, greatest(30.0, 120.0 * CASE place WHEN 'curb' THEN 0.85 WHEN 'apartment' THEN 1.35 WHEN 'commercial' THEN 1.5 ELSE 1.0 END::DOUBLE
           * CASE vehicle WHEN 'two_wheel' THEN 0.7 WHEN 'semi' THEN 1.6 WHEN 'walker' THEN 0.55 WHEN 'box_truck' THEN 1.45 WHEN 'large_4w' THEN 1.25 ELSE 1.0 END::DOUBLE))) AS target
         FROM win w LEFT JOIN tp USING (order_id) GROUP BY 1),
pres AS (SELECT *, CASE WHEN gaps >= 3 THEN CAST(least(30, greatest(3, round_even(7 * (target / 120.0::DOUBLE * (5.0 / least(30.0, greatest(1.0, gap_median)))::DOUBLE), 0))) AS INTEGER) ELSE 7 END AS min_pts,
         CASE WHEN gaps >= 3 THEN CAST(least(80, greatest(5, round_even(30 * (target / 120.0::DOUBLE * (5.0 / least(30.0, greatest(1.0, gap_median)))::DOUBLE), 0))) AS INTEGER) ELSE 30 END AS drop_min_pts FROM prof),
near AS (SELECT a.order_id, a.rn, a.lat, a.lon, count(*) AS n FROM tp a JOIN tp b ON a.order_id = b.order_id AND {distance("a.lat", "a.lon", "b.lat", "b.lon")} <= 50 GROUP BY ALL),
core AS (SELECT near.* FROM near JOIN pres USING (order_id) WHERE n >= min_pts),
dense AS (SELECT DISTINCT a.order_id, a.rn FROM tp a JOIN core b ON a.order_id = b.order_id AND {distance("a.lat", "a.lon", "b.lat", "b.lon")} <= 50),
ps AS (SELECT tp.*, s.stop_idx, s.ns, {distance("tp.lat", "tp.lon", "s.slat", "s.slon")} AS dist, d.rn IS NOT NULL AS inc FROM tp JOIN v_stops s USING (order_id) LEFT JOIN dense d ON d.order_id = tp.order_id AND d.rn = tp.rn),
tiers AS (SELECT order_id, stop_idx, any_value(ns) AS ns, count(*) FILTER (dist < 150) AS n1, count(*) FILTER (dist < 150 AND inc) AS c1, count(*) FILTER (dist < 400) AS n2, count(*) FILTER (dist < 400 AND inc) AS c2,
          count(*) FILTER (dist < 800) AS n3, count(*) FILTER (dist < 800 AND inc) AS c3 FROM ps GROUP BY 1, 2),
home AS (SELECT order_id, 1 + count(*) FILTER (ts - before > 3600) AS visits FROM (SELECT ps.order_id, ts, lag(ts) OVER (PARTITION BY ps.order_id ORDER BY ps.rn) AS before FROM ps JOIN v_orders USING (order_id) WHERE var = 3 AND stop_idx = 0 AND dist < 800) GROUP BY 1),
conf AS (SELECT order_id, stop_idx, ns, CASE WHEN var = 3 AND stop_idx = ns - 1 AND coalesce(visits, 1) = 1 THEN confidence / 2 ELSE confidence END AS confidence FROM (
         SELECT order_id, stop_idx, ns, CASE WHEN n1 > drop_min_pts THEN c1 / n1 WHEN n2 > drop_min_pts THEN c2 / n2 * 0.6 WHEN n3 > drop_min_pts THEN c3 / n3 * 0.2 ELSE 0 END::DOUBLE AS confidence FROM tiers JOIN pres USING (order_id)) JOIN v_orders USING (order_id) LEFT JOIN home USING (order_id)),
stopc AS (SELECT order_id, avg(confidence) AS stop_confidence, max(CASE WHEN stop_idx = ns - 1 THEN confidence END) AS last_confidence FROM conf GROUP BY 1),
vst AS (SELECT order_id, stop_idx, any_value(ns) AS ns, min(ts) FILTER (dist <= CASE WHEN stop_idx > 0 AND stop_idx = ns - 1 THEN 400 ELSE 150 END) AS vts FROM ps GROUP BY 1, 2),
vis AS (SELECT order_id, any_value(ns) AS ns, max(CASE WHEN stop_idx = 0 THEN vts END) AS pickup_ts, max(CASE WHEN stop_idx = ns - 1 THEN vts END) AS drop_ts, list(vts ORDER BY stop_idx) FILTER (vts IS NOT NULL) AS seen,
          list(vts ORDER BY stop_idx) FILTER (stop_idx > 0 AND stop_idx < ns - 1 AND vts IS NOT NULL) AS mid FROM vst GROUP BY 1),
{_MATCHES}path AS (SELECT w.order_id, len(w.ks) AS ns, (CASE WHEN m0.rn IS NULL THEN 0 WHEN m1.rn IS NULL THEN 1 WHEN m2.rn IS NULL THEN 2 WHEN m3.rn IS NULL THEN 3 WHEN m4.rn IS NULL THEN 4 ELSE 5 END)::DOUBLE / len(w.ks) AS path_score
         FROM win w LEFT JOIN m0 USING (order_id) LEFT JOIN m1 USING (order_id) LEFT JOIN m2 USING (order_id) LEFT JOIN m3 USING (order_id) LEFT JOIN m4 USING (order_id)),
seqv AS (SELECT p.*, pickup_ts, drop_ts, coalesce(seen, []) AS seen, coalesce(mid, []) AS mid, coalesce(drop_ts <= pickup_ts, false) AS drop_before, pickup_ts IS NOT NULL AND drop_ts IS NOT NULL AS both_visited FROM path p LEFT JOIN vis v USING (order_id)),
seqo AS (SELECT *, len(list_filter(range(1, len(seen)), lambda i: seen[i + 1] <= seen[i])) = 0 AND (NOT both_visited OR drop_before OR len(list_filter(mid, lambda t: t <= pickup_ts OR t >= drop_ts)) = 0) AND NOT drop_before AS order_ok FROM seqv),
seqr AS (SELECT *, CASE WHEN drop_before THEN 0 WHEN NOT order_ok AND both_visited THEN 0 WHEN path_score >= 1 - 1e-9 THEN path_score WHEN NOT both_visited AND pickup_ts IS NOT NULL AND drop_ts IS NULL THEN greatest(path_score, 0.5) WHEN NOT both_visited THEN path_score
           WHEN ns > 2 AND len(mid) < ns - 2 THEN greatest(path_score, len(seen) / ns * 0.5) ELSE 1.0 END::DOUBLE AS sequence_score,
         CASE WHEN drop_before THEN 'drop_before_pickup' WHEN NOT order_ok AND both_visited THEN 'stop_order_violation' WHEN path_score >= 1 - 1e-9 THEN NULL WHEN NOT both_visited AND pickup_ts IS NOT NULL AND drop_ts IS NULL THEN 'pickup_only' WHEN NOT both_visited THEN NULL
           WHEN ns > 2 AND len(mid) < ns - 2 THEN 'middle_stops_missing' ELSE 'pickup_drop_order' END AS sequence_reason FROM seqo),
hops AS (SELECT order_id, {distance("plat", "plon", "lat", "lon")} AS m, ts - prev AS s FROM tp WHERE prev IS NOT NULL AND ts - prev > 0.5),
integ AS (SELECT w.order_id, coalesce(max(m), 0.0) AS max_jump_m, coalesce(max(m / s), 0.0) AS max_speed_mps FROM win w LEFT JOIN hops USING (order_id) GROUP BY 1),
lastp AS (SELECT order_id, max(CASE WHEN stop_idx = 0 THEN dist END) AS m, max(CASE WHEN stop_idx = ns - 1 THEN dist END) AS d FROM ps WHERE rn = (SELECT max(rn) FROM tp WHERE tp.order_id = ps.order_id) GROUP BY 1),
stg AS (SELECT s.order_id, m, d, CASE WHEN m IS NULL THEN 'unknown' WHEN drop_before THEN CASE WHEN m <= 150 THEN 'at_merchant' ELSE 'unknown' END
          WHEN d <= 400 THEN CASE WHEN pickup_ts IS NOT NULL THEN 'near_dropoff' ELSE 'unknown' END WHEN m <= 150 THEN 'at_merchant' WHEN pickup_ts IS NOT NULL THEN 'en_route' ELSE 'pre_pickup' END AS cancel_stage
        FROM seqr s LEFT JOIN lastp USING (order_id)),
pwin AS (SELECT tp.order_id, tp.rn, tp.ts, tp.lat, tp.lon, tp.heading, tp.ts BETWEEN w.assign_ts AND w.assign_ts + 480 AS early FROM tp JOIN win w USING (order_id)),
pcnt AS (SELECT order_id, count(*) AS n, count(*) FILTER (early) AS ne FROM pwin GROUP BY 1),
psel AS (SELECT p.*, abs(heading - {_COURSE}) % 360 AS d FROM pwin p JOIN pcnt c USING (order_id) WHERE c.n >= 3 AND CASE WHEN c.ne < 3 THEN p.rn <= 5 ELSE p.early END),
pend AS (SELECT order_id, count(*) AS n, arg_min({distance("lat", "lon", "14.55::DOUBLE", "121.02::DOUBLE")}, rn) AS d0, arg_max({distance("lat", "lon", "14.55::DOUBLE", "121.02::DOUBLE")}, rn) AS d1,
           count(d) AS ne, count(*) FILTER (least(d, 360 - d) <= 60) AS toward, count(*) FILTER (least(d, 360 - d) >= 120) AS away FROM psel GROUP BY 1),
prg AS (SELECT w.order_id, CASE WHEN d0 > 1 THEN (d0 - d1) / d0 WHEN d0 - d1 > 0 THEN 1.0 ELSE 0.0 END AS raw, coalesce(n >= 2, false) AS measured, d0, coalesce(ne >= 3, false) AS heading_ok, CASE WHEN ne >= 3 THEN away / ne END AS away_fraction, CASE WHEN ne >= 3 THEN toward / ne END AS toward_fraction FROM win w LEFT JOIN pend USING (order_id)),
prq AS (SELECT *, measured AND coalesce(away_fraction >= 0.5, false) AS wrong, measured AND NOT coalesce(away_fraction >= 0.5, false) AND coalesce(toward_fraction < 0.4, false) AND raw > 0 AS crooked FROM prg),
prog AS (SELECT *, CASE WHEN NOT measured THEN 0.0 WHEN wrong THEN least(raw, 0.0) WHEN crooked THEN raw * 0.25 ELSE raw END AS progress_ratio FROM prq)"""

#: Dwells: runs of slow pings near a stop, walked ping by ping because a run's first ping anchors it.
DWELLS = f"""
walk AS (
  SELECT order_id, stop_idx, rn, CASE WHEN ok THEN ts END AS start, CASE WHEN ok THEN lat END AS alat, CASE WHEN ok THEN lon END AS alon, false AS hit
  FROM (SELECT *, dist <= 80 AND coalesce(speed <= 1.5, dist <= 80) AS ok FROM ps WHERE rn = 1)
  UNION ALL
  SELECT order_id, stop_idx, rn,
    CASE WHEN NOT ok THEN NULL WHEN start IS NULL THEN ts WHEN away THEN NULL ELSE start END, CASE WHEN NOT ok THEN NULL WHEN start IS NULL THEN lat WHEN away THEN NULL ELSE alat END,
    CASE WHEN NOT ok THEN NULL WHEN start IS NULL THEN lon WHEN away THEN NULL ELSE alon END, hit OR coalesce(ok AND NOT away AND ts - start >= target, false)
  FROM (SELECT w.start, w.alat, w.alon, w.hit, p.*, q.target, p.dist <= 80 AND coalesce(p.speed <= 1.5, p.dist <= 80) AS ok, coalesce({distance("w.alat", "w.alon", "p.lat", "p.lon")} > 40, false) AS away
        FROM walk w JOIN ps p ON p.order_id = w.order_id AND p.stop_idx = w.stop_idx AND p.rn = w.rn + 1 JOIN prof q ON q.order_id = p.order_id)),
dw AS (SELECT order_id, stop_idx, bool_or(hit) AS hit FROM walk GROUP BY 1, 2),
dwf AS (SELECT w.order_id, coalesce(bool_or(hit) FILTER (stop_idx = 0), false) AS dwell_pickup, coalesce(bool_or(hit) FILTER (stop_idx = len(ks) - 1), false) AS dwell_drop, (count(*) FILTER (hit))::DOUBLE / any_value(len(ks)) AS dwell_fraction FROM win w LEFT JOIN dw USING (order_id) GROUP BY 1)"""

#: An entity's baselines, walked score by score: {source} gives kind, entity, head, ts, order_id, s.
BASELINES = """
obs AS (SELECT *, CASE WHEN kind = 'pair' THEN {pair} ELSE {wide} END AS size, row_number() OVER (PARTITION BY kind, entity, head ORDER BY ts, order_id) AS rn FROM ({source})),
steps AS (
  SELECT kind, entity, head, order_id, size, rn, 1::BIGINT AS n, [{{'t': ts, 's': s}}] AS w, s AS e, CASE WHEN s < 0.75 AND size = 1 THEN s END AS b, CASE WHEN s < 0.75 AND size = 1 THEN 0.75 END::DOUBLE AS thr, false AS active FROM obs WHERE rn = 1
  UNION ALL
  SELECT kind, entity, head, order_id, size, rn, n, w, e, b2, CASE WHEN b2 IS NULL THEN NULL ELSE coalesce(thr, 0.75) END, coalesce(n >= {samples} AND e > b2 + {eps} AND len(w) >= size AND len(list_filter(w, lambda x: x.s > b2 + {eps})) / len(w) >= {above}, false)
  FROM (SELECT *, CASE WHEN NOT under THEN b WHEN b IS NULL THEN cand WHEN cand < b - 0.05 THEN cand ELSE b END AS b2
    FROM (SELECT *, (len(w) >= size AND len(list_filter(w, lambda x: x.s < 0.75)) / len(w) >= {under}) OR (n >= {samples} AND e < 0.75 - 0.05) AS under,
        CASE WHEN len(list_filter(w, lambda x: x.s < 0.75)) > 0 THEN list_sum(list_transform(list_filter(w, lambda x: x.s < 0.75), lambda x: x.s)) / len(list_filter(w, lambda x: x.s < 0.75)) ELSE e END AS cand
      FROM (SELECT o.kind, o.entity, o.head, o.order_id, o.size, o.rn, p.n + 1 AS n, list_filter(list_append(p.w, {{'t': o.ts, 's': o.s}}), lambda x: x.t >= o.ts - {age} * 86400)[-o.size:] AS w, 0.2 * o.s + 0.8 * p.e AS e, p.b, p.thr
        FROM steps p JOIN obs o ON o.kind = p.kind AND o.entity = p.entity AND o.head = p.head AND o.rn = p.rn + 1))))"""

_Z = "CASE WHEN len({0}) >= 4 THEN 0.6745 * (x - list_aggregate({0}, 'median')) / greatest(list_aggregate(list_transform({0}, lambda v: abs(v - list_aggregate({0}, 'median'))), 'median'), 0.001) END"

HISTORY = f"""
v_hist AS (
  SELECT -(order_id * 100 + j) AS order_id, driver_id, CASE WHEN prof = 1 THEN user_id ELSE user_id + 1 END AS user_id, cancel_ts - CASE WHEN prof = 4 THEN 8000 ELSE 600 * (j % 11 + 1) END AS ts,
    CASE WHEN j < nc THEN 'cancel' WHEN j < nc + na THEN 'accept' ELSE 'complete' END AS kind, prof = 2 AS cause
  FROM (SELECT *, unnest(range(nc + na + nk)) AS j FROM (SELECT *, order_id % 11 AS prof, coalesce([0, 5, 4, 2, 1][order_id % 11 + 1], 0) AS nc, coalesce([0, 5, 6, 8][order_id % 11 + 1], 0) AS na, coalesce([0, 0, 1, 8][order_id % 11 + 1], 0) AS nk FROM v_orders))),
hs AS (SELECT o.order_id, count(h.ts) FILTER (kind = 'accept') AS a, count(h.ts) FILTER (kind = 'cancel') AS c, count(h.ts) FILTER (kind = 'complete') AS k, count(h.ts) FILTER (kind = 'cancel' AND cause) AS wc,
         count(h.ts) FILTER (kind = 'cancel' AND h.user_id = o.user_id) AS pair FROM v_orders o LEFT JOIN v_hist h ON h.driver_id = o.driver_id AND h.ts BETWEEN o.cancel_ts - 7200 AND o.cancel_ts GROUP BY 1),
hm AS (SELECT *, c / 2.0::DOUBLE AS rate, c / greatest(a, 1) AS acr, k / greatest(k + c, 1) AS cr, greatest(CASE WHEN o.n_reassign = 3 THEN 3 ELSE 1 END, c + 1) AS chain,
         a >= 5 AND c / greatest(a, 1) >= 0.45 AS m1, k + c >= 5 AND k / greatest(k + c, 1) <= 0.40 AS m2, c >= 5 AND wc / greatest(c, 1) <= 0.35 AND c / greatest(a, 1) >= 0.45 * 0.8 AS m3 FROM hs JOIN (SELECT order_id, n_reassign FROM v_orders) o USING (order_id)),
dv0 AS (SELECT order_id, device_id, cancel_ts, order_id % 17 = 0 AS spoof, order_id % 19 = 0 AS rooted, greatest(CASE WHEN order_id % 10 < 3 THEN order_id % 100 / 100.0 ELSE 0 END, CASE WHEN order_id % 17 = 0 THEN 0.85 ELSE 0 END, CASE WHEN order_id % 19 = 0 THEN 0.55 ELSE 0 END)::DOUBLE AS x,
          order_id % 10 < 3 OR order_id % 17 = 0 OR order_id % 19 = 0 AS told FROM v_orders),
dv1 AS (SELECT *, bool_or(told) OVER (PARTITION BY device_id ORDER BY cancel_ts, order_id ROWS UNBOUNDED PRECEDING) AS begun FROM dv0),
dv AS (SELECT *, greatest(x, CASE WHEN begun THEN list_reduce(h, lambda p, y: 0.4 * y + 0.6 * p) ELSE 0 END) AS risk FROM (SELECT *, list(x) FILTER (begun) OVER (PARTITION BY device_id ORDER BY cancel_ts, order_id ROWS UNBOUNDED PRECEDING) AS h FROM dv1)),
ed AS (SELECT device_id, kind, entity, count(*) AS n, max(ts) AS last FROM (SELECT device_id, 'driver' AS kind, driver_id AS entity, cancel_ts AS ts FROM v_orders UNION ALL SELECT device_id, 'user', user_id, assign_ts FROM v_orders WHERE order_id % 3 = 0) WHERE ts <= 801964800 GROUP BY 1, 2, 3 HAVING max(ts) >= 801964800 - 365 * 86400),
gd AS (SELECT device_id, count(*) FILTER (kind = 'driver') AS drivers, count(*) FILTER (kind = 'user') AS users, sum(n) AS seen FROM ed GROUP BY 1),
gv AS (SELECT entity, count(*) AS devices, sum(n) AS seen FROM ed WHERE kind = 'driver' GROUP BY 1),
gs AS (SELECT o.order_id, e.entity IS NOT NULL AND gd.seen >= 3 AND drivers >= 3 AS g1, e.entity IS NOT NULL AND gd.seen >= 3 AND users >= 3 AS g2, e.entity IS NOT NULL AND gv.seen >= 3 AND devices >= 4 AS g3, e.entity IS NOT NULL AND u.entity IS NOT NULL AS g4
       FROM v_orders o LEFT JOIN ed e ON e.device_id = o.device_id AND e.kind = 'driver' AND e.entity = o.driver_id LEFT JOIN gd ON gd.device_id = o.device_id LEFT JOIN gv ON gv.entity = o.driver_id LEFT JOIN ed u ON u.device_id = o.device_id AND u.kind = 'user' AND u.entity = o.user_id),
ch AS (SELECT order_id, driver_id, cancel_ts AS ts, order_id % 31 = 0 AS forced, order_id % 29 = 0 AS cash, order_id % 23 = 0 AS persuasion FROM v_orders WHERE order_id % 23 = 0 OR order_id % 29 = 0 OR order_id % 31 = 0
       UNION ALL SELECT -(order_id * 10 + j), driver_id, cancel_ts - j * 86400, true, false, false FROM v_orders, range(1, 4) t(j) WHERE order_id % 37 = 0),
cr AS (SELECT *, greatest(CASE WHEN forced THEN 0.9 ELSE 0 END, CASE WHEN cash THEN 0.85 ELSE 0 END, CASE WHEN persuasion THEN 0.7 ELSE 0 END)::DOUBLE AS risk FROM ch),
cs AS (SELECT o.order_id, coalesce(any_value(m.risk), 0) AS risk, coalesce(any_value(m.forced), false) AS forced, coalesce(any_value(m.cash), false) AS cash, coalesce(any_value(m.persuasion), false) AS persuasion, count(d.ts) AS repeats
       FROM v_orders o LEFT JOIN cr m ON m.order_id = o.order_id LEFT JOIN cr d ON d.driver_id = o.driver_id AND d.ts BETWEEN o.cancel_ts - 604800 AND o.cancel_ts AND d.order_id <> o.order_id AND d.risk >= 0.55 GROUP BY 1)"""

HEADS = f"""
rep AS (SELECT w.order_id, replaced, (coalesce(last_confidence >= 0.75, false) OR dwell_drop) AS reached, CASE WHEN replaced THEN (w.order_id % 300)::DOUBLE END AS delay,
          CASE WHEN replaced THEN (SELECT count(*) FROM v_stops s WHERE s.order_id = w.order_id AND EXISTS (SELECT 1 FROM (SELECT unnest(w.rks) AS k) r WHERE {distance("s.slat", "s.slon", "(14.55::DOUBLE + (r.k / 19.0::DOUBLE) * (14.65::DOUBLE - 14.55::DOUBLE))", "(121.02::DOUBLE + (r.k / 19.0::DOUBLE) * (121.08::DOUBLE - 121.02::DOUBLE))")} <= 150)) / len(w.ks) END AS similarity
        FROM win w LEFT JOIN stopc USING (order_id) JOIN dwf USING (order_id)),
repv AS (SELECT *, replaced AND (NOT reached OR delay <= 180 OR similarity >= 0.7) AS valid FROM rep),
feat AS (
  SELECT w.*, p.point_count, p.max_gap_minutes, p.min_pts, p.point_count < 20 OR p.max_gap_minutes > 45 AS gps_sparse, g.cancel_stage, g.d AS drop_m, s.drop_before, r.valid, i.max_jump_m, i.max_speed_mps, q.measured, q.wrong, q.crooked, q.heading_ok, q.away_fraction, q.progress_ratio,
    g.cancel_stage IN ('at_merchant', 'en_route', 'near_dropoff') AND NOT s.drop_before AS after_pickup, coalesce(g.d <= 400, false) AS near_dest,
    q.measured AND q.progress_ratio < 0.15 AND coalesce(q.d0 > 200, false) AS no_progress, s.sequence_score, s.sequence_reason,
    least(1.0, greatest(0.0, coalesce(c.stop_confidence, 0) * CASE WHEN i.max_jump_m >= 2000 OR i.max_speed_mps >= 55 THEN 0.5 ELSE 1.0 END)) * CASE WHEN dv.spoof THEN greatest(0.0, 1 - 0.5 * dv.risk) ELSE 1.0 END AS stop_confidence, f.dwell_fraction,
    hm.c AS cancels, hm.rate, hm.acr, hm.cr, hm.a AS accepts, hm.chain, hm.pair, m1, m2, m3, dv.risk AS device_risk, dv.spoof, dv.rooted, dv.risk >= 0.7 AS device_fires, g1, g2, g3, g4, cs.risk AS chat_risk, cs.forced, cs.cash, cs.persuasion, cs.repeats
  FROM win w JOIN pres p USING (order_id) JOIN stg g USING (order_id) JOIN seqr s USING (order_id) JOIN prog q USING (order_id) JOIN integ i USING (order_id) JOIN repv r USING (order_id) JOIN dwf f USING (order_id) LEFT JOIN stopc c USING (order_id)
    JOIN hm USING (order_id) JOIN dv USING (order_id) JOIN gs USING (order_id) JOIN cs USING (order_id)),
fc AS (SELECT *, CASE WHEN chat_risk >= 0.55 THEN 0.4 * chat_risk + CASE WHEN no_progress OR wrong THEN 0.15 ELSE 0 END ELSE 0 END + CASE WHEN repeats >= 3 THEN 0.2 ELSE 0 END AS chat_bonus FROM feat),
fa AS (
  SELECT *, least(1.0, CASE WHEN var = 5 THEN 0.5 ELSE 0 END + CASE WHEN n_reassign + 1 >= 3 THEN 0.25 ELSE 0 END + CASE WHEN chain >= 3 THEN 0.25 ELSE 0 END + CASE WHEN near_dest THEN 0.25 ELSE 0 END + CASE WHEN after_pickup THEN 0.2 ELSE 0 END + CASE WHEN no_progress THEN 0.2 ELSE 0 END
      + CASE WHEN wrong THEN 0.25 ELSE 0 END + CASE WHEN cancels >= 4 AND rate >= 2 THEN 0.15 ELSE 0 END + CASE WHEN m1 THEN 0.25 ELSE 0 END + CASE WHEN m2 THEN 0.2 ELSE 0 END + CASE WHEN m3 THEN 0.2 ELSE 0 END + CASE WHEN pair >= 3 THEN 0.2 ELSE 0 END
      + CASE WHEN device_fires THEN 0.35 * device_risk ELSE 0 END + CASE WHEN g1 THEN 0.25 ELSE 0 END + CASE WHEN g2 THEN 0.2 ELSE 0 END + CASE WHEN g3 THEN 0.2 ELSE 0 END + CASE WHEN g4 THEN 0.25 ELSE 0 END + chat_bonus)::DOUBLE AS abuse_plain,
    list_filter([CASE WHEN var = 5 THEN 'order_still_active_after_driver_cancel' END, CASE WHEN n_reassign + 1 >= 3 THEN 'multi_cancel_pattern' END, CASE WHEN chain >= 3 THEN 'driver_chain_pattern' END, CASE WHEN near_dest THEN 'cancel_near_destination' END, CASE WHEN after_pickup THEN 'cancel_after_pickup' END,
      CASE WHEN no_progress THEN 'no_progress_to_pickup' END, CASE WHEN wrong THEN 'wrong_direction' END, CASE WHEN cancels >= 4 AND rate >= 2 THEN 'high_cancel_rate' END, CASE WHEN m1 THEN 'high_accept_cancel_rate' END, CASE WHEN m2 THEN 'low_completion_rate' END, CASE WHEN m3 THEN 'cancel_without_cause_heavy' END,
      CASE WHEN pair >= 3 THEN 'pair_cancel_density' END, CASE WHEN device_fires THEN 'device_integrity' END, CASE WHEN device_fires AND spoof THEN 'device_spoof_suspected' END, CASE WHEN device_fires AND rooted THEN 'device_rooted' END, CASE WHEN g1 THEN 'multi_account_device' END, CASE WHEN g2 THEN 'multi_user_device' END,
      CASE WHEN g3 THEN 'device_hopping' END, CASE WHEN g4 THEN 'shared_device_pair' END, CASE WHEN chat_risk >= 0.55 THEN 'chat_force_cancel' END, CASE WHEN chat_risk >= 0.55 AND forced THEN 'chat_rider_forced_cancel' END, CASE WHEN chat_risk >= 0.55 AND cash THEN 'chat_cash_offline_suggested' END,
      CASE WHEN chat_risk >= 0.55 AND persuasion THEN 'chat_persuasion_suspected' END, CASE WHEN chat_risk >= 0.55 AND (no_progress OR wrong) THEN 'force_cancel_with_stall' END, CASE WHEN repeats >= 3 THEN 'repeat_force_cancel' END], lambda z: z IS NOT NULL) AS abuse_because,
    least(1.0, CASE WHEN category = 'FOOD' THEN 0.34 ELSE 0 END + CASE WHEN order_value >= 500 THEN 0.33 ELSE 0 END + CASE WHEN alone THEN 0.33 ELSE 0 END + CASE WHEN category = 'FOOD' AND after_pickup THEN 0.2 ELSE 0 END
      + CASE WHEN cancel_stage = 'near_dropoff' AND alone THEN 0.15 ELSE 0 END)::DOUBLE AS theft_score, (stop_confidence + 1.5 * sequence_score + dwell_fraction) / 3.5 AS b FROM fc),
an AS (SELECT order_id, 0 AS f, abuse_plain AS x, driver_id AS entity, city AS cohort, cancel_ts AS ts FROM fa UNION ALL SELECT order_id, 1, rate, driver_id, city, cancel_ts FROM fa UNION ALL SELECT order_id, 2, acr, driver_id, city, cancel_ts FROM fa WHERE accepts >= 1),
aw AS (SELECT *, (list(x) OVER (PARTITION BY f, entity ORDER BY ts, order_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))[-6:] AS own, list({{'e': entity, 'x': x}}) OVER (PARTITION BY f, cohort ORDER BY ts, order_id ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS peer FROM an),
az AS (SELECT order_id, f, {_Z.format("own")} AS zs, {_Z.format("peers")} AS zp FROM (SELECT *, list_transform(list_filter(peer, lambda r: r.e <> entity), lambda r: r.x)[-40:] AS peers FROM aw)),
asg AS (SELECT order_id, list(z ORDER BY f, k) FILTER (z IS NOT NULL) AS zz, max(top) AS top FROM (SELECT order_id, f, 0 AS k, CASE WHEN zs >= 3 THEN 'anomaly_self' END AS z, greatest(zs, zp) AS top FROM az UNION ALL SELECT order_id, f, 1, CASE WHEN zp >= 3 THEN 'anomaly_peer' END, NULL FROM az) GROUP BY 1),
fs AS (SELECT fa.*, coalesce(CASE WHEN zz[1] IS NULL THEN [] WHEN len(list_distinct(zz)) = 2 THEN [zz[1], CASE zz[1] WHEN 'anomaly_self' THEN 'anomaly_peer' ELSE 'anomaly_self' END] ELSE [zz[1]] END, []) AS odd, top, CASE WHEN zz[1] IS NOT NULL THEN least(1.0, abuse_plain + 0.15) ELSE abuse_plain END AS abuse_score FROM fa LEFT JOIN asg USING (order_id)),
hd0 AS (
  SELECT *, CASE WHEN NOT replaced THEN greatest(b, 0.5 * b + 0.35) WHEN NOT valid THEN least(1.0, b + 0.15) ELSE b END AS r_offline,
    least(1.0, abuse_score + CASE WHEN replaced AND NOT valid AND abuse_score >= 0.5 THEN 0.1 ELSE 0 END) AS r_abuse, theft_score AS r_theft FROM fs),
raws AS (SELECT order_id, driver_id, user_id, cancel_ts AS ts, 'cancelled_offline' AS head, r_offline AS s FROM hd0 UNION ALL SELECT order_id, driver_id, user_id, cancel_ts, 'cancel_abuse', r_abuse FROM hd0 UNION ALL SELECT order_id, driver_id, user_id, cancel_ts, 'selective_theft', r_theft FROM hd0)"""

MONEY = """
bact AS (SELECT order_id, head, list(kind ORDER BY k) AS kinds, arg_min(b, k) AS base, arg_min(thr, k) AS armed FROM (SELECT *, CASE kind WHEN 'pair' THEN 0 WHEN 'driver' THEN 1 ELSE 2 END AS k FROM steps WHERE active) GROUP BY 1, 2),
bel AS (SELECT r.order_id, r.head, r.s, a.kinds, coalesce(r.s > base + 0.02 AND r.s < armed, false) AS band, CASE r.head WHEN 'cancelled_offline' THEN 0 WHEN 'cancel_abuse' THEN 1 ELSE 2 END AS k FROM raws r LEFT JOIN bact a USING (order_id, head)),
bdo AS (SELECT order_id, max(CASE WHEN k = 0 THEN CASE WHEN band THEN s * 0.85 ELSE s END END) AS s_offline, max(CASE WHEN k = 1 THEN CASE WHEN band THEN s * 0.9 ELSE s END END) AS s_abuse, max(CASE WHEN k = 2 THEN s END) AS s_theft,
          flatten(list(list_transform(kinds, lambda x: CASE WHEN k = 2 THEN 'baseline_shadow:' ELSE 'baseline_discount:' END || x) ORDER BY k) FILTER (band)) AS why FROM bel GROUP BY 1),
hd AS (SELECT h.*, s_offline, s_abuse, s_theft, coalesce(list_transform(list_filter(list_zip(why, range(len(why))), lambda z: list_position(why, z[1]) = z[2] + 1), lambda z: z[1]), []) AS base_why FROM hd0 h JOIN bdo USING (order_id)),
money AS (
  SELECT *, order_value * s_offline AS e_offline, order_value * s_abuse * 0.4 AS e_abuse, order_value * s_theft * 0.8 AS e_theft, (s_offline >= 0.75)::INT AS f_offline, (s_abuse >= 0.75)::INT AS f_abuse, (s_theft >= 0.75)::INT AS f_theft FROM hd),
final AS (
  SELECT *, e_offline + e_abuse + e_theft AS ear_total, e_offline + 0.7 * e_abuse + 1.2 * e_theft AS attention,
    list_filter([CASE WHEN category = 'FOOD' THEN 'food_category' END, CASE WHEN order_value >= 500 THEN 'high_value' END, CASE WHEN alone THEN 'next_driver_no_order' END, CASE WHEN category = 'FOOD' AND after_pickup THEN 'cancel_after_pickup' END, CASE WHEN cancel_stage = 'near_dropoff' AND alone THEN 'near_dropoff_no_order' END], lambda z: z IS NOT NULL) AS theft_because FROM money),
routed AS (
  SELECT *, CASE WHEN f_offline + f_abuse + f_theft = 0 AND attention < 50 THEN 'skip' WHEN attention >= 200 OR (f_offline + f_abuse + f_theft > 0 AND attention >= 50) THEN 'P1' ELSE 'P2' END AS priority,
    CASE WHEN f_theft = 1 THEN 'theft' WHEN f_offline = 1 THEN 'offline' WHEN f_abuse = 1 THEN 'abuse' ELSE 'low_signal' END AS queue,
    list_concat(abuse_because, odd, theft_because, list_filter([CASE WHEN NOT replaced THEN 'no_replacement' WHEN NOT valid THEN 'invalid_replacement' END, sequence_reason, CASE WHEN max_jump_m >= 2000 THEN 'gps_teleport' END, CASE WHEN max_speed_mps >= 55 THEN 'gps_impossible_speed' END,
      CASE WHEN wrong THEN 'wrong_direction' END, CASE WHEN crooked THEN 'heading_misaligned' END, CASE WHEN measured AND NOT heading_ok THEN 'heading_unavailable' END, CASE WHEN no_progress THEN 'no_progress_to_pickup' END, 'stage:' || cancel_stage,
      CASE WHEN gps_sparse THEN 'gps_sparse' END, CASE WHEN max_gap_minutes > 45 THEN 'gps_gaps' END], lambda z: z IS NOT NULL), base_why) AS reasons FROM final)"""

EVIDENCE_SQL = """, cand AS (
  SELECT order_id, 0 AS i, 'cancel_stage' AS feature, 'cancel_abuse' AS head, CASE WHEN cancel_stage = 'unknown' THEN 0.05 ELSE 0.2 END::DOUBLE AS weight, NULL::DOUBLE AS number FROM routed
  UNION ALL SELECT order_id, 1, 'final_stop_confidence', 'cancelled_offline', stop_confidence, stop_confidence FROM routed
  UNION ALL SELECT order_id, 2, 'driver_chain_count', 'cancel_abuse', least(1.0, chain / 5.0), chain FROM routed
  UNION ALL SELECT order_id, 3, 'pair_cancel_count', 'cancel_abuse', least(1.0, pair / 5.0), pair FROM routed
  UNION ALL SELECT order_id, 4, 'entity_cancel_rate', 'cancel_abuse', least(1.0, rate / 4.0), rate FROM routed
  UNION ALL SELECT order_id, 5, 'accept_cancel_rate', 'cancel_abuse', acr, acr FROM routed
  UNION ALL SELECT order_id, 6, 'completion_rate', 'cancel_abuse', greatest(0.0, 1 - cr), cr FROM routed
  UNION ALL SELECT order_id, 7, 'device_integrity', 'cancel_abuse', device_risk, device_risk FROM routed WHERE device_fires
  UNION ALL SELECT order_id, 8, 'device_graph', 'cancel_abuse', least(1.0, 0.25 * (g1::INT + g2::INT + g3::INT + g4::INT)), g1::INT + g2::INT + g3::INT + g4::INT FROM routed WHERE g1 OR g2 OR g3 OR g4
  UNION ALL SELECT order_id, 9, 'chat_force_cancel', 'cancel_abuse', chat_risk, chat_risk FROM routed WHERE chat_bonus > 0
  UNION ALL SELECT order_id, 10, 'entity_anomaly', 'cancel_abuse', least(1.0, top / 6.0), top FROM routed WHERE len(odd) > 0
  UNION ALL SELECT order_id, 11, 'wrong_direction', 'cancel_abuse', 0.8, away_fraction FROM routed WHERE wrong
  UNION ALL SELECT order_id, 12, 'no_progress_to_pickup', 'cancel_abuse', 0.7, progress_ratio FROM routed WHERE no_progress
  UNION ALL SELECT order_id, 13, 'gps_integrity', 'cancelled_offline', 0.6, max_jump_m FROM routed WHERE max_jump_m >= 2000 OR max_speed_mps >= 55
  UNION ALL SELECT order_id, 14, 'stop_presence', 'cancelled_offline', 0.35, min_pts FROM routed
  UNION ALL SELECT order_id, 100 + unnest(range(len(list_concat(abuse_because, odd)))), unnest(list_concat(abuse_because, odd)), 'cancel_abuse', 0.5, NULL FROM routed
  UNION ALL SELECT order_id, 200 + unnest(range(len(theft_because))), unnest(theft_because), 'selective_theft', 0.5, NULL FROM routed
  UNION ALL SELECT order_id, 300, 'dropoff_dist_m', 'cancel_abuse', 0.3, drop_m FROM routed WHERE drop_m IS NOT NULL),
uniq AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY round(weight, 9) DESC, i) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY order_id, feature ORDER BY round(weight, 9) DESC, i) AS k FROM cand) WHERE k = 1)
SELECT order_id, CAST(place AS INTEGER) AS place, feature, head, round(weight, 6) AS weight FROM uniq WHERE place < 8"""


def on_views(sql: str, recursive: bool = False) -> str:
    head = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}"
    return f"{head}\n{sql}" if sql.lstrip().upper().startswith("SELECT") else f"{head},\n{sql}"


def on_tracks(sql: str) -> str:
    return f"WITH {VIEWS},{TRACKS}{_tail(sql)}"


def _tail(sql: str) -> str:
    """A statement, or more views and a statement."""
    start = sql.lstrip()
    return f"\n{sql}" if start.upper().startswith("SELECT") or start.startswith(",") else f",\n{sql}"


#: Baselines of every order's driver, user and pair, in the policy of whole assessments.
_OWN = "SELECT 'driver' AS kind, 'driver:' || driver_id AS entity, head, ts, order_id, s FROM raws UNION ALL SELECT 'user', 'user:' || user_id, head, ts, order_id, s FROM raws UNION ALL SELECT 'pair', 'pair:' || driver_id || ':' || user_id, head, ts, order_id, s FROM raws"


def on_heads(sql: str) -> str:
    base = BASELINES.format(source=_OWN, wide=4, pair=2, age=4000, samples=4, under=0.7, above=0.5, eps=0.02)
    return f"WITH RECURSIVE {VIEWS},{TRACKS},{DWELLS},{HISTORY},{HEADS},{base},{MONEY}{_tail(sql)}"


def rates(a: str, c: str, k: str, w: str) -> str:
    return (
        f"round({c} / greatest({a}, 1), 6) AS accept_cancel_rate, round({k} / greatest({k} + {c}, 1), 6) AS completion_rate, "
        f"round(CASE WHEN {c} = 0 THEN 1.0 ELSE least(greatest({w}, 0), {c}) / {c} END::DOUBLE, 6) AS with_cause_fraction"
    )


def signals(a: str, c: str, k: str, w: str) -> str:
    acr = f"({c} / greatest({a}, 1))"
    return (
        f"array_to_string(list_filter([CASE WHEN {a} >= 5 AND {acr} >= 0.45 THEN 'high_accept_cancel_rate' END, "
        f"CASE WHEN {k} + {c} >= 5 AND {k} / greatest({k} + {c}, 1) <= 0.40 THEN 'low_completion_rate' END, "
        f"CASE WHEN {c} >= 5 AND least({w}, {c}) / {c} <= 0.35 AND {acr} >= 0.45 * 0.8 THEN 'cancel_without_cause_heavy' END], lambda x: x IS NOT NULL), ',') AS signals"
    )
