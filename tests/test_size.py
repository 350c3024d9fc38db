"""What only larger tables show: ties of rounding and of limits, tracks of many pings, keys with many rows."""

import random

import duckdb
import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracklens.functions.policy import DEFAULTS
from tracklens.operators import history, measures, search, tracks
from tracklens.plans import registry
from tracklens.streaming import states


def twin(name, **tables):
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"create view {t} as select * from '{path}/*.parquet'")
    r = c.sql(registry.ORACLE[name])
    return sorted(tuple(x) for x in r.fetchall())


def test_funnel_at_its_limits(spark, tmp_path):
    """9 cancels on 25 accepts are 0.36, four fifths of 0.45; 323 on 640 lie halfway between two numbers of six decimals."""
    counts = [(1, "signup", 25), (1, "error", 9), (2, "signup", 640), (2, "error", 323), (3, "signup", 20), (3, "error", 9)]
    e = spark.createDataFrame(counts, "user_id bigint, event_type string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    e = e.select((F.col("user_id") * 1000 + F.col("i") + F.when(F.col("event_type") == "error", 500_000).otherwise(0)).alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("i")).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    df = registry.QUERIES["marketplace_funnel"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got == twin("marketplace_funnel", events=tmp_path / "events.parquet")
    assert "cancel_without_cause_heavy" in got[0][-1] and got[1][5] == 0.504687


class Held:
    """A state variable in memory."""

    def __init__(self):
        self.value, self.puts = None, 0

    def get(self):
        return iter(self.value or []) if isinstance(self.value, list) or self.value is None and self.listed else self.value

    def update(self, value):
        self.value = value

    def put(self, values):
        self.value, self.puts = list(values), self.puts + len(values)

    def clear(self):
        self.value = None


def test_waiting_rows_of_a_key_are_few_elements():
    """10,000 rows put one by one into the list of one key were 140 s of live_devices at sf0.1, as each put looks at the list."""
    made = {}

    def state(name, listed):
        made[name] = Held()
        made[name].listed = listed
        return made[name]

    class Handle:
        getValueState = staticmethod(lambda name, schema, ttl: state(name, False))
        getListState = staticmethod(lambda name, schema, ttl: state(name, True))

    p = states.Ordered(states.Average(0.5), ["k"], late=1_000_000, days=1)
    p.init(Handle)
    rows = [Row(k="a", ts=t, id=t, x=float(t % 7)) for t in range(25_000)]
    list(p.handleInputRows(("a",), iter(rows[::2]), None))
    out = list(p.handleInputRows(("a",), iter(rows[1::2]), None))
    want = None
    for r in rows:
        want = r.x if want is None else 0.5 * r.x + 0.5 * want
    assert [(r.newest, r.n, r.dropped) for r in out] == [(24_999, 25_000, 0)] and out[0].value == want
    assert made["waiting"].puts <= 10


def test_measures_are_what_the_expressions_say(spark, monkeypatch):
    """Tracks of 0 to 200 pings, some without speed or heading, at few places or many, in short and long windows, against the expressions ping by ping."""
    rng = random.Random(4)
    start = 1_704_103_200
    pings, orders = [], []
    for k in range(90):
        n = rng.choice([0, 1, 2, 3, 7, 20, 40, 60, 200])
        few, at = rng.random() < 0.5, start + rng.randint(0, 200_000)
        for i in range(n):
            step = rng.randint(0, 3) * 0.00012 if few else rng.gauss(0, 0.0009)
            ts = at + rng.randint(0, 9000) if rng.random() < 0.9 else at + rng.randint(-60_000, 60_000)
            pings.append((k % 70, ts, i, 14.55 + step, 121.02 + (rng.randint(0, 2) * 0.0001 if few else rng.gauss(0, 0.0005)), rng.choice([None, 0.2, 0.5, 9.0]), rng.choice([None, 10.0, 190.0])))
        way = [(14.55, 121.02), (14.5505, 121.0204), (14.551, 121.021), (14.55, 121.02)]
        orders.append((k, k % 70, at - (400_000 if k % 13 == 0 else 0), at + rng.choice([4800, 9000]), rng.choice([way[:2], way[:1], way[:3], [way[0], way[1], way[0]]]), rng.choice(["curb", None]), f"R{k}" if k % 2 else None))
    p = spark.createDataFrame(pings, "track_id bigint, ts bigint, seq int, lat double, lon double, speed double, heading double")
    o = spark.createDataFrame(orders, "order_id bigint, track_id bigint, assign_ts bigint, cancel_ts bigint, stops array<struct<lat:double,lon:double>>, place_class string, replacement_order_id string")
    o = o.withColumns({"replacement_placed_ts": F.when(F.col("replacement_order_id").isNotNull(), F.col("cancel_ts") + 600), "replacement_stops": F.when(F.col("replacement_order_id").isNotNull(), F.col("stops"))})
    slow = tracks.resolve_window(tracks.attach(o, p, DEFAULTS), DEFAULTS)
    for step in (tracks.presence_scale, tracks.stop_confidences, tracks.dwell_fraction, tracks.visits, tracks.sequence, tracks.integrity, tracks.stage, tracks.progress, tracks.replacement):
        slow = step(slow, DEFAULTS)
    near = lambda x: round(x, 6) if isinstance(x, float) else [near(y) for y in x] if isinstance(x, list) else x
    plain = lambda df, names: {r.order_id: {c: near(r[c]) for c in names} for r in df.select("order_id", *names).collect()}
    want_df, got_df = slow.drop("track").cache(), tracks.geometry(o, p, DEFAULTS)
    assert sorted(want_df.columns) == sorted(got_df.columns)
    names = [c for c in want_df.columns if c not in ("stops", "replacement_stops")]
    want = plain(want_df, names)
    assert plain(got_df, names) == want
    monkeypatch.setattr(measures, "PINGS", 100)
    monkeypatch.setattr(measures, "PAIRS", 500)
    monkeypatch.setattr(measures, "LONG", 4)
    assert plain(tracks.geometry(o, p, DEFAULTS), names) == want
    grid = [(30, 5), (80, 15)]
    old = tracks.grid_confidences(tracks.resolve_window(tracks.attach(o, p, DEFAULTS), DEFAULTS), DEFAULTS, grid)
    key = lambda df: sorted((r.order_id, r.radius, r.points, round(r.stop_confidence, 6)) for r in df.select("order_id", "radius", "points", "stop_confidence").collect())
    assert key(search.retune_candidates(o, p, DEFAULTS, grid)) == key(old)


def test_distances_near_the_radius():
    """Pairs are told apart by squared angles, those about as far as the radius by the exact distance; across the date line and at the poles too."""
    rng = np.random.default_rng(1)
    for lat, lon, spread in ((14.55, 121.02, 1e-3), (0.0, 180.0, 1e-3), (89.9999, 10.0, 90.0), (-33.0, 5.0, 40.0)):
        p = np.radians(np.clip(lat + rng.normal(size=(3, 40)) * min(spread, 1e-3 if lat > 80 else spread), -90, 90))
        q = np.radians((lon + rng.normal(size=(3, 40)) * spread + 180) % 360 - 180)
        whole = tracks._metres(p, q)
        radii = [50.0, float(np.median(whole)), float(whole[0, 1, 2]), 0.0]
        for r, found in zip(radii, measures.close(p, q, np.cos(p), radii), strict=True):
            assert (found == (whole <= r)).all()


def test_hot_cohorts_are_many_tasks(spark, monkeypatch):
    """Stretches are dealt by key and stretch; a broadcast of their rows left all of a key, and by coalescing all keys, in one task."""
    monkeypatch.setattr(history, "STRETCH", 50)
    rng = random.Random(3)
    data = [(f"e{rng.randint(0, 9)}", "c", k // 2, rng.randint(0, 200_000), rng.random()) for k in range(600)]
    rows = spark.createDataFrame(data, "entity string, cohort string, order_id bigint, ts bigint, x double")
    placed = history.stretches(rows, "cohort", 5)
    assert placed.count() > 600
    placed.collect()
    assert "BroadcastHashJoin" not in placed._jdf.queryExecution().executedPlan().toString()
    got = {(r.order_id, r.ts, r.x): (r.z_self, r.z_peer) for r in history.anomalies(rows, DEFAULTS).collect()}
    a, line = DEFAULTS["anomaly"], sorted(data, key=lambda r: (r[3], r[2]))
    middle = lambda xs: (sorted(xs)[(len(xs) - 1) // 2] + sorted(xs)[len(xs) // 2]) / 2.0

    def z(x, last):
        if len(last) < a["min_support"]:
            return None
        return 0.6745 * (x - middle(last)) / max(middle([abs(v - middle(last)) for v in last]), a["epsilon"])

    for i, (e, _, k, ts, x) in enumerate(line):
        own = [r[4] for r in [r for r in line[:i] if r[0] == e][-2 * a["window_n"] :] if r[2] != k][-a["window_n"] :]
        peers = [r[4] for r in line[:i][-3 * a["peer_window_n"] :] if r[2] != k and r[0] != e][-a["peer_window_n"] :]
        for have, want in zip(got[k, ts, x], (z(x, own), z(x, peers)), strict=True):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
