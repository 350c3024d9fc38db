"""GPS tracks: windows, gaps, clusters, dwells, visits, stages, progress and integrity.

A track is one array of (ts, seq, lat, lon, speed, heading) an order, sorted by (ts, seq). It is gathered by
one exchange; the window around the order bounds its length. Everything after that is expressions over the
array, without a further exchange; only the density clusters are Python. Times are whole seconds since 1970.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, bearing, between, heading_error, within
from .measures import Measure

HOUR = 3600
DAY = 86400
#: Pairs of pings whose distances are in memory at once.
PAIRS = 2_000_000


def attach(orders: DataFrame, pings: DataFrame, policy: dict[str, Any], key: str = "track_id") -> DataFrame:
    """orders with `superset`, in order of time the pings of the days that their widest window touches.

    Pings are gathered by key and pair of days, each in the pair that it begins and the one that it ends, so a driver with very
    many pings is dealt over days, and an order finds all of its pings in the pair that its window begins in: they
    come to the orders as one array, without a further exchange. Orders of longer windows ask several pairs.
    """
    low, high = _base(policy)
    half = F.lit(int(policy["gps"]["max_window_h"] * HOUR / 2))
    mid = low + F.floor((high - low) / 2)
    first, last = F.least(low, mid - half), F.greatest(high, mid + half)
    day = F.floor(F.col("ts") / DAY)
    dealt = pings.withColumn("_d", F.explode(F.array(day - 1, day)))
    packs = dealt.groupBy(key, "_d").agg(F.sort_array(F.collect_list(F.struct("ts", F.col("seq").cast("bigint").alias("seq"), "lat", "lon", "speed", "heading"))).alias("superset"))
    packs = packs.hint("merge")  # their size is guessed before the pings are, far too small
    asked = orders.withColumns({"_d": F.floor(first / DAY), "_e": F.floor(last / DAY)})
    near = F.coalesce(F.col("_e") <= F.col("_d") + 1, F.lit(True))
    none = F.array().cast("array<struct<ts:bigint,seq:bigint,lat:double,lon:double,speed:double,heading:double>>")
    short = asked.where(near).join(packs, [key, "_d"], "left")
    days = asked.where(~near).select("order_id", key, F.explode(F.sequence("_d", "_e", F.lit(2).cast("bigint"))).alias("_d"))
    track = days.join(packs, [key, "_d"]).groupBy("order_id").agg(F.sort_array(F.flatten(F.collect_list("superset"))).alias("superset"))
    out = short.unionByName(asked.where(~near).join(track, "order_id", "left"))
    return out.withColumn("superset", F.coalesce("superset", none)).select(*orders.columns, "superset")


def _base(policy: dict[str, Any]) -> tuple[Column, Column]:
    return F.least(F.col("assign_ts"), F.col("cancel_ts") - int(policy["gps"]["min_window_h"] * HOUR)), F.col("cancel_ts") + 300


def _clip(track: Column, low: Column, high: Column) -> Column:
    return F.filter(track, lambda p: p["ts"].between(low, high))


def _diffs(track: Column) -> Column:
    n = F.greatest(F.size(track) - 1, F.lit(0))
    return F.zip_with(F.slice(track, 1, n), F.slice(track, 2, n), lambda a, b: b["ts"] - a["ts"])


def max_gap_minutes(track: Column, low: Column, high: Column) -> Column:
    """Longest time without a ping between the window's bounds."""
    inner = F.coalesce(F.array_max(_diffs(track)), F.lit(0))
    edge = F.greatest(F.element_at(track, 1)["ts"] - low, high - F.element_at(track, -1)["ts"])
    return F.when(F.size(track) == 0, high - low).otherwise(F.greatest(inner, edge)) / 60.0


def resolve_window(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """window_start, window_end, expanded, track, point_count, max_gap_minutes, gps_sparse, from the superset.

    The window reaches from the assignment (or 3 hours before the cancellation) to 5 minutes after it; where
    that is sparse, half of the widest window to either side of its middle.
    """
    gps = policy["gps"]
    low, high = _base(policy)
    half = int(gps["max_window_h"] * HOUR / 2)
    df = df.withColumns({"b0": low, "b1": high}).withColumn("bt", _clip(F.col("superset"), F.col("b0"), F.col("b1")))
    sparse = lambda t, a, b: (F.size(t) < gps["min_points"]) | (max_gap_minutes(t, a, b) > gps["max_gap_minutes"])
    df = df.withColumn("expanded", sparse(F.col("bt"), F.col("b0"), F.col("b1")))
    mid = F.col("b0") + F.floor((F.col("b1") - F.col("b0")) / 2)
    df = df.withColumns({"window_start": F.when(F.col("expanded"), mid - half).otherwise(F.col("b0")), "window_end": F.when(F.col("expanded"), mid + half).otherwise(F.col("b1"))})
    df = df.withColumn("track", F.when(F.col("expanded"), _clip(F.col("superset"), F.col("window_start"), F.col("window_end"))).otherwise(F.col("bt")))
    df = df.withColumns({"point_count": F.size("track"), "max_gap_minutes": max_gap_minutes(F.col("track"), F.col("window_start"), F.col("window_end"))})
    df = df.withColumn("gps_sparse", (F.col("point_count") < gps["min_points"]) | (F.col("max_gap_minutes") > gps["max_gap_minutes"]))
    return df.drop("b0", "b1", "bt", "superset")


def usable_gaps(track: Column, policy: dict[str, Any]) -> Column:
    most = policy["gps"]["max_gap_minutes"] * 60
    return F.array_sort(F.filter(_diffs(track), lambda d: (d > 0) & (d <= most)))


def median(sorted_: Column) -> Column:
    n = F.size(sorted_)
    at = lambda i: F.get(sorted_, i.cast("int"))
    return F.when(n == 0, F.lit(None)).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)


def _factor(name: Column, factors: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in factors.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit(1.0))


def dwell_target(df: DataFrame, policy: dict[str, Any]) -> Column:
    """Seconds that a dwell lasts at df's places, by its vehicles."""
    d = policy["dwell"]
    place = _factor(F.col("place_class"), d["place_factors"]) if "place_class" in df.columns else F.lit(1.0)
    vehicle = _factor(F.col("vehicle_class"), d["vehicle_factors"]) if "vehicle_class" in df.columns else F.lit(1.0)
    return F.least(F.lit(600.0), F.greatest(F.lit(30.0), F.lit(float(d["min_dwell_seconds"])) * place * vehicle))


def presence_scale(df: DataFrame, policy: dict[str, Any], points: Column | list[int] | None = None) -> DataFrame:
    """gap_median, dwell_target_s, min_pts, drop_min_pts: how long and how dense a stop must be at this ping rate, place and vehicle. points replaces the policy's min_pts; of a list min_pts_grid has them all."""
    d, c = policy["dwell"], policy["dbscan"]
    low, high = sorted((float(d["gap_seconds_min"]), float(d["gap_seconds_max"])))
    df = df.withColumn("gaps", usable_gaps(F.col("track"), policy)).withColumn("gap_median", median(F.col("gaps")))
    df = df.withColumn("dwell_target_s", dwell_target(df, policy))
    tau = F.least(F.lit(high), F.greatest(F.lit(low), F.col("gap_median")))
    on = F.lit(bool(c["autoscale_min_pts"])) & (F.size("gaps") >= d["min_gap_samples"]) & F.col("gap_median").isNotNull()
    df = df.withColumn("scale", F.when(on, F.col("dwell_target_s") / float(d["min_dwell_seconds"]) * (float(c["autoscale_ref_gap_seconds"]) / tau)))
    scaled = lambda base, a, b: F.when(on, F.least(F.lit(b), F.greatest(F.lit(a), F.bround(F.col("scale") * base.cast("double"), 0).cast("int")))).otherwise(base.cast("int"))
    if isinstance(points, list):
        df, points = df.withColumn("min_pts_grid", F.array(*(scaled(F.lit(n), 3, 30) for n in points))), None
    least = F.lit(int(c["min_pts"])) if points is None else points
    return df.withColumns({"min_pts": scaled(least, 3, 30), "drop_min_pts": scaled(F.lit(int(c["drop_off_min_pts"])), 5, 80)}).drop("gaps", "scale")


def _density(lat: pa.Array, lon: pa.Array, k: pa.Array, eps_: pa.Array) -> pa.Array:
    """near (points within eps, itself included) and dense of every point; tracks of one length are computed together."""
    eps = eps_.to_numpy(zero_copy_only=False)
    sizes = lat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = [np.radians(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) for x in (lat, lon)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    least = k.to_numpy(zero_copy_only=False)
    near, dense = np.zeros(offsets[-1], dtype=np.int32), np.zeros(offsets[-1], dtype=bool)
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, PAIRS // (n * n))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            at = offsets[some][:, None] + np.arange(n)[None, :]
            p, q = flat[0][at], flat[1][at]
            close = _metres(p, q) <= eps[some][:, None, None]
            count = close.sum(axis=2)
            core = count >= least[some][:, None]
            near[at], dense[at] = count, (close & core[:, None, :]).any(axis=2)
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (near, dense)]
    return pa.StructArray.from_arrays(lists, names=["near", "dense"])


def clustered(df: DataFrame, eps: float | Column, track: str = "track", min_pts: str = "min_pts", out: str = "dense") -> DataFrame:
    """df with the track's points as (ts, lat, lon, near, dense): pings within eps, itself included, and whether it is
    in a density cluster, as a core (near >= min_pts) or within eps of a core.

    Distances of all pairs of a track are array arithmetic over Arrow batches: nested array functions, the
    built-in form of it, are interpreted pair by pair (55 s for 5.6 million pairs in one task).
    """
    density = F.arrow_udf(_density, "struct<near:array<int>,dense:array<boolean>>")
    eps = eps if isinstance(eps, Column) else F.lit(float(eps))
    of = lambda name: F.transform(track, lambda p: p[name])
    df = df.withColumn("_d", density(of("lat"), of("lon"), F.col(min_pts), eps))
    return df.withColumn(out, F.transform(track, lambda p, i: F.struct(p["ts"].alias("ts"), p["lat"].alias("lat"), p["lon"].alias("lon"), F.get("_d.near", i).alias("near"), F.get("_d.dense", i).alias("dense")))).drop("_d")


def stop_confidences(df: DataFrame, policy: dict[str, Any], eps: Column | None = None) -> DataFrame:
    """confidences (one a stop) and stop_confidence (their mean), from track, stops, min_pts and drop_min_pts.

    The first of the three radii (strict) with more than drop_min_pts pings decides: the share of them in a
    cluster, discounted for the wider ones. A round trip with one visit halves the last stop's.
    """
    return _confidences(clustered(df, float(policy["dbscan"]["clustering_radius_m"]) if eps is None else eps), policy)


def grid_confidences(df: DataFrame, policy: dict[str, Any], grid: list[tuple[int, int]]) -> DataFrame:
    """stop_confidences() for every candidate (radius, points) of the grid, a row each. A track's distances are computed once for all of them."""
    points = sorted({n for _, n in grid})
    df = presence_scale(df, policy, points)

    def density(lat: pa.Array, lon: pa.Array, least: pa.Array) -> pa.Array:
        sizes = lat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [np.radians(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) for x in (lat, lon)]
        k = np.array(least.to_pylist(), dtype=np.int64).reshape(len(sizes), len(points))
        ends = np.cumsum(sizes)
        out: list[np.ndarray] = []
        for i, n in enumerate(sizes.tolist()):
            p, q = (x[ends[i] - n : ends[i]] for x in flat)
            metres = _metres(p[None], q[None])[0]
            close = {r: metres <= r for r in {r for r, _ in grid}}
            near = {r: c.sum(axis=1) for r, c in close.items()}
            out += [(close[r] & (near[r] >= k[i, points.index(m)])[None, :]).any(axis=1) for r, m in grid]
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(sizes, len(grid)))]).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, bool)))
        return pa.ListArray.from_arrays(pa.array((np.arange(len(sizes) + 1) * len(grid)).astype(np.int32)), inner)

    of = lambda name: F.transform("track", lambda p: p[name])
    df = df.withColumn("_g", F.arrow_udf(density, "array<array<boolean>>")(of("lat"), of("lon"), F.col("min_pts_grid")))
    df = df.select("*", F.posexplode_outer("_g").alias("_c", "_flags")).drop("_g", "min_pts_grid")  # outer: no filter on it is pushed down
    at = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in grid)), F.col("_c") + 1)
    dense = F.transform("track", lambda p, i: F.struct(p["ts"].alias("ts"), p["lat"].alias("lat"), p["lon"].alias("lon"), F.get("_flags", i).alias("dense")))
    return _confidences(df.withColumns({"radius": at(0), "points": at(1), "dense": dense}).drop("_c", "_flags"), policy)


def _metres(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of all pairs of each row's points, in radians."""
    s, t = np.sin((p[:, :, None] - p[:, None, :]) / 2), np.sin((q[:, :, None] - q[:, None, :]) / 2)
    a = s * s + np.cos(p)[:, :, None] * np.cos(p)[:, None, :] * t * t
    return 2 * EARTH_KM * 1000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _confidences(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    c = policy["dbscan"]

    def closer(stop: Column, metres: float):
        return lambda p: between(p, stop) < metres

    def one(stop: Column) -> Column:
        out: Column = F.lit(0.0)
        for r, discount in reversed([(c["immediate_dp_radius"], 1.0), (c["standard_dp_radius"], c["standard_discount"]), (c["extended_dp_radius"], c["extended_discount"])]):
            near = F.filter(F.col("dense"), closer(stop, float(r)))
            n, inside = F.size(near), F.size(F.filter(near, lambda p: p["dense"]))
            out = F.when(n > F.col("drop_min_pts"), inside / F.greatest(n, F.lit(1)) * float(discount)).otherwise(out)
        return out

    df = df.withColumn("confidences", F.when(F.size("track") == 0, F.array().cast("array<double>")).otherwise(F.transform("stops", one)))
    first, last = F.get("stops", 0), F.element_at("stops", F.greatest(F.size("stops"), F.lit(1)))
    at_home = F.filter(F.col("track"), lambda p: between(p, first) < float(c["extended_dp_radius"]))
    visits = F.size(F.filter(_diffs(at_home), lambda d: d > c["round_trip_gap_seconds"])) + 1
    round_trip = (F.size("stops") > 1) & (first["lat"] == last["lat"]) & (first["lon"] == last["lon"])
    df = df.withColumn("visits", F.when(round_trip, visits))
    n = F.size("confidences")
    halved = F.transform("confidences", lambda x, i: F.when(i == n - 1, x / 2).otherwise(x))
    df = df.withColumn("confidences", F.when((F.col("visits") == 1) & (n > 0), halved).otherwise(F.col("confidences")))
    mean = F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    return df.withColumn("stop_confidence", F.when(n == 0, 0.0).otherwise(mean)).drop("dense")


def dwelled(track: Column, stop: Column, target: Column, policy: dict[str, Any]) -> Column:
    """Whether a run of slow pings near the stop lasts for target seconds; a ping far from the run's first one ends it."""
    d = policy["dwell"]
    empty = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(False).alias("hit"))
    state = lambda start, lat, lon, hit: F.struct(start.cast("bigint").alias("start"), lat.alias("lat"), lon.alias("lon"), hit.alias("hit"))

    def step(s: Column, p: Column) -> Column:
        near = between(p, stop) <= float(d["radius_m"])
        slow = F.coalesce(p["speed"] <= float(d["max_speed_mps"]), near)
        away = between(s, p) > float(d["max_run_displacement_m"])
        gone = state(F.lit(None), F.lit(0.0), F.lit(0.0), F.lit(False))
        return (
            F.when(s["hit"], s)
            .when(~(near & slow), gone)
            .when(s["start"].isNull(), state(p["ts"], p["lat"], p["lon"], F.lit(0.0) >= target))
            .when(away, gone)
            .otherwise(state(s["start"], s["lat"], s["lon"], (p["ts"] - s["start"]) >= target))
        )

    return F.aggregate(track, empty, step, lambda s: s["hit"])


def dwell_fraction(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """dwell (one truth value a stop) and dwell_fraction."""
    if "dwell" not in df.columns:
        df = df.withColumn("dwell", F.transform("stops", lambda s: dwelled(F.col("track"), s, F.col("dwell_target_s"), policy)))
    return df.withColumn("dwell_fraction", F.when(F.size("stops") == 0, 0.0).otherwise(F.size(F.filter("dwell", lambda x: x)) / F.greatest(F.size("stops"), F.lit(1))))


def path_match(track: Column, stops: Column, radius: float) -> Column:
    """Share of stops that pings match in order: each takes the first ping after the one before; the first that finds none ends it."""
    indexed = F.transform(track, lambda p, i: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), i.alias("i")))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"))

    def step(s: Column, stop: Column) -> Column:
        hit = F.get(F.filter(indexed, lambda p: (p["i"] > s["at"]) & within(p, stop, radius)), F.lit(0))["i"]
        # beyond the last index nothing matches any more
        return F.when(hit.isNull(), F.struct(F.lit(2**31 - 1).alias("at"), s["n"].alias("n"))).otherwise(F.struct(hit.alias("at"), (s["n"] + 1).alias("n")))

    return F.aggregate(stops, start, step, lambda s: s["n"] / F.greatest(F.size(stops), F.lit(1)))


def first_visit(track: Column, stop: Column, radius: Column | float) -> Column:
    return F.array_min(F.transform(F.filter(track, lambda p: within(p, stop, radius)), lambda p: p["ts"]))


def visits(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """visit_ts (first visit of each stop), pickup_ts, drop_ts, drop_before, both_visited, order_ok, middles, middles_hit."""
    s, q = policy["stages"], float(policy["sequence"]["stop_match_radius_m"])
    n = F.size("stops")
    radius = lambda i: F.when(i == 0, float(s["merchant_radius_m"])).when(i == n - 1, float(s["dropoff_radius_m"])).otherwise(q)
    if "visit_ts" not in df.columns:
        df = df.withColumn("visit_ts", F.transform("stops", lambda stop, i: first_visit(F.col("track"), stop, radius(i))))
    df = df.withColumns({"pickup_ts": F.get("visit_ts", 0), "drop_ts": F.when(n >= 2, F.element_at("visit_ts", F.greatest(n, F.lit(1))))})
    df = df.withColumns({"drop_before": F.coalesce(F.col("drop_ts") <= F.col("pickup_ts"), F.lit(False)), "both_visited": F.col("drop_ts").isNotNull() & F.col("pickup_ts").isNotNull()})
    seen = F.filter("visit_ts", lambda t: t.isNotNull())
    k = F.greatest(F.size(seen) - 1, F.lit(0))
    rising = F.forall(F.zip_with(F.slice(seen, 1, k), F.slice(seen, 2, k), lambda a, b: b > a), lambda x: x)
    inner = F.slice("visit_ts", 2, F.greatest(n - 2, F.lit(0)))
    inside = F.when(F.col("both_visited") & ~F.col("drop_before"), F.forall(inner, lambda t: t.isNull() | ((t > F.col("pickup_ts")) & (t < F.col("drop_ts"))))).otherwise(True)
    return df.withColumns({"order_ok": rising & inside & ~F.col("drop_before"), "middles": F.greatest(n - 2, F.lit(0)), "middles_hit": F.size(F.filter(inner, lambda t: t.isNotNull())), "stops_visited": F.size(seen)})


def sequence(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """path_score, sequence_score and sequence_reason (null if the path matched whole), from visits()."""
    q = policy["sequence"]
    if "path_score" not in df.columns:
        df = df.withColumn("path_score", path_match(F.col("track"), F.col("stops"), float(q["stop_match_radius_m"])))
    need = F.ceil(F.col("middles") * float(min(1.0, max(0.0, q["min_middle_fraction"]))))
    p, both, before = F.col("path_score"), F.col("both_visited"), F.col("drop_before")
    ladder = [
        (before, F.lit(0.0), "drop_before_pickup"),
        (~F.col("order_ok") & both, F.lit(0.0), "stop_order_violation"),
        (p >= 1 - 1e-9, p, None),
        (~both & F.col("pickup_ts").isNotNull() & F.col("drop_ts").isNull(), F.greatest(p, F.lit(0.5)), "pickup_only"),
        (~both, p, None),
        ((F.col("middles") > 0) & (F.col("middles_hit") < need), F.greatest(p, F.col("stops_visited") / F.greatest(F.size("stops"), F.lit(1)) * 0.5), "middle_stops_missing"),
    ]
    score, reason = F.lit(1.0), F.lit("pickup_drop_order")
    for when, value, why in reversed(ladder):
        score, reason = F.when(when, value).otherwise(score), F.when(when, F.lit(why)).otherwise(reason)
    return df.withColumns({"sequence_score": score, "sequence_reason": reason})


def stage(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """merchant_dist_m and dropoff_dist_m of the last ping, cancel_stage, after_pickup, near_dest."""
    s = policy["stages"]
    merchant, drop = float(s["merchant_radius_m"]), float(s["dropoff_radius_m"])
    some = (F.col("point_count") > 0) & (F.size("stops") > 0)
    if "merchant_dist_m" not in df.columns:
        last = F.element_at("track", -1)
        final = F.element_at("stops", F.greatest(F.size("stops"), F.lit(1)))
        df = df.withColumns({"merchant_dist_m": F.when(some, between(last, F.get("stops", 0))), "dropoff_dist_m": F.when(some, between(last, final))})
    m, d = F.col("merchant_dist_m"), F.col("dropoff_dist_m")
    seen = F.col("pickup_ts").isNotNull()
    df = df.withColumn(
        "cancel_stage",
        F.when(~some, "unknown")
        .when(F.col("drop_before"), F.when(m <= merchant, "at_merchant").otherwise("unknown"))
        .when(d <= drop, F.when(seen, "near_dropoff").otherwise("unknown"))
        .when(m <= merchant, "at_merchant")
        .when(seen, "en_route")
        .otherwise("pre_pickup"),
    )
    after = F.col("cancel_stage").isin("at_merchant", "en_route", "near_dropoff") & ~F.col("drop_before")
    return df.withColumns({"after_pickup": after, "near_dest": F.coalesce(d <= float(policy["abuse"]["near_dest_radius_m"]), F.lit(False))})


def progress(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """progress_ratio, toward_fraction, away_fraction, heading_available, no_progress, wrong_direction, progress_reasons toward the first stop."""
    g = policy["progress"]
    n_min = int(g["min_points"])
    if "pw_n" not in df.columns:
        target = F.get("stops", 0)
        early = F.filter("track", lambda p: p["ts"].between(F.col("assign_ts"), F.col("assign_ts") + int(g["window_minutes"] * 60)))
        df = df.withColumn("pw", F.when(F.size(early) < n_min, F.slice("track", 1, max(n_min, 5))).otherwise(early))
        df = df.withColumn("pw", F.when((F.size("track") >= n_min) & (F.size("pw") >= 2) & (F.size("stops") > 0), F.col("pw")))
        errors = F.transform(F.filter("pw", lambda p: p["heading"].isNotNull()), lambda p: heading_error(p["heading"], bearing(p["lat"], p["lon"], target["lat"], target["lon"])))
        most, back = float(g["max_heading_error_deg"]), float(g["away_heading_error_deg"])
        n = lambda f: F.size(F.filter("errors", f))
        df = df.withColumns({"d0": between(F.get("pw", 0), target), "d1": between(F.element_at("pw", F.greatest(F.size("pw"), F.lit(1))), target), "errors": errors, "pw_n": F.size("pw")})
        df = df.withColumns({"headings": F.size("errors"), "toward": n(lambda e: e <= most), "away": n(lambda e: (e >= back) & (e > most))}).drop("pw", "errors")
    closed = F.col("d0") - F.col("d1")
    df = df.withColumn("raw_progress", F.when(F.col("d0") > 1.0, closed / F.col("d0")).otherwise(F.when(closed > 0, 1.0).otherwise(0.0)))
    df = df.withColumn("heading_available", F.coalesce(F.col("headings") >= n_min, F.lit(False)))
    share = lambda n: F.when(F.col("heading_available"), F.col(n) / F.greatest("headings", F.lit(1)))
    df = df.withColumns({"toward_fraction": share("toward"), "away_fraction": share("away")})
    wrong = F.coalesce(F.col("away_fraction") >= 0.5, F.lit(False))
    crooked = F.coalesce(~wrong & (F.col("toward_fraction") < 0.4) & (F.col("raw_progress") > 0), F.lit(False))
    measured = F.coalesce(F.col("pw_n") >= 2, F.lit(False))
    ratio = F.when(wrong, F.least(F.col("raw_progress"), F.lit(0.0))).when(crooked, F.least(F.col("raw_progress"), F.col("raw_progress") * 0.25)).otherwise(F.col("raw_progress"))
    df = df.withColumns({"wrong_direction": measured & wrong, "progress_ratio": F.when(measured, ratio).otherwise(0.0)})
    df = df.withColumn("no_progress", measured & F.coalesce((F.col("progress_ratio") < float(g["no_progress_ratio"])) & (F.col("d0") > float(g["min_start_distance_m"])), F.lit(False)))
    reasons = F.array_compact(F.array(F.when(wrong, "wrong_direction"), F.when(crooked, "heading_misaligned"), F.when(measured & ~F.col("heading_available"), "heading_unavailable"), F.when(F.col("no_progress"), "no_progress_to_pickup")))
    return df.withColumn("progress_reasons", F.when(measured, reasons).otherwise(F.array().cast("array<string>"))).drop("pw_n", "d0", "d1", "headings", "toward", "away")


def integrity(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """max_jump_m, max_speed_mps between following pings, teleport, speed_spike, gps_multiplier, and stop_confidence dampened by it."""
    g = policy["gps_integrity"]
    if "max_jump_m" not in df.columns:
        n = F.greatest(F.size("track") - 1, F.lit(0))
        hops = F.zip_with(F.slice("track", 1, n), F.slice("track", 2, n), lambda a, b: F.struct(between(a, b).alias("m"), (b["ts"] - a["ts"]).alias("s")))
        df = df.withColumn("hops", F.filter(hops, lambda h: h["s"] > 0.5))
        df = df.withColumns({"max_jump_m": F.coalesce(F.array_max(F.transform("hops", lambda h: h["m"])), F.lit(0.0)), "max_speed_mps": F.coalesce(F.array_max(F.transform("hops", lambda h: h["m"] / h["s"])), F.lit(0.0))})
    df = df.withColumns({"teleport": F.col("max_jump_m") >= float(g["teleport_jump_m"]), "speed_spike": F.col("max_speed_mps") >= float(g["max_speed_mps"])})
    df = df.withColumn("gps_multiplier", F.when(F.col("teleport") | F.col("speed_spike"), float(g["stop_confidence_dampen"])).otherwise(1.0))
    if "stop_confidence" in df.columns:
        df = df.withColumn("stop_confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("stop_confidence") * F.col("gps_multiplier"))))
    return df.drop("hops")


def route_similarity(stops: Column, others: Column, radius: float) -> Column:
    """Share of stops that have any of the others within radius; 0 if either has none."""
    hit = F.size(F.filter(stops, lambda s: F.exists(others, lambda o: within(s, o, radius))))
    return F.when((F.size(stops) > 0) & (F.size(others) > 0), hit / F.greatest(F.size(stops), F.lit(1))).otherwise(0.0)


def replacement(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """replacement_valid, paths_passed and replacement_reasons, from replacement_{order_id,placed_ts,stops}, the last stop's confidence before dampening, and its dwell."""
    r = policy["replacement"]
    n = F.size("confidences")
    reached = F.coalesce(F.when(n > 0, F.element_at("confidences", F.greatest(n, F.lit(1)))) >= float(policy["dbscan"]["confidence_threshold"]), F.lit(False)) | F.coalesce(F.when(F.size("dwell") > 0, F.element_at("dwell", F.greatest(F.size("dwell"), F.lit(1)))), F.lit(False))
    has = F.col("replacement_order_id").isNotNull()
    delay = (F.col("replacement_placed_ts") - F.col("cancel_ts")) / 60.0
    similar = F.when(F.col("replacement_stops").isNotNull(), route_similarity(F.col("stops"), F.col("replacement_stops"), float(policy["sequence"]["stop_match_radius_m"])))
    why = F.array_compact(F.array(F.when(~reached, "gps"), F.when(delay <= float(r["max_place_delay_minutes"]), "timing"), F.when(similar >= float(r["route_similarity_min"]), "route")))
    valid = F.size(why) > 0
    return df.withColumns({"reached_destination": reached, "replacement_delay_min": delay, "route_similarity": similar, "replacement_valid": has & valid, "paths_passed": F.when(has, why), "replacement_reasons": F.when(~has, F.array(F.lit("no_replacement"))).when(valid, F.array().cast("array<string>")).otherwise(F.array(F.lit("invalid_replacement")))})


def measured(orders: DataFrame, pings: DataFrame, policy: dict[str, Any], parts: tuple[str, ...], key: str = "track_id", grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """orders with their window, point_count, max_gap_minutes, gps_sparse, gap_median, dwell_target_s, min_pts and drop_min_pts, and what `parts` name
    (see measures.Measure), by array arithmetic over batches of tracks; the functions above say the same ping by ping, of a track that is kept."""
    df = attach(orders, pings, policy, key)
    low, high = _base(policy)
    df = df.withColumns({"_b0": low, "_b1": high, "dwell_target_s": dwell_target(df, policy)})
    m = Measure(policy, parts, grid)
    stops = F.coalesce("stops", F.array().cast(df.schema["stops"].dataType))
    found = F.arrow_udf(m.__call__, m.schema())(F.col("superset"), stops, F.col("_b0").cast("bigint"), F.col("_b1").cast("bigint"), F.col("dwell_target_s"), F.col("assign_ts").cast("bigint"))
    df = df.withColumn("_m", found).select(*orders.columns, "dwell_target_s", "_b0", "_b1", "_m.*")
    mid, half = F.col("_b0") + F.floor((F.col("_b1") - F.col("_b0")) / 2), int(policy["gps"]["max_window_h"] * HOUR / 2)
    return df.withColumns({"window_start": F.when(F.col("expanded"), mid - half).otherwise(F.col("_b0")), "window_end": F.when(F.col("expanded"), mid + half).otherwise(F.col("_b1"))}).drop("_b0", "_b1")


def geometry(orders: DataFrame, pings: DataFrame, policy: dict[str, Any], key: str = "track_id") -> DataFrame:
    """All of the above for every order."""
    df = measured(orders, pings, policy, ("stops", "walk"), key)
    for step in (dwell_fraction, visits, sequence, integrity, stage, progress):
        df = step(df, policy)
    return replacement(df, policy) if "replacement_order_id" in df.columns else df
