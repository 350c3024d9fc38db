"""What tracks.py says of a track, measured over Arrow batches: one pass of array arithmetic over all pings of many orders.

The built-in form of it, nested array functions, is interpreted ping by ping. Pings of an order lie one after the other in flat
arrays, `off` has where an order's begin; a lane is a stop of an order, and a pair is a lane's ping. Orders are
taken in slices of at most PINGS pings, so memory doesn't grow with a batch's tracks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa

from ..functions.geo import EARTH_KM

#: Pings of the orders that are measured at once, pairs of pings whose distances are in memory at once, and from how many pings on equal places of a track are taken together.
PINGS, PAIRS, LONG = 300_000, 200_000, 48

WINDOW = "expanded boolean, point_count int, max_gap_minutes double, gps_sparse boolean, gap_median double, min_pts int, drop_min_pts int"
CLUSTERS = "clustered bigint, cores bigint"
STOPS = "confidences array<double>, visits int, stop_confidence double"
WALK = "dwell array<boolean>, visit_ts array<bigint>, path_score double, merchant_dist_m double, dropoff_dist_m double, max_jump_m double, max_speed_mps double, pw_n int, d0 double, d1 double, headings int, toward int, away int"
GRID = "grid array<double>"


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of what holds in each segment."""
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def reduced(ufunc: Any, x: np.ndarray, off: np.ndarray, empty: Any) -> np.ndarray:
    out = np.full(len(off) - 1, empty, dtype=np.result_type(x.dtype, np.asarray(empty).dtype))
    some = off[1:] > off[:-1]
    if some.any():
        out[some] = ufunc.reduceat(x, off[:-1][some])
    return out


def metres(lat: np.ndarray, cos: np.ndarray, lon: np.ndarray, lat2: np.ndarray, cos2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """geo.haversine() of degrees, with the cosines of the latitudes."""
    s, t = np.sin((np.radians(lat2) - np.radians(lat)) / 2), np.sin(np.radians(lon2 - lon) / 2)
    a = s * s + cos * cos2 * t * t
    return 2 * EARTH_KM * 1000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def exact(p: np.ndarray, q: np.ndarray, p2: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Metres between points in radians."""
    s, t = np.sin((p - p2) / 2), np.sin((q - q2) / 2)
    a = s * s + np.cos(p) * np.cos(p2) * t * t
    return 2 * EARTH_KM * 1000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def close(p: np.ndarray, q: np.ndarray, cos: np.ndarray, radii: list[float], rows: slice = slice(None)) -> list[np.ndarray]:
    """For each radius, which of a track's points (axis 1, of `rows`) are how far from which (axis 2); p and q in radians, a track a row.

    Squares of the angles bound the haversine's squared sines: by them pairs are told apart, but those too near to the
    radius for that are computed exactly.
    """
    a, b = p[:, rows, None], q[:, rows, None]
    u, v = a - p[:, None, :], b - q[:, None, :]
    widest = max(np.abs(u).max(initial=0.0), np.abs(v).max(initial=0.0)) / 2
    u *= u
    v *= v
    v *= cos[:, rows, None]
    v *= cos[:, None, :]
    u += v
    out = []
    for r in radii:
        x = r / (2 * EARTH_KM * 1000.0)
        slack = 1e-9 + max(widest, x) ** 2
        if not slack < 0.05:  # also where a coordinate is missing
            out.append(exact(a, b, p[:, None, :], q[:, None, :]) <= r)
            continue
        most = 4 * x * x
        near = u <= most * (1 + slack)
        doubt = near & (u >= most * (1 - slack))
        if doubt.any():
            i, j, k = np.nonzero(doubt)
            first = j + (rows.start or 0)
            near[i, j, k] = exact(p[i, first], q[i, first], p[i, k], q[i, k]) <= r
        out.append(near)
    return out


def density(lat: np.ndarray, lon: np.ndarray, off: np.ndarray, candidates: list[tuple[float, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each candidate (radius, points of an order): near, the points within the radius of each point, itself included, and dense, whether it has
    enough of them or is near to one that has. Tracks of one length are compared together, equal places of a long one once."""
    p, q = np.radians(lat), np.radians(lon)
    cos = np.cos(p)
    radii = sorted({r for r, _ in candidates})
    near = {r: np.zeros(len(p), dtype=np.int64) for r in radii}
    dense = [np.zeros(len(p), dtype=bool) for _ in candidates]
    sizes = np.diff(off)
    for n in np.unique(sizes[(sizes > 0) & (sizes < LONG)]).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, PAIRS // (n * n))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            at = off[some][:, None] + np.arange(n)[None, :]
            found = dict(zip(radii, close(p[at], q[at], cos[at], radii), strict=True))
            count = {r: f.sum(axis=2) for r, f in found.items()}
            for r in radii:
                near[r][at] = count[r]
            for d, (r, least) in zip(dense, candidates, strict=True):
                d[at] = (found[r] & (count[r] >= least[some][:, None])[:, None, :]).any(axis=2)
    for i in np.flatnonzero(sizes >= LONG).tolist():
        own = slice(off[i], off[i + 1])
        order = np.lexsort((q[own], p[own]))
        ps, qs = p[own][order], q[own][order]
        new = np.concatenate([[True], (ps[1:] != ps[:-1]) | (qs[1:] != qs[:-1])])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        u, v = ps[first][None], qs[first][None]
        c, m = np.cos(u), len(first)
        step = max(1, PAIRS // m)
        parts = [slice(a, min(a + step, m)) for a in range(0, m, step)]
        kept: list[list[np.ndarray]] = []
        counts = {r: np.zeros(m, dtype=np.int64) for r in radii}
        for part in parts:
            found_ = [f[0] for f in close(u, v, c, radii, part)]
            for r, f in zip(radii, found_, strict=True):
                counts[r][part] = f @ times
            if len(parts) == 1:
                kept.append(found_)
        cores = [counts[r] >= least[i] for r, least in candidates]
        held = [np.zeros(m, dtype=bool) for _ in candidates]
        for part in parts:
            found_ = kept[0] if kept else [f[0] for f in close(u, v, c, radii, part)]
            by = dict(zip(radii, found_, strict=True))
            for h, core, (r, _) in zip(held, cores, candidates, strict=True):
                h[part] = (by[r] & core[None, :]).any(axis=1)
        for r in radii:
            near[r][own] = counts[r][place]
        for d, h in zip(dense, held, strict=True):
            d[own] = h[place]
    return [near[r] for r, _ in candidates], dense


def column(x: pa.Array, kind: Any, null: Any) -> np.ndarray:
    return np.asarray((x.fill_null(null) if x.null_count else x).to_numpy(zero_copy_only=False), dtype=kind)


def nullable(x: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(x, type=kind, mask=missing)


def listed(off: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, upto = 0, offsets(sizes)
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PINGS, "right")) - 1)
        yield begin, end
        begin = end


class Measure:
    """Measures superset (pings in order of time), stops, low and high (the bounds of the basic window), target (seconds of a dwell) and assign (seconds) of each order.

    parts names what is measured besides the window: clusters, stops, walk, grid (of candidates). schema() is the result's.
    """

    def __init__(self, policy: dict[str, Any], parts: tuple[str, ...], grid: list[tuple[int, int]] | None = None) -> None:
        self.policy, self.parts, self.grid = policy, parts, grid or []

    def schema(self) -> str:
        more = {"clusters": CLUSTERS, "stops": STOPS, "walk": WALK, "grid": GRID}
        return f"struct<{', '.join(f'{c.strip().split(None, 1)[0]}:{c.strip().split(None, 1)[1]}' for c in ', '.join([WINDOW, *(more[p] for p in self.parts)]).split(', '))}>"

    def __call__(self, superset: pa.Array, stops: pa.Array, low: pa.Array, high: pa.Array, target: pa.Array, assign: pa.Array) -> pa.Array:
        sizes = column(superset.value_lengths(), np.int64, 0)
        out = [self.some(*(x.slice(a, b - a) for x in (superset, stops, low, high, target, assign))) for a, b in slices(sizes)]
        if not out:
            out = [self.some(superset, stops, low, high, target, assign)]
        return pa.concat_arrays(out)

    def some(self, superset: pa.Array, stops: pa.Array, low: pa.Array, high: pa.Array, target: pa.Array, assign: pa.Array) -> pa.Array:
        gps = self.policy["gps"]
        count = len(superset)
        lost = np.asarray((low.is_null().to_numpy(zero_copy_only=False)) | (high.is_null().to_numpy(zero_copy_only=False)))
        b0, b1, goal = column(low, np.int64, 0), column(high, np.int64, -1), column(target, np.float64, np.nan)
        off = offsets(column(superset.value_lengths(), np.int64, 0))
        flat = superset.flatten()
        cell = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
        row = np.repeat(np.arange(count), np.diff(off))
        ts = column(cell["ts"], np.int64, 0)

        def gap(ts: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            some = off[1:] > off[:-1]
            d = np.diff(ts, prepend=ts[:1])
            d[off[:-1][some]] = 0
            out = reduced(np.maximum, d, off, 0)
            if some.any():
                first, last = ts[off[:-1][some]], ts[off[1:][some] - 1]
                out[some] = np.maximum(out[some], np.maximum(first - a[some], b[some] - last))
            out[~some] = (b - a)[~some]
            return out / 60.0

        inside = (ts >= b0[row]) & (ts <= b1[row])
        base = offsets(sums(inside, off))
        n, widest = np.diff(base), gap(ts[inside], base, b0, b1)
        expanded = (n < gps["min_points"]) | (widest > gps["max_gap_minutes"])
        mid, half = b0 + (b1 - b0) // 2, int(gps["max_window_h"] * 3600 / 2)
        w0, w1 = np.where(expanded, mid - half, b0), np.where(expanded, mid + half, b1)
        keep = (ts >= w0[row]) & (ts <= w1[row]) & ~lost[row]
        off, row, ts = offsets(sums(keep, off)), row[keep], ts[keep]
        n, widest = np.diff(off), gap(ts, off, w0, w1)
        lat, lon = (column(cell[c], np.float64, np.nan)[keep] for c in ("lat", "lon"))
        out: dict[str, pa.Array] = {
            "expanded": pa.array(expanded),
            "point_count": pa.array(n.astype(np.int32)),
            "max_gap_minutes": nullable(widest, lost, pa.float64()),
            "gps_sparse": pa.array((n < gps["min_points"]) | (widest > gps["max_gap_minutes"])),
        }
        d = np.diff(ts, prepend=ts[:1])
        d[off[:-1][n > 0]] = 0
        usable = (d > 0) & (d <= gps["max_gap_minutes"] * 60)
        gaps, k = d[usable], sums(usable, off)
        g = offsets(k)
        gaps = gaps[np.lexsort((gaps, row[usable]))]
        at = lambda i: gaps[np.minimum(g[:-1] + i, max(len(gaps) - 1, 0))] if len(gaps) else np.zeros(count)
        middle = (at(np.maximum(k - 1, 0) // 2) + at(k // 2)) / 2.0
        out["gap_median"] = nullable(middle, k == 0, pa.float64())
        scaled = self.scaled(goal, middle, k)
        least, drop = scaled(int(self.policy["dbscan"]["min_pts"]), 3, 30), scaled(int(self.policy["dbscan"]["drop_off_min_pts"]), 5, 80)
        out |= {"min_pts": pa.array(least.astype(np.int32)), "drop_min_pts": pa.array(drop.astype(np.int32))}

        if {"clusters", "stops"} & {*self.parts}:
            near, dense = density(lat, lon, off, [(float(self.policy["dbscan"]["clustering_radius_m"]), least)])
            if "clusters" in self.parts:
                out |= {"clustered": pa.array(sums(dense[0], off)), "cores": pa.array(sums(near[0] >= least[row], off))}
        if {"stops", "walk", "grid"} & {*self.parts}:
            pairs = Pairs(stops, lat, lon, off)
            if "stops" in self.parts:
                out |= self.confidences(pairs, ts, dense[0], drop)
            if "walk" in self.parts:
                heading, speed = (column(cell[c], np.float64, np.nan)[keep] for c in ("heading", "speed"))
                out |= self.walked(pairs, ts, lat, lon, off, row, heading, speed, goal, column(assign, np.int64, 0), np.asarray(assign.is_null().to_numpy(zero_copy_only=False)))
            if "grid" in self.parts:
                _, each = density(lat, lon, off, [(float(r), scaled(m, 3, 30)) for r, m in self.grid])
                means = np.stack([self.stop_values(pairs, ts, x, drop)[2] for x in each], axis=1) if each else np.zeros((count, 0))
                out["grid"] = listed(np.arange(count + 1) * len(self.grid), pa.array(means.reshape(-1)))
        return pa.StructArray.from_arrays([*out.values()], names=[*out])

    def scaled(self, goal: np.ndarray, middle: np.ndarray, k: np.ndarray):
        """tracks.presence_scale(): a number of points at this ping rate and target."""
        d, c = self.policy["dwell"], self.policy["dbscan"]
        low, high = sorted((float(d["gap_seconds_min"]), float(d["gap_seconds_max"])))
        on = bool(c["autoscale_min_pts"]) & (k >= d["min_gap_samples"]) & (k > 0)
        tau = np.minimum(high, np.maximum(low, middle))
        scale = goal / float(d["min_dwell_seconds"]) * (float(c["autoscale_ref_gap_seconds"]) / np.where(on, tau, 1.0))
        return lambda base, a, b: np.where(on, np.minimum(b, np.maximum(a, np.rint(np.where(on, scale, 0.0) * float(base)))), base).astype(np.int64)

    def stop_values(self, s: Pairs, ts: np.ndarray, dense: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Confidences of the lanes, visits of round trips (0 for others), mean of each order."""
        c = self.policy["dbscan"]
        value, open_ = np.zeros(len(s.order)), np.ones(len(s.order), dtype=bool)
        inside = dense[s.ping]
        for r, discount in ((c["immediate_dp_radius"], 1.0), (c["standard_dp_radius"], c["standard_discount"]), (c["extended_dp_radius"], c["extended_discount"])):
            here = s.dist < float(r)
            n, m = sums(here, s.off), sums(here & inside, s.off)
            takes = open_ & (n > drop[s.order])
            value[takes] = (m[takes] / np.maximum(n[takes], 1)) * float(discount)
            open_ &= ~takes
        home = s.dist < float(c["extended_dp_radius"])
        home &= (s.place == 0)[s.lane]
        seen = ts[s.ping[home]]
        own = s.lane[home]
        away = np.concatenate([[False], (own[1:] == own[:-1]) & (seen[1:] - seen[:-1] > c["round_trip_gap_seconds"])]) if len(own) else np.zeros(0, bool)
        visits = np.where(s.round_trip, np.bincount(s.order[own[away]], minlength=len(s.count)) + 1, 0)
        last = s.last & (visits == 1)[s.order]
        value[last] /= 2
        value = np.where((s.size > 0)[s.order], value, 0.0)
        return value, visits, reduced(np.add, value, offsets(s.count), 0.0) / np.maximum(s.count, 1)

    def confidences(self, s: Pairs, ts: np.ndarray, dense: np.ndarray, drop: np.ndarray) -> dict[str, pa.Array]:
        value, visits, mean = self.stop_values(s, ts, dense, drop)
        some = (s.size > 0)[s.order]
        lists = listed(offsets(np.where(s.size > 0, s.count, 0)), pa.array(value[some]))
        return {"confidences": lists, "visits": nullable(visits.astype(np.int32), ~s.round_trip, pa.int32()), "stop_confidence": pa.array(mean)}

    def walked(self, s: Pairs, ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, off: np.ndarray, row: np.ndarray, heading: np.ndarray, speed: np.ndarray, goal: np.ndarray, assign: np.ndarray, unassigned: np.ndarray) -> dict[str, pa.Array]:
        st, g = self.policy["stages"], self.policy["progress"]
        match = float(self.policy["sequence"]["stop_match_radius_m"])
        count, cos = len(s.count), s.cos
        when = ts[s.ping]
        none = np.iinfo(np.int64).max
        radius = np.where(s.place == 0, float(st["merchant_radius_m"]), np.where(s.last, float(st["dropoff_radius_m"]), match))
        visit = reduced(np.minimum, np.where(s.dist <= radius[s.lane], when, none), s.off, none)
        lanes = offsets(s.count)
        out = {"dwell": listed(lanes, pa.array(self.dwells(s, ts, lat, lon, speed, goal))), "visit_ts": listed(lanes, nullable(visit, visit == none, pa.int64()))}

        # path: each stop takes the first ping after the one before
        at, hits, on = np.full(count, -1), np.zeros(count, dtype=np.int64), np.ones(count, dtype=bool)
        index = np.arange(len(s.ping)) - s.off[:-1][s.lane]
        fits = s.dist <= match
        for k in range(int(s.count.max(initial=0))):
            this = np.flatnonzero(s.place == k)
            good = fits & (index > at[s.order[s.lane]]) & (s.place == k)[s.lane]
            found = reduced(np.minimum, np.where(good, index, none), s.off, none)[this]
            who = s.order[this]
            hit = on[who] & (found < none)
            hits[who[hit]] += 1
            at[who[hit]] = found[hit]
            on[who[~hit]] = False
        out["path_score"] = pa.array(hits / np.maximum(s.count, 1))

        some = (s.size > 0) & (s.count > 0)
        first, last = np.full(count, np.nan), np.full(count, np.nan)
        ends = s.off[1:] - 1
        a, b = s.place == 0, s.last
        a, b = np.flatnonzero(a & some[s.order]), np.flatnonzero(b & some[s.order])
        first[s.order[a]], last[s.order[b]] = s.dist[ends[a]], s.dist[ends[b]]
        out |= {"merchant_dist_m": nullable(first, ~some | np.isnan(first), pa.float64()), "dropoff_dist_m": nullable(last, ~some | np.isnan(last), pa.float64())}

        seconds = np.diff(ts, prepend=ts[:1])
        seconds[off[:-1][s.size > 0]] = 0
        back = np.maximum(np.arange(len(ts)) - 1, 0)
        hop = metres(lat[back], cos[back], lon[back], lat, cos, lon) if len(ts) else np.zeros(0)
        moved = seconds > 0.5
        jump = reduced(np.fmax, np.where(moved, hop, 0.0), off, 0.0)
        fast = reduced(np.fmax, np.where(moved, hop, 0.0) / np.where(moved, seconds, 1), off, 0.0)
        out |= {"max_jump_m": pa.array(np.nan_to_num(jump)), "max_speed_mps": pa.array(np.nan_to_num(fast))}

        # progress: the early pings, or the first ones where these are too few
        least = int(g["min_points"])
        early = (ts >= assign[row]) & (ts <= assign[row] + int(g["window_minutes"] * 60)) & ~unassigned[row]
        many = sums(early, off)
        few = many < least
        begin = np.where(few, off[:-1], reduced(np.minimum, np.where(early, np.arange(len(ts)), none), off, 0))
        n = np.where(few, np.minimum(s.size, max(least, 5)), many)
        measured = (s.size >= least) & (n >= 2) & (s.count > 0)
        d0, d1 = np.full(count, np.nan), np.full(count, np.nan)
        lane = lanes[:-1][measured]
        d0[measured] = s.dist[s.off[:-1][lane] + begin[measured] - off[:-1][measured]]
        d1[measured] = s.dist[s.off[:-1][lane] + (begin + n)[measured] - 1 - off[:-1][measured]]
        place = np.arange(len(ts))
        told = measured[row] & (place >= begin[row]) & (place < (begin + n)[row]) & ~np.isnan(heading)
        who = row[told]
        target = lanes[:-1][who]
        p, q, dl = np.radians(lat[told]), np.radians(s.lat[target]), np.radians(s.lon[target] - lon[told])
        course = (np.degrees(np.arctan2(np.sin(dl) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(dl))) + 360.0) % 360.0
        off_by = np.fmod(np.abs(heading[told] - course), 360.0)
        off_by = np.minimum(off_by, 360.0 - off_by)
        each = lambda x: pa.array(np.bincount(who[x], minlength=count).astype(np.int32))
        most = float(g["max_heading_error_deg"])
        out |= {"pw_n": nullable(n.astype(np.int32), ~measured, pa.int32()), "d0": nullable(d0, np.isnan(d0), pa.float64()), "d1": nullable(d1, np.isnan(d1), pa.float64())}
        return out | {"headings": each(np.ones(len(who), dtype=bool)), "toward": each(off_by <= most), "away": each((off_by >= float(g["away_heading_error_deg"])) & (off_by > most))}

    def dwells(self, s: Pairs, ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """tracks.dwelled() of each lane. Only runs of slow pings near the stop that last long enough are walked, all of them side by side."""
        d = self.policy["dwell"]
        near = s.dist <= float(d["radius_m"])
        v = speed[s.ping]
        ok = near & (np.isnan(v) | (v <= float(d["max_speed_mps"])))
        out = np.zeros(len(s.order), dtype=bool)
        at = np.flatnonzero(ok)
        if not len(at):
            return out
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (s.lane[at[1:]] != s.lane[at[:-1]])]))
        begin, size = at[cut], np.diff(np.append(cut, len(at)))
        lane = s.lane[begin]
        target = goal[s.order[lane]]
        long_ = ts[s.ping[begin + size - 1]] - ts[s.ping[begin]] >= target
        begin, size, lane, target = begin[long_], size[long_], lane[long_], target[long_]
        order = np.argsort(-size, kind="stable")
        begin, size, lane, target = begin[order], size[order], lane[order], target[order]
        hit = np.zeros(len(begin), dtype=bool)
        anchor = np.full(len(begin), -1)
        longest = float(d["max_run_displacement_m"])
        for j in range(int(size.max(initial=0))):
            live = np.flatnonzero(~hit[: np.searchsorted(-size, -j, "left")])
            if not len(live):
                break
            ping = s.ping[begin[live] + j]
            held = anchor[live]
            fresh = held < 0
            base = np.where(fresh, ping, held)
            away = ~fresh & (metres(lat[base], s.cos[base], lon[base], lat[ping], s.cos[ping], lon[ping]) > longest)
            hit[live] = ~fresh & ~away & (ts[ping] - ts[base] >= target[live])
            anchor[live] = np.where(away, -1, base)
        out[lane[hit]] = True
        return out


class Pairs:
    """Distances of every stop of an order to every ping of its track."""

    def __init__(self, stops: pa.Array, lat: np.ndarray, lon: np.ndarray, off: np.ndarray) -> None:
        self.size = np.diff(off)
        self.count = column(stops.value_lengths(), np.int64, 0)
        lanes = offsets(self.count)
        flat = stops.flatten()
        cell = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
        self.lat, self.lon = (column(cell[c], np.float64, np.nan) for c in ("lat", "lon"))
        self.order = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.order)) - lanes[:-1][self.order]
        self.last = self.place == self.count[self.order] - 1
        one, end = np.minimum(lanes[:-1], max(len(self.lat) - 1, 0)), np.maximum(lanes[1:] - 1, 0)
        self.round_trip = (self.count > 1) & (self.lat[one] == self.lat[end]) & (self.lon[one] == self.lon[end]) if len(self.lat) else np.zeros(len(self.count), dtype=bool)
        n = self.size[self.order]
        self.off = offsets(n)
        self.lane = np.repeat(np.arange(len(self.order)), n)
        self.ping = np.arange(self.off[-1]) - self.off[:-1][self.lane] + off[:-1][self.order][self.lane]
        self.cos = np.cos(np.radians(lat))
        cos = np.cos(np.radians(self.lat))
        self.dist = metres(lat[self.ping], self.cos[self.ping], lon[self.ping], self.lat[self.lane], cos[self.lane], self.lon[self.lane])
