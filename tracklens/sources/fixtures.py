"""The engine's inputs derived from the star-schema tables, deterministically: orders, pings, funnel events, edges and more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import epoch

#: Latitude and longitude of the pickup and the drop-off of every derived order, and the jitter's step.
PICKUP, DROP, JITTER = (14.55, 121.02), (14.65, 121.08), 0.00001
#: Pings and speed of each template of a track.
COUNTS = [40, 25, 20, 12, 2, 60, 40, 40, 40]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stops of the variants of an order, in nineteenths of the way from pickup to drop-off; the others have the two ends.
WAYS = {1: [0, 9, 19], 2: [0, 12, 6, 19], 3: [0, 19, 0], 4: [0, 6, 9, 12, 19]}
PLACES = ["curb", "apartment", None, "commercial", "residential", "weird", "unknown"]
VEHICLES = ["two_wheel", None, "semi", "walker", "box_truck", "van_pickup", "large_4w"]


def _way(ks, off=None):
    """Stops at nineteenths of the way; where `off` holds, the third lies a kilometre beside it."""
    shift = lambda i: F.when(off & (i == 2), 0.01).otherwise(0.0) if off is not None else F.lit(0.0)
    return F.transform(ks, lambda k, i: F.struct((F.lit(PICKUP[0]) + (k / 19.0) * (DROP[0] - PICKUP[0]) + shift(i)).alias("lat"), (F.lit(PICKUP[1]) + (k / 19.0) * (DROP[1] - PICKUP[1])).alias("lon")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled orders (status F), in 9 templates of tracks and 7 variants of stops, status, place, vehicle and driver's track."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    k = F.col("o_orderkey")
    tpl, var = (k % 9).cast("int"), (F.floor(k / 9) % 7).cast("int")
    assign = epoch(F.col("o_orderdate")) + (k % 1440) * 60
    replaced = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    cancel = assign + F.when(tpl == 3, 15).when(tpl == 5, 120).otherwise(80) * 60
    of = lambda lists, key, other: F.coalesce(*(F.when(key == v, F.array(*map(F.lit, x))) for v, x in lists.items()), F.array(*map(F.lit, other)))
    driver, user = k % 200, F.col("o_custkey")
    return o.select(
        k.alias("order_id"),
        tpl.alias("tpl"),
        var.alias("var"),
        user.alias("user_id"),
        driver.alias("driver_id"),
        F.when(var == 6, -(driver + 1)).otherwise(k).alias("track_id"),
        assign.alias("assign_ts"),
        cancel.alias("cancel_ts"),
        _way(of(WAYS, var, [0, 19]), var == 4).alias("stops"),
        (F.col("o_totalprice") / 500.0).alias("order_value"),
        F.when(tpl <= 4, "FOOD").otherwise("HAUL").alias("category"),
        tpl.isin(0, 1).alias("next_driver_no_order"),
        F.when(var == 5, "PICKED_UP").otherwise("CANCELLED").alias("order_status"),
        F.when(tpl == 2, 3).otherwise(0).alias("n_reassign"),
        F.when(tpl == 2, F.array(driver, driver + 1, driver + 2)).otherwise(F.array().cast("array<bigint>")).alias("reassign_drivers"),
        F.when(replaced, F.concat(F.lit("R"), k.cast("string"))).alias("replacement_order_id"),
        F.when(replaced, cancel + (k % 300) * 60).alias("replacement_placed_ts"),
        F.when(replaced, _way(of({0: [0, 19], 1: [19]}, var, [0]))).alias("replacement_stops"),
        F.get(F.array(*map(F.lit, PLACES)), var).alias("place_class"),
        F.get(F.array(*map(F.lit, VEHICLES)), (var + tpl) % 7).alias("vehicle_class"),
        F.concat(F.lit("R"), (user % 5).cast("string")).alias("region_code"),
        F.concat(F.lit("C"), (user % 25).cast("string")).alias("city_code"),
        (user % 60).alias("device_id"),
        F.when(k % 10 < 3, (k % 100) / 100.0).alias("device_score"),
        (k % 17 == 0).alias("device_spoof"),
        (k % 19 == 0).alias("device_rooted"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings of every derived order's track, 2 minutes apart; made row by row, no exchange. Orders of variant 6 share their driver's track; those of template 4 and variant 0 have none."""
    o = orders(spark, sf_dir).where("not (tpl = 4 and var = 0)").select("order_id", "track_id", "tpl", "var", "assign_ts")
    count = F.element_at(F.array(*map(F.lit, COUNTS)), F.col("tpl") + 1)
    p = o.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    i, tpl, var = F.col("i"), F.col("tpl"), F.col("var")
    out = tpl.isin(7, 8) & (i % 4 == 0)
    k = F.floor(i / 4).cast("int")
    line = (i - 20) / 19.0
    near = F.when(var == 2, F.lit(PICKUP[0] + 0.01) - i * 0.0002).otherwise(PICKUP[0] + 0.01)
    lat0 = F.when(tpl == 3, near).when((tpl == 5) & i.between(20, 39), PICKUP[0] + line * (DROP[0] - PICKUP[0])).when((tpl == 5) & (i >= 40), DROP[0]).when((tpl == 6) & (i == 20), PICKUP[0] + 0.05).when(tpl == 7, PICKUP[0] + 0.0022).when(tpl == 8, PICKUP[0] + 0.0054).otherwise(PICKUP[0])
    lon0 = F.when((tpl == 5) & i.between(20, 39), PICKUP[1] + line * (DROP[1] - PICKUP[1])).when((tpl == 5) & (i >= 40), DROP[1]).otherwise(PICKUP[1])
    lat = F.when(out, lat0 - (k % 3) * 0.0006).otherwise(lat0 + (i % 5) * JITTER)
    lon = F.when(out, lon0 + (F.floor(k / 3) + 1) * 0.0006).otherwise(lon0 + (i % 3) * JITTER)
    speed = F.when(tpl == 0, 0.2).when(tpl == 1, 0.3).when(tpl == 2, 1.0).when(tpl == 3, 5.0).when(tpl == 4, 0.0).when((tpl == 5) & i.between(20, 39), 8.0).when(tpl == 6, 0.2).otherwise(0.3)
    heading = F.when(tpl == 3, F.when(var == 0, 180.0).when(var == 1, 0.0).when(var == 2, 90.0))
    return p.select("track_id", (F.col("assign_ts") + i * 120).alias("ts"), (i + 100 * (F.col("order_id") % 100_000)).cast("bigint").alias("seq"), lat.alias("lat"), lon.alias("lon"), speed.alias("speed"), heading.alias("heading"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's driver did in the hours before: order_id, driver_id, user_id, ts, kind, with_cause, in 11 profiles."""
    o = orders(spark, sf_dir).select("order_id", "driver_id", "user_id", "cancel_ts", (F.col("order_id") % 11).cast("int").alias("prof"))
    n = lambda xs: F.coalesce(F.get(F.array(*map(F.lit, xs)), F.col("prof")), F.lit(0))
    nc, na, nk = n([0, 5, 4, 2, 1]), n([0, 5, 6, 8]), n([0, 0, 1, 8])
    e = o.withColumns({"nc": nc, "na": na, "n": nc + na + nk}).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    kind = F.when(F.col("j") < F.col("nc"), "cancel").when(F.col("j") < F.col("nc") + F.col("na"), "accept").otherwise("complete")
    ts = F.col("cancel_ts") - F.when(F.col("prof") == 4, 8000).otherwise(600 * (F.col("j") % 11 + 1))
    return e.select((-(F.col("order_id") * 100 + F.col("j"))).alias("order_id"), "driver_id", F.when(F.col("prof") == 1, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), ts.alias("ts"), kind.alias("kind"), (F.col("prof") == 2).alias("with_cause"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, entity_kind, entity_id, ts of the orders: every driver at the cancellation, every third user at the assignment."""
    o = orders(spark, sf_dir)
    d = o.select("device_id", F.lit("driver").alias("entity_kind"), F.col("driver_id").alias("entity_id"), F.col("cancel_ts").alias("ts"))
    return d.unionByName(o.where("order_id % 3 = 0").select("device_id", F.lit("user").alias("entity_kind"), F.col("user_id").alias("entity_id"), F.col("assign_ts").alias("ts")))


def order_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat signals: order_id, driver_id, persuasion, cash, forced, score, source, ts; some drivers have three more in the days before."""
    o = orders(spark, sf_dir)
    k = F.col("order_id")
    flags = lambda a, b, c: (a.alias("persuasion"), b.alias("cash"), c.alias("forced"))
    own = o.where("order_id % 23 = 0 or order_id % 29 = 0 or order_id % 31 = 0").select("order_id", "driver_id", *flags(k % 23 == 0, k % 29 == 0, k % 31 == 0), F.col("cancel_ts").alias("ts"))
    more = o.where("order_id % 37 = 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(3)))).select((-(k * 10 + F.col("j"))).alias("order_id"), "driver_id", *flags(F.lit(False), F.lit(False), F.lit(True)), (F.col("cancel_ts") - F.col("j") * 86400).alias("ts"))
    return own.unionByName(more).withColumns({"score": F.lit(None).cast("double"), "source": F.lit("app")})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", epoch(F.col("ts")).alias("ts"), F.col("user_id").alias("driver_id"), (F.col("event_id") % 25).alias("user_id"), F.col("event_type"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, ts, driver_id, user_id, kind (accept, complete, cancel), with_cause."""
    kind = F.when(F.col("event_type") == "signup", "accept").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "cancel")
    return events(spark, sf_dir).withColumn("kind", kind).where("kind is not null").select(F.col("event_id").alias("order_id"), "ts", "driver_id", "user_id", "kind", F.coalesce(F.col("k") % 3 == 0, F.lit(False)).alias("with_cause"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, entity_kind, entity_id, ts: drivers of all events, users of purchases."""
    e = events(spark, sf_dir).withColumn("device_id", F.col("event_id") % 60)
    d = e.select("device_id", F.lit("driver").alias("entity_kind"), F.col("driver_id").alias("entity_id"), "ts")
    return d.unionByName(e.where("event_type = 'purchase'").select("device_id", F.lit("user").alias("entity_kind"), F.col("user_id").alias("entity_id"), "ts"))


def device_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("event_id") % 60).alias("device_id"), "event_id", "ts", F.least(F.lit(1.0), F.col("value") / 400.0).alias("risk"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: ((F.col("event_id") * m) % 1000) / 1000.0
    return events(spark, sf_dir).select(F.col("event_id").alias("order_id"), F.col("driver_id").alias("entity"), "ts", (F.col("event_id") % 5).alias("region"), n(7919).alias("cancelled_offline"), n(104729).alias("cancel_abuse"), n(1299709).alias("selective_theft"), F.col("value").alias("order_value"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("order_id"), F.col("quality").alias("cancelled_offline"), F.col("toxic").alias("cancel_abuse"), F.lit(None).cast("int").alias("selective_theft"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(F.lit("cancelled_offline"), F.lit("cancel_abuse"), F.lit("selective_theft"))
    return events(spark, sf_dir).where("event_type in ('purchase', 'error')").select(F.col("event_id").alias("order_id"), F.when(F.col("event_type") == "purchase", "clawback_won").otherwise("clawback_lost").alias("outcome"), (F.col("event_id") % 5).alias("region"), F.element_at(heads, (F.col("event_id") % 3).cast("int") + 1).alias("head"), "ts", F.col("value").alias("amount"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, d, start_ts, end_ts, supply, demand: 30 days of January 2024 for each of 5 regions."""
    start = 1704067200
    d = F.col("d")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("region"))
    return regions.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("region", "d", (start + d * 86400).cast("bigint").alias("start_ts"), (start + (d + 1) * 86400).cast("bigint").alias("end_ts"), (50 + d % 40).cast("double").alias("supply"), F.when(d % 7 == 0, 120.0).otherwise(60.0).alias("demand"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments in generations 1 to 3, some of them twice under two policy hashes."""
    s = scores(spark, sf_dir).withColumn("generation", F.explode(F.sequence(F.lit(1), (1 + F.col("order_id") % 3).cast("int"))))
    hashes = F.when(F.col("order_id") % 10 == 0, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(F.lit("p1")))
    return s.withColumn("policy_hash", F.explode(hashes)).select("order_id", "policy_hash", F.lit("rules").alias("model_version"), "generation", "cancelled_offline", "cancel_abuse", "selective_theft", (F.col("ts") + F.col("generation") * 60).alias("assessed_at"), F.lit(False).alias("provisional"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nation"), F.upper("r_name").alias("region_code"), F.upper("n_name").alias("city_code"))
