"""Readers for order and ping files, and the scenario generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import hash_share, parse_path, parse_time

YES = ("1", "true", "yes", "y", "t")
HEADS = ("cancelled_offline", "cancel_abuse", "selective_theft")
_EVENTS = "array<struct<driver_id:bigint,ts:string,timestamp:string,type:string,event_type:string>>"


def text(name: str) -> Column:
    """A trimmed cell; empty is null."""
    t = F.trim(F.col(name))
    return F.when(t != "", t)


def truth(name: str) -> Column:
    t = text(name)
    return F.when(t.isNotNull(), F.lower(t).isin(*YES))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders of a CSV file with a header: typed, empty cells null, paths and reassignments parsed, labels where the file has them.

    A reassign list that is no JSON list fails the read.
    """
    raw = spark.read.option("header", True).csv(path)
    has = {c.lower() for c in raw.columns}
    opt = lambda name, f: (f(name) if name in has else F.lit(None))
    seconds = lambda name: F.floor(parse_time(text(name))).cast("bigint")
    events = F.from_json(F.coalesce(opt("reassign_cancel_events", text), F.lit("[]")), _EVENTS)
    checked = F.when(events.isNull(), F.raise_error(F.lit("reassign_cancel_events is no JSON list")).cast(_EVENTS)).otherwise(events)
    out = raw.select(
        text("order_display_id").alias("order_id"),
        text("driver_id").cast("bigint").alias("driver_id"),
        text("driver_id").cast("bigint").alias("track_id"),
        seconds("assign_ts").alias("assign_ts"),
        seconds("cancel_ts").alias("cancel_ts"),
        parse_path(text("latlong")).alias("stops"),
        text("order_status").alias("order_status"),
        text("category").alias("category"),
        text("order_value").cast("double").alias("order_value"),
        text("currency").alias("currency"),
        opt("next_driver_no_order", truth).cast("boolean").alias("next_driver_no_order"),
        opt("replacement_order_id", text).cast("string").alias("replacement_order_id"),
        opt("replacement_placed_at", seconds).cast("bigint").alias("replacement_placed_ts"),
        F.when(opt("replacement_latlong", text).isNotNull(), parse_path(opt("replacement_latlong", text).cast("string"))).alias("replacement_stops"),
        checked.alias("reassign_events"),
        *(opt(c, text).cast("string").alias(c) for c in ("user_id", "merchant_id", "device_id", "place_class", "vehicle_class", "region_code", "city_code")),
        *(opt(f"label_{h}", text).try_cast("int").alias(f"label_{h}") for h in HEADS),
    )
    return out.withColumn("n_reassign", F.size("reassign_events"))


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    """Pings of a CSV file (driver_id, lat, lon, ts, speed_mps and maybe heading_deg); seq is the file's own order at equal times."""
    raw = spark.read.option("header", True).csv(path)
    heading = text("heading_deg").cast("double") if "heading_deg" in raw.columns else F.lit(None).cast("double")
    cols = raw.select(text("driver_id").cast("bigint").alias("track_id"), F.floor(parse_time(text("ts"))).cast("bigint").alias("ts"), text("lat").cast("double").alias("lat"), text("lon").cast("double").alias("lon"), text("speed_mps").cast("double").alias("speed"), heading.alias("heading"))
    return cols.withColumn("seq", F.monotonically_increasing_id())


def pings_from_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """track_id and pings of JSON lists; speed_mps or speed, heading_deg or heading or course."""
    kind = "array<struct<lat:double,lon:double,ts:string,speed_mps:double,speed:double,heading_deg:double,heading:double,course:double>>"
    p = df.select("track_id", F.posexplode(F.from_json(column, kind)).alias("seq", "p"))
    return p.select("track_id", F.floor(parse_time(F.col("p.ts"))).cast("bigint").alias("ts"), "seq", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.coalesce("p.speed_mps", "p.speed").alias("speed"), F.coalesce("p.heading_deg", "p.heading", "p.course").alias("heading"))


#: Scenario templates, their share and labels (offline, abuse, theft), pings, order value and speed.
TEMPLATES = {
    "theft_dwell": (0.20, (0, 0, 1), 40, 800.0, 0.2),
    "plain_offline": (0.25, (1, 0, 0), 25, 50.0, 0.3),
    "abuse_chain": (0.15, (0, 1, 0), 20, 200.0, 1.0),
    "clean_cancel": (0.30, (0, 0, 0), 12, 80.0, 5.0),
    "gps_sparse": (0.10, (0, 0, 0), 2, 90.0, 0.0),
}


def scenarios(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n scenarios: id, template by the id's hash and the shares, its labels, number of pings, order value and speed."""
    u = hash_share(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))) / float(2**32)
    edges, at = [], 0.0
    for name, (share, *_) in TEMPLATES.items():
        at += share
        edges.append((round(at, 10), name))
    pick = F.lit(edges[-1][1])
    for edge, name in reversed(edges[:-1]):
        pick = F.when(u < edge, name).otherwise(pick)
    of = lambda f, kind: F.create_map(*(F.lit(x) for k, v in TEMPLATES.items() for x in (k, f(v))))[F.col("template")].cast(kind)
    out = spark.range(n).withColumn("template", pick)
    return out.withColumns({**{f"label_{h}": of(lambda v, k=k: v[1][k], "int") for k, h in enumerate(HEADS)}, "n_pings": of(lambda v: v[2], "int"), "order_value": of(lambda v: v[3], "double"), "speed": of(lambda v: v[4], "double")})


def scenario_orders(df: DataFrame) -> DataFrame:
    """Orders of scenarios, as assess() takes them: one pickup and drop-off, cancelled after 80 minutes (15 in a clean one)."""
    start = 1704103200  # 2024-01-01 10:00
    point = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    minutes = F.when(F.col("template") == "clean_cancel", 15).otherwise(80)
    return df.select(
        F.col("id").alias("order_id"), F.col("id").alias("driver_id"), F.col("id").alias("track_id"), F.lit(start).cast("bigint").alias("assign_ts"), (F.lit(start) + minutes * 60).cast("bigint").alias("cancel_ts"),
        F.array(point(14.55, 121.02), point(14.65, 121.08)).alias("stops"), F.lit("CANCELLED").alias("order_status"), F.lit("FOOD").alias("category"), "order_value",
        F.col("template").isin("theft_dwell", "plain_offline").alias("next_driver_no_order"), F.when(F.col("template") == "abuse_chain", 3).otherwise(0).alias("n_reassign"),
        F.lit(None).cast("string").alias("replacement_order_id"), F.lit(None).cast("bigint").alias("replacement_placed_ts"), F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("replacement_stops"),
        "template", *(f"label_{h}" for h in HEADS),
    )


def scenario_pings(df: DataFrame, jitter: float = 1e-5) -> DataFrame:
    """Their pings, 2 minutes apart, around the pickup (a kilometre off in a clean one)."""
    p = df.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n_pings") - 1)))
    off = F.when(F.col("template") == "clean_cancel", 0.01).otherwise(0.0)
    return p.select(F.col("id").alias("track_id"), (F.lit(1704103200) + F.col("seq") * 120).cast("bigint").alias("ts"), "seq", (14.55 + off + (F.col("seq") % 5) * jitter).alias("lat"), (121.02 + off + (F.col("seq") % 3) * jitter).alias("lon"), "speed", F.lit(None).cast("double").alias("heading"))


def fixed_pings(spark: SparkSession, rows: list[tuple], start: int, end: int) -> DataFrame:
    """A few given pings (track_id, ts, lat, lon, speed, heading) of an inclusive time range, for tests and demonstrations."""
    df = spark.createDataFrame(rows, "track_id bigint, ts bigint, lat double, lon double, speed double, heading double")
    return df.where(F.col("ts").between(start, end)).withColumn("seq", F.monotonically_increasing_id())


def pings_to_json(tracks: DataFrame, track: str = "track") -> DataFrame:
    """track_id and payload, the track as a JSON list that pings_from_json() reads."""
    point = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.date_format(F.timestamp_seconds(p["ts"]), "yyyy-MM-dd HH:mm:ss").alias("ts"), p["speed"].alias("speed_mps"), p["heading"].alias("heading_deg"))
    return tracks.select("track_id", F.to_json(F.transform(track, point)).alias("payload"))


def write_shards(df: DataFrame, path: str, rows: int, key: str = "id") -> DataFrame:
    """df in numbered shards of about `rows` rows under path, by key; a shard written again replaces itself. Returns the manifest (shard, n)."""
    placed = df.withColumn("shard", F.floor(F.col(key) / rows).cast("int"))
    placed.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return read_shards(df.sparkSession, path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def next_shard(manifest: DataFrame) -> DataFrame:
    return manifest.agg((F.coalesce(F.max("shard"), F.lit(-1)) + 1).alias("next_shard"))
