"""Geography and time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: A degree of latitude is a little longer than this; used to rule out far points before the exact distance.
DEGREE_M = 111_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    p, q = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((q - p) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(p) * F.cos(q) * t * t
    return F.lit(2 * EARTH_KM * 1000.0) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def between(p: Column, q: Column) -> Column:
    """Metres between two structs with lat and lon."""
    return haversine(p["lat"], p["lon"], q["lat"], q["lon"])


def within(p: Column, q: Column, metres: Column | float) -> Column:
    """Whether two structs are at most so far apart; latitude alone rules most pairs out."""
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return (F.abs(p["lat"] - q["lat"]) * DEGREE_M <= m) & (between(p, q) <= m)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 up to 360 degrees."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(q)
    x = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def heading_error(heading: Column, course: Column) -> Column:
    """Smallest angle between two directions, 0 to 180 degrees."""
    d = F.abs(heading - course) % 360.0
    return F.least(d, F.lit(360.0) - d)


def parse_path(path: Column) -> Column:
    """'lat|lon,lat|lon' as an array of structs; blank and null are empty."""
    cut = F.filter(F.split(F.coalesce(path, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.transform(cut, lambda x: F.struct(F.split(F.trim(x), "[|]")[0].cast("double").alias("lat"), F.split(F.trim(x), "[|]")[1].cast("double").alias("lon")))


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def parse_time(text: Column) -> Column:
    """Seconds since 1970 of ISO text; Z and offsets count, and text without either is UTC. Null where it is no time."""
    clean = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    zoned = F.when(clean.rlike(r"[+-]\d\d:?\d\d$"), clean).otherwise(F.concat(clean, F.lit("+00:00")))
    return F.unix_micros(F.try_to_timestamp(zoned)) / 1e6


def market(code: Column) -> Column:
    return F.upper(F.trim(F.coalesce(code, F.lit(""))))


def day_key(seconds: Column) -> Column:
    """Calendar day of epoch seconds, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def hash_share(key: Column) -> Column:
    """First eight hexadecimal digits of a key's sha256 as a number."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")


def lineage_id(order: Column, events: Column) -> Column:
    """sha256 of the order and its events' times (ts, else timestamp, else nothing), in order of their text."""
    times = F.array_sort(F.transform(events, lambda e: F.coalesce(e["ts"], e["timestamp"], F.lit(""))))
    return F.sha2(F.concat(order.cast("string"), F.lit("|"), F.array_join(times, "|")), 256)


def lineage_summary(events: Column) -> dict[str, Column]:
    """count of events, their times that aren't empty, sorted, and their types (type, else event_type) as they come."""
    times = F.array_sort(F.filter(F.transform(events, lambda e: F.coalesce(e["ts"], e["timestamp"], F.lit(""))), lambda t: t != ""))
    return {"count": F.size(events), "times": times, "types": F.transform(events, lambda e: F.coalesce(e["type"], e["event_type"]))}


def cohort(city: Column, region: Column) -> Column:
    """The peers of an order: its city's, else its region's, else all."""
    own = lambda kind, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(kind + ":"), F.trim(c)))
    return F.coalesce(own("city", city), own("region", region), F.lit("cohort:global"))
