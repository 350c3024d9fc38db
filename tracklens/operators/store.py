"""Versioned assessments and keyed tables: latest reads, generations, upserts, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("order_id", "policy_hash", "model_version", "generation")


def latest_all(rows: DataFrame) -> DataFrame:
    """Rows of each order's highest generation; rows that tie there all stay."""
    w = Window.partitionBy("order_id")
    return rows.withColumn("_top", F.max("generation").over(w)).where(F.col("generation") == F.col("_top")).drop("_top")


def latest(rows: DataFrame) -> DataFrame:
    """One row an order: the highest generation, then the last assessed, then by policy hash and model."""
    top = rows.groupBy("order_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "order_id"]), F.struct("generation", "assessed_at", "policy_hash", "model_version")).alias("r"))
    return top.select("order_id", "r.*")


def next_generation(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Each order's highest generation plus one; 1 for a new order."""
    top = rows.groupBy("order_id").agg(F.max("generation").alias("g"))
    return orders.select("order_id").distinct().join(top, "order_id", "left").select("order_id", (F.coalesce("g", F.lit(0)) + 1).alias("next_generation"))


def mark_provisional(rows: DataFrame, before: DataFrame) -> DataFrame:
    """rows whose generation is below `before` (order_id, generation) and that aren't provisional yet, marked so: what an upsert is to write again."""
    b = before.select("order_id", F.col("generation").alias("_b"))
    return rows.join(b, "order_id").where((F.col("generation") < F.col("_b")) & ~F.col("provisional")).drop("_b").withColumn("provisional", F.lit(True))


def upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """table with rows laid over it by key; of several new rows with one key the last written (by assessed_at, then by all columns' hash) stays."""
    w = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col("assessed_at").desc(), F.xxhash64(*table.columns))
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def missing(requests: DataFrame, table: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Requests that no stored row answers."""
    return requests.join(table.select(*key), [*key], "left_anti")


def last_write(rows: DataFrame, key: str = "order_id", at: str = "created_at") -> DataFrame:
    """The last row of each key; of equally late ones the greatest by their other columns."""
    rest = [at, *(c for c in rows.columns if c not in (key, at))]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*")


def prune(rows: DataFrame, now: int, days: int, at: str = "ts") -> DataFrame:
    return rows.where(F.col(at) >= now - days * 86400)


def latest_in_market(cache: DataFrame, market: str) -> DataFrame:
    """Of a market's cached rows each order's highest generation within that market."""
    return latest_all(cache.where(F.col("market") == market))


def generations(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """All generations of the asked orders, ascending within each."""
    return rows.join(orders.select("order_id").distinct(), "order_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("order_id").orderBy("generation", "assessed_at", "policy_hash", "model_version")))


def cached(table: DataFrame, rows: DataFrame, now: int, days: int) -> DataFrame:
    """The replay cache after a batch: what is older than `days` is dropped, empty tracks aren't kept, a written (order, generation) is replaced.

    Rows: order_id, generation, market, ts, points (an array).
    """
    kept = prune(table, now, days)
    new = rows.where(F.size("points") > 0)
    return kept.join(new.select("order_id", "generation"), ["order_id", "generation"], "left_anti").unionByName(new)
