"""Live states where rows are late, repeated or too late, and streams that begin with a batch table or go on from a checkpoint. The registered queries hold them against batch folds."""

import random

from pyspark.sql import functions as F

from tracklens.functions.policy import DEFAULTS
from tracklens.operators import history
from tracklens.sources.kept import KeptTable
from tracklens.streaming import states


def run(spark, tmp_path, batches, schema, stream, key, name="s"):
    """The result after each list of batches, one run of the stream each."""
    root, out = str(tmp_path / name), []
    for run_ in batches:
        for rows in run_:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        states.start(stream(live), f"{root}/t", key, f"{root}/c").awaitTermination(120)
        out.append({r[key[0]]: r for r in KeptTable(spark, f"{root}/t", key, "newest").read().collect()})
    return out


SCHEMA = "k string, ts bigint, id bigint, x double"


def test_late_repeated_and_dropped_rows(spark, tmp_path):
    fold = lambda live: states.ordered(live, ["k"], states.Average(0.5), late=100)
    first, second = run(spark, tmp_path, [[[("a", 0, 1, 1.0), ("a", 100, 2, 0.0)], [("a", 50, 3, 0.5), ("a", 100, 2, 0.0)]], [[("a", 300, 4, 1.0)], [("a", 60, 5, 9.0), ("a", 300, 4, 1.0), ("b", 1, 1, None)]]], SCHEMA, fold, ("k",))
    assert (first["a"].value, first["a"].n, first["a"].dropped) == (0.375, 3, 0)  # 1, 0.5, 0 in order of time
    assert (second["a"].value, second["a"].n, second["a"].dropped) == (0.6875, 4, 1)  # the row at 60 comes too late
    assert (second["b"].value, second["b"].n) == (None, 0)


def test_any_arrival_within_the_time_gives_the_batch_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), t, t, rng.random()) for t in range(400)]
    seen = sorted(rows * 2, key=lambda r: r[1] + rng.random() * 80)
    parts = [seen[i : i + 160] for i in range(0, 800, 160)]
    got = run(spark, tmp_path, [parts[:2], parts[2:]], SCHEMA, lambda live: states.ordered(live, ["k"], states.Average(0.3), late=200), ("k",))[-1]
    want = {r.k: r for r in history.folded(spark.createDataFrame(rows, SCHEMA), ["k"], "x", 0.3, order=("ts", "id")).collect()}
    assert {k: (round(r.value, 12), r.n) for k, r in got.items()} == {k: (round(r.value, 12), r.n) for k, r in want.items()}


def test_initial_states(spark, tmp_path):
    before = spark.createDataFrame([("a", 50, 0.5, 4), ("z", 9, 1.0, 1)], "k string, upto bigint, v double, n bigint")
    got = run(spark, tmp_path, [[[("a", 40, 1, 9.0), ("a", 60, 2, 1.0), ("b", 1, 1, 0.25)]]], SCHEMA, lambda live: states.ordered(live, ["k"], states.Average(0.5), 10, initial=before), ("k",))[-1]
    assert (got["a"].value, got["a"].n, got["a"].dropped) == (0.75, 5, 1) and (got["b"].value, got["b"].n) == (0.25, 1)
    schema = "k string, ts bigint, id bigint, mark int"
    held = spark.createDataFrame([("a", 100, [(1, 100, 1), (2, 10, 0)])], "k string, newest bigint, orders array<struct<id:bigint,ts:bigint,mark:int>>")
    stream = lambda live: states.windowed_orders(live, ["k"], 50, initial=held)
    got = run(spark, tmp_path, [[[("a", 120, 3, 1), ("a", 90, 1, 0)]], [[("a", 151, 4, 0)]]], schema, stream, ("k",), "w")
    assert [(g["a"].orders, g["a"].marked, g["a"].newest) for g in got] == [(2, 2, 120), (2, 1, 151)]


def test_peers(spark, tmp_path):
    """z against other entities of a cohort, by the batch operator."""
    rng = random.Random(5)
    rows = [(str(rng.randint(0, 3)), t, t, f"e{rng.randint(0, 4)}", rng.random()) for t in range(120)]
    schema = "cohort string, ts bigint, id bigint, entity string, x double"
    stream = lambda live: states.ordered(live, ["cohort"], states.Anomaly(DEFAULTS, True), late=60)
    got = run(spark, tmp_path, [[rows[:50], rows[50:]]], schema, stream, ("order_id",))[-1]
    batch = spark.createDataFrame(rows, schema).withColumnRenamed("id", "order_id")
    want = {r.order_id: r.z_peer for r in history.anomalies(batch, DEFAULTS).collect()}
    near = lambda z: None if z is None else round(z, 9)
    assert {k: near(r.z) for k, r in got.items()} == {k: near(z) for k, z in want.items()} and sum(z is not None for z in want.values()) > 20
