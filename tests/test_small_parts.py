"""Keys cut into stretches against whole ones, and small operators that no registered query runs."""

import random

import pytest
from pyspark.sql import functions as F

from tracklens.functions import policy
from tracklens.functions.policy import DEFAULTS
from tracklens.operators import control, history, models
from tracklens.plans import assess
from tracklens.sources import readers
from tracklens.streaming import sinks, streams


def test_stretches_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2]), k, rng.randint(0, 300_000), rng.random(), rng.random() < 0.1) for k in range(400)]
    df = spark.createDataFrame(rows, "device_id bigint, order_id bigint, ts bigint, instant double, told boolean")
    run = lambda: (
        {r.order_id: r.prev for r in history.previous_average(df, "device_id", "instant", 0.9, ("ts", "order_id")).collect()},
        {r.order_id: r.ewma_risk for r in history.device_states(df, 0.9).collect()},
    )
    whole = run()
    monkeypatch.setattr(history, "STRETCH", 7)
    assert run() == whole and len(whole[0]) == len(whole[1]) == 400
    # against a plain walk
    value, told, want = {}, {}, {}
    for d, k, ts, x, t in sorted(rows, key=lambda r: (r[2], r[1])):
        want[k] = value.get(d)
        value[d] = x if d not in value else 0.9 * x + (1 - 0.9) * value[d]
    assert {k: None if v is None else round(v, 12) for k, v in whole[0].items()} == {k: None if v is None else round(v, 12) for k, v in want.items()}


def test_scenarios_are_assessed(spark):
    """Generated orders and pings through the whole assessment: dwelling thefts score high, clean cancels low."""
    s = readers.scenarios(spark, 60, 5)
    a = assess.assess(readers.scenario_orders(s), readers.scenario_pings(s), DEFAULTS)
    got = a.groupBy("template").agg(F.avg("score_selective_theft").alias("theft"), F.avg("score_cancelled_offline").alias("offline")).collect()
    by = {r.template: r for r in got}
    assert by["theft_dwell"].theft > 0.9 and by["clean_cancel"].theft < by["theft_dwell"].theft and by["clean_cancel"].offline < by["plain_offline"].offline


def test_small_parts(spark, tmp_path):
    e = spark.createDataFrame([(1, 7, "cancel", 5, False), (1, 7, "cancel", 9, False), (1, 7, "cancel", 9, True), (1, 7, "accept", 2, None)], "driver_id int, order_id int, kind string, ts int, with_cause boolean")
    assert sorted((r.kind, r.ts, r.with_cause) for r in history.latest_events(e).collect()) == [("accept", 2, None), ("cancel", 9, True)]
    shadows = spark.createDataFrame([("m", 1), ("m", 1), ("m", 2), ("n", 1)], "shadow string, order_id int")
    assert {(r.shadow, r.n) for r in models.shadow_counts(shadows).collect()} == {("m", 2), ("n", 1)}
    t = spark.createDataFrame([("R", "", "a", 1.0), ("R", "", "b", 1.0), ("Q", "C", "a", 1.0)], "region string, city string, path string, value double")
    assert {tuple(r) for r in control.overlay_keys(t).collect()} == {("R", ""), ("Q", "C")} and control.recoverability_of(t, " q", "c ").count() == 1
    assert sorted(r.ts for r in readers.fixed_pings(spark, [(1, 1, 0.0, 0.0, None, None), (1, 5, 0.0, 0.0, None, None), (1, 9, 0.0, 0.0, None, None)], 1, 5).collect()) == [1, 5]
    (tmp_path / "p.yaml").write_text("thresholds: {cancel_abuse: 0.8}\n")
    (tmp_path / "q.yaml").write_text("- 1\n")
    try:
        assert policy.load(str(tmp_path / "p.yaml"))["thresholds"]["cancel_abuse"] == 0.8
        with pytest.raises(ValueError):
            policy.load(str(tmp_path / "q.yaml"))
    except ModuleNotFoundError:
        pytest.skip("no YAML reader here")


def test_first_event_of_each_key(spark, tmp_path):
    spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 15, 3)], "k string, ts bigint, id int").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("k string, ts bigint, id int").parquet(str(tmp_path / "in"))
    streams.start(streams.once_per_key(live, "k"), sinks.jsonl(str(tmp_path / "out")), str(tmp_path / "c"), "append").awaitTermination(60)
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]
