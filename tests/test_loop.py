"""The control loop: debouncing under a clock of its own, cycles that are tried again, and one market's error."""

import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from tracklens.functions.policy import DEFAULTS, merged
from tracklens.operators import tuning
from tracklens.sources import fixtures
from tracklens.streaming import loop

DATA = "/root/testdata/sf0.001"
LEARN = {"learning": {"min_pattern_support": 3, "target_precision": 0.02, "min_pattern_recall": 0.2}, "thresholds": {"cancelled_offline": 0.95, "cancel_abuse": 0.95}}


class Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getValueState(self, name, schema):
        def put(v):
            self.value = v

        return SimpleNamespace(get=lambda: self.value, update=put, clear=lambda: put(None))


def test_debounce_under_a_clock():
    now, handle = [0], Handle()
    d = loop.Debounce(30_000, lambda timers: now[0])
    d.init(handle)
    woke = []

    def at(t, rows=0):
        now[0] = t
        for due in sorted(x for x in handle.timers if x <= t):
            handle.timers.discard(due)
            woke.extend((t, r.feedback) for r in d.handleExpiredTimer(("R", ""), None, SimpleNamespace(getExpiryTimeInMs=lambda due=due: due)))
        if rows:
            assert list(d.handleInputRows(("R", ""), iter(range(rows)), None)) == []

    for t, rows in ((0, 1), (20_000, 2), (45_000, 1), (70_000, 0), (75_000, 0), (80_000, 0), (90_000, 1), (119_999, 0), (120_000, 0), (500_000, 0)):
        at(t, rows)
    assert woke == [(75_000, 4), (120_000, 1)] and handle.timers == set() and handle.value is None


def cycle(spark, root, tune=tuning.tune):
    k = F.col("order_id")
    scores = fixtures.scores(spark, DATA).withColumns({"region": F.concat(F.lit("r"), (k % 2).cast("string")), "city": F.lit(None).cast("string")})
    caps = spark.createDataFrame([], "region string, city string, window string, cap int")
    return loop.Cycle(spark, root, merged(DEFAULTS, LEARN), lambda: (scores, fixtures.labels(spark, DATA), caps), lambda: 1_706_745_600, tune, cooldown_minutes=60)


def test_a_cycle_tunes_once_and_enters_it(spark, tmp_path):
    c = cycle(spark, f"file://{tmp_path}/c")
    wakes = spark.createDataFrame([("R0", "", 2, 5)], "region string, city string, feedback bigint, due bigint")
    for _ in range(2):
        c.wake(wakes, 0)
        audit = c.audit.read().collect()
        assert {r.region for r in audit} == {"R0"} and len(audit) == 4 and sum(r.action == "metrics_snapshot" for r in audit) == 1
        assert c.metrics.read().count() == 3 - 1  # no label of one head
    applied = {r.path: r.value for r in c.overlays.read().collect()}
    assert applied and all(r.decision == "accepted" for r in audit if r.path in applied)
    c.tick(0)  # R1 is new, R0 has been applied just now
    audit = c.audit.read().collect()
    assert {r.region for r in audit} == {"R0", "R1"} and c.metrics.read().select("region").distinct().count() == 2


def test_one_market_fails_alone(spark, tmp_path):
    def tune(scores, *args, **more):
        return tuning.tune(scores, *args, **more).withColumn("reason", F.when(F.col("region") == "R1", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("reason")))

    c = cycle(spark, f"file://{tmp_path}/c", tune)
    c.wake(spark.createDataFrame([("R0", "", 1, 1), ("R1", "", 1, 1)], "region string, city string, feedback bigint, due bigint"), 0)
    assert {r.region for r in c.audit.read().where("action <> 'metrics_snapshot'").collect()} == {"R0"}


def test_feedback_wakes_its_market(spark, tmp_path):
    """The loop on a stream: two rows of one market are one wake."""
    spark.createDataFrame([(" r0", None), ("R0", "")], "region string, city string").coalesce(1).write.parquet(str(tmp_path / "in"))
    c = cycle(spark, f"file://{tmp_path}/c")
    seen = []
    wake = c.wake
    c.wake = lambda df, n: (seen.extend((r.region, r.feedback) for r in df.collect()), wake(df, n))
    q = loop.run(spark.readStream.schema("region string, city string").parquet(str(tmp_path / "in")), c, str(tmp_path / "q"), pause=1.0)
    try:
        end = time.time() + 90
        while time.time() < end and not (seen and c.audit.version().number):
            time.sleep(0.5)
            assert q.exception() is None
    finally:
        q.stop()
    assert seen == [("R0", 2)] and c.audit.read().count() == 4
