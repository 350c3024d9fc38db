"""The control loop: feedback wakes its market after a pause, a tick wakes all, and each wake runs metrics, tuning and audit.

debounced() is a state of its own for each market: what comes in within the pause puts the wake off, and a
processing-time timer sends one wake for all of it. Cycle keeps the loop's tables and runs a batch of wakes: all markets
that woke are tuned by one plan; if that fails, each is tried alone, so one market's error leaves the others be.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import control, quality, tuning
from ..operators.control import MARKET
from ..sources.kept import KeptTable, stream_id
from . import states

log = logging.getLogger(__name__)
#: Seconds without feedback after which a market wakes.
PAUSE = 30


class Debounce(StatefulProcessor):
    """A market's feedback since its last wake: the timer is put off with each, and the wake has how many there were."""

    def __init__(self, pause_ms: int, clock: Callable[[Any], int] | None = None) -> None:
        self.pause_ms, self.clock = pause_ms, clock or (lambda timers: timers.getCurrentProcessingTimeInMs())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.pending.get()
        due = self.clock(timerValues) + self.pause_ms
        if before is not None:
            self.handle.deleteTimer(before[1])
        self.handle.registerTimer(due)
        self.pending.update(((before[0] if before is not None else 0) + sum(1 for _ in rows), due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.pending.get()
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.pending.clear()
            yield Row(region=key[0], city=key[1], feedback=held[0], due=held[1])

    def close(self) -> None:
        pass


def debounced(feedback: DataFrame, pause: float = PAUSE) -> DataFrame:
    """region, city, feedback (how many), due (milliseconds): one wake for each market's feedback (region, city) once none has come for `pause` seconds. Feedback without a market wakes the empty one."""
    return control.normal(feedback).select(*MARKET).groupBy(*MARKET).transformWithState(Debounce(int(pause * 1000)), "region string, city string, feedback bigint, due bigint", "Update", "processingTime")


def ticks(markets: DataFrame) -> DataFrame:
    """Wakes of all markets, as a scheduled tick gives them."""
    return control.normal(markets).select(*MARKET).distinct().withColumns({"feedback": F.lit(0).cast("bigint"), "due": F.lit(0).cast("bigint")})


class Cycle:
    """Runs wakes: metrics of each market are kept, then thresholds tuned, overlays saved and everything entered in the audit.

    root holds the tables label_metrics, decisions, overlays and audit. load gives (scores, labels, caps) as they are now. A batch that is
    tried again changes nothing that it has done. tune: what decides, from the same arguments as tuning.tune().
    """

    def __init__(self, spark: SparkSession, root: str, policy: dict[str, Any], load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], clock: Callable[[], int], tune: Callable[..., DataFrame] = tuning.tune, **tuner: Any) -> None:
        self.spark, self.policy, self.load, self.clock, self.tune, self.tuner = spark, policy, load, clock, tune, tuner
        self.metrics = KeptTable(spark, f"{root}/label_metrics", (*MARKET, "head", "computed_at"), "computed_at")
        self.overlays = KeptTable(spark, f"{root}/overlays", (*MARKET, "path"), "set_at")
        self.decisions = KeptTable(spark, f"{root}/decisions", ("at", *MARKET, "head"), "at")
        self.audit = KeptTable(spark, f"{root}/audit", ("at", *MARKET, "action", "path"), "at")

    def wake(self, wakes: DataFrame, batch: int, reason: str = "feedback_debounce") -> None:
        """A sink of wakes for foreachBatch."""
        markets = [tuple(r) for r in wakes.select(*MARKET).distinct().orderBy(*MARKET).collect()]  # markets are few: some per city
        if not markets:
            return
        own, now = f"{stream_id(self.spark)}-{reason}", self.clock()
        try:
            self._run(markets, f"{own}", batch, now, reason)
        except Exception:
            log.exception("tuning %s markets at once failed; each is tried alone", len(markets))
            for region, city in markets:
                try:
                    self._run([(region, city)], f"{own}-{region}-{city}", batch, now, reason)
                except Exception:
                    log.exception("the cycle failed for market %s/%s", region, city)

    def _run(self, markets: list[tuple[str, str]], stream: str, batch: int, now: int, reason: str) -> None:
        asked = self.spark.createDataFrame(markets, "region string, city string")
        scores, labels, caps = self.load()
        mine = control.normal(scores).join(F.broadcast(asked.select("region").distinct()), "region", "left_semi")  # the markets of this batch
        overlays = self.overlays.read()
        values = tuning.no_overlays(scores) if overlays is None else overlays.select(*MARKET, "path", "value")
        audit = self.audit.read()
        applied = self.spark.createDataFrame([], "region string, city string, path string, applied_at bigint") if audit is None else control.last_applied(audit)

        snapshot = self.metrics_of(mine, labels, values, asked).withColumn("computed_at", F.lit(now).cast("bigint"))
        self.metrics.upsert(snapshot, stream, batch)
        if self.decisions.rows_of(stream, batch) is None:
            decided = self.tune(mine, labels, caps, applied, self.policy, now, overlays=values, **self.tuner).join(F.broadcast(asked), [*MARKET], "left_semi")
            self.decisions.upsert(decided.withColumn("at", F.lit(now).cast("bigint")), stream, batch)
        decided = self.decisions.rows_of(stream, batch)  # what was decided first stands, also where what follows is tried again
        self.overlays.upsert(tuning.tuned_values(decided).withColumn("set_at", F.lit(now).cast("bigint")), stream, batch)
        recorded = asked.select(F.lit(now).cast("bigint").alias("at"), F.lit("tuner").alias("actor"), F.lit("metrics_snapshot").alias("action"), *MARKET, F.lit("").alias("path"), F.lit("recorded").alias("decision"), F.lit(reason).alias("reason"))
        self.audit.upsert(recorded.unionByName(control.audit_rows(decided, "tuner", now)), stream, batch)

    def metrics_of(self, scores: DataFrame, labels: DataFrame, overlays: DataFrame, asked: DataFrame) -> DataFrame:
        """Precision, recall and counts of each asked market and head at the market's own thresholds."""
        long = tuning.candidate_scores(scores, [], self.policy).join(quality.by_head(labels, "label", "order_id").where("label is not null"), ["order_id", "head"])
        pairs = tuning.to_markets(long, asked).join(tuning.own_thresholds(asked, overlays, self.policy), [*MARKET, "head"])
        return quality.confusion(pairs, F.col("score") >= F.col("threshold_now"), *MARKET, "head")

    def tick(self, batch: int) -> None:
        """All markets that have scores."""
        scores, _, _ = self.load()
        self.wake(ticks(scores.where(F.trim(F.coalesce("region", F.lit(""))) != "")), batch, "scheduled_tick")


def run(feedback: DataFrame, cycle: Cycle, checkpoint: str, pause: float = PAUSE, every: str = "1 second"):
    """Starts the loop on a stream of feedback; it goes on until it is stopped. Timers need batches without rows, so these are run."""
    needed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    with states.settings(feedback.sparkSession, needed):
        return debounced(feedback, pause).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(cycle.wake).trigger(processingTime=every).start()
