"""Sinks for batches and streams. A sink is a function of (DataFrame, batch id), as foreachBatch wants it.

What a batch writes is known by its stream and its number: a batch that is tried again replaces its own files, or
leaves alone what it has done. A stream's id stays with its checkpoint; a stream with a new checkpoint is
another one, though its numbers start from 0 again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import KeptTable, stream_id

Sink = Callable[[DataFrame, int], None]
log = logging.getLogger(__name__)


def jsonl(path: str) -> Sink:
    """One JSON line a row, in a folder for each stream and batch."""
    return lambda df, n: df.write.mode("overwrite").json(f"{path}/stream={stream_id(df.sparkSession)}/batch_id={n}")


def ledger(path: str) -> Sink:
    """Every row ever written, with its stream and batch."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/stream={stream_id(df.sparkSession)}/batch_id={n}")


def http(url: str, api_key: str = "", rows: int = 100, tries: int = 3, wait: float = 0.5, timeout: float = 5.0) -> Sink:
    """Posts JSON lists of at most `rows` rows from the tasks, each with a key (stream, batch, task, place) that stays when it's sent again.

    A post that fails is tried again after a wait that doubles; when the last fails the task does, and with it the batch:
    within fanout() that is logged and stops nobody else.
    """

    def write(df: DataFrame, n: int) -> None:
        own = f"{stream_id(df.sparkSession)}-{n}"

        def post(batches):
            import json
            import time
            import urllib.request

            place, held = 0, []

            def send() -> None:
                nonlocal place
                headers = {"Content-Type": "application/json", "Idempotency-Key": f"{own}-{TaskContext.get().partitionId()}-{place}"} | ({"X-API-Key": api_key} if api_key else {})
                for k in range(tries):
                    try:
                        urllib.request.urlopen(urllib.request.Request(url, f"[{','.join(held)}]".encode(), headers), timeout=timeout).close()
                        break
                    except OSError:
                        if k == tries - 1:
                            raise
                        time.sleep(wait * 2**k)
                place += 1
                held.clear()

            for r in batches:
                json.loads(r.value)
                held.append(r.value)
                if len(held) >= rows:
                    send()
            if held:
                send()

        df.select(F.to_json(F.struct(*df.columns)).alias("value")).foreachPartition(post)

    return write


def fanout(*sinks: Sink) -> Sink:
    """Every sink gets the batch, computed once; one that fails is logged and doesn't stop the others."""

    def write(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                try:
                    sink(df, n)
                except Exception:
                    log.exception("a sink failed on batch %s", n)
        finally:
            df.unpersist()

    return write


def keyed(root: str, key: tuple[str, ...], at: str | None = "assessed_at") -> Sink:
    """Keyed upsert into a kept table: a batch that is in it already changes nothing."""

    def write(df: DataFrame, n: int) -> None:
        KeptTable(df.sparkSession, root, key, at).upsert(df, stream_id(df.sparkSession), n)

    return write


def publish(root: str, stream: Sink, tickets: Sink | None = None, policy: dict[str, Any] | None = None, now: int = 0) -> Sink:
    """Publishes assessments in order: earlier generations are marked provisional, the table and its ledger are written, then the stream; then tickets are made.

    A batch has one outcome, however often it is tried: marks are made against the table as it was before the batch. A failure of
    the table or the ledger fails the batch; later ones are logged and swallowed. Tickets need a policy and the columns
    that they are sampled by (see sampling.inline_samples()); their sink gets the ones that are new, and root/tickets keeps them.
    """
    from ..operators.store import KEY, mark_provisional

    def write(df: DataFrame, n: int) -> None:
        spark, own = df.sparkSession, stream_id(df.sparkSession)
        table = KeptTable(spark, f"{root}/assessments", KEY, "assessed_at")
        if table.rows_of(own, n) is None and n > table.version().done.get(own, -1):
            asked = df.groupBy("order_id").agg(F.max("generation").alias("generation"))
            old = table.read(having=asked.select("order_id"))
            table.upsert(df if old is None else df.unionByName(mark_provisional(old, asked)), own, n)
        wrote = table.rows_of(own, n)  # the ledger takes what the table took; once compacted it is complete
        if wrote is not None:
            ledger(f"{root}/ledger")(wrote, n)
        later = [stream]
        if tickets is not None and policy is not None:
            later.append(lambda rows, k: ticketed(rows, k, f"{root}/tickets", policy, now, tickets))
        fanout(*later)(df, n)

    return write


def ticketed(df: DataFrame, n: int, root: str, policy: dict[str, Any], now: int, stream: Sink) -> None:
    """Makes tickets of a batch's assessments, keeps them under root and sends the new ones on.

    A retry finds its own tickets kept and sends the same ones. An order has one ticket, and a day no more than its soft cap.
    """
    from ..operators.control import day_counts, new_tickets
    from ..operators.sampling import inline_samples

    own = stream_id(df.sparkSession)
    kept = KeptTable(df.sparkSession, root, ("order_id", "day"))
    if kept.rows_of(own, n) is None:
        before = kept.read()
        if before is None:
            before = df.sparkSession.createDataFrame([], df.select("order_id").schema).withColumns({"day": F.lit(""), "status": F.lit("")})
        fresh = df.join(before.select("order_id").distinct(), "order_id", "left_anti")  # an order is asked about once
        kept.upsert(new_tickets(inline_samples(fresh, policy, day_counts(before)), before, now), own, n)
    mine = kept.rows_of(own, n)
    if mine is not None:
        stream(mine, n)


def read_keyed(spark, root: str, key: tuple[str, ...], at: str | None = "assessed_at", version: int | None = None) -> DataFrame | None:
    return KeptTable(spark, root, key, at).read(version)
