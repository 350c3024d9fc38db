"""Sinks that lose nothing: retried and restarted batches, aborted writes, services that fail for a while."""

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tracklens.functions.policy import DEFAULTS
from tracklens.operators.store import KEY
from tracklens.sources import gps_http
from tracklens.streaming import database, sinks


class Service(HTTPServer):
    """An HTTP service on this machine; answer(request) gives (status, body)."""

    def __init__(self, answer):
        self.asked, self.lock = [], threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def reply(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
                with self.server.lock:
                    self.server.asked.append((self.path, dict(self.headers), body))
                    status, out = answer(self.path, body, len(self.server.asked))
                self.send_response(status)
                self.end_headers()
                self.wfile.write(out.encode())

            do_GET = do_POST = reply

            def log_message(self, *args):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server_port}"
        threading.Thread(target=self.serve_forever, daemon=True).start()


ASSESSED = "order_id bigint, policy_hash string, model_version string, generation int, cancelled_offline double, cancel_abuse double, selective_theft double, assessed_at bigint, provisional boolean"


def assessed(spark, generation, *orders):
    return spark.createDataFrame([(o, "p", "m", generation, 0.9, 0.1, 0.1, 1000 + generation, False) for o in orders], ASSESSED)


def marks(spark, root):
    return {(r.order_id, r.generation, r.provisional) for r in sinks.read_keyed(spark, f"{root}/assessments", KEY).collect()}


def test_publish_again_and_after_a_failed_ledger(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    write = sinks.publish(root, sinks.jsonl(root + "-s"), sinks.jsonl(root + "-t"), DEFAULTS, 5)
    write(assessed(spark, 1, 1, 2, 3), 0)
    whole = {(1, 1, True), (2, 1, True), (3, 1, False), (1, 2, False), (2, 2, False)}

    def broken(path):
        def fail(df, n):
            raise OSError("no ledger")

        return fail

    with monkeypatch.context() as m:
        m.setattr(sinks, "ledger", broken)
        with pytest.raises(OSError):
            write(assessed(spark, 2, 1, 2), 1)
    for _ in range(2):
        write(assessed(spark, 2, 1, 2), 1)
        assert marks(spark, root) == whole
        rows = spark.read.parquet(f"{root}/ledger").where("batch_id = 1").collect()
        assert {(r.order_id, r.generation, r.provisional) for r in rows} == {(1, 1, True), (2, 1, True), (1, 2, False), (2, 2, False)} and len(rows) == 4
    write(assessed(spark, 1, 1, 2, 3), 0)  # an old batch once more
    assert marks(spark, root) == whole
    tickets = spark.read.json(root + "-t").collect()
    assert sorted(r.order_id for r in tickets) == [1, 2, 3] and {r.sampling_reason for r in tickets} == {"pattern_mass"}


def test_streams_with_new_checkpoints_lose_nothing(spark, tmp_path):
    schema = "k int, v string, assessed_at int"
    for n in range(2):
        spark.createDataFrame([(10 * n + i, f"v{n}", n) for i in range(3)], schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    sink = sinks.fanout(sinks.keyed(str(tmp_path / "t"), ("k",)), sinks.jsonl(str(tmp_path / "j")), sinks.ledger(str(tmp_path / "l")))
    for n, checkpoint in ((0, "a"), (1, "b"), (1, "b")):  # two streams, the second started again
        live = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n}"))
        live.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(60)
    assert sinks.read_keyed(spark, str(tmp_path / "t"), ("k",)).count() == 6
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "l")).count() == 6


def test_http_sink_sends_again_with_the_same_key(spark):
    service = Service(lambda path, body, n: (503 if n <= 2 else 200, ""))
    df = spark.createDataFrame([(i, f"ä{i}") for i in range(25)], "k int, v string").coalesce(1)
    sinks.http(service.url, "secret", rows=10, wait=0.01)(df, 7)
    good = service.asked[2:]
    assert [len(json.loads(b)) for _, _, b in good] == [10, 10, 5] and {x["k"] for _, _, b in good for x in json.loads(b)} == set(range(25))
    keys = [h["Idempotency-Key"] for _, h, _ in service.asked]
    assert keys[0] == keys[1] == keys[2] and len(set(keys)) == 3 and all(h["X-Api-Key"] == "secret" for _, h, _ in service.asked)
    service.shutdown()
    down = Service(lambda path, body, n: (500, ""))
    with pytest.raises(Exception):
        sinks.http(down.url, rows=10, tries=2, wait=0.01)(df, 8)
    seen = []
    sinks.fanout(sinks.http(down.url, tries=1), lambda d, n: seen.append(d.count()))(df, 9)
    assert seen == [25]
    down.shutdown()


def rows_of(path, sql):
    with sqlite3.connect(path) as db:
        return sorted(db.execute(sql).fetchall())


def test_database_merges_each_batch_once(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    schema = "k bigint, v string, assessed_at bigint"
    put = lambda rows, stream, batch: database.upserted(spark.createDataFrame(rows, schema).repartition(2), "sqlite3", path, "t", ("k",), "assessed_at", stream, batch)
    put([(1, "a", 1), (2, "b", 1), (2, "c", 2)], "s", 0)
    put([(2, "d", 3), (3, "it's ?", 3)], "s", 1)
    put([(2, "not again", 9)], "s", 1)
    put([(4, "e", 1)], "another", 1)
    want = [(1, "a", 1), (2, "d", 3), (3, "it's ?", 3), (4, "e", 1)]
    assert rows_of(path, "select * from t") == want
    broken = spark.range(4).select(F.col("id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("v"), F.lit(5).cast("bigint").alias("assessed_at")).repartition(3)
    with pytest.raises(Exception):
        broken.write.format("database_upsert").options(module="sqlite3", dsn=path, table="t", key="k", stream="s", batch="2").mode("append").save()
    assert rows_of(path, "select * from t") == want and rows_of(path, "select * from t_staging") == []
    put([(1, "after", 5)], "s", 2)
    assert rows_of(path, "select v from t where k = 1") == [("after",)] and len(rows_of(path, "select * from t_batches")) == 4


def test_rows_that_nobody_reports_are_not_merged(spark, tmp_path):
    """A second attempt of a task writes under its own mark; only what is reported counts."""
    path = str(tmp_path / "d.sqlite")
    schema = spark.createDataFrame([], "k bigint, v string").schema
    writer = database.UpsertWriter(schema, {"module": "sqlite3", "dsn": path, "table": "t", "key": "k", "stream": "s", "batch": "0"})
    with sqlite3.connect(path) as db:
        db.execute("insert into t_staging values (?, ?, 1, 'lost attempt')", (writer.run, "x"))
        db.execute("insert into t_staging values (?, ?, 1, 'reported')", (writer.run, "y"))
    writer.commit([database.Written("y", 1), None])
    assert rows_of(path, "select * from t") == [(1, "reported")] and rows_of(path, "select * from t_staging") == []
    with sqlite3.connect(path) as db:
        db.execute("insert into t_staging values (?, ?, 2, 'aborted')", (writer.run, "z"))
    writer.abort([])
    assert rows_of(path, "select * from t") == [(1, "reported")] and rows_of(path, "select * from t_staging") == []


def gps(path, body, n):
    """Points of a driver every 600 s, at both ends too; odd fields now and then."""
    q = parse_qs(urlparse(path).query)
    driver = int(path.split("/")[3])
    start, end = (gps_http.seconds(q[k][0]) for k in ("start", "end"))
    points = [{"lat": 1.5, "lon": driver, "ts": gps_http.iso(t), **({"speed": 3} if t % 1200 else {"speed_mps": 2.5, "course": 90})} for t in range(start - start % 600, end + 1, 600) if t >= start]
    return 200, json.dumps([*points, {"lat": 1.0, "lon": 2.0, "ts": ""}, {"lat": None, "lon": 2.0, "ts": gps_http.iso(start)}])


def test_gps_source_pushes_filters_and_tries_again(spark):
    failed = set()

    def answer(path, body, n):
        if path not in failed and n % 3 == 0:
            failed.add(path)
            return 503, ""
        return gps(path, body, n)

    service = Service(answer)
    gps_http.register(spark)
    read = spark.read.format("gps_http").options(url=service.url, api_key="k", slice="3600", drivers_a_task="2", wait="0.01").load()
    df = read.where("driver_id in (7, 8, 9) and ts >= 7200 and ts < 14400 and speed > 2.6")
    got = {(r.driver_id, r.ts, r.speed) for r in df.collect()}
    assert got == {(d, t, 3.0) for d in (7, 8, 9) for t in range(7200, 14400, 600) if t % 1200}
    asked = {(int(p.split("/")[3]), gps_http.seconds(parse_qs(urlparse(p).query)["start"][0]), gps_http.seconds(parse_qs(urlparse(p).query)["end"][0])) for p, _, _ in service.asked}
    assert asked == {(d, t, t + 3600) for d in (7, 8, 9) for t in (7200, 10800)} and all(h["X-Api-Key"] == "k" for _, h, _ in service.asked)
    assert read.where("driver_id = 7 and ts between 600 and 1200").select("ts", "heading").orderBy("ts").collect() == [(600, None), (1200, 90.0)]
    with pytest.raises(Exception):
        read.where("ts > 10").collect()
    asks = spark.createDataFrame([(5, 0, 1300), (5, 0, 1300), (6, 600, 601), (6, 5, 5), (None, 0, 9)], "driver_id bigint, start bigint, end bigint")
    got = sorted((r.driver_id, r.ts) for r in gps_http.fetch_tracks(asks, gps_http.Service(service.url, wait=0.01)).collect())
    assert got == [(5, 0), (5, 600), (5, 1200), (6, 600)]
    service.shutdown()


def test_gps_answers_that_fail(spark):
    service = Service(lambda path, body, n: (404, "") if "/1/" in path else (200, "{}"))
    for driver in (1, 2):
        with pytest.raises(Exception):
            list(gps_http.Service(service.url, wait=0.01).points(driver, 0, 10))
    assert len(service.asked) == 2
    service.shutdown()


def test_gps_stream(spark, tmp_path):
    service = Service(gps)
    gps_http.register(spark)
    for end in (3600, 7200):  # the second run goes on where the first ended
        live = spark.readStream.format("gps_http").options(url=service.url, drivers="3,4", start="0", end=str(end), lag="0").load()
        live.writeStream.foreachBatch(sinks.ledger(str(tmp_path / "l"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "l")).count() == 2 * end // 600
    service.shutdown()
