"""Streams and sinks against their batch forms, and the CSV readers."""

from pyspark.sql import functions as F

from tracklens.operators import history
from tracklens.sources import fixtures, readers
from tracklens.streaming import sinks, streams

DATA = "/root/testdata/sf0.001"


def test_moving_average_equals_the_batch_fold(spark, tmp_path):
    rows = fixtures.device_risks(spark, DATA).select("device_id", F.col("event_id").alias("id"), "ts", "risk")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.start(streams.moving_average(live, "device_id", "risk", 0.4), sinks.jsonl(str(tmp_path / "out")), str(tmp_path / "c")).awaitTermination(120)
    got = {int(r.key): (round(r.value, 9), r.n) for r in spark.read.json(str(tmp_path / "out")).collect()}
    want = {r.device_id: (round(r.value, 9), r.n) for r in history.folded(rows, ["device_id"], "risk", 0.4, order=("ts", "id")).collect()}
    assert got == want


def test_windows_run(spark, tmp_path):
    rows = fixtures.funnel(spark, DATA)
    rows.write.parquet(str(tmp_path / "in"))
    for k, f in enumerate((streams.tumbling_funnel, streams.session_funnel)):
        live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streams.start(f(live), sinks.jsonl(str(tmp_path / f"out{k}")), str(tmp_path / f"c{k}"), "append").awaitTermination(120)
        assert spark.read.json(str(tmp_path / f"out{k}")).count() > 0


def test_fanout_goes_on_after_a_failure_and_upserts(spark, tmp_path):
    def broken(df, n):
        raise RuntimeError

    root = str(tmp_path / "t")
    write = sinks.fanout(broken, sinks.keyed(root, ("k",)), sinks.ledger(str(tmp_path / "l")))
    write(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, assessed_at int"), 0)
    write(spark.createDataFrame([(1, "c", 2)], "k int, v string, assessed_at int"), 1)
    assert {(r.k, r.v) for r in sinks.read_keyed(spark, root, ("k",)).collect()} == {(1, "c"), (2, "b")}
    assert spark.read.parquet(str(tmp_path / "l")).count() == 3


def test_csv_orders(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_display_id,driver_id,cancel_ts,assign_ts,latlong,path_point_num,order_status,category,order_value,currency,next_driver_no_order,label_cancel_abuse\nA,7,2024-01-01 11:20:00,2024-01-01T10:00:00Z,14.5|121.0,1,CANCELLED,FOOD,12.5,PHP,yes,\n")
    r = readers.read_orders(spark, str(tmp_path / "o.csv")).first()
    assert (r.order_id, r.assign_ts, r.cancel_ts, r.order_value, r.next_driver_no_order, r.label_cancel_abuse) == ("A", 1704103200, 1704108000, 12.5, True, None)
    assert [(s.lat, s.lon) for s in r.stops] == [(14.5, 121.0)] and r.n_reassign == 0
