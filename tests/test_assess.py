"""The two golden orders: 40 pings at the pickup, every 2 minutes."""

import pytest
from pyspark.sql import functions as F

from tracklens.functions.policy import DEFAULTS
from tracklens.plans.assess import assess

START = 1704103200  # 2024-01-01 10:00


@pytest.fixture(scope="module")
def golden(spark):
    orders = spark.createDataFrame(
        [("THEFT", 1, START, START + 4800, "FOOD", 800.0, True), ("PLAIN", 2, START, START + 4800, "HAUL", 50.0, None)],
        "order_id string, track_id bigint, assign_ts bigint, cancel_ts bigint, category string, order_value double, next_driver_no_order boolean",
    )
    stop = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))
    orders = orders.withColumns({"stops": F.array(stop(14.55, 121.02), stop(14.65, 121.08)), "order_status": F.lit("CANCELLED"), "replacement_order_id": F.lit(None).cast("string"), "replacement_placed_ts": F.lit(None).cast("bigint"), "replacement_stops": F.lit(None).cast("array<struct<lat:double,lon:double>>")})
    pings = spark.createDataFrame([(t, START + 120 * i, i, 14.55 + (i % 5) * 1e-5, 121.02 + (i % 3) * 1e-5, 0.3, None) for t in (1, 2) for i in range(40)], "track_id bigint, ts bigint, seq int, lat double, lon double, speed double, heading double")
    return {r.order_id: r for r in assess(orders, pings, DEFAULTS).collect()}


def test_scores(golden):
    t, p = golden["THEFT"], golden["PLAIN"]
    assert (t.score_cancelled_offline, t.score_cancel_abuse, t.score_selective_theft) == (0.6, 0.2, 1.0)
    assert (p.score_cancelled_offline, p.score_cancel_abuse, p.score_selective_theft) == (0.6, 0.2, 0.0)
    assert (t.flag_cancelled_offline, t.flag_cancel_abuse, t.flag_selective_theft) == (0, 0, 1)
    assert (p.flag_cancelled_offline, p.flag_cancel_abuse, p.flag_selective_theft) == (0, 0, 0)


def test_reasons_stage_and_money(golden):
    t, p = golden["THEFT"], golden["PLAIN"]
    tail = ["no_replacement", "pickup_only", "heading_unavailable", "stage:at_merchant", "gps_sparse", "gps_gaps"]
    assert t.reasons == ["cancel_after_pickup", "food_category", "high_value", "next_driver_no_order", "cancel_after_pickup", *tail]
    assert p.reasons == ["cancel_after_pickup", *tail]
    assert t.cancel_stage == p.cancel_stage == "at_merchant"
    assert t.provisional and p.provisional
    assert t.attention_score == pytest.approx(1292.8) and p.attention_score == pytest.approx(32.8)
    assert (t.ear_cancel_abuse, t.ear_cancelled_offline, t.ear_selective_theft, t.ear_total) == pytest.approx((64.0, 480.0, 640.0, 1184.0))
    assert t.confidences == [1.0, 0.0] and t.min_pts == 3 and t.drop_min_pts == 5
