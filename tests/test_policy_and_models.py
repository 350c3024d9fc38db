"""Policy merging and bounds, sampling, bundles and canaries."""

import hashlib
import json

import pytest

from tracklens.functions import policy
from tracklens.operators import models, sampling


def test_merge_bounds_and_hash():
    p = policy.merged(policy.DEFAULTS, {"dbscan": {"min_pts": 9}}, {"dbscan": {"min_pts": 11}, "theft": {"food_categories": ["X"]}})
    assert p["dbscan"]["min_pts"] == 11 and p["dbscan"]["clustering_radius_m"] == 50 and p["theft"]["food_categories"] == ["X"]
    assert policy.DEFAULTS["dbscan"]["min_pts"] == 7
    bad = policy.violations({"dbscan": {"min_pts": 31, "autoscale_min_pts": False}, "dwell": {"place_factors": {"curb": 1.0}}, "anomaly": {"mode": "off"}, "theft": {"food_categories": []}, "progress": {"x": [1]}})
    assert sorted(bad) == [("anomaly.mode", "not_numeric"), ("dbscan.min_pts", "out_of_bounds"), ("dwell.place_factors.curb", "unbounded"), ("progress.x", "list_not_allowed")]
    assert policy.policy_hash({"b": 1, "a": 2}) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    assert policy.section(policy.DEFAULTS, "selective_theft", "mode") == "shadow" and policy.section(policy.DEFAULTS, "cancel_abuse", "discount") == 0.90
    assert set(policy.BOUNDS) <= set(policy.leaves(policy.DEFAULTS))


def test_batch_sample_keeps_quota_and_caps():
    rows = [{"order_id": i, "head": policy.HEADS[i % 3], "reason": ("pattern_mass", "uncertainty", None)[i % 4 % 3]} for i in range(300)]
    got = sampling.batch_sample(rows, policy.DEFAULTS)
    assert len(got) == 50 and len({r["order_id"] for r in got}) == 50
    assert sum(r["pass"] == "pattern" for r in got) == 35
    assert max(sum(r["head"] == h for r in got) for h in policy.HEADS) <= 25


def test_bundle_and_prediction(spark, tmp_path):
    raw = json.dumps({h: [1, 0, 0, 0, 0, -1] for h in policy.HEADS}).encode()
    (tmp_path / "w.json").write_bytes(raw)
    (tmp_path / "feature_schema.json").write_text(json.dumps({"features": models.FEATURES}))
    model = {"model_id": "m", "heads": policy.HEADS, "artifact": "w.json", "sha256": hashlib.sha256(raw).hexdigest()}
    (tmp_path / "model.json").write_text(json.dumps(model))
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 0.0)], ["order_id", *models.FEATURES])
    assert models.predict(df, models.load_bundle(str(tmp_path))).first().ml_cancel_abuse == pytest.approx(0.5)
    with pytest.raises(ValueError):
        models.predict(df.drop("abuse_score"), models.load_bundle(str(tmp_path)))
    (tmp_path / "w.json").write_bytes(raw + b" ")
    with pytest.raises(ValueError):
        models.load_bundle(str(tmp_path))


def test_roles_and_canary(spark):
    r = models.set_role(spark.createDataFrame([("a", "champion"), ("b", "canary"), ("c", "shadow")], "model_id string, role string"), "b", "champion")
    assert {x.model_id: x.role for x in r.collect()} == {"a": "retired", "b": "champion", "c": "shadow"}
    live = {"status": "active", "started_at": 0}
    assert [models.canary_tick(*a) for a in ((None, True, 0, 24), (live, False, 0, 24), (live, True, 86400, 24), (live, True, 5, 24))] == ["idle", "rolled_back", "promoted", "active"]
