"""Policy: default values, market overlays, bounds and the hash of a policy."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy
from typing import Any

HEADS = ("cancelled_offline", "cancel_abuse", "selective_theft")

# Defaults of the scoring policy.
DEFAULTS: dict[str, Any] = {
    "dbscan": {"min_pts": 7, "confidence_threshold": 0.75, "clustering_radius_m": 50, "immediate_dp_radius": 150, "standard_dp_radius": 400, "extended_dp_radius": 800, "standard_discount": 0.6, "extended_discount": 0.2, "drop_off_min_pts": 30, "round_trip_gap_seconds": 3600, "autoscale_min_pts": True, "autoscale_ref_gap_seconds": 5},
    "dwell": {
        "min_dwell_seconds": 120, "max_speed_mps": 1.5, "radius_m": 80, "max_run_displacement_m": 40, "min_gap_samples": 3, "gap_seconds_min": 1, "gap_seconds_max": 30,
        "place_factors": {"unknown": 1.0, "curb": 0.85, "residential": 1.0, "apartment": 1.35, "commercial": 1.5},
        "vehicle_factors": {"unknown": 1.0, "walker": 0.55, "cycle": 0.6, "two_wheel": 0.7, "van_pickup": 1.0, "large_4w": 1.25, "box_truck": 1.45, "semi": 1.6},
    },
    "sequence": {"stop_match_radius_m": 150, "offline_weight": 1.5, "min_middle_fraction": 1.0},
    "gps": {"min_window_h": 3, "max_window_h": 24, "min_points": 20, "max_gap_minutes": 45},
    "replacement": {"max_place_delay_minutes": 180, "route_similarity_min": 0.7},
    "theft": {"high_value_amount": 500, "food_categories": ["FOOD", "FOOD_DELIVERY"], "cancel_after_pickup_bonus": 0.2, "near_dropoff_no_order_bonus": 0.15},
    "abuse": {
        "multi_cancel_window_minutes": 120, "near_dest_radius_m": 400, "chain_lookback_minutes": 120, "cancel_stats_window_minutes": 120, "cancel_after_pickup_bonus": 0.2, "no_progress_bonus": 0.2, "wrong_direction_bonus": 0.25,
        "cancel_rate_min_count": 4, "cancel_rate_threshold": 2.0, "cancel_rate_bonus": 0.15, "marketplace_min_support": 5, "accept_cancel_rate_threshold": 0.45, "accept_cancel_rate_bonus": 0.25, "completion_rate_floor": 0.40, "low_completion_rate_bonus": 0.20,
        "with_cause_fraction_floor": 0.35, "without_cause_bonus": 0.20, "pair_cancel_min": 3, "pair_density_bonus": 0.2, "multi_account_device_bonus": 0.25, "multi_user_device_bonus": 0.20, "device_hopping_bonus": 0.20, "shared_device_pair_bonus": 0.25,
    },
    "device_integrity": {"ewma_alpha": 0.4, "risk_threshold": 0.7, "abuse_bonus_scale": 0.35, "gps_dampen": 0.5},
    "device_graph": {"window_days": 30, "min_support": 3, "max_drivers_per_device": 3, "max_users_per_device": 3, "max_devices_per_driver": 4, "shared_pair_min_sightings": 1},
    "chat_signals": {"risk_threshold": 0.55, "abuse_bonus_scale": 0.40, "stall_combo_bonus": 0.15, "repeat_min_count": 3, "repeat_bonus": 0.20, "window_minutes": 10080},
    "anomaly": {"mode": "apply", "window_n": 20, "peer_window_n": 200, "min_support": 8, "z_threshold": 3.0, "epsilon": 0.001, "abuse_bonus": 0.15, "features": ["accept_cancel_rate", "cancel_rate", "cancel_abuse"]},
    "stages": {"merchant_radius_m": 150, "dropoff_radius_m": 400},
    "progress": {"window_minutes": 8, "max_heading_error_deg": 60, "away_heading_error_deg": 120, "min_points": 3, "no_progress_ratio": 0.15, "min_start_distance_m": 200},
    "gps_integrity": {"max_speed_mps": 55, "teleport_jump_m": 2000, "stop_confidence_dampen": 0.5},
    "blend": {h: {"rule_weight": 0.6, "ml_weight": 0.4} for h in HEADS},
    "thresholds": dict.fromkeys(HEADS, 0.75),
    "ear": {"mode": "shadow", "outcome_ewma_alpha": 0.05, "min_updates_apply": 5, "recoverability": {"cancelled_offline": 1.0, "cancel_abuse": 0.4, "selective_theft": 0.8}, "attention_weights": {"cancelled_offline": 1.0, "cancel_abuse": 0.7, "selective_theft": 1.2}},
    "feedback": {"daily_review_quota": 50, "inline_soft_cap_fraction": 0.6, "per_head_min": 5, "per_head_max": 25, "uncertainty_delta": 0.1},
    "baselines": {
        "mode": "apply", "window_n": 20, "pair_window_n": 8, "under_fraction": 0.9, "ewma_alpha": 0.2, "ewma_delta": 0.05, "min_ewma_samples": 10, "above_epsilon": 0.1, "above_fraction": 0.9, "discount": 0.85, "refresh_epsilon": 0.05, "max_age_days": 90,
        "heads": {"cancelled_offline": {"enabled": True}, "cancel_abuse": {"enabled": True, "discount": 0.90}, "selective_theft": {"enabled": True, "mode": "shadow"}},
    },
    "learning": {"target_precision": 0.98, "min_pattern_support": 15, "min_pattern_recall": 0.35, "pattern_mass_fraction": 0.7, "blend_search_min_support": 40, "pattern_strata": {"cancelled_offline": {"score_min": 0.85}, "cancel_abuse": {"score_min": 0.70}, "selective_theft": {"score_min": 0.70}}},
    "dbscan_retune": {"mode": "shadow", "on_tick": False, "cooldown_minutes": 1440, "min_labeled": 15, "min_recall_lift": 0.01, "cache_retention_days": 30, "holdout_fraction": 0.3, "grid": {"clustering_radius_m": [30, 40, 50, 60, 80], "min_pts": [5, 7, 9, 11, 15]}},
    "calibration": {"mode": "shadow", "on_tick": False, "min_labeled": 30, "platt_max_n": 80, "holdout_fraction": 0.3, "max_ece": 0.05, "cooldown_minutes": 1440, "ece_bins": 10},
    "routing": {"p1_attention_min": 200, "p2_attention_min": 50, "prefer_flag_order": ["selective_theft", "cancelled_offline", "cancel_abuse"]},
}

# Lowest and highest value that a market's overlay may set.
BOUNDS: dict[str, tuple[float, float]] = {
    "dbscan.min_pts": (3, 30), "dbscan.confidence_threshold": (0.5, 0.95), "dbscan.clustering_radius_m": (20, 150), "dbscan.immediate_dp_radius": (50, 300), "dbscan.standard_dp_radius": (150, 800), "dbscan.extended_dp_radius": (300, 1500),
    "dbscan.standard_discount": (0.2, 1.0), "dbscan.extended_discount": (0.05, 0.8), "dbscan.drop_off_min_pts": (5, 80), "dbscan.round_trip_gap_seconds": (600, 7200), "dbscan.autoscale_ref_gap_seconds": (1, 60),
    "dwell.min_dwell_seconds": (30, 600), "dwell.max_speed_mps": (0.5, 5.0), "dwell.radius_m": (30, 200), "dwell.max_run_displacement_m": (10, 150), "dwell.min_gap_samples": (2, 20), "dwell.gap_seconds_min": (0.2, 10), "dwell.gap_seconds_max": (5, 120),
    "sequence.stop_match_radius_m": (50, 400), "sequence.offline_weight": (0.5, 3.0), "gps.min_window_h": (1, 12), "gps.max_window_h": (3, 48), "gps.min_points": (5, 100), "gps.max_gap_minutes": (10, 180),
    "replacement.max_place_delay_minutes": (15, 720), "replacement.route_similarity_min": (0.3, 1.0), "theft.high_value_amount": (50, 10000), "abuse.multi_cancel_window_minutes": (15, 720), "abuse.near_dest_radius_m": (100, 1000), "abuse.chain_lookback_minutes": (15, 1440),
    **{f"blend.{h}.{w}": (0.0, 1.0) for h in HEADS for w in ("rule_weight", "ml_weight")},
    **{f"thresholds.{h}": (0.5, 0.95) for h in HEADS},
    "ear.outcome_ewma_alpha": (0.001, 0.5), "ear.min_updates_apply": (1, 1000),
    **{f"ear.recoverability.{h}": (0.0, 1.0) for h in HEADS},
    **{f"ear.attention_weights.{h}": (0.0, 3.0) for h in HEADS},
    "feedback.daily_review_quota": (0, 5000), "feedback.inline_soft_cap_fraction": (0.0, 1.0), "feedback.per_head_min": (0, 500), "feedback.per_head_max": (0, 2000), "feedback.uncertainty_delta": (0.01, 0.5),
    "routing.p1_attention_min": (0.0, 100000), "routing.p2_attention_min": (0.0, 100000),
}
ALLOWED_LISTS = ("theft.food_categories",)

# Precision and recall asked for at each supply/demand ratio.
OPERATING_POINT = {
    "ratio_min": 0.5, "ratio_max": 2.0,
    "peak": {"ratio": 0.8, "min_precision": 0.85, "min_recall": 0.40, "max_precision": 1.0, "max_recall": 0.70},
    "surplus": {"ratio": 1.2, "min_precision": 0.70, "min_recall": 0.50, "max_precision": 1.0, "max_recall": 1.0},
    "fallback": {"min_precision": 0.75, "min_recall": 0.50, "max_precision": 1.0, "max_recall": 1.0},
}
# What a challenger model must show.
PROMOTION = {"min_shadow_assessments": 500, "max_fp_dollar_lift": 0.0, "min_catch_lift": 0.02, "min_labeled_shadow": 0, "min_label_agreement": None, "canary_pct": 5, "canary_hours": 24}


def load(path: str) -> dict[str, Any]:
    """A policy file; anything but a mapping is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def merged(base: dict[str, Any], *overlays: dict[str, Any] | None) -> dict[str, Any]:
    """base with the overlays laid over it in turn; mappings are merged, all else is replaced."""
    out = deepcopy(base)
    for over in overlays:
        for k, v in (over or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def leaves(tree: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Dotted path to value, for everything that is no mapping."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        path = f"{prefix}{k}"
        out |= leaves(v, path + ".") if isinstance(v, dict) else {path: v}
    return out


def numbers(tree: dict[str, Any]) -> dict[str, float]:
    """The numeric leaves; truth values are none."""
    return {k: float(v) for k, v in leaves(tree).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def put(tree: dict[str, Any], path: str, value: Any) -> None:
    *way, last = path.split(".")
    for k in way:
        tree = tree.setdefault(k, {})
    tree[last] = value


def get(tree: dict[str, Any], path: str, default: Any = None) -> Any:
    for k in path.split("."):
        if not isinstance(tree, dict) or k not in tree:
            return default
        tree = tree[k]
    return tree


def violations(overlay: dict[str, Any], bounds: dict[str, tuple[float, float]] = BOUNDS) -> list[tuple[str, str]]:
    """(path, what is wrong): numbers without a bound or outside of it, lists that aren't allowed, any text."""
    out = []
    for path, v in leaves(overlay).items():
        if isinstance(v, bool):
            continue
        if isinstance(v, (int, float)):
            if path not in bounds:
                out.append((path, "unbounded"))
            elif not bounds[path][0] <= v <= bounds[path][1]:
                out.append((path, "out_of_bounds"))
        elif isinstance(v, list):
            if path not in ALLOWED_LISTS:
                out.append((path, "list_not_allowed"))
        else:
            out.append((path, "not_numeric"))
    return out


def policy_hash(policy: dict[str, Any]) -> str:
    """sha256 of the policy as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def section(policy: dict[str, Any], head: str, key: str) -> Any:
    """A baseline setting of a head, its own or the common one; an unknown mode counts as shadow."""
    cfg = policy["baselines"]
    value = cfg["heads"].get(head, {}).get(key, cfg.get(key))
    return "shadow" if key == "mode" and value not in ("off", "shadow", "apply") else value
