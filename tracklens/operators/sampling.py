"""Review sampling: why an assessment is worth a look, and which ones fit the day's quota."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import day_key
from ..functions.policy import HEADS
from ..functions.scoring import score_band

#: Ticket priorities by reason.
PRIORITY = {"disagreement": 100, "pattern_mass": 90, "uncertainty": 80, "bias_fp": 70, "bias_fn": 70, "quota_fill": 10}


def in_pattern(head: str, policy: dict[str, Any], score: Column, reasons: Column | None = None) -> Column:
    """Whether an assessment is of a head's common pattern: a high score, or a telling reason."""
    s = policy["learning"]["pattern_strata"].get(head)
    if s is None:
        return F.lit(False)
    hit = score >= float(s["score_min"]) if "score_min" in s else F.lit(False)
    if reasons is not None and s.get("reason_any"):
        hit = hit | F.arrays_overlap(reasons, F.array(*map(F.lit, s["reason_any"])))
    return F.coalesce(hit, F.lit(False))


def pattern_heads(policy: dict[str, Any], scores: dict[str, Column], reasons: Column | None = None) -> Column:
    """The heads whose pattern an assessment is of, in their order."""
    return F.array_compact(F.array(*(F.when(in_pattern(h, policy, scores[h], reasons), F.lit(h)) for h in HEADS)))


def with_strata(policy: dict[str, Any], strata: dict[str, Any]) -> dict[str, Any]:
    """policy with pattern strata given for some heads: a given one takes the whole place of the head's own; unknown heads are left out."""
    own = policy["learning"]["pattern_strata"] | {h: dict(v) for h, v in strata.items() if h in HEADS and isinstance(v, dict)}
    return policy | {"learning": policy["learning"] | {"pattern_strata": own}}


def inline_reason(df: DataFrame, policy: dict[str, Any], rule: str | None = None, ml: str | None = None, bias: dict[str, str] | None = None) -> DataFrame:
    """df (a score column a head) with ticket_reason, ticket_head and priority, null where there is no reason.

    rule, ml: prefixes of rule and model columns, where there are any. Disagreement goes before a common pattern,
    that before closeness to the threshold, that before a known bias; of several heads the first, of close ones the closest.
    """
    t = {h: float(policy["thresholds"].get(h, 0.75)) for h in HEADS}
    delta = float(policy["feedback"]["uncertainty_delta"])
    none = F.lit(None).cast("string")
    apart = F.coalesce(*(F.when(F.col(ml + h).isNotNull() & ((F.col(rule + h) >= t[h]) != (F.col(ml + h) >= t[h])), h) for h in HEADS)) if rule and ml else none
    reasons = F.col("reasons") if "reasons" in df.columns else None
    mass = F.coalesce(*(F.when(in_pattern(h, policy, F.col(h), reasons), h) for h in HEADS))
    near = F.array_min(F.filter(F.array(*(F.struct(F.abs(F.col(h) - t[h]).alias("d"), F.lit(h).alias("h")) for h in HEADS)), lambda x: x["d"] <= delta))["h"]
    hints = [F.when(F.col(h) >= t[h] if (bias or {}).get(h) == "bias_fp" else F.col(h) < t[h], F.struct(F.lit((bias or {})[h]).alias("r"), F.lit(h).alias("h"))) for h in HEADS if (bias or {}).get(h) in ("bias_fp", "bias_fn")]
    hint = F.coalesce(*hints) if hints else F.lit(None).cast("struct<r:string,h:string>")
    reason = F.when(apart.isNotNull(), "disagreement").when(mass.isNotNull(), "pattern_mass").when(near.isNotNull(), "uncertainty").otherwise(hint["r"])
    table = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return df.withColumns({"ticket_reason": reason, "ticket_head": F.coalesce(apart, mass, near, hint["h"])}).withColumn("priority", table[F.col("ticket_reason")])


def inline_tickets(reasoned: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """The day's tickets under the soft cap, in order of time; an order has one ticket a day."""
    f = policy["feedback"]
    cap = int(f["daily_review_quota"] * f["inline_soft_cap_fraction"])
    once = Window.partitionBy("order_id", "day").orderBy("ts")
    day = Window.partitionBy("day").orderBy("ts", "order_id")
    rows = reasoned.where("ticket_reason is not null").withColumn("_o", F.row_number().over(once)).where("_o = 1")
    return rows.withColumn("_n", F.row_number().over(day)).where(F.col("_n") <= cap).drop("_o", "_n")


def inline_samples(assessed: DataFrame, policy: dict[str, Any], taken: DataFrame | None = None) -> DataFrame:
    """What control.new_tickets() makes tickets of: the day's samples of assessments (order_id, assessed_at, a score a head, region and city where there are any).

    taken: (day, n) of tickets that the day has already; they count for its soft cap.
    """
    f = policy["feedback"]
    own = assessed.withColumns({c: F.col(c) if c in assessed.columns else F.lit(None).cast("string") for c in ("region", "city")})
    rows = inline_reason(own, policy).where("ticket_reason is not null").withColumn("day", day_key(F.col("assessed_at")))
    once = Window.partitionBy("order_id", "day").orderBy("assessed_at", F.col("priority").desc(), "ticket_head")
    rows = rows.withColumn("_o", F.row_number().over(once)).where("_o = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy("assessed_at", "order_id")))
    had = F.lit(0)
    if taken is not None:
        rows, had = rows.join(taken.select("day", F.col("n").alias("_had")), "day", "left"), F.coalesce("_had", F.lit(0))
    rows = rows.where(F.col("_n") + had <= int(f["daily_review_quota"] * f["inline_soft_cap_fraction"]))
    return rows.select("order_id", "region", "city", F.array("ticket_head").alias("heads"), F.col("ticket_reason").alias("sampling_reason"), "priority", "day")


def unlabelled(candidates: DataFrame, labels: DataFrame, tickets: DataFrame) -> DataFrame:
    """Candidates without a label and without a ticket."""
    return candidates.join(labels.select("order_id"), "order_id", "left_anti").join(tickets.select("order_id"), "order_id", "left_anti")


def bias_hints(metrics: DataFrame) -> DataFrame:
    """Hint of each head's newest metrics row (head, computed_at, precision, recall, fp, fn, support)."""
    w = Window.partitionBy("head").orderBy(F.col("computed_at").desc())
    new = metrics.withColumn("_n", F.row_number().over(w)).where("_n = 1 and support >= 5")
    return new.select("head", F.when((F.col("precision") < 0.7) & (F.col("fp") > 0), "bias_fp").when((F.col("recall") < 0.5) & (F.col("fn") > 0), "bias_fn").alias("hint")).where("hint is not null")


def batch_sample(candidates: list[dict[str, Any]], policy: dict[str, Any], taken: int = 0) -> list[dict[str, Any]]:
    """The day's batch, greedily: the pattern's share first, then other reasons, then each head's floor, then up to its cap.

    candidates: at most a few hundred rows (order_id, heads it stands for by reason, priority), already cut down by the
    plans above; the choice of each row depends on the ones before it, so it is made on the driver.
    """
    f = policy["feedback"]
    left = int(f["daily_review_quota"]) - taken
    count = dict.fromkeys(HEADS, 0)
    out: list[dict[str, Any]] = []
    used: set[Any] = set()

    def take(row: dict[str, Any], why: str) -> None:
        nonlocal left
        out.append(row | {"pass": why})
        used.add(row["order_id"])
        count[row["head"]] += 1
        left -= 1

    mass = round(float(policy["learning"]["pattern_mass_fraction"]) * max(0, left))
    for row in candidates:
        if mass > 0 and left > 0 and row["reason"] == "pattern_mass" and row["order_id"] not in used and count[row["head"]] < int(f["per_head_max"]):
            take(row, "pattern")
            mass -= 1
    for row in candidates:
        if left > 0 and row["reason"] not in (None, "pattern_mass") and row["order_id"] not in used and count[row["head"]] < int(f["per_head_max"]):
            take(row, "reason")
    for least, why in ((int(f["per_head_min"]), "floor"), (int(f["per_head_max"]), "fill")):
        while left > 0:
            open_ = [(count[h], k, r) for k, h in enumerate(HEADS) for r in candidates if r["head"] == h and r["order_id"] not in used and count[h] < least]
            if not open_:
                break
            take(min(open_, key=lambda x: (x[0], x[1]))[2], why)
    return out


def bands(df: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """band_<head>: low, mid or high against the head's threshold."""
    delta = float(policy["feedback"]["uncertainty_delta"])
    return df.withColumns({f"band_{h}": score_band(F.col(h), float(policy["thresholds"][h]), delta) for h in HEADS})
