"""Label quality: confusion rows, holdout splits, calibration error, promotion and fill reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import hash_share
from ..functions.policy import HEADS
from ..functions.scoring import ratio


def by_head(df: DataFrame, value: str, *keep: str, prefix: str = "") -> DataFrame:
    """One row a head: keep, head and the head's column (prefix + head) as value; narrow."""
    pairs = F.array(*(F.struct(F.lit(h).alias("head"), F.col(prefix + h).alias(value)) for h in HEADS))
    return df.select(*keep, F.inline(pairs))


def labelled(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """order_id, head, score, label (0 or 1) of every labelled head, with the score columns' own extras."""
    extra = [c for c in scores.columns if c not in (*HEADS, "order_id")]
    s = by_head(scores, "score", "order_id", *extra)
    return s.join(by_head(labels, "label", "order_id").where("label is not null"), ["order_id", "head"])


def in_market(df: DataFrame, region: str = "", city: str = "") -> DataFrame:
    """Rows of a market; an empty code stands for all."""
    from ..functions.geo import market

    for name, code in (("region", region), ("city", city)):
        if code:
            df = df.where(market(F.col(name)) == code.strip().upper())
    return df


def resolved_score(score: Column, raw: Column, rule: Column, ml: Column, blend: dict[str, float] | None) -> Column:
    """The score that tuning looks at: rule and model blended anew where weights are given, else the raw score, else the stored one."""
    if blend:
        w, m = float(blend["rule_weight"]), float(blend["ml_weight"])
        return F.when(ml.isNull() | F.lit(m <= 0 or w + m <= 0), rule).otherwise((w * rule + m * ml) / (w + m if w + m > 0 else 1.0))
    return F.coalesce(raw, score)


def threshold_of(head: Column, thresholds: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in thresholds.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, head), F.lit(1.0))


def confusion(pairs: DataFrame, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, support, flag_rate of each group; 0 where there is nothing to divide by."""
    n = lambda p, y: F.sum(F.when(predicted.cast("boolean") == F.lit(p), F.when(F.col("label") == y, 1).otherwise(0)).otherwise(0)).cast("bigint")
    g = pairs.groupBy(*by).agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(False, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    g = g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "support": tp + fn, "flag_rate": ratio(tp + fp, tp + fp + fn + tn)})
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", ratio(2 * p * r, p + r))


def holdout_split(df: DataFrame, fraction: float, key: str = "order_id") -> DataFrame:
    """df with `holdout`, by the hash of the key. If no row would be left for training, none is held out."""
    f = min(0.9, max(0.0, fraction))
    out = df.withColumn("holdout", hash_share(F.col(key)) / float(0xFFFFFFFF) < f)
    trains = out.agg(F.coalesce(F.bool_or(~F.col("holdout")), F.lit(False)).alias("_trains"))  # one row
    return out.crossJoin(F.broadcast(trains)).withColumn("holdout", F.col("holdout") & F.col("_trains")).drop("_trains")


def calibration_bins(pairs: DataFrame, bins: int, *by: str) -> DataFrame:
    """n, confidence and accuracy of each of `bins` equal score intervals; 1.0 is in the last."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))


def calibration_error(pairs: DataFrame, bins: int, *by: str) -> DataFrame:
    """Expected calibration error of each group."""
    t = calibration_bins(pairs, bins, *by).withColumn("gap", F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return t.groupBy(*by).agg((F.sum("gap") / F.sum("n")).alias("ece"), F.sum("n").cast("bigint").alias("n"))


def predictors(pairs: DataFrame) -> DataFrame:
    """Each pair three times: as flagged, always flagged and never."""
    return pairs.withColumn("p", F.explode(F.array(F.struct(F.lit("model").alias("predictor"), F.col("flag").alias("guess")), F.struct(F.lit("always").alias("predictor"), F.lit(True).alias("guess")), F.struct(F.lit("never").alias("predictor"), F.lit(False).alias("guess"))))).select("*", "p.*").drop("p")


def floor_violations(report: DataFrame, floors: DataFrame) -> DataFrame:
    """Rows of the report (head, precision, recall) below their floor (head, min_precision, min_recall); a missing head violates too."""
    j = floors.join(report, "head", "left")
    bad = F.col("precision").isNull() | (F.col("precision") < F.col("min_precision")) | (F.col("recall") < F.col("min_recall"))
    return j.where(bad).select("head", "precision", "recall", "min_precision", "min_recall")


def promotion(pairs: DataFrame, gates: dict[str, Any]) -> DataFrame:
    """One row: money that challenger or champion flag alone or at all, catch lift, label agreement, blockers and whether it is ready.

    pairs: order_id, head, champion, challenger (truth values), order_value and maybe label. An order agrees with its
    labels if the challenger does on every labelled head.
    """
    if "label" not in pairs.columns:
        pairs = pairs.withColumn("label", F.lit(None).cast("int"))
    judged = pairs.where("label is not null").groupBy("order_id").agg(F.min((F.col("challenger") == (F.col("label") == 1)).cast("int")).alias("ok")).agg(F.count(F.lit(1)).alias("labelled"), F.avg("ok").alias("agreement"))
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("order_value"))), F.lit(0.0))
    new, old = F.col("challenger"), F.col("champion")
    g = pairs.agg(F.countDistinct("order_id").cast("bigint").alias("assessed"), money(new & ~old).alias("challenger_only"), money(old & ~new).alias("champion_only"), money(new).alias("challenger_caught"), money(old).alias("champion_caught"))
    g = g.withColumn("catch_lift", ratio(F.col("challenger_caught") - F.col("champion_caught"), F.col("champion_caught"))).crossJoin(judged)  # one row each
    agree = gates["min_label_agreement"]
    block = F.array_compact(
        F.array(
            F.when(F.col("assessed") < int(gates["min_shadow_assessments"]), "min_shadow_assessments"),
            F.when(F.col("challenger_only") > F.col("champion_only") * (1 + float(gates["max_fp_dollar_lift"])), "fp_dollar_lift"),
            F.when(F.col("catch_lift") < float(gates["min_catch_lift"]), "catch_lift"),
            F.when(F.col("labelled") < int(gates["min_labeled_shadow"]), "min_labeled_shadow"),
            F.when(F.col("agreement") < (0.0 if agree is None else float(agree)), "label_agreement"),
        )
    )
    return g.withColumn("blockers", block).withColumn("ready", F.size("blockers") == 0)


def fill_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that have each column; blanks and `unknown` count as missing."""
    known = lambda c: F.when(F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin("", "unknown"), 0.0).otherwise(1.0)
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(known(c)).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col("n").alias("n"), F.coalesce(F.col(c), F.lit(0.0)).alias("share")) for c in columns))))


def dwell_nudges(df: DataFrame, factors: dict[str, float], least: int = 10, rate: float = 0.25) -> DataFrame:
    """For each place class of (place_class, flag, label): error rates and the dwell factor they suggest; unknown places teach none."""
    df = df.withColumn("place_class", F.coalesce(F.nullif(F.trim("place_class"), F.lit("")), F.lit("unknown")))
    g = df.groupBy("place_class").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("flag") & (F.col("label") == 0), 1.0).otherwise(0.0)).alias("fp_rate"), F.avg(F.when(~F.col("flag") & (F.col("label") == 1), 1.0).otherwise(0.0)).alias("fn_rate"))
    table = F.create_map(*(F.lit(x) for k, v in factors.items() for x in (k, float(v))))
    now = F.coalesce(F.try_element_at(table, F.col("place_class")), F.lit(1.0))
    up, down = (F.col("fp_rate") >= rate) & (F.col("fp_rate") > F.col("fn_rate")), (F.col("fn_rate") >= rate) & (F.col("fn_rate") > F.col("fp_rate"))
    least_ = (F.col("n") >= least) & (F.col("place_class") != "unknown")
    move = F.when(least_ & up, now * 1.1).when(least_ & down, now * 0.9).otherwise(now)
    return g.withColumns({"factor": now, "suggested": F.bround(F.least(F.lit(2.0), F.greatest(F.lit(0.5), move)), 3)})
