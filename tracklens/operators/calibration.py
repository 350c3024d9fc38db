"""Score calibration: Platt's sigmoid for few labels, isotonic regression for more, by Spark's own learners."""

from __future__ import annotations

from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality


def fit_platt(pairs: DataFrame) -> tuple[float, float] | None:
    """Slope and offset of (score, label); None without both classes. The penalty is 1 / n on the slope alone."""
    n, y = pairs.agg(F.count(F.lit(1)), F.avg(F.col("label").cast("double"))).first()
    if not n or y in (0.0, 1.0):
        return None
    x = pairs.select(array_to_vector(F.array(F.col("score").cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    m = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=100).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def fit_isotonic(pairs: DataFrame) -> tuple[list[float], list[float]]:
    """Thresholds and values of a rising fit; between them values are interpolated, outside they stay."""
    x = pairs.select(F.col("score").cast("double").alias("features"), F.col("label").cast("double").alias("label"))
    m = IsotonicRegression(isotonic=True).fit(x)
    return [float(v) for v in m.boundaries.toArray()], [float(v) for v in m.predictions.toArray()]


def fit(pairs: DataFrame, policy: dict[str, Any]) -> list[dict[str, Any]]:
    """A decision for each head: fitted (with method, parameters and holdout error), or why not. Heads are three; rows stay distributed."""
    c = policy["calibration"]
    least = max(int(c["min_labeled"]), int(policy["learning"]["min_pattern_support"]))
    split = quality.holdout_split(pairs, float(c["holdout_fraction"])).persist()
    out = []
    for head, n in sorted((r[0], r[1]) for r in split.groupBy("head").count().collect()):
        own = split.where(F.col("head") == head)
        base = {"head": head, "n": n, "method": None, "a": None, "b": None, "xs": None, "ys": None, "ece": None}
        if n < least:
            out.append(base | {"decision": "insufficient_pattern_labels"})
            continue
        train, held = own.where("not holdout"), own.where("holdout")
        fitted: dict[str, Any] = {}
        if train.count() < int(c["platt_max_n"]):
            ab = fit_platt(train)
            if ab:
                fitted = {"method": "platt", "a": ab[0], "b": ab[1]}
        else:
            xs, ys = fit_isotonic(train)
            fitted = {"method": "isotonic", "xs": xs, "ys": ys}
        if not fitted:
            out.append(base | {"decision": "fit_failed"})
            continue
        from ..functions.scoring import calibrated

        lit = lambda k, kind: F.lit(fitted.get(k)).cast(kind)
        done = held.withColumn("score", calibrated(F.col("score"), F.lit(fitted["method"]), lit("a", "double"), lit("b", "double"), F.array(*map(F.lit, fitted.get("xs") or [0.0])), F.array(*map(F.lit, fitted.get("ys") or [0.0]))))
        ece = quality.calibration_error(done, int(c["ece_bins"]), "head").first()
        error = ece["ece"] if ece else None
        good = error is not None and error <= float(c["max_ece"])
        out.append(base | fitted | {"ece": error, "decision": "ece_ok" if good else "high_ece"})
    split.unpersist()
    return out
