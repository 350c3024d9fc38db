"""Models: bundles with a checksum, roles, serving by cohort, and the canary's life."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import hash_share
from ..functions.policy import HEADS

FEATURES = ("stop_confidence", "sequence_score", "dwell_fraction", "abuse_score", "theft_score")


def load_bundle(folder: str) -> dict[str, Any]:
    """A model's description and weights; a wrong checksum, head list or unknown feature is an error.

    model.json: heads, artifact (a file of weights a head, one for each feature and the offset) and its sha256.
    """
    root = Path(folder)
    model = json.loads((root / "model.json").read_text())
    features = json.loads((root / "feature_schema.json").read_text())["features"]
    raw = (root / model["artifact"]).read_bytes()
    if hashlib.sha256(raw).hexdigest() != model["sha256"]:
        raise ValueError("the artifact's checksum differs")
    if tuple(model["heads"]) != HEADS:
        raise ValueError(f"heads must be {HEADS}")
    if not set(features) <= set(FEATURES):
        raise ValueError(f"unknown features: {sorted(set(features) - set(FEATURES))}")
    return {"model_id": model["model_id"], "features": features, "weights": json.loads(raw)}


def predict(df: DataFrame, bundle: dict[str, Any], prefix: str = "ml_") -> DataFrame:
    """df with a probability a head (logistic in the features, cut to 0..1); a missing feature column is an error."""
    for f in bundle["features"]:
        if f not in df.columns:
            raise ValueError(f"missing feature {f}")

    def one(head: str) -> Column:
        *w, offset = bundle["weights"][head]
        x = sum((F.col(f).cast("float").cast("double") * float(a) for f, a in zip(bundle["features"], w, strict=True)), F.lit(float(offset)))
        return 1 / (1 + F.exp(-x))

    return df.withColumns({prefix + h: one(h) for h in HEADS})


def in_cohort(key: Column, percent: int) -> Column:
    return hash_share(key) % 100 < percent


def serving(df: DataFrame, champion: str, challenger: str | None, percent: int, key: str = "order_id") -> DataFrame:
    """ml_<head>: the challenger's columns (prefix) for orders of the canary cohort, the champion's for the others."""
    if challenger is None:
        return df.withColumns({f"ml_{h}": F.col(champion + h) for h in HEADS})
    return df.withColumns({f"ml_{h}": F.when(in_cohort(F.col(key), percent), F.col(challenger + h)).otherwise(F.col(champion + h)) for h in HEADS})


def set_role(registry: DataFrame, model_id: str, role: str) -> DataFrame:
    """registry (model_id, role) with the model in its new role; a champion or canary that it takes over from retires."""
    alone = role in ("champion", "canary")
    old = (F.col("role") == role) & (F.col("model_id") != model_id) if alone else F.lit(False)
    return registry.withColumn("role", F.when(F.col("model_id") == model_id, role).when(old, "retired").otherwise(F.col("role")))


def canary_tick(state: dict[str, Any] | None, ready: bool, now: float, hours: float) -> str:
    """idle without one, rolled_back if it isn't ready any more, promoted after its hours, else active."""
    if not state or state.get("status") != "active":
        return "idle"
    if not ready:
        return "rolled_back"
    return "promoted" if now - state["started_at"] >= hours * 3600 else "active"


def shadow_money(pairs: DataFrame) -> DataFrame:
    """Money of each head that a shadow flags and the champion doesn't, and the other way round; pairs: head, champion, challenger, order_value."""
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("order_value"))), F.lit(0.0))
    return pairs.groupBy("head").agg(s(F.col("challenger") & ~F.col("champion")).alias("shadow_only"), s(F.col("challenger") & F.col("champion")).alias("both"), F.count(F.lit(1)).alias("n"))


def shadow_rows(df: DataFrame, champion: str, shadows: dict[str, str], policy: dict[str, Any], key: str = "order_id") -> DataFrame:
    """A row for each order, shadow model and head: both blended scores and whether each flags it. What is served doesn't change.

    champion, shadows: prefixes of the models' columns; rule_<head> are the rules' scores.
    """
    from ..functions.scoring import blend

    value = F.col("order_value") if "order_value" in df.columns else F.lit(0.0)
    one = lambda m, prefix, h: F.struct(F.lit(m).alias("shadow"), F.lit(h).alias("head"), blend(F.col(f"rule_{h}"), F.col(champion + h), h, policy).alias("champion_score"), blend(F.col(f"rule_{h}"), F.col(prefix + h), h, policy).alias("shadow_score"), F.lit(float(policy["thresholds"].get(h, 1.0))).alias("t"))
    long = df.select(key, value.alias("order_value"), F.inline(F.array(*(one(m, p, h) for m, p in shadows.items() for h in HEADS))))
    return long.withColumns({"champion": F.col("champion_score") >= F.col("t"), "challenger": F.col("shadow_score") >= F.col("t")}).drop("t")


def shadow_counts(rows: DataFrame) -> DataFrame:
    """Orders recorded for each shadow model."""
    return rows.groupBy("shadow").agg(F.countDistinct("order_id").alias("n"))


def served(df: DataFrame, bundle: dict[str, Any] | None, prefix: str = "ml_") -> DataFrame:
    """df with the serving model's columns; where it can't be applied the rules serve alone and model_reasons says so."""
    none = {prefix + h: F.lit(None).cast("double") for h in HEADS}
    if bundle is None:
        return df.withColumns(none).withColumn("model_reasons", F.array().cast("array<string>"))
    try:
        return predict(df, bundle, prefix).withColumn("model_reasons", F.array().cast("array<string>"))
    except ValueError:
        return df.withColumns(none).withColumn("model_reasons", F.array(F.lit("champion_predict_failed")))


def teacher_labels(rows: DataFrame, flip_rate: float, seed: int = 0, key: str = "order_id") -> DataFrame:
    """rows (key, head, flag) with label: the flag, turned over in a share of rows, each head by itself and by hash, so the same in every run."""
    if not 0.0 <= flip_rate <= 1.0:
        raise ValueError("flip_rate must be in [0, 1]")
    u = hash_share(F.concat_ws(":", F.lit(str(seed)), "head", F.col(key).cast("string"))) / float(2**32)
    return rows.withColumn("label", F.when(u < flip_rate, 1 - F.col("flag")).otherwise(F.col("flag")).cast("int"))


def fit(df: DataFrame, rounds: int = 100, depth: int = 6, holdout: float = 0.05, seed: int = 0) -> tuple[dict[str, Any], DataFrame]:
    """A boosted-tree model a head on FEATURES and label_<head>, and its holdout rows (head, label, predicted).

    The trees are Spark's own learner's, grown on the cluster; the holdout is by random split.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(df.select(*(F.col(c).cast("double").alias(c) for c in FEATURES), *(F.col(f"label_{h}").cast("double").alias(f"label_{h}") for h in HEADS)))
    train, held = rows.randomSplit([1 - holdout, holdout], seed)
    models, found = {}, None
    for h in HEADS:
        models[h] = GBTRegressor(featuresCol="features", labelCol=f"label_{h}", maxDepth=depth, maxIter=rounds, seed=seed).fit(train)
        one = models[h].transform(held).select(F.lit(h).alias("head"), F.col(f"label_{h}").alias("label"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("predicted"))
        found = one if found is None else found.unionByName(one)
    return models, found


def predict_trees(df: DataFrame, models: dict[str, Any], prefix: str = "ml_") -> DataFrame:
    """df with each head's tree prediction, cut to 0..1."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=[*FEATURES], outputCol="_f").transform(df)
    for h, m in models.items():
        out = m.setFeaturesCol("_f").setPredictionCol("_p").transform(out).withColumn(prefix + h, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_p")))).drop("_p")
    return out.drop("_f")
