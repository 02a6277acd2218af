"""Clustering, horizon models and isolation forests (checked by properties, not SQL)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pulsegrid.catalog.registry import Registry, rounded
from pulsegrid.catalog.stats import NAMES
from pulsegrid.operators import anomaly, iforest, ml, stats, timeseries
from pulsegrid.operators.report import cross_metric_analysis as cross
from pulsegrid.plans.staging import stage_path
from pulsegrid.sources import adapters as A

Q = Registry()
M = ["event_id", "timestamp", "metric_type", "metric_name", "value"]
ROLLED = ["value", "rolling_mean", "rolling_std", "hour", "day_of_week"]


def _metrics(spark, d):
    return A.metrics_long(spark, d).select(*M)


@Q.add("performance_clustering")
def performance_clustering(spark, d):
    wide = stats.positional_align(_metrics(spark, d), NAMES)
    return rounded(ml.performance_clustering(wide, NAMES))


@Q.add("cross_metric_analysis")
def cross_metric_analysis(spark, d):
    pairs, clusters = cross(_metrics(spark, d), NAMES, hours=None)
    left = pairs.select(F.lit("correlation").alias("part"), F.concat_ws("~", "metric1", "metric2").alias("name"), F.col("correlation").alias("value"))
    right = clusters.select(F.lit("cluster").alias("part"), F.col("cluster").cast("string").alias("name"), F.col("percentage").alias("value"))
    return rounded(left.unionByName(right))


@lru_cache(maxsize=1)
def _trained(app: str, d: str):
    """All metric types and horizons; one training serves the four queries of a session."""
    spark = SparkSession.getActiveSession()
    return ml.train_all_models(_metrics(spark, d))


def _models(spark, d):
    return _trained(spark.sparkContext.applicationId, d)


@Q.add("train_horizon_models")
def train_horizon_models(spark, d):
    _, scores = _models(spark, d)
    return spark.createDataFrame(scores, ml.SCORE_SCHEMA).drop("trained_at")


@Q.add("predict_horizon")
def predict_horizon(spark, d):
    models, scores = _models(spark, d)
    return ml.predict_horizon(_metrics(spark, d), models, scores)


@Q.add("model_persist")
def model_persist(spark, d):
    """Predictions of all models, saved and loaded again."""
    models, scores = _models(spark, d)
    path = stage_path(spark, "models")
    ml.save_models(models, path)
    return ml.predict_horizon(_metrics(spark, d), ml.load_models(path, list(models)), scores)


@Q.add("model_performance_summary")
def model_performance_summary(spark, d):
    _, scores = _models(spark, d)
    return ml.model_performance_summary(spark.createDataFrame(scores, ml.SCORE_SCHEMA))


@Q.add("isolation_forest")
def isolation_forest(spark, d):
    feats = timeseries.rolling_features(_metrics(spark, d))
    out = iforest.isolation_forest(feats, ROLLED)
    return rounded(out.select("event_id", "metric_name", "score", "decision", "is_anomaly", "ml_score"))


@Q.add("composite_anomaly_model")
def composite_anomaly_model(spark, d):
    """Composite scores with the model term, from a forest that was saved and loaded again."""
    feats = timeseries.rolling_features(_metrics(spark, d))
    path = stage_path(spark, "forest")
    iforest.save_forest(iforest.train_forest(feats, ROLLED), path)
    out = anomaly.composite_with_forest(_metrics(spark, d), feats, iforest.load_forest(spark, path), ROLLED)
    return rounded(out.select("event_id", "metric_name", "value", "expected_value", "ml_score", "anomaly_score", "severity"))
