"""Clustering on spark.ml and horizon models."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.operators import forest
from pulsegrid.operators.forest import Forest
from pulsegrid.operators.timeseries import ORDER, framed, lag_features
from pulsegrid.plans.ordering import last_n, numbered
from pulsegrid.plans.staging import stage

SEED = 42
LAGS = (1, 2, 3, 5, 10)
FEATURES = ["value", "hour", "day_of_week", "is_weekend", *[f"lag_{n}" for n in LAGS]]
HORIZONS = (5, 15, 30, 60)


def _level(mean: Column, overall: Column) -> Column:
    return (
        F.when(overall == 0, "normal")
        .when(mean > overall * 1.2, "high")
        .when(mean < overall * 0.8, "low")
        .otherwise("normal")
    )


def performance_clustering(wide: DataFrame, columns: Sequence[str], max_k: int = 10) -> DataFrame:
    """k-means on standardized metrics with the elbow's k.

    Result: per cluster its size, share, mean and level of every metric, with the silhouette
    (squared Euclidean) of the whole clustering. Needs two metrics and ten rows.
    """
    columns = list(columns)
    if len(columns) < 2:
        raise ValueError("clustering needs at least two metrics")
    filled = stage(wide.select(*columns).na.fill(0.0), "clustering")
    # One row: means and population deviations of the metrics.
    moments = filled.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    n = moments["n"]
    if n < 10:
        raise ValueError("clustering needs at least ten rows")
    scaled = filled.select(
        *columns,
        *[
            ((F.col(c) - moments[f"m{i}"]) / (moments[f"s{i}"] or 1.0)).alias(f"_z{i}")
            for i, c in enumerate(columns)
        ],
    )
    vectors = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(columns))], outputCol="features")
    data = stage(vectors.transform(scaled).select(*columns, "features"), "vectors")
    ks = range(2, min(max_k, max(2, n // 3)) + 1)
    models = [KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(data) for k in ks]
    costs = [m.summary.trainingCost for m in models]
    drops = [a - b for a, b in zip(costs, costs[1:])]
    # The elbow is the k before the largest drop.
    model = models[drops.index(max(drops))] if drops else models[0]
    placed = model.transform(data)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(placed)
    means = placed.groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.avg(c).alias(f"{c}_mean") for c in columns]
    )
    levels = [_level(F.col(f"{c}_mean"), F.lit(moments[f"m{i}"])).alias(f"{c}_level") for i, c in enumerate(columns)]
    return means.select(
        "cluster",
        "size",
        (F.col("size") / n * 100).alias("percentage"),
        *[f"{c}_mean" for c in columns],
        *levels,
        F.lit(model.getK()).alias("optimal_clusters"),
        F.lit(float(silhouette)).alias("silhouette_score"),
        F.lit(n).alias("total_samples"),
    )


def _horizon_features(rows: DataFrame, horizons: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Lag features of every type with the values of all horizons, numbered and written once."""
    first, *others = horizons

    def targets(w: WindowSpec) -> dict[str, Column]:
        return {f"target_{h}": F.lead("value", h).over(w) for h in others}

    ahead = framed(numbered(rows, ["metric_type"], order), targets, 0, max(horizons), ["metric_type"], order, keep_position=True)
    feats = lag_features(ahead, first, LAGS, keys=["metric_type"], order=order, keep_last=True)
    feats = feats.withColumnRenamed("target", f"target_{first}")
    columns = dict.fromkeys(["metric_type", *order, *FEATURES, *[f"target_{h}" for h in horizons]])
    return stage(feats.select(*columns), "features")


def train_all_models(
    metrics: DataFrame,
    types: Sequence[str] | None = None,
    horizons: Sequence[int] = HORIZONS,
    trees: int = 100,
    depth: int = 10,
    order: Sequence[str] = ORDER,
    min_rows: int = 100,
    min_clean: int = 50,
    trained_at: datetime | None = None,
    parallelism: int = 4,
) -> tuple[dict[str, Forest], list[tuple]]:
    """One random forest per metric type and horizon (in rows), with accuracy, mae and mse on a
    hashed fifth and the time of training.

    All types' features are built in one pass. The forests of ``parallelism`` types grow at a
    time, those of a type in the same passes over its rows; only their nodes and scores come back
    to the caller. A type needs ``min_rows`` rows, a model ``min_clean`` complete ones; others
    are left out.
    """
    rows = metrics.filter(F.col("metric_type").isNotNull())
    if types is not None:
        rows = rows.filter(F.col("metric_type").isin(list(types)))
    # One row per metric type.
    enough = rows.groupBy("metric_type").agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    names = sorted(r.metric_type for r in enough.collect())
    if not names:
        return {}, []
    trained_at = trained_at or datetime.now()
    feats = _horizon_features(rows.filter(F.col("metric_type").isin(names)), horizons, order)
    known = feats.groupBy("metric_type").agg(*[F.count(f"target_{h}").alias(str(h)) for h in horizons])
    clean = {r.metric_type: r for r in known.collect()}
    wanted = {t: [h for h in horizons if clean[t][str(h)] >= min_clean] for t in names if t in clean}
    # The split depends on the row only, so reruns and retries agree.
    fold = F.pmod(F.xxhash64(*order), F.lit(10))

    def fit(name: str) -> list[tuple[Forest, tuple]]:
        labels = {f"{name}_{h}min": f"target_{h}" for h in wanted[name]}
        mine = feats.filter(F.col("metric_type") == name)
        grown = forest.grow(mine.filter(fold < 8), FEATURES, labels, order, trees, depth, SEED)
        errors = forest.errors(mine.filter(fold >= 8), grown, labels)
        out = []
        for h, key in zip(wanted[name], labels):
            if key not in grown:
                continue
            mae, mse, spread = errors.get(key, (None, None, None))
            accuracy = 1 - mae / spread if spread else 0.0
            accuracy = max(0.0, min(1.0, accuracy))
            out.append((grown[key], (key, name, h, accuracy, mae, mse, trained_at)))
        return out

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        types_fitted = pool.map(inheritable_thread_target(metrics.sparkSession)(fit), [t for t in wanted if wanted[t]])
        fitted = [one for several in types_fitted for one in several]
    return {score[0]: model for model, score in fitted}, [score for _, score in fitted]


def train_horizon_models(
    metrics: DataFrame, metric_type: str, horizons: Sequence[int] = HORIZONS, **options
) -> tuple[dict[str, Forest], list[tuple]]:
    """``train_all_models`` of one metric type."""
    return train_all_models(metrics, [metric_type], horizons, **options)


SCORE_SCHEMA = (
    "model string, metric_type string, horizon_minutes int, accuracy double, mae double, mse double, trained_at timestamp"
)


def model_performance_summary(scores: DataFrame) -> DataFrame:
    """Accuracy, mean absolute error and time of training per model."""
    return scores.select("model", "accuracy", "mae", F.col("trained_at").alias("last_updated"))


def newest_features(metrics: DataFrame, order: Sequence[str] = ORDER, tail_rows: int = 500) -> DataFrame:
    """The newest complete feature row of every metric type.

    The last ``tail_rows`` rows of each type are enough unless all of these are incomplete; only
    the types where they are get their whole history looked through.
    """
    kept = list(dict.fromkeys([*order, *FEATURES]))

    def newest(rows: DataFrame) -> DataFrame:
        feats = lag_features(rows, 1, LAGS, keys=["metric_type"], order=order, keep_last=True)
        best = F.max_by(F.struct(*kept), F.struct(*order))
        return feats.groupBy("metric_type").agg(best.alias("_r")).select("metric_type", "_r.*")

    quick = stage(newest(last_n(metrics, ["metric_type"], order, tail_rows)), "newest")
    types = metrics.select("metric_type").distinct()
    rest = stage(types.join(quick, "metric_type", "left_anti").filter("metric_type is not null"), "rest")
    if rest.isEmpty():
        return quick
    return quick.unionByName(stage(newest(metrics.join(rest, "metric_type", "left_semi")), "newest"))


def predict_horizon(
    metrics: DataFrame,
    models: dict[str, Forest],
    scores: list[tuple],
    order: Sequence[str] = ORDER,
    tail_rows: int = 500,
) -> DataFrame:
    """Prediction of each model from its type's newest complete feature row, with its confidence."""
    types = list(dict.fromkeys(score[1] for score in scores))
    newest = newest_features(metrics.filter(F.col("metric_type").isin(types)), order, tail_rows)
    out = None
    for key, metric_type, horizon, accuracy, *_ in scores:
        one = models[key].transform(newest.filter(F.col("metric_type") == metric_type)).select(
            F.lit(key).alias("model"),
            "metric_type",
            F.lit(horizon).alias("horizon_minutes"),
            "timestamp",
            F.col("prediction").alias("predicted_value"),
            F.lit(min(1.0, accuracy)).alias("confidence"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no models")
    return out


def latest_prediction(predictions: DataFrame, order: str = "event_id") -> DataFrame:
    """The newest stored prediction per metric type and horizon."""
    newest = F.max_by(F.struct("timestamp", "predicted_value", "accuracy"), F.struct("timestamp", order))
    return predictions.groupBy("metric_type", "horizon_minutes").agg(newest.alias("p")).select(
        "metric_type", "horizon_minutes", "p.*"
    )


def save_models(models: dict[str, Forest], path: str, parallelism: int = 4) -> None:
    """One folder per model."""

    spark = SparkSession.active()

    def save(key: str) -> None:
        models[key].save(spark, f"{path}/{key}")

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(inheritable_thread_target(spark)(save), models))


def load_models(path: str, keys: Sequence[str], parallelism: int = 4) -> dict[str, Forest]:
    spark = SparkSession.active()

    def load(key: str) -> Forest:
        return Forest.load(spark, f"{path}/{key}")

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(keys, pool.map(inheritable_thread_target(spark)(load), keys)))
