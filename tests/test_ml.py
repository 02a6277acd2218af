import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import iforest, ml
from pulsegrid.plans.staging import stage_path


@pytest.fixture(scope="module")
def planted(spark):
    """Two series of Gaussian points, each with three far outliers (ids below 3)."""
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("a", 600), ("b", 400)):
        for i in range(n):
            x, y = rng.normal(0, 1, 2) if i >= 3 else rng.choice([-1, 1], 2) * (12 + i)
            rows.append((f"{key}{i}", key, i, float(x), float(y)))
    return spark.createDataFrame(rows, "row string, metric_name string, i int, x double, y double")


def test_planted_outliers_rank_first(planted):
    out = iforest.isolation_forest(planted, ["x", "y"], row_id=["row"], contamination=0.01)
    for key in ("a", "b"):
        top = out.filter(F.col("metric_name") == key).orderBy(F.col("score").desc()).limit(3).collect()
        assert {r.i for r in top} == {0, 1, 2}
    assert out.filter("score < 0 or score > 1 or ml_score < 0 or ml_score > 1").count() == 0
    assert 5 <= out.filter("is_anomaly").count() <= 12


def test_forest_has_all_trees_of_full_size(planted):
    forest = iforest.train_forest(planted, ["x", "y"], row_id=["row"], trees=40, sample=64)
    sizes = {r.metric_name: (r.n, r.lo, r.hi) for r in forest.groupBy("metric_name").agg(
        F.count("*").alias("n"), F.min("_n").alias("lo"), F.max("_n").alias("hi")).collect()}
    for n, lo, hi in sizes.values():
        assert n == 40 and lo >= 48 and hi <= 64


def test_large_series_use_one_tree_per_row(spark):
    df = spark.range(40_000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("row"), F.lit("m").alias("metric_name"), F.randn(3).alias("x")
    )
    forest = iforest.train_forest(df, ["x"], row_id=["row"], trees=20, sample=256)
    assert forest.count() == 20 and forest.agg(F.min("_n")).first()[0] >= 200


def test_shares_do_not_change_scores(planted):
    path = stage_path(planted.sparkSession, "forest")
    iforest.save_forest(iforest.train_forest(planted, ["x", "y"], row_id=["row"], trees=10), path)
    forest = iforest.load_forest(planted.sparkSession, path)
    whole = {r.row: r.score for r in iforest.score_forest(planted, forest, ["x", "y"], row_id=["row"]).collect()}
    grouped = iforest.score_forest(planted, forest, ["x", "y"], row_id=["row"], share_rows=50)
    got = {r.row: r.score for r in grouped.collect()}
    assert got.keys() == whole.keys() and len(got) == 1000
    assert max(abs(got[k] - whole[k]) for k in got) < 1e-12


def test_average_path():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert iforest.average_path(256) == pytest.approx(10.24, abs=0.01)


def test_clusters_of_two_states(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(20, 1)), float(rng.normal(30, 1))) for _ in range(40)]
    rows += [(float(rng.normal(90, 1)), float(rng.normal(80, 1))) for _ in range(60)]
    out = ml.performance_clustering(spark.createDataFrame(rows, "cpu double, memory double"), ["cpu", "memory"], max_k=4)
    got = out.collect()
    assert sum(r["size"] for r in got) == 100 and got[0].total_samples == 100
    assert {r.cpu_level for r in got} >= {"low", "high"} and got[0].silhouette_score > 0.5
    with pytest.raises(ValueError):
        ml.performance_clustering(spark.createDataFrame(rows[:5], "cpu double, memory double"), ["cpu", "memory"])


def test_horizon_model_learns_and_persists(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=i), "cpu", "cpu_percent", 50 + 30 * float(np.sin(i / 5))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, metric_type string, metric_name string, value double")
    models, scores = ml.train_horizon_models(df, "cpu", horizons=(5,), trees=10, depth=6)
    assert scores[0][3] > 0.8
    want = ml.predict_horizon(df, models, scores).first()
    path = stage_path(spark, "models")
    ml.save_models(models, path)
    got = ml.predict_horizon(df, ml.load_models(path, list(models)), scores).first()
    assert got.predicted_value == want.predicted_value and got.timestamp == t0 + timedelta(minutes=399)
    assert ml.train_horizon_models(df.limit(50), "cpu")[0] == {}


def test_forest_keeps_series_without_a_name(planted):
    nameless = planted.withColumn("metric_name", F.when(F.col("metric_name") == "a", "a"))
    out = iforest.isolation_forest(nameless, ["x", "y"], row_id=["row"])
    assert out.count() == 1000 and out.filter("score is null").count() == 0
    top = out.filter("metric_name is null").orderBy(F.col("score").desc()).limit(3).collect()
    assert {r.i for r in top} == {0, 1, 2}


def test_composite_score_takes_the_larger_of_model_and_rules(spark, series):
    from pulsegrid.operators import anomaly, timeseries

    rng = np.random.default_rng(5)
    values = list(rng.normal(50, 5, 400))
    df = series(load=values)
    feats = timeseries.rolling_features(df)
    columns = ["value", "rolling_mean", "rolling_std"]
    forest = iforest.train_forest(feats, columns)
    plain = {r.event_id: r.anomaly_score for r in anomaly.composite_anomaly(df, limit=-1.0).collect()}
    model = {r.event_id: r.ml_score for r in iforest.decide(feats, forest, columns).collect()}
    both = anomaly.composite_with_forest(df, feats, forest, columns, limit=-1.0).collect()
    assert {r.event_id for r in both} == plain.keys()
    for r in both:
        assert r.anomaly_score == max(plain[r.event_id], model.get(r.event_id, 0.0))
    assert any(model.get(r.event_id, 0) > plain[r.event_id] for r in both)


def test_all_horizon_models_in_one_call(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    schema = "event_id long, timestamp timestamp, metric_type string, metric_name string, value double"
    rows = []
    for k, (kind, n) in enumerate((("cpu", 300), ("memory", 200), ("short", 40))):
        rows += [(k * 1000 + i, t0 + timedelta(minutes=i), kind, kind, 50 + 30 * float(np.sin(i / 5 + k))) for i in range(n)]
    # The newest memory rows are incomplete, beyond what the tail holds.
    rows += [(1000 + i, t0 + timedelta(minutes=i), "memory", "memory", None) for i in range(200, 230)]
    df = spark.createDataFrame(rows, schema)
    at = datetime(2024, 2, 1)
    models, scores = ml.train_all_models(df, horizons=(5, 15), trees=10, depth=6, trained_at=at)
    assert set(models) == {"cpu_5min", "cpu_15min", "memory_5min", "memory_15min"}
    one, alone = ml.train_horizon_models(df, "cpu", horizons=(5,), trees=10, depth=6, trained_at=at)
    assert [s for s in scores if s[0] == "cpu_5min"] == alone
    got = {r.model: r for r in ml.predict_horizon(df, models, scores, tail_rows=20).collect()}
    assert set(got) == set(models)
    assert got["memory_5min"].timestamp == t0 + timedelta(minutes=199)
    summary = ml.model_performance_summary(spark.createDataFrame(scores, ml.SCORE_SCHEMA)).collect()
    assert len(summary) == 4 and all(r.last_updated == at for r in summary)


def timed_series(spark, n, kind="cpu", value=lambda i: 50 + 30 * float(np.sin(i / 5))):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), kind, kind, value(i)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, timestamp timestamp, metric_type string, metric_name string, value double")


def test_horizons_of_a_type_grow_in_the_same_passes(spark):
    """The number of Spark jobs does not depend on how many horizons and trees there are."""
    df, sc, jobs = timed_series(spark, 300), spark.sparkContext, []
    for k, (horizons, trees) in enumerate((((5,), 2), ((5, 15, 30, 60), 8))):
        sc.setJobGroup(f"passes{k}", "")
        models, _ = ml.train_all_models(df, horizons=horizons, trees=trees, depth=3)
        assert len(models) == len(horizons)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"passes{k}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 3


def test_forest_of_several_shares_finds_the_steps(spark, monkeypatch):
    """Labels known for different rows, duplicate rows and a feature of one value, in many shares."""
    from pulsegrid.operators import forest

    rng = np.random.default_rng(8)
    rows = [(float(x), int(g), 1.0, float(10 * (x > 0.3) + g), float(x) if x > 0.5 else None) for x, g in zip(rng.random(2000), rng.integers(0, 3, 2000))]
    df = spark.createDataFrame(rows + rows[:500], "x double, g int, same double, y double, z double")
    monkeypatch.setattr(forest, "SHARE_ROWS", 300)
    labels = {"a": "y", "b": "z"}
    grown = forest.grow(df, ["x", "g", "same"], labels, trees=20, depth=5)
    again = forest.grow(df.repartition(3), ["x", "g", "same"], labels, trees=20, depth=5)
    for k in labels:
        one, two = grown[k], again[k]
        assert (one.feature == two.feature).all() and (one.split == two.split).all() and np.allclose(one.value, two.value)
        assert not (one.feature == 2).any()
    got = forest.errors(df, grown, labels)
    assert got["a"][0] < 0.3 and got["b"][0] < 0.02 and 11.9 < got["a"][2] <= 12
    # Trees differ: each has its own bootstrap.
    assert len({v.tobytes() for v in grown["a"].value}) == 20
    assert forest.grow(df.filter("false"), ["x"], labels) == {}
    with pytest.raises(Exception, match="a feature is null or not a number"):
        forest.grow(df, ["x", "z"], {"a": "y"}, trees=1)


def test_best_splits_against_all_splits():
    from pulsegrid.operators import forest

    rng = np.random.default_rng(3)
    sizes = [4, 1, 6]
    for _ in range(50):
        x = np.stack([rng.integers(0, s, 12) for s in sizes], axis=1)
        w, y = rng.integers(1, 4, 12).astype(float), rng.normal(0, 1, 12)
        n, s = np.zeros((1, 11)), np.zeros((1, 11))
        for k, start in enumerate((0, 4, 5)):
            np.add.at(n[0], start + x[:, k], w)
            np.add.at(s[0], start + x[:, k], w * y)
        spread = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
        left = {(k, t): x[:, k] <= t for k, size in enumerate(sizes) for t in range(size - 1)}
        falls = {at: spread(m) + spread(~m) for at, m in left.items() if 0 < m.sum() < 12}
        feature, split, ns, means = forest.best_splits(n, s, sizes)
        best = left[int(feature[0]), int(split[0])]
        assert np.isclose(falls[int(feature[0]), int(split[0])], min(falls.values()))
        assert np.allclose(ns[0], [w[best].sum(), w[~best].sum()])
        assert np.allclose(means[0], [np.average(y[m], weights=w[m]) for m in (best, ~best)])
    feature, _, ns, means = forest.best_splits(np.array([[2.0, 1, 3]]), np.array([[4.0, 2, 6]]), [3])
    assert feature[0] == forest.LEAF and means.tolist() == [[2, 2]]


def test_thresholds_lie_between_values():
    from pulsegrid.operators.forest import thresholds

    assert thresholds([]).tolist() == [] and thresholds([3.0] * 9).tolist() == []
    assert thresholds([0.0, 0, 1, 1, 2, 6]).tolist() == [0.5, 1.5, 4]
    many = thresholds([0.0] * 900 + list(range(1, 102)))
    assert len(many) <= 31 and many[0] == 0.5 and thresholds(np.arange(1001.0)).size == 31
    assert thresholds([-np.inf, 0.0, np.inf]).tolist() == [-np.inf, 0]


def test_histograms_of_open_nodes_count_every_row(monkeypatch):
    """Parts of the rows, joined features and closed nodes, against a sum row by row."""
    import pyarrow as pa

    from pulsegrid.operators import forest

    rng, sizes, n = np.random.default_rng(4), [5, 3, 1, 40], 700
    bins = np.stack([rng.integers(0, s, n).astype(np.uint8) for s in sizes], axis=1)
    y = rng.normal(0, 1, n)
    monkeypatch.setattr(forest, "HELD_ROWS", 150)
    # The root splits at feature 0, its left child at feature 3; the right one is a leaf.
    feature, split = np.array([0, 3, forest.LEAF], np.uint8), np.array([2, 20, 0], np.uint8)
    opened = np.array([True, True, False, False])
    share = pa.RecordBatch.from_pydict({
        "label": ["a"], "share": pa.array([0], pa.int64()),
        "bins": pa.array([bins.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()),
    })
    at = {k: {"a": [x]} for k, x in (("feature", feature), ("split", split), ("opened", opened))}
    (out,) = forest._counted(sizes, 2, at["feature"], at["split"], at["opened"], 42)(iter([share]))
    got = [np.frombuffer(out.column(c)[0].as_buffer(), t).reshape(2, -1) for c, t in (("n", np.float32), ("s", np.float64))]
    draw = np.random.default_rng([42, 0, 0]).integers(0, 1 << 16, n, np.uint16)
    want = np.zeros((2, 2, sum(sizes)))
    for row, w, label in zip(bins, forest._WEIGHTS[draw], y):
        if row[0] <= 2:
            for start, b in zip((0, 5, 8, 9), row):
                want[:, int(row[3] > 20), start + b] += w, w * label
    assert np.allclose(got, want)
    assert forest._joined([32, 24, 7, 2, 32], 512) == [[3, 2], [1], [0], [4]]


def test_bootstrap_weights_are_poisson():
    from pulsegrid.operators.forest import _WEIGHTS

    assert abs(_WEIGHTS.mean() - 1) < 1e-3 and abs(_WEIGHTS.var() - 1) < 1e-2 and abs((_WEIGHTS == 0).mean() - np.exp(-1)) < 1e-4
