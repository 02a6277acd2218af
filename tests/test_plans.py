import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.plans.ordering import last_n, numbered, with_frames, with_position, with_sliding_moments
from pulsegrid.plans.quantiles import group_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Three keys, one with most of the rows, spread over several partitions out of order."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randrange(200), i, rng.gauss(0, 5)) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, id long, v double").repartition(7)


def plain_position(df):
    w = Window.partitionBy("k").orderBy("t", "id")
    return df.withColumn("want", F.row_number().over(w) - 1)


def test_positions_equal_row_number(skewed):
    got = with_position(skewed, ["k"], ["t", "id"], total="n")
    want = plain_position(skewed).select("id", "want")
    both = got.join(want, "id")
    assert both.count() == 3000
    assert both.filter("pos != want").count() == 0
    assert {r.k: r.n for r in both.select("k", "n").distinct().collect()} == {
        r.k: r["count"] for r in skewed.groupBy("k").count().collect()
    }


def test_positions_of_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 1), ("a", 2)], "k string, t int")
    got = {(r.k, r.t, r.pos, r.n) for r in with_position(df, ["k"], ["t"], total="n").collect()}
    assert got == {("a", 1, 0, 2), ("a", 2, 1, 2), (None, 1, 0, 2), (None, 2, 1, 2)}


def test_positions_without_key(skewed):
    got = [r.id for r in with_position(skewed, [], ["t", "id"]).orderBy("pos").collect()]
    want = [r.id for r in skewed.orderBy("t", "id").collect()]
    assert got == want


def test_numbered_reuses_positions(skewed):
    once = numbered(skewed, ["k"], ["t", "id"])
    assert numbered(once, ["k"], ["t", "id"]) is once


@pytest.mark.parametrize("block", [13, 100, 10_000])
def test_frames_cross_blocks(skewed, block):
    placed = with_position(skewed, ["k"], ["t", "id"])

    def build(w):
        return {
            "s": F.sum("v").over(w.rowsBetween(-10, 2)),
            "lagged": F.lag("v", 10).over(w),
            "ahead": F.lead("v", 2).over(w),
        }

    got = with_frames(placed, ["k"], build, 10, 2, block_rows=block)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select(
        "id",
        F.sum("v").over(w.rowsBetween(-10, 2)).alias("ws"),
        F.lag("v", 10).over(w).alias("wl"),
        F.lead("v", 2).over(w).alias("wa"),
    )
    both = got.join(want, "id")
    assert both.count() == 3000
    wrong = (F.abs(F.col("s") - F.col("ws")) > 1e-9) | ~F.col("lagged").eqNullSafe(F.col("wl")) | ~F.col("ahead").eqNullSafe(F.col("wa"))
    assert both.filter(wrong).count() == 0


@pytest.mark.parametrize("rows, block", [(1, 5), (2, 7), (30, 31), (30, 10_000), (100, 64)])
def test_sliding_moments_equal_frames(skewed, rows, block):
    df = skewed.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v")))
    placed = with_position(df, ["k"], ["t", "id"])
    got = with_sliding_moments(placed, ["k"], "v", rows, block_rows=block)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(1 - rows, 0)
    want = df.select(
        "id", F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.var_pop("v").over(w).alias("q")
    )
    both = got.join(want, "id")
    assert both.count() == 3000 and both.filter("_sn != n").count() == 0
    filled = both.filter("n > 0")
    assert filled.filter("abs(_sm - m) > 1e-9 or abs(_sq / n - q) > 1e-9 or _sm is null").count() == 0


def test_constant_frames_have_no_spread(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.lit(0.1).alias("v"))
    assert with_sliding_moments(df, ["k"], "v", 37, block_rows=50).filter("_sq != 0").count() == 0


@pytest.mark.parametrize("small_rows", [0, 1_000_000])
def test_quantiles_equal_numpy(spark, skewed, small_rows):
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0]
    # Repeated values as well as distinct ones.
    df = skewed.withColumn("v", F.when(F.col("id") % 3 == 0, F.round("v")).otherwise(F.col("v")))
    got = {r.k: r.q for r in group_quantiles(df, ["k"], "v", probs, small_rows=small_rows).collect()}
    for k, part in df.toPandas().groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(part["v"], probs), atol=1e-9)


def test_quantiles_of_one_hot_value(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), F.when(F.col("id") < 900, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = group_quantiles(df, ["k"], "v", [0.5, 0.95], small_rows=0).first().q
    np.testing.assert_allclose(got, np.quantile([5.0] * 900 + list(range(900, 1000)), [0.5, 0.95]))


def test_approximate_quantiles_are_close(skewed):
    q = group_quantiles(skewed, ["k"], "v", [0.5], approx=True).filter("k = 'hot'").first().q[0]
    want = skewed.filter("k = 'hot'").toPandas()["v"].median()
    assert abs(q - want) < 0.1


@pytest.mark.parametrize("n", [7, 1500])
def test_last_n(skewed, n):
    got = last_n(skewed, ["k"], ["t", "id"], n, rank="rank")
    want = plain_position(skewed).withColumn("total", F.count("*").over(Window.partitionBy("k"))).filter(f"want >= total - {n}")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert got.filter("rank = 1").count() == 3


def test_last_n_limits_before_the_shuffle(skewed):
    plan = last_n(skewed, ["k"], ["t", "id"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
