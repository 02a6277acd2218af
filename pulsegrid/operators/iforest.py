"""Isolation forest (Liu, Ting, Zhou 2008), one forest per series.

Trees see 256 sampled rows each and are built in parallel, one group per (series, tree).
Scoring reads each row once. Splits are drawn between a column's smallest and largest value,
so standardizing the columns first would change nothing and is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.quantiles import group_quantiles
from pulsegrid.plans.staging import stage

SAMPLE = 256
TREES = 100
SCORE_ROWS = 100_000
_OVERSAMPLE = 1.3

FOREST_TYPE = (
    "_tree int, _n int, feature array<int>, split array<double>, left array<int>, right array<int>, size array<int>"
)


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as parallel node lists; a leaf has feature -1."""
    limit = math.ceil(math.log2(max(2, len(x))))
    tree: dict[str, list] = {"feature": [], "split": [], "left": [], "right": [], "size": []}

    def add(rows: np.ndarray, depth: int) -> int:
        node = len(tree["feature"])
        for name, empty in (("feature", -1), ("split", 0.0), ("left", -1), ("right", -1)):
            tree[name].append(empty)
        tree["size"].append(len(rows))
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            return node
        f = int(rng.choice(usable))
        split = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] < split
        tree["feature"][node], tree["split"][node] = f, split
        if below.any() and not below.all():
            tree["left"][node] = add(rows[below], depth + 1)
            tree["right"][node] = add(rows[~below], depth + 1)
        else:
            tree["feature"][node] = -1
        return node

    add(x, 0)
    return tree


def train_forest(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("metric_name",),
    row_id: Sequence[str] = ("event_id",),
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Written forest table: one row per series and tree.

    Every row draws whether it is sampled from a hash of its id. A large series needs one
    draw per row, which also names the tree; a small one draws for each tree, so that trees
    may share rows.
    """
    keys, features = list(keys), list(features)
    rows = df.select(*dict.fromkeys([*keys, *row_id, *features])).na.drop(subset=features)
    sizes = stage(rows.groupBy(*keys).agg(F.count("*").alias("_rows")), "sizes")
    placed = join_keys(rows, sizes, keys)
    rate = F.lit(sample * _OVERSAMPLE) / F.col("_rows")

    def draw(*salt: Column) -> Column:
        return F.pmod(F.xxhash64(*row_id, F.lit(seed), *salt), F.lit(1 << 30)) / float(1 << 30)

    one = F.when(
        draw(F.lit(-1)) < rate * trees,
        F.array(F.pmod(F.xxhash64(*row_id, F.lit(seed), F.lit(-2)), F.lit(trees)).cast("int")),
    )
    every = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < rate)
    chosen = F.when(rate * trees <= 1, one).otherwise(every)
    sampled = placed.withColumn("_tree", F.explode(chosen))
    sampled = sampled.withColumn("_rank", F.xxhash64(*row_id, "_tree"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + FOREST_TYPE

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank").head(sample)
        number = int(pdf["_tree"].iloc[0])
        tree = _grow(pdf[features].to_numpy(float), np.random.default_rng([seed, number]))
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "_tree": [number], "_n": [len(pdf)], **{k: [v] for k, v in tree.items()}})

    return stage(sampled.groupBy(*keys, "_tree").applyInPandas(build, schema), "forest")


def _scores(x: np.ndarray, forest: list[dict]) -> np.ndarray:
    """Anomaly score of each row: 2 ** (-mean path / expected path)."""
    depth, expected = np.zeros(len(x)), 0.0
    for tree in forest:
        feature, split = np.asarray(tree["feature"]), np.asarray(tree["split"])
        left, right = np.asarray(tree["left"]), np.asarray(tree["right"])
        leaf_path = np.array([average_path(s) for s in tree["size"]])
        node, steps = np.zeros(len(x), dtype=int), np.zeros(len(x))
        active = feature[node] >= 0
        while active.any():
            at = node[active]
            f = feature[at]
            below = x[np.flatnonzero(active), f] < split[at]
            node[active] = np.where(below, left[at], right[at])
            steps[active] += 1
            active = feature[node] >= 0
        depth += steps + leaf_path[node]
        expected += average_path(tree["_n"])
    return np.power(2.0, -depth / max(expected, 1e-12))


_PARTS = ["_n", "feature", "split", "left", "right", "size"]


def score_forest(
    df: DataFrame,
    forest: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("metric_name",),
    row_id: Sequence[str] = ("event_id",),
    share_rows: int = SCORE_ROWS,
) -> DataFrame:
    """Add ``score`` (about 0.5 normal, towards 1 anomalous) to every row without null features.

    Each series is cut into shares of about ``share_rows`` rows, and a copy of its trees goes to
    each share. Rows of a series without trees have a null score.
    """
    keys, features = list(keys), list(features)
    rows = df.na.drop(subset=features)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    shares = rows.groupBy(*keys).agg(F.ceil(F.count("*") / share_rows).cast("int").alias("_shares"))
    shares = stage(shares, "shares")
    share = F.pmod(F.xxhash64(*row_id), F.col("_shares")).cast("int")
    salted = join_keys(rows, shares, keys).withColumn("_share", share).drop("_shares")
    copies = join_keys(forest, shares, keys).withColumn("_share", F.explode(F.expr("sequence(0, _shares - 1)")))

    def score_share(pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_share")
        if len(pdf):
            listed = trees[_PARTS].to_dict("records")
            pdf["score"] = _scores(pdf[features].to_numpy(float), listed) if listed else np.nan
        else:
            pdf["score"] = pd.Series(dtype="float64")
        return pdf

    return salted.groupBy(*keys, "_share").cogroup(copies.groupBy(*keys, "_share")).applyInPandas(score_share, schema)


def save_forest(forest: DataFrame, path: str) -> None:
    forest.write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("metric_name",),
    row_id: Sequence[str] = ("event_id",),
    contamination: float = 0.01,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Train and score: decision below 0 marks the share ``contamination`` of outliers.

    ``ml_score`` maps the decision to 0..1, as the composite anomaly score takes it.
    """
    forest = train_forest(df, features, keys, row_id, trees, sample, seed)
    return decide(df, forest, features, keys, row_id, contamination)


def decide(
    df: DataFrame,
    forest: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("metric_name",),
    row_id: Sequence[str] = ("event_id",),
    contamination: float = 0.01,
) -> DataFrame:
    """Score with a forest that exists, such as a saved one; see ``isolation_forest``."""
    scored = stage(score_forest(df, forest, features, keys, row_id), "scored")
    cut = group_quantiles(scored, keys, "score", [1 - contamination])
    limits = stage(cut.select(*keys, F.col("q")[0].alias("_cut")), "cuts")
    decision = F.col("_cut") - F.col("score")
    ml_score = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("decision") + 0.5))
    return (
        join_keys(scored, limits, list(keys))
        .withColumn("decision", decision)
        .withColumn("is_anomaly", F.col("decision") < 0)
        .withColumn("ml_score", ml_score)
        .drop("_cut")
    )
