"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that occurs in ``links`` (columns id, component).

    Each round first points an id's larger neighbours at its smallest neighbour (large star),
    then an id's smaller neighbours likewise (small star); links turn into stars around the
    smallest ids in a logarithmic number of rounds. The link count never grows, a round is two
    map-side combined aggregates with joins, and every round is a written table."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u > v").distinct()
    links = stage(links, "links")
    while True:
        # Large star: larger neighbours of an id go to its smallest neighbour or itself.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # u > v: v's larger neighbour u goes to v's smallest.
        large = links.join(least.withColumnRenamed("u", "w"), F.col("v") == F.col("w"))
        large = large.select("u", F.col("m").alias("v")).filter("u > v").distinct()
        # Small star: an id and its smaller neighbours go to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(moved.union(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "links")
        # Stable once no id points at two others or at one that points on.
        open_ends = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
        links = after
        if open_ends.isEmpty() and several.isEmpty():
            break
    roots = links.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
