"""Ordered operators over keys of any size.

A window partitioned by metric puts a whole metric into one task. Here rows are range
partitioned on (key, order) instead, which stays balanced whatever the key sizes are,
numbered per key from partition offsets, and then cut into blocks of equal row count.
Frame functions run per (key, block) with the few rows of the neighbouring block that the
frame reaches copied in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.plans.staging import stage

# Rows per block: with its halo a block stays below the 4096 rows that Spark's window operator
# keeps in memory before it turns to its spilling buffer.
BLOCK_ROWS = 3_500

# Rows per block where a block hands one row of state on to the next.
CARRY_BLOCK_ROWS = 250_000

POS, TOTAL = "_series_pos", "_series_rows"

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pos: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its key, and the key's row count.

    ``order`` must identify a row within its key. Rows with a null key are a key of their own.
    """
    keys, order = list(keys), list(order)
    # A constant keeps single-series calls on the same path as keyed ones.
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in keys + order])
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    staged = stage(ranged, "ordered")
    chunk = F.shiftright("_mid", _PARTITION_BITS)
    per_chunk = staged.groupBy(*keys, chunk.alias("_chunk")).agg(
        F.min("_mid").alias("_first"), F.count("*").alias("_rows")
    )
    # One row per key and range partition, far below the data.
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        per_chunk.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(by_key))
        .drop("_rows"),
        "offsets",
    )
    theirs = [f"_key{i}" for i in range(len(keys))]
    offsets = offsets.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs)], "_chunk", "_first", "_base", "_total")
    same = chunk == F.col("_chunk")
    for k, t in zip(keys, theirs):
        same &= F.col(k).eqNullSafe(F.col(t))
    joined = staged.join(offsets, same)
    columns = [F.col(c) for c in df.columns]
    columns.append((F.col("_mid") - F.col("_first") + F.col("_base")).alias(pos))
    if total:
        columns.append(F.col("_total").alias(total))
    return joined.select(*columns)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the columns POS and TOTAL; unchanged where it has them already.

    Number a table once, write it, and every ordered operator reuses the numbers.
    """
    if POS in df.columns and TOTAL in df.columns:
        return df
    return with_position(df, keys, order, POS, TOTAL)


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps refer to by name.

    The optimizer copies the expression of a plain added column into every later filter and
    projection; with long expressions the generated code then grows past what the JIT compiles.
    A generator of one row keeps each value computed once.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(one))


def spread_blocks(
    positioned: DataFrame, before: int, after: int, pos: str, block_rows: int
) -> tuple[DataFrame, Column]:
    """Rows in every block whose frames reach them, and the condition for a row's own block."""
    size = max(block_rows, before + after, 1)
    first = F.expr(f"greatest(0, ({pos} - {after}) div {size})")
    last = F.expr(f"({pos} + {before}) div {size}")
    spread = positioned.withColumn("_block", F.explode(F.sequence(first, last)))
    return spread, F.col("_block") == F.expr(f"{pos} div {size}")


def with_frames(
    positioned: DataFrame,
    keys: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int = 0,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add frame columns that look at most ``before`` rows back and ``after`` ahead.

    ``build`` gets the ordered window of one block and returns the columns to add.
    """
    spread, own = spread_blocks(positioned, before, after, pos, block_rows)
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    added = build(window)
    taken = set(added) & set(positioned.columns)
    if taken:
        raise ValueError(f"frame columns exist already: {sorted(taken)}")
    framed = spread.select("*", *[c.alias(n) for n, c in added.items()])
    return framed.filter(own).drop("_block")


def with_sliding_moments(
    positioned: DataFrame,
    keys: Sequence[str],
    value: str,
    rows: int,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add n, mean and m2 (sum of squared deviations) of the last ``rows`` rows as
    ``_sn``, ``_sm`` and ``_sq``.

    A plain sliding frame visits ``rows`` rows for each row. Here a series is cut into runs of
    that length: each frame is the end of one run and the start of the next, both of which are
    running aggregates, and the two are merged. A constant frame has m2 exactly 0.
    """
    spread, own = spread_blocks(positioned, rows - 1, 0, pos, block_rows)
    spread = spread.withColumn("_run", F.expr(f"{pos} div {rows}"))
    run = Window.partitionBy(*keys, "_block", "_run")
    start = run.orderBy(F.col(pos).asc()).rowsBetween(Window.unboundedPreceding, 0)
    end = run.orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    # Ordered like the runs, so that each direction needs one sort.
    block = Window.partitionBy(*keys, "_block")
    line = block.orderBy("_run", pos)
    whole_block = block.orderBy("_run", F.col(pos).desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # Values relative to one of the block: a constant series becomes zeros.
    spread = spread.withColumn("_pivot", F.first(value, ignorenulls=True).over(whole_block))
    spread = spread.withColumn("_d", F.col(value) - F.col("_pivot"))
    moments = {"n": F.count("_d"), "m": F.avg("_d"), "v": F.var_pop("_d")}
    out = spread.select("*", *[c.over(end).alias(f"_e{k}") for k, c in moments.items()])
    out = out.select("*", *[c.over(start).alias(f"_b{k}") for k, c in moments.items()])
    # The end of the run before, from this frame's first row on; none where the run is whole.
    whole = F.col(pos) % rows == rows - 1
    ahead = [F.when(~whole, F.lag(f"_e{k}", rows - 1).over(line)).alias(f"_a{k}") for k in moments]
    out = out.select("*", *ahead).filter(own)
    zero = F.lit(0.0)
    na, nb = F.coalesce("_an", F.lit(0)), F.col("_bn")
    n = na + nb
    ma, mb = F.coalesce("_am", "_bm"), F.coalesce("_bm", "_am")
    shift = ma - mb
    qa, qb = F.coalesce(F.col("_av") * na, zero), F.coalesce(F.col("_bv") * nb, zero)
    added = {
        "_sn": n,
        "_sm": F.col("_pivot") + mb + shift * F.try_divide(na, n),
        "_sq": qa + qb + shift * shift * F.try_divide(na * nb, n),
    }
    return with_computed(out, added).select(*positioned.columns, *added)


def last_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str | None = None
) -> DataFrame:
    """The last ``n`` rows of each key by ``order``; ``rank`` 1 is the newest.

    Spark keeps only ``n`` rows per key and task before the shuffle (window group limit),
    so a hot key sends ``n`` rows per task, not its rows. Above that operator's limit rows are
    numbered by range instead; the result is the same.
    """
    newest = [F.col(c).desc() for c in order]
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        df = with_position(df, keys, order, "_pos", "_total")
        df = df.filter(F.col("_pos") >= F.col("_total") - n)
        out = df.withColumn("_rn", F.col("_total") - F.col("_pos"))
        out = out.drop("_pos", "_total")
    else:
        window = Window.partitionBy(*keys).orderBy(*newest)
        out = df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")
