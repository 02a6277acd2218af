"""Greedy cooldown over series of any size.

Firing is greedy: after a breach fires, its series is silent for the cooldown, so each firing
depends on the one before. Every breach has one successor, the first breach at least a cooldown
later, and the firings are the way from a series' first breach along the successors.

The successor is a count: it is the number of breaches before ``time + cooldown``. Numbering the
breaches together with copies of them shifted by the cooldown gives it, since a shifted copy has
as many shifted copies before it as its breach has breaches. A sort by time does this, whatever
number of breaches falls inside one cooldown.

Long series are cut into blocks of consecutive breaches. A block follows its successors to the
first one behind its end, for the breaches where a way can enter it. These jumps are composed
with themselves in rounds, each twice as far as the one before, and in each round the entries
reached so far reach as many again: the logarithm of the number of blocks in rounds. A way
enters a block at most once, and each block marks its firings from there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import with_position
from pulsegrid.plans.staging import stage

BLOCK_ROWS = 100_000

_POS, _TIME, _GAP, _TOTAL, _NEXT, _BLOCK, _ENTRY = (
    f"_cooldown_{x}" for x in ("pos", "time", "gap", "total", "next", "block", "entry")
)


def successors(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``placed`` with the position of each row's successor; null where it has none."""
    targets = placed.select(*keys, F.col(_TIME), F.lit(1).alias("_kind"), _POS)
    shifted = placed.select(*keys, (F.col(_TIME) + F.col(_GAP)).alias(_TIME), F.lit(0).alias("_kind"), _POS)
    # A shifted copy comes before the breaches of its time: these may fire.
    ranked = with_position(targets.union(shifted), keys, [_TIME, "_kind", _POS], "_rank")
    counted = ranked.filter("_kind = 0").select(*keys, _POS, (F.col("_rank") - F.col(_POS)).alias(_NEXT))
    joined = join_keys(placed, counted, [*keys, _POS])
    return joined.withColumn(_NEXT, F.when(F.col(_NEXT) < F.col(_TOTAL), F.col(_NEXT)))


def _exits(keys: list[str], block_rows: int):
    """Where the ways that enter a block leave it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_POS, ignore_index=True)
        base = int(pdf[_POS].iloc[0])
        n = len(pdf)
        to = pdf[_NEXT].fillna(-1).to_numpy(np.int64)
        while True:  # doubling inside the block
            inside = (to >= 0) & (to < base + n)
            if not inside.any():
                break
            to[inside] = to[to[inside] - base]
        out = pdf[[*keys, _POS]][pdf[_ENTRY]].copy()
        out["_exit"] = pd.array(to, dtype="Int64")[pdf[_ENTRY].to_numpy()]
        out.loc[out["_exit"] < 0, "_exit"] = pd.NA
        return out

    return run


def entries(chained: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Positions at which the ways from the first rows enter blocks."""
    keys = list(keys)
    block = F.expr(f"{_POS} div {block_rows}")
    target = F.expr(f"{_NEXT} div {block_rows}")
    reached = chained.filter(target != block).select(*keys, F.col(_NEXT).alias(_POS)).distinct()
    start = chained.filter(F.col(_POS) == 0).select(*keys, _POS)
    marks = stage(reached.union(start).distinct().withColumn(_ENTRY, F.lit(True)), "cooldown-entries")
    marked = join_keys(chained, marks, [*keys, _POS], "left").withColumn(_ENTRY, F.coalesce(_ENTRY, F.lit(False)))
    types = ", ".join(f"`{k}` {chained.schema[k].dataType.simpleString()}" for k in keys)
    narrow = marked.select(*keys, block.alias(_BLOCK), _POS, _NEXT, _ENTRY)
    jumps = narrow.groupBy(*keys, _BLOCK).applyInPandas(_exits(keys, block_rows), f"{types}, {_POS} bigint, _exit bigint")
    jumps = stage(jumps.filter("_exit is not null"), "cooldown-jumps")
    found = stage(start, "cooldown-found")
    while not jumps.isEmpty():
        step = join_keys(found, jumps, [*keys, _POS]).select(*keys, F.col("_exit").alias(_POS))
        found = stage(found.union(step), "cooldown-found")
        further = jumps.select(*keys, F.col(_POS).alias("_exit"), F.col("_exit").alias("_to"))
        jumps = join_keys(jumps, further, [*keys, "_exit"]).select(*keys, _POS, F.col("_to").alias("_exit"))
        jumps = stage(jumps, "cooldown-jumps")
    return found.select(*keys, block.alias(_BLOCK), F.col(_POS).alias(_ENTRY))


def _firings(keys: list[str]):
    """Rows of a block that fire, from its entry on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_POS, ignore_index=True)
        times, gap = pdf[_TIME].to_numpy(np.int64), int(pdf[_GAP].iloc[0])
        after = np.searchsorted(times, times + gap, side="left")
        i, fired = int(pdf[_ENTRY].iloc[0] - pdf[_POS].iloc[0]), []
        while i < len(times):
            fired.append(i)
            i = int(after[i]) if gap > 0 else i + 1
        return pdf[[*keys, _POS]].iloc[fired]

    return run


def fire(
    breaches: DataFrame, keys: Sequence[str], order: Sequence[str], minutes: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows that fire. ``order`` begins with the time and identifies a row within its key; the
    cooldown is the same in all rows of a key. A null key is a key of its own."""
    keys = list(keys)
    time, gap = F.unix_micros(F.col(order[0]).cast("timestamp")), F.col(minutes).cast("bigint") * 60_000_000
    placed = with_position(breaches, keys, order, _POS, _TOTAL)
    placed = placed.withColumns({_TIME: time, _GAP: gap, _BLOCK: F.expr(f"{_POS} div {block_rows}")})
    placed = stage(placed, "cooldown")
    narrow = placed.select(*keys, _POS, _TIME, _GAP, _TOTAL, _BLOCK)
    starts = narrow.filter(f"{_POS} = 0").select(*keys, _BLOCK, F.col(_POS).alias(_ENTRY))
    long = narrow.filter(F.col(_TOTAL) > block_rows)
    if not long.isEmpty():
        chained = stage(successors(long, keys), "cooldown-successors")
        starts = starts.union(entries(chained, keys, block_rows)).distinct()
    work = join_keys(narrow, stage(starts, "cooldown-starts"), [*keys, _BLOCK])
    types = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    fired = work.groupBy(*keys, _BLOCK).applyInPandas(_firings(keys), f"{types}, {_POS} bigint")
    return join_keys(placed, stage(fired, "cooldown-fired"), [*keys, _POS], "left_semi").select(*breaches.columns)
