"""Process tables: filters, rankings, trees and connections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import clamp
from pulsegrid.plans.ordering import last_n
from pulsegrid.plans.staging import stage

NUMERIC_SORT = ("cpu_percent", "memory_percent", "pid", "memory_rss", "memory_vms")
TEXT_SORT = ("name", "username", "status")


def clamp_percent(processes: DataFrame, column: str = "cpu_percent") -> DataFrame:
    return processes.withColumn(column, clamp(F.col(column)))


def filter_processes(
    processes: DataFrame,
    name: str | None = None,
    exact: bool = False,
    user: str | None = None,
    min_cpu: float | None = None,
    min_memory: float | None = None,
    status: str | None = None,
) -> DataFrame:
    """All given conditions together; names match a part in any case unless ``exact``."""
    if name is not None:
        matched = F.col("name") == name if exact else F.lower("name").contains(name.lower())
        processes = processes.filter(matched)
    if user is not None:
        processes = processes.filter(F.lower("username") == user.lower())
    if min_cpu is not None:
        processes = processes.filter(F.col("cpu_percent") >= min_cpu)
    if min_memory is not None:
        processes = processes.filter(F.col("memory_percent") >= min_memory)
    if status is not None:
        processes = processes.filter(F.lower("status") == status.lower())
    return processes


def _sort_columns(by: str) -> list[Column]:
    if by in NUMERIC_SORT:
        first = F.col(by).desc()
    elif by in TEXT_SORT:
        first = F.col(by).asc()
    else:
        raise ValueError(f"unknown sort column {by}")
    return [first, F.col("pid").asc()]


def sort_processes(processes: DataFrame, by: str = "cpu_percent", limit: int | None = None) -> DataFrame:
    """Numbers descending, texts ascending, ties by pid; with ``limit`` a distributed top-k."""
    out = processes.orderBy(*_sort_columns(by))
    return out if limit is None else out.limit(limit)


def dedupe_pids(processes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per pid, the first by ``order``; combined map-side, so hot pids do not gather."""
    others = [c for c in processes.columns if c != "pid"]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return processes.groupBy("pid").agg(first.alias("_p")).select("pid", "_p.*").select(*processes.columns)


def top_processes(processes: DataFrame, metric: str = "cpu_percent", count: int = 10) -> DataFrame:
    """The ``count`` processes with the highest peak of ``metric``, one row per pid."""
    peak = processes.groupBy("pid").agg(F.max(metric).alias(metric), F.max_by("name", F.struct(metric, "name")).alias("name"))
    return peak.orderBy(F.col(metric).desc(), F.col("pid")).limit(count)


def process_history(processes: DataFrame, pid: int) -> DataFrame:
    """All measurements of one process by time."""
    return processes.filter(F.col("pid") == pid).orderBy("timestamp")


def process_tree(processes: DataFrame, root: int) -> DataFrame:
    """Descendants of a process with depth and path, by ancestors 1, 2, 4, … levels up.

    In each round a process that has not reached the root takes over the ancestor of its
    ancestor, twice as far up, so a tree of depth d takes log2(d) rounds. The first rounds find
    the descendants and carry no paths: a cycle never reaches the root and is left behind there.
    The second ones join the paths of the descendants alone. A parent that is not in the table
    ends a way. ``processes`` needs pid, parent_pid, name and status; of several rows of a pid
    the least counts.
    """
    one = F.min(F.struct("parent_pid", "name", "status"))
    nodes = processes.groupBy("pid").agg(one.alias("_p")).select("pid", "_p.*")
    nodes = stage(nodes.filter(F.col("pid").isNotNull()), "tree-nodes")
    links = nodes.filter((F.col("pid") != root) & F.col("parent_pid").isNotNull())
    links = links.select("pid", F.col("parent_pid").alias("up"))
    below = _climbed(links, root, {}).select("pid")
    own = stage(links.join(below, "pid").withColumn("path", F.array("pid")), "tree-links")
    paths = _climbed(own, root, {"path": lambda upper, lower: F.concat(upper, lower)})
    start = nodes.filter(F.col("pid") == root).select("pid", F.array().cast(paths.schema["path"].dataType).alias("path"))
    reached = paths.select("pid", F.concat(F.array(F.lit(root).cast(nodes.schema["pid"].dataType)), "path").alias("path"))
    # The root itself has the path of one; below it only if it is in the table.
    found = start.withColumn("path", F.array("pid")).union(reached.join(start.select(), how="left_semi"))
    return nodes.join(found, "pid").select(
        "pid", "name", "status", (F.size("path") - 1).alias("depth"), "path", F.lit(root).alias("root")
    )


def _climbed(links: DataFrame, root: int, joined: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``links`` (pid, up) whose way leads to ``root``, followed to it. ``joined`` says how a
    column of the upper part of a way and that of the lower part become one."""
    most = links.count()
    waiting = stage(links.filter(F.col("up") != root), "tree-waiting")
    done, reach = links.filter(F.col("up") == root), 1
    # A way without a cycle is no longer than the number of links.
    while reach <= most and not waiting.isEmpty():
        upper = done.unionByName(waiting)
        upper = upper.select(F.col("pid").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in joined])
        both = [f(F.col(f"_{c}"), F.col(c)).alias(c) for c, f in joined.items()]
        moved = stage(waiting.join(upper, "up").select("pid", F.col("_up").alias("up"), *both), "tree-moved")
        done = stage(done.unionByName(moved.filter(F.col("up") == root)), "tree-done")
        waiting = moved.filter(F.col("up") != root)
        reach *= 2
    return done


def _family(col: Column) -> Column:
    return F.when(col == "AF_INET", "IPv4").when(col == "AF_INET6", "IPv6").otherwise("Other")


def _kind(col: Column) -> Column:
    return F.when(col == "SOCK_STREAM", "TCP").when(col == "SOCK_DGRAM", "UDP").otherwise("Other")


def connection_breakdown(connections: DataFrame) -> DataFrame:
    """Counts by status, family, type and local port, with one shuffle of partial counts."""
    named = connections.select(
        "status",
        _family(F.col("family")).alias("family"),
        _kind(F.col("type")).alias("type"),
        F.col("local_port").cast("string").alias("port"),
    )
    dims = ["status", "family", "type", "port"]
    grouped = named.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(
        F.count("*").alias("connections"), F.grouping_id().alias("_gid")
    )
    # grouping_id has the bit of every dimension that is rolled up.
    dimension = F.lit(None).cast("string")
    for i, c in enumerate(dims):
        kept = (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
        dimension = F.when(F.col("_gid") == kept, c).otherwise(dimension)
    return grouped.select(dimension.alias("dimension"), F.coalesce(*dims).alias("value"), "connections")


def connection_process_join(connections: DataFrame, processes: DataFrame) -> DataFrame:
    """Connections per process name; connections of unknown pids do not count.

    Connections are counted per pid first, so a busy pid joins as one row.
    """
    per_pid = connections.filter(F.col("pid").isNotNull()).groupBy("pid").agg(F.count("*").alias("n"))
    names = processes.select("pid", "name")
    return per_pid.join(names, "pid").groupBy("name").agg(F.sum("n").alias("connections"))


def connection_change(connections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest number of connections and its difference to the snapshot before (0 if none)."""
    totals = connections.groupBy(*keys, "timestamp").agg(F.count("*").alias("total"))
    newest = last_n(totals, keys, ["timestamp"], 2, rank="_rn")
    agg = newest.groupBy(*keys).agg(
        F.max("timestamp").alias("timestamp"),
        F.max(F.when(F.col("_rn") == 1, F.col("total"))).alias("current_connections"),
        F.max(F.when(F.col("_rn") == 2, F.col("total"))).alias("_previous"),
    )
    change = F.coalesce(F.col("current_connections") - F.col("_previous"), F.lit(0))
    return agg.withColumn("connection_change", change).drop("_previous")
