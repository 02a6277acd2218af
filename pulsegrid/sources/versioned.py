"""Partitioned parquet tables whose changes become visible by one rename.

A commit writes its rows to a folder of its own and then puts a manifest in place that says, for
every part (partition folder), which commits its rows are in. Readers follow the newest manifest,
so a writer that is killed leaves the table as it was, and what it wrote is replaced when the same
commit runs again. A manifest has one entry per part, not per row or file. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.staging import stage
from pulsegrid.sources.storage import filesystem

BUCKETS = 64


class VersionedTable:
    """Table at ``path``, partitioned by the column ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: str = "date") -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._fs, self._jvm = filesystem(spark, path)

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]

    def versions(self) -> list[int]:
        """Numbers of all commits, ascending."""
        return sorted(int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[0] not in "._")

    def manifest(self, version: int | None = None) -> dict:
        """Schema, parts and properties as of a commit, by default the newest."""
        known = self.versions()
        if not known:
            return {"schema": None, "parts": {}, "properties": {}}
        file = f"{self.path}/commits/{version or known[-1]:012d}.json"
        return json.loads(self.spark.read.option("wholetext", True).text(file).first()[0])

    def parts(self) -> list[str]:
        """Names of the parts that hold rows, such as ``date=2024-01-31``."""
        return sorted(self.manifest()["parts"])

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some parts, as of a commit."""
        state = self.manifest(version)
        if state["schema"] is None:
            raise ValueError(f"no commit in {self.path}")
        schema = T.StructType.fromJson(state["schema"])
        wanted = state["parts"] if parts is None else [p for p in parts if p in state["parts"]]
        paths = [f"{self.path}/data/_commit={v}/{p}" for p in wanted for v in state["parts"][p]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*schema.names)

    def commit(
        self,
        df: DataFrame,
        version: int | None = None,
        replace: Iterable[str] | None = None,
        properties: dict | None = None,
    ) -> bool:
        """Add the rows of ``df``; with ``replace``, in place of those parts, which go if ``df``
        has no row of them. False, and nothing done, if ``version`` is committed already."""
        known = self.versions()
        last = known[-1] if known else 0
        version = last + 1 if version is None else version
        if version <= last:
            return False
        state = self.manifest()
        folder = f"data/_commit={version}"
        # Rows of a part meet in few files; a large part is split.
        rows = df.hint("rebalance", self.by)
        rows.write.mode("overwrite").partitionBy(self.by).parquet(f"{self.path}/{folder}")
        gone = set(replace or ())
        now = {p: vs for p, vs in state["parts"].items() if p not in gone}
        for part in self._names(folder):
            if part.startswith(f"{self.by}="):
                now[part] = [*now.get(part, []), version]
        fields = [*[f for f in df.schema.fields if f.name != self.by], df.schema[self.by]]
        # Written parquet columns are nullable.
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        text = json.dumps(
            {"schema": schema.jsonValue(), "parts": now, "properties": properties or state["properties"]}
        )
        draft, final = self._at("commits", f"_{version}.draft"), self._at("commits", f"{version:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"commit {version} of {self.path} was not put in place")
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the newest ``keep`` commits refers to; the older commits can no
        longer be read, and their manifests go first."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._at("commits", f"{v:012d}.json"), False)
        used = {(v, p) for k in known[-keep:] for p, vs in self.manifest(k)["parts"].items() for v in vs}
        removed = 0
        for folder in self._names("data"):
            v = int(folder.split("=")[1])
            parts = [p for p in self._names(f"data/{folder}") if p.startswith(f"{self.by}=")]
            stale = [p for p in parts if (v, p) not in used]
            whole = len(stale) == len(parts)
            for target in [folder] if whole else [f"{folder}/{p}" for p in stale]:
                self._fs.delete(self._at("data", target), True)
            removed += len(stale)
        return removed


def append_dated(table: VersionedTable, df: DataFrame, ts: str = "timestamp", version: int | None = None) -> bool:
    """Commit rows to a table partitioned by date."""
    return table.commit(df.withColumn("date", F.to_date(ts)), version)


def append_new(
    table: VersionedTable, df: DataFrame, row_id: Sequence[str], ts: str = "timestamp", version: int | None = None
) -> bool:
    """Commit the rows that a table partitioned by date does not have yet, known by ``row_id``.

    Only the dates that ``df`` has rows of are looked at: a row that comes again has the same time.
    """
    dated = df.withColumn("date", F.to_date(ts)).dropDuplicates([*row_id])
    state = table.manifest()
    if state["schema"] is not None:
        dates = [r[0] for r in dated.select("date").distinct().collect()]  # at most one per part
        names = [f"date={d.isoformat() if d else '__HIVE_DEFAULT_PARTITION__'}" for d in dates]
        dated = join_keys(dated, table.read(names).select(*row_id), list(row_id), "left_anti")
    return table.commit(dated, version)


def retain(table: VersionedTable, as_of: datetime, days: int = 7, ts: str = "timestamp") -> DataFrame:
    """Remove rows older than ``days`` from a table partitioned by date, in one commit.

    Older dates leave the manifest, only the date of the cut is rewritten. Rows without a time
    stay. The data stays on disk until ``vacuum``.
    """
    cutoff = as_of - timedelta(days=days)
    edge = f"date={cutoff.date().isoformat()}"
    # Rows without a time are in a part whose name comes after all dates.
    old = [p for p in table.parts() if p <= edge]
    if old:
        table.commit(table.read([edge]).filter(F.col(ts) >= F.lit(cutoff)), replace=old)
    return table.read()


class ChangeTable:
    """Rows kept up to date by batches of changes, in buckets of the key's hash.

    A batch rewrites only the buckets it has changes for. The last sequence of every key is kept,
    also of deleted ones, so changes may come late, out of order or twice.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: Sequence[str], sequence: Sequence[str], buckets: int = BUCKETS
    ) -> None:
        self.table = VersionedTable(spark, path, "_bucket")
        self.key, self.sequence = list(key), list(sequence)
        # Rows stay in the bucket they were first written to.
        self.buckets = int(self.table.manifest()["properties"].get("buckets", buckets))

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def load(self, base: DataFrame, changes: DataFrame) -> bool:
        """First commit: rows that every change comes after. ``changes`` (any, also none) gives the
        types of the sequence columns. A later call does nothing."""
        before = {c: F.lit(None).cast(changes.schema[c].dataType) for c in self.sequence}
        rows = base.withColumns(before | {"_deleted": F.lit(False)})
        return self.table.commit(self._placed(rows), 1, properties={"buckets": self.buckets})

    def apply(self, changes: DataFrame, version: int | None = None, op: str = "op") -> bool:
        """Merge a batch: per key the newest change counts, ``delete`` removes the row.

        ``version`` numbers the batch (2 and up), so that one that runs again has no effect.
        """
        known = self.table.versions()
        if version is not None and known and version <= known[-1]:
            return False
        payload = [c for c in changes.columns if c not in (*self.key, *self.sequence, op)]
        columns = [*payload, *self.sequence, "_deleted"]

        def newest(rows: DataFrame) -> DataFrame:
            # Combined in the tasks before the shuffle, whatever share of the log a key has.
            best = F.max_by(F.struct(*columns), F.struct(*self.sequence))
            return rows.groupBy(*self.key).agg(best.alias("_r")).select(*self.key, "_r.*")

        marked = changes.withColumn("_deleted", F.col(op).eqNullSafe("delete"))
        fresh = stage(self._placed(newest(marked)), "changes")
        touched = [f"_bucket={r[0]}" for r in fresh.select("_bucket").distinct().collect()]  # at most `buckets`
        rows = fresh.drop("_bucket")
        if known:
            rows = self.table.read(touched).select(*rows.columns).unionByName(rows)
        merged = self._placed(newest(rows))
        return self.table.commit(merged, version, replace=touched, properties={"buckets": self.buckets})

    def read(self) -> DataFrame:
        """The rows as they are now."""
        return self.table.read().filter(~F.col("_deleted")).drop("_bucket", "_deleted", *self.sequence)
