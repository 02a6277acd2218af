from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.staging import stage_path
from pulsegrid.sources import versioned

T0 = datetime(2024, 1, 1)


def hourly(spark, hours, start=0):
    rows = [(i, T0 + timedelta(hours=i)) for i in range(start, start + hours)]
    return spark.createDataFrame(rows, "id long, timestamp timestamp")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_commits_add_replace_and_stay_readable(spark):
    table = versioned.VersionedTable(spark, stage_path(spark, "versioned"))
    with pytest.raises(ValueError):
        table.read()
    versioned.append_dated(table, hourly(spark, 30))
    versioned.append_dated(table, hourly(spark, 30, 30))
    assert ids(table.read()) == list(range(60))
    assert table.parts() == ["date=2024-01-01", "date=2024-01-02", "date=2024-01-03"]
    assert ids(table.read(["date=2024-01-02"])) == list(range(24, 48))
    day = table.read(["date=2024-01-02"]).filter("id < 30")
    table.commit(day, replace=["date=2024-01-02", "date=2024-01-03"])
    assert ids(table.read()) == list(range(30)) and ids(table.read(version=2)) == list(range(60))
    assert table.vacuum() > 0 and table.versions() == [3]
    assert ids(table.read()) == list(range(30))


def test_a_commit_runs_once_and_a_killed_one_leaves_the_table(spark, monkeypatch):
    path = stage_path(spark, "versioned")
    table = versioned.VersionedTable(spark, path)
    assert versioned.append_dated(table, hourly(spark, 10), version=1)
    assert not versioned.append_dated(table, hourly(spark, 10), version=1)

    def killed(*_, **__):
        raise RuntimeError("killed")

    # The data is written, the manifest is not.
    monkeypatch.setattr(versioned.json, "dumps", killed)
    with pytest.raises(RuntimeError):
        versioned.append_dated(table, hourly(spark, 99, 10))
    monkeypatch.undo()
    again = versioned.VersionedTable(spark, path)
    assert ids(again.read()) == list(range(10))
    versioned.append_dated(again, hourly(spark, 5, 10))
    assert ids(again.read()) == list(range(15))


def test_retention_is_one_commit(spark):
    table = versioned.VersionedTable(spark, stage_path(spark, "versioned"))
    rows = hourly(spark, 240).unionByName(spark.createDataFrame([(-1, None)], "id long, timestamp timestamp"))
    versioned.append_dated(table, rows)
    as_of = T0 + timedelta(hours=239)
    kept = versioned.retain(table, as_of, days=7)
    assert ids(kept) == [-1, *range(239 - 168, 240)]
    assert len(table.versions()) == 2 and ids(table.read(version=1)) == [-1, *range(240)]
    versioned.retain(table, as_of + timedelta(days=30), days=7)
    table.vacuum()
    assert ids(table.read()) == [-1]
    # Nothing old: no commit.
    before = table.versions()
    versioned.retain(table, as_of, days=7)
    assert table.versions() == before


CHANGE = "id long, v string, seq long, op string"


def test_changes_out_of_order_and_delivered_again(spark):
    table = versioned.ChangeTable(spark, stage_path(spark, "changes"), ["id"], ["seq"], buckets=4)
    log = [
        [(1, "b", 5, "update"), (3, "n", 1, "insert"), (None, "z", 1, "insert")],
        [(1, "a", 2, "update"), (2, None, 9, "delete")],
        [(2, "late", 4, "update"), (1, "b", 5, "update"), (4, "x", 1, "insert"), (4, "y", 2, "update")],
        [(2, "back", 10, "insert"), (3, None, 2, "delete")],
    ]
    batches = [spark.createDataFrame(b, CHANGE) for b in log]
    base = spark.createDataFrame([(1, "base"), (2, "base"), (9, "base")], "id long, v string")
    assert table.load(base, batches[0]) and not table.load(base, batches[0])

    def state():
        return {r.id: r.v for r in table.read().collect()}

    want = [
        {1: "b", 2: "base", 3: "n", 9: "base", None: "z"},
        {1: "b", 3: "n", 9: "base", None: "z"},
        {1: "b", 3: "n", 4: "y", 9: "base", None: "z"},
        {1: "b", 2: "back", 4: "y", 9: "base", None: "z"},
    ]
    for n, (batch, expected) in enumerate(zip(batches, want)):
        assert table.apply(batch, n + 2)
        assert state() == expected
        assert not table.apply(batch, n + 2)
    for batch in batches:
        table.apply(batch)
    assert state() == want[-1]


def test_only_buckets_with_changes_are_rewritten(spark):
    table = versioned.ChangeTable(spark, stage_path(spark, "changes"), ["id"], ["seq"], buckets=16)
    changes = spark.createDataFrame([(7, "new", 1, "update")], CHANGE)
    table.load(spark.range(1000).select("id", F.lit("base").alias("v")), changes)
    table.apply(changes)
    parts = table.table.manifest()["parts"]
    assert len(parts) == 16 and sorted(v for vs in parts.values() for v in vs) == [1] * 15 + [2]
    # The number of buckets is the table's, not the caller's.
    again = versioned.ChangeTable(spark, table.table.path, ["id"], ["seq"], buckets=3)
    assert again.buckets == 16
    again.apply(spark.createDataFrame([(7, "newer", 2, "update")], CHANGE))
    assert again.read().filter("id = 7").first().v == "newer" and again.read().count() == 1000


def test_changes_without_a_load(spark):
    table = versioned.ChangeTable(spark, stage_path(spark, "changes"), ["id"], ["seq"])
    table.apply(spark.createDataFrame([(1, "a", 1, "insert"), (2, "b", 1, "delete")], CHANGE))
    assert [tuple(r) for r in table.read().collect()] == [(1, "a")]


def test_new_rows_are_added_once(spark):
    table = versioned.VersionedTable(spark, stage_path(spark, "versioned"))
    rows = hourly(spark, 50).unionByName(spark.createDataFrame([(None, T0), (77, None)], "id long, timestamp timestamp"))
    # Repeated in one batch, late, and with ties in time.
    tied = spark.createDataFrame([(100, T0), (101, T0)], "id long, timestamp timestamp")
    versioned.append_new(table, rows.filter("id > 20 or id is null").unionByName(rows.filter("id = 30")), ["id"])
    versioned.append_new(table, rows, ["id"])
    versioned.append_new(table, tied.unionByName(rows), ["id"], version=3)
    assert not versioned.append_new(table, tied, ["id"], version=3)
    got = [r.id for r in table.read().collect()]
    assert sorted(x for x in got if x is not None) == [*range(50), 77, 100, 101] and got.count(None) == 1
