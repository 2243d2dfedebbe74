"""A store changes at once, rewrites what it must, and forgets what nobody reads."""

from pathlib import Path

import pytest

from leaseloom.sources.folders import shared_folder
from leaseloom.sources.versions import Store

SCHEMA = "snapshot_id int, property_id int, v int"


def rows(store, name="t"):
    return sorted((r.snapshot_id, r.property_id, r.v) for r in store.read(name).collect())


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_readers_see_the_last_state_alone(spark):
    store = Store(spark, shared_folder(spark))
    frame = spark.createDataFrame([(s, p, s * p) for s in (1, 2, 3) for p in (1, 2)], SCHEMA)
    store.replace("t", frame, [1, 2, 3])
    store.put("d", frame.limit(1))
    assert not Store(spark, store.path).tables
    store.commit()
    seen = Store(spark, store.path)
    assert rows(seen) == rows(store) and seen.read("d").count() == 1
    # a writer that dies after its writes
    dying = Store(spark, store.path)
    dying.replace("t", frame.filter("snapshot_id = 2").withColumn("v", frame.v + 100), [2])
    dying.append("d", frame)
    assert rows(dying)[2:4] == [(2, 1, 102), (2, 2, 104)] and dying.read("d").count() == 7
    assert rows(Store(spark, store.path)) == rows(seen) and Store(spark, store.path).read("d").count() == 1
    # and one that comes second
    fast, slow = Store(spark, store.path), Store(spark, store.path)
    fast.put("d", frame)
    slow.put("d", frame.limit(2))
    fast.commit()
    with pytest.raises(RuntimeError, match="faster"):
        slow.commit()
    assert Store(spark, store.path).read("d").count() == 6


def test_a_replacement_writes_the_touched_dates_once(spark):
    store = Store(spark, shared_folder(spark))
    frame = spark.createDataFrame([(s, p, s * p) for s in range(1, 6) for p in range(3)], SCHEMA)
    store.replace("t", frame, list(range(1, 6)))
    store.commit()
    before = files(store.path)
    store.replace("t", spark.createDataFrame([(2, 1, -1)], SCHEMA), [2], spark.createDataFrame([(2, 1)], "snapshot_id int, property_id int"))
    store.commit()
    after = files(store.path)
    assert all(after[f] == t for f, t in before.items())
    assert {f.parent.name for f in after.keys() - before.keys()} == {"snapshot_id=2"}
    assert [r for r in rows(store) if r[0] == 2] == [(2, 0, 0), (2, 1, -1), (2, 2, 4)] and len(rows(store)) == 15
    # a book, and a date, that lose their last row
    store.replace("t", frame.limit(0), [3], spark.createDataFrame([(3, 0), (3, 1)], "snapshot_id int, property_id int"))
    store.replace("u", frame.filter("snapshot_id = 1"), [1])
    store.replace("u", frame.limit(0), [1])
    store.commit()
    assert [r for r in rows(store) if r[0] == 3] == [(3, 2, 6)] and rows(store, "u") == []
    with pytest.raises(ValueError, match="not replaced"):
        Store(spark, store.path).replace("t", frame, [1])


def test_a_snapshot_is_a_partition_filter(spark):
    store = Store(spark, shared_folder(spark))
    store.replace("t", spark.createDataFrame([(s, 1, s) for s in range(1, 9)], SCHEMA), list(range(1, 9)))
    plan = store.read("t").filter("snapshot_id = 3").select("v")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in text and "ReadSchema: struct<v:int>" in text


def test_swept_stores_keep_what_is_read(spark):
    store = Store(spark, shared_folder(spark))
    frame = spark.createDataFrame([(s, 1, s) for s in (1, 2)], SCHEMA)
    for k in range(4):
        days = [1, 2] if k == 0 else [2]
        store.replace("t", frame.filter(frame.snapshot_id.isin(days)).withColumn("v", frame.v + k), days)
        store.append("a", frame.filter(f"v = {k}"))
        store.commit()
    held = len(files(store.path))
    Store(spark, store.path).replace("t", frame, [1, 2])  # never committed
    store.sweep()
    assert rows(Store(spark, store.path)) == [(1, 1, 1), (2, 1, 5)] and rows(Store(spark, store.path), "a") == [(1, 1, 1), (2, 1, 2)]
    left = {f.parent.name for f in files(store.path) if "/t/" in str(f)}
    assert left == {"snapshot_id=1", "snapshot_id=2"} and len(files(store.path)) < held
    assert Store(spark, store.path).number == 4
