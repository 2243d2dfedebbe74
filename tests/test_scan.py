"""The chunked operators give what one window over the whole key gives, also when one key is hot."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leaseloom.operators import scan


def hot(spark, n=4000):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(1, 30)}", i, rng.randint(0, 50), rng.choice([None, "a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, pos int, v int, tag string")


@pytest.mark.parametrize("chunk_rows", [1 << 20, 100])
def test_prefix_scan(spark, chunk_rows):
    df = hot(spark)
    got = scan.prefix_scan(scan.with_chunks(df, "pos", chunk_rows), ["key"], "pos", lasts={"l": F.col("tag")},
                           prior_lasts={"p": F.col("tag")}, sums={"s": F.col("v")}).select("key", "pos", "l", "p", "s")
    w = Window.partitionBy("key").orderBy("pos")
    want = df.select("key", "pos", F.last("tag", True).over(w).alias("l"),
                     F.last("tag", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.sum("v").over(w).alias("s"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_two_level_row_number(spark):
    df = hot(spark)
    got = scan.two_level_row_number(df, ["key"], {"_v": F.floor(F.col("v") / 10)}, [F.col("v"), F.col("pos")], "n").select("key", "pos", "n")
    want = df.select("key", "pos", F.row_number().over(Window.partitionBy("key").orderBy("v", "pos")).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    offsets = scan.two_level_row_number(df, ["key"], {"_v": F.floor(F.col("v") / 10)}, [F.col("v"), F.col("pos")], "n", weight=F.col("v")).select("key", "pos", "n")
    before = Window.partitionBy("key").orderBy("v", "pos").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("key", "pos", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("n"))
    assert sorted(map(tuple, offsets.collect())) == sorted(map(tuple, want.collect()))


def test_median_is_an_observed_value(spark):
    df = hot(spark).withColumn("v", (F.col("v") * 37.25 - 300).cast("decimal(18,4)"))
    got = {r.key: (float(r.median), r.n) for r in scan.grouped_median_disc(df, ["key"], "v", F.lit(100)).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.key, []).append(float(r.v))
    assert got == {k: (sorted(v)[(len(v) - 1) // 2], len(v)) for k, v in groups.items()}


def test_buckets_are_placed_in_two_levels(spark):
    df = hot(spark)
    got = scan.two_level_row_number(df, ["key"], {"_tens": F.floor(F.col("v") / 10), "_v": F.col("v")}, [F.col("v"), F.col("pos")], "n", wider=["_tens"])
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("v", "pos")))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_whole_keys_hand_nothing_over(spark):
    df = hot(spark)
    dealt = scan.dealt_by_chunk(scan.with_chunks(df, "pos"), ["key"], "pos", 4000)
    got = scan.prefix_scan(dealt, ["key"], "pos", lasts={"l": F.col("tag")}, prior_lasts={"p": F.col("tag")}, sums={"s": F.col("v")}, whole=True)
    w = Window.partitionBy("key").orderBy("pos")
    want = df.select("key", "pos", F.last("tag", True).over(w).alias("l"),
                     F.last("tag", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.sum("v").over(w).alias("s"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
