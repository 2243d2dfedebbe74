"""The driver's line items are numbered in their lease's block as one window over the lease would, however many a lease has."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leaseloom.plans import driver_tables as D


def lines(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 40), rng.choice([0, 1, 1, 2, None]), rng.choice([None, *range(0, 40_000, 1000)]), rng.randint(1, 9),
             float(rng.randint(1, 50)), float(i)) for i in range(1500)]
    return spark.createDataFrame(rows, "lease_id long, slot int, partkey long, suppkey long, quantity double, price double")


@pytest.mark.parametrize("long", [[], [1], [1, 7]])
def test_lines_are_numbered_by_lease(spark, long):
    # the price alone tells the rows apart, and is dropped in the end
    df = lines(spark).withColumn("amount", F.col("price"))
    got = D.numbered_charges(df, spark.createDataFrame([(x,) for x in long], "lease_id long"))
    order = Window.partitionBy("lease_id").orderBy("slot", "partkey", "suppkey", "quantity", "price")
    want = df.filter("slot IS NOT NULL AND partkey IS NOT NULL").select("lease_id", "amount", F.row_number().over(order).cast("bigint").alias("line_no"))
    assert got.schema["line_no"].dataType == want.schema["line_no"].dataType
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_no_count_of_lines_without_long_leases(spark):
    """One group for nearly every line was what filled the memory of the tasks."""
    plan = D.numbered_charges(lines(spark), spark.createDataFrame([], "lease_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_lines_are_dealt_by_order_before_they_are_added_up(spark):
    heads = D.lease_heads(D.read(spark, "/root/testdata/sf0.001", "orders"), D.read(spark, "/root/testdata/sf0.001", "customer"))
    plan = D.lease_frame(heads, D.read(spark, "/root/testdata/sf0.001", "lineitem"))._jdf.queryExecution().executedPlan().toString()
    at = plan.index("partial_sum")
    assert "REPARTITION_BY_COL" in plan[at:]
