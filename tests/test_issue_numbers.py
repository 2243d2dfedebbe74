"""Findings get their numbers in the order of rule, file and row, in parts that stay small."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from leaseloom.plans import load


def test_findings_of_one_rule_and_file_are_numbered_in_parts(spark):
    """Two files may hold all findings of a rule: they are numbered by rule, file and row, no part of it larger than some rows of a file."""
    found = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("file_id"), F.lit("warning").alias("severity"),
        F.concat(F.lit("rule"), F.col("id") % 3).alias("rule"), F.when(F.col("id") % 5 != 0, (F.col("id") * 97 % 3000 * 100).cast("int")).alias("sheet_row"),
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("detail"))
    got = load._issues(found, F.lit(1).cast("bigint"), 10)
    order = Window.orderBy("rule", "file_id", "sheet_row", F.to_json("detail"))
    want = found.select((F.row_number().over(order) + 10).alias("issue_id"), F.col("detail")["n"].alias("n"))
    assert sorted((r.issue_id, r.detail["n"]) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert re.search(r"row_number\(\) windowspecdefinition\([^)]*_rows#", got._jdf.queryExecution().executedPlan().toString())
