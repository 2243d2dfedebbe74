import pytest

import brute
from leaseloom.llm import decontamination as D

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, "!!"), (5, ""),
         (6, "two three four five six seven eight nine ten eleven twelve thirteen"), (7, "über alles é 1 2 3 4 5 6 7 8"), (7, "short item"), (None, "zebra")]
TEXTS = [
    "x one two three four five six seven eight nine ten y", "ONE, two-three four. five six seven eight nine ten; eleven twelve thirteen", "short", "a SHORT item! short item",
    "one two three four five six seven eight nine", None, "", "Über alles é 1 2 3 4 5 6 7 8 9", "zebra", "one two three four five six seven eight nine " * 30 + "ten " * 3]
ROWS = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[0])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, block_bytes):
    df = spark.createDataFrame(ROWS, "insight_id bigint, detail string").selectExpr("*", "'x' as spans", "1 as n_words")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = [(r.insight_id, r.n_words, [k for s in r.spans for k in range(s["first"], s["last"] + 1)], r["items"])
           for r in D.find_held_out(df, items, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted(brute.held_out_hits(ROWS, ITEMS), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_cut_and_pass_through(spark, block_bytes):
    df = spark.createDataFrame([(1, "s", "keep, short ITEM. and this"), (2, "t", "nothing"), (3, "u", None)], "insight_id bigint, _held_spans string, detail string")
    out = D.without_held_out(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"), block_bytes=block_bytes)
    assert out.columns == ["insight_id", "_held_spans", "detail"]
    assert sorted(map(tuple, out.collect())) == [(1, "s", "keep, . and this"), (2, "t", "nothing"), (3, "u", None)]


def test_a_task_looks_up_one_block_at_a_time(spark):
    df = spark.createDataFrame(ROWS, "insight_id bigint, detail string")
    found = D.find_held_out(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"), block_bytes=20)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "insight_id bigint, detail string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_held_out(none, items).collect() == []
    [row] = D.find_held_out(spark.createDataFrame([(1, "a b")], "insight_id bigint, detail string"), items).collect()
    assert (row.n_words, row.spans, row["items"]) == (2, [], [])
