import random

import pytest

import brute
from leaseloom.llm import near_dedup as N
from leaseloom.llm.components import connected_components
from leaseloom.llm.staging import Work

EDGE = [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (None, "a b"), (None, "x y z"), (7, "q w e r t y"), (7, "q w e r t y"), (-5, "q w e r t y"),
        (9, "! ! ! ! ! !")]


def versions(seed, n=200):
    """Copies of one text with some words changed: many pairs lie near the threshold, and few are linked to the first one."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(120)] = f"z{r.randrange(10**6)}"
        out.append((2000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("rows, options", [
    (EDGE, {}), (EDGE + versions(3), {"least_percent": 85, "outsiders": 7, "members": 20}), (versions(4, 80), {"least_percent": 80}), ([], {})])
def test_against_brute_force(spark, rows, options):
    df = spark.createDataFrame(rows, "insight_id bigint, detail string").selectExpr("*", "1 as place", "2 as set_key", "3 as kept")
    got = [tuple(r) for r in N.near_duplicates(df, **options).collect()]
    assert sorted(got, key=str) == sorted(brute.near_duplicates(rows, options.get("least_percent", 80)), key=str)


def test_one_of_each(spark):
    rows = [(1, "h", "a b c d e f"), (0, "h", "a b c d e f"), (0, "h", "a b c d e f"), (5, "h", ""), (5, "h", None), (None, "h", "A b c d e f"), (8, "h", "z")]
    out = N.one_of_each(spark.createDataFrame(rows, "insight_id bigint, headline string, detail string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(0, "h", "a b c d e f"), (5, "h", ""), (5, "h", None), (8, "h", "z")], key=str)


def test_the_callers_columns_come_back_whatever_they_are_called(spark):
    names = ["_set_key", "_place", "set_key", "smallest", "is_first", "place", "_place_"]
    rows = [(1, "a b c d e f", *names), (0, "a b c d e f", *names), (5, "", *names)]
    df = spark.createDataFrame(rows, f"insight_id bigint, detail string, {', '.join(f'{n} string' for n in names)}")
    out = N.one_of_each(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows[1:])


def test_signatures_lose_no_link():
    assert N.least_matches(85) == 80 and N.least_matches(100) == 128


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300), (300, 301)]
    with Work(spark) as work:
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), work, "t").collect()))
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {301: 300}
