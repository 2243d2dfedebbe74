import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leaseloom.functions import scalars as C


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(fn(F.col("v"))).collect()]


def test_decimals(spark):
    texts = [None, "", "0", "260,778.00", "$1,234.56", "(1,234.00)", "(-5)", "97.6666666666667", "97.5%", "  ", "()", "not a number", "1.2.3", "-"]
    got = apply(spark, C.as_decimal, texts)
    want = ["0", "0", "0", "260778.00", "1234.56", "-1234.00", "5", "97.6666666666667", "97.5", "0", "0", None, None, None]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_dates(spark):
    texts = ["02/25/2026", "2/5/2026", "2026-02-25", "02/25/26", "07/04/69", "07/04/68", "", None, "14 March", "02/30/2026", "2026-02"]
    d = dt.date
    assert apply(spark, C.as_date, texts) == [
        d(2026, 2, 25), d(2026, 2, 5), d(2026, 2, 25), d(2026, 2, 25), d(1969, 7, 4), d(2068, 7, 4), None, None, None, None, None]
    assert apply(spark, C.as_date_error, texts) == [False] * 8 + [True] * 3


def test_ints(spark):
    texts = ["650", "650.00", "1,200", "1.5", "", None, "x"]
    assert apply(spark, C.as_int, texts) == [650, 650, 1200, None, None, None, None]
    assert apply(spark, C.as_int_error, texts) == [False, False, False, True, False, False, True]


def test_figures_that_are_the_same(spark):
    texts = ["96.00", "96", "96%", "$96.00", "(1,234.50)", "-0.50", "0.00", "Occupied", "100", "1,000", "1997-12-31", ".5"]
    assert apply(spark, C.normalise_figure, texts) == [
        "96", "96", "96", "96", "-1234.5", "-0.5", "0", "occupied", "100", "1000", "1997-12-31", "0.5"]


@pytest.mark.parametrize("capture, occ, want", [
    (95.0, 95.0, "performing"), (95.0, 94.99, "vacancy_led"), (94.99, 95.0, "leaking"), (94.99, 94.99, "distressed"),
    (None, 95.0, None), (95.0, None, None)])
def test_quadrant_equality_is_the_high_side(spark, capture, occ, want):
    row = spark.createDataFrame([(capture, occ)], "c double, o double")
    assert row.select(C.quadrant(F.col("c"), F.col("o"), F.lit(95.0), F.lit(95.0))).first()[0] == want


def test_status_book_type_and_asset(spark):
    codes = ["134r", "134land", "134c", "138a", "ALTAPM", "115R"]
    assert apply(spark, C.derive_book_type, codes) == ["residential", "land", "commercial", "affordable", "other", "residential"]
    assert apply(spark, C.derive_asset_key, codes) == ["134", "134", "134", "138", "ALTAPM", "115"]
    rows = spark.createDataFrame([("future", "VACANT", None), ("current", "VACANT", dt.date(2026, 1, 1)), ("current", None, dt.date(2026, 1, 1)),
                                  ("current", None, None)], "s string, x string, m date")
    assert [r[0] for r in rows.select(C.derive_status(F.col("s"), F.col("x"), F.col("m"))).collect()] == ["future", "vacant", "notice", "occupied"]


def test_similarity_and_search(spark):
    assert apply(spark, lambda c: C.trigram_similarity(c, F.lit("two words")), ["word", "two words", "", "zzz"]) == [
        pytest.approx(4 / 11), 1.0, 0.0, 0.0]
    assert apply(spark, lambda c: C.contains_term(c, "50%_a"), ["x50%_A", "x50xxa", "50%ba"]) == [True, False, False]


def test_rounding_is_half_away_from_zero(spark):
    row = spark.createDataFrame([(Decimal("0.005"), 1), (Decimal("-0.005"), 1), (Decimal("24.6899992"), 2)], "n decimal(12,7), d int")
    assert [str(r[0]) for r in row.select(F.round(F.col("n"), 2)).collect()][:2] == ["0.01", "-0.01"]
    counts = spark.createDataFrame([(1, 8, "12.50"), (1, 3, "33.33"), (2, 3, "66.67"), (1, 800, "0.13"), (1, 0, None)], "n bigint, d bigint, w string")
    assert all((None if r.p is None else str(r.p)) == r.w for r in counts.select(C.percent(F.col("n"), F.col("d")).alias("p"), "w").collect())


def test_canonical_json(spark):
    df = spark.createDataFrame([("115r", Decimal("96.00"), None, dt.date(2026, 2, 25), ["b", "a"])], "code string, pct decimal(5,2), gone int, day date, list array<string>")
    assert df.select(C.canonical_json(df)).first()[0] == '{"code":"115r","day":"2026-02-25","list":["b","a"],"pct":"96.00"}'
