"""Every registered query runs and, where it has an oracle, agrees with it."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import compare
from leaseloom.plans import catalog

#: Queries of rare findings: the smallest tables have none.
EMPTY = {"c11_like_escape", "r10_concentration_view"}
#: Queries whose result depends on how much there is of a book: they run on larger tables too.
BY_SIZE = [k for k in catalog.ENTRIES if k.startswith(("i3_", "i6_", "g3_", "m14_"))]


@pytest.mark.parametrize("key", list(catalog.ENTRIES))
def test_query(spark, sf_dir, key):
    why = compare.differences(spark, compare.connect(sf_dir), sf_dir, key)
    assert why is None or (why.startswith("no rows") and key in EMPTY), why


@pytest.mark.parametrize("key", BY_SIZE)
def test_query_on_larger_books(spark, sf_dir, key):
    larger = sf_dir.replace("0.001", "0.01")
    assert compare.differences(spark, compare.connect(larger), larger, key) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 175
