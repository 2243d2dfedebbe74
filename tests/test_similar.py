"""Many names looked up at once give what each gives alone."""

import uuid

import pytest

from leaseloom.operators import ledger as L
from leaseloom.operators import marts as M
from leaseloom.operators import reads as R
from leaseloom.operators.similar import nearest_names, postings, similar_names
from leaseloom.plans import catalog
from leaseloom.sources.bucketed import co_located


@pytest.fixture(scope="module")
def T(spark, sf_dir):
    return catalog.context(spark, sf_dir).T


def brute(a, b):
    def grams(text):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {f"  {w} "[k:k + 3] for w in words for k in range(len(w) + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


NAMES = ["RENT", "RENTAFF", "PARKING", "PETFEE", "PETFEEM", "W/D", "CONPARK", "A B C", "!!", "TRASH"]
TERMS = ["RENTS", "pet fee", "w d", "", "??", "ZZZZ", "CONPARKING", "RENT", "RENT", None]


def test_nearest_names_against_brute_force(spark):
    names = spark.createDataFrame([(n,) for n in [*NAMES, "RENT", None]], "charge_code string")
    asked = spark.createDataFrame([(t,) for t in TERMS], "term string")
    posted = postings(names, "charge_code")
    got = {}
    for r in nearest_names(asked, posted, names, "charge_code", 4).orderBy("term", "place").collect():
        got.setdefault(r.term, []).append((r.name, round(r.similarity, 9)))
    want = {t: sorted(((n, round(brute(t, n), 9)) for n in NAMES), key=lambda x: (-x[1], x[0]))[:4] for t in TERMS if t is not None}
    assert got == want
    alike = {(r.term, r.name) for r in similar_names(asked, posted, 0.4).collect()}
    assert alike == {(t, n) for t in TERMS if t for n in NAMES if brute(t, n) >= 0.4} and alike
    # one by one
    for term in ("RENTS", "pet fee"):
        alone = [(r.charge_code, round(r.similarity, 9)) for r in L.nearest_codes(names.filter("charge_code is not null").distinct(), term, 4).collect()]
        assert alone == got[term]
    assert nearest_names(asked.limit(0), posted, names, "charge_code").collect() == []
    assert nearest_names(asked, posted.limit(0), names.limit(0), "charge_code").collect() == []


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_grains_are_one_aggregate_of_the_books(T):
    rows = R.book_grains(T).collect()
    kpi = M.property_snapshot_kpi(T)
    total = {r.snapshot_id: (r.units, r.pct_occupied) for r in R.portfolio_totals(T).collect()}
    assert {r.snapshot_id: (r.units, r.pct_occupied) for r in rows if r.grain == "portfolio"} == total
    assert {(r.snapshot_id, r.asset_key): r.units for r in rows if r.grain == "asset"} == {(r.snapshot_id, r.asset_key): r.units for r in R.asset_table(T).collect()}
    assert sum(r.grain == "book" for r in rows) == kpi.count()
    text = plan(R.book_grains(T))
    assert text.count("Expand") == 1


def test_leases_and_lines_meet_without_a_shuffle(spark, T):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # dimensions are small enough to be sent, the facts are not
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        near = co_located(T, f"near_{uuid.uuid4().hex[:8]}", 4)
        for mart in (M.loss_to_lease, M.unit_rent_outlier):
            text = plan(mart(near))
            moved = lambda text: [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "lease_id" in x.split("hashpartitioning(")[1].split(")")[0]]
            assert not moved(text) and "SortMergeJoin [lease_id" in text, text
            assert moved(plan(mart(T)))
            assert sorted(map(str, mart(near).collect())) == sorted(map(str, mart(T).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
