"""Grids in, star schema out: what is loaded is what was printed, and a reload replaces whole books."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.operators import marts as M
from leaseloom.operators import reads as R
from leaseloom.operators import rules as V
from leaseloom.operators.payload import payload_sections
from leaseloom.plans import catalog
from leaseloom.plans.load import load_reports
from leaseloom.plans.reviews import apply_review
from leaseloom.sources.folders import shared_folder
from leaseloom.sources.versions import Store
from leaseloom.tables import STORED


@pytest.fixture(scope="module")
def ctx(spark):
    return catalog.context(spark, "/root/testdata/sf0.001")


def figures(T):
    cols = ("units", "occupied_units", "future_leases", "market_rent", "balance", "square_feet")
    return {(r.as_of_date, r.property_code): tuple(r[c] for c in cols) for r in M.property_snapshot_kpi(T).collect()}


def test_load_and_reload(spark, ctx):
    out = shared_folder(spark)
    loaded = load_reports(spark, ctx.rent_grid, ctx.availability_grid, out)
    vacant = ["vacant", "model", "down"]
    rejected = (F.col("lease_id") % 311 == 0) | ((F.col("lease_id") % 307 == 0) & ~F.col("occupancy_status").isin(vacant))
    printed = ctx.T.with_frames(lease=ctx.T.lease.filter(~rejected))
    assert figures(loaded.tables) == figures(printed)
    assert loaded.tables.lease_charge.count() == ctx.T.lease_charge.join(printed.lease, "lease_id", "left_semi").count()
    assert loaded.tables.lease.select("lease_id").distinct().count() == printed.lease.count()
    assert loaded.tables.property.count() == 25 and loaded.tables.property.select("property_id").distinct().count() == 25
    rules = {r.rule for r in loaded.issues.select("rule").distinct().collect()}
    assert {"lease_row_coercion", "sentinel_field_violation", "charge_without_block", "availability_total_row_differs"} <= rules

    # reload one book with its last lease gone: only that book changes
    before = figures(loaded.tables)
    code = "100r"
    name = loaded.tables.lease.groupBy("snapshot_id", "property_id").count().join(loaded.tables.property.filter(F.col("property_code") == code), "property_id").orderBy(
        F.desc("count")).select("snapshot_id").first()[0]
    one = ctx.rent_grid.filter(F.col("file_name") == f"rr_{name // 10000}00.xlsx")
    unit = one.filter(F.col("c01").rlike("^U[0-9]+$")).orderBy("sheet_row").first()["c01"]
    gone = one.withColumn("c04", F.when(F.col("c01") == unit, "bad-id").otherwise(F.col("c04")))
    again = load_reports(spark, gone, ctx.availability_grid, out, known=loaded.tables)
    after = figures(again.tables)
    assert after.keys() == before.keys()
    changed = {k for k in after if after[k] != before[k]}
    assert {c for _, c in changed} <= {code} and len(changed) == 1
    assert again.tables.lease.count() == printed.lease.count() - 1
    assert again.tables.availability.count() == 175
    # the other files were skipped, the changed one got an id of its own
    counts = {r.status: r["count"] for r in again.tables.file.filter(F.col("run_id") == 2).groupBy("status").count().collect()}
    assert counts == {"loaded": 1, "skipped": 175}
    assert again.tables.run.count() == 2 and again.tables.unit.groupBy("property_id", "unit_code").count().filter("count > 1").isEmpty()
    assert not again.tables.lease.join(again.tables.unit, ["unit_id", "property_id", "unit_code"], "left_anti").count()

    # and a third load of the same changes nothing
    third = load_reports(spark, gone, ctx.availability_grid, out, known=again.tables)
    assert figures(third.tables) == after and third.tables.run.orderBy(F.desc("run_id")).first().files_loaded == 0


TITLE = {1: S.RENT_ROLL_TITLE}


def roll(month, rent, unit="101", resident="t1", name="Oak Court (115r)", groups=True):
    """A rent roll of one lease and its charge line."""
    lease = {1: unit, 2: "a1", 3: "700", 4: resident, 5: "N", 6: "1000.00", 7: "RENT", 8: rent, 9: "0", 10: "0", 11: "01/01/2024", 12: "12/31/2025", 14: "0"}
    body = [{1: S.CURRENT_LABEL}, lease, {7: "RENT", 8: "1.00"}, {7: "Total", 8: str(float(rent) + 1)}]
    if groups:
        body += [{1: "Summary Groups"}, {}, {1: S.CURRENT_LABEL, 8: rent, 11: "1"}, {1: "end"}]
    head = [TITLE, {1: name}, {1: f"As Of = {month}/28/2025"}, {1: f"Month Year = {month}/2025"},
            dict(enumerate(S.RENT_ROLL_HEADER_1, 1)), dict(enumerate(S.RENT_ROLL_HEADER_2, 1))]
    return head + body


def sheet(spark, files):
    rows = [(name, k, *[(row.get(c) or None) for c in range(1, 15)]) for name, body in files.items() for k, row in enumerate(body, 1)]
    return spark.createDataFrame(rows, "file_name string, sheet_row int, " + ", ".join(f"c{c:02d} string" for c in range(1, 15)))


def test_two_months_in_two_loads(spark):
    out = shared_folder(spark)
    one = load_reports(spark, sheet(spark, {"jan.xlsx": roll("01", "900.00")}), None, out)
    two = load_reports(spark, sheet(spark, {"feb.xlsx": roll("02", "700.00")}), None, out, known=one.tables)
    T = two.tables
    rents = {r.snapshot_id: float(r.contract_rent) for r in M.loss_to_lease(T).collect()}
    assert rents == {20250128: 901.0, 20250228: 701.0}
    assert T.lease.select("lease_id").distinct().count() == 2 and T.lease.select("unit_id").distinct().count() == 1 == T.unit.count()
    repeats = V.rule_duplicate_charge_code_in_block(T).collect()
    assert [r.detail["blocks_with_repeats"] for r in repeats] == ["2"]
    assert one.tables.run.first().status == two.tables.run.filter("run_id = 2").first().status
    assert {r.snapshot_id for r in two.marts["property_snapshot_kpi"].collect()} == {20250128, 20250228}
    assert R.run_history(T).count() == 2 and R.issue_summary(T).filter("rule = 'duplicate_charge_code_in_block'").count() >= 1
    assert payload_sections(T)["portfolio"].count() == 2


def test_empty_facts_and_broken_files(spark):
    out = shared_folder(spark)
    files = {"a.xlsx": roll("03", "5.00", groups=False), "b.xlsx": [{1: "something else"}] * 7}
    T = load_reports(spark, sheet(spark, files), None, out).tables
    assert T.summary_group.count() == T.charge_summary.count() == T.availability.count() == 0 and T.lease.count() == 1
    assert {(r.file_name, r.status) for r in T.file.collect()} == {("a.xlsx", "loaded"), ("b.xlsx", "failed")}
    assert T.run.first().status == "partial" and T.issue.filter("rule = 'file_parse_failed'").count() == 1
    vacant = roll("04", "0.00", resident="VACANT", groups=False)
    vacant[7] = {k: v for k, v in vacant[7].items() if k not in (7, 8)}
    only = load_reports(spark, sheet(spark, {"v.xlsx": [r for r in vacant if r.get(7) not in ("RENT", "Total") or r.get(1)]}), None, shared_folder(spark))
    assert only.tables.lease_charge.count() == 0 and M.property_snapshot_kpi(only.tables).first().vacant_units == 1
    nothing = load_reports(spark, None, None, shared_folder(spark))
    assert nothing.tables.lease.count() == 0 and nothing.tables.run.first().status == "succeeded"


FACTS = ("lease", "lease_charge", "summary_group", "charge_summary", "availability")


def folders(df):
    """The tables that a plan scans."""
    return {f.rsplit("/version=", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}


def parts(out, name):
    return set(Store(SparkSession.active(), out).tables[name]["parts"])


@pytest.fixture(scope="module")
def year(spark):
    """A store of three months, two books each."""
    out = shared_folder(spark)
    files = {f"{code}{m}.xlsx": roll(m, f"{n}00.00", name=f"Court ({code})") for n, (m, code) in enumerate([(m, c) for m in ("01", "02", "03") for c in ("115r", "116a")], 1)}
    files["116a03.xlsx"][7] |= {7: "PETFEEM"}
    return out, load_reports(spark, sheet(spark, files), None, out)


def test_reads_take_the_stored_aggregates(year):
    T = year[1].tables
    scanned = {
        "totals": R.portfolio_totals(T), "table": R.property_table(T), "assets": R.asset_table(T), "expirations": R.portfolio_expirations(T, 20250228),
        "mix": R.portfolio_charge_mix(T), "matrix": M.property_profitability(T), "bridge": M.revenue_bridge(T), "concentration": M.expiration_concentration(T),
        "findings": R.issue_summary(T), "detail": R.issue_detail(T, 20250228), "export": R.issue_export(T),
        **payload_sections(T, 20250228), **{name: rule(T, [20250128]) for name, rule in V.RULES.items()}}
    for name, df in scanned.items():
        assert not folders(df) & {"lease", "lease_charge"}, name
    # and give what the facts give
    bare = T.with_frames(lease=T.lease)
    assert bare.book_detail is None
    for read in (R.issue_summary, R.portfolio_totals, R.property_table, R.portfolio_expirations, R.portfolio_charge_mix, M.revenue_bridge):
        assert sorted(map(str, read(T).collect())) == sorted(map(str, read(bare).collect())) != []


def test_a_store_without_an_aggregate_gets_it_whole(spark):
    out = shared_folder(spark)
    load_reports(spark, sheet(spark, {f"{m}.xlsx": roll(m, "900.00") for m in ("01", "02")}), None, out)
    store = Store(spark, out)
    del store.tables["book_files"]
    store.commit()
    T = load_reports(spark, sheet(spark, {"03.xlsx": roll("03", "700.00")}), None, out).tables
    assert {(r.snapshot_id, r.file_id) for r in T.book_files.collect()} == {(r.snapshot_id, r.file_id) for r in T.lease.collect()}
    assert {r.snapshot_id for r in R.issue_summary(T).collect()} == {20250128, 20250228, 20250328}


def test_a_reloaded_book_changes_its_own_rows(spark, year):
    out, before = year
    rows = lambda T, name: {str(r) for r in getattr(T, name).collect()}
    old = {name: (rows(before.tables, name), parts(out, name)) for name in (*FACTS[:2], *STORED)}
    changed = roll("02", "777.00", name="Court (115r)")
    again = load_reports(spark, sheet(spark, {"115r02.xlsx": changed}), None, out)
    for name, (had, folders_before) in old.items():
        now = rows(again.tables, name)
        gone = had - now
        assert all("20250228" in r and "property_id=1" in r.replace("'", "") for r in gone | (now - had)), name
        assert {p.split("/")[1] for p in folders_before - parts(out, name)} == {"snapshot_id=20250228"}
    assert {float(r.lease_charges) for r in again.marts["property_snapshot_kpi"].filter("snapshot_id = 20250228 and property_code = '115r'").collect()} == {778.0}
    # the tallies are those of the stored tables
    run = again.tables.run.filter("run_id = 2").first()
    assert (run.files_loaded, run.rows_loaded) == (1, 4)
    assert before.tables.run.filter("run_id = 1").first().rows_loaded == sum(getattr(before.tables, n).count() for n in FACTS)


def test_a_review_touches_the_snapshots_that_hold_the_code(spark, year):
    out, _ = year
    T = Store(spark, out).frames(year[1].tables)
    before = {name: parts(out, f"mart/{name}") for name in ("charge_mix", "ancillary", "revenue_bridge", "property_snapshot_kpi")}
    change = spark.createDataFrame([("PETFEEM", "parking", None, True, "n", "me", None)],
                                   "charge_code string, category string, description string, verified boolean, note string, changed_by string, changed_at timestamp")
    T, mix = apply_review(T, change, out)
    for name, had in before.items():
        moved = {p.split("/")[1] for p in had ^ parts(out, f"mart/{name}")}
        assert moved == (set() if name == "property_snapshot_kpi" else {"snapshot_id=20250328"}), name
    found = {(r.snapshot_id, r.category) for r in mix.filter("charge_code = 'PETFEEM'").collect()}
    assert found == {(20250328, "parking")} == {(r.snapshot_id, r.category) for r in M.charge_mix(T).filter("charge_code = 'PETFEEM'").collect()}
    assert T.audit.count() == 1
    had = parts(out, "mart/charge_mix")
    # no real change: an audit of no rows, and no mart is written
    T, _ = apply_review(T, change, out)
    assert T.audit.count() == 1 and parts(out, "mart/charge_mix") == had


def test_a_load_that_dies_is_not_seen(spark, monkeypatch):
    out = shared_folder(spark)
    one = load_reports(spark, sheet(spark, {"jan.xlsx": roll("01", "900.00")}), None, out)
    changed = sheet(spark, {"jan.xlsx": roll("01", "100.00"), "feb.xlsx": roll("02", "100.00")})

    def die(self):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", die)
        with pytest.raises(RuntimeError, match="killed"):
            load_reports(spark, changed, None, out)
    T = Store(spark, out).frames(one.tables)
    assert [float(r.lease_charges) for r in M.property_snapshot_kpi(T).collect()] == [901.0] and T.run.count() == 1 == T.snapshot.count()
    # the next load does it all, and a book that it names anew is renamed in every stored mart
    renamed = sheet(spark, {"feb.xlsx": roll("02", "100.00", name="New (115r)")})
    done = load_reports(spark, renamed, None, out)
    assert sorted(float(r.lease_charges) for r in M.property_snapshot_kpi(done.tables).collect()) == [101.0, 901.0] and done.tables.run.count() == 2
    assert {r.property_name for r in done.marts["property_snapshot_kpi"].collect()} == {"New"}
