"""The window formulation of the report grammar against a line-by-line reading of the same rules."""

import random

import pytest
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.operators import grammar as G
from leaseloom.sources.grids import grid_schema

N = S.RENT_ROLL_COLUMNS
HEADER = [
    {1: S.RENT_ROLL_TITLE}, {1: "Synthetic Property (test1r)"}, {1: "As Of = 02/25/2026"}, {1: "Month Year = 02/2026"},
    {i: v for i, v in enumerate(S.RENT_ROLL_HEADER_1, 1) if v}, {i: v for i, v in enumerate(S.RENT_ROLL_HEADER_2, 1) if v},
]


def grid(spark, files):
    rows = [
        (name, i, *[sheet_row.get(c) for c in range(1, N + 1)])
        for name, body in files.items() for i, sheet_row in enumerate(HEADER + body, 1)
    ]
    return spark.createDataFrame(rows, grid_schema(N))


def money_ok(text):
    text = (text or "").replace(",", "").replace("$", "").replace("%", "").strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    try:
        float(text or 0)
        return True
    except ValueError:
        return False


def read_by_line(body):
    """{sheet_row: (class, section, owner, line number)} by walking the rows once."""
    out, mode, skip, section = {}, None, 0, None
    block = None  # (head row, accepted)
    lines = 0
    for at, row in enumerate(body, 7):
        cell = {i: (row.get(i) or "").strip() for i in range(1, N + 1)}
        a, d, g = cell[1], cell[4], cell[7]
        anchor = "g" if a == "Summary Groups" else "c" if a.startswith("Summary of Charges") else None
        if anchor:
            mode, skip, block = anchor, 1 if anchor == "g" else 2, None
            out[at] = ("anchor", section, None, None)
        elif mode and skip:
            skip -= 1
            out[at] = ("header", section, None, None)
        elif mode == "g":
            if a in S.SUMMARY_GROUP_LABELS:
                out[at] = ("group", section, None, None)
            else:
                out[at], mode = ("group_unknown" if a else "mode_end", section, None, None), None
        elif mode == "c":
            if a in ("", "Total"):
                out[at], mode = ("mode_end", section, None, None), None
            else:
                out[at] = ("charge_summary", section, None, None)
        elif a in (S.CURRENT_LABEL, S.FUTURE_LABEL) and not any(cell[i] for i in range(2, N + 1)):
            section, block = "current" if a == S.CURRENT_LABEL else "future", None
            out[at] = ("section", section, None, None)
        elif a:
            resident = cell[4]
            sentinel = resident in S.SENTINELS
            good = section is not None and all(money_ok(cell[i]) for i in (6, 9, 10, 14)) and (not cell[3] or cell[3].isdigit())
            if good and (section == "future" or not sentinel):
                good = not sentinel and resident.startswith("t") and resident.isalnum()
            block, lines = (at, good), 0
            number = None
            if good and g and g != "Total" and money_ok(cell[8]):
                lines, number = 1, 1
            out[at] = ("head", section, at if good else None, number)
        elif g and g != "Total":
            if block is None:
                out[at] = ("orphan", section, None, None)
            elif not block[1]:
                out[at] = ("silent", section, None, None)
            else:
                lines += money_ok(cell[8])
                out[at] = ("line", section, block[0], lines if money_ok(cell[8]) else None)
        elif g == "Total":
            owned = block is not None and block[1]
            out[at] = ("total" if owned else "blank", section, block[0] if owned else None, None)
            block = None
        elif d == "Total":
            out[at], block = ("section_total", section, None, None), None
        else:
            out[at] = ("blank", section, None, None)
    return out


def random_row(rng):
    pick = rng.random()
    amount = rng.choice(["10.00", "1,250.50", "(75.25)", "oops", ""])
    if pick < 0.03:
        return {1: S.CURRENT_LABEL}
    if pick < 0.06:
        return {1: S.FUTURE_LABEL}
    if pick < 0.08:
        return {1: rng.choice(S.SUMMARY_GROUP_LABELS), 7: "100"}
    if pick < 0.11:
        return {1: "Summary Groups"}
    if pick < 0.14:
        return {1: "Summary of Charges by Charge Code"}
    if pick < 0.17:
        return {4: "Total"}
    if pick < 0.20:
        return {1: "Total", 4: "9"}
    if pick < 0.30:
        return {}
    if pick < 0.55:
        row = {1: f"u{rng.randint(1, 99)}", 3: rng.choice(["650", "650", "1.5", None]),
               4: rng.choice(["t1", "t22", "VACANT", "MODEL", "r9", None]), 6: rng.choice(["900", "900", "junk"])}
        if rng.random() < 0.6:
            row.update({7: rng.choice(["RENT", "Total"]), 8: amount})
        return row
    if pick < 0.85:
        return {7: rng.choice(["RENT", "TRASH"]), 8: amount}
    return {7: "Total", 8: amount}


def random_files(n_files=60, seed=11):
    rng = random.Random(seed)
    files = {}
    for f in range(n_files):
        body = [random_row(rng) for _ in range(rng.randint(1, 90))]
        # an anchor right below another one is the documented difference: keep them apart
        for i in range(1, len(body)):
            near = [(b.get(1) or "") for b in body[max(0, i - 2):i]]
            if (body[i].get(1) or "").startswith("Summary") and any(x.startswith("Summary") for x in near):
                body[i] = {}
        files[f"f{f:02d}.xlsx"] = body
    return files


@pytest.mark.parametrize("chunk_rows", [1 << 20, 8])
def test_every_row_is_read_as_line_by_line(spark, chunk_rows):
    files = random_files()
    got = {
        (r.file_name, r.sheet_row): (r.cls, r.section, r.owner, r.line_no)
        for r in G.classify_rows(grid(spark, files), chunk_rows).collect()
    }
    want = {(f, at): v for f, body in files.items() for at, v in read_by_line(body).items()}
    assert got == want
    assert {v[0] for v in want.values()} >= {"line", "silent", "orphan", "group_unknown", "charge_summary", "total", "head"}


def one_file(spark, body):
    parsed = G.parse_rent_rolls(grid(spark, {"one.xlsx": body}))
    return parsed, [(i.severity, i.rule, i.sheet_row) for i in parsed.issues.collect()]


CURRENT = {1: S.CURRENT_LABEL}


def head(unit="101", resident="t1", **cells):
    row = {1: unit, 2: "A1", 3: "650", 4: resident, 5: "Resident 1", 6: "1000", 14: "0"}
    row.update({int(k[1:]): v for k, v in cells.items()})
    return row


def test_block_with_total_and_repeated_code(spark):
    parsed, issues = one_file(spark, [
        CURRENT, head(c7="RENT", c8="1,000.00"), {7: "PETFEEM", 8: "25"}, {7: "PETFEEM", 8: "25"}, {7: "Total", 8: "1050.00"}])
    lease = parsed.leases.collect()[0]
    assert (str(lease.charges_total), lease.charge_lines, lease.occupancy_status) == ("1050.00", 3, "occupied")
    assert [(r.line_no, r.charge_code) for r in parsed.lines.orderBy("line_no").collect()] == [(1, "RENT"), (2, "PETFEEM"), (3, "PETFEEM")]
    assert issues == []


def test_total_mismatch_and_missing_total(spark):
    _, issues = one_file(spark, [CURRENT, head(c7="RENT", c8="1000"), {7: "Total", 8: "999.99"}, head(unit="102", c7="RENT", c8="5")])
    assert sorted(issues) == [("error", "block_total_mismatch", 8), ("error", "block_total_mismatch", 10)]


def test_rejected_heads(spark):
    parsed, issues = one_file(spark, [
        head(unit="100"), {7: "RENT", 8: "1"}, CURRENT, head(resident=None), {7: "RENT", 8: "1"}, head(unit="102", resident="r7"),
        head(unit="103", c3="1.5"), head(unit="104", resident="VACANT", c14="12.50"), {7: "Total"}, {7: "TRASH", 8: "3"}])
    assert sorted(issues) == sorted([
        ("error", "lease_outside_section", 7), ("error", "occupied_row_without_resident", 10), ("error", "resident_id_format", 12),
        ("error", "lease_row_coercion", 13), ("warning", "sentinel_field_violation", 14), ("error", "charge_without_block", 16)])
    assert [r.unit_code for r in parsed.leases.collect()] == ["104"]


def test_header_total_in_code_column_is_no_charge(spark):
    parsed, _ = one_file(spark, [CURRENT, head(c7="Total", c8="55")])
    assert parsed.lines.count() == 0


def test_summary_blocks(spark):
    parsed, issues = one_file(spark, [
        CURRENT, head(c7="RENT", c8="10"), {7: "Total", 8: "10"}, {1: "Summary Groups"}, {6: "Square"},
        {1: S.CURRENT_LABEL, 6: "260,778.00", 7: "(1,234.00)", 8: "bad", 11: "300", 12: "97.6666666666667"}, {1: "Totals:", 11: "1.5"},
        {1: "Unknown label"}, {}, {1: "Summary of Charges by Charge Code"}, {}, {1: "Charge Code"}, {1: "RENT", 4: "10.00"}, {1: "TRASH", 4: "x"},
        {1: "Total", 4: "10"}])
    groups = {r.group_label: r for r in parsed.groups.collect()}
    first = groups[S.CURRENT_LABEL]
    assert (str(first.square_footage), str(first.market_rent), first.lease_charges, first.unit_count) == ("260778.00", "-1234.00", None, 300)
    assert groups["Totals:"].unit_count is None
    assert [(r.charge_code, str(r.amount)) for r in parsed.charge_summary.collect()] == [("RENT", "10.00")]
    assert sorted(issues) == sorted([
        ("warning", "summary_group_coercion", 12), ("warning", "summary_group_coercion", 13), ("warning", "unexpected_summary_group_label", 14),
        ("error", "charge_summary_coercion", 20)])


def test_changed_header_fails_only_its_file(spark):
    rows = grid(spark, {"good.xlsx": [CURRENT, head()], "bad.xlsx": [CURRENT, head()]})
    rows = rows.withColumn("c01", F.when((F.col("file_name") == "bad.xlsx") & (F.col("sheet_row") == 3), "As of yesterday").otherwise(F.col("c01")))
    parsed = G.parse_rent_rolls(rows)
    assert [r.file_name for r in parsed.headers.collect()] == ["good.xlsx"]
    assert [(r.file_name, r.rule) for r in parsed.issues.collect()] == [("bad.xlsx", "file_parse_failed")]
    assert parsed.leases.count() == 1


def availability(spark, data, total):
    n = S.AVAILABILITY_COLUMNS
    rows = [{1: S.AVAILABILITY_TITLE}, {1: "Synthetic Property (134c)"}, {1: "As Of = 02/25/2026"},
            dict(enumerate(S.AVAILABILITY_HEADER_1, 1)), {i: v for i, v in enumerate(S.AVAILABILITY_HEADER_2, 1) if v},
            dict(enumerate(data, 1)), dict(enumerate(total, 1))]
    return spark.createDataFrame([("a.xlsx", i, *[r.get(c) for c in range(1, n + 1)]) for i, r in enumerate(rows, 1)], grid_schema(n))


def test_availability_total_row(spark):
    data = ["134c", "Synthetic Property", "800", "1,000.00", "10", "9", "0", "1", "0", "x", "1", "0", "0", "0", "90", "90", "90", "0"]
    total = ["", "Total", "800", "1,000.00", "11", *data[5:17], "100"]
    rows, issues = G.availability_row(availability(spark, data, total))
    row = rows.collect()[0]
    assert (row.units, row.notice_unrented, str(row.avg_rent), str(row.pct_occ)) == (10, 0, "1000.00", "90.0000")
    assert sorted((i.severity, i.rule, i.detail["field"]) for i in issues.collect()) == [
        ("info", "availability_total_row_differs", "pct_trend"), ("warning", "availability_coercion", "notice_unrented"),
        ("warning", "availability_total_row_differs", "units")]


def test_all_scans_share_one_shuffle_and_one_sort(spark):
    """A row of a sheet moves and is sorted once for the four scans, and what is asked of many cells is asked of an array of them."""
    rows = [{1: S.CURRENT_LABEL}, {1: "101", 3: "700", 4: "t1", 7: "RENT", 8: "5"}, {7: "Total", 8: "5"}]
    plan = G.classify_rows(grid(spark, {"a.xlsx": rows, "b.xlsx": rows}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert plan.count("Window [") == 4
    assert "exists(array(" in plan


def test_chunks_hand_over_a_row_each(spark, monkeypatch):
    """What is stored for sheets of several chunks grows with the chunks and with the rows from the first anchor on, not with all rows."""
    stored, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (stored.append(df.count()), cut(df))[1])
    body = [CURRENT, head(c7="RENT", c8="10"), *[{7: "PETFEEM", 8: "1"}] * 250, {7: "Total", 8: "260"}, {1: "Summary Groups"}, {6: "Square"}, {1: "Totals:"}, {}]
    rows = {r.sheet_row: r for r in G.classify_rows(grid(spark, {"a.xlsx": body}), 16).collect()}
    chunks = len({at // 16 for at in rows})
    assert chunks > 10 and max(stored) <= chunks
    last = max(at for at, r in rows.items() if r.cls == "line")
    assert rows[last].owner == min(at for at, r in rows.items() if r.cls == "head") and rows[last].line_no == 251


def test_figures_of_blocks_are_added_up_before_text_is_sorted(spark):
    body = [CURRENT, head(c7="RENT", c8="10"), {7: "PETFEEM", 8: "1"}, {7: "Total", 8: "11"}]
    blocks = G.lease_blocks(G.classify_rows(grid(spark, {"a.xlsx": body, None: body})))
    assert {(r.file_name, str(r.printed_total), str(r.sum_of_charges), r.charge_lines) for r in blocks.collect()} == {
        (f, "11.00000000000000", "11.00000000000000", 2) for f in ("a.xlsx", None)}
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not any("SortAggregate" in line and "sum" in line for line in plan.splitlines())


def test_scans_move_the_cells_as_one_value(spark):
    """Marks and numbers go through the windows beside the cells, which travel packed; the findings of a sheet take two reads of its rows."""
    body = [CURRENT, head(c7="RENT", c8="10"), {7: "PETFEEM", 8: "1"}, {7: "Total", 8: "11"}]
    lines = G.classify_rows(grid(spark, {"a.xlsx": body}))._jdf.queryExecution().executedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    assert any("c05#" in line for line in lines) and not any("c05#" in line for line in lines[windows[0]:windows[-1] + 1])
    rows = G.classify_rows(grid(spark, {"a.xlsx": body}))
    assert G.row_issues(rows)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2


def test_findings_of_every_kind_in_one_read(spark):
    """`row_issues` finds what the three kinds of findings find by themselves."""
    rows = G.classify_rows(grid(spark, random_files(30, seed=5))).localCheckpoint()
    told = lambda df: sorted((r.file_name, r.severity, r.rule, r.sheet_row, str(sorted(r.detail.items(), key=str))) for r in df.collect())
    apart = [x for find in (G.lease_issues, G.line_issues, G.summary_issues) for x in told(find(rows))]
    assert told(G.row_issues(rows)) == sorted(apart)
    assert {x[2] for x in apart} >= {"lease_outside_section", "lease_row_coercion", "charge_coercion", "charge_without_block", "block_total_coercion",
                                     "unexpected_summary_group_label", "charge_summary_coercion"}
