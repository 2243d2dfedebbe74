"""The report grammar as windows over a cell grid.

A grid holds one row per sheet row: `file_name, sheet_row, c01 .. cNN` (text, null when blank). The
rent-roll grammar is a line-by-line state machine; here each piece of state is the last value of some
event at or before a row, so three prefix scans per file classify every row and no Python runs.

An anchor printed inside the one or two header rows that follow another anchor is treated as an
anchor of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.functions.scalars import (
    NUMBER, as_date, as_date_error, as_decimal, as_decimal_error, as_int, as_int_error, as_text,
    derive_status, strip,
)
from leaseloom.operators.scan import CHUNK, CHUNK_ROWS, cut, dealt_by_chunk, prefix_scan, with_chunks

FILE, ROW = "file_name", "sheet_row"
HEADER_ROWS = 6


def cells(n: int) -> list[str]:
    return [f"c{i:02d}" for i in range(1, n + 1)]


def _text(i: int) -> Column:
    return F.coalesce(strip(F.col(f"c{i:02d}")), F.lit(""))


_CELLS = cells(S.RENT_ROLL_COLUMNS)


def _error(rule: str, severity: str, where: Column, detail: dict[str, Column]) -> tuple[Column, Column]:
    """Where a finding is made, and the finding."""
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return where, F.when(where, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.create_map(*pairs).alias("detail")))


def _issues(df: DataFrame, found: list[tuple[Column, Column]], row: Column) -> DataFrame:
    """One row per finding, several findings per row allowed. Rows without any, nearly all of them, go before an array is made of each."""
    hits = F.filter(F.array(*[said for _, said in found]), lambda x: x.isNotNull())
    return (
        df.filter(reduce(Column.__or__, [where for where, _ in found])).select(FILE, row.cast("int").alias(ROW), F.explode(hits).alias("i"))
        .select(FILE, "i.severity", "i.rule", ROW, "i.detail")
    )


def _field_issues(df: DataFrame, rule: str, severity: Column, fields: dict[str, dict[str, Column]], where: Callable[[Column], Column], detail: dict[str, Column], row: Column) -> DataFrame:
    """One row per field that `where` holds for. The fields travel as an array, so that what is asked of each is compiled once and not
    field by field. `detail` is added to what is said of every field."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), *[c.alias(k) for k, c in said.items()]) for n, said in fields.items()])
    told = lambda x: [p for k in ("field", *next(iter(fields.values()))) if not k.startswith("_") for p in (F.lit(k), x[k].cast("string"))]
    base = [p for k, v in detail.items() for p in (F.lit(k), v.cast("string"))]
    return df.withColumns({ROW: row.cast("int"), "_x": F.explode(F.filter(each, where))}).select(
        FILE, severity.alias("severity"), F.lit(rule).alias("rule"), ROW, F.create_map(*base, *told(F.col("_x"))).alias("detail"))


# ---- headers -----------------------------------------------------------------

def _first_rows(grid: DataFrame, n_cols: int, last_row: int) -> DataFrame:
    """The first sheet rows of each file, pivoted to one row of cell arrays."""
    row = F.array(*[_text(i) for i in range(1, n_cols + 1)])
    return grid.filter(F.col(ROW) <= last_row).groupBy(FILE).agg(
        F.max(ROW).alias("_rows"),
        *[F.max(F.when(F.col(ROW) == k, row)).alias(f"_r{k}") for k in range(1, last_row + 1)],
    )


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _head_cell(k: int) -> Column:
    return F.coalesce(F.element_at(f"_r{k}", 1), F.lit(""))


def _differs(k: int, expected: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(f"_r{k}") != _array(expected), F.lit(True))


def _identity(pivot: DataFrame) -> DataFrame:
    return pivot.withColumns({
        "property_name": strip(F.regexp_extract(_head_cell(2), S.TITLE_PATTERN, 1)),
        "property_code": strip(F.regexp_extract(_head_cell(2), S.TITLE_PATTERN, 2)),
        "as_of_date": as_date(F.nullif(F.regexp_extract(_head_cell(3), S.AS_OF_PATTERN, 1), F.lit(""))),
    })


def _failures(checked: DataFrame) -> DataFrame:
    detail = F.create_map(F.lit("file"), F.col(FILE), F.lit("error"), F.col("error"))
    return checked.filter(F.col("error").isNotNull()).select(
        FILE, F.lit("error").alias("severity"), F.lit("file_parse_failed").alias("rule"),
        F.lit(None).cast("int").alias(ROW), detail.alias("detail"))


def _is_titled(k: int) -> Column:
    return _head_cell(k).rlike(S.TITLE_PATTERN)


def report_header(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers of the well-formed rent rolls, and one finding per file whose header block changed."""
    pivot = _identity(_first_rows(grid, S.RENT_ROLL_COLUMNS, HEADER_ROWS)).withColumn(
        "report_month",
        as_date(F.regexp_replace(F.nullif(F.regexp_extract(_head_cell(4), S.MONTH_PATTERN, 1), F.lit("")), "/", "/01/")))
    checked = pivot.withColumn(
        "error",
        F.when(F.col("_rows") < HEADER_ROWS, "expected a header block")
        .when(_head_cell(1) != S.RENT_ROLL_TITLE, "row 1 is not the report title")
        .when(~_is_titled(2), "row 2 is not '<name> (<code>)'")
        .when(F.col("as_of_date").isNull(), "row 3 is not 'As Of = MM/DD/YYYY'")
        .when(F.col("report_month").isNull(), "row 4 is not 'Month Year = MM/YYYY'")
        .when(_differs(5, S.RENT_ROLL_HEADER_1), "header row 5 changed")
        .when(_differs(6, S.RENT_ROLL_HEADER_2), "header row 6 changed"))
    good = checked.filter(F.col("error").isNull())
    return good.select(FILE, "property_code", "property_name", "as_of_date", "report_month"), _failures(checked)


# ---- row classes -------------------------------------------------------------

def _money(i: int) -> Column:
    return as_decimal(F.col(f"c{i:02d}")).try_cast(S.MONEY)


def _unread(i: int) -> Column:
    """Not a figure, or one no money column can hold."""
    return _money(i).isNull()


def _cells(*at: int) -> Column:
    """Cells as an array, so that what is asked of each is compiled once and not cell by cell."""
    return F.array(*[F.col(f"c{i:02d}") for i in at])


def _resident() -> tuple[Column, Column]:
    raw = _text(4)
    sentinel = F.when(raw.isin(*S.SENTINELS), raw)
    return sentinel, F.when(~raw.isin(*S.SENTINELS) & (raw != ""), raw)


#: where a lease head has its amounts and its dates
_MONEY_CELLS, _DATE_CELLS = (6, 9, 10, 14), (11, 12, 13)
# who a lease head names
NOBODY, SENTINEL, RESIDENT, MALFORMED = 0, 1, 2, 3


def _row_facts() -> dict[str, Column]:
    """What can be said of a row by itself, computed once before the scans: marks and codes, so that the scans move no text."""
    raw, a, g = _text(4), _text(1), _text(7)
    named = (
        F.when(raw == "", NOBODY).when(raw.isin(*S.SENTINELS), SENTINEL)
        .when(raw.rlike(S.RESIDENT_ID_PATTERN), RESIDENT).otherwise(MALFORMED))
    bad = as_int_error(F.col("c03")) | F.exists(_cells(*_MONEY_CELLS), lambda c: as_decimal(c).try_cast(S.MONEY).isNull()) | F.exists(
        _cells(*_DATE_CELLS), as_date_error)
    rest = F.concat_ws("", *[f"c{i:02d}" for i in range(2, S.RENT_ROLL_COLUMNS + 1)])
    sentinel = F.coalesce(*[F.when(raw == s, i) for i, s in enumerate(S.SENTINELS, 1)], F.lit(0))
    # who a head names, whether it can be read, its sentinel and whether its resident moved out, in one number
    head = named + F.when(bad, 4).otherwise(0) + F.when(as_date(F.col("c13")).isNotNull(), 8).otherwise(0) + 16 * sentinel
    return {
        "_kind": F.when(a == "Summary Groups", "g").when(a.startswith("Summary of Charges"), "c"),
        "_first_cell": a != "", "_listed": a.isin(*S.SUMMARY_GROUP_LABELS), "_over": a.isin("", "Total"),
        # asked of section labels only
        "_label": F.when(a.isin(S.CURRENT_LABEL, S.FUTURE_LABEL) & (strip(rest) == ""), F.when(a == S.CURRENT_LABEL, "current").otherwise("future")),
        "_billed": (g != "") & (g != "Total"), "_total": g == "Total", "_section_total": (g == "") & (raw == "Total"),
        "_payable": ~_unread(8),
        # what the lines below need of their lease, so that they are never joined to it
        "_said": F.when(a != "", head),
    }


def _head_rejection(section: Column, said: Column) -> Column:
    """Why a lease head is not loaded; null when it is."""
    named = said.bitwiseAND(3)
    vacant_ok = (section == "current") & (named == SENTINEL)
    return (
        F.when(section.isNull(), "lease_outside_section")
        .when(said.bitwiseAND(4) != 0, "lease_row_coercion")
        .when(named.isin(NOBODY, SENTINEL) & ~vacant_ok, "occupied_row_without_resident")
        .when(named == MALFORMED, "resident_id_format")
    )


def _sentinel_said(said: Column) -> Column:
    code = F.shiftright(said, 4).bitwiseAND(3)
    return F.coalesce(*[F.when(code == i, s) for i, s in enumerate(S.SENTINELS, 1)])


def _scanned(rows: DataFrame, handed: bool, **events) -> DataFrame:
    """One scan of the rows in their chunks, and what earlier chunks hand over, if they do."""
    scanned = prefix_scan(rows, [FILE], ROW, **events, whole=True)
    if not handed:
        return scanned
    last = {n: F.coalesce(n, f"_c_{n}") for kind in ("lasts", "prior_lasts") for n in events.get(kind, {})}
    return scanned.withColumns(last | {n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in events.get("sums", {})})


def _numbered_row(code: Column) -> Column:
    """A row with a small code, as one number that grows with the row."""
    return F.shiftleft(F.col(ROW).cast("bigint"), 8) + code


def _row_of(numbered: str) -> Column:
    return F.shiftright(F.col(numbered), 8)


def _code_of(numbered: str) -> Column:
    return F.col(numbered).bitwiseAND(255)


def _anchor() -> dict[str, Column]:
    return {"_anchor": F.when(F.col("_kind") == "g", _numbered_row(F.lit(0))).when(F.col("_kind") == "c", _numbered_row(F.lit(1)))}


def _past_anchor() -> dict[str, Column]:
    """Rows past the header of the summary block above them, and those of them that end it."""
    groups = _code_of("_anchor") == 0
    past = F.coalesce((F.col(ROW) - _row_of("_anchor") > F.when(groups, 1).otherwise(2)) & F.col("_kind").isNull(), F.lit(False))
    return {"_past": past, "_ends": past & F.when(groups, ~F.col("_listed")).otherwise(F.col("_over"))}


def _ended() -> dict[str, Column]:
    return {"_ended": F.when(F.col("_ends"), F.col(ROW))}


def _mode() -> dict[str, Column]:
    over = F.col("_anchor").isNull() | F.coalesce(F.col("_ended") > _row_of("_anchor"), F.lit(False))
    return {"_normal": over & F.col("_kind").isNull(), "_mode": F.when(~over, F.when(_code_of("_anchor") == 0, "g").otherwise("c"))}


def _line_events() -> dict[str, Column]:
    """What a row means for the sections and blocks, once it is known to be an ordinary one."""
    normal, label = F.col("_normal"), F.col("_label")
    return {
        "_start": F.when(normal, label),
        "_is_head": normal & F.col("_first_cell") & label.isNull(),
        "_closes": F.col("_kind").isNotNull() | (normal & label.isNotNull())
                   | (normal & ~F.col("_first_cell") & (F.col("_total") | F.col("_section_total"))),
        "_line": (normal & F.col("_billed") & F.col("_payable")).cast("bigint"),
    }


def _head() -> Column:
    """A lease head; it is accepted or not depending on the section it turns out to stand in."""
    return _numbered_row(F.col("_said"))


def _chunks_of(body: DataFrame) -> DataFrame:
    """The chunks of every sheet, with their rows and their first anchor, stored."""
    return cut(body.withColumn("_kind", _row_facts()["_kind"]).groupBy(FILE, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_kind").isNotNull(), F.col(ROW))).alias("_first")))


def _handed(body: DataFrame, chunks: DataFrame, blocks: bool) -> DataFrame:
    """What the earlier chunks of a sheet hand to each of its chunks, a row a chunk, stored: the anchor and the end of its block, and with
    `blocks` the section, the open head, the last closing row and the lines so far.

    Only rows from the first anchor of a sheet on are scanned for this. Of all the others, which are ordinary, a chunk adds up whole numbers;
    the rows from its last head on are then read again for that head and its lines."""
    facts = _row_facts()
    of_long = chunks.groupBy(FILE).agg(F.max(CHUNK).alias("_last"), F.min("_first").alias("_from")).filter(F.col("_last") > 0).select(FILE, "_from")
    long = body.join(of_long, FILE)
    only = lambda df, *names: df.withColumns({n: facts[n] for n in names})
    tail = cut(long.filter(F.col(ROW) >= F.col("_from")).drop("_from"))
    placed = prefix_scan(only(tail, "_kind", "_listed", "_over"), [FILE], ROW, lasts=_anchor(), handing=only(tail, "_kind").select(FILE, ROW, CHUNK, "_kind"))
    placed = cut(placed.withColumns(_past_anchor()))
    narrow = placed.select(FILE, ROW, CHUNK, "_ends")
    placed = prefix_scan(placed, [FILE], ROW, prior_lasts=_ended(), handing=narrow).withColumns(_mode())
    every = chunks.join(of_long.select(FILE), FILE, "left_semi").select(FILE, CHUNK)
    marks = placed.groupBy(FILE, CHUNK).agg(
        F.max(F.when(F.col("_kind").isNotNull(), F.col("_anchor"))).alias("_t__anchor"), F.max(F.when(F.col("_ends"), F.col(ROW))).alias("_t__ended"))
    totals = every.join(marks, [FILE, CHUNK], "left")
    lasts = ["_anchor", "_ended"]
    before = Window.partitionBy(FILE).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = {}
    if blocks:
        ordinary = long.filter(F.col("_from").isNull() | (F.col(ROW) < F.col("_from"))).drop("_from").withColumn("_normal", F.lit(True))
        rows = ordinary.unionByName(cut(placed.select(*tail.columns, "_normal")))
        told = lambda df: only(df, *facts).withColumns(_line_events())
        # whole numbers only, so that they are added up before anything is sorted
        numbers = cut(told(rows).groupBy(FILE, CHUNK).agg(
            F.max(F.when(F.col("_start").isNotNull(), F.col(ROW).cast("bigint") * 2 + F.when(F.col("_start") == "future", 1).otherwise(0))).alias("_s"),
            F.max(F.when(F.col("_is_head"), F.col(ROW))).alias("_at"), F.max(F.when(F.col("_closes"), F.col(ROW))).alias("_t__closed"),
            F.sum("_line").alias("_t__lines")))
        at = numbers.filter(F.col("_at").isNotNull()).select(FILE, CHUNK, "_at")
        since = told(rows.join(at, [FILE, CHUNK]).filter(F.col(ROW) >= F.col("_at"))).groupBy(FILE, CHUNK).agg(
            F.max(F.when(F.col("_is_head") & (F.col(ROW) == F.col("_at")), _head())).alias("_t__head"), F.sum("_line").alias("_since"))
        totals = totals.join(numbers, [FILE, CHUNK], "left").join(since, [FILE, CHUNK], "left").withColumns({
            "_t_section": F.when(F.col("_s") % 2 == 1, "future").when(F.col("_s").isNotNull(), "current"),
            "_t__base": F.when(F.col("_at").isNotNull(), F.coalesce(F.sum("_t__lines").over(before), F.lit(0)) + F.col("_t__lines") - F.col("_since"))})
        lasts += ["section", "_head", "_closed", "_base"]
        sums = {"_c__lines": F.sum("_t__lines").over(before)}
    return cut(totals.select(FILE, CHUNK, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
                             *[c.alias(n) for n, c in sums.items()]).filter(F.col(CHUNK) > 0))


def mode_segments(grid: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Body rows with the summary-block mode they belong to (`_mode`, null outside) and whether they
    are ordinary rows (`_normal`)."""
    return _mode_segments(grid, chunk_rows, False)[0].select("*", "_cells.*").drop("_cells")


def _mode_segments(grid: DataFrame, chunk_rows: int, blocks: bool) -> tuple[DataFrame, bool]:
    """`mode_segments`, and whether sheets of several chunks have what their chunks hand over beside their rows. All scans of the rows share
    one shuffle and one sort."""
    body = with_chunks(grid.filter(F.col(ROW) > HEADER_ROWS), ROW, chunk_rows)
    chunks = _chunks_of(body)
    n_rows, last = chunks.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max(CHUNK)).first()
    handed = bool(last)
    rows = dealt_by_chunk(body, [FILE], ROW, n_rows, chunk_rows)
    if handed:
        rows = rows.join(_handed(body, chunks, blocks), [FILE, CHUNK], "left")
    # the cells travel through the scans as one value
    told = rows.select(*[c for c in rows.columns if c not in _CELLS], F.struct(*_CELLS).alias("_cells"), *[c.alias(n) for n, c in _row_facts().items()])
    rows = _scanned(told, handed, lasts=_anchor()).withColumns(_past_anchor())
    return _scanned(rows, handed, prior_lasts=_ended()).withColumns(_mode()), handed


def classify_rows(grid: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every body row with its class, section, owning block and, for charge lines, its number.

    `cls`: anchor, header, group, group_unknown, charge_summary, mode_end, section, head, line, orphan,
    silent (a line under a rejected head), total, section_total, blank. `owner` is the sheet row of the
    accepted head; `reject_rule` is set on rejected heads.

    Sheets are read in chunks of `chunk_rows`, whatever their length."""
    rows, handed = _mode_segments(grid, chunk_rows, True)
    rows = rows.withColumns(_line_events())
    rows = _scanned(rows, handed, lasts={"section": F.col("_start"), "_head": F.when(F.col("_is_head"), _head())},
                    prior_lasts={"_closed": F.when(F.col("_closes"), F.col(ROW))}, sums={"_lines": F.col("_line")})
    head, said = _row_of("_head"), _code_of("_head")
    rejected = _head_rejection(F.col("section"), said)
    rows = rows.withColumns({
        "_open": F.col("_head").isNotNull() & ~F.coalesce(F.col("_closed") >= head, F.lit(False)),
        "_accepted": F.col("_head").isNotNull() & rejected.isNull()})
    rows = _scanned(rows, handed, lasts={"_base": F.when(F.col("_is_head"), F.col("_lines") - F.col("_line"))})
    cls = (
        F.when(F.col("_kind").isNotNull(), "anchor")
        .when(F.col("_mode").isNotNull(),
              F.when(~F.col("_past"), "header")
              .when(F.col("_ends"), F.when((F.col("_mode") == "g") & F.col("_first_cell"), "group_unknown").otherwise("mode_end"))
              .when(F.col("_mode") == "g", "group").otherwise("charge_summary"))
        .when(F.col("_start").isNotNull(), "section")
        .when(F.col("_is_head"), "head")
        .when(F.col("_billed"), F.when(~F.col("_open"), "orphan").when(F.col("_accepted"), "line").otherwise("silent"))
        .when(F.col("_total"), F.when(F.col("_open") & F.col("_accepted"), "total").otherwise("blank"))
        .when(F.col("_section_total"), "section_total").otherwise("blank")
    )
    rows = rows.withColumn("cls", cls).withColumn(
        "owner", F.when(F.col("cls").isin("head", "line", "total") & F.col("_accepted"), head.cast("int")))
    numbered = F.col("owner").isNotNull() & (F.col("_line") > 0)
    moved = F.when(said.bitwiseAND(8) != 0, True)
    return rows.select(
        FILE, ROW, "cls", "section", "owner",
        F.when(F.col("owner").isNotNull(), derive_status(F.col("section"), _sentinel_said(said), moved)).alias("occupancy_status"),
        F.when(F.col("cls") == "head", rejected).alias("reject_rule"),
        F.when(numbered, F.col("_lines") - F.col("_base")).cast("int").alias("line_no"),
        "_cells.*",
    )


# ---- facts from classified rows ----------------------------------------------

def charge_lines(rows: DataFrame) -> DataFrame:
    """Parsed charge lines of accepted blocks; `owner` is the sheet row of their lease, whose section and status they carry."""
    return rows.filter(F.col("line_no").isNotNull()).select(
        FILE, "owner", "section", "occupancy_status", "line_no", _text(7).alias("charge_code"), as_decimal(F.col("c08")).alias("amount"), ROW)


def _lease_fields() -> list[Column]:
    sentinel, resident = _resident()
    money, day = (lambda i: F.element_at("_money", _MONEY_CELLS.index(i) + 1)), (lambda i: F.element_at("_days", _DATE_CELLS.index(i) + 1))
    return [
        _text(1).alias("unit_code"), as_text(F.col("c02")).alias("unit_type_code"), as_int(F.col("c03")).alias("unit_sqft"),
        resident.alias("resident_id"), as_text(F.col("c05")).alias("resident_name"), sentinel.alias("sentinel"), F.col("section").alias("section"),
        derive_status(F.col("section"), sentinel, day(13)).alias("occupancy_status"), money(6).alias("market_rent"),
        money(9).alias("resident_deposit"), money(10).alias("other_deposit"), money(14).alias("balance"),
        day(11).alias("move_in"), day(12).alias("lease_expiration"), day(13).alias("move_out")]


def lease_blocks(rows: DataFrame) -> DataFrame:
    """One row per accepted block: its lease, its printed total (0 when none or unreadable), the number
    and the sum of its lines."""
    is_head, zero = F.col("cls") == "head", F.lit(0).cast(NUMBER)
    # a file without a name is a file too, and both sides are dealt by the same plain keys
    key = {"_named": F.col(FILE).isNotNull(), "_file": F.coalesce(FILE, F.lit(""))}
    owned = rows.filter(F.col("owner").isNotNull()).withColumns(key)
    # figures are added up before anything is sorted; only the heads, one a block, travel with their text
    amount = as_decimal(F.col("c08"))
    figures = owned.groupBy(*key, F.col("owner").alias(ROW)).agg(
        F.max(F.when(F.col("cls") == "total", amount)).alias("_printed"),
        F.sum(F.when(F.col("line_no").isNotNull(), amount)).alias("_sum"), F.count("line_no").alias("_lines"))
    read = owned.filter(is_head).withColumns({
        "_money": F.transform(_cells(*_MONEY_CELLS), lambda c: as_decimal(c).try_cast(S.MONEY)),
        "_days": F.transform(_cells(*_DATE_CELLS), as_date)})
    heads = read.select(*key, F.col("owner").alias(ROW), F.struct(*_lease_fields()).alias("h")).groupBy(*key, ROW).agg(F.max("h").alias("h"))
    return figures.join(heads, [*key, ROW], "left").select(
        F.when(F.col("_named"), F.col("_file")).alias(FILE), ROW, "h.*", F.coalesce("_printed", zero).alias("printed_total"),
        F.coalesce("_sum", zero).alias("sum_of_charges"), F.col("_lines").cast("int").alias("charge_lines"))


def leases(blocks: DataFrame) -> DataFrame:
    """Accepted leases with their printed charge total and their number of lines."""
    return blocks.withColumn("charges_total", F.col("printed_total").cast(S.MONEY)).drop(
        "printed_total", "sum_of_charges")


def lease_row_filter(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted leases, and the findings about lease heads."""
    return leases(lease_blocks(rows)), lease_issues(rows)


def _unread_cells() -> Column:
    """The cells of a lease head that cannot be read, with their text."""
    bad = {2: as_int_error(F.col("c03")), **{i - 1: _unread(i) for i in (6, 9, 10, 14)}, **{i - 1: as_date_error(F.col(f"c{i:02d}")) for i in (11, 12, 13)}}
    said = [F.when(where, F.concat(F.lit(f"column {i + 1}: "), F.col(f"c{i + 1:02d}"))) for i, where in sorted(bad.items())]
    return F.array_join(F.array_compact(F.array(*said)), "; ")


def lease_issues(rows: DataFrame) -> DataFrame:
    return _issues(rows.filter(F.col("cls") == "head"), _lease_findings(), F.col(ROW))


def _lease_findings() -> list[tuple[Column, Column]]:
    sentinel, resident = _resident()
    unit = _text(1)
    why = F.col("reject_rule")
    balance = as_decimal(F.col("c14"))
    dated = as_text(F.col("c11")).isNotNull() | as_text(F.col("c12")).isNotNull() | as_text(F.col("c13")).isNotNull()
    status = derive_status(F.col("section"), sentinel, as_date(F.col("c13")))
    return [
        _error("lease_outside_section", "error", why == "lease_outside_section", {"unit_code": unit}),
        _error("lease_row_coercion", "error", why == "lease_row_coercion", {"unit_code": unit, "error": _unread_cells()}),
        _error("occupied_row_without_resident", "error", why == "occupied_row_without_resident",
               {"unit_code": unit, "occupancy_status": status}),
        _error("resident_id_format", "error", why == "resident_id_format", {"unit_code": unit, "resident_id": resident}),
        _error("sentinel_field_violation", "warning", (F.col("cls") == "head") & why.isNull() & sentinel.isNotNull() & (dated | (balance != 0)),
               {"unit_code": unit, "sentinel": sentinel, "balance": balance.cast(S.MONEY)}),
    ]


def line_issues(rows: DataFrame) -> DataFrame:
    """Lines without a block and lines or totals whose amount cannot be read: those of an owned line were tried when it was numbered."""
    return _issues(rows, _line_findings(), F.col(ROW))


def _line_findings() -> list[tuple[Column, Column]]:
    code = _text(7)
    owned = F.col("owner").isNotNull()
    return [
        _error("charge_without_block", "error", F.col("cls") == "orphan", {"charge_code": code}),
        _error("charge_coercion", "error", owned & F.col("cls").isin("line", "head") & F.col("line_no").isNull() & (code != "") & (code != "Total"),
               {"charge_code": code}),
        _error("block_total_coercion", "error", (F.col("cls") == "total") & _unread(8), {"amount": F.col("c08")}),
    ]


def block_total_check(blocks: DataFrame, tol: float = 0.005) -> DataFrame:
    """Blocks whose printed total differs from the sum of their lines."""
    bad = blocks.filter(F.abs(F.col("printed_total") - F.col("sum_of_charges")) > tol)
    found = _error("block_total_mismatch", "error", F.lit(True), {
        "unit_code": F.col("unit_code"), "printed_total": F.col("printed_total").cast(S.MONEY),
        "sum_of_charges": F.col("sum_of_charges").cast(S.MONEY)})
    return _issues(bad, [found], F.col(ROW))


_GROUP_CELLS = {"square_footage": 6, "market_rent": 7, "lease_charges": 8, "security_deposit": 9, "other_deposits": 10,
                "pct_unit_occupancy": 12, "pct_sqft_occupied": 13, "balance": 14}


def summary_groups(rows: DataFrame) -> DataFrame:
    """Printed summary groups; a cell that cannot be read is null."""
    def money(i: int, t) -> Column:
        return F.when(_text(i) != "", as_decimal(F.col(f"c{i:02d}"))).try_cast(t)

    return rows.filter(F.col("cls") == "group").select(
        FILE, ROW, _text(1).alias("group_label"),
        *[money(i, S.PERCENT if n.startswith("pct") else S.TOTAL).alias(n) for n, i in _GROUP_CELLS.items()],
        as_int(F.col("c11")).alias("unit_count"))


def summary_issues(rows: DataFrame) -> DataFrame:
    """Unknown group labels and summary cells that cannot be read."""
    return _issues(rows, _summary_findings(), F.col(ROW)).unionByName(_group_issues(rows))


def _summary_findings() -> list[tuple[Column, Column]]:
    return [_error("unexpected_summary_group_label", "warning", F.col("cls") == "group_unknown", {"label": _text(1)}),
            _error("charge_summary_coercion", "error", (F.col("cls") == "charge_summary") & as_decimal_error(F.col("c04")), {"charge_code": _text(1)})]


def _group_issues(rows: DataFrame) -> DataFrame:
    said = {n: {"_text": F.col(f"c{i:02d}"), "_whole": F.lit(n == "unit_count")} for n, i in {**_GROUP_CELLS, "unit_count": 11}.items()}
    return _field_issues(
        rows.filter(F.col("cls") == "group"), "summary_group_coercion", F.lit("warning"), said,
        lambda x: F.when(x["_whole"], as_int_error(x["_text"])).otherwise((strip(x["_text"]) != "") & as_decimal_error(x["_text"])), {}, F.col(ROW))


def row_issues(rows: DataFrame) -> DataFrame:
    """All that `lease_issues`, `line_issues` and `summary_issues` find, the rows read once for the few groups and once for all else."""
    return _issues(rows, [*_lease_findings(), *_line_findings(), *_summary_findings()], F.col(ROW)).unionByName(_group_issues(rows))


def charge_summary_rows(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("cls") == "charge_summary") & ~as_decimal_error(F.col("c04"))).select(
        FILE, ROW, _text(1).alias("charge_code"), as_decimal(F.col("c04")).cast(S.TOTAL).alias("amount"))


@dataclass(frozen=True)
class ParsedRentRolls:
    headers: DataFrame
    rows: DataFrame
    leases: DataFrame
    lines: DataFrame
    groups: DataFrame
    charge_summary: DataFrame
    issues: DataFrame


def parse_rent_rolls(grid: DataFrame, chunk_rows: int = CHUNK_ROWS) -> ParsedRentRolls:
    """Facts and findings of every well-formed file; a malformed file yields one finding only. Headers, classified rows and
    blocks are cut once each, since several frames are read off them."""
    headers, failures = report_header(grid)
    headers = cut(headers)
    rows = cut(classify_rows(grid.join(headers.select(FILE), FILE, "left_semi"), chunk_rows))
    blocks = cut(lease_blocks(rows))
    found = [row_issues(rows), block_total_check(blocks)]
    coded = reduce(DataFrame.unionByName, found).join(headers.select(FILE, "property_code"), FILE)
    issues = failures.unionByName(coded.select(
        FILE, "severity", "rule", ROW,
        F.map_concat(F.create_map(F.lit("property_code"), F.col("property_code")), "detail").alias("detail")))
    return ParsedRentRolls(headers, rows, leases(blocks), charge_lines(rows), summary_groups(rows), charge_summary_rows(rows), issues)


# ---- availability ------------------------------------------------------------

_COUNTS = ("avg_sqft", "units", "occupied_no_notice", "vacant_rented", "vacant_unrented", "notice_rented",
           "notice_unrented", "available", "model", "down", "admin")
_AMOUNTS = ("avg_rent", "pct_occ", "pct_occ_w_nonrev", "pct_leased", "pct_trend")


def availability_row(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The data row of each availability report, and the findings about it. The checked reports, one row each, are cut, since both are read
    off them."""
    at = {n: i for i, n in enumerate(S.AVAILABILITY_FIELDS, start=1)}

    def data(name: str, row: str = "_r6") -> Column:
        return F.element_at(row, at[name])

    def every(names: tuple[str, ...], parse: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(*[data(n) for n in names]), parse)

    checked = cut(_identity(_first_rows(grid, S.AVAILABILITY_COLUMNS, 7)).withColumn(
        "error",
        F.when(F.col("_rows") < 6, "expected at least 6 rows")
        .when(_head_cell(1) != S.AVAILABILITY_TITLE, "row 1 is not the report title")
        .when(~_is_titled(2), "row 2 is not '<name> (<code>)'")
        .when(F.col("as_of_date").isNull(), "row 3 is not 'As Of = MM/DD/YYYY'")
        .when(_differs(4, S.AVAILABILITY_HEADER_1), "header row 4 changed")
        .when(_differs(5, S.AVAILABILITY_HEADER_2), "header row 5 changed")
        .when(_head_cell(6) != F.col("property_code"), "data row property differs from the title")
        .when(F.exists(F.array(*[data(n) for n in _AMOUNTS]), as_decimal_error), "data row holds an unreadable amount")))
    good = checked.filter(F.col("error").isNull())
    rows = good.withColumns({"_whole": every(_COUNTS, lambda c: F.coalesce(as_int(c), F.lit(0))), "_figures": every(_AMOUNTS, as_decimal)}).select(
        FILE, "property_code", "property_name", "as_of_date",
        *[F.element_at("_whole", i).alias(n) for i, n in enumerate(_COUNTS, 1)],
        *[F.element_at("_figures", i).try_cast(S.MONEY if n == "avg_rent" else S.PERCENT).alias(n) for i, n in enumerate(_AMOUNTS, 1)])
    whose = {"property_code": F.col("property_code")}
    differing = _field_issues(
        good.filter(F.element_at("_r7", 2) == "Total"), "availability_total_row_differs",
        F.when(F.col("_x.field") == "pct_trend", "info").otherwise("warning"),
        {n: {"data_row": data(n), "total_row": data(n, "_r7")} for n in S.AVAILABILITY_FIELDS[2:]}, lambda x: x["data_row"] != x["total_row"], whose, F.lit(7))
    unread = _field_issues(good, "availability_coercion", F.lit("warning"), {n: {"_text": data(n)} for n in _COUNTS},
                           lambda x: as_int_error(x["_text"]), whose, F.lit(6))
    return rows, _failures(checked).unionByName(differing).unionByName(unread)
