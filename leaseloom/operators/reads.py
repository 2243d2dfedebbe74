"""Read queries. `snapshot_id=None` answers for every snapshot at once; a given one becomes a filter
on the facts' partition column."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.functions.scalars import (
    contains_term, is_occupied, percent, priority_rank, ratio, severity_rank,
)
from leaseloom.operators import marts as M
from leaseloom.operators.rollups import (
    BOOK, book_code_charges, book_files, book_spine, is_expiring, only,
)
from leaseloom.tables import BY_SNAPSHOT, Tables

KPI_SUMS = ("units", "occupied_units", "notice_units", "vacant_units", "non_revenue_units", "future_leases",
            "market_rent", "lease_charges", "square_feet", "balance")
_KPI_ZERO = KPI_SUMS


def at(T: Tables, snapshot_id: int | None) -> Tables:
    """The bundle restricted to one snapshot."""
    if snapshot_id is None:
        return T
    names = ("snapshot", *BY_SNAPSHOT, "insight", "insight_run")
    return T.with_frames(**{n: only(getattr(T, n), snapshot_id) for n in names if getattr(T, n) is not None})


def _coded(df: DataFrame, T: Tables, *columns: str) -> DataFrame:
    return df.join(T.property.select("property_id", *(columns or ("property_code",))), "property_id")


def _for_property(df: DataFrame, property_code: str | None) -> DataFrame:
    # property codes compare without regard to case
    return df if property_code is None else df.filter(F.lower("property_code") == property_code.lower())


def latest_snapshot(T: Tables, as_of: dt.date | None = None) -> DataFrame:
    days = T.snapshot if as_of is None else T.snapshot.filter(F.col("as_of_date") == F.lit(as_of))
    return days.select("snapshot_id", "as_of_date").orderBy(F.desc("as_of_date")).limit(1)


def snapshot_list(T: Tables) -> DataFrame:
    return T.snapshot.select("snapshot_id", "as_of_date", "report_month").orderBy(F.desc("as_of_date"))


def portfolio_totals(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    """Portfolio sums; `properties` counts every book, `property_count` those with leases."""
    T = at(T, snapshot_id)
    summed = M.property_snapshot_kpi(T).groupBy("snapshot_id").agg(
        *[F.sum(c).alias(c) for c in KPI_SUMS], F.count(F.lit(1)).alias("property_count")
    )
    every = T.property.agg(F.count(F.lit(1))).scalar()
    return T.snapshot.select("snapshot_id").join(summed, "snapshot_id", "left").select(
        "snapshot_id", *KPI_SUMS, percent(F.col("occupied_units"), F.col("units")).alias("pct_occupied"),
        every.alias("properties"), F.coalesce("property_count", F.lit(0)).alias("property_count"),
    )


def property_kpi(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    """Books with their KPI and availability figures; an empty book is still returned."""
    T = at(T, snapshot_id)
    kpi = M.property_snapshot_kpi(T).select(*BOOK, *KPI_SUMS, "pct_occupied")
    seen = T.availability.select(*BOOK, F.col("units").alias("availability_units"), "available", "pct_leased",
                                 "avg_rent", "avg_sqft")
    return (
        _for_property(book_spine(T), property_code)
        .join(kpi, BOOK, "left").join(seen, BOOK, "left")
        .select("snapshot_id", "property_id", "property_code", "property_name", "book_type", "asset_key",
                *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _KPI_ZERO], "pct_occupied",
                "availability_units", "available", "pct_leased", "avg_rent", "avg_sqft")
    )


def property_table(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    dropped = ("property_id", "availability_units", "avg_rent", "avg_sqft")
    return property_kpi(T, snapshot_id).drop(*dropped).orderBy("snapshot_id", "property_code")


def asset_table(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    return M.asset_snapshot_kpi(M.property_snapshot_kpi(at(T, snapshot_id))).select(
        "snapshot_id", "asset_key", "asset_label", "book_count", "property_codes", "units", "occupied_units",
        "vacant_units", "pct_occupied", "market_rent", "lease_charges", "balance",
    ).orderBy("snapshot_id", F.desc("units"))


def portfolio_expirations(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    return M.expiration_schedule(at(T, snapshot_id)).groupBy("snapshot_id", "expiry_month").agg(
        *[F.sum(c).alias(c) for c in ("expiring_leases", "charges_at_risk", "holdover_mtm")]
    ).orderBy("snapshot_id", "expiry_month")


def portfolio_charge_mix(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    return M.charge_mix(at(T, snapshot_id)).groupBy("snapshot_id", "category").agg(
        F.sum("line_count").alias("line_count"), F.sum("amount").alias("amount")
    ).orderBy("snapshot_id", F.desc("amount"))


#: The grains of `book_grains`, by what each is keyed by beside the snapshot.
GRAINS = {"portfolio": (), "asset": ("asset_key",), "book": ("asset_key", "property_code")}
CHARGE_GRAINS = {"portfolio": ("category",), "book": ("property_code", "category")}


def _grain(grains: dict[str, tuple[str, ...]], keys: list[str]) -> Column:
    """The name of a row's grain, by which keys it was not grouped by."""
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    names = {sum(b for k, b in bit.items() if k not in ("snapshot_id", *held)): name for name, held in grains.items()}
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.grouping_id(*keys).cast("int")]


def book_grains(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    """Portfolio, assets and books in one aggregate over the books' figures: grain, snapshot_id, asset_key, property_code (null where a
    grain has none), the sums, how many books they are of, and the occupancy."""
    keys = ["snapshot_id", "asset_key", "property_code"]
    sets = [["snapshot_id", *held] for held in GRAINS.values()]
    return M.property_snapshot_kpi(at(T, snapshot_id)).groupingSets(sets, *keys).agg(
        _grain(GRAINS, keys).alias("grain"), *[F.sum(c).alias(c) for c in KPI_SUMS], F.count(F.lit(1)).alias("books"),
        percent(F.sum("occupied_units"), F.sum("units")).alias("pct_occupied"))


def charge_grains(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    """What the portfolio and each book bill by category, in one aggregate."""
    keys = ["snapshot_id", "property_code", "category"]
    sets = [["snapshot_id", *held] for held in CHARGE_GRAINS.values()]
    return _coded(M.charge_mix(at(T, snapshot_id)), T).groupingSets(sets, *keys).agg(
        _grain(CHARGE_GRAINS, keys).alias("grain"), F.sum("line_count").alias("line_count"), F.sum("amount").alias("amount"))


def status_mix(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    return at(T, snapshot_id).lease.groupBy("snapshot_id", F.col("occupancy_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy("snapshot_id", F.desc("n"))


MATRIX_COLUMNS = (
    "property_code", "property_name", "book_type", "asset_key", "units", "occupied_units", "notice_units",
    "vacant_units", "pct_occupied", "market_rent", "lease_charges", "revenue_capture_pct", "quadrant",
    "plottable", "exclusion_reason", "charge_coverage", "charges_to_threshold", "units_to_threshold",
    "loss_to_lease", "concessions", "ancillary_charges", "units_owing", "balance_owed",
)


def matrix_view(T: Tables, snapshot_id: int | None = None, plottable: bool | None = None, **thresholds: float) -> DataFrame:
    """The matrix with its thresholds; `plottable` picks the points or the excluded books."""
    rows = M.property_profitability(at(T, snapshot_id), **thresholds)
    if plottable is not None:
        rows = rows.filter(F.col("plottable") == plottable)
    return rows.select("snapshot_id", *MATRIX_COLUMNS, "capture_threshold", "occupancy_threshold").orderBy(
        "snapshot_id", F.asc_nulls_last("revenue_capture_pct"), "property_code")


def outlier_view(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    return M.unit_rent_outlier(at(T, snapshot_id)).drop("property_id", "unit_id").orderBy(
        "snapshot_id", F.desc(F.abs("pct_vs_median")), "property_code", "unit_code")


def concentration_view(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    return M.expiration_concentration(at(T, snapshot_id)).filter("concentrated").drop("property_id", "concentrated").orderBy(
        "snapshot_id", F.desc("share_of_book"))


def unit_type_mix(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    T = at(T, snapshot_id)
    per = (
        T.lease.filter((F.col("section") == "current") & F.col("unit_type_code").isNotNull())
        .groupBy(*BOOK, "unit_type_code")
        .agg(F.count(F.lit(1)).alias("units"), ratio(F.sum("market_rent"), F.count("market_rent"), 2).alias("avg_market_rent"),
             ratio(F.sum("unit_sqft"), F.count("unit_sqft"), 0).alias("avg_sqft"),
             F.count_if(is_occupied(F.col("occupancy_status"))).alias("occupied"))
    )
    return _for_property(_coded(per, T), property_code).drop("property_id").orderBy("snapshot_id", "property_code", F.desc("units"))


def property_loss_to_lease(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    T = at(T, snapshot_id)
    return _for_property(_coded(M.book_loss_to_lease(T), T), property_code).drop("property_id")


_UNIT_COLUMNS = ("property_code", "unit_code", "unit_type_code", "unit_sqft", "occupancy_status", "section",
                 "resident_id", "display_name", "market_rent", "charges_total", "balance", "move_in",
                 "lease_expiration", "move_out")


def _named(df: DataFrame, T: Tables) -> DataFrame:
    return df.join(T.resident, "resident_id", "left")


def unit_search(
    T: Tables, snapshot_id: int | None = None, property_code: str | None = None, status: str | None = None,
    term: str | None = None, limit: int = 200, offset: int = 0,
) -> DataFrame:
    """One page of leases, with the number of leases the filters match in `total`.

    Resident names are only joined before the page is cut when the term has to be looked up in them;
    otherwise they are joined to the page."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must lie in 1..1000 and offset must not be negative")
    T = at(T, snapshot_id)
    hits = _for_property(_coded(T.lease, T), property_code)
    if status is not None:
        hits = hits.filter(F.col("occupancy_status") == status)
    if term is not None:
        hits = _named(hits, T).filter(contains_term(F.col("unit_code"), term) | contains_term(F.col("display_name"), term))
    total = hits.agg(F.count(F.lit(1))).scalar()
    order = ["snapshot_id", "property_code", "unit_code", "section"]
    page = hits.orderBy(*order, "lease_id").offset(offset).limit(limit)
    if term is None:
        page = _named(page, T)
    return page.select("snapshot_id", *_UNIT_COLUMNS, "lease_id", total.alias("total")).orderBy(*order, "lease_id")


def unit_list(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    """Every lease of the snapshot, unpaginated."""
    T = at(T, snapshot_id)
    return _named(_coded(T.lease, T), T).select("snapshot_id", *_UNIT_COLUMNS).orderBy(
        "snapshot_id", "property_code", "unit_code", "section")


def lease_header(T: Tables, snapshot_id: int | None = None, lease_id: int | None = None) -> DataFrame:
    """One lease of a snapshot (read from that snapshot's partition alone), or all."""
    T = T.with_frames(lease=only(T.lease, snapshot_id))
    lease = T.lease if lease_id is None else T.lease.filter(F.col("lease_id") == lease_id)
    return _named(_coded(lease, T), T).select(
        "lease_id", "property_code", "unit_code", "occupancy_status", "resident_id", "display_name",
        "market_rent", "charges_total", "balance")


def lease_lines(T: Tables, snapshot_id: int | None = None, lease_id: int | None = None) -> DataFrame:
    """The lines of one lease of a snapshot, or of all."""
    billed = only(T.lease_charge, snapshot_id)
    lines = billed if lease_id is None else billed.filter(F.col("lease_id") == lease_id)
    return lines.join(T.charge_code, "charge_code").select(
        "lease_id", "line_no", "charge_code", "category", "description", "is_concession", "amount"
    ).orderBy("lease_id", "line_no")


def expiring_leases(
    T: Tables, snapshot_id: int | None = None, month: dt.date | None = None, property_code: str | None = None
) -> DataFrame:
    """The leases behind one bar of the expiration ladder; same predicate as the ladder, no limit."""
    if month is not None and month.day != 1:
        raise ValueError("month must be the first day of a month")
    T = at(T, snapshot_id)
    dated = T.lease.filter(is_expiring()).withColumn("expiry_month", F.trunc("lease_expiration", "MM"))
    if month is not None:
        dated = dated.filter(F.col("expiry_month") == F.lit(month))
    rows = _for_property(_coded(dated, T, "property_code", "property_name"), property_code)
    return (
        _named(rows.join(T.snapshot.select("snapshot_id", "as_of_date"), "snapshot_id"), T)
        .select("snapshot_id", "expiry_month", "property_name", *_UNIT_COLUMNS,
                (F.col("lease_expiration") < F.col("as_of_date")).alias("holdover"), "lease_id")
        .orderBy("snapshot_id", "property_code", "unit_code")
    )


def anomaly_view(T: Tables, snapshot_id: int | None = None, **params: float) -> DataFrame:
    found = M.property_anomaly(M.property_profitability(at(T, snapshot_id)), **params)
    return found.drop("property_id").orderBy(
        "snapshot_id", priority_rank(F.col("priority")), F.desc(F.abs("z")), "property_code")


def snapshot_runs(T: Tables) -> DataFrame:
    """The runs that loaded each snapshot."""
    loaded = book_files(T).select("snapshot_id", "file_id").distinct()
    return loaded.join(T.file.select("file_id", "run_id"), "file_id").select("snapshot_id", "run_id").distinct()


def _snapshot_issues(T: Tables, issues: DataFrame) -> DataFrame:
    return issues.join(snapshot_runs(T), "run_id")


def issue_summary(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    """Issues of the runs that loaded the snapshot, counted by rule; counted before the join, so a
    run that loaded many snapshots does not multiply its issues."""
    counted = T.issue.groupBy("run_id", "severity", "rule").agg(F.count(F.lit(1)).alias("n"))
    return (
        _snapshot_issues(at(T, snapshot_id), counted).groupBy("snapshot_id", "severity", "rule")
        .agg(F.sum("n").alias("n")).orderBy("snapshot_id", severity_rank(F.col("severity")), "rule")
    )


def issue_detail(T: Tables, snapshot_id: int | None = None, limit: int = 100) -> DataFrame:
    """The first warnings and errors of each snapshot's runs."""
    # severities sort as declared: info, warning, error
    order = [F.when(F.col("severity") == "warning", 0).otherwise(1), F.col("rule"), F.col("issue_id")]
    first = Window.partitionBy("run_id").orderBy(*order)
    # a snapshot's first `limit` lie within the first `limit` of each of its runs
    heads = T.issue.filter(F.col("severity") != "info").withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= limit)
    by_snapshot = Window.partitionBy("snapshot_id").orderBy(*order)
    return (
        _snapshot_issues(at(T, snapshot_id), heads).withColumn("_i", F.row_number().over(by_snapshot))
        .filter(F.col("_i") <= limit).select("snapshot_id", "severity", "rule", "issue_id", "detail")
    )


def issue_export(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    T = at(T, snapshot_id)
    return T.issue.join(snapshot_runs(T).select("run_id").distinct(), "run_id", "left_semi").select(
        "severity", "rule", "sheet_row", "detail").orderBy("severity", "rule")


def run_history(T: Tables, n: int = 10) -> DataFrame:
    return T.run.orderBy(F.desc("run_id")).limit(n)


def charge_code_usage(T: Tables, snapshot_id: int | None = None, unverified_only: bool = False) -> DataFrame:
    """Every code with its lines, amount and number of books; unused codes are kept."""
    used = (
        book_code_charges(at(T, snapshot_id)).groupBy("charge_code")
        .agg(F.sum("line_count").alias("line_count"), F.sum("amount").alias("amount"),
             F.countDistinct("property_id").alias("properties"))
    )
    codes = T.charge_code.filter(~F.col("label_verified")) if unverified_only else T.charge_code
    return codes.join(used, "charge_code", "left").select(
        "charge_code", "category", "description", "is_concession", "label_verified",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("line_count", "amount", "properties")],
    ).orderBy("category", "charge_code")


def audit_history(T: Tables, charge_code: str | None = None, limit: int | None = 20) -> DataFrame:
    rows = T.audit if charge_code is None else T.audit.filter(F.col("charge_code") == charge_code)
    rows = rows.orderBy(F.desc("changed_at"))
    return rows if limit is None else rows.limit(limit)


def _positioning_first() -> Column:
    return F.when(F.col("category") == "positioning", 0).otherwise(1)


def property_insights(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    rows = at(T, snapshot_id).insight.filter(F.col("scope") == "property")
    return _for_property(rows, property_code).orderBy(
        "snapshot_id", "property_code", priority_rank(F.col("priority")), _positioning_first(), "insight_id")


def insight_list(T: Tables, snapshot_id: int | None = None, scope: str | None = None) -> DataFrame:
    rows = at(T, snapshot_id).insight
    if scope is not None:
        rows = rows.filter(F.col("scope") == scope)
    return rows.orderBy("snapshot_id", priority_rank(F.col("priority")), "scope", "insight_id")


def last_insight_run(T: Tables, snapshot_id: int | None = None) -> DataFrame:
    runs = at(T, snapshot_id).insight_run
    kept = ("model", "status", "error", "started_at", "finished_at")
    return runs.groupBy("snapshot_id").agg(F.max_by(F.struct(*kept), "insight_run_id").alias("r")).select("snapshot_id", "r.*")


def panel_matrix(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    return _for_property(M.property_profitability(at(T, snapshot_id)), property_code)


def panel_charge_mix(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    T = at(T, snapshot_id)
    return _for_property(_coded(M.charge_mix(T), T), property_code).select(
        "snapshot_id", "property_code", "category", "charge_code", "line_count", "amount"
    ).orderBy("snapshot_id", "property_code", F.desc("amount"))


def panel_expirations(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    T = at(T, snapshot_id)
    return _for_property(_coded(M.expiration_schedule(T), T), property_code).select(
        "snapshot_id", "property_code", "expiry_month", "expiring_leases", "charges_at_risk", "holdover_mtm"
    ).orderBy("snapshot_id", "property_code", "expiry_month")


def panel_summary_groups(T: Tables, snapshot_id: int | None = None, property_code: str | None = None) -> DataFrame:
    T = at(T, snapshot_id)
    return _for_property(_coded(T.summary_group, T), property_code).select(
        "snapshot_id", "property_code", "group_label", "unit_count", "square_footage", "market_rent", "lease_charges",
        "security_deposit", "other_deposits", "pct_unit_occupancy", "balance",
    ).orderBy("snapshot_id", "property_code", "group_label")


def reconciliation_view(T: Tables, snapshot_id: int | None = None, differing_only: bool = False) -> DataFrame:
    rows = M.reconciliation(at(T, snapshot_id))
    if differing_only:
        off = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
        rows = rows.filter(
            off("unit_delta") | off("charge_delta")
            | (F.col("detail_occupied") != F.coalesce("availability_occupied", "detail_occupied")))
    return rows.orderBy("snapshot_id", "property_code")


# ---- the export registry: each dataset is a full, unpaginated read -----------
EXPORTS = {
    "properties": lambda T, s: property_table(T, s).drop("available", "pct_leased"),
    "assets": asset_table,
    "units": unit_list,
    "charge_mix": lambda T, s: panel_charge_mix(T, s).orderBy("snapshot_id", "property_code", "category", "charge_code"),
    "expirations": panel_expirations,
    "matrix": lambda T, s: M.property_profitability(at(T, s)).select("snapshot_id", *MATRIX_COLUMNS).orderBy("snapshot_id", "property_code"),
    "revenue_bridge": lambda T, s: M.revenue_bridge(at(T, s)).drop("property_id").orderBy("snapshot_id", "property_code"),
    "outliers": lambda T, s: M.unit_rent_outlier(at(T, s)).drop("property_id", "unit_id", "lease_id").orderBy("snapshot_id", "property_code", "unit_code"),
    "concentration": lambda T, s: M.expiration_concentration(at(T, s)).drop("property_id", "concentration_threshold", "min_dated_leases").orderBy("snapshot_id", "property_code", "expiry_month"),
    "anomalies": lambda T, s: M.property_anomaly(M.property_profitability(at(T, s))).drop("property_id").orderBy("snapshot_id", "property_code", "metric"),
    "reconciliation": reconciliation_view,
    "issues": issue_export,
    "charge_codes": charge_code_usage,
}


def export_dataset(T: Tables, dataset: str, snapshot_id: int | None = None) -> DataFrame:
    if dataset not in EXPORTS:
        raise KeyError(f"unknown dataset {dataset!r}; expected one of {', '.join(sorted(EXPORTS))}")
    return EXPORTS[dataset](T, snapshot_id)
