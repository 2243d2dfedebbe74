"""Reconciliation rules and row constraints. Every rule returns
`severity, rule, snapshot_id, property_code, detail` and reads book-grain aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.functions.scalars import is_occupied
from leaseloom.operators.rollups import BOOK, book_code_charges, book_dates, book_detail, book_repeats
from leaseloom.tables import BY_SNAPSHOT, Tables

TOLERANCE = 0.01


def _within(df: DataFrame, snapshot_ids: Sequence[int] | None) -> DataFrame:
    return df if snapshot_ids is None else df.filter(F.col("snapshot_id").isin(*snapshot_ids))


def _scoped(T: Tables, snapshot_ids: Sequence[int] | None) -> Tables:
    held = {n: getattr(T, n) for n in BY_SNAPSHOT if getattr(T, n) is not None}
    return T.with_frames(**{n: _within(df, snapshot_ids) for n, df in held.items()})


def _emit(df: DataFrame, severity: str, rule: str, detail: Mapping[str, Column], snapshot: Column | None = None) -> DataFrame:
    pairs = [x for name, value in detail.items() for x in (F.lit(name), value.cast("string"))]
    return df.select(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
        (snapshot if snapshot is not None else F.lit(None)).cast("int").alias("snapshot_id"),
        F.col("property_code"), F.create_map(*pairs).alias("detail"),
    )


def _codes(T: Tables) -> DataFrame:
    return T.property.select("property_id", "property_code")


def rule_charge_summary_vs_detail(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    T = _scoped(T, snapshot_ids)
    detail = (
        book_code_charges(T).filter(is_occupied(F.col("occupancy_status")))
        .groupBy(*BOOK, "charge_code").agg(F.sum("amount").alias("detail_amount"))
    )
    found = F.coalesce(F.col("detail_amount"), F.lit(0).cast("decimal(12,2)"))
    bad = (
        T.charge_summary.join(detail, [*BOOK, "charge_code"], "left")
        .filter(F.abs(F.col("amount") - found) > TOLERANCE)
        .join(_codes(T), "property_id")
    )
    return _emit(bad, "error", "charge_summary_vs_detail", {
        "property_code": F.col("property_code"), "charge_code": F.col("charge_code"),
        "report_amount": F.col("amount"), "detail_amount": found,
    }, F.col("snapshot_id"))


def summary_group_comparison(T: Tables) -> DataFrame:
    """Printed groups beside the detail each label stands for; one pass for all five labels.
    `Totals:` mixes scopes in the source and is never compared."""
    pair = lambda label, n, charges: F.struct(
        F.lit(label).alias("group_label"), F.col(n).alias("detail_units"), F.col(charges).alias("detail_charges"))
    labelled = book_detail(T).select(*BOOK, F.explode(F.array(
        pair(S.CURRENT_LABEL, "units", "lease_charges"),
        pair(S.FUTURE_LABEL, "future_leases", "future_charges"),
        pair("Occupied Units", "occupied_units", "occupied_charges"),
        pair("Total Vacant Units", "vacant_units", "vacant_charges"),
        pair("Total Non Rev Units", "non_revenue_units", "non_revenue_charges"),
    )).alias("d")).select(*BOOK, "d.*")
    return (
        T.summary_group.filter(F.col("group_label").isin(*[x for x in S.SUMMARY_GROUP_LABELS if x != "Totals:"]))
        .select(*BOOK, "group_label", "unit_count", "lease_charges")
        .join(labelled, [*BOOK, "group_label"], "left")
        .join(_codes(T), "property_id")
        .select("snapshot_id", "property_code", "group_label", "unit_count", "lease_charges",
                F.coalesce("detail_units", F.lit(0)).alias("detail_units"),
                F.coalesce(F.col("detail_charges"), F.lit(0).cast("decimal(12,2)")).alias("detail_charges"))
    )


def rule_summary_group_units_vs_detail(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    bad = summary_group_comparison(_scoped(T, snapshot_ids)).filter(F.col("unit_count") != F.col("detail_units"))
    return _emit(bad, "error", "summary_group_units_vs_detail", {
        "property_code": F.col("property_code"), "group_label": F.col("group_label"),
        "report_units": F.col("unit_count"), "detail_units": F.col("detail_units"),
    }, F.col("snapshot_id"))


def rule_summary_group_charges_vs_detail(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    bad = summary_group_comparison(_scoped(T, snapshot_ids)).filter(
        F.abs(F.col("lease_charges") - F.col("detail_charges")) > TOLERANCE
    )
    return _emit(bad, "error", "summary_group_charges_vs_detail", {
        "property_code": F.col("property_code"), "group_label": F.col("group_label"),
        "report_charges": F.col("lease_charges"), "detail_charges": F.col("detail_charges"),
    }, F.col("snapshot_id"))


def _available(T: Tables) -> DataFrame:
    detail = book_detail(T).select(*BOOK, F.col("units").alias("_u"), F.col("occupied_units").alias("_o"))
    return (
        T.availability.join(detail, BOOK, "left").join(_codes(T), "property_id")
        .withColumns({"detail_units": F.coalesce("_u", F.lit(0)), "detail_occupied": F.coalesce("_o", F.lit(0)),
                      "availability_occupied": F.col("occupied_no_notice") + F.col("notice_rented") + F.col("notice_unrented")})
    )


def rule_availability_units_vs_detail(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    bad = _available(_scoped(T, snapshot_ids)).filter(F.col("units") != F.col("detail_units"))
    return _emit(bad, "warning", "availability_units_vs_detail", {
        "snapshot_id": F.col("snapshot_id"), "property_code": F.col("property_code"),
        "availability_units": F.col("units"), "detail_units": F.col("detail_units"),
    }, F.col("snapshot_id"))


def rule_availability_occupancy_split_vs_detail(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    bad = _available(_scoped(T, snapshot_ids)).filter(F.col("availability_occupied") != F.col("detail_occupied"))
    return _emit(bad, "info", "availability_occupancy_split_vs_detail", {
        "property_code": F.col("property_code"), "availability_occupied": F.col("availability_occupied"),
        "detail_occupied": F.col("detail_occupied"),
    }, F.col("snapshot_id"))


def _counted(T: Tables, books: DataFrame, count: str, rule: str, name: str) -> DataFrame:
    """Informational counts per property, over all the snapshots given."""
    per = books.groupBy("property_id").agg(F.sum(count).alias("n")).filter(F.col("n") > 0).join(_codes(T), "property_id")
    return _emit(per, "info", rule, {"property_code": F.col("property_code"), name: F.col("n")})


def rule_expired_lease_no_moveout(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    return _counted(T, book_dates(_scoped(T, snapshot_ids)), "expired_held", "expired_lease_no_moveout", "count")


def rule_moveout_before_asof(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    return _counted(T, book_dates(_scoped(T, snapshot_ids)), "moved_out", "moveout_before_asof", "count")


def rule_zero_unit_property(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    T = _scoped(T, snapshot_ids)
    idle = (
        _codes(T)
        .join(book_detail(T).select("property_id").distinct(), "property_id", "left_anti")
        .join(T.availability.select("property_id").distinct(), "property_id", "left_semi")
    )
    return _emit(idle, "info", "zero_unit_property", {"property_code": F.col("property_code")})


def rule_duplicate_charge_code_in_block(T: Tables, snapshot_ids: Sequence[int] | None = None) -> DataFrame:
    return _counted(T, book_repeats(_scoped(T, snapshot_ids)), "blocks", "duplicate_charge_code_in_block", "blocks_with_repeats")


RULES = {
    "charge_summary_vs_detail": rule_charge_summary_vs_detail,
    "summary_group_units_vs_detail": rule_summary_group_units_vs_detail,
    "summary_group_charges_vs_detail": rule_summary_group_charges_vs_detail,
    "availability_units_vs_detail": rule_availability_units_vs_detail,
    "availability_occupancy_split_vs_detail": rule_availability_occupancy_split_vs_detail,
    "expired_lease_no_moveout": rule_expired_lease_no_moveout,
    "moveout_before_asof": rule_moveout_before_asof,
    "zero_unit_property": rule_zero_unit_property,
    "duplicate_charge_code_in_block": rule_duplicate_charge_code_in_block,
}


def issue_log(*frames: DataFrame) -> DataFrame:
    """Parse-time and post-load findings as one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rule_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


# ---- row constraints ---------------------------------------------------------

def lease_constraints() -> dict[str, Column]:
    """Name -> condition that marks a violation."""
    status, has_resident = F.col("occupancy_status"), F.col("resident_id").isNotNull()
    empty = status.isin("vacant", "model", "down")
    return {
        "lease_resident_presence": (empty & has_resident) | (~empty & ~has_resident),
        "lease_notice_implies_moveout": (status == "notice") & F.col("move_out").isNull(),
        "lease_date_order": F.col("move_out") < F.col("move_in"),
        "lease_sqft_non_negative": F.col("unit_sqft") < 0,
        "lease_section_value": ~F.col("section").isin(*S.SECTIONS),
        "lease_status_value": ~status.isin(*S.STATUSES),
        "resident_id_fmt": has_resident & ~F.col("resident_id").rlike(S.RESIDENT_ID_PATTERN),
    }


def availability_constraints() -> dict[str, Column]:
    return {"availability_units_non_negative": F.col("units") < 0}


def insight_constraints() -> dict[str, Column]:
    scope = F.col("scope")
    code, key = F.col("property_code").isNotNull(), F.col("asset_key").isNotNull()
    fits = (
        F.when(scope == "portfolio", ~code & ~key).when(scope == "asset", ~code & key)
        .when(scope == "property", code & ~key).otherwise(F.lit(False))
    )
    size = F.length("headline")
    return {
        "insight_headline_length": (size < 8) | (size > 120),
        "insight_scope_target": ~fits,
        "insight_category_value": ~F.col("category").isin(*S.INSIGHT_CATEGORIES),
        "insight_priority_value": ~F.col("priority").isin(*S.PRIORITIES),
    }


def audit_constraints() -> dict[str, Column]:
    same = [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in ("category", "description", "verified")]
    return {"charge_code_audit_changed_something": same[0] & same[1] & same[2]}


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Every row once per constraint it breaks, with the constraint's name; one pass."""
    broken = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda r: r.isNotNull()
    )
    return df.withColumn("violated", F.explode(broken))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that should be unique and are not, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
