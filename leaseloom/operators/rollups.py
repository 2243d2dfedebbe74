"""Shared aggregates: one pass over each fact, at lease grain and at book grain.

A book is a (snapshot, property). Catalyst prunes the aggregate columns a caller does not select, so
one wide definition serves every mart without computing what it does not need. Where the aggregates are
stored with the tables, they are read instead of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.functions.scalars import is_occupied
from leaseloom.tables import Tables

BOOK = ["snapshot_id", "property_id"]


def only(df: DataFrame, snapshot_id: int | None) -> DataFrame:
    """Restrict to one snapshot (a partition filter), or keep them all."""
    return df if snapshot_id is None else df.filter(F.col("snapshot_id") == snapshot_id)


def is_expiring() -> Column:
    """The one definition of a dated lease, shared by the ladder and its drill-down."""
    return is_occupied(F.col("occupancy_status")) & F.col("lease_expiration").isNotNull()


def sum_if(cond: Column, value: str) -> Column:
    return F.sum(F.when(cond, F.col(value)))


def book_detail(T: Tables) -> DataFrame:
    """Every lease-derived figure at book grain, in one pass over the leases."""
    if T.book_detail is not None:
        return T.book_detail
    status = F.col("occupancy_status")
    current, future = F.col("section") == "current", F.col("section") == "future"
    occupied, vacant = is_occupied(status), status == "vacant"
    non_revenue = status.isin(*S.NON_REVENUE_STATUSES)
    owing = current & (F.col("balance") > 0)
    return T.lease.groupBy(*BOOK).agg(
        F.count_if(current).alias("units"),
        F.count_if(occupied).alias("occupied_units"),
        F.count_if(status == "notice").alias("notice_units"),
        F.count_if(vacant).alias("vacant_units"),
        F.count_if(non_revenue).alias("non_revenue_units"),
        F.count_if(future).alias("future_leases"),
        sum_if(current, "market_rent").alias("market_rent"),
        sum_if(current, "charges_total").alias("lease_charges"),
        sum_if(current, "unit_sqft").alias("square_feet"),
        sum_if(current, "balance").alias("balance"),
        sum_if(current, "resident_deposit").alias("deposits"),
        sum_if(current & (vacant | non_revenue), "market_rent").alias("vacancy_loss"),
        F.count_if(current & (F.col("charge_lines") > 0)).alias("leases_with_charges"),
        F.count_if(owing).alias("units_owing"),
        sum_if(owing, "balance").alias("balance_owed"),
        sum_if(occupied, "market_rent").alias("occupied_market_rent"),
        sum_if(future, "charges_total").alias("future_charges"),
        sum_if(occupied, "charges_total").alias("occupied_charges"),
        sum_if(vacant, "charges_total").alias("vacant_charges"),
        sum_if(non_revenue, "charges_total").alias("non_revenue_charges"),
    )


def book_code_charges(T: Tables) -> DataFrame:
    """Charge lines counted and summed per book, lease state and code; the only pass over the lines
    the book-grain marts make. The lines carry their lease's book and state, so no fact join."""
    if T.book_code_charges is not None:
        return T.book_code_charges
    return T.lease_charge.groupBy(*BOOK, "section", "occupancy_status", "charge_code").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("amount").alias("amount")
    )


def book_expirations(T: Tables) -> DataFrame:
    """Occupied and notice leases by the month they expire in."""
    if T.book_expirations is not None:
        return T.book_expirations
    return _dated(T).filter(is_expiring()).groupBy(*BOOK, F.trunc("lease_expiration", "MM").alias("expiry_month")).agg(
        F.count(F.lit(1)).alias("expiring_leases"),
        F.sum("charges_total").alias("charges_at_risk"),
        F.count_if(F.col("lease_expiration") < F.col("as_of_date")).alias("holdover_mtm"),
    )


def book_dates(T: Tables) -> DataFrame:
    """Leases whose dates disagree with the report's, by book: held beyond their end, and moved out before it."""
    if T.book_dates is not None:
        return T.book_dates
    day = F.col("as_of_date")
    return _dated(T).groupBy(*BOOK).agg(
        F.count_if(is_occupied(F.col("occupancy_status")) & (F.col("lease_expiration") < day)).alias("expired_held"),
        F.count_if(F.col("move_out") < day).alias("moved_out"),
    )


def book_repeats(T: Tables) -> DataFrame:
    """Lease and code pairs with several lines, by book."""
    if T.book_repeats is not None:
        return T.book_repeats
    repeats = T.lease_charge.groupBy(*BOOK, "lease_id", "charge_code").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return repeats.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("blocks"))


def book_files(T: Tables) -> DataFrame:
    """The files that the leases of a book came from."""
    if T.book_files is not None:
        return T.book_files
    return T.lease.select(*BOOK, "file_id").distinct()


#: The aggregates that a load stores.
ROLLUPS = {"book_detail": book_detail, "book_code_charges": book_code_charges, "book_expirations": book_expirations,
           "book_dates": book_dates, "book_repeats": book_repeats, "book_files": book_files}


def _dated(T: Tables) -> DataFrame:
    return T.lease.join(T.snapshot.select("snapshot_id", "as_of_date"), "snapshot_id")


def with_category(df: DataFrame, T: Tables) -> DataFrame:
    return df.join(T.charge_code.select("charge_code", "category"), "charge_code")


def book_charges(T: Tables) -> DataFrame:
    """Every charge-derived figure at book grain."""
    category = F.col("category")
    current, occupied = F.col("section") == "current", is_occupied(F.col("occupancy_status"))
    main = category.isin("rent", "subsidy", "concession")
    return (
        with_category(book_code_charges(T), T)
        .groupBy(*BOOK)
        .agg(
            sum_if(current & (category == "rent"), "amount").alias("rent_charges"),
            sum_if(current & (category == "subsidy"), "amount").alias("subsidy"),
            sum_if(current & (category == "concession"), "amount").alias("current_concessions"),
            sum_if(current & ~main, "amount").alias("current_ancillary"),
            sum_if(current, "amount").alias("billed_charges"),
            sum_if(~main, "amount").alias("ancillary_charges"),
            sum_if(occupied & (category == "rent"), "amount").alias("occupied_rent"),
            sum_if(occupied & (category == "concession"), "amount").alias("occupied_concessions"),
        )
    )


def lease_charge_rollup(T: Tables, lines: Column | None = None) -> DataFrame:
    """Rent and concession sums per lease of a snapshot; leases with neither have no row.

    `lines` narrows the lines by their lease's state before anything moves, and lines of other
    categories are dropped before the shuffle. They collapse to one row per lease before any join, so a
    lease with very many lines costs its partial aggregates and not its lines."""
    category = F.col("category")
    billed = T.lease_charge if lines is None else T.lease_charge.filter(lines)
    codes = T.charge_code.filter(category.isin("rent", "concession")).select("charge_code", "category")
    return (
        billed.join(codes, "charge_code")
        .groupBy(*T.lease_key)
        .agg(
            sum_if(category == "rent", "amount").alias("rent_amount"),
            sum_if(category == "concession", "amount").alias("concession_amount"),
        )
    )


def book_spine(T: Tables) -> DataFrame:
    """Every snapshot with every property, so that a book without leases still gets its row.

    The snapshots travel as one array (a snapshot is a distinct calendar date, which bounds it) and
    are unnested beside each property."""
    days = T.snapshot.agg(
        F.sort_array(F.collect_set(F.struct("snapshot_id", "as_of_date"))).alias("days")
    ).scalar()
    return (
        T.property.withColumn("_day", F.explode(days))
        .select("_day.snapshot_id", "_day.as_of_date", *T.property.columns)
    )
