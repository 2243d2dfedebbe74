"""The marts: occupancy, charges, expirations, positioning, revenue bridge, anomalies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.functions.scalars import is_occupied, percent, quadrant, ratio
from leaseloom.operators.rollups import (
    BOOK, book_charges, book_code_charges, book_detail, book_expirations, book_spine,
    lease_charge_rollup, with_category,
)
from leaseloom.operators.scan import cut, grouped_median_disc
from leaseloom.sources.literals import literal_rows
from leaseloom.tables import Tables


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).alias(c)


def _threshold(x: float) -> Column:
    return F.lit(Decimal(str(x)))


def property_snapshot_kpi(T: Tables) -> DataFrame:
    """Occupancy and revenue per book, from the lease detail."""
    return (
        book_detail(T)
        .join(T.property, "property_id")
        .join(T.snapshot.select("snapshot_id", "as_of_date"), "snapshot_id")
        .select(
            "snapshot_id", "as_of_date", "property_id", "property_code", "property_name", "book_type",
            "asset_key", "units", "occupied_units", "notice_units", "vacant_units",
            "non_revenue_units", "future_leases",
            percent(F.col("occupied_units"), F.col("units")).alias("pct_occupied"),
            "market_rent", "lease_charges", "square_feet", "balance", "deposits",
        )
    )


def charge_mix(T: Tables) -> DataFrame:
    """What each book bills, by category and code, over every section."""
    return (
        with_category(book_code_charges(T), T)
        .groupBy(*BOOK, "category", "charge_code")
        .agg(F.sum("line_count").alias("line_count"), F.sum("amount").alias("amount"))
    )


def expiration_schedule(T: Tables) -> DataFrame:
    """Occupied and notice leases by the month they expire in."""
    return book_expirations(T)


def loss_to_lease(T: Tables) -> DataFrame:
    """Contract against market rent, per occupied or notice lease."""
    contract = F.coalesce(F.col("rent_amount"), F.lit(0))
    occupied = is_occupied(F.col("occupancy_status"))
    return (
        T.lease.filter(occupied)
        .join(lease_charge_rollup(T, occupied), list(T.lease_key), "left")
        .select(
            *BOOK, "unit_id", "unit_code", "unit_type_code", "market_rent",
            contract.alias("contract_rent"),
            F.coalesce(F.col("concession_amount"), F.lit(0)).alias("concessions"),
            (F.col("market_rent") - contract).alias("loss_to_lease"),
        )
    )


def book_loss_to_lease(T: Tables) -> DataFrame:
    """`loss_to_lease` summed per book, without joining the two facts: the sum of the differences is
    the difference of the sums."""
    contract = F.coalesce(F.col("occupied_rent"), F.lit(0))
    return (
        book_detail(T).filter(F.col("occupied_units") > 0)
        .select(*BOOK, F.col("occupied_units").alias("units"), F.col("occupied_market_rent").alias("market_rent"))
        .join(book_charges(T).select(*BOOK, "occupied_rent", "occupied_concessions"), BOOK, "left")
        .select(
            *BOOK, "units", "market_rent", contract.alias("contract_rent"),
            F.coalesce(F.col("occupied_concessions"), F.lit(0)).alias("concessions"),
            (F.col("market_rent") - contract).alias("loss_to_lease"),
        )
    )


def reconciliation(T: Tables, kpi: DataFrame | None = None) -> DataFrame:
    """Detail against the availability report and against the printed rollup."""
    printed = T.summary_group.filter(F.col("group_label") == S.CURRENT_LABEL).select(
        *BOOK, F.col("lease_charges").alias("report_charges")
    )
    available = T.availability.select(
        *BOOK, F.col("units").alias("availability_units"),
        (F.col("occupied_no_notice") + F.col("notice_rented") + F.col("notice_unrented")).alias("availability_occupied"),
    )
    k = kpi if kpi is not None else property_snapshot_kpi(T)
    return (
        k.select(*BOOK, "property_code", F.col("units").alias("detail_units"),
                 F.col("occupied_units").alias("detail_occupied"), F.col("lease_charges").alias("detail_charges"))
        .join(available, BOOK, "left")
        .join(printed, BOOK, "left")
        .select(
            "snapshot_id", "property_code", "detail_units", "availability_units",
            (F.col("detail_units") - F.col("availability_units")).alias("unit_delta"),
            "detail_occupied", "availability_occupied", "detail_charges", "report_charges",
            (F.col("detail_charges") - F.col("report_charges")).alias("charge_delta"),
        )
    )


def asset_snapshot_kpi(kpi: DataFrame) -> DataFrame:
    """The books of one physical asset, summed."""
    total = [F.sum(c).alias(c) for c in (
        "units", "occupied_units", "vacant_units", "non_revenue_units", "market_rent",
        "lease_charges", "square_feet", "balance")]
    return (
        kpi.groupBy("snapshot_id", "as_of_date", "asset_key")
        .agg(
            F.min("property_name").alias("asset_label"),
            F.count(F.lit(1)).alias("book_count"),
            F.sort_array(F.collect_list("property_code")).alias("property_codes"),
            *total,
        )
        .withColumn("pct_occupied", percent(F.col("occupied_units"), F.col("units")))
    )


TREND_METRICS = ("pct_occupied", "market_rent", "lease_charges", "balance", "notice_units")


def property_trend(kpi: DataFrame) -> DataFrame:
    """Movement against the property's previous snapshot; its first snapshot has no row."""
    by_property = Window.partitionBy("property_id").orderBy("as_of_date")
    moved = kpi.select(
        "property_id", "property_code", "property_name",
        F.lag("as_of_date").over(by_property).alias("prior_as_of"),
        F.col("as_of_date").alias("current_as_of"),
        *TREND_METRICS,
        *[(F.col(m) - F.lag(m).over(by_property)).alias(f"d_{m}") for m in TREND_METRICS],
    )
    return moved.filter(F.col("prior_as_of").isNotNull())


def charge_coverage(T: Tables) -> DataFrame:
    """Share of a book's current leases that print at least one charge line."""
    return book_detail(T).select(
        *BOOK, F.col("units").alias("current_leases"), "leases_with_charges",
        ratio(F.col("leases_with_charges"), F.col("units"), 3).alias("charge_coverage"),
    )


def delinquency(T: Tables) -> DataFrame:
    return book_detail(T).filter(F.col("units") > 0).select(*BOOK, "units_owing", "balance_owed")


def ancillary(mix: DataFrame, excluded: tuple[str, ...] = ("rent", "concession", "subsidy")) -> DataFrame:
    return mix.groupBy(*BOOK).agg(
        F.sum(F.when(~F.col("category").isin(*excluded), F.col("amount"))).alias("ancillary_charges")
    )


def _exclusion(units: Column, rent: Column, coverage: Column, coverage_th: float) -> Column:
    return (
        F.when(units == 0, "no_units")
        .when(rent.isNull() | (rent <= 0), "no_market_rent")
        .when(F.coalesce(coverage, F.lit(0)) < _threshold(coverage_th), "no_charge_data")
    )


def property_profitability(
    T: Tables, capture_th: float = 95.0, occ_th: float = 95.0, coverage_th: float = 0.5
) -> DataFrame:
    """Revenue capture against physical occupancy for every book, with its quadrant, the movement it
    takes to cross each line, and the reason when a book cannot be scored.

    One pass over the leases and one over the charge lines, joined at book grain."""
    detail = book_detail(T).withColumn("pct_occupied", percent(F.col("occupied_units"), F.col("units")))
    counts = ("units", "occupied_units", "notice_units", "vacant_units", "non_revenue_units")
    base = (
        book_spine(T)
        .join(detail, BOOK, "left")
        .join(book_charges(T).select(*BOOK, "ancillary_charges", "occupied_rent", "occupied_concessions"), BOOK, "left")
        .select(
            "snapshot_id", "as_of_date", "property_id", "property_code", "property_name", "book_type",
            "asset_key", *[_zero(c) for c in counts], "pct_occupied", "market_rent", "lease_charges",
            "square_feet", "balance",
            _threshold(capture_th).alias("capture_threshold"),
            _threshold(occ_th).alias("occupancy_threshold"),
            ratio(F.col("leases_with_charges"), F.col("units"), 3).alias("charge_coverage"),
            F.coalesce(
                F.col("occupied_market_rent") - F.coalesce(F.col("occupied_rent"), F.lit(0)), F.lit(0)
            ).alias("loss_to_lease"),
            F.coalesce(F.col("occupied_concessions"), F.lit(0)).alias("concessions"),
            _zero("ancillary_charges"), _zero("units_owing"), _zero("balance_owed"),
        )
    )
    scored = base.withColumns({
        "revenue_capture_pct": F.when(
            F.col("market_rent") > 0, percent(F.col("lease_charges"), F.col("market_rent"))
        ),
        "exclusion_reason": _exclusion(
            F.col("units"), F.col("market_rent"), F.col("charge_coverage"), coverage_th
        ),
    }).withColumn("plottable", F.col("exclusion_reason").isNull())
    short_charges = F.round(
        F.col("market_rent") * F.col("capture_threshold") / F.lit(100) - F.col("lease_charges"), 2
    )
    short_units = F.ceil(F.col("units") * F.col("occupancy_threshold") / F.lit(100)).cast("bigint") - F.col("occupied_units")
    return scored.withColumns({
        "quadrant": F.when(F.col("plottable"), quadrant(
            F.col("revenue_capture_pct"), F.col("pct_occupied"),
            F.col("capture_threshold"), F.col("occupancy_threshold"))),
        "charges_to_threshold": F.when(
            F.col("plottable"), F.greatest(F.lit(0).cast("decimal(3,2)"), short_charges)),
        "units_to_threshold": F.when(F.col("plottable"), F.greatest(F.lit(0), short_units)),
    })


def revenue_bridge(T: Tables, coverage_th: float = 0.5) -> DataFrame:
    """Gross potential rent down to billed charges, current section only."""
    detail = book_detail(T).select(
        *BOOK, F.col("units").alias("current_leases"), F.col("market_rent").alias("gross_potential_rent"),
        "vacancy_loss", "leases_with_charges",
    )
    charges = book_charges(T).select(
        *BOOK, "rent_charges", "subsidy", F.col("current_concessions").alias("concessions"),
        F.col("current_ancillary").alias("ancillary"), "billed_charges",
    )
    steps = ("rent_charges", "subsidy", "concessions", "ancillary", "billed_charges")
    base = (
        book_spine(T)
        .join(detail, BOOK, "left")
        .join(charges, BOOK, "left")
        .select(
            "snapshot_id", "property_id", "property_code", "property_name", "book_type", "asset_key",
            _zero("gross_potential_rent"), _zero("vacancy_loss"), _zero("current_leases"),
            *[_zero(c) for c in steps],
            ratio(F.col("leases_with_charges"), F.col("current_leases"), 3).alias("charge_coverage"),
        )
    )
    return base.select(
        "snapshot_id", "property_id", "property_code", "property_name", "book_type", "asset_key",
        "gross_potential_rent", "vacancy_loss",
        (F.col("gross_potential_rent") - F.col("vacancy_loss") - F.col("rent_charges")).alias("loss_to_lease"),
        *steps, "charge_coverage",
        _exclusion(F.col("current_leases"), F.col("gross_potential_rent"), F.col("charge_coverage"),
                   coverage_th).alias("exclusion_reason"),
    )


BRIDGE_STEPS = ("gross_potential_rent", "vacancy_loss", "loss_to_lease", "rent_charges", "subsidy",
                "concessions", "ancillary", "billed_charges")


def revenue_bridge_portfolio(bridge: DataFrame) -> DataFrame:
    """The bridge of every scored book together, per snapshot."""
    return (
        bridge.filter(F.col("exclusion_reason").isNull())
        .groupBy("snapshot_id")
        .agg(*[F.sum(c).alias(c) for c in BRIDGE_STEPS], F.count(F.lit(1)).alias("books"))
    )


def _rent_psf() -> Column:
    return F.round(F.col("market_rent") / F.col("unit_sqft").cast("decimal(10,0)"), 4)


# value ranges the medians are located in: a range holds at most 100,000 distinct values
_MEDIAN_RANGE = {"rent": 1000, "psf": 10}


def rent_peers(priced: DataFrame) -> DataFrame:
    """Peer count and the two observed medians of each (snapshot, property, unit type)."""
    group = ["snapshot_id", "property_id", "unit_type_code"]
    long = priced.select(
        *group,
        F.explode(F.array(
            F.struct(F.lit("rent").alias("measure"), F.col("market_rent").cast("decimal(18,4)").alias("value")),
            F.struct(F.lit("psf").alias("measure"), F.col("rent_psf").cast("decimal(18,4)").alias("value")),
        )).alias("m"),
    ).select(*group, "m.measure", "m.value")
    width = F.when(F.col("measure") == "rent", _MEDIAN_RANGE["rent"]).otherwise(_MEDIAN_RANGE["psf"])
    medians = grouped_median_disc(long, [*group, "measure"], "value", width)
    return medians.groupBy(*group).agg(
        F.max("n").alias("peer_units"),
        F.max(F.when(F.col("measure") == "rent", F.col("median"))).cast("decimal(12,2)").alias("median_market_rent"),
        F.max(F.when(F.col("measure") == "psf", F.col("median"))).alias("median_rent_psf"),
    )


def unit_rent_outlier(T: Tables, min_peers: int = 3) -> DataFrame:
    """Each occupied or notice unit against the median asking rent of its unit type in its book."""
    held = (F.col("section") == "current") & is_occupied(F.col("occupancy_status"))
    priced = T.lease.filter(
        held & F.col("unit_type_code").isNotNull() & (F.col("unit_sqft") > 0) & (F.col("market_rent") > 0)
    ).withColumn("rent_psf", _rent_psf())
    peers = rent_peers(priced).filter(F.col("peer_units") >= min_peers)
    # no lines at all is unknown; lines without a rent line is a rent of zero
    contract = F.when(F.col("charge_lines") > 0, F.coalesce(F.col("rent_amount"), F.lit(0)))
    above = F.col("market_rent") - F.col("median_market_rent")
    return (
        priced.join(lease_charge_rollup(T, held), list(T.lease_key), "left")
        .join(peers, ["snapshot_id", "property_id", "unit_type_code"])
        .join(T.property.select("property_id", "property_code"), "property_id")
        .select(
            "snapshot_id", "property_id", "property_code", "unit_id", "unit_code", "unit_type_code",
            "unit_sqft", "occupancy_status", "lease_expiration", "lease_id", "market_rent",
            contract.alias("contract_rent"), "rent_psf", "peer_units", "median_market_rent",
            "median_rent_psf", above.alias("market_vs_median"),
            percent(above, F.col("median_market_rent")).alias("pct_vs_median"),
            (contract - F.col("market_rent")).alias("contract_vs_market"),
        )
    )


def expiration_concentration(T: Tables, share_th: float = 0.15, min_dated: int = 50) -> DataFrame:
    """Which months carry too much of a book's renewal risk. The book's dated leases are the sum of
    its own ladder, so the leases are read once."""
    dated = F.sum("expiring_leases").over(Window.partitionBy(*BOOK))
    share = F.col("expiring_leases").cast("decimal(20,0)") / F.nullif(F.col("dated_leases"), F.lit(0)).cast("decimal(10,0)")
    allowed = F.floor(F.col("dated_leases") * _threshold(share_th)).cast("bigint")
    return (
        expiration_schedule(T)
        .withColumn("dated_leases", dated)
        .join(T.property.select("property_id", "property_code", "property_name"), "property_id")
        .select(
            *BOOK, "property_code", "property_name", "expiry_month", "expiring_leases",
            "charges_at_risk", "holdover_mtm", "dated_leases",
            _threshold(share_th).alias("concentration_threshold"),
            F.lit(min_dated).alias("min_dated_leases"),
            F.round(share, 4).alias("share_of_book"),
            ((F.col("dated_leases") >= min_dated) & (share >= _threshold(share_th))).alias("concentrated"),
            F.greatest(F.lit(0), F.col("expiring_leases") - allowed).alias("leases_to_shift"),
        )
    )


def metric_meta(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, S.METRICS, "metric string, label string, unit string, worse_when string")


def metric_values(profitability: DataFrame) -> DataFrame:
    """The seven rate metrics in long form, one row per scored metric of a book with units."""
    scored = F.col("plottable")
    values = {
        "pct_occupied": F.col("pct_occupied"),
        "revenue_capture_pct": F.when(scored, F.col("revenue_capture_pct")),
        "balance_per_unit": ratio(F.col("balance"), F.col("units"), 2),
        "concession_per_unit": F.when(scored, ratio(F.col("concessions"), F.col("units"), 2)),
        "loss_to_lease_per_unit": F.when(scored, ratio(F.col("loss_to_lease"), F.col("units"), 2)),
        "notice_rate": percent(F.col("notice_units"), F.col("units")),
        "vacancy_rate": percent(F.col("vacant_units"), F.col("units")),
    }
    keys = ["snapshot_id", "property_id", "property_code", "property_name", "units"]
    return (
        profitability.filter(F.col("units") > 0)
        .select(*keys, *[v.cast("decimal(22,2)").alias(n) for n, v in values.items()])
        .unpivot(keys, list(values), "metric", "value")
        .filter(F.col("value").isNotNull())
    )


def property_anomaly(
    profitability: DataFrame, z_th: float = 1.75, min_books: int = 3, medium_z: float = 2.0, high_z: float = 2.5
) -> DataFrame:
    """Each book's rate against the same rate across the portfolio, per snapshot.

    The peer statistics are an aggregate joined back, not a window: a snapshot's books are never
    gathered in one task."""
    spark = profitability.sparkSession
    # books times metrics, read for the peers and for the books: stored, so that the matrix is computed once
    values = cut(metric_values(profitability))
    x = F.col("value").cast("double")
    peers = values.groupBy("snapshot_id", "metric").agg(
        F.count(F.lit(1)).alias("peer_books"), F.sum("value").alias("_sum"), F.avg(x).alias("_mean"),
        F.stddev_samp(x).alias("_sd"),
    ).filter(F.col("peer_books") >= min_books)
    z = F.round((x - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), 2)
    size = F.abs(F.col("z"))
    return (
        values.join(peers, ["snapshot_id", "metric"])
        .withColumn("z", z)
        .filter(F.col("z").isNotNull() & (size >= z_th))
        .join(metric_meta(spark), "metric")
        .select(
            "snapshot_id", "property_id", "property_code", "property_name", "units", "metric", "label",
            "unit", "worse_when", "value", ratio(F.col("_sum"), F.col("peer_books"), 4).alias("peer_mean"),
            F.round("_sd", 4).alias("peer_sd"), "peer_books", "z",
            (((F.col("worse_when") == "low") & (F.col("z") < 0))
             | ((F.col("worse_when") == "high") & (F.col("z") > 0))).alias("adverse"),
            F.when(size >= high_z, "high").when(size >= medium_z, "medium").otherwise("low").alias("priority"),
        )
    )
