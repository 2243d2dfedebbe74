"""Maps the driver's order tables onto the lease model, so every operator runs on whole tables.

Test plumbing only: the operators never see these table names. Orders become leases (nation is the
book, order year the snapshot, order the unit), line items become charge lines; a few printed
rollups are made to disagree with the detail on purpose.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leaseloom import schemas as S
from leaseloom.functions.scalars import (
    derive_asset_key, derive_book_type, is_occupied, percent,
)
from leaseloom.operators.rollups import (
    BOOK, book_code_charges, book_detail, book_spine,
)
from leaseloom.operators.scan import cut, two_level_row_number
from leaseloom.sources.folders import shared_folder
from leaseloom.sources.sinks import bulk_write, charge_code_seed, side_by_side
from leaseloom.tables import Tables

EMPTY_BOOK = 24
_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "pages": "page_id long, url string, html string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast(S.MONEY)


def divides(c: Column, n: int) -> Column:
    return c % n == 0


def property_frame(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    suffix = (
        F.when(k == EMPTY_BOOK, "land").when(k % 4 == 1, "a").when(k % 8 == 3, "c").when(k % 8 == 7, "m").otherwise("r")
    )
    coded = nation.select(
        k.alias("property_id"),
        F.concat((F.lit(100) + k - k % 2).cast("string"), suffix).alias("property_code"),
        F.col("n_name").alias("property_name"),
    )
    return coded.withColumns({
        "asset_key": derive_asset_key(F.col("property_code")),
        "book_type": derive_book_type(F.col("property_code")),
    })


def lease_heads(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One row per lease, before its charges."""
    key, nation = F.col("o_orderkey"), F.col("c_nationkey")
    day = F.col("o_orderdate").cast("date")
    status = (
        F.when(divides(key, 41), "future")
        .when(key % (10 + 5 * (nation % 5)) == 0, "vacant")
        .when(divides(key, 89), "model")
        .when(divides(key, 101), "down")
        .when(divides(key, 23), "notice")
        .otherwise("occupied")
    )
    rent = F.when(nation % 8 == 3, F.lit(0).cast(S.MONEY)).otherwise(money(F.col("o_totalprice")))
    expiration = (
        F.when(divides(key, 19), F.lit(None).cast("date"))
        .when(nation % 4 == 1, F.date_add(F.date_sub(F.trunc(day, "MM"), 1), (200 + 60 * (key % 3)).cast("int")))
        .otherwise(F.date_add(day, (300 + key % 120).cast("int")))
    )
    held = F.col("occupancy_status").isin("occupied", "notice", "future")
    return (
        orders.join(customer.filter(nation != EMPTY_BOOK), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.alias("lease_id"), F.year(day).alias("snapshot_id"), nation.alias("property_id"),
            key.alias("unit_id"), F.concat(F.lit("U"), key).alias("unit_code"),
            F.col("c_mktsegment").alias("unit_type_code"),
            F.when(divides(key, 41), "future").otherwise("current").alias("section"),
            status.alias("occupancy_status"),
            F.when(divides(key, 97), 0).otherwise(450 + (key * 37) % 900).cast("int").alias("unit_sqft"),
            rent.alias("market_rent"),
            money(F.lit(500)).alias("resident_deposit"), money(F.lit(0)).alias("other_deposit"),
            F.when(divides(key, 6), money(F.col("c_acctbal"))).otherwise(money(F.lit(0))).alias("balance"),
            day.alias("move_in"), expiration.alias("lease_expiration"),
            F.when(status == "notice", F.date_add(day, (30 + key % 400).cast("int"))).alias("move_out"),
            (F.year(day) * 100 + nation).alias("file_id"),
        )
        .withColumn("resident_id", F.when(held, F.concat(F.lit("t"), F.col("lease_id"))))
    )


def _bills(status: Column, property_id: Column) -> Column:
    return ~status.isin("vacant", "model", "down") & (property_id % 7 != 6)


def _rent_line(rent: Column) -> Column:
    return rent > 700


def lease_frame(heads: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Leases with their printed charge total and number of charge lines."""
    first = F.col("l_linenumber") == 1
    signed = F.when(F.col("l_linenumber") == 4, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    # dealt by order before they are added up: combining first holds a task's whole share of the orders in memory
    per_order = lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("lease_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(~first, money(signed))).alias("_rest"),
        F.sum(F.when(first, money(F.col("l_quantity")))).alias("_first_qty"),
        F.sum(F.when(first, money(F.col("l_extendedprice")))).alias("_first_price"),
    )
    bills = _bills(F.col("occupancy_status"), F.col("property_id"))
    has_rent = bills & _rent_line(F.col("market_rent"))
    zero = F.lit(0).cast(S.MONEY)
    rent = F.when(has_rent, F.col("market_rent") - 100 * (F.col("lease_id") % 7)).otherwise(zero)
    opening = F.when(F.col("property_id") % 3 == 0, F.col("_first_price")).otherwise(F.col("_first_qty"))
    total = F.when(bills, rent + F.coalesce(opening, zero) + F.coalesce(F.col("_rest"), zero)).otherwise(zero)
    lines = F.when(bills, F.when(has_rent, 1).otherwise(0) + F.coalesce(F.col("_n"), F.lit(0))).otherwise(0)
    return heads.join(per_order, "lease_id", "left").select(
        *heads.columns, money(total).alias("charges_total"), lines.cast("int").alias("charge_lines")
    )


_LINE_CODES = {1: "PARKING", 2: "PETFEEM", 3: "TRASH", 4: "CONRENT", 5: "RENTHAP", 6: "AMENITY", 7: "W/D"}


def charge_frame(heads: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Charge lines with the columns that order them in their block."""
    state = ["lease_id", "snapshot_id", "property_id", "section", "occupancy_status"]
    billed = heads.filter(_bills(F.col("occupancy_status"), F.col("property_id")))
    rent = billed.filter(_rent_line(F.col("market_rent"))).select(
        *state, F.lit("RENT").alias("charge_code"),
        money(F.col("market_rent") - 100 * (F.col("lease_id") % 7)).alias("amount"),
        F.lit(0).alias("slot"), F.lit(0).cast("long").alias("partkey"), F.lit(0).cast("long").alias("suppkey"),
        F.lit(0.0).alias("quantity"), F.lit(0.0).alias("price"),
    )
    n = F.col("l_linenumber")
    code = F.create_map(*[F.lit(x) for pair in _LINE_CODES.items() for x in pair])[n]
    amount = (
        F.when((n == 1) & (F.col("property_id") % 3 == 0), F.col("l_extendedprice"))
        .when(n == 4, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    )
    other = lineitem.join(billed.select(*state), F.col("l_orderkey") == F.col("lease_id")).select(
        *state, code.alias("charge_code"), money(amount).alias("amount"), n.alias("slot"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )
    return rent.unionByName(other)


_LINE_ORDER = ["slot", "partkey", "suppkey", "quantity", "price"]


def numbered_charges(lines: DataFrame, long: DataFrame) -> DataFrame:
    """`line_no` as printed, lease by lease; the leases in `long` (lease_id) one (slot, part range) at a time, so that a lease of very many
    lines is split. A line without lease, slot or part is not printed."""
    order = [F.col(c) for c in _LINE_ORDER]
    placed = lines.dropna(subset=["lease_id", "slot", "partkey"])
    by_lease = lambda df: df.withColumn("line_no", F.row_number().over(Window.partitionBy("lease_id").orderBy(*order)).cast("bigint"))
    long = cut(long)
    if long.isEmpty():
        return by_lease(placed).drop(*_LINE_ORDER)
    split = two_level_row_number(
        placed.join(long, "lease_id", "left_semi"), ["lease_id"], {"_slot": F.col("slot"), "_part": F.floor(F.col("partkey") / 4096)}, order, "line_no")
    return by_lease(placed.join(long, "lease_id", "left_anti")).unionByName(split).drop(*_LINE_ORDER)


def snapshot_frame(orders: DataFrame) -> DataFrame:
    year = F.year("o_orderdate")
    return orders.select(year.alias("snapshot_id")).distinct().select(
        "snapshot_id",
        F.make_date("snapshot_id", F.lit(12), F.lit(31)).alias("as_of_date"),
        F.make_date("snapshot_id", F.lit(12), F.lit(1)).alias("report_month"),
    )


def availability_frame(T: Tables) -> DataFrame:
    """The availability report; every eleventh book overstates its units, every thirteenth its notices."""
    plant = F.col("property_id") + F.col("snapshot_id")
    held = F.col("_has_leases")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in (
        "units", "occupied_units", "notice_units", "vacant_units", "non_revenue_units")}
    zero = F.lit(0).cast("bigint")
    detail = book_detail(T).select(*BOOK, *n, F.lit(True).alias("_has_leases"), "market_rent", "square_feet")
    pct = percent(n["occupied_units"], n["units"]).cast(S.PERCENT)
    none = F.lit(0).cast(S.PERCENT)
    return book_spine(T).select(*BOOK).join(detail, BOOK, "left").select(
        *BOOK,
        F.coalesce(F.round(F.col("square_feet") / F.nullif(F.col("units"), F.lit(0)), 0).cast("int"), F.lit(0)).alias("avg_sqft"),
        F.coalesce(money(F.col("market_rent") / F.nullif(F.col("units"), F.lit(0))), money(F.lit(0))).alias("avg_rent"),
        (n["units"] + F.when(held & divides(plant, 11), 1).otherwise(0)).alias("units"),
        (n["occupied_units"] - n["notice_units"]).alias("occupied_no_notice"),
        zero.alias("vacant_rented"), n["vacant_units"].alias("vacant_unrented"),
        zero.alias("notice_rented"),
        (n["notice_units"] + F.when(held & divides(plant, 13), 1).otherwise(0)).alias("notice_unrented"),
        (n["vacant_units"] + n["notice_units"]).alias("available"),
        n["non_revenue_units"].alias("model"), zero.alias("down"), zero.alias("admin"),
        F.coalesce(pct, none).alias("pct_occ"), F.coalesce(pct, none).alias("pct_occ_w_nonrev"),
        F.coalesce(pct, none).alias("pct_leased"),
        F.when(divides(plant, 5), F.lit(100)).otherwise(F.lit(0)).cast(S.PERCENT).alias("pct_trend"),
        (F.col("snapshot_id") * 100 + F.col("property_id") + 50).alias("file_id"),
    )


def summary_group_frame(T: Tables) -> DataFrame:
    """The printed summary groups; some unit counts and some charge totals are off."""
    plant = F.col("property_id") + F.col("snapshot_id")

    def row(label: str, count: Column, charges: Column, rent: Column) -> Column:
        return F.struct(F.lit(label).alias("group_label"), count.cast("bigint").alias("unit_count"),
                        F.coalesce(charges, F.lit(0)).cast(S.TOTAL).alias("lease_charges"),
                        F.coalesce(rent, F.lit(0)).cast(S.TOTAL).alias("market_rent"))

    off_charge = F.when(divides(plant, 19), F.lit(0.5)).otherwise(F.lit(0)).cast("decimal(3,2)")
    zero = F.lit(0)
    groups = F.array(
        row(S.CURRENT_LABEL, F.col("units"), F.coalesce(F.col("lease_charges"), zero) + off_charge, F.col("market_rent")),
        row(S.FUTURE_LABEL, F.col("future_leases"), F.col("future_charges"), zero),
        row("Occupied Units", F.col("occupied_units") + F.when(divides(plant, 17), 1).otherwise(0),
            F.col("occupied_charges"), F.col("occupied_market_rent")),
        row("Total Non Rev Units", F.col("non_revenue_units"), F.col("non_revenue_charges"), zero),
        row("Total Vacant Units", F.col("vacant_units"), F.col("vacant_charges"), F.col("vacancy_loss")),
        row("Totals:", F.col("units") + F.col("future_leases"),
            F.coalesce(F.col("lease_charges"), zero) + F.coalesce(F.col("future_charges"), zero), F.col("market_rent")),
    )
    return (
        book_detail(T)
        .select(*BOOK, F.explode(groups).alias("g"), (F.col("snapshot_id") * 100 + F.col("property_id")).alias("file_id"))
        .select(
            *BOOK, "g.group_label", F.lit(None).cast(S.TOTAL).alias("square_footage"), "g.market_rent",
            "g.lease_charges", F.lit(0).cast(S.TOTAL).alias("security_deposit"),
            F.lit(0).cast(S.TOTAL).alias("other_deposits"), F.col("g.unit_count").cast("int").alias("unit_count"),
            F.lit(None).cast(S.PERCENT).alias("pct_unit_occupancy"), F.lit(None).cast(S.PERCENT).alias("pct_sqft_occupied"),
            F.lit(0).cast(S.TOTAL).alias("balance"), "file_id",
        )
    )


def charge_summary_frame(T: Tables) -> DataFrame:
    """The printed charge summary over occupied and notice leases; some TRASH rows are off by one."""
    plant = F.col("property_id") + F.col("snapshot_id")
    off = F.when((F.col("charge_code") == "TRASH") & divides(plant, 7), 1).otherwise(0)
    return (
        book_code_charges(T).filter(is_occupied(F.col("occupancy_status")))
        .groupBy(*BOOK, "charge_code").agg(F.sum("amount").alias("amount"))
        .select(*BOOK, "charge_code", (F.col("amount") + off).cast(S.TOTAL).alias("amount"),
                (F.col("snapshot_id") * 100 + F.col("property_id")).alias("file_id"))
    )


def file_frame(T: Tables) -> DataFrame:
    """One rent-roll file per book with leases; two runs loaded them."""
    return T.lease.select(*BOOK, "file_id").distinct().select(
        "file_id", F.when(F.col("snapshot_id") <= 1997, 1).otherwise(2).cast("bigint").alias("run_id"),
        F.lit("rent_roll").alias("dataset"), F.concat(F.lit("rr_"), "file_id", F.lit(".xlsx")).alias("file_name"),
        F.sha2(F.col("file_id").cast("string"), 256).alias("sha256"),
    )


def issue_frame(T: Tables) -> DataFrame:
    """Row-level findings of the two loads."""
    found = (
        F.when((F.col("occupancy_status") == "vacant") & (F.col("balance") != 0),
               F.struct(F.lit("warning").alias("severity"), F.lit("sentinel_field_violation").alias("rule")))
        .when(F.col("unit_sqft") == 0,
              F.struct(F.lit("error").alias("severity"), F.lit("lease_row_coercion").alias("rule")))
        .when((F.col("occupancy_status") == "notice") & (F.col("lease_id") % 2 == 0),
              F.struct(F.lit("info").alias("severity"), F.lit("moveout_before_asof").alias("rule")))
    )
    return (
        T.lease.withColumn("_f", found).filter(F.col("_f").isNotNull())
        .select(
            F.col("lease_id").alias("issue_id"),
            F.when(F.col("snapshot_id") <= 1997, 1).otherwise(2).cast("bigint").alias("run_id"),
            F.col("file_id"), "_f.severity", "_f.rule", F.lit(None).cast("int").alias("sheet_row"),
            F.create_map(F.lit("unit_code"), F.col("unit_code")).alias("detail"),
        )
    )


def run_frame(T: Tables) -> DataFrame:
    """The ledger rows of those loads, counted from what they loaded."""
    return (
        T.lease.groupBy(F.when(F.col("snapshot_id") <= 1997, 1).otherwise(2).cast("bigint").alias("run_id"))
        .agg(F.count(F.lit(1)).alias("rows_loaded"), F.countDistinct("file_id").alias("files_loaded"),
             F.min("move_in").cast("timestamp").alias("started_at"), F.max("move_in").cast("timestamp").alias("finished_at"))
        .withColumns({"status": F.lit("partial"), "files_skipped": F.lit(0).cast("bigint"),
                      "files_failed": F.lit(0).cast("bigint"), "tool_version": F.lit("1")})
    )


def insight_frame(spark: SparkSession, matrix: DataFrame) -> DataFrame:
    """Written findings about each scored book; some cite a wrong figure, some a wrong target."""
    n = F.col("property_id") + F.col("snapshot_id")
    occ = F.col("pct_occupied").cast("string")
    wrong = divides(n, 5)
    scope = F.when(divides(n, 6), "asset").when(divides(n, 17), "portfolio").otherwise("property")
    code = F.col("property_code")
    evidence = F.array(
        F.struct(F.lit("pct_occupied").alias("metric"), F.concat(occ, F.lit("%")).alias("value"), F.lit(None).cast("string").alias("comparison")),
        F.struct(F.lit("units").alias("metric"),
                 F.when(wrong, F.concat(F.col("units").cast("string"), F.lit(".125"))).otherwise(F.col("units").cast("string")).alias("value"),
                 F.lit("this book").alias("comparison")),
    )
    return matrix.filter(F.col("plottable")).select(
        (F.col("snapshot_id") * 100 + F.col("property_id")).cast("bigint").alias("insight_id"),
        "snapshot_id", scope.alias("scope"),
        F.when(divides(n, 6), F.lit(None)).when(divides(n, 23), F.lit("999x"))
        .when(divides(n, 4), F.upper(code)).otherwise(code).alias("property_code"),
        F.when(divides(n, 6), code).when(divides(n, 3), F.col("asset_key")).alias("asset_key"),
        F.when(divides(n, 2), "positioning").otherwise("occupancy").alias("category"),
        F.when(divides(n, 3), "high").when(divides(n, 2), "medium").otherwise("low").alias("priority"),
        F.concat(F.lit("Occupancy of "), code, F.lit(" at "), occ).alias("headline"),
        F.concat(F.lit("The book holds "), F.col("units").cast("string"), F.lit(" units.")).alias("detail"),
        evidence.alias("evidence"), F.lit("writer").alias("model"),
        F.sha2(F.col("snapshot_id").cast("string"), 256).alias("prompt_sha256"),
        F.col("as_of_date").cast("timestamp").alias("generated_at"),
    )


def derived_facts(spark: SparkSession, sf_dir: str) -> Tables:
    """Leases straight from the driver's tables, with the dimensions they need."""
    customer, orders, lineitem = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    return Tables(
        snapshot=snapshot_frame(orders), property=property_frame(read(spark, sf_dir, "nation")),
        charge_code=charge_code_seed(spark), lease=lease_frame(lease_heads(orders, customer), lineitem),
    )


#: Leases of more lines are numbered in parts.
LONG_LEASE = 1 << 17
_STORED = ("snapshot", "lease")
_STORED_ROLLUPS = ("summary_group", "charge_summary", "availability", "issue", "file")


def core_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The loaded star schema: facts and printed rollups stored by snapshot in the shared folder, as a
    load leaves them for the marts to read."""
    root = shared_folder(spark)

    def store(T: Tables, names: tuple[str, ...]) -> Tables:
        def one(name: str) -> DataFrame:
            df = getattr(T, name)
            parts = ("snapshot_id",) if name != "snapshot" and "snapshot_id" in df.columns else ()
            bulk_write(df, f"{root}/{name}", parts)
            columns = [f for f in df.schema if f.name not in parts] + [df.schema[p] for p in parts]
            return spark.read.schema(StructType(columns)).parquet(f"{root}/{name}")

        return T.with_frames(**side_by_side({name: partial(one, name) for name in names}))

    T = store(derived_facts(spark, sf_dir), _STORED)
    # the lines take their lease's book and state from the stored leases
    long = T.lease.filter(F.col("charge_lines") > LONG_LEASE).select("lease_id").distinct()
    T = store(T.with_frames(lease_charge=numbered_charges(charge_frame(T.lease, read(spark, sf_dir, "lineitem")), long)), ("lease_charge",))
    T = T.with_frames(
        unit=T.lease.select("property_id", "unit_code", "unit_type_code", "unit_sqft"),
        unit_type=T.lease.select("property_id", "unit_type_code").distinct(),
        resident=T.lease.filter(F.col("resident_id").isNotNull()).select(
            "resident_id", F.concat(F.lit("Resident "), F.col("lease_id")).alias("display_name")),
    )
    T = T.with_frames(availability=availability_frame(T), summary_group=summary_group_frame(T),
                      charge_summary=charge_summary_frame(T), file=file_frame(T), issue=issue_frame(T))
    T = store(T, _STORED_ROLLUPS)
    return T.with_frames(run=run_frame(T))
