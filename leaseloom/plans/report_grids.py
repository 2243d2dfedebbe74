"""Prints core frames in the report layouts, as cell grids. Test plumbing for the grammar: every lease
and line of the core frames becomes sheet rows, with a few faults printed on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.operators.grammar import cells
from leaseloom.operators.rollups import BOOK, book_spine
from leaseloom.operators.scan import two_level_row_number
from leaseloom.tables import Tables


def _name(prefix: str) -> Column:
    return F.concat(F.lit(prefix), (F.col("snapshot_id") * 100 + F.col("property_id")).cast("string"), F.lit(".xlsx"))


def _day(c: str) -> Column:
    return F.date_format(c, "MM/dd/yyyy")


def _comma(c: str) -> Column:
    text = F.format_number(F.abs(c), 2)
    return F.when(F.col(c) < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def _row(n: int, at: Column, **cols: Column | str) -> Column:
    given = {k: (F.lit(v) if isinstance(v, str) else v).cast("string") for k, v in cols.items()}
    return F.struct(at.cast("int").alias("sheet_row"), *[
        given.get(c, F.lit(None).cast("string")).alias(c) for c in cells(n)])


def _literal_row(n: int, at: int, values: tuple[str, ...]) -> Column:
    return _row(n, F.lit(at), **{c: v for c, v in zip(cells(n), values) if v})


def _rows(df: DataFrame, prefix: str, *rows: Column) -> DataFrame:
    return df.select(_name(prefix).alias("file_name"), F.explode(F.array(*rows)).alias("r")).select("file_name", "r.*")


def rent_roll_grid(T: Tables) -> DataFrame:
    lines = T.lease_charge
    n, pre = S.RENT_ROLL_COLUMNS, "rr_"
    block = F.greatest(F.col("charge_lines"), F.lit(1)) + 1
    future = F.col("section") == "future"
    placed = two_level_row_number(
        T.lease.join(T.resident, "resident_id", "left"), BOOK,
        {"_s": F.when(future, 1).otherwise(0), "_b": F.floor(F.col("lease_id") / 4096)}, [F.col("lease_id")], "_offset", weight=block,
    ).withColumn("head_row", F.when(future, 10).otherwise(8) + F.col("_offset"))
    sentinel = F.upper("occupancy_status")
    key = F.col("lease_id")
    resident = (
        F.when(F.col("occupancy_status").isin("vacant", "model", "down"), sentinel)
        .when(key % 307 == 0, F.concat(F.lit("r-"), key)).otherwise(F.col("resident_id")))
    area = F.when(key % 311 == 0, "n/a").otherwise(F.col("unit_sqft").cast("string"))
    first = lines.filter("line_no = 1").select("lease_id", F.col("charge_code").alias("_code"), F.col("amount").alias("_amount"))
    printed = F.col("charges_total") + F.when(key % 211 == 0, 0.01).otherwise(0).cast("decimal(3,2)")
    heads = _rows(
        placed.join(first, "lease_id", "left"), pre,
        _row(n, F.col("head_row"), c01=F.col("unit_code"), c02=F.col("unit_type_code"), c03=area, c04=resident, c05=F.col("display_name"),
             c06=F.col("market_rent"), c07=F.col("_code"), c08=F.col("_amount"), c09=F.col("resident_deposit"), c10=F.col("other_deposit"),
             c11=_day("move_in"), c12=_day("lease_expiration"), c13=_day("move_out"), c14=F.col("balance")),
        _row(n, F.col("head_row") + block - 1, c07="Total", c08=printed))
    more = _rows(
        lines.filter("line_no > 1").select("lease_id", "line_no", "charge_code", "amount").join(placed.select("lease_id", *BOOK, "head_row"), "lease_id"), pre,
        _row(n, F.col("head_row") + F.col("line_no") - 1, c07=F.col("charge_code"), c08=F.col("amount")))
    sizes = T.lease.groupBy(*BOOK).agg(
        F.sum(F.when(~future, block)).alias("_c"), F.sum(F.when(future, block)).alias("_f"))
    books = book_spine(T).join(sizes, BOOK, "left").withColumns({
        "_c": F.coalesce("_c", F.lit(0)), "_f": F.coalesce("_f", F.lit(0))}).withColumn("_end", F.col("_c") + F.col("_f"))
    stray = (F.col("property_id") + F.col("snapshot_id")) % 5 == 0
    end = F.col("_end")
    frame = _rows(
        books.join(T.snapshot.select("snapshot_id", "report_month"), "snapshot_id"), pre,
        _row(n, F.lit(1), c01=S.RENT_ROLL_TITLE),
        _row(n, F.lit(2), c01=F.concat("property_name", F.lit(" ("), "property_code", F.lit(")"))),
        _row(n, F.lit(3), c01=F.concat(F.lit("As Of = "), _day("as_of_date"))),
        _row(n, F.lit(4), c01=F.concat(F.lit("Month Year = "), F.date_format("report_month", "MM/yyyy"))),
        _literal_row(n, 5, S.RENT_ROLL_HEADER_1), _literal_row(n, 6, S.RENT_ROLL_HEADER_2),
        _row(n, F.lit(7), c01=S.CURRENT_LABEL),
        _row(n, F.col("_c") + 8, c04="Total"),
        _row(n, F.col("_c") + 9, c01=S.FUTURE_LABEL),
        _row(n, end + 10, c04="Total"),
        _row(n, end + 11, c07=F.when(stray, "TRASH"), c08=F.when(stray, "1.00")),
        _row(n, end + 12, c01="Summary Groups"),
        _row(n, end + 13, c06="Square", c07="Market"),
        _row(n, end + 20),
        _row(n, end + 21, c01="Summary of Charges by Charge Code"),
        _row(n, end + 22, c01="(Current/Notice Residents)"),
        _row(n, end + 23, c01="Charge Code", c04="Amount"))
    order = F.array(*[F.lit(x) for x in S.SUMMARY_GROUP_LABELS])
    ends = books.select(*BOOK, "_end")
    groups = _rows(
        T.summary_group.join(ends, BOOK), pre,
        _row(n, end + 13 + F.array_position(order, F.col("group_label")), c01=F.col("group_label"), c07=_comma("market_rent"),
             c08=_comma("lease_charges"), c09=_comma("security_deposit"), c10=_comma("other_deposits"), c11=F.col("unit_count"), c14=_comma("balance")))

    ranked = T.charge_summary.withColumn("_i", F.row_number().over(Window.partitionBy(*BOOK).orderBy("charge_code")))
    codes = _rows(ranked.join(ends, BOOK), pre, _row(n, end + 23 + F.col("_i"), c01=F.col("charge_code"), c04=_comma("amount")))
    last = ranked.groupBy(*BOOK).agg(F.max("_i").alias("_i"))
    closing = _rows(ends.join(last, BOOK, "left"), pre, _row(n, end + 24 + F.coalesce("_i", F.lit(0)), c01="Total"))
    out = heads
    for part in (more, frame, groups, codes, closing):
        out = out.unionByName(part)
    return out


def availability_grid(T: Tables) -> DataFrame:
    n, pre = S.AVAILABILITY_COLUMNS, "av_"
    names = dict(zip(cells(n), S.AVAILABILITY_FIELDS))
    books = T.availability.join(T.property, "property_id").join(T.snapshot.select("snapshot_id", "as_of_date"), "snapshot_id")
    data = {c: F.col(f) for c, f in names.items()}
    total = {**data, "c01": F.lit(None), "c02": F.lit("Total"), "c18": F.lit("100.0000")}
    return _rows(
        books, pre,
        _row(n, F.lit(1), c01=S.AVAILABILITY_TITLE),
        _row(n, F.lit(2), c01=F.concat("property_name", F.lit(" ("), "property_code", F.lit(")"))),
        _row(n, F.lit(3), c01=F.concat(F.lit("As Of = "), _day("as_of_date"))),
        _literal_row(n, 4, S.AVAILABILITY_HEADER_1), _literal_row(n, 5, S.AVAILABILITY_HEADER_2),
        _row(n, F.lit(6), **data), _row(n, F.lit(7), **total))
