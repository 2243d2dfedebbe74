"""Registered queries: report grammar, dimension merges, scalar functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.functions import scalars as C
from leaseloom.operators import dimensions as Dm
from leaseloom.operators import grammar as G
from leaseloom.operators import marts as M
from leaseloom.operators import reads as R
from leaseloom.operators import rules as V
from leaseloom.plans.catalog import Context, register
from leaseloom.sources import grids, sinks
from leaseloom.sources.folders import shared_folder
from leaseloom.sources.versions import Store

# ---- report grammar ----------------------------------------------------------
# Two faults are printed into the grids: ids of every 307th lease and areas of every 311th.
_LOADED = "NOT (lease_id % 311 = 0) AND NOT (lease_id % 307 = 0 AND status NOT IN ('vacant','model','down'))"
_FILE = "'rr_' || file_id || '.xlsx'"
register("g1_report_header", "file_name:s property_code:s property_name:s as_of_date:t report_month:t", lambda c: c.parsed.headers,
         "SELECT 'rr_' || (snapshot_id * 100 + property_id) || '.xlsx' AS file_name, property_code, property_name, as_of_date, report_month FROM snap CROSS JOIN prop")
register("g2_mode_segments", "file_name:s groups:i codes:i",
         lambda c: G.mode_segments(c.rent_grid).filter(F.col("_mode").isNotNull() & F.col("_past") & ~F.col("_ends")).groupBy("file_name").agg(
             F.count_if(F.col("_mode") == "g").alias("groups"), F.count_if(F.col("_mode") == "c").alias("codes")),
         f"SELECT {_FILE} AS file_name, 6 AS groups, count(DISTINCT CASE WHEN l.status IN ('occupied','notice') THEN charge_code END) AS codes"
         " FROM lease l LEFT JOIN line USING (lease_id) GROUP BY file_id")
register("g3_section_carry", "file_name:s section:s heads:i",
         lambda c: c.rows.filter("cls = 'head'").groupBy("file_name", "section").agg(F.count(F.lit(1)).alias("heads")),
         f"SELECT {_FILE} AS file_name, section, count(*) AS heads FROM lease GROUP BY file_id, section")
_LEASE_OUT = ("file_name:s unit_code:s unit_type_code:s unit_sqft:i resident_id:s section:s occupancy_status:s market_rent:d balance:d "
              "move_in:t lease_expiration:t move_out:t charges_total:d charge_lines:i")
register("g4_lease_blocks", _LEASE_OUT, lambda c: c.parsed.leases,
         f"SELECT {_FILE} AS file_name, l.*, status AS occupancy_status, charges_total + CASE WHEN lease_id % 211 = 0 THEN 0.01 ELSE 0 END AS charges_total,"
         f" coalesce(n, 0) AS charge_lines FROM (SELECT * EXCLUDE (charges_total), charges_total AS ct FROM lease) x JOIN lease l USING (lease_id)"
         f" LEFT JOIN (SELECT lease_id, count(*) AS n FROM line GROUP BY 1) USING (lease_id) WHERE {_LOADED.replace('status', 'l.status')}"
         .replace("l.*, status", "l.* EXCLUDE (charges_total), l.status").replace("charges_total + CASE", "l.charges_total + CASE").replace("_id % 211", "_id % 211")
         .replace("'rr_' || file_id", "'rr_' || l.file_id"))
register("g5_charge_lines", "file_name:s unit_code:s line_no:i charge_code:s amount:d",
         lambda c: c.parsed.lines.drop("section", "occupancy_status").join(c.parsed.leases.select("file_name", F.col("sheet_row").alias("owner"), "unit_code"), ["file_name", "owner"]),
         f"SELECT 'rr_' || l.file_id || '.xlsx' AS file_name, unit_code, line_no, charge_code, amount FROM line JOIN lease l USING (lease_id) WHERE {_LOADED.replace('status', 'l.status')}")
register("g6_block_total_check", "file_name:s severity:s rule:s detail:s", lambda c: c.parsed.issues.filter("rule = 'block_total_mismatch'"),
         f"SELECT {_FILE} AS file_name, 'error' AS severity, 'block_total_mismatch' AS rule, '{{\"property_code\":\"' || property_code || '\",\"unit_code\":\"' || unit_code || '\",\"printed_total\":\"' ||"
         " CAST(charges_total + 0.01 AS DECIMAL(12,2)) || '\",\"sum_of_charges\":\"' || CAST(charges_total AS DECIMAL(12,2)) || '\"}' AS detail"
         f" FROM lease JOIN prop USING (property_id) WHERE lease_id % 211 = 0 AND {_LOADED}")
register("g7_summary_groups", "file_name:s group_label:s unit_count:i lease_charges:d", lambda c: G.summary_groups(c.rows),
         "SELECT 'rr_' || (snapshot_id * 100 + property_id) || '.xlsx' AS file_name, group_label, unit_count, lease_charges FROM printed_group")
register("g8_charge_summary_rows", "file_name:s charge_code:s amount:d", lambda c: G.charge_summary_rows(c.rows),
         "SELECT 'rr_' || (snapshot_id * 100 + property_id) || '.xlsx' AS file_name, charge_code, amount FROM printed_code")
register("g9_lease_row_filter", "file_name:s severity:s rule:s n:i",
         lambda c: G.lease_row_filter(c.rows)[1].groupBy("file_name", "severity", "rule").agg(F.count(F.lit(1)).alias("n")),
         f"SELECT {_FILE} AS file_name, severity, rule, count(*) AS n FROM (SELECT file_id, CASE WHEN lease_id % 311 = 0 THEN 'error' WHEN status IN ('vacant','model','down')"
         " THEN 'warning' ELSE 'error' END AS severity, CASE WHEN lease_id % 311 = 0 THEN 'lease_row_coercion' WHEN status IN ('vacant','model','down')"
         " THEN 'sentinel_field_violation' ELSE 'resident_id_format' END AS rule FROM lease"
         " WHERE lease_id % 311 = 0 OR lease_id % 307 = 0 OR status IN ('vacant','model','down')) GROUP BY file_id, severity, rule")
register("g10_orphan_charges", "file_name:s severity:s rule:s detail:s", lambda c: c.parsed.issues.filter("rule IN ('charge_without_block', 'charge_coercion', 'block_total_coercion')"),
         "SELECT 'rr_' || (snapshot_id * 100 + property_id) || '.xlsx' AS file_name, 'error' AS severity, 'charge_without_block' AS rule,"
         " '{\"property_code\":\"' || property_code || '\",\"charge_code\":\"TRASH\"}' AS detail FROM snap CROSS JOIN prop WHERE (property_id + snapshot_id) % 5 = 0")
register("g11_availability_row", "file_name:s property_code:s as_of_date:t units:i occupied_no_notice:i vacant_unrented:i notice_unrented:i available:i avg_rent:d avg_sqft:i pct_leased:d",
         lambda c: G.availability_row(c.availability_grid)[0],
         "SELECT 'av_' || (snapshot_id * 100 + property_id) || '.xlsx' AS file_name, property_code, as_of_date, a.* FROM avail a JOIN prop USING (property_id) JOIN snap USING (snapshot_id)")
register("g11_availability_issues", "file_name:s severity:s rule:s field:s",
         lambda c: G.availability_row(c.availability_grid)[1].withColumn("field", F.col("detail")["field"]),
         "SELECT 'av_' || (snapshot_id * 100 + property_id) || '.xlsx' AS file_name, 'info' AS severity, 'availability_total_row_differs' AS rule, 'pct_trend' AS field"
         " FROM snap CROSS JOIN prop WHERE (property_id + snapshot_id) % 5 <> 0")

# ---- dimension merges --------------------------------------------------------


def _heads(c: Context) -> DataFrame:
    """Lease rows as parsed rows: each order is printed in the file of its book."""
    return c.T.lease.withColumns({"file_name": F.col("file_id").cast("string"), "sheet_row": F.col("lease_id").cast("int")})


register("d1_merge_snapshot", "as_of_date:t report_month:t",
         lambda c: Dm.merge_snapshot(
             c.T.snapshot.filter("snapshot_id % 3 <> 0").select("as_of_date", F.when(F.col("snapshot_id") % 2 == 0, F.col("report_month")).alias("report_month")),
             c.T.lease.filter("snapshot_id % 2 = 1 OR snapshot_id % 3 = 0").select(
                 F.make_date("snapshot_id", F.lit(12), F.lit(31)).alias("as_of_date"),
                 # file order is the order of the lease ids; the second file in it has the month that counts
                 F.when((F.col("lease_id") % 2 == 0) & (F.col("snapshot_id") != 1998),
                        F.add_months(F.make_date("snapshot_id", F.lit(12), F.lit(1)), (F.col("lease_id") % 5).cast("int"))).alias("report_month"),
                 F.lpad("lease_id", 12, "0").alias("file_name"))),
         "SELECT as_of_date, coalesce(CASE WHEN (snapshot_id % 2 = 1 OR snapshot_id % 3 = 0) AND snapshot_id <> 1998 THEN f.month END,"
         " CASE WHEN snapshot_id % 3 <> 0 AND snapshot_id % 2 = 0 THEN report_month END) AS report_month FROM snap LEFT JOIN"
         " (SELECT snapshot_id, arg_min(CAST(make_date(snapshot_id, 12, 1) + to_months(CAST(lease_id % 5 AS INT)) AS DATE), lease_id) AS month"
         " FROM lease WHERE lease_id % 2 = 0 GROUP BY 1) f USING (snapshot_id)")
register("d2_merge_property", "property_code:s property_name:s asset_key:s book_type:s",
         lambda c: Dm.merge_property(
             c.T.property.filter("property_id % 2 = 0"),
             R._coded(c.T.lease, c.T).select(
                 F.when(F.col("lease_id") % 3 == 0, F.upper("property_code")).otherwise(F.col("property_code")).alias("property_code"),
                 F.concat(F.lit("seen "), F.col("lease_id")).alias("property_name"), (F.col("lease_id") % 2).alias("source_rank"),
                 F.lpad("lease_id", 12, "0").alias("file_name")).withColumn("property_code", F.lower("property_code"))),
         "SELECT p.* REPLACE (coalesce(n, property_name) AS property_name) FROM prop p LEFT JOIN (SELECT property_id, 'seen ' ||"
         " coalesce(max(lease_id) FILTER (WHERE lease_id % 2 = 1), max(lease_id)) AS n FROM lease GROUP BY 1) USING (property_id)"
         " WHERE n IS NOT NULL OR property_id % 2 = 0")
register("d3_merge_unit_type", "property_id:i unit_type_code:s",
         lambda c: Dm.merge_unit_type(c.T.unit_type.filter("property_id % 2 = 0"), c.T.lease), "SELECT DISTINCT property_id, unit_type_code FROM lease")


def _shared_units(c: Context) -> DataFrame:
    """Units seen again and again: a thousand unit codes per book, some rows without a type or area."""
    return _heads(c).withColumns({
        "unit_code": F.concat(F.lit("U"), F.col("lease_id") % 1000),
        "unit_type_code": F.when(F.col("lease_id") % 4 != 0, F.col("unit_type_code")),
        "unit_sqft": F.when(F.col("lease_id") % 5 != 0, F.col("unit_sqft")), "file_name": F.lpad("lease_id", 12, "0")})


register("d4_merge_unit", "property_id:i unit_code:s unit_type_code:s unit_sqft:i",
         lambda c: Dm.merge_unit(
             c.T.lease.filter("property_id % 2 = 0").select("property_id", F.concat(F.lit("U"), F.col("lease_id") % 1500).alias("unit_code"),
                                                            F.lit("OLD").alias("unit_type_code"), F.lit(1).alias("unit_sqft")).distinct(),
             _shared_units(c)),
         "WITH seen AS (SELECT property_id, 'U' || (lease_id % 1000) AS unit_code, arg_max(unit_type_code, lease_id) FILTER (WHERE lease_id % 4 <> 0) AS t,"
         " arg_max(unit_sqft, lease_id) FILTER (WHERE lease_id % 5 <> 0) AS s FROM lease GROUP BY 1, 2),\n"
         "known AS (SELECT DISTINCT property_id, 'U' || (lease_id % 1500) AS unit_code FROM lease WHERE property_id % 2 = 0)\n---\n"
         "SELECT coalesce(s.property_id, k.property_id) AS property_id, coalesce(s.unit_code, k.unit_code) AS unit_code, coalesce(s.t, CASE WHEN k.unit_code IS NOT NULL THEN 'OLD' END) AS unit_type_code,"
         " coalesce(s.s, CASE WHEN k.unit_code IS NOT NULL THEN 1 END) AS unit_sqft FROM seen s FULL JOIN known k ON k.property_id = s.property_id AND k.unit_code = s.unit_code")
register("d5_merge_resident", "resident_id:s display_name:s",
         lambda c: Dm.merge_resident(c.T.resident, _shared_units(c).select(
             F.concat(F.lit("t"), F.col("lease_id") % 1000).alias("resident_id"),
             F.when(F.col("lease_id") % 3 != 0, F.concat(F.lit("Name "), F.col("lease_id"))).alias("resident_name"), "file_name", "sheet_row")),
         "WITH seen AS (SELECT 't' || (lease_id % 1000) AS resident_id, max(lease_id) AS k FROM lease GROUP BY 1),\n"
         "known AS (SELECT resident_id, 'Resident ' || lease_id AS display_name FROM lease WHERE resident_id IS NOT NULL)\n---\n"
         "SELECT coalesce(s.resident_id, o.resident_id) AS resident_id, CASE WHEN s.k IS NULL THEN o.display_name WHEN s.k % 3 = 0 THEN s.resident_id"
         " ELSE 'Name ' || s.k END AS display_name FROM seen s FULL JOIN known o ON o.resident_id = s.resident_id")


def _odd_lines(c: Context) -> DataFrame:
    return c.T.lease_charge.withColumn(
        "charge_code", F.when(F.col("lease_id") % 50 == 0, F.concat(F.lit("CONX"), F.col("property_id"))).otherwise(F.col("charge_code")))


_ODD = "SELECT DISTINCT CASE WHEN lease_id % 50 = 0 THEN 'CONX' || property_id ELSE charge_code END AS charge_code FROM line"
register("d6_unknown_codes", "charge_code:s category:s description:s label_verified:b is_concession:b",
         lambda c: Dm.unknown_codes(_odd_lines(c), c.T.charge_summary, c.T.charge_code)[0],
         f"SELECT charge_code, category, description, label_verified, is_concession FROM code UNION ALL SELECT charge_code, 'other', NULL, false, true FROM ({_ODD})"
         " WHERE charge_code NOT IN (SELECT charge_code FROM code)")
register("d6_unknown_code_issues", "severity:s rule:s detail:s", lambda c: Dm.unknown_codes(_odd_lines(c), c.T.charge_summary, c.T.charge_code)[1],
         "SELECT 'warning' AS severity, 'unknown_charge_code' AS rule, '{\"charge_code\":\"' || charge_code || '\"}' AS detail"
         f" FROM ({_ODD}) WHERE charge_code NOT IN (SELECT charge_code FROM code)")
register("d7_resolve_keys", "unit_code:s section:s property_id:i snapshot_id:i",
         lambda c: Dm.resolve_keys(
             c.parsed.leases.join(c.parsed.headers.select("file_name", "property_code", "as_of_date"), "file_name"),
             [(c.T.property.select("property_code", "property_id"), ["property_code"]), (c.T.snapshot.select("as_of_date", "snapshot_id"), ["as_of_date"])]),
         f"SELECT unit_code, section, property_id, snapshot_id FROM lease WHERE {_LOADED}")
register("d8_upsert_rollups", "snapshot_id:i property_id:i charge_code:s amount:d",
         lambda c: Dm.upsert_rollups(
             c.T.lease_charge.select("snapshot_id", "property_id", "charge_code", "amount", F.lit("f").alias("file_name"), (F.col("lease_id") * 1000 + F.col("line_no")).alias("sheet_row")),
             ["snapshot_id", "property_id", "charge_code"]),
         "SELECT snapshot_id, property_id, charge_code, arg_max(amount, lease_id * 1000 + line_no) AS amount FROM line GROUP BY 1, 2, 3")
register("d9_upsert_availability", "snapshot_id:i property_id:i units:i",
         lambda c: Dm.upsert_availability(_heads(c).select(
             "snapshot_id", "property_id", F.lpad("lease_id", 12, "0").alias("file_name"), (F.col("lease_id") % 100).alias("units"))),
         "SELECT snapshot_id, property_id, max(lease_id) % 100 AS units FROM lease GROUP BY 1, 2")
_BROKEN = "violated:s n:i"


def _by_rule(df: DataFrame) -> DataFrame:
    return df.groupBy("violated").agg(F.count(F.lit(1)).alias("n"))


register("d10_row_constraints", _BROKEN,
         lambda c: _by_rule(V.violations(
             c.T.lease.withColumns({
                 "move_out": F.when(F.col("lease_id") % 13 == 0, F.date_sub("move_in", 1)).otherwise(F.col("move_out")),
                 "resident_id": F.when(F.col("lease_id") % 17 == 0, F.lit(None)).when(F.col("lease_id") % 29 == 0, F.lit("x-1")).otherwise(F.col("resident_id")),
                 "unit_sqft": F.col("unit_sqft") - 460}), V.lease_constraints())),
         "WITH bent AS (SELECT status, unit_sqft - 460 AS area, CASE WHEN lease_id % 13 = 0 THEN move_in - 1 ELSE move_out END AS mo, move_in,"
         " CASE WHEN lease_id % 17 = 0 THEN NULL WHEN lease_id % 29 = 0 THEN 'x-1' ELSE resident_id END AS res FROM lease)\n---\n"
         "SELECT violated, count(*) AS n FROM (SELECT 'lease_resident_presence' AS violated FROM bent WHERE (status IN ('vacant','model','down')) = (res IS NOT NULL)"
         " UNION ALL SELECT 'lease_notice_implies_moveout' FROM bent WHERE status = 'notice' AND mo IS NULL"
         " UNION ALL SELECT 'lease_date_order' FROM bent WHERE mo < move_in UNION ALL SELECT 'lease_sqft_non_negative' FROM bent WHERE area < 0"
         " UNION ALL SELECT 'resident_id_fmt' FROM bent WHERE res = 'x-1') GROUP BY 1")
register("d10_duplicate_keys", "snapshot_id:i property_id:i unit_type_code:s move_in:t n:i",
         lambda c: V.duplicate_keys(c.T.lease, ["snapshot_id", "property_id", "unit_type_code", "move_in"]),
         "SELECT snapshot_id, property_id, unit_type_code, move_in, count(*) AS n FROM lease GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")

register("d10_unit_key", "snapshot_id:i property_id:i unit_code:s section:s n:i",
         lambda c: V.duplicate_keys(
             c.T.lease.withColumn("unit_code", F.concat(F.lit("U"), F.col("lease_id") % 499)), ["snapshot_id", "property_id", "unit_code", "section"]),
         "SELECT snapshot_id, property_id, 'U' || (lease_id % 499) AS unit_code, section, count(*) AS n FROM lease GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
register("d10_availability_constraints", _BROKEN,
         lambda c: _by_rule(V.violations(c.T.availability.withColumn("units", F.col("units") - 20), V.availability_constraints())),
         "SELECT 'availability_units_non_negative' AS violated, count(*) AS n FROM avail WHERE units < 20 HAVING count(*) > 0")

# ---- scalar functions over whole tables --------------------------------------


def _cents(c: Context) -> DataFrame:
    """Every line item's price as cents, and how it is going to be printed."""
    return c.raw("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), (F.col("l_partkey") % 7).alias("style"))


def _plain():
    cents = F.col("cents")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _printed():
    plain, s = _plain(), F.col("style")
    comma = F.format_number(F.col("cents").cast("decimal(20,0)") / 100, 2)
    return (F.when(s == 0, plain).when(s == 1, F.concat(F.lit(" $"), comma)).when(s == 2, F.concat(F.lit("("), comma, F.lit(")")))
            .when(s == 3, F.concat(plain, F.lit("%"))).when(s == 4, "  ").when(s == 5, F.concat(F.lit("n/a "), plain)).otherwise(F.concat(F.lit("-"), plain)))


_CENTS = "(SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_partkey % 7 AS style FROM lineitem)"
register("c1_as_text", "c_custkey:i value:s",
         lambda c: c.raw("customer").select("c_custkey", C.as_text(
             F.when(F.col("c_custkey") % 5 == 0, "  \t ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("\t ")))).alias("value")),
         "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS value FROM customer")
register("c2_as_decimal", "style:i l_linenumber:i n:i errors:i total:d low:d high:d",
         lambda c: _cents(c).withColumn("v", C.as_decimal(_printed())).groupBy("style", "l_linenumber").agg(
             F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("errors"), F.sum(F.col("v").cast("decimal(18,2)")).alias("total"),
             F.min("v").alias("low"), F.max("v").alias("high")),
         "SELECT style, l_linenumber, count(*) AS n, count(*) FILTER (WHERE style = 5) AS errors, sum(v) / 100.0 AS total, min(v) / 100.0 AS low, max(v) / 100.0 AS high"
         f" FROM (SELECT *, CASE style WHEN 2 THEN -cents WHEN 6 THEN -cents WHEN 4 THEN 0 WHEN 5 THEN NULL ELSE cents END AS v FROM {_CENTS}) GROUP BY 1, 2")
register("c3_as_date", "o_orderkey:i value:t error:b",
         lambda c: c.raw("orders").withColumn("t", F.expr(
             "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd')"
             " WHEN 2 THEN date_format(o_orderdate, 'MM/dd/yy') WHEN 3 THEN date_format(o_orderdate, 'dd MMMM') ELSE ' ' END")).select(
             "o_orderkey", C.as_date(F.col("t")).alias("value"), C.as_date_error(F.col("t")).alias("error")),
         "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS value, o_orderkey % 5 = 3 AS error FROM orders")
register("c4_as_int", "style:i n:i whole:i errors:i total:i",
         lambda c: _cents(c).withColumn("t", F.when(F.col("style") == 4, F.concat(F.format_number(F.floor(F.col("cents") / 100), 0), F.lit(".00"))).otherwise(_plain()))
         .groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count(C.as_int(F.col("t"))).alias("whole"), F.count_if(C.as_int_error(F.col("t"))).alias("errors"),
                               F.sum(C.as_int(F.col("t"))).alias("total")),
         "SELECT style, count(*) AS n, count(v) AS whole, count(*) - count(v) AS errors, sum(v) AS total FROM (SELECT style,"
         f" CASE WHEN style = 4 OR cents % 100 = 0 THEN cents // 100 END AS v FROM {_CENTS}) GROUP BY 1")
register("c5_derive_status", "lease_id:i status:s",
         lambda c: c.T.lease.select("lease_id", C.derive_status(
             F.col("section"), F.when(F.col("occupancy_status").isin("vacant", "model", "down"), F.upper("occupancy_status")), F.col("move_out")).alias("status")),
         "SELECT lease_id, status FROM lease")
register("c6_derive_asset_key", "asset_key:s n:i",
         lambda c: R._coded(c.T.lease, c.T).groupBy(C.derive_asset_key(
             F.when(F.col("lease_id") % 2 == 0, F.col("property_code")).otherwise(F.concat(F.lit("alt"), F.col("property_code")))).alias("asset_key")).agg(F.count(F.lit(1)).alias("n")),
         "SELECT CASE WHEN lease_id % 2 = 0 THEN asset_key ELSE 'alt' || property_code END AS asset_key, count(*) AS n FROM lease JOIN prop USING (property_id) GROUP BY 1")
register("c7_derive_book_type", "book_type:s n:i",
         lambda c: R._coded(c.T.lease, c.T).groupBy(C.derive_book_type(F.upper("property_code")).alias("book_type")).agg(F.count(F.lit(1)).alias("n")),
         "SELECT book_type, count(*) AS n FROM lease JOIN prop USING (property_id) GROUP BY 1")
register("c8_is_concession", "is_concession:b n:i amount:d",
         lambda c: c.T.lease_charge.groupBy(C.is_concession(F.col("charge_code")).alias("is_concession")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")),
         "SELECT charge_code LIKE 'CON%' AS is_concession, count(*) AS n, sum(amount) AS amount FROM line GROUP BY 1")
register("c9_quadrant", "snapshot_id:i property_code:s quadrant:s",
         lambda c: c.matrix.select("snapshot_id", "property_code", C.quadrant(
             F.col("revenue_capture_pct"), F.col("pct_occupied"), F.lit(90), F.lit(92)).alias("quadrant")),
         "SELECT snapshot_id, property_code, CASE WHEN revenue_capture_pct IS NULL OR pct_occupied IS NULL THEN NULL WHEN revenue_capture_pct >= 90 THEN"
         " CASE WHEN pct_occupied >= 92 THEN 'performing' ELSE 'vacancy_led' END WHEN pct_occupied >= 92 THEN 'leaking' ELSE 'distressed' END AS quadrant FROM matrix")
_TRIMMED = ("CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) WHEN cents % 10 = 0 THEN (cents // 100) || '.' || (cents % 100) // 10"
            " ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END")
register("c10_normalise_figure", "l_orderkey:i l_linenumber:i style:i value:s",
         lambda c: _cents(c).select("l_orderkey", "l_linenumber", "style", C.normalise_figure(_printed()).alias("value")),
         f"SELECT l_orderkey, l_linenumber, style, CASE style WHEN 2 THEN '-' || t WHEN 6 THEN '-' || t WHEN 4 THEN '' WHEN 5 THEN 'n/a ' || (cents // 100) || '.' ||"
         f" lpad(CAST(cents % 100 AS VARCHAR), 2, '0') ELSE t END AS value FROM (SELECT *, {_TRIMMED} AS t FROM {_CENTS})")
register("c11_like_escape", "page_id:i",
         lambda c: c.raw("pages").filter(C.contains_term(F.col("html"), "_A") | C.contains_term(F.col("html"), "X%%%") | C.contains_term(F.col("html"), "\\")).select("page_id"),
         "SELECT page_id FROM pages WHERE contains(lower(html), '_a') OR contains(lower(html), 'x%%%') OR contains(html, '\\')")
register("c12_trigram_similarity", "p_partkey:i similarity:d",
         lambda c: c.raw("part").select("p_partkey", C.trigram_similarity(F.concat_ws(" ", "p_name", "p_type"), F.lit("Red widget, economy")).alias("similarity")),
         """WITH grams AS (SELECT p_partkey, list_distinct(flatten(list_transform(
              list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: w <> ''),
              lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM part),
probe AS (SELECT list_distinct(flatten(list_transform(['red', 'widget', 'economy'],
              lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS t)
---
SELECT p_partkey, len(list_intersect(g, t)) / len(list_distinct(list_concat(g, t))) AS similarity FROM grams, probe""")
register("c13_estimate_tokens", "source:s tokens:i low:i",
         lambda c: c.raw("documents").groupBy("source").agg(F.sum(C.estimate_tokens(F.col("text"))).alias("tokens"), F.min(C.estimate_tokens(F.col("text"))).alias("low")),
         "SELECT source, sum(greatest(1, length(text) // 4)) AS tokens, min(greatest(1, length(text) // 4)) AS low FROM documents GROUP BY 1")
_JSON_COLUMNS = ["property_code", "units", "pct_occupied", "market_rent", "as_of_date"]
_JSON_SQL = ("'{\"as_of_date\":\"' || as_of_date || '\"' || coalesce(',\"market_rent\":\"' || CAST(market_rent AS DECIMAL(22,2)) || '\"', '') ||"
             " coalesce(',\"pct_occupied\":\"' || CAST(pct_occupied AS DECIMAL(10,2)) || '\"', '') || ',\"property_code\":\"' || property_code || '\",\"units\":' || units || '}'")
register("c14_canonical_json", "snapshot_id:i property_id:i json:s sha256:s",
         lambda c: c.matrix.select("snapshot_id", "property_id", C.canonical_json(c.matrix, _JSON_COLUMNS).alias("json"), C.payload_sha256(c.matrix, _JSON_COLUMNS).alias("sha256")),
         f"SELECT snapshot_id, property_id, {_JSON_SQL} AS json, sha256({_JSON_SQL}) AS sha256 FROM matrix")
register("c15_priority_rank", "rank:i n:i",
         lambda c: c.raw("orders").groupBy(C.priority_rank(F.lower(F.regexp_extract("o_orderpriority", r"^\d-(\w+)", 1))).alias("rank")).agg(F.count(F.lit(1)).alias("n")),
         "SELECT CASE WHEN o_orderpriority LIKE '%HIGH' THEN 0 WHEN o_orderpriority LIKE '%MEDIUM' THEN 1 ELSE 2 END AS rank, count(*) AS n FROM orders GROUP BY 1")
register("c16_fmt_money", "lease_id:i text:s", lambda c: c.T.lease.select("lease_id", C.fmt_money(F.col("balance") - F.lit(1000)).alias("text")),
         "SELECT lease_id, '$' || format('{:,.2f}', CAST(balance - 1000 AS DOUBLE)) AS text FROM lease")
register("c17_builtins", "snapshot_id:i low_half:i up:i down:i floor_zero:d month:t changed:i",
         lambda c: c.T.lease.groupBy("snapshot_id").agg(
             F.sum(F.round(F.col("unit_sqft") / F.lit(4), 0).cast("bigint")).alias("low_half"), F.sum(F.ceil("market_rent")).alias("up"), F.sum(F.floor("balance")).alias("down"),
             F.sum(F.greatest(F.lit(0), F.col("balance"))).alias("floor_zero"), F.max(F.trunc("lease_expiration", "MM")).alias("month"),
             F.count_if(~F.col("lease_expiration").eqNullSafe(F.col("move_out"))).alias("changed")),
         "SELECT snapshot_id, sum(CAST(round(unit_sqft / 4) AS BIGINT)) AS low_half, sum(ceil(market_rent)) AS up, sum(floor(balance)) AS down,"
         " sum(greatest(0, balance)) AS floor_zero, max(CAST(date_trunc('month', lease_expiration) AS DATE)) AS month,"
         " count(*) FILTER (WHERE lease_expiration IS DISTINCT FROM move_out) AS changed FROM lease GROUP BY 1")

# ---- sources and sinks -------------------------------------------------------


def _tables_on_disk(c: Context) -> DataFrame:
    return grids.file_inventory(c.spark, {"tables": c.sf_dir}, "*.parquet")


register("s1_file_inventory", "dataset:s file_name:s sha256:s byte_size:i", _tables_on_disk)
register("s2_skip_unchanged", "dataset:s file_name:s sha256:s",
         lambda c: grids.skip_unchanged(_tables_on_disk(c), _tables_on_disk(c).filter(F.col("file_name").startswith("n")).select("dataset", "file_name", "sha256")))


def _grid_files(c: Context) -> DataFrame:
    return grids.grid_inventory(c.rent_grid, "rent_roll").unionByName(grids.grid_inventory(c.availability_grid, "unit_availability"))


def _some_known(c: Context) -> DataFrame:
    """Files up to 1997 were loaded before, every third of them with other content."""
    files = _grid_files(c).withColumn("_n", F.regexp_extract("file_name", r"_(\d+)", 1).cast("int"))
    return files.filter("_n < 199800").withColumn("sha256", F.when(F.col("_n") % 3 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))).drop("_n")


_GRID_FILES = "(SELECT snapshot_id * 100 + property_id AS n FROM snap CROSS JOIN prop) CROSS JOIN (VALUES ('rent_roll', 'rr_'), ('unit_availability', 'av_')) AS k(dataset, head)"
register("s1_grid_inventory", "dataset:s file_name:s same_content:i",
         lambda c: _grid_files(c).withColumn("same_content", F.count("sha256").over(Window.partitionBy("sha256"))),
         f"SELECT dataset, head || n || '.xlsx' AS file_name, 1 AS same_content FROM {_GRID_FILES}")
register("s2_skip_unchanged_grids", "dataset:s file_name:s", lambda c: grids.skip_unchanged(_grid_files(c), _some_known(c)),
         f"SELECT dataset, head || n || '.xlsx' AS file_name FROM {_GRID_FILES} WHERE n >= 199800 OR n % 3 = 0")
register("s3_grid_source", "file_name:s rows:i last_row:i",
         lambda c: c.rent_grid.groupBy("file_name").agg(F.count(F.lit(1)).alias("rows"), F.max("sheet_row").alias("last_row")),
         "SELECT 'rr_' || (s.snapshot_id * 100 + p.property_id) || '.xlsx' AS file_name, 24 + coalesce(b.rows, 0) + coalesce(k.n, 0) + CASE WHEN b.rows IS NULL THEN -6 ELSE 0 END AS rows,"
         " 24 + coalesce(b.rows, 0) + coalesce(k.n, 0) AS last_row FROM snap s CROSS JOIN prop p"
         " LEFT JOIN (SELECT snapshot_id, property_id, sum(greatest(coalesce(n, 0), 1) + 1) AS rows FROM lease LEFT JOIN (SELECT lease_id, count(*) AS n FROM line GROUP BY 1) USING (lease_id)"
         "   GROUP BY 1, 2) b ON b.snapshot_id = s.snapshot_id AND b.property_id = p.property_id"
         " LEFT JOIN (SELECT snapshot_id, property_id, count(*) AS n FROM printed_code GROUP BY 1, 2) k ON k.snapshot_id = s.snapshot_id AND k.property_id = p.property_id")


def _exported(c: Context, dataset: str, schema: str) -> DataFrame:
    out = shared_folder(c.spark)
    sinks.write_csv(R.export_dataset(c.T, dataset), out)
    return c.spark.read.schema(schema).option("header", True).csv(out)


def _export_sizes(c: Context) -> DataFrame:
    """Rows of every dataset of the export registry."""
    T = c.T
    sizes = [R.export_dataset(T, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("dataset"), "n") for d in R.EXPORTS]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


register("s4_csv_export", "snapshot_id:i property_code:s category:s charge_code:s line_count:i amount:d",
         lambda c: _exported(c, "charge_mix", "snapshot_id int, property_code string, category string, charge_code string, line_count bigint, amount decimal(22,2)"),
         "SELECT * FROM mix JOIN prop USING (property_id)")
register("s4_csv_export_datasets", "dataset:s n:i", _export_sizes,
         " UNION ALL ".join(f"SELECT '{d}' AS dataset, count(*) AS n FROM {t}" for d, t in {
             "properties": "(SELECT 1 FROM snap CROSS JOIN prop)", "assets": "asset", "units": "lease", "charge_mix": "mix", "expirations": "ladder", "matrix": "matrix",
             "revenue_bridge": "bridge", "outliers": "outlier", "concentration": "conc", "anomalies": "anomaly", "reconciliation": "recon", "issues": "issue",
             "charge_codes": "code"}.items()))


def _replaced(c: Context) -> DataFrame:
    """Load every book, then reload every third book with its even leases only."""
    store, kept = Store(c.spark, shared_folder(c.spark)), ("snapshot_id", "property_id", "lease_id", "market_rent")
    days = [r.snapshot_id for r in c.T.snapshot.select("snapshot_id").collect()]
    store.replace("lease", c.T.lease.select(*kept), days)
    store.commit()
    reloaded = c.T.lease.filter("property_id % 3 = 0")
    store.replace("lease", reloaded.filter("lease_id % 2 = 0").select(*kept), days, reloaded.select("snapshot_id", "property_id").distinct())
    store.commit()
    return Store(c.spark, store.path).read("lease")


register("s7_replace_scope", "snapshot_id:i property_id:i lease_id:i market_rent:d", _replaced,
         "SELECT * FROM lease l WHERE property_id % 3 <> 0 OR lease_id % 2 = 0")


def _written(c: Context) -> DataFrame:
    out = shared_folder(c.spark)
    sinks.bulk_write(c.T.lease_charge.select("lease_id", "snapshot_id", "charge_code", "amount"), out, ("snapshot_id",))
    return c.spark.read.schema("lease_id bigint, charge_code string, amount decimal(12,2), snapshot_id int").parquet(out)


register("s9_bulk_write", "snapshot_id:i charge_code:s n:i amount:d",
         lambda c: _written(c).groupBy("snapshot_id", "charge_code").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")),
         "SELECT snapshot_id, charge_code, count(*) AS n, sum(amount) AS amount FROM line GROUP BY 1, 2")
register("s10_charge_code_seed", "charge_code:s category:s description:s label_verified:b",
         lambda c: sinks.charge_code_seed(c.spark, c.T.lease_charge.select("charge_code").distinct().select(
             "charge_code", F.lit("fee").alias("category"), F.lit("kept").alias("description"), F.lit(False).alias("label_verified"), C.is_concession(F.col("charge_code")).alias("is_concession"))),
         "SELECT charge_code, CASE WHEN charge_code IN (SELECT charge_code FROM line) THEN 'fee' ELSE category END AS category, CASE WHEN charge_code IN (SELECT charge_code FROM line)"
         " THEN 'kept' ELSE description END AS description, label_verified AND charge_code NOT IN (SELECT charge_code FROM line) AS label_verified FROM code")


def _materialised(c: Context) -> DataFrame:
    """Write the stored marts in dependency order, then read the asset rollup off the stored KPIs."""
    paths = sinks.materialise_marts({
        "property_snapshot_kpi": lambda: c.kpi, "charge_mix": lambda: M.charge_mix(c.T), "expiration_schedule": lambda: M.expiration_schedule(c.T),
    }, shared_folder(c.spark))
    return M.asset_snapshot_kpi(c.spark.read.parquet(paths["property_snapshot_kpi"]))


register("s11_materialise_marts", "snapshot_id:i as_of_date:t asset_key:s asset_label:s book_count:i property_codes:s units:i occupied_units:i pct_occupied:d market_rent:d lease_charges:d balance:d",
         _materialised, "SELECT * FROM asset")
