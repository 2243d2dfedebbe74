"""Registered queries: the load as a whole, run three times over the report grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaseloom.operators import marts as M
from leaseloom.operators import rules as V
from leaseloom.plans.catalog import Context, register
from leaseloom.plans.queries_ingest import _LOADED

#: Loaded snapshots are numbered by date, the driver's by year.


def _by_year(df: DataFrame) -> DataFrame:
    return df.withColumn("snapshot_id", F.floor(F.col("snapshot_id") / 10000).cast("int"))


def _loss(c: Context) -> DataFrame:
    T = c.loads[1].tables
    return _by_year(M.loss_to_lease(T).join(T.property.select("property_id", "property_code"), "property_id"))


register("e1_load_loss_to_lease", "snapshot_id:i property_code:s unit_code:s market_rent:d contract_rent:d concessions:d loss_to_lease:d", _loss,
         "SELECT t.snapshot_id, property_code, t.unit_code, t.market_rent, contract_rent, concessions, loss_to_lease"
         f" FROM ltl t JOIN (SELECT snapshot_id, unit_code FROM lease WHERE {_LOADED}) USING (snapshot_id, unit_code) JOIN prop USING (property_id)")
register("e1_load_kpi", "snapshot_id:i property_code:s units:i occupied_units:i vacant_units:i future_leases:i market_rent:d balance:d",
         lambda c: _by_year(c.loads[1].marts["property_snapshot_kpi"]),
         "SELECT snapshot_id, property_code, sum(CAST(section = 'current' AS INT)) AS units, sum(CAST(status IN ('occupied','notice') AS INT)) AS occupied_units,"
         " sum(CAST(status = 'vacant' AS INT)) AS vacant_units, sum(CAST(section = 'future' AS INT)) AS future_leases,"
         " sum(CASE WHEN section = 'current' THEN market_rent END) AS market_rent, sum(CASE WHEN section = 'current' THEN balance END) AS balance"
         f" FROM lease JOIN prop USING (property_id) WHERE {_LOADED} GROUP BY 1, 2")
register("e1_load_repeated_codes", "property_code:s blocks:i",
         lambda c: V.rule_duplicate_charge_code_in_block(c.loads[1].tables).select("property_code", F.col("detail")["blocks_with_repeats"].cast("bigint").alias("blocks")),
         "SELECT property_code, count(*) AS blocks FROM (SELECT lease_id, charge_code FROM line GROUP BY 1, 2 HAVING count(*) > 1)"
         f" JOIN (SELECT lease_id, property_id FROM lease WHERE {_LOADED}) USING (lease_id) JOIN prop USING (property_id) GROUP BY 1")
_FILES = ("SELECT CASE WHEN snapshot_id < 1998 THEN 1 ELSE 2 END AS run_id, 'rr' AS kind FROM snap CROSS JOIN prop"
          " UNION ALL SELECT CASE WHEN snapshot_id < 1998 THEN 1 ELSE 2 END, 'av' FROM snap CROSS JOIN prop")
register("e1_load_run", "run_id:i status:s files_loaded:i files_skipped:i files_failed:i", lambda c: c.loads[2].tables.run,
         f"WITH seen AS ({_FILES})\n---\nSELECT run_id, 'partial' AS status, count(*) AS files_loaded, 0 AS files_skipped, 0 AS files_failed FROM seen GROUP BY 1"
         " UNION ALL SELECT 3, 'succeeded', 0, count(*), 0 FROM seen")
register("e1_reload_skips", "dataset:s status:s n:i",
         lambda c: c.loads[2].tables.file.filter("run_id = 3").groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("n")),
         f"WITH seen AS ({_FILES})\n---\nSELECT CASE kind WHEN 'rr' THEN 'rent_roll' ELSE 'unit_availability' END AS dataset, 'skipped' AS status, count(*) AS n FROM seen GROUP BY 1")
#: What was loaded, the printed totals among it, and what each printed label stands for.
_LABELS = {"Current/Notice/Vacant Residents": "section = 'current'", "Future Residents/Applicants": "section = 'future'", "Occupied Units": "status IN ('occupied','notice')",
           "Total Vacant Units": "status = 'vacant'", "Total Non Rev Units": "status IN ('model','down')"}
_DETAIL = (
    f"WITH ll AS (SELECT *, charges_total + CASE WHEN lease_id % 211 = 0 THEN 0.01 ELSE 0 END AS billed FROM lease WHERE {_LOADED}),\n"
    "lline AS (SELECT line.* FROM line JOIN (SELECT lease_id FROM ll) USING (lease_id)),\n"
    "labelled AS (" + " UNION ALL ".join(
        f"SELECT snapshot_id, property_id, '{label}' AS group_label, count(*) AS units, sum(billed) AS charges FROM ll WHERE {what} GROUP BY 1, 2" for label, what in _LABELS.items()) + "),\n"
    "compared AS (SELECT g.snapshot_id, g.property_id, unit_count, lease_charges, coalesce(units, 0) AS units, coalesce(charges, 0) AS charges FROM printed_group g"
    " LEFT JOIN labelled l ON l.snapshot_id = g.snapshot_id AND l.property_id = g.property_id AND l.group_label = g.group_label WHERE g.group_label <> 'Totals:'),\n"
    "counted AS (SELECT a.snapshot_id, a.property_id, a.units, a.occupied_no_notice + a.notice_unrented AS held, coalesce(c.units, 0) AS loaded, coalesce(o.units, 0) AS loaded_held FROM avail a"
    " LEFT JOIN labelled c ON c.snapshot_id = a.snapshot_id AND c.property_id = a.property_id AND c.group_label = 'Current/Notice/Vacant Residents'"
    " LEFT JOIN labelled o ON o.snapshot_id = a.snapshot_id AND o.property_id = a.property_id AND o.group_label = 'Occupied Units'),\n"
    "runs AS (SELECT snapshot_id, CASE WHEN snapshot_id < 1998 THEN 1 ELSE 2 END AS run_id FROM snap),\n"
    "found AS (SELECT snapshot_id, 'error' AS severity, 'lease_row_coercion' AS rule FROM lease WHERE lease_id % 311 = 0"
    " UNION ALL SELECT snapshot_id, 'error', 'resident_id_format' FROM lease WHERE lease_id % 311 <> 0 AND lease_id % 307 = 0 AND status NOT IN ('vacant','model','down')"
    " UNION ALL SELECT snapshot_id, 'warning', 'sentinel_field_violation' FROM lease WHERE lease_id % 311 <> 0 AND status IN ('vacant','model','down')"
    " UNION ALL SELECT snapshot_id, 'error', 'block_total_mismatch' FROM ll WHERE lease_id % 211 = 0"
    " UNION ALL SELECT snapshot_id, 'error', 'charge_without_block' FROM snap CROSS JOIN prop WHERE (property_id + snapshot_id) % 5 = 0"
    " UNION ALL SELECT snapshot_id, 'info', 'availability_total_row_differs' FROM snap CROSS JOIN prop WHERE (property_id + snapshot_id) % 5 <> 0"
    " UNION ALL SELECT p.snapshot_id, 'error', 'charge_summary_vs_detail' FROM printed_code p LEFT JOIN (SELECT snapshot_id, property_id, charge_code, sum(amount) AS loaded FROM lline"
    " WHERE status IN ('occupied','notice') GROUP BY 1, 2, 3) d ON d.snapshot_id = p.snapshot_id AND d.property_id = p.property_id AND d.charge_code = p.charge_code"
    " WHERE abs(p.amount - coalesce(loaded, 0)) > 0.01"
    " UNION ALL SELECT snapshot_id, 'error', 'summary_group_units_vs_detail' FROM compared WHERE unit_count <> units"
    " UNION ALL SELECT snapshot_id, 'error', 'summary_group_charges_vs_detail' FROM compared WHERE abs(lease_charges - charges) > 0.01"
    " UNION ALL SELECT snapshot_id, 'warning', 'availability_units_vs_detail' FROM counted WHERE units <> loaded"
    " UNION ALL SELECT snapshot_id, 'info', 'availability_occupancy_split_vs_detail' FROM counted WHERE held <> loaded_held),\n"
    # these count a property once a load, whatever its snapshots
    "once AS (SELECT DISTINCT run_id, property_id, 'expired_lease_no_moveout' AS rule FROM ll JOIN snap USING (snapshot_id) JOIN runs USING (snapshot_id) WHERE status IN ('occupied','notice') AND lease_expiration < as_of_date"
    " UNION ALL SELECT DISTINCT run_id, property_id, 'moveout_before_asof' FROM ll JOIN snap USING (snapshot_id) JOIN runs USING (snapshot_id) WHERE move_out < as_of_date"
    " UNION ALL SELECT DISTINCT run_id, property_id, 'duplicate_charge_code_in_block' FROM (SELECT snapshot_id, property_id FROM lline GROUP BY snapshot_id, property_id, lease_id, charge_code HAVING count(*) > 1) JOIN runs USING (snapshot_id)"
    " UNION ALL SELECT run_id, property_id, 'zero_unit_property' FROM (SELECT DISTINCT run_id FROM runs) r CROSS JOIN prop WHERE NOT EXISTS"
    " (SELECT 1 FROM ll JOIN runs USING (snapshot_id) WHERE ll.property_id = prop.property_id AND runs.run_id = r.run_id))\n---\n")
register("e1_load_issues", "run_id:i severity:s rule:s n:i",
         lambda c: c.loads[2].tables.issue.groupBy("run_id", "severity", "rule").agg(F.count(F.lit(1)).alias("n")),
         _DETAIL + "SELECT run_id, severity, rule, count(*) AS n FROM found JOIN runs USING (snapshot_id) GROUP BY 1, 2, 3"
         " UNION ALL SELECT run_id, 'info', rule, count(*) FROM once GROUP BY 1, 2, 3")
