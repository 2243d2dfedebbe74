"""Registered queries: marts, reconciliation rules, reads, ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaseloom.operators import ledger as L
from leaseloom.operators import marts as M
from leaseloom.operators import reads as R
from leaseloom.operators import rules as V
from leaseloom.operators.scan import cut
from leaseloom.operators.similar import nearest_names, postings
from leaseloom.plans import driver_tables as D
from leaseloom.plans.catalog import Context, register
from leaseloom.plans.reviews import apply_review
from leaseloom.sources.bucketed import co_located
from leaseloom.sources.folders import shared_folder

_KPI = ("units:i occupied_units:i notice_units:i vacant_units:i non_revenue_units:i future_leases:i "
        "pct_occupied:d market_rent:d lease_charges:d square_feet:i balance:d")
_BOOK = "snapshot_id:i property_id:i"
_NAMES = "property_code:s property_name:s book_type:s asset_key:s"


# ---- marts -------------------------------------------------------------------
register("m1_property_snapshot_kpi", f"{_BOOK} as_of_date:t {_NAMES} {_KPI} deposits:d", lambda c: c.kpi, "SELECT * FROM kpi")
register("m2_charge_mix", f"{_BOOK} category:s charge_code:s line_count:i amount:d", lambda c: M.charge_mix(c.T), "SELECT * FROM mix")
_LADDER = "expiry_month:t expiring_leases:i charges_at_risk:d holdover_mtm:i"
register("m3_expiration_schedule", f"{_BOOK} {_LADDER}", lambda c: M.expiration_schedule(c.T), "SELECT * FROM ladder")
register("m4_loss_to_lease", f"{_BOOK} unit_code:s unit_type_code:s market_rent:d contract_rent:d concessions:d loss_to_lease:d",
         lambda c: M.loss_to_lease(c.T), "SELECT * FROM ltl")
_RECON = ("property_code:s detail_units:i availability_units:i unit_delta:i detail_occupied:i availability_occupied:i "
          "detail_charges:d report_charges:d charge_delta:d")
register("m5_reconciliation", f"snapshot_id:i {_RECON}", lambda c: M.reconciliation(c.T, c.kpi), "SELECT * FROM recon")
_ASSET = "asset_key:s asset_label:s book_count:i property_codes:s units:i occupied_units:i vacant_units:i"
register("m6_asset_snapshot_kpi",
         f"snapshot_id:i as_of_date:t {_ASSET} non_revenue_units:i pct_occupied:d market_rent:d lease_charges:d square_feet:i balance:d",
         lambda c: M.asset_snapshot_kpi(c.kpi), "SELECT * FROM asset")
_TREND = ("property_code:s property_name:s prior_as_of:t current_as_of:t pct_occupied:d d_pct_occupied:d market_rent:d d_market_rent:d "
          "lease_charges:d d_lease_charges:d balance:d d_balance:d notice_units:i d_notice_units:i")
register("m7_property_trend", f"property_id:i {_TREND}", lambda c: M.property_trend(c.kpi), "SELECT * FROM trend")
register("m8_charge_coverage", f"{_BOOK} current_leases:i leases_with_charges:i charge_coverage:d", lambda c: M.charge_coverage(c.T),
         "SELECT *, round(leases_with_charges / nullif(current_leases, 0), 3) AS charge_coverage FROM cover")
register("m9_delinquency", f"{_BOOK} units_owing:i balance_owed:d", lambda c: M.delinquency(c.T), "SELECT * FROM owing")
register("m10_ancillary", f"{_BOOK} ancillary_charges:d", lambda c: M.ancillary(M.charge_mix(c.T)), "SELECT * FROM anc")
_MATRIX = (f"{_NAMES} units:i occupied_units:i notice_units:i vacant_units:i pct_occupied:d market_rent:d lease_charges:d "
           "revenue_capture_pct:d quadrant:s plottable:b exclusion_reason:s charge_coverage:d charges_to_threshold:d "
           "units_to_threshold:i loss_to_lease:d concessions:d ancillary_charges:d units_owing:i balance_owed:d")
_THRESHOLDS = "capture_threshold:d occupancy_threshold:d"
register("m11_property_profitability", f"{_BOOK} as_of_date:t {_MATRIX} non_revenue_units:i square_feet:i balance:d {_THRESHOLDS}",
         lambda c: c.matrix, "SELECT * FROM matrix")
_STEPS = "gross_potential_rent:d vacancy_loss:d loss_to_lease:d rent_charges:d subsidy:d concessions:d ancillary:d billed_charges:d"
register("m12_revenue_bridge", f"{_BOOK} {_NAMES} {_STEPS} charge_coverage:d exclusion_reason:s", lambda c: M.revenue_bridge(c.T),
         "SELECT * FROM bridge")
register("m13_revenue_bridge_portfolio", f"snapshot_id:i {_STEPS} books:i",
         lambda c: M.revenue_bridge_portfolio(M.revenue_bridge(c.T)),
         "SELECT snapshot_id, " + ", ".join(f"sum({s.split(':')[0]}) AS {s.split(':')[0]}" for s in _STEPS.split())
         + ", count(*) AS books FROM bridge WHERE exclusion_reason IS NULL GROUP BY 1")
_OUTLIER = ("property_code:s unit_code:s unit_type_code:s unit_sqft:i occupancy_status:s lease_expiration:t lease_id:i market_rent:d "
            "contract_rent:d rent_psf:d peer_units:i median_market_rent:d median_rent_psf:d market_vs_median:d pct_vs_median:d contract_vs_market:d")
_OUTLIER_SQL = "SELECT *, status AS occupancy_status FROM outlier"
register("m14_unit_rent_outlier", f"{_BOOK} unit_id:i {_OUTLIER}", lambda c: M.unit_rent_outlier(c.T), _OUTLIER_SQL)
_CONC = f"property_code:s property_name:s {_LADDER} dated_leases:i share_of_book:d leases_to_shift:i concentration_threshold:d min_dated_leases:i"
register("m15_expiration_concentration", f"{_BOOK} {_CONC} concentrated:b", lambda c: M.expiration_concentration(c.T), "SELECT * FROM conc")
_ANOMALY = ("property_code:s property_name:s units:i metric:s label:s unit:s worse_when:s value:d peer_mean:d peer_sd:d peer_books:i "
            "z:d adverse:b priority:s")
register("m16_property_anomaly", f"{_BOOK} {_ANOMALY}", lambda c: M.property_anomaly(c.matrix), "SELECT * FROM anomaly")
register("m17_metric_meta", "metric:s label:s unit:s worse_when:s books:i",
         lambda c: M.metric_values(c.matrix).groupBy("metric").agg(F.count(F.lit(1)).alias("books")).join(M.metric_meta(c.spark), "metric"),
         "SELECT metric, label, unit, worse_when, count(value) AS books FROM metric JOIN meta USING (metric) GROUP BY ALL")

# ---- reconciliation rules ----------------------------------------------------
for _i, _rule in enumerate(V.RULES, start=1):
    register(f"v{_i}_{_rule}", "severity:s rule:s snapshot_id:i property_code:s detail:s",
             lambda c, f=V.RULES[_rule]: f(c.T), f"SELECT * FROM finding WHERE rule = '{_rule}'")
register("v10_issue_log", "severity:s rule:s n:i",
         lambda c: V.rule_counts(V.issue_log(c.T.issue, *[f(c.T) for f in V.RULES.values()])),
         "SELECT severity, rule, count(*) AS n FROM (SELECT severity, rule FROM finding UNION ALL SELECT severity, rule FROM issue) GROUP BY ALL")

# ---- reads -------------------------------------------------------------------
register("r1_latest_snapshot", "snapshot_id:i as_of_date:t", lambda c: R.latest_snapshot(c.T),
         "SELECT * FROM snap WHERE as_of_date = (SELECT max(as_of_date) FROM snap)")
register("r1_snapshot_list", "snapshot_id:i as_of_date:t report_month:t", lambda c: R.snapshot_list(c.T), "SELECT * FROM snap")
_SUMS = [c.split(":")[0] for c in _KPI.split() if not c.startswith("pct")]
register("r2_portfolio_totals", f"snapshot_id:i {_KPI} properties:i property_count:i", lambda c: R.portfolio_totals(c.T),
         "SELECT s.snapshot_id, " + ", ".join(f"sum(k.{x}) AS {x}" for x in _SUMS)
         + ", round(100.0 * sum(k.occupied_units) / nullif(sum(k.units), 0), 2) AS pct_occupied, count(*) AS properties, count(k.property_id) AS property_count"
         " FROM snap s CROSS JOIN prop p LEFT JOIN kpi k ON k.snapshot_id = s.snapshot_id AND k.property_id = p.property_id GROUP BY 1")
_ZEROED = ", ".join(f"coalesce(k.{x}, 0) AS {x}" for x in _SUMS)
_BOOKS_SQL = (f"SELECT s.snapshot_id, p.*, {_ZEROED}, k.pct_occupied, a.units AS availability_units, a.available, a.pct_leased, a.avg_rent, a.avg_sqft"
              " FROM snap s CROSS JOIN prop p LEFT JOIN kpi k ON k.snapshot_id = s.snapshot_id AND k.property_id = p.property_id"
              " LEFT JOIN avail a ON a.snapshot_id = s.snapshot_id AND a.property_id = p.property_id")
register("r3_property_table", f"snapshot_id:i {_NAMES} {_KPI} available:i pct_leased:d", lambda c: R.property_table(c.T), _BOOKS_SQL)
register("r4_asset_table", f"snapshot_id:i {_ASSET} pct_occupied:d market_rent:d lease_charges:d balance:d", lambda c: R.asset_table(c.T),
         "SELECT * FROM asset")
register("r5_portfolio_expirations", f"snapshot_id:i {_LADDER}", lambda c: R.portfolio_expirations(c.T),
         "SELECT snapshot_id, expiry_month, sum(expiring_leases) AS expiring_leases, sum(charges_at_risk) AS charges_at_risk,"
         " sum(holdover_mtm) AS holdover_mtm FROM ladder GROUP BY 1, 2")
register("r6_portfolio_charge_mix", "snapshot_id:i category:s line_count:i amount:d", lambda c: R.portfolio_charge_mix(c.T),
         "SELECT snapshot_id, category, sum(line_count) AS line_count, sum(amount) AS amount FROM mix GROUP BY 1, 2")
register("r7_status_mix", "snapshot_id:i status:s n:i", lambda c: R.status_mix(c.T),
         "SELECT snapshot_id, status, count(*) AS n FROM lease GROUP BY 1, 2")
register("r8_matrix_view", f"snapshot_id:i {_MATRIX} {_THRESHOLDS}", lambda c: R.matrix_view(c.T), "SELECT * FROM matrix")
register("r8_matrix_excluded", f"snapshot_id:i {_MATRIX} {_THRESHOLDS}", lambda c: R.matrix_view(c.T, plottable=False),
         "SELECT * FROM matrix WHERE NOT plottable")
register("r9_outlier_view", f"snapshot_id:i {_OUTLIER}", lambda c: R.outlier_view(c.T), _OUTLIER_SQL)
register("r10_concentration_view", f"snapshot_id:i {_CONC}", lambda c: R.concentration_view(c.T), "SELECT * FROM conc WHERE concentrated")
register("r11_property_kpi", f"{_BOOK} {_NAMES} {_KPI} availability_units:i available:i pct_leased:d avg_rent:d avg_sqft:i",
         lambda c: R.property_kpi(c.T), _BOOKS_SQL)
register("r12_unit_type_mix", "snapshot_id:i property_code:s unit_type_code:s units:i avg_market_rent:d avg_sqft:d occupied:i",
         lambda c: R.unit_type_mix(c.T),
         "SELECT snapshot_id, property_code, unit_type_code, count(*) AS units,"
         " (2 * CAST(sum(market_rent) * 100 AS BIGINT) + count(*)) // (2 * count(*)) / 100.0 AS avg_market_rent,"
         " round(sum(unit_sqft) / count(*), 0) AS avg_sqft, count(*) FILTER (WHERE status IN ('occupied','notice')) AS occupied"
         " FROM units_of WHERE section = 'current' GROUP BY 1, 2, 3")
register("r13_property_loss_to_lease", "snapshot_id:i property_code:s units:i market_rent:d contract_rent:d concessions:d loss_to_lease:d",
         lambda c: R.property_loss_to_lease(c.T), "SELECT * FROM book_ltl JOIN prop USING (property_id)")
_UNIT = ("property_code:s unit_code:s unit_type_code:s unit_sqft:i occupancy_status:s section:s resident_id:s display_name:s market_rent:d "
         "charges_total:d balance:d move_in:t lease_expiration:t move_out:t")
_GRAIN_SUMS = "units occupied_units notice_units vacant_units non_revenue_units future_leases market_rent lease_charges square_feet balance".split()
_SUMMED = ", ".join(f"sum({c}) AS {c}" for c in _GRAIN_SUMS) + ", count(*) AS books, round(100.0 * sum(occupied_units) / nullif(sum(units), 0), 2) AS pct_occupied FROM kpi GROUP BY ALL"
register("r2_book_grains", "grain:s snapshot_id:i asset_key:s property_code:s units:i occupied_units:i notice_units:i vacant_units:i non_revenue_units:i future_leases:i"
         " market_rent:d lease_charges:d square_feet:i balance:d books:i pct_occupied:d", lambda c: R.book_grains(c.T),
         f"SELECT 'portfolio' AS grain, snapshot_id, NULL AS asset_key, NULL AS property_code, {_SUMMED} UNION ALL SELECT 'asset', snapshot_id, asset_key, NULL, {_SUMMED}"
         f" UNION ALL SELECT 'book', snapshot_id, asset_key, property_code, {_SUMMED}")
register("r6_charge_grains", "grain:s snapshot_id:i property_code:s category:s line_count:i amount:d", lambda c: R.charge_grains(c.T),
         "SELECT 'portfolio' AS grain, snapshot_id, NULL AS property_code, category, sum(line_count) AS line_count, sum(amount) AS amount FROM mix GROUP BY ALL"
         " UNION ALL SELECT 'book', snapshot_id, property_code, category, sum(line_count), sum(amount) FROM mix JOIN prop USING (property_id) GROUP BY ALL")
register("m4_loss_to_lease_co_located", "snapshot_id:i property_id:i unit_code:s market_rent:d contract_rent:d concessions:d loss_to_lease:d",
         lambda c: M.loss_to_lease(co_located(c.T, f"m4_{uuid.uuid4().hex[:12]}", 8)), "SELECT * FROM ltl")
register("r14_unit_search", f"snapshot_id:i {_UNIT} lease_id:i total:i", lambda c: R.unit_search(c.T, limit=1000, offset=500),
         "SELECT *, status AS occupancy_status, (SELECT count(*) FROM lease) AS total FROM units_of"
         " ORDER BY snapshot_id, property_code, unit_code, section, lease_id LIMIT 1000 OFFSET 500")
register("r14_unit_search_term", f"snapshot_id:i {_UNIT} lease_id:i total:i",
         lambda c: R.unit_search(c.T, status="occupied", term="nt 1", limit=200),
         "SELECT *, status AS occupancy_status, count(*) OVER () AS total FROM units_of WHERE status = 'occupied'"
         " AND (unit_code ILIKE '%nt 1%' OR display_name ILIKE '%nt 1%') ORDER BY snapshot_id, property_code, unit_code, section, lease_id LIMIT 200")
register("r15_lease_header", "lease_id:i property_code:s unit_code:s occupancy_status:s resident_id:s display_name:s market_rent:d charges_total:d balance:d",
         lambda c: R.lease_header(c.T), "SELECT *, status AS occupancy_status FROM units_of")
register("r16_lease_lines", "lease_id:i line_no:i charge_code:s category:s description:s is_concession:b amount:d",
         lambda c: R.lease_lines(c.T),
         "SELECT * FROM line JOIN code USING (charge_code)")
register("r17_expiring_leases", f"snapshot_id:i expiry_month:t property_name:s {_UNIT} holdover:b lease_id:i",
         lambda c: R.expiring_leases(c.T),
         "SELECT u.*, status AS occupancy_status, CAST(date_trunc('month', lease_expiration) AS DATE) AS expiry_month, lease_expiration < as_of_date AS holdover"
         " FROM units_of u JOIN snap USING (snapshot_id) WHERE status IN ('occupied','notice') AND lease_expiration IS NOT NULL")
register("r18_anomaly_view", f"snapshot_id:i {_ANOMALY}", lambda c: R.anomaly_view(c.T), "SELECT * FROM anomaly")
_RUNS_SQL = "(SELECT DISTINCT snapshot_id, CASE WHEN snapshot_id <= 1997 THEN 1 ELSE 2 END AS run_id FROM lease)"
register("r19_issue_summary", "snapshot_id:i severity:s rule:s n:i", lambda c: R.issue_summary(c.T),
         f"SELECT r.snapshot_id, severity, rule, count(*) AS n FROM issue JOIN {_RUNS_SQL} r USING (run_id) GROUP BY 1, 2, 3")
register("r19_issue_detail", "snapshot_id:i severity:s rule:s issue_id:i detail:s", lambda c: R.issue_detail(c.T),
         "SELECT snapshot_id, severity, rule, issue_id, '{\"unit_code\":\"' || unit_code || '\"}' AS detail FROM"
         " (SELECT r.snapshot_id, severity, rule, issue_id, i.unit_code, row_number() OVER (PARTITION BY r.snapshot_id ORDER BY"
         " CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule, issue_id) AS i"
         f" FROM issue i JOIN {_RUNS_SQL} r USING (run_id) WHERE severity <> 'info') WHERE i <= 100")
register("r20_run_history", "run_id:i status:s rows_loaded:i", lambda c: R.run_history(c.T),
         "SELECT CASE WHEN snapshot_id <= 1997 THEN 1 ELSE 2 END AS run_id, 'partial' AS status, count(*) AS rows_loaded FROM lease GROUP BY 1")
_USAGE = "charge_code:s category:s description:s is_concession:b label_verified:b line_count:i amount:d properties:i"
_USAGE_SQL = ("SELECT c.charge_code, category, description, is_concession, label_verified, count(l.lease_id) AS line_count,"
              " coalesce(sum(l.amount), 0) AS amount, count(DISTINCT l.property_id) AS properties"
              " FROM code c LEFT JOIN line l ON l.charge_code = c.charge_code{} GROUP BY 1, 2, 3, 4, 5")
register("r21_charge_code_usage", _USAGE, lambda c: R.charge_code_usage(c.T), _USAGE_SQL.format(""))
register("r21_charge_codes_unverified", _USAGE, lambda c: R.charge_code_usage(c.T, unverified_only=True),
         "SELECT * FROM (" + _USAGE_SQL.format("") + ") WHERE NOT label_verified")


def _changes(c: Context):
    """Review decisions taken from what is billed: codes seen on more lines than average become
    verified, the rarer ones are filed under `fee`."""
    used = c.T.lease_charge.groupBy("charge_code").agg(F.count(F.lit(1)).alias("n"))
    mean = used.agg(F.avg("n")).scalar()
    often = F.col("n") >= mean
    return used.select(
        "charge_code", F.when(~often, "fee").alias("category"), F.lit(None).cast("string").alias("description"),
        F.when(often, F.lit(True)).alias("verified"), F.lit("by volume").alias("note"), F.lit("review").alias("changed_by"),
        F.timestamp_seconds(F.col("n")).alias("changed_at"))


_CHANGED_SQL = """WITH used AS (SELECT charge_code, count(*) AS n FROM line GROUP BY 1),
moved AS (SELECT c.*, n, CASE WHEN n < (SELECT avg(n) FROM used) THEN 'fee' ELSE category END AS new_category,
                 CASE WHEN n >= (SELECT avg(n) FROM used) THEN true ELSE label_verified END AS new_verified
          FROM code c LEFT JOIN used USING (charge_code))
---
"""
_AUDIT = "charge_code:s old_category:s new_category:s old_description:s new_description:s old_verified:b new_verified:b note:s changed_by:s"
_AUDIT_SQL = (_CHANGED_SQL + "SELECT charge_code, category AS old_category, new_category, description AS old_description, description AS new_description,"
              " label_verified AS old_verified, new_verified, 'by volume' AS note, 'review' AS changed_by FROM moved"
              " WHERE n IS NOT NULL AND (category <> new_category OR label_verified <> new_verified)")
register("r22_audit_history", _AUDIT,
         lambda c: R.audit_history(c.T.with_frames(audit=L.reclassify(c.T.charge_code, _changes(c))[1])), _AUDIT_SQL)


def _idle_audit(c: Context):
    """The audit rows, and each of them once more with nothing changed."""
    audit = L.reclassify(c.T.charge_code, _changes(c))[1]
    idle = audit.withColumns({f"new_{x}": F.col(f"old_{x}") for x in ("category", "description", "verified")})
    return V.violations(audit.unionByName(idle), V.audit_constraints()).groupBy("violated").agg(F.count(F.lit(1)).alias("n"))


def _insights(c: Context):
    return D.insight_frame(c.spark, c.matrix)


_INSIGHT_SQL = """WITH ins AS (
  SELECT snapshot_id * 100 + property_id AS insight_id, snapshot_id, as_of_date, property_code AS book, property_id + snapshot_id AS n, units, pct_occupied,
         CASE WHEN (property_id + snapshot_id) % 6 = 0 THEN 'asset' WHEN (property_id + snapshot_id) % 17 = 0 THEN 'portfolio' ELSE 'property' END AS scope,
         CASE WHEN (property_id + snapshot_id) % 6 = 0 THEN NULL WHEN (property_id + snapshot_id) % 23 = 0 THEN '999x'
              WHEN (property_id + snapshot_id) % 4 = 0 THEN upper(property_code) ELSE property_code END AS property_code,
         CASE WHEN (property_id + snapshot_id) % 6 = 0 THEN property_code WHEN (property_id + snapshot_id) % 3 = 0 THEN asset_key END AS asset_key,
         CASE WHEN (property_id + snapshot_id) % 2 = 0 THEN 'positioning' ELSE 'occupancy' END AS category,
         CASE WHEN (property_id + snapshot_id) % 3 = 0 THEN 'high' WHEN (property_id + snapshot_id) % 2 = 0 THEN 'medium' ELSE 'low' END AS priority,
         quadrant, revenue_capture_pct
  FROM matrix WHERE plottable)
---
"""
_INSIGHT = "insight_id:i snapshot_id:i scope:s property_code:s asset_key:s category:s priority:s"
register("d10_insight_constraints", "violated:s n:i",
         lambda c: V.violations(
             _insights(c).withColumn("headline", F.when(F.col("insight_id") % 7 == 0, "short").otherwise(F.col("headline"))), V.insight_constraints()
         ).groupBy("violated").agg(F.count(F.lit(1)).alias("n")),
         _INSIGHT_SQL + "SELECT violated, count(*) AS n FROM (SELECT 'insight_headline_length' AS violated FROM ins WHERE insight_id % 7 = 0"
         " UNION ALL SELECT 'insight_scope_target' FROM ins WHERE (scope = 'portfolio' AND (property_code IS NOT NULL OR asset_key IS NOT NULL))"
         " OR (scope = 'asset' AND (property_code IS NOT NULL OR asset_key IS NULL)) OR (scope = 'property' AND (property_code IS NULL OR asset_key IS NOT NULL))) GROUP BY 1")
register("d10_audit_constraints", "violated:s n:i",
         lambda c: _idle_audit(c), _CHANGED_SQL + "SELECT 'charge_code_audit_changed_something' AS violated, count(*) AS n FROM moved"
         " WHERE n IS NOT NULL AND (category <> new_category OR label_verified <> new_verified) HAVING count(*) > 0")
register("r23_property_insights", _INSIGHT, lambda c: R.property_insights(c.T.with_frames(insight=_insights(c))),
         _INSIGHT_SQL + "SELECT * FROM ins WHERE scope = 'property'")
register("r23_insight_list", _INSIGHT, lambda c: R.insight_list(c.T.with_frames(insight=_insights(c))), _INSIGHT_SQL + "SELECT * FROM ins")


def _insight_runs(c: Context):
    """One generation attempt per snapshot and quadrant; the last attempt is the one with most books."""
    return c.matrix.filter("plottable").groupBy("snapshot_id", "quadrant").agg(F.count(F.lit(1)).alias("n")).select(
        "snapshot_id", (F.col("n") * 10 + F.instr(F.lit("dlpv"), F.left("quadrant", F.lit(1)))).alias("insight_run_id"), F.col("quadrant").alias("model"),
        F.when(F.col("n") > 5, "succeeded").otherwise("refused").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


register("r23_last_insight_run", "snapshot_id:i model:s status:s", lambda c: R.last_insight_run(c.T.with_frames(insight_run=_insight_runs(c))),
         "SELECT snapshot_id, arg_max(quadrant, n * 10 + instr('dlpv', left(quadrant, 1))) AS model,"
         " CASE WHEN arg_max(n, n * 10 + instr('dlpv', left(quadrant, 1))) > 5 THEN 'succeeded' ELSE 'refused' END AS status"
         " FROM (SELECT snapshot_id, quadrant, count(*) AS n FROM matrix WHERE plottable GROUP BY 1, 2) GROUP BY 1")
register("r24_panel_matrix", f"{_BOOK} {_MATRIX}", lambda c: R.panel_matrix(c.T), "SELECT * FROM matrix")
register("r24_panel_charge_mix", "snapshot_id:i property_code:s category:s charge_code:s line_count:i amount:d", lambda c: R.panel_charge_mix(c.T),
         "SELECT * FROM mix JOIN prop USING (property_id)")
register("r24_panel_expirations", f"snapshot_id:i property_code:s {_LADDER}", lambda c: R.panel_expirations(c.T),
         "SELECT * FROM ladder JOIN prop USING (property_id)")
register("r24_panel_summary_groups", "snapshot_id:i property_code:s group_label:s unit_count:i lease_charges:d", lambda c: R.panel_summary_groups(c.T),
         "SELECT * FROM printed_group JOIN prop USING (property_id)")
register("r25_reconciliation_view", f"snapshot_id:i {_RECON}", lambda c: R.reconciliation_view(c.T), "SELECT * FROM recon")
register("r25_reconciliation_differing", f"snapshot_id:i {_RECON}", lambda c: R.reconciliation_view(c.T, differing_only=True),
         "SELECT * FROM recon WHERE coalesce(unit_delta, 0) <> 0 OR coalesce(charge_delta, 0) <> 0"
         " OR detail_occupied <> coalesce(availability_occupied, detail_occupied)")

# ---- ledger ------------------------------------------------------------------
_COUNTS = ["SELECT '{}' AS metric, count(*) AS n FROM {}".format(m, t) for m, t in (
    ("leases", "lease"), ("charges", "line"), ("summary_groups", "printed_group"), ("charge_summaries", "printed_code"), ("availability", "avail"))]
_FACTS_SQL = " UNION ALL ".join(_COUNTS)
register("l1_load_tally", "metric:s n:i", lambda c: L.load_tally(c.T, c.T.issue),
         _FACTS_SQL + f" UNION ALL SELECT 'rows_loaded', sum(n) FROM ({_FACTS_SQL}) UNION ALL"
         " SELECT 'issues_' || severity, count(*) FROM issue GROUP BY severity")
register("l2_run_status", "run_id:i files_seen:i files_failed:i errors:i warnings:i status:s",
         lambda c: L.run_status(c.T.file.withColumn("failed", F.col("file_id") % 97 == 0), c.T.issue),
         "SELECT f.run_id, files_seen, files_failed, errors, warnings, CASE WHEN errors > 0 OR files_failed > 0 THEN"
         " CASE WHEN files_failed = files_seen THEN 'failed' ELSE 'partial' END WHEN warnings > 0 THEN 'partial' ELSE 'succeeded' END AS status"
         " FROM (SELECT CASE WHEN snapshot_id <= 1997 THEN 1 ELSE 2 END AS run_id, count(DISTINCT file_id) AS files_seen,"
         " count(DISTINCT file_id) FILTER (WHERE file_id % 97 = 0) AS files_failed FROM lease GROUP BY 1) f JOIN"
         " (SELECT run_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings"
         " FROM issue GROUP BY 1) i ON i.run_id = f.run_id")


def _golden(c: Context) -> DataFrame:
    """The expected counts come from the source tables: books from the nations, leases from the orders. One is wrong on purpose."""
    orders = c.raw("orders").join(c.raw("customer").filter("c_nationkey <> 24").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    held = orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 41 == 0).alias("future")).first()
    return L.golden_check(c.T, {"properties": c.raw("nation").count(), "charge_codes": 7, "leases": held.n, "leases_future": held.future})


register("l3_golden_check", "metric:s n:i expected:i verdict:s", _golden,
         "SELECT metric, n, expected, CASE WHEN expected IS NULL THEN '' WHEN n = expected THEN 'ok' ELSE 'DIFF' END AS verdict FROM ("
         " SELECT 'properties' AS metric, count(*) AS n FROM prop UNION ALL SELECT 'leases', count(*) FROM lease"
         " UNION ALL SELECT 'leases_current', count(*) FROM lease WHERE section = 'current'"
         " UNION ALL SELECT 'leases_future', count(*) FROM lease WHERE section = 'future'"
         " UNION ALL SELECT 'units', count(*) FROM lease UNION ALL SELECT 'unit_types', count(*) FROM (SELECT DISTINCT property_id, unit_type_code FROM lease)"
         " UNION ALL SELECT 'residents', count(resident_id) FROM lease UNION ALL SELECT 'charges', count(*) FROM line"
         " UNION ALL SELECT 'charge_codes', count(DISTINCT charge_code) FROM line UNION ALL SELECT 'summary_groups', count(*) FROM printed_group"
         " UNION ALL SELECT 'charge_summaries', count(*) FROM printed_code UNION ALL SELECT 'availability_rows', count(*) FROM avail)"
         " LEFT JOIN (SELECT 'properties' AS metric, count(*) AS expected FROM nation UNION ALL SELECT 'charge_codes', 7 UNION ALL SELECT 'leases', count(*)"
         " FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 24 UNION ALL SELECT 'leases_future', count(*) FROM orders JOIN customer"
         " ON c_custkey = o_custkey WHERE c_nationkey <> 24 AND o_orderkey % 41 = 0) AS e USING (metric)")
register("l4_run_issue_rollup", "severity:s rule:s n:i fails:b", lambda c: L.run_issue_rollup(c.T, strict=True),
         "SELECT severity, rule, count(*) AS n, severity IN ('error','warning') AS fails FROM issue WHERE run_id = (SELECT max(run_id) FROM issue) GROUP BY 1, 2")
register("l5_reclassify", "charge_code:s category:s description:s label_verified:b is_concession:b",
         lambda c: L.reclassify(c.T.charge_code, _changes(c))[0],
         _CHANGED_SQL + "SELECT charge_code, new_category AS category, description, new_verified AS label_verified, is_concession FROM moved")
register("l5_reclassified_mix", f"{_BOOK} category:s charge_code:s line_count:i amount:d",
         lambda c: apply_review(c.T, _changes(c), shared_folder(c.spark))[1],
         _CHANGED_SQL + "SELECT snapshot_id, property_id, new_category AS category, charge_code, count(*) AS line_count, sum(amount) AS amount"
         " FROM line JOIN moved USING (charge_code) GROUP BY ALL")
register("l5_stored_audit", _AUDIT, lambda c: apply_review(c.T, _changes(c), shared_folder(c.spark))[0].audit, _AUDIT_SQL)
register("l6_nearest_codes", "charge_code:s similarity:d",
         lambda c: L.nearest_codes(c.T.lease_charge.groupBy("charge_code").agg(F.count(F.lit(1)).alias("n")), "PETS FEE"),
         """WITH grams AS (SELECT charge_code, list_distinct(flatten(list_transform(
              list_filter(regexp_split_to_array(lower(charge_code), '[^a-z0-9]+'), lambda w: w <> ''),
              lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g
            FROM (SELECT DISTINCT charge_code FROM line)),
probe AS (SELECT ['  p', ' pe', 'pet', 'ets', 'ts ', '  f', ' fe', 'fee', 'ee '] AS t)
---
SELECT charge_code, len(list_intersect(g, t)) / len(list_distinct(list_concat(g, t))) AS similarity FROM grams, probe
ORDER BY 2 DESC, 1 LIMIT 3""")
