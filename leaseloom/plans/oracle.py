"""Independent DuckDB SQL for the registered queries, written from the definitions of the operators.

`CORE` maps the driver's tables onto the lease model in SQL; `MARTS` states the marts the way a
relational database would. Each entry of `BODIES` is one query over those views.
"""

from __future__ import annotations

CORE = r"""
prop AS (
  SELECT property_id, property_code, property_name,
         CASE WHEN regexp_extract(property_code, '^\d+') = '' THEN property_code
              ELSE regexp_extract(property_code, '^\d+') END AS asset_key,
         CASE WHEN property_code LIKE '%land' THEN 'land' WHEN property_code LIKE '%c' THEN 'commercial'
              WHEN property_code LIKE '%a' THEN 'affordable' WHEN property_code LIKE '%r' THEN 'residential'
              ELSE 'other' END AS book_type
  FROM (SELECT n_nationkey AS property_id, n_name AS property_name,
               CAST(100 + n_nationkey - n_nationkey % 2 AS VARCHAR) ||
               CASE WHEN n_nationkey = 24 THEN 'land' WHEN n_nationkey % 4 = 1 THEN 'a'
                    WHEN n_nationkey % 8 = 3 THEN 'c' WHEN n_nationkey % 8 = 7 THEN 'm' ELSE 'r' END AS property_code
        FROM nation)
),
snap AS (
  SELECT DISTINCT year(o_orderdate) AS snapshot_id, make_date(year(o_orderdate), 12, 31) AS as_of_date,
         make_date(year(o_orderdate), 12, 1) AS report_month
  FROM orders
),
code AS (
  SELECT *, charge_code LIKE 'CON%' AS is_concession FROM (VALUES __CODES__)
    AS t(charge_code, category, description, label_verified)
),
head AS (
  SELECT o_orderkey AS lease_id, year(o_orderdate) AS snapshot_id, c_nationkey AS property_id,
         'U' || o_orderkey AS unit_code, c_mktsegment AS unit_type_code,
         CASE WHEN o_orderkey % 41 = 0 THEN 'future' ELSE 'current' END AS section,
         CASE WHEN o_orderkey % 41 = 0 THEN 'future'
              WHEN o_orderkey % (10 + 5 * (c_nationkey % 5)) = 0 THEN 'vacant'
              WHEN o_orderkey % 89 = 0 THEN 'model' WHEN o_orderkey % 101 = 0 THEN 'down'
              WHEN o_orderkey % 23 = 0 THEN 'notice' ELSE 'occupied' END AS status,
         CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 450 + (o_orderkey * 37) % 900 END AS unit_sqft,
         CASE WHEN c_nationkey % 8 = 3 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS market_rent,
         CASE WHEN o_orderkey % 6 = 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) ELSE 0 END AS balance,
         CAST(o_orderdate AS DATE) AS move_in,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL
              WHEN c_nationkey % 4 = 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) - 1 + CAST(200 + 60 * (o_orderkey % 3) AS INT)
              ELSE CAST(o_orderdate AS DATE) + CAST(300 + o_orderkey % 120 AS INT) END AS lease_expiration
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 24
),
bill AS (
  SELECT *, status NOT IN ('vacant','model','down') AND property_id % 7 <> 6 AS bills,
         CASE WHEN status = 'notice' THEN move_in + CAST(30 + lease_id % 400 AS INT) END AS move_out,
         CASE WHEN status IN ('occupied','notice','future') THEN 't' || lease_id END AS resident_id
  FROM head
),
line AS (
  SELECT lease_id, snapshot_id, property_id, section, status, charge_code, amount, slot,
         row_number() OVER (PARTITION BY lease_id ORDER BY slot, pk, sk, q, p) AS line_no
  FROM (
    SELECT lease_id, snapshot_id, property_id, section, status, 'RENT' AS charge_code,
           CAST(market_rent - 100 * (lease_id % 7) AS DECIMAL(12,2)) AS amount, 0 AS slot, 0 AS pk, 0 AS sk, 0.0 AS q, 0.0 AS p
    FROM bill WHERE bills AND market_rent > 700
    UNION ALL
    SELECT lease_id, snapshot_id, property_id, section, status,
           CASE l_linenumber WHEN 1 THEN 'PARKING' WHEN 2 THEN 'PETFEEM' WHEN 3 THEN 'TRASH' WHEN 4 THEN 'CONRENT'
                             WHEN 5 THEN 'RENTHAP' WHEN 6 THEN 'AMENITY' WHEN 7 THEN 'W/D' END,
           CAST(CASE WHEN l_linenumber = 1 AND property_id % 3 = 0 THEN l_extendedprice
                     WHEN l_linenumber = 4 THEN -l_quantity ELSE l_quantity END AS DECIMAL(12,2)),
           l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem JOIN bill ON l_orderkey = lease_id WHERE bills)
),
lease AS (
  SELECT b.*, coalesce(t.charges, 0) AS charges_total, b.snapshot_id * 100 + b.property_id AS file_id
  FROM bill b LEFT JOIN (SELECT lease_id, sum(amount) AS charges FROM line GROUP BY 1) t ON t.lease_id = b.lease_id
),
issue AS (
  SELECT lease_id AS issue_id, CASE WHEN snapshot_id <= 1997 THEN 1 ELSE 2 END AS run_id, file_id, unit_code,
         CASE WHEN status = 'vacant' AND balance <> 0 THEN 'warning' WHEN unit_sqft = 0 THEN 'error'
              WHEN status = 'notice' AND lease_id % 2 = 0 THEN 'info' END AS severity,
         CASE WHEN status = 'vacant' AND balance <> 0 THEN 'sentinel_field_violation' WHEN unit_sqft = 0 THEN 'lease_row_coercion'
              WHEN status = 'notice' AND lease_id % 2 = 0 THEN 'moveout_before_asof' END AS rule
  FROM lease
  WHERE (status = 'vacant' AND balance <> 0) OR unit_sqft = 0 OR (status = 'notice' AND lease_id % 2 = 0)
)"""

MARTS = r"""
label(status, occupied, notice, vacant, idle) AS (
  VALUES ('occupied', 1, 0, 0, 0), ('notice', 1, 1, 0, 0), ('vacant', 0, 0, 1, 0), ('model', 0, 0, 0, 1), ('down', 0, 0, 0, 1), ('future', 0, 0, 0, 0)
),
tense(section, now, later) AS (VALUES ('current', 1, 0), ('future', 0, 1)),
state AS (
  SELECT snapshot_id, property_id, section, status, count(*) AS n, sum(market_rent) AS rent, sum(charges_total) AS charges, sum(unit_sqft) AS sqft,
         sum(balance) AS balance, sum(greatest(balance, 0)) AS owed, sum(CAST(balance > 0 AS INT)) AS owing, count(b.lease_id) AS with_lines
  FROM lease LEFT JOIN (SELECT DISTINCT lease_id FROM line) b USING (lease_id) GROUP BY ALL
),
book AS (
  SELECT snapshot_id, property_id, sum(n * now) AS units, sum(n * occupied) AS occupied_units, sum(n * notice) AS notice_units, sum(n * vacant) AS vacant_units,
         sum(n * idle) AS non_revenue_units, sum(n * later) AS future_leases, sum(rent * nullif(now, 0)) AS market_rent, sum(charges * nullif(now, 0)) AS lease_charges,
         sum(sqft * nullif(now, 0)) AS square_feet, sum(balance * nullif(now, 0)) AS balance, sum(owed * now) AS balance_owed, sum(owing * now) AS units_owing,
         sum(with_lines * now) AS leases_with_charges
  FROM state JOIN label USING (status) JOIN tense USING (section) GROUP BY 1, 2
),
kpi AS (
  SELECT b.* EXCLUDE (balance_owed, units_owing, leases_with_charges), as_of_date, property_code, property_name, book_type, asset_key,
         round(100.0 * occupied_units / nullif(units, 0), 2) AS pct_occupied, 500.0 * units AS deposits
  FROM book b JOIN prop USING (property_id) JOIN snap USING (snapshot_id)
),
mix AS (
  SELECT snapshot_id, property_id, category, charge_code, count(*) AS line_count, sum(amount) AS amount
  FROM line JOIN code USING (charge_code) GROUP BY ALL
),
ladder AS (
  SELECT l.snapshot_id, l.property_id, CAST(date_trunc('month', lease_expiration) AS DATE) AS expiry_month,
         count(*) AS expiring_leases, sum(charges_total) AS charges_at_risk,
         count(*) FILTER (WHERE lease_expiration < as_of_date) AS holdover_mtm
  FROM lease l JOIN snap s USING (snapshot_id)
  WHERE status IN ('occupied','notice') AND lease_expiration IS NOT NULL GROUP BY 1, 2, 3
),
ltl AS (
  SELECT l.lease_id, l.snapshot_id, l.property_id, l.unit_code, l.unit_type_code, l.market_rent,
         coalesce(sum(c.amount) FILTER (WHERE k.category = 'rent'), 0) AS contract_rent,
         coalesce(sum(c.amount) FILTER (WHERE k.category = 'concession'), 0) AS concessions,
         l.market_rent - coalesce(sum(c.amount) FILTER (WHERE k.category = 'rent'), 0) AS loss_to_lease
  FROM lease l LEFT JOIN line c ON c.lease_id = l.lease_id LEFT JOIN code k ON k.charge_code = c.charge_code
  WHERE l.status IN ('occupied','notice')
  GROUP BY l.lease_id, l.snapshot_id, l.property_id, l.unit_code, l.unit_type_code, l.market_rent
),
avail AS (
  SELECT s.snapshot_id, p.property_id,
         coalesce(k.units, 0) + CASE WHEN k.units IS NOT NULL AND (p.property_id + s.snapshot_id) % 11 = 0 THEN 1 ELSE 0 END AS units,
         coalesce(k.occupied_units - k.notice_units, 0) AS occupied_no_notice,
         coalesce(k.vacant_units, 0) AS vacant_unrented,
         coalesce(k.notice_units, 0) + CASE WHEN k.units IS NOT NULL AND (p.property_id + s.snapshot_id) % 13 = 0 THEN 1 ELSE 0 END AS notice_unrented,
         coalesce(k.vacant_units + k.notice_units, 0) AS available,
         coalesce(k.pct_occupied, 0) AS pct_leased,
         coalesce((2 * CAST(k.market_rent * 100 AS BIGINT) + k.units) // nullif(2 * k.units, 0) / 100.0, 0) AS avg_rent,
         coalesce(CAST(round(k.square_feet / nullif(k.units, 0), 0) AS INT), 0) AS avg_sqft
  FROM snap s CROSS JOIN prop p LEFT JOIN kpi k ON k.snapshot_id = s.snapshot_id AND k.property_id = p.property_id
),
grp AS (
  SELECT l.snapshot_id, l.property_id, g.label AS group_label,
         count(*) FILTER (WHERE CASE g.label
            WHEN 'Current/Notice/Vacant Residents' THEN section = 'current'
            WHEN 'Future Residents/Applicants' THEN section = 'future'
            WHEN 'Occupied Units' THEN status IN ('occupied','notice')
            WHEN 'Total Vacant Units' THEN status = 'vacant'
            WHEN 'Total Non Rev Units' THEN status IN ('model','down') ELSE true END) AS detail_units,
         coalesce(sum(charges_total) FILTER (WHERE CASE g.label
            WHEN 'Current/Notice/Vacant Residents' THEN section = 'current'
            WHEN 'Future Residents/Applicants' THEN section = 'future'
            WHEN 'Occupied Units' THEN status IN ('occupied','notice')
            WHEN 'Total Vacant Units' THEN status = 'vacant'
            WHEN 'Total Non Rev Units' THEN status IN ('model','down') ELSE true END), 0) AS detail_charges
  FROM lease l CROSS JOIN (VALUES ('Current/Notice/Vacant Residents'), ('Future Residents/Applicants'),
      ('Occupied Units'), ('Total Vacant Units'), ('Total Non Rev Units'), ('Totals:')) AS g(label)
  GROUP BY 1, 2, 3
),
printed_group AS (
  SELECT *, detail_units + CASE WHEN group_label = 'Occupied Units' AND (property_id + snapshot_id) % 17 = 0 THEN 1 ELSE 0 END AS unit_count,
         detail_charges + CASE WHEN group_label = 'Current/Notice/Vacant Residents' AND (property_id + snapshot_id) % 19 = 0
                               THEN CAST(0.5 AS DECIMAL(3,2)) ELSE 0 END AS lease_charges
  FROM grp
),
printed_code AS (
  SELECT snapshot_id, property_id, charge_code, sum(amount) AS detail_amount,
         sum(amount) + CASE WHEN charge_code = 'TRASH' AND (property_id + snapshot_id) % 7 = 0 THEN 1 ELSE 0 END AS amount
  FROM line WHERE status IN ('occupied','notice') GROUP BY 1, 2, 3
),
recon AS (
  SELECT k.snapshot_id, k.property_code, k.units AS detail_units, a.units AS availability_units, k.units - a.units AS unit_delta,
         k.occupied_units AS detail_occupied, a.occupied_no_notice + a.notice_unrented AS availability_occupied,
         k.lease_charges AS detail_charges, g.lease_charges AS report_charges, k.lease_charges - g.lease_charges AS charge_delta
  FROM kpi k LEFT JOIN avail a ON a.snapshot_id = k.snapshot_id AND a.property_id = k.property_id
  LEFT JOIN printed_group g ON g.snapshot_id = k.snapshot_id AND g.property_id = k.property_id
       AND g.group_label = 'Current/Notice/Vacant Residents'
),
asset AS (
  SELECT snapshot_id, as_of_date, asset_key, min(property_name) AS asset_label, count(*) AS book_count,
         string_agg(property_code, ',' ORDER BY property_code) AS property_codes,
         sum(units) AS units, sum(occupied_units) AS occupied_units, sum(vacant_units) AS vacant_units,
         sum(non_revenue_units) AS non_revenue_units,
         round(100.0 * sum(occupied_units) / nullif(sum(units), 0), 2) AS pct_occupied,
         sum(market_rent) AS market_rent, sum(lease_charges) AS lease_charges, sum(square_feet) AS square_feet, sum(balance) AS balance
  FROM kpi GROUP BY 1, 2, 3
),
trend AS (
  SELECT k.property_id, k.property_code, k.property_name, b.as_of_date AS prior_as_of, k.as_of_date AS current_as_of,
         k.pct_occupied, round(k.pct_occupied - b.pct_occupied, 2) AS d_pct_occupied,
         k.market_rent, k.market_rent - b.market_rent AS d_market_rent,
         k.lease_charges, k.lease_charges - b.lease_charges AS d_lease_charges,
         k.balance, k.balance - b.balance AS d_balance, k.notice_units, k.notice_units - b.notice_units AS d_notice_units, k.snapshot_id
  FROM kpi k JOIN kpi b ON b.property_id = k.property_id AND b.as_of_date =
       (SELECT max(o.as_of_date) FROM kpi o WHERE o.property_id = k.property_id AND o.as_of_date < k.as_of_date)
),
cover AS (SELECT snapshot_id, property_id, units AS current_leases, leases_with_charges FROM book),
owing AS (SELECT snapshot_id, property_id, units_owing, CASE WHEN units_owing > 0 THEN balance_owed END AS balance_owed FROM book WHERE units > 0),
anc AS (
  SELECT snapshot_id, property_id, sum(amount) AS ancillary_charges
  FROM mix JOIN (SELECT DISTINCT category FROM code EXCEPT VALUES ('rent'), ('concession'), ('subsidy')) USING (category) GROUP BY 1, 2
),
book_ltl AS (
  SELECT snapshot_id, property_id, count(*) AS units, sum(market_rent) AS market_rent, sum(contract_rent) AS contract_rent,
         sum(concessions) AS concessions, sum(loss_to_lease) AS loss_to_lease
  FROM ltl GROUP BY 1, 2
),
given AS (
  SELECT snapshot_id, property_id FROM snap, prop
  UNION ALL BY NAME SELECT snapshot_id, property_id, units, occupied_units, notice_units, vacant_units, non_revenue_units, pct_occupied, market_rent, lease_charges,
                           square_feet, balance FROM kpi
  UNION ALL BY NAME SELECT snapshot_id, property_id, round(leases_with_charges / nullif(current_leases, 0), 3) AS charge_coverage FROM cover
  UNION ALL BY NAME SELECT snapshot_id, property_id, loss_to_lease, concessions FROM book_ltl
  UNION ALL BY NAME SELECT snapshot_id, property_id, ancillary_charges FROM anc
  UNION ALL BY NAME SELECT snapshot_id, property_id, units_owing, balance_owed FROM owing
),
scored AS (
  SELECT *, CASE WHEN market_rent > 0 THEN round(100.0 * lease_charges / market_rent, 2) END AS revenue_capture_pct,
         list_filter([CASE WHEN units = 0 THEN 'no_units' END, CASE WHEN coalesce(market_rent, 0) <= 0 THEN 'no_market_rent' END,
                      CASE WHEN coalesce(charge_coverage, 0) < 0.5 THEN 'no_charge_data' END], lambda r: r IS NOT NULL)[1] AS exclusion_reason
  FROM (SELECT snapshot_id, property_id, max(pct_occupied) AS pct_occupied, max(market_rent) AS market_rent, max(lease_charges) AS lease_charges,
               max(square_feet) AS square_feet, max(balance) AS balance, max(charge_coverage) AS charge_coverage,
               coalesce(max(units), 0) AS units, coalesce(max(occupied_units), 0) AS occupied_units, coalesce(max(notice_units), 0) AS notice_units,
               coalesce(max(vacant_units), 0) AS vacant_units, coalesce(max(non_revenue_units), 0) AS non_revenue_units,
               coalesce(max(loss_to_lease), 0) AS loss_to_lease, coalesce(max(concessions), 0) AS concessions,
               coalesce(max(ancillary_charges), 0) AS ancillary_charges, coalesce(max(units_owing), 0) AS units_owing, coalesce(max(balance_owed), 0) AS balance_owed
        FROM given GROUP BY 1, 2) JOIN prop USING (property_id) JOIN snap USING (snapshot_id)
),
corner(high_capture, high_occupancy, quadrant) AS (
  VALUES (true, true, 'performing'), (true, false, 'vacancy_led'), (false, true, 'leaking'), (false, false, 'distressed')
),
matrix AS (
  SELECT s.*, exclusion_reason IS NULL AS plottable, 95.0 AS capture_threshold, 95.0 AS occupancy_threshold, quadrant,
         CASE WHEN exclusion_reason IS NULL THEN
           CAST(greatest(0, (CAST(market_rent * 100 AS BIGINT) * 95 - CAST(lease_charges * 100 AS BIGINT) * 100 + 50) // 100) / 100.0 AS DECIMAL(28,2)) END AS charges_to_threshold,
         CASE WHEN exclusion_reason IS NULL THEN greatest(0, (CAST(units AS BIGINT) * 95 + 99) // 100 - occupied_units) END AS units_to_threshold
  FROM scored s LEFT JOIN corner ON exclusion_reason IS NULL AND high_capture = (revenue_capture_pct >= 95) AND high_occupancy = (pct_occupied >= 95)
),
bridge AS (
  SELECT s.snapshot_id, p.*, coalesce(r.gpr, 0) AS gross_potential_rent, coalesce(r.vac, 0) AS vacancy_loss,
         coalesce(r.gpr, 0) - coalesce(r.vac, 0) - coalesce(c.rent, 0) AS loss_to_lease,
         coalesce(c.rent, 0) AS rent_charges, coalesce(c.subsidy, 0) AS subsidy, coalesce(c.concessions, 0) AS concessions,
         coalesce(c.ancillary, 0) AS ancillary, coalesce(c.billed, 0) AS billed_charges, r.coverage AS charge_coverage,
         CASE WHEN coalesce(r.n, 0) = 0 THEN 'no_units' WHEN coalesce(r.gpr, 0) <= 0 THEN 'no_market_rent'
              WHEN coalesce(r.coverage, 0) < 0.5 THEN 'no_charge_data' END AS exclusion_reason
  FROM snap s CROSS JOIN prop p
  LEFT JOIN (SELECT snapshot_id, property_id, sum(market_rent) AS gpr, count(*) AS n,
                    sum(market_rent) FILTER (WHERE status IN ('vacant','model','down')) AS vac,
                    round(count(*) FILTER (WHERE lease_id IN (SELECT lease_id FROM line)) / count(*), 3) AS coverage
             FROM lease WHERE section = 'current' GROUP BY 1, 2) r ON r.snapshot_id = s.snapshot_id AND r.property_id = p.property_id
  LEFT JOIN (SELECT snapshot_id, property_id, sum(amount) FILTER (WHERE category = 'rent') AS rent,
                    sum(amount) FILTER (WHERE category = 'subsidy') AS subsidy, sum(amount) FILTER (WHERE category = 'concession') AS concessions,
                    sum(amount) FILTER (WHERE category NOT IN ('rent','subsidy','concession')) AS ancillary, sum(amount) AS billed
             FROM line JOIN code USING (charge_code) WHERE section = 'current' GROUP BY 1, 2) c
         ON c.snapshot_id = s.snapshot_id AND c.property_id = p.property_id
),
priced AS (
  SELECT l.*, (2 * CAST(market_rent * 100 AS BIGINT) * 100 + unit_sqft) // (2 * unit_sqft) / 10000.0 AS rent_psf,
         (SELECT CASE WHEN count(*) > 0 THEN coalesce(sum(c.amount) FILTER (WHERE c.charge_code IN ('RENT','RENTAFF','RENTRETL')), 0) END
          FROM line c WHERE c.lease_id = l.lease_id) AS contract_rent
  FROM lease l WHERE section = 'current' AND status IN ('occupied','notice') AND unit_sqft > 0 AND market_rent > 0
),
peers AS (
  SELECT snapshot_id, property_id, unit_type_code, count(*) AS peer_units,
         quantile_disc(market_rent, 0.5) AS median_market_rent, quantile_disc(rent_psf, 0.5) AS median_rent_psf
  FROM priced GROUP BY 1, 2, 3
),
outlier AS (
  SELECT b.*, p.property_code, b.lease_id AS unit_id, peer_units, median_market_rent, median_rent_psf,
         market_rent - median_market_rent AS market_vs_median,
         round(100.0 * (market_rent - median_market_rent) / nullif(median_market_rent, 0), 2) AS pct_vs_median,
         contract_rent - market_rent AS contract_vs_market
  FROM priced b JOIN peers USING (snapshot_id, property_id, unit_type_code) JOIN prop p USING (property_id) WHERE peer_units >= 3
),
conc AS (
  SELECT e.*, p.property_code, p.property_name, d.dated_leases, 0.15 AS concentration_threshold, 50 AS min_dated_leases,
         round(expiring_leases / dated_leases, 4) AS share_of_book,
         dated_leases >= 50 AND expiring_leases * 100 >= dated_leases * 15 AS concentrated,
         greatest(0, expiring_leases - CAST(floor(dated_leases * 15 / 100) AS BIGINT)) AS leases_to_shift
  FROM ladder e JOIN prop p USING (property_id)
  JOIN (SELECT snapshot_id, property_id, count(*) AS dated_leases FROM lease
        WHERE status IN ('occupied','notice') AND lease_expiration IS NOT NULL GROUP BY 1, 2) d USING (snapshot_id, property_id)
),
metric AS (
  SELECT snapshot_id, property_id, property_code, property_name, units, unnest(['pct_occupied','revenue_capture_pct','balance_per_unit',
           'concession_per_unit','loss_to_lease_per_unit','notice_rate','vacancy_rate']) AS metric,
         unnest([pct_occupied, CASE WHEN plottable THEN revenue_capture_pct END, round(balance / units, 2),
           CASE WHEN plottable THEN round(concessions / units, 2) END, CASE WHEN plottable THEN round(loss_to_lease / units, 2) END,
           round(100.0 * notice_units / units, 2), round(100.0 * vacant_units / units, 2)]::DOUBLE[]) AS value
  FROM matrix WHERE units > 0
),
meta AS (
  SELECT * FROM (VALUES ('pct_occupied','Physical occupancy','pct','low'), ('revenue_capture_pct','Revenue capture','pct','low'),
    ('balance_per_unit','Resident balance per unit','money','low'), ('concession_per_unit','Concessions per unit','money','low'),
    ('loss_to_lease_per_unit','Loss to lease per unit','money','high'), ('notice_rate','Units on notice','pct','high'),
    ('vacancy_rate','Vacant units','pct','high')) AS t(metric, label, unit, worse_when)
),
cents AS (SELECT *, CAST(round(value * 100) AS HUGEINT) AS v FROM metric WHERE value IS NOT NULL),
moments AS (
  SELECT snapshot_id, metric, count(*) AS n, sum(v) AS s, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) AS spread
  FROM cents GROUP BY 1, 2 HAVING count(*) >= 3
),
apart AS (
  SELECT c.*, n AS peer_books, sign(s) * ((2 * abs(s) * 100 + n) // (2 * n)) / 10000.0 AS peer_mean, sqrt(spread / (n * (n - 1))) / 100 AS sd,
         round((n * v - s) / nullif(sqrt(spread * n / (n - 1)), 0), 2) AS z
  FROM cents c JOIN moments USING (snapshot_id, metric)
),
anomaly AS (
  SELECT a.* EXCLUDE (v, sd), label, unit, worse_when, round(sd, 4) AS peer_sd, z * CASE worse_when WHEN 'low' THEN -1 ELSE 1 END > 0 AS adverse, priority
  FROM apart a JOIN meta USING (metric)
  JOIN (VALUES (1.75, 2.0, 'low'), (2.0, 2.5, 'medium'), (2.5, 1e9, 'high')) AS band(least_z, below_z, priority) ON abs(z) >= least_z AND abs(z) < below_z
),
units_of AS (
  SELECT l.*, p.property_code, p.property_name, CASE WHEN resident_id IS NOT NULL THEN 'Resident ' || lease_id END AS display_name
  FROM lease l JOIN prop p USING (property_id)
),
finding AS (
  SELECT 'error' AS severity, 'charge_summary_vs_detail' AS rule, snapshot_id, property_code,
         '{"property_code":"' || property_code || '","charge_code":"' || charge_code || '","report_amount":"' ||
         CAST(amount AS DECIMAL(14,2)) || '","detail_amount":"' || CAST(detail_amount AS DECIMAL(14,2)) || '"}' AS detail
  FROM printed_code JOIN prop USING (property_id) WHERE abs(amount - detail_amount) > 0.01
  UNION ALL
  SELECT 'error', 'summary_group_units_vs_detail', snapshot_id, property_code, '{"property_code":"' || property_code || '","group_label":"' ||
         group_label || '","report_units":"' || unit_count || '","detail_units":"' || detail_units || '"}'
  FROM printed_group JOIN prop USING (property_id) WHERE group_label <> 'Totals:' AND unit_count <> detail_units
  UNION ALL
  SELECT 'error', 'summary_group_charges_vs_detail', snapshot_id, property_code, '{"property_code":"' || property_code || '","group_label":"' ||
         group_label || '","report_charges":"' || CAST(lease_charges AS DECIMAL(14,2)) || '","detail_charges":"' || CAST(detail_charges AS DECIMAL(14,2)) || '"}'
  FROM printed_group JOIN prop USING (property_id) WHERE group_label <> 'Totals:' AND abs(lease_charges - detail_charges) > 0.01
  UNION ALL
  SELECT 'warning', 'availability_units_vs_detail', a.snapshot_id, property_code, '{"snapshot_id":"' || a.snapshot_id || '","property_code":"' || property_code ||
         '","availability_units":"' || a.units || '","detail_units":"' || count(l.lease_id) FILTER (WHERE l.section = 'current') || '"}'
  FROM avail a JOIN prop USING (property_id) LEFT JOIN lease l ON l.snapshot_id = a.snapshot_id AND l.property_id = a.property_id
  GROUP BY a.snapshot_id, property_code, a.units HAVING a.units <> count(l.lease_id) FILTER (WHERE l.section = 'current')
  UNION ALL
  SELECT 'info', 'availability_occupancy_split_vs_detail', a.snapshot_id, property_code, '{"property_code":"' || property_code || '","availability_occupied":"' ||
         (a.occupied_no_notice + a.notice_unrented) || '","detail_occupied":"' || coalesce(d.n, 0) || '"}'
  FROM avail a JOIN prop USING (property_id)
  LEFT JOIN (SELECT snapshot_id, property_id, count(*) AS n FROM lease WHERE status IN ('occupied','notice') GROUP BY 1, 2) d
    ON d.snapshot_id = a.snapshot_id AND d.property_id = a.property_id
  WHERE a.occupied_no_notice + a.notice_unrented <> coalesce(d.n, 0)
  UNION ALL
  SELECT 'info', 'expired_lease_no_moveout', NULL, property_code, '{"property_code":"' || property_code || '","count":"' || count(*) || '"}'
  FROM lease JOIN prop USING (property_id) JOIN snap USING (snapshot_id)
  WHERE status IN ('occupied','notice') AND lease_expiration < as_of_date GROUP BY property_code
  UNION ALL
  SELECT 'info', 'moveout_before_asof', NULL, property_code, '{"property_code":"' || property_code || '","count":"' || count(*) || '"}'
  FROM lease JOIN prop USING (property_id) JOIN snap USING (snapshot_id) WHERE move_out < as_of_date GROUP BY property_code
  UNION ALL
  SELECT 'info', 'zero_unit_property', NULL, property_code, '{"property_code":"' || property_code || '"}'
  FROM prop p WHERE NOT EXISTS (SELECT 1 FROM lease l WHERE l.property_id = p.property_id)
  UNION ALL
  SELECT 'info', 'duplicate_charge_code_in_block', NULL, property_code, '{"property_code":"' || property_code || '","blocks_with_repeats":"' || count(*) || '"}'
  FROM (SELECT lease_id, property_id, charge_code FROM line GROUP BY ALL HAVING count(*) > 1) JOIN prop USING (property_id) GROUP BY property_code
)"""

_CAST = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "DATE", "b": "BOOLEAN"}


def _codes() -> str:
    from leaseloom.schemas import CHARGE_CODES

    return ", ".join(
        f"('{c}', '{cat}', '{desc}', {str(ok).lower()})" for c, cat, desc, ok in CHARGE_CODES
    )


def _column(name: str, kind: str) -> str:
    cast = f"CAST({name} AS {_CAST[kind]})"
    return f"{cast} + 0.0 AS {name}" if kind == "d" else f"{cast} AS {name}"


def sql_for(body: str, columns: dict[str, str]) -> str:
    """The complete statement: the shared views, the query, and the output types."""
    picked = ", ".join(_column(n, k) for n, k in columns.items())
    needed = CORE.replace("__CODES__", _codes()) + ",\n" + MARTS
    extra = ""
    if body.lstrip().upper().startswith("WITH "):
        ctes, body = body.split("\n---\n")
        extra = ",\n" + ctes.strip()[5:]
    return f"WITH {needed}{extra}\nSELECT {picked} FROM (\n{body}\n)"
