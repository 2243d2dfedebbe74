"""Registered queries: payload, figure lineage, evidence checks, artifact sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.operators import evidence as E
from leaseloom.operators import payload as P
from leaseloom.operators import pieces
from leaseloom.operators.digests import digest_tree, stale_books
from leaseloom.plans import driver_tables as D
from leaseloom.plans.catalog import Context, register
from leaseloom.plans.queries_marts import _INSIGHT_SQL, _RUNS_SQL
from leaseloom.plans.reviews import import_insights
from leaseloom.sources import sinks
from leaseloom.sources.documents import stored_payload_paths
from leaseloom.sources.folders import shared_folder
from leaseloom.sources.grids import insight_source
from leaseloom.sources.versions import Store, replace_snapshot_insights

_SUMS = "units occupied_units vacant_units non_revenue_units future_leases market_rent lease_charges square_feet balance".split()

# section -> (rows in SQL, order, columns in payload order)
SECTION_SQL: dict[str, tuple[str, str, str]] = {
    "portfolio": ("SELECT snapshot_id, " + ", ".join(f"sum({c}) AS {c}" for c in _SUMS)
                  + ", round(100.0 * sum(occupied_units) / nullif(sum(units), 0), 2) AS pct_occupied, count(*) AS property_count FROM kpi GROUP BY 1", "1",
                  "units occupied_units vacant_units non_revenue_units future_leases pct_occupied market_rent lease_charges square_feet balance property_count"),
    "properties": ("SELECT * FROM kpi", "property_code",
                   "property_code property_name book_type asset_key units occupied_units notice_units vacant_units non_revenue_units future_leases pct_occupied"
                   " market_rent lease_charges square_feet balance"),
    "assets": ("SELECT * FROM asset", "asset_key",
               "asset_key asset_label book_count property_codes units occupied_units vacant_units non_revenue_units pct_occupied market_rent lease_charges square_feet balance"),
    "charge_mix": ("SELECT snapshot_id, property_code, category, sum(line_count) AS line_count, sum(amount) AS amount FROM mix JOIN prop USING (property_id) GROUP BY 1, 2, 3",
                   "property_code, category", "property_code category line_count amount"),
    "expirations": ("SELECT e.*, property_code FROM ladder e JOIN prop USING (property_id) JOIN snap s ON s.snapshot_id = e.snapshot_id"
                    " WHERE expiry_month <= as_of_date + INTERVAL 12 MONTH", "property_code, expiry_month",
                    "property_code expiry_month expiring_leases charges_at_risk holdover_mtm"),
    "loss_to_lease": ("SELECT * FROM book_ltl JOIN prop USING (property_id)", "property_code", "property_code units market_rent contract_rent concessions loss_to_lease"),
    "matrix": ("SELECT * FROM matrix WHERE plottable", "revenue_capture_pct, property_code",
               "property_code property_name book_type quadrant revenue_capture_pct pct_occupied units occupied_units vacant_units notice_units market_rent lease_charges"
               " charges_to_threshold units_to_threshold loss_to_lease concessions ancillary_charges units_owing balance_owed capture_threshold occupancy_threshold"),
    "reconciliation": ("SELECT * FROM recon WHERE coalesce(unit_delta, 0) <> 0 OR coalesce(charge_delta, 0) <> 0 OR detail_occupied <> coalesce(availability_occupied, detail_occupied)",
                       "property_code", "property_code detail_units availability_units unit_delta detail_occupied availability_occupied charge_delta"),
    "data_quality": (f"SELECT r.snapshot_id, rule, severity, count(*) AS n FROM issue JOIN {_RUNS_SQL} r USING (run_id) GROUP BY 1, 2, 3", "rule, severity", "rule severity n"),
    "trend": ("SELECT *, d_pct_occupied + 0.0 AS d_pct FROM trend", "property_code",
              "property_code prior_as_of d_pct_occupied d_market_rent d_lease_charges d_balance d_notice_units"),
}


def _paths_sql() -> str:
    """The payload's paths as one view `path(snapshot_id, section_no, i, col_no, sub, path, raw, value)`."""
    ctes, selects = [], ["SELECT snapshot_id, 0 AS section_no, 0 AS i, 0 AS col_no, 0 AS sub, '$.as_of' AS path, CAST(as_of_date AS VARCHAR) AS raw FROM snap",
                         "SELECT snapshot_id, 0, 0, 1, 0, '$.report_month', CAST(report_month AS VARCHAR) FROM snap"]
    for no, (name, (rows, order, columns)) in enumerate(SECTION_SQL.items(), start=1):
        ctes.append(f"sec_{name} AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {order}) - 1 AS i FROM ({rows}))")
        base = "'$.portfolio.'" if name == "portfolio" else f"'$.{name}[' || i || '].'"
        for k, col in enumerate(columns.split()):
            if col == "property_codes":
                selects.append(f"SELECT snapshot_id, {no}, i, {k}, j - 1, {base} || '{col}[' || (j - 1) || ']', string_split(property_codes, ',')[j]"
                               f" FROM (SELECT *, unnest(range(1, book_count + 1)) AS j FROM sec_{name})")
            else:
                at = "0" if name == "portfolio" else "i"
                selects.append(f"SELECT snapshot_id, {no}, {at}, {k}, 0, {base} || '{col}', CAST({col} AS VARCHAR) FROM sec_{name} WHERE {col} IS NOT NULL")
    for k, (name, (metric, down)) in enumerate(P.RANKINGS.items()):
        ctes.append(f"rank_{name} AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {metric} {'DESC' if down else 'ASC'}, property_code) - 1 AS i"
                    f" FROM kpi WHERE units > 0 AND {metric} IS NOT NULL)")
        for j, col in enumerate(("property_code", metric, "units")):
            selects.append(f"SELECT snapshot_id, {len(SECTION_SQL) + 1 + k}, i, {j}, 0, '$.rankings.{name}[' || i || '].{col}', CAST({col} AS VARCHAR) FROM rank_{name} WHERE i < 5")
    norm = ("CASE WHEN regexp_matches(raw, '^-?[0-9]+(\\.[0-9]+)?$') THEN CASE WHEN contains(raw, '.') THEN regexp_replace(regexp_replace(regexp_replace(raw, '0+$', ''), '\\.$', ''), '^-0$', '0')"
            " ELSE raw END ELSE lower(raw) END")
    body = "\n UNION ALL ".join(selects)
    return ",\n".join(ctes) + f",\npath AS (SELECT *, {norm} AS value FROM (\n{body}\n))"


_PATHS = _paths_sql()
_RANK_UNION = " UNION ALL ".join(
    f"SELECT snapshot_id, '{n}' AS ranking, i + 1 AS place, property_code, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, units FROM rank_{n} WHERE i < 5"
    for n, (m, _) in P.RANKINGS.items())


def _sizes(c: Context) -> DataFrame:
    out = None
    for name in P.SECTION_ORDER:
        n = c.sections[name].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select("snapshot_id", F.lit(name).alias("section"), "n")
        out = n if out is None else out.unionByName(n)
    return out


register("i1_payload_sections", "snapshot_id:i section:s n:i", _sizes,
         "WITH " + _PATHS + "\n---\n" + " UNION ALL ".join(f"SELECT snapshot_id, '{n}' AS section, count(*) AS n FROM sec_{n} GROUP BY 1" for n in SECTION_SQL))
register("i1_payload_expirations", "snapshot_id:i property_code:s expiry_month:t expiring_leases:i charges_at_risk:d holdover_mtm:i",
         lambda c: c.sections["expirations"], "WITH " + _PATHS + "\n---\nSELECT * FROM sec_expirations")
register("i1_payload_charge_mix", "snapshot_id:i property_code:s category:s line_count:i amount:d", lambda c: c.sections["charge_mix"],
         "WITH " + _PATHS + "\n---\nSELECT * FROM sec_charge_mix")
register("i2_rankings", "snapshot_id:i ranking:s place:i property_code:s metric:s value:d units:i", lambda c: c.sections["rankings"],
         "WITH " + _PATHS + "\n---\n" + _RANK_UNION)


def _part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("snapshot_id", "chunk", "part").agg(F.count(F.lit(1)).alias("n"))


_ASSET_SQL = (
    "SELECT snapshot_id, 'map:' || asset_key AS chunk, unnest(['as_of','asset','portfolio_context']) AS part, 1 AS n FROM asset"
    " UNION ALL SELECT snapshot_id, 'map:' || asset_key, 'properties', count(*) FROM kpi GROUP BY 1, 2"
    + "".join(f" UNION ALL SELECT snapshot_id, 'map:' || asset_key, '{s}', count(*) FROM (SELECT snapshot_id, property_code FROM sec_{s}) JOIN (SELECT property_code, asset_key FROM prop)"
              " USING (property_code) GROUP BY 1, 2" for s in ("charge_mix", "expirations", "loss_to_lease", "reconciliation")))
register("i3_asset_chunks", "snapshot_id:i chunk:s part:s n:i", lambda c: _part_sizes(P.asset_chunks(c.sections)), "WITH " + _PATHS + "\n---\n" + _ASSET_SQL)


def _asset_documents(c: Context) -> DataFrame:
    parts = P.asset_chunks(c.sections)
    fit = P.chunk_fit(P.chunk_sizes(parts, P.ASSET_PARTS), num_ctx=2000)
    return P.assemble_chunks(parts, fit, P.ASSET_PARTS)


register("i3_asset_documents", "snapshot_id:i chunk:s document:s needed:i num_ctx:i reason:s", _asset_documents)
register("i4_positioning_chunks", "snapshot_id:i chunk:s capture:d units:i property_count:i as_of:s",
         lambda c: P.positioning_chunks(c.sections).select(
             "snapshot_id", "chunk", F.get_json_object("document", "$.property.revenue_capture_pct").alias("capture"), F.get_json_object("document", "$.property.units").alias("units"),
             F.get_json_object("document", "$.portfolio_context.property_count").alias("property_count"), F.get_json_object("document", "$.as_of").alias("as_of")),
         "SELECT snapshot_id, 'positioning:' || property_code AS chunk, revenue_capture_pct AS capture, units, count(*) OVER (PARTITION BY snapshot_id) AS property_count,"
         " as_of_date AS as_of FROM matrix WHERE plottable")


def _headlines(c: Context) -> DataFrame:
    return c.sections["assets"].select("snapshot_id", "asset_key", F.concat(F.lit("Occupancy "), F.col("pct_occupied").cast("string")).alias("headline"))


register("i5_reduce_chunk", "snapshot_id:i chunk:s part:s n:i", lambda c: _part_sizes(P.reduce_chunk(c.sections, _headlines(c))),
         "WITH " + _PATHS + "\n---\nSELECT snapshot_id, 'reduce' AS chunk, unnest(['as_of','portfolio','rankings']) AS part, 1 AS n FROM sec_portfolio"
         " UNION ALL SELECT snapshot_id, 'reduce', 'asset_findings', count(*) FROM asset GROUP BY 1"
         " UNION ALL SELECT snapshot_id, 'reduce', 'data_quality', count(*) FROM sec_data_quality GROUP BY 1"
         " UNION ALL SELECT snapshot_id, 'reduce', 'reconciliation', count(*) FROM sec_reconciliation GROUP BY 1")
# ---- the length of a chunk's document, summed from what each row prints -------
_COUNTS = set("units occupied_units notice_units vacant_units non_revenue_units future_leases square_feet property_count book_count line_count expiring_leases"
              " holdover_mtm units_to_threshold units_owing detail_units availability_units unit_delta detail_occupied availability_occupied n d_notice_units".split())
_TEXTS = set("property_code property_name book_type asset_key asset_label category expiry_month quadrant rule severity prior_as_of headline".split())


def _json_length(columns: str) -> str:
    """SQL for the length of a row printed as compact JSON without its nulls."""
    def one(c: str) -> str:
        if c == "property_codes":
            return f"{len(c) + 4} + length({c}) + 2 * book_count + 2"
        if c in _COUNTS:
            shown = f"length(CAST(CAST({c} AS BIGINT) AS VARCHAR))"
        elif c in _TEXTS:
            shown = f"2 + length(CAST({c} AS VARCHAR))"
        else:
            shown = f"2 + length(CAST(CAST({c} AS DECIMAL(24,{1 if c.endswith('_threshold') and not c.startswith('charges') else 2})) AS VARCHAR))"
        return f"coalesce({len(c) + 4} + {shown}, 0)"

    return " + ".join(one(c) for c in columns.split()) + " + 1"


def _frame(expected: dict[str, bool]) -> int:
    return 2 + sum(len(k) + 3 for k in expected) + len(expected) - 1 + 2 * sum(expected.values()) + len('"YYYY-MM-DD"')


def _lists(names: list[str], chunk: str) -> str:
    """Characters of the list parts: rows plus the commas between them."""
    return "".join(
        f" UNION ALL SELECT s.snapshot_id, {chunk}, sum({_json_length(SECTION_SQL[n][2])}) + count(*) - 1 FROM sec_{n} s"
        + (" JOIN (SELECT property_code AS pc, asset_key AS ak FROM prop) ON pc = property_code" if "ak" in chunk else "") + " GROUP BY 1, 2" for n in names)


_CONTEXT = _json_length("pct_occupied property_count units")
_ASSET_LENGTHS = (
    f"SELECT a.snapshot_id, 'map:' || asset_key AS chunk, {_json_length(SECTION_SQL['assets'][2])} AS chars FROM sec_assets a"
    f" UNION ALL SELECT a.snapshot_id, 'map:' || a.asset_key, c FROM sec_assets a JOIN (SELECT snapshot_id, {_CONTEXT} AS c FROM sec_portfolio) USING (snapshot_id)"
    + _lists(["properties", "charge_mix", "expirations", "loss_to_lease", "reconciliation"], "'map:' || ak"))
_RANK_LENGTHS = " UNION ALL ".join(
    f"SELECT snapshot_id, sum({_json_length(f'property_code {m} units')}) + count(*) - 1 + {len(n) + 5} AS c FROM rank_{n} WHERE i < 5 GROUP BY 1" for n, (m, _) in P.RANKINGS.items())
_REDUCE_LENGTHS = (
    f"SELECT snapshot_id, 'reduce' AS chunk, {_json_length(SECTION_SQL['portfolio'][2])} AS chars FROM sec_portfolio"
    f" UNION ALL SELECT snapshot_id, 'reduce', sum(c) + count(*) - 1 + 2 FROM ({_RANK_LENGTHS}) GROUP BY 1"
    f" UNION ALL SELECT snapshot_id, 'reduce', sum({_json_length('asset_key headline')}) + count(*) - 1 FROM"
    " (SELECT snapshot_id, asset_key, 'Occupancy ' || CAST(pct_occupied AS DECIMAL(24,2)) AS headline FROM asset) GROUP BY 1"
    + _lists(["data_quality", "reconciliation"], "'reduce'"))


def _fit_sql(parts: str, expected: dict[str, bool], num_ctx: int) -> str:
    return (f"SELECT snapshot_id, chunk, length, tokens, floor(CAST(tokens AS DOUBLE) * CAST(1.3 AS DOUBLE)) AS needed, CAST(tokens AS DOUBLE) * CAST(1.3 AS DOUBLE) <= {num_ctx} AS fits FROM (SELECT snapshot_id, chunk, length,"
            f" greatest(1, length // 4) AS tokens FROM (SELECT snapshot_id, chunk, CAST(sum(chars) AS BIGINT) + {_frame(expected)} AS length FROM ({parts}) GROUP BY 1, 2))")


register("i6_chunk_fit", "snapshot_id:i chunk:s length:i tokens:i needed:i fits:b",
         lambda c: P.chunk_fit(P.chunk_sizes(P.asset_chunks(c.sections), P.ASSET_PARTS), num_ctx=1500).unionByName(
             P.chunk_fit(P.chunk_sizes(P.reduce_chunk(c.sections, _headlines(c)), P.REDUCE_PARTS), num_ctx=4096)),
         "WITH " + _PATHS + "\n---\n" + _fit_sql(_ASSET_LENGTHS, P.ASSET_PARTS, 1500) + " UNION ALL " + _fit_sql(_REDUCE_LENGTHS, P.REDUCE_PARTS, 4096))
# `needed` is rounded down: a refused chunk may need num_ctx and a fraction
register("i3_asset_document_verdicts", "snapshot_id:i chunk:s refused:i made:i num_ctx:i",
         lambda c: _asset_documents(c).groupBy("snapshot_id", "chunk").agg(
             F.count_if(F.col("document").isNull() & (F.col("needed") >= F.col("num_ctx")) & F.col("reason").isNotNull()).alias("refused"),
             F.count_if(F.col("document").isNotNull() & (F.col("needed") <= F.col("num_ctx")) & F.col("reason").isNull()).alias("made"),
             F.max("num_ctx").alias("num_ctx")),
         "WITH " + _PATHS + "\n---\nSELECT snapshot_id, chunk, CAST(NOT fits AS INT) AS refused, CAST(fits AS INT) AS made, 2000 AS num_ctx FROM ("
         + _fit_sql(_ASSET_LENGTHS, P.ASSET_PARTS, 2000) + ")")
_POSITIONING_LENGTHS = (
    f"SELECT m.snapshot_id, 'positioning:' || property_code AS chunk, {_json_length(SECTION_SQL['matrix'][2])} + c + {len('{"as_of":"YYYY-MM-DD","portfolio_context":,"property":}')} AS length FROM sec_matrix m"
    f" JOIN (SELECT snapshot_id, {_json_length('property_count capture_threshold occupancy_threshold pct_occupied')} AS c FROM"
    " (SELECT snapshot_id, count(*) AS property_count, max(capture_threshold) AS capture_threshold, max(occupancy_threshold) AS occupancy_threshold FROM sec_matrix GROUP BY 1)"
    " JOIN (SELECT snapshot_id, pct_occupied FROM sec_portfolio) USING (snapshot_id)) USING (snapshot_id)")


def _sized(parts: str, expected: dict[str, bool]) -> str:
    return f"SELECT snapshot_id, chunk, CAST(sum(chars) AS BIGINT) + {_frame(expected)} AS length FROM ({parts}) GROUP BY 1, 2"


register("i6_size_report", "snapshot_id:i kind:s chunk:s length:i tokens:i fits:b",
         lambda c: pieces.size_report(P.asset_chunks(c.sections), P.positioning_chunks(c.sections), P.reduce_chunk(c.sections, _headlines(c)), num_ctx=1500),
         "WITH " + _PATHS + "\n---\nSELECT *, string_split(chunk, ':')[1] AS kind, greatest(1, length // 4) AS tokens,"
         " CAST(greatest(1, length // 4) AS DOUBLE) * CAST(1.3 AS DOUBLE) <= 1500 AS fits FROM ("
         + f"{_sized(_ASSET_LENGTHS, P.ASSET_PARTS)} UNION ALL {_sized(_REDUCE_LENGTHS, P.REDUCE_PARTS)} UNION ALL {_POSITIONING_LENGTHS})")

_SPLIT_AT = (2000, 700)
_SEQ = {"properties": "property_code", "charge_mix": "property_code || '|' || category", "expirations": "property_code || '|' || expiry_month",
        "loss_to_lease": "property_code", "reconciliation": "property_code"}


def _split(c: Context) -> DataFrame:
    """Every piece at two sizes, with the rows and characters of its document."""
    parts, every = P.asset_chunks(c.sections), None
    for num_ctx in _SPLIT_AT:
        made = pieces.split_documents(parts, P.ASSET_PARTS, num_ctx)
        rows = sum((F.coalesce(F.json_array_length(F.get_json_object("document", f"$.{name}")), F.lit(0)) for name in _SEQ), F.lit(0))
        one = made.select("snapshot_id", "chunk", F.lit(num_ctx).alias("num_ctx"), "piece", "pieces", rows.alias("rows"), F.length("document").alias("length"))
        every = one if every is None else every.unionByName(one)
    return every


def _split_sql(num_ctx: int) -> str:
    """The pieces by a running sum: what fits is the most characters whose quarter, rounded down, times 1.3 is within the context."""
    most = f"(4 * CAST(floor({num_ctx} / 1.3) AS BIGINT) + 3)"
    rows = " UNION ALL ".join(
        f"SELECT s.snapshot_id, 'map:' || ak AS chunk, '{n}' AS part, {seq} AS seq, {_json_length(SECTION_SQL[n][2])} AS chars FROM sec_{n} s"
        " JOIN (SELECT property_code AS pc, asset_key AS ak FROM prop) ON pc = property_code" for n, seq in _SEQ.items())
    single = _ASSET_LENGTHS[:_ASSET_LENGTHS.index(" UNION ALL SELECT s.snapshot_id")]
    return f"""SELECT snapshot_id, chunk, {num_ctx} AS num_ctx, piece, max(piece) OVER (PARTITION BY snapshot_id, chunk) AS pieces, rows, length FROM (
 SELECT snapshot_id, chunk, piece, count(*) AS rows, max(fixed) + sum(chars) + count(*) - count(DISTINCT part) AS length FROM (
  SELECT *, dense_rank() OVER (PARTITION BY snapshot_id, chunk ORDER BY CASE WHEN whole THEN 0 ELSE begins // ({most} - fixed - longest) END) AS piece FROM (
   SELECT *, fixed + sum(chars) OVER (PARTITION BY snapshot_id, chunk) + count(*) OVER (PARTITION BY snapshot_id, chunk) - kinds <= {most} AS whole FROM (
    SELECT *, sum(chars + 1) OVER (PARTITION BY snapshot_id, chunk ORDER BY part, seq ROWS UNBOUNDED PRECEDING) - chars - 1 AS begins,
           max(chars) OVER (PARTITION BY snapshot_id, chunk) AS longest
    FROM ({rows}) JOIN (SELECT snapshot_id, chunk, sum(chars) + {_frame(P.ASSET_PARTS)} AS fixed FROM ({single}) GROUP BY 1, 2) USING (snapshot_id, chunk)
         JOIN (SELECT snapshot_id, chunk, count(DISTINCT part) AS kinds FROM ({rows}) GROUP BY 1, 2) USING (snapshot_id, chunk))))
 GROUP BY snapshot_id, chunk, piece)"""


register("i3_split_documents", "snapshot_id:i chunk:s num_ctx:i piece:i pieces:i rows:i length:i", _split,
         "WITH " + _PATHS + "\n---\n" + " UNION ALL ".join(_split_sql(n) for n in _SPLIT_AT))
register("i7_flatten_paths", "snapshot_id:i path:s value:s", lambda c: c.paths, "WITH " + _PATHS + "\n---\nSELECT * FROM path")


def _figures(c: Context) -> DataFrame:
    """The figures a report on each scored book would cite."""
    return c.matrix.filter("plottable").select("snapshot_id", F.explode(F.array(
        F.concat(F.col("pct_occupied").cast("string"), F.lit("%")), F.col("units").cast("string"), F.lit("0"), F.lit("no such figure"))).alias("figure"))


register("i8_find_paths", "snapshot_id:i figure:s path:s place:i", lambda c: P.find_paths(c.paths, _figures(c)),
         "WITH " + _PATHS + ",\nasked AS (SELECT DISTINCT snapshot_id, figure, CASE WHEN contains(figure, '.') THEN regexp_replace(regexp_replace(replace(figure, '%', ''), '0+$', ''), '\\.$', '')"
         " ELSE figure END AS value FROM (SELECT snapshot_id, unnest([format('{:.2f}', pct_occupied) || '%', CAST(units AS VARCHAR), '0', 'no such figure']) AS figure FROM matrix WHERE plottable))"
         "\n---\nSELECT snapshot_id, figure, path, place FROM asked JOIN (SELECT *, row_number() OVER (PARTITION BY snapshot_id, value ORDER BY section_no, i, col_no, sub) AS place FROM path)"
         " USING (snapshot_id, value) WHERE place <= 12")


def _insights(c: Context) -> DataFrame:
    return D.insight_frame(c.spark, c.matrix)


def _targets(c: Context) -> tuple[DataFrame, DataFrame]:
    return E.known_targets(c.T.property)


_TARGET = "insight_id:i scope:s property_code:s asset_key:s"
_FIXED = ("CASE WHEN n % 6 = 0 THEN 'property' ELSE scope END AS scope, CASE WHEN n % 6 = 0 THEN book WHEN n % 17 = 0 THEN NULL WHEN n % 23 = 0 THEN '999x' ELSE book END AS property_code,"
          " NULL AS asset_key")
register("i9_normalise_target", _TARGET, lambda c: E.normalise_target(_insights(c), *_targets(c)), _INSIGHT_SQL + f"SELECT insight_id, {_FIXED} FROM ins")
_REASONS = "insight_id:i reason:s"
register("i10_evidence_gate_dropped", _REASONS, lambda c: E.evidence_gate(_insights(c), c.paths, *_targets(c))[1],
         _INSIGHT_SQL + "SELECT * FROM (SELECT insight_id, CASE WHEN scope = 'portfolio' AND (property_code IS NOT NULL OR asset_key IS NOT NULL) THEN 'scope/target mismatch'"
         " WHEN scope = 'property' AND asset_key IS NOT NULL THEN 'scope/target mismatch' WHEN scope = 'asset' THEN 'asset target ''' || asset_key || ''' does not exist'"
         " WHEN scope = 'property' AND property_code <> book THEN 'property target ''' || property_code || ''' does not exist'"
         " WHEN n % 5 = 0 THEN 'evidence value ''' || units || '.125'' is not in the payload' END AS reason FROM ins) WHERE reason IS NOT NULL")
register("i10_evidence_gate_kept", "insight_id:i", lambda c: E.evidence_gate(E.normalise_target(_insights(c), *_targets(c)), c.paths, *_targets(c))[0],
         _INSIGHT_SQL + "SELECT insight_id FROM ins WHERE n % 5 <> 0 AND (n % 6 = 0 OR n % 17 = 0 OR n % 23 <> 0)")
_GATE = "snapshot_id:i read:i kept:i dropped:i inserted:i stale:b status:s error:s"
_GATE_SQL = (_INSIGHT_SQL + "SELECT *, {inserted} AS inserted, {status} AS status, {error} AS error FROM (SELECT snapshot_id, count(*) AS read, true AS stale,"
             " count(*) FILTER (WHERE n % 5 <> 0 AND (n % 6 = 0 OR n % 17 = 0 OR n % 23 <> 0)) AS kept,"
             " count(*) FILTER (WHERE NOT (n % 5 <> 0 AND (n % 6 = 0 OR n % 17 = 0 OR n % 23 <> 0))) AS dropped FROM ins GROUP BY 1)")
register("i11_import_gate", _GATE, lambda c: E.import_gate(_insights(c), c.paths, *_targets(c), allow_stale=True)[0],
         _GATE_SQL.format(inserted="kept", status="'succeeded'", error="NULL"))
register("i11_import_gate_stale", _GATE, lambda c: E.import_gate(_insights(c), c.paths, *_targets(c))[0],
         _GATE_SQL.format(inserted="0", status="'refused'", error="'payload changed since generation'"))


def _import_runs(c: Context) -> DataFrame:
    """Three imports of one artifact: refused as stale, let in, and let in again over what is there."""
    out, T = shared_folder(c.spark), c.T.with_frames(insight_run=None)
    for allow in (False, True, True):
        T, _ = import_insights(T, _insights(c), c.paths, *_targets(c), out, allow_stale=allow)
    stored = T.insight.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("stored"))
    turn = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("insight_run_id"))
    return T.insight_run.withColumn("turn", turn).join(stored, "snapshot_id")


register("i11_import_runs", "snapshot_id:i turn:i status:s note:s kept:i dropped:i replaced:i stored:i", _import_runs,
         _INSIGHT_SQL + "SELECT snapshot_id, turn, CASE turn WHEN 1 THEN 'refused' ELSE 'succeeded' END AS status, CASE turn WHEN 1 THEN 'payload changed since generation'"
         " ELSE 'imported although the payload changed since generation' END AS note, kept, dropped, CASE turn WHEN 3 THEN kept ELSE 0 END AS replaced, kept AS stored"
         " FROM (SELECT snapshot_id, count(*) FILTER (WHERE n % 5 <> 0 AND (n % 6 = 0 OR n % 17 = 0 OR n % 23 <> 0)) AS kept,"
         " count(*) FILTER (WHERE NOT (n % 5 <> 0 AND (n % 6 = 0 OR n % 17 = 0 OR n % 23 <> 0))) AS dropped FROM ins GROUP BY 1), (VALUES (1), (2), (3)) AS t(turn)")


def _per_book(c: Context) -> DataFrame:
    return _insights(c).withColumn("book", F.regexp_extract("headline", r"^Occupancy of (\S+) at", 1))


register("i12_positioning_priority", "insight_id:i scope:s property_code:s asset_key:s category:s priority:s",
         lambda c: E.positioning_priority(_per_book(c), c.matrix),
         _INSIGHT_SQL + "SELECT insight_id, 'property' AS scope, book AS property_code, NULL AS asset_key, 'positioning' AS category,"
         " CASE quadrant WHEN 'distressed' THEN 'high' WHEN 'performing' THEN 'low' ELSE 'medium' END AS priority FROM ins")
register("i12_first_per_book", "snapshot_id:i property_code:s insight_id:i",
         lambda c: E.first_per_book(_per_book(c).unionByName(_per_book(c).withColumn("insight_id", F.col("insight_id") + 100000)).withColumn("property_code", F.col("book"))),
         _INSIGHT_SQL + "SELECT snapshot_id, book AS property_code, insight_id FROM ins")
_GAP = "'$' || format('{:,.2f}', CAST(charges_to_threshold AS DOUBLE))"
_MOST = "greatest(concessions, loss_to_lease, balance_owed)"
_CAUSE = f"CASE WHEN concessions = {_MOST} THEN 'concessions' WHEN loss_to_lease = {_MOST} THEN 'loss_to_lease' ELSE 'balance_owed' END"
_SHORT = {"no_units": "Not scored: no units in this book", "no_market_rent": "Not scored: no market rent printed", "no_charge_data": "Not scored: no lease-charge lines"}
_LONG = {
    "no_units": "No current lease row belongs to this book on the report date, so neither axis of the matrix has a value.",
    "no_market_rent": "Asking rents add up to nothing in this report; without them billed revenue has nothing to be measured against.",
    "no_charge_data": "Under half of the current leases come with charge lines. Capture would read low for want of data, so it is left open."}
_TITLES = {"performing": "Performing: defend the position", "vacancy_led": "Vacancy-led: lease up the empty units",
           "leaking": "Leaking: full but under-collecting", "distressed": "Distressed: empty and underpriced"}
register("i13_positioning_fallback", "snapshot_id:i property_code:s headline:s detail:s evidence:s quadrant:s",
         lambda c: E.positioning_fallback(c.matrix),
         "SELECT snapshot_id, property_code, quadrant, CASE exclusion_reason "
         + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SHORT.items())
         + " ELSE CASE quadrant " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLES.items()) + " END END AS headline,"
         " CASE exclusion_reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LONG.items()) + " ELSE CASE quadrant"
         f" WHEN 'performing' THEN 'On target on both axes. Keep the ' || notice_units || ' notice units let; the capture line is ' || {_GAP} || ' away.'"
         " WHEN 'vacancy_led' THEN 'Billing holds up, letting does not: ' || units_to_threshold || ' more units must be occupied, with ' || vacant_units ||"
         " ' standing empty and ' || notice_units || ' more about to.'"
         f" WHEN 'leaking' THEN 'Units are let but ' || {_GAP} || ' of monthly billing is missing. Look first at ' || replace({_CAUSE}, '_', ' ') ||"
         f" ', which come to $' || format('{{:,.2f}}', CAST({_MOST} AS DOUBLE)) || '.'"
         " ELSE CASE WHEN CAST(charges_to_threshold AS DOUBLE) / market_rent >= units_to_threshold / units"
         f" THEN 'Money is further away than tenants: ' || {_GAP} || ' of billing is missing against ' || units_to_threshold || ' units to let.'"
         f" ELSE 'Tenants are further away than money: ' || units_to_threshold || ' units to let against ' || {_GAP} || ' of missing billing.' END END END AS detail,"
         " CASE WHEN exclusion_reason IS NOT NULL THEN '[]' WHEN quadrant = 'performing' THEN '[{\"metric\":\"notice_units\",\"value\":\"' || notice_units || '\"},{\"metric\":\"charges_to_threshold\",\"value\":\"' || "
         + _GAP + " || '\"}]' WHEN quadrant = 'vacancy_led' THEN '[{\"metric\":\"units_to_threshold\",\"value\":\"' || units_to_threshold || '\"},{\"metric\":\"vacant_units\",\"value\":\"' || vacant_units ||"
         " '\"},{\"metric\":\"notice_units\",\"value\":\"' || notice_units || '\"}]' WHEN quadrant = 'leaking' THEN '[{\"metric\":\"charges_to_threshold\",\"value\":\"' || " + _GAP
         + " || '\"},{\"metric\":\"' || " + _CAUSE + " || '\",\"value\":\"$' || format('{:,.2f}', CAST(" + _MOST + " AS DOUBLE)) || '\"}]' ELSE '[{\"metric\":\"charges_to_threshold\",\"value\":\"' || "
         + _GAP + " || '\"},{\"metric\":\"units_to_threshold\",\"value\":\"' || units_to_threshold || '\"}]' END AS evidence FROM matrix")


def _some_current(c: Context) -> DataFrame:
    """Findings of even years carry the hash the payload has now."""
    now = P.fingerprint(c.paths)
    return _insights(c).join(now, "snapshot_id").withColumn(
        "prompt_sha256", F.when(F.col("snapshot_id") % 2 == 0, F.col("payload_sha256")).otherwise(F.col("prompt_sha256"))).drop("payload_sha256")


register("i14_staleness", "insight_id:i snapshot_id:i stale:b", lambda c: E.staleness(_some_current(c), c.paths),
         _INSIGHT_SQL + "SELECT insight_id, snapshot_id, snapshot_id % 2 <> 0 AS stale FROM ins")
register("i15_generation_skip", "snapshot_id:i model:s",
         lambda c: E.generation_skip(
             c.matrix.filter("plottable").groupBy("snapshot_id", F.col("quadrant").alias("model")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("prompt_sha256")),
             c.matrix.filter("plottable").groupBy("snapshot_id", F.col("quadrant").alias("model")).agg(F.count(F.lit(1)).alias("n")).select(
                 "snapshot_id", "model", F.sha2(F.when(F.col("model") == "leaking", F.lit("0")).otherwise(F.col("n").cast("string")), 256).alias("prompt_sha256"),
                 F.when(F.col("n") > 4, "succeeded").otherwise("failed").alias("status"))),
         "SELECT snapshot_id, quadrant AS model FROM matrix WHERE plottable AND quadrant <> 'leaking' GROUP BY 1, 2 HAVING count(*) > 4")

# ---- the digest tree: a row's figures, its book, branch, section and snapshot --------
_BOOK_OF = {"portfolio": "''", "assets": "asset_key", "data_quality": "rule"}
_TREE = (
    "WITH " + _PATHS + ",\nnamed AS ("
    + " UNION ALL ".join(f"SELECT snapshot_id, {no} AS section_no, '{name}' AS section, {'0' if name == 'portfolio' else 'i'} AS i, {_BOOK_OF.get(name, 'property_code')} AS book FROM sec_{name}"
                         for no, name in enumerate(SECTION_SQL, start=1))
    + "),\nrowdig AS (SELECT n.snapshot_id, n.section, n.book, n.i, sha256(string_agg(regexp_replace(path, '^\\$\\.[a-z_]+(\\[[0-9]+\\])?\\.', '') || '=' || value, chr(10) ORDER BY col_no, sub)) AS digest"
    " FROM named n JOIN path p ON p.snapshot_id = n.snapshot_id AND p.section_no = n.section_no AND p.i = n.i GROUP BY 1, 2, 3, 4),\n"
    "bookdig AS (SELECT snapshot_id, section, substring(sha256(book), 1, 3) AS branch, book, sha256(string_agg('=' || digest, chr(10) ORDER BY digest)) AS digest FROM rowdig GROUP BY 1, 2, 3, 4),\n"
    "branchdig AS (SELECT snapshot_id, section, branch, sha256(string_agg(book || '=' || digest, chr(10) ORDER BY book || '=' || digest)) AS digest FROM bookdig GROUP BY 1, 2, 3),\n"
    "sectiondig AS (SELECT snapshot_id, section, sha256(string_agg(branch || '=' || digest, chr(10) ORDER BY branch)) AS digest FROM branchdig GROUP BY 1, 2)\n---\n"
    "SELECT snapshot_id, 'book' AS level, section, branch, book, digest FROM bookdig UNION ALL SELECT snapshot_id, 'branch', section, branch, NULL, digest FROM branchdig"
    " UNION ALL SELECT snapshot_id, 'section', section, NULL, NULL, digest FROM sectiondig"
    " UNION ALL SELECT snapshot_id, 'snapshot', NULL, NULL, NULL, sha256(string_agg(section || '=' || digest, chr(10) ORDER BY section || '=' || digest)) FROM sectiondig GROUP BY 1")
register("i14_digest_tree", "snapshot_id:i level:s section:s branch:s book:s digest:s", lambda c: digest_tree(c.sections), _TREE)


def _moved_sections(c: Context) -> dict[str, DataFrame]:
    """The payload after the rent of every affordable book went up, one book lost its ladder of 1997, and the portfolio of 1996 a count."""
    rent = F.when(F.col("property_code").endswith("a"), F.col("market_rent") + 1).otherwise(F.col("market_rent")).cast("decimal(38,2)")
    return c.sections | {
        "properties": c.sections["properties"].withColumn("market_rent", rent),
        "expirations": c.sections["expirations"].filter("not (snapshot_id = 1997 and property_code = '100r')"),
        "portfolio": c.sections["portfolio"].withColumn("property_count", F.col("property_count") + (F.col("snapshot_id") == 1996).cast("int"))}


register("i14_stale_books", "snapshot_id:i section:s book:s change:s", lambda c: stale_books(digest_tree(c.sections), digest_tree(_moved_sections(c))),
         "WITH " + _PATHS + "\n---\nSELECT snapshot_id, 'properties' AS section, property_code AS book, 'changed' AS change FROM sec_properties WHERE property_code LIKE '%a'"
         " UNION ALL SELECT DISTINCT snapshot_id, 'expirations', property_code, 'removed' FROM sec_expirations WHERE snapshot_id = 1997 AND property_code = '100r'"
         " UNION ALL SELECT snapshot_id, 'portfolio', '', 'changed' FROM sec_portfolio WHERE snapshot_id = 1996")

# ---- artifacts and exports ---------------------------------------------------


def _exported_payload(c: Context) -> DataFrame:
    out = shared_folder(c.spark)
    sinks.payload_export({n: c.sections[n] for n in P.SECTION_ORDER}, out)
    lines = c.spark.read.text([f"{out}/{n}" for n in P.SECTION_ORDER]).select(
        F.element_at(F.split(F.input_file_name(), "/"), -2).alias("section"), F.get_json_object("value", "$.snapshot_id").alias("snapshot_id"))
    return lines.groupBy("snapshot_id", "section").agg(F.count(F.lit(1)).alias("n"))


register("s5_payload_export", "snapshot_id:i section:s n:i", _exported_payload,
         "WITH " + _PATHS + "\n---\n" + " UNION ALL ".join(f"SELECT snapshot_id, '{n}' AS section, count(*) AS n FROM sec_{n} GROUP BY 1" for n in SECTION_SQL))


def _stored_paths(c: Context) -> DataFrame:
    out = shared_folder(c.spark)
    sinks.payload_export({n: c.sections[n] for n in P.SECTION_ORDER}, out)
    return stored_payload_paths(c.spark, out)


register("i7_stored_payload_paths", "snapshot_id:i path:s value:s", _stored_paths,
         "WITH " + _PATHS + f"\n---\nSELECT * FROM path WHERE section_no BETWEEN 1 AND {len(SECTION_SQL)}")


def _artifacts(c: Context) -> str:
    """One artifact file per finding; some with a wrong version, hash or key."""
    n = F.col("insight_id")
    item = F.to_json(F.struct("scope", "property_code", "asset_key", "category", "priority", "headline", "detail", "evidence"))
    document = F.concat(
        F.lit('{"artifact_version":'), F.when(n % 7 == 0, "2").otherwise("1"), F.lit(',"as_of":"'), F.col("snapshot_id").cast("string"), F.lit('-12-31","prompt_sha256":"'),
        F.when(n % 11 == 0, "short").otherwise(F.col("prompt_sha256")), F.lit('","model":"writer","generated_at":"2026-01-01T00:00:00Z","payload_source":"database",'),
        F.when(n % 13 == 0, '"extra":1,').otherwise(""), F.lit('"insights":['), item, F.lit("]}"))
    out = shared_folder(c.spark)
    _insights(c).select(n.alias("artifact_id"), document.alias("value")).write.partitionBy("artifact_id").text(out)
    return out


register("s6_insight_source", "category:s scope:s headline:s", lambda c: insight_source(c.spark, _artifacts(c))[0],
         _INSIGHT_SQL + "SELECT category, scope, 'Occupancy of ' || book || ' at ' || format('{:.2f}', pct_occupied) AS headline FROM ins"
         " WHERE insight_id % 7 <> 0 AND insight_id % 11 <> 0 AND insight_id % 13 <> 0")
register("s6_insight_rejects", "reason:s n:i",
         lambda c: insight_source(c.spark, _artifacts(c))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
         _INSIGHT_SQL + "SELECT CASE WHEN insight_id % 7 = 0 THEN 'artifact version not readable' WHEN insight_id % 13 = 0 THEN 'unknown key' ELSE 'bad prompt hash' END AS reason,"
         " count(*) AS n FROM ins WHERE insight_id % 7 = 0 OR insight_id % 11 = 0 OR insight_id % 13 = 0 GROUP BY 1")


def _replaced_insights(c: Context) -> DataFrame:
    """Store every finding, then replace 1998's with those that survive the gate."""
    store, kept = Store(c.spark, shared_folder(c.spark)), ("insight_id", "scope", "category", "snapshot_id")
    store.replace("insight", _insights(c).select(*kept), [r.snapshot_id for r in c.T.snapshot.select("snapshot_id").collect()])
    store.commit()
    survivors = E.evidence_gate(E.normalise_target(_insights(c), *_targets(c)), c.paths, *_targets(c))[0]
    return replace_snapshot_insights(store, survivors.select(*kept), 1998)


register("s8_replace_snapshot_insights", "insight_id:i snapshot_id:i category:s", _replaced_insights,
         _INSIGHT_SQL + "SELECT * FROM ins WHERE snapshot_id <> 1998 OR (n % 5 <> 0 AND (n % 6 = 0 OR n % 17 = 0 OR n % 23 <> 0))")
