"""The analytical payload of a snapshot, its figures with their paths, and the chunks cut from it.

A payload is a set of row sets keyed by `snapshot_id`, not one document: paths, hashes and sizes are
computed over the rows, so nothing is gathered whole. Documents are only assembled for chunks already
known to fit a context window, which bounds them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from leaseloom.functions.scalars import canonical_json, normalise_figure, tokens_of_length
from leaseloom.operators import marts as M
from leaseloom.operators import reads as R
from leaseloom.operators.scan import two_level_row_number
from leaseloom.tables import Tables

# section -> the columns its rows are ordered by; `portfolio` is one object per snapshot
SECTION_ORDER: dict[str, tuple[str, ...]] = {
    "portfolio": (), "properties": ("property_code",), "assets": ("asset_key",), "charge_mix": ("property_code", "category"),
    "expirations": ("property_code", "expiry_month"), "loss_to_lease": ("property_code",), "matrix": ("revenue_capture_pct", "property_code"),
    "reconciliation": ("property_code",), "data_quality": ("rule", "severity"), "trend": ("property_code",),
}
RANKINGS = {  # name -> (metric, descending)
    "lowest_occupancy": ("pct_occupied", False), "highest_occupancy": ("pct_occupied", True),
    "largest_negative_balance": ("balance", False), "largest_market_rent": ("market_rent", True),
}
HORIZON_MONTHS = 12


def payload_sections(T: Tables, snapshot_id: int | None = None, kpi_mart: DataFrame | None = None) -> dict[str, DataFrame]:
    """The finished row sets of one snapshot (or of each), every row keyed by `snapshot_id`. The movement since the snapshot before is read
    off `kpi_mart`, the stored figures of all snapshots, if given."""
    scoped = R.at(T, snapshot_id)
    days = scoped.snapshot.select("snapshot_id", "as_of_date")
    kpi = M.property_snapshot_kpi(scoped)
    # movement looks back at the previous snapshot, so its input is not narrowed to one
    every = kpi_mart if kpi_mart is not None else M.property_snapshot_kpi(T) if snapshot_id is not None else kpi
    coded = scoped.property.select("property_id", "property_code")
    figures = ["units", "occupied_units", "notice_units", "vacant_units", "non_revenue_units", "future_leases", "pct_occupied",
               "market_rent", "lease_charges", "square_feet", "balance"]
    totals = R.portfolio_totals(scoped).select(
        "snapshot_id", *[c for c in figures if c != "notice_units"], "property_count").filter(F.col("property_count") > 0)
    horizon = F.add_months("as_of_date", HORIZON_MONTHS)
    sections = {
        "portfolio": totals,
        "properties": kpi.select("snapshot_id", "property_code", "property_name", "book_type", "asset_key", *figures),
        "assets": M.asset_snapshot_kpi(kpi).select(
            "snapshot_id", "asset_key", "asset_label", "book_count", "property_codes", "units", "occupied_units", "vacant_units",
            "non_revenue_units", "pct_occupied", "market_rent", "lease_charges", "square_feet", "balance"),
        "charge_mix": M.charge_mix(scoped).join(coded, "property_id").groupBy("snapshot_id", "property_code", "category").agg(
            F.sum("line_count").alias("line_count"), F.sum("amount").alias("amount")),
        "expirations": M.expiration_schedule(scoped).join(days, "snapshot_id").filter(F.col("expiry_month") <= horizon).join(coded, "property_id").select(
            "snapshot_id", "property_code", "expiry_month", "expiring_leases", "charges_at_risk", "holdover_mtm"),
        "loss_to_lease": R.property_loss_to_lease(scoped).select(
            "snapshot_id", "property_code", "units", "market_rent", "contract_rent", "concessions", "loss_to_lease"),
        "matrix": M.property_profitability(scoped).filter("plottable").select(
            "snapshot_id", "property_code", "property_name", "book_type", "quadrant", "revenue_capture_pct", "pct_occupied", "units",
            "occupied_units", "vacant_units", "notice_units", "market_rent", "lease_charges", "charges_to_threshold", "units_to_threshold",
            "loss_to_lease", "concessions", "ancillary_charges", "units_owing", "balance_owed", "capture_threshold", "occupancy_threshold"),
        "reconciliation": R.reconciliation_view(scoped, differing_only=True).select(
            "snapshot_id", "property_code", "detail_units", "availability_units", "unit_delta", "detail_occupied", "availability_occupied", "charge_delta"),
        "data_quality": R.issue_summary(scoped).select("snapshot_id", "rule", "severity", "n"),
        "trend": M.property_trend(every).join(days, F.col("current_as_of") == F.col("as_of_date")).select(
            "snapshot_id", "property_code", "prior_as_of", "d_pct_occupied", "d_market_rent", "d_lease_charges", "d_balance", "d_notice_units"),
    }
    sections["rankings"] = rankings(sections["properties"])
    sections["dates"] = scoped.snapshot.select("snapshot_id", F.col("as_of_date").alias("as_of"), "report_month")
    return sections


def rankings(properties: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` books of each ranking, per snapshot, ties by code."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("ranking"), F.lit(metric).alias("metric"), F.col(metric).cast("decimal(38,2)").alias("value"),
                 (F.col(metric) * (-1 if down else 1)).cast("decimal(38,2)").alias("key"))
        for name, (metric, down) in RANKINGS.items()])
    place = Window.partitionBy("snapshot_id", "ranking").orderBy("key", "property_code")
    return (
        properties.filter(F.col("units") > 0).select("snapshot_id", "property_code", "units", F.explode(entries).alias("e"))
        .select("snapshot_id", "property_code", "units", "e.*").filter(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)
        .select("snapshot_id", "ranking", "place", "property_code", "metric", "value", "units")
    )


# ---- figures and their paths -------------------------------------------------

def _item(col_no: int, name: str):
    return lambda v, k: F.struct(
        F.lit(col_no).alias("col_no"), k.alias("sub"), F.concat(F.lit(f"{name}["), k.cast("string"), F.lit("]")).alias("leaf"), v.cast("string").alias("raw"))


def row_entries(df: DataFrame) -> Column:
    """The scalars of a row in column order, list items one by one; nulls and booleans are no figures."""
    parts = []
    for i, f in enumerate(x for x in df.schema.fields if x.name not in ("snapshot_id", "_i")):
        if isinstance(f.dataType, T_.BooleanType):
            continue
        if isinstance(f.dataType, T_.ArrayType):
            parts.append(F.transform(F.col(f.name), _item(i, f.name)))
        else:
            parts.append(F.array(F.struct(
                F.lit(i).alias("col_no"), F.lit(0).alias("sub"), F.lit(f.name).alias("leaf"), F.col(f.name).cast("string").alias("raw"))))
    return F.filter(F.flatten(F.array(*parts)), lambda e: e["raw"].isNotNull())


PATH_ORDER = ["section_no", "i", "col_no", "sub"]


def _paths(df: DataFrame, section_no: int, prefix: Column, i: Column) -> DataFrame:
    return df.select("snapshot_id", F.lit(section_no).alias("section_no"), i.cast("bigint").alias("i"), prefix.alias("_p"),
                     F.explode(row_entries(df)).alias("e")).select(
        "snapshot_id", "section_no", "i", "e.col_no", "e.sub", F.concat("_p", "e.leaf").alias("path"), "e.raw",
        normalise_figure(F.col("e.raw")).alias("value"))


def sort_lead(section: str, first: Column) -> Column:
    """What the rows of a section that begin alike have in common: neither they nor these are sorted as a whole."""
    return F.floor(first) if section == "matrix" else F.substring(first, 1, 3)


def flatten_paths(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Every scalar of the payload with its path, raw text and normalised value."""
    frames = [_paths(sections["dates"], 0, F.lit("$."), F.lit(0))]
    for no, (name, order) in enumerate(SECTION_ORDER.items(), start=1):
        df = sections[name]
        if not order:
            frames.append(_paths(df, no, F.lit(f"$.{name}."), F.lit(0)))
            continue
        indexed = two_level_row_number(df, ["snapshot_id"], {"_lead": sort_lead(name, F.col(order[0]))}, [F.col(c) for c in order], "_i")
        at = F.col("_i") - 1
        frames.append(_paths(indexed, no, F.concat(F.lit(f"$.{name}["), at.cast("string"), F.lit("].")), at))
    last = len(SECTION_ORDER) + 1
    for k, (name, (metric, _)) in enumerate(RANKINGS.items()):
        rows = sections["rankings"].filter(F.col("ranking") == name)
        shown = rows.select("snapshot_id", "property_code", F.col("value").alias(metric), "units", F.col("place").alias("_i"))
        at = F.col("_i") - 1
        frames.append(_paths(shown, last + k, F.concat(F.lit(f"$.rankings.{name}["), at.cast("string"), F.lit("].")), at))
    return reduce(DataFrame.unionByName, frames)


def find_paths(paths: DataFrame, figures: DataFrame, limit: int = 12) -> DataFrame:
    """Where each figure (`snapshot_id, figure`) occurs, the first `limit` places in payload order.

    Places are cut to `limit` per value before the join: a value such as 0 may fill much of a payload."""
    first = Window.partitionBy("snapshot_id", "value").orderBy(*PATH_ORDER)
    places = paths.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit).select(
        "snapshot_id", "value", "path", "place")
    asked = figures.select("snapshot_id", "figure").distinct().withColumn("value", normalise_figure(F.col("figure")))
    return asked.join(places, ["snapshot_id", "value"]).select("snapshot_id", "figure", "path", "place")


def fingerprint(paths: DataFrame) -> DataFrame:
    """One hash per snapshot over all its (path, text) pairs. The pairs are hashed one by one and the
    hashes added up in four lanes, so the order they arrive in does not matter and they combine on the
    map side; the paths carry the positions, so reordering a section still changes the result."""
    digest = F.sha2(F.concat_ws("=", "path", "raw"), 256)
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 16 * k, 15), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    return paths.select("snapshot_id", digest.alias("_h")).groupBy("snapshot_id").agg(
        F.sha2(F.concat_ws("|", *[x.cast("string") for x in lanes]), 256).alias("payload_sha256"))


# ---- chunks ------------------------------------------------------------------

PARTS = ["snapshot_id", "chunk", "part", "is_list", "seq", "json"]
_BY_PROPERTY = ("charge_mix", "expirations", "loss_to_lease", "reconciliation")
ASSET_PARTS = {"as_of": False, "asset": False, "charge_mix": True, "expirations": True, "loss_to_lease": True,
               "portfolio_context": False, "properties": True, "reconciliation": True}
REDUCE_PARTS = {"as_of": False, "asset_findings": True, "data_quality": True, "portfolio": False, "rankings": False, "reconciliation": True}


def _part(df: DataFrame, chunk: Column, part: str, is_list: bool, seq: Column, columns: list[str]) -> DataFrame:
    return df.select("snapshot_id", chunk.alias("chunk"), F.lit(part).alias("part"), F.lit(is_list).alias("is_list"),
                     seq.cast("string").alias("seq"), canonical_json(df, columns).alias("json"))


def _order_text(name: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in SECTION_ORDER[name]])


def _fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("snapshot_id", "_asset")]


def _as_of(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    return chunks.join(dates, "snapshot_id").select(
        "snapshot_id", "chunk", F.lit("as_of").alias("part"), F.lit(False).alias("is_list"), F.lit("").alias("seq"),
        F.concat(F.lit('"'), F.col("as_of").cast("string"), F.lit('"')).alias("json"))


def asset_chunks(sections: Mapping[str, DataFrame]) -> DataFrame:
    """The parts of one chunk per asset: its own row, its books and their figures, the portfolio context."""
    assets, properties, portfolio = sections["assets"], sections["properties"], sections["portfolio"]
    name = F.concat(F.lit("map:"), F.col("asset_key"))
    chunks = assets.select("snapshot_id", name.alias("chunk"))
    context = portfolio.select("snapshot_id", "pct_occupied", "units", "property_count")
    parts = [
        _as_of(chunks, sections["dates"]),
        _part(assets, name, "asset", False, F.lit(""), _fields(assets)),
        _part(properties, name, "properties", True, _order_text("properties"), _fields(properties)),
        chunks.join(context.select("snapshot_id", canonical_json(context, ["pct_occupied", "units", "property_count"]).alias("json")), "snapshot_id").select(
            "snapshot_id", "chunk", F.lit("portfolio_context").alias("part"), F.lit(False).alias("is_list"), F.lit("").alias("seq"), "json"),
    ]
    owner = properties.select("snapshot_id", "property_code", F.col("asset_key").alias("_asset"))
    for section in _BY_PROPERTY:
        rows = sections[section].join(owner, ["snapshot_id", "property_code"])
        parts.append(_part(rows, F.concat(F.lit("map:"), F.col("_asset")), section, True, _order_text(section), _fields(rows)))
    return reduce(DataFrame.unionByName, parts)


def positioning_chunks(sections: Mapping[str, DataFrame]) -> DataFrame:
    """One small document per scored book: its matrix row and the portfolio's reference points."""
    matrix = sections["matrix"]
    context = (
        matrix.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("property_count"), F.max("capture_threshold").alias("capture_threshold"),
                                          F.max("occupancy_threshold").alias("occupancy_threshold"))
        .join(sections["portfolio"].select("snapshot_id", "pct_occupied"), "snapshot_id")
    )
    context = context.select("snapshot_id", canonical_json(context, _fields(context)).alias("_context"))
    rows = matrix.select("snapshot_id", "property_code", canonical_json(matrix, _fields(matrix)).alias("_row"))
    return rows.join(context, "snapshot_id").join(sections["dates"], "snapshot_id").select(
        "snapshot_id", F.concat(F.lit("positioning:"), F.col("property_code")).alias("chunk"),
        F.format_string('{"as_of":"%s","portfolio_context":%s,"property":%s}', F.col("as_of").cast("string"), "_context", "_row").alias("document"))


def reduce_chunk(sections: Mapping[str, DataFrame], findings: DataFrame) -> DataFrame:
    """The parts of the portfolio chunk: totals, rankings, open reconciliation and quality rows, and the
    headlines (`snapshot_id, asset_key, headline`) found per asset."""
    name = F.lit("reduce")
    portfolio = sections["portfolio"]
    ranked = sections["rankings"]
    shown = F.concat(
        F.lit('{"'), F.least(F.col("metric"), F.lit("property_code")), F.lit('":"'),
        F.when(F.col("metric") < "property_code", F.col("value").cast("string")).otherwise(F.col("property_code")),
        F.lit('","'), F.greatest(F.col("metric"), F.lit("property_code")), F.lit('":"'),
        F.when(F.col("metric") < "property_code", F.col("property_code")).otherwise(F.col("value").cast("string")),
        F.lit('","units":'), F.col("units").cast("string"), F.lit("}"))
    # at most five rows per ranking
    lists = ranked.groupBy("snapshot_id", "ranking").agg(F.sort_array(F.collect_list(F.struct("place", shown.alias("j")))).alias("l"))
    lists = lists.select("snapshot_id", F.format_string('"%s":[%s]', "ranking", F.array_join(F.transform("l", lambda x: x["j"]), ",")).alias("j"))
    ranking = lists.groupBy("snapshot_id").agg(F.sort_array(F.collect_list("j")).alias("l")).select(
        "snapshot_id", name.alias("chunk"), F.lit("rankings").alias("part"), F.lit(False).alias("is_list"), F.lit("").alias("seq"),
        F.concat(F.lit("{"), F.array_join("l", ","), F.lit("}")).alias("json"))
    parts = [
        _as_of(portfolio.select("snapshot_id", name.alias("chunk")), sections["dates"]),
        _part(portfolio, name, "portfolio", False, F.lit(""), _fields(portfolio)), ranking,
        _part(findings, name, "asset_findings", True, F.col("asset_key"), ["asset_key", "headline"]),
    ]
    for section in ("data_quality", "reconciliation"):
        parts.append(_part(sections[section], name, section, True, _order_text(section), _fields(sections[section])))
    return reduce(DataFrame.unionByName, parts)


def frame_length(expected: Mapping[str, bool]) -> int:
    """Characters of a document without what its parts hold."""
    return 2 + sum(len(k) + 3 for k in expected) + len(expected) - 1 + 2 * sum(expected.values())


def chunk_sizes(parts: DataFrame, expected: Mapping[str, bool]) -> DataFrame:
    """Length and token estimate of each chunk's document, from its parts' lengths alone."""
    frame = frame_length(expected)
    per_part = parts.groupBy("snapshot_id", "chunk", "part", "is_list").agg(
        F.sum(F.length("json")).alias("_chars"), F.count(F.lit(1)).alias("_n"))
    length = F.sum(F.col("_chars") + F.when(F.col("is_list"), F.col("_n") - 1).otherwise(0)) + frame
    return per_part.groupBy("snapshot_id", "chunk").agg(length.alias("length")).withColumn("tokens", tokens_of_length(F.col("length")))


def chunk_fit(sizes: DataFrame, num_ctx: int, headroom: float = 1.3) -> DataFrame:
    """Whether each chunk fits the context with headroom. A chunk that does not is refused, never cut."""
    need = F.col("tokens") * F.lit(headroom)
    return sizes.withColumns({"needed": F.floor(need).cast("bigint"), "num_ctx": F.lit(num_ctx).cast("bigint"), "fits": need <= num_ctx})


def documents(parts: DataFrame, keys: list[str], expected: Mapping[str, bool]) -> DataFrame:
    """One document for each of `keys`, which are known to fit a context."""
    text = parts.groupBy(*keys, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "json"))), lambda x: x["json"]), ",").alias("t"))
    parts_of = text.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "t"))).alias("m"))
    fields = []
    for key in sorted(expected):
        body = F.coalesce(F.col("m")[key], F.lit(""))
        fields.append(F.concat(F.lit(f'"{key}":['), body, F.lit("]")) if expected[key] else F.concat(F.lit(f'"{key}":'), body))
    return parts_of.select(*keys, F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("document"))


def assemble_chunks(parts: DataFrame, fit: DataFrame, expected: Mapping[str, bool]) -> DataFrame:
    """One row for each chunk of `fit`: its document, or for a refused one a null document and the reason. A document's size is bounded
    by the context it fits; the parts of a refused chunk are never gathered (`pieces.split_documents` gives them in several documents)."""
    kept = parts.join(fit.filter("fits").select("snapshot_id", "chunk"), ["snapshot_id", "chunk"])
    made = documents(kept, ["snapshot_id", "chunk"], expected)
    reason = F.when(~F.col("fits"), F.format_string("needs a context of %d tokens, %d given", F.col("needed"), F.col("num_ctx")))
    return fit.join(made, ["snapshot_id", "chunk"], "left").select("snapshot_id", "chunk", "document", "needed", "num_ctx", reason.alias("reason"))
