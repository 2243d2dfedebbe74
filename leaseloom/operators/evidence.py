"""Checks on written findings: targets, cited figures, staleness, import, and the deterministic text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.functions.scalars import fmt_money, normalise_figure
from leaseloom.operators.payload import fingerprint
from leaseloom.operators.scan import cut

# fixed values: the priority a quadrant implies
QUADRANT_PRIORITY = {"distressed": "high", "leaking": "medium", "vacancy_led": "medium", "performing": "low"}


def known_targets(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The property codes and the asset keys that exist."""
    return properties.select("property_code").distinct(), properties.select("asset_key").distinct()


def _spellings(codes: DataFrame, assets: DataFrame) -> DataFrame:
    """Case-folded identifier -> its known spellings and what each one names."""
    named = codes.select(F.col("property_code").alias("text"), F.lit(True).alias("is_code"), F.lit(False).alias("is_asset")).unionByName(
        assets.select(F.col("asset_key").alias("text"), F.lit(False).alias("is_code"), F.lit(True).alias("is_asset")))
    one = named.groupBy("text").agg(F.bool_or("is_code").alias("is_code"), F.bool_or("is_asset").alias("is_asset"))
    return one.groupBy(F.lower("text").alias("fold")).agg(F.array_agg(F.struct("text", "is_code", "is_asset")).alias("known"))


def _resolved(value: Column, known: Column) -> Column:
    """The spelling in use: the value itself when known, else the known one of the same fold."""
    same = F.filter(known, lambda k: k["text"] == value)
    nothing = F.struct(value.alias("text"), F.lit(False).alias("is_code"), F.lit(False).alias("is_asset"))
    return F.when(F.size(same) > 0, F.get(same, F.lit(0))).when(F.size(known) > 0, F.array_min(known)).otherwise(nothing)


def normalise_target(insights: DataFrame, codes: DataFrame, assets: DataFrame) -> DataFrame:
    """Correct the spelling of targets, believe the identifier over a swapped scope, and clear the
    target field the scope does not own."""
    known = _spellings(codes, assets)
    columns = insights.columns
    looked = (
        insights.withColumns({"_fc": F.lower("property_code"), "_fk": F.lower("asset_key")})
        .join(known.select(F.col("fold").alias("_fc"), F.col("known").alias("_kc")), "_fc", "left")
        .join(known.select(F.col("fold").alias("_fk"), F.col("known").alias("_kk")), "_fk", "left")
        .withColumns({"_c": _resolved(F.col("property_code"), F.col("_kc")), "_k": _resolved(F.col("asset_key"), F.col("_kk"))})
    )
    scope, code, key = F.col("scope"), F.col("_c.text"), F.col("_k.text")
    is_book = (scope == "asset") & (key != "") & ~F.col("_k.is_asset") & F.col("_k.is_code")
    is_asset = (scope == "property") & (code != "") & ~F.col("_c.is_code") & F.col("_c.is_asset")
    swapped = F.coalesce(is_book, F.lit(False)), F.coalesce(is_asset, F.lit(False))
    fixed = F.when(swapped[0], "property").when(swapped[1], "asset").otherwise(scope)
    return looked.withColumns({
        "scope": fixed,
        "property_code": F.when(fixed == "property", F.when(swapped[0], key).otherwise(code)),
        "asset_key": F.when(fixed == "asset", F.when(swapped[1], code).otherwise(key)),
    }).select(*columns)


def judge(insights: DataFrame, paths: DataFrame, codes: DataFrame, assets: DataFrame) -> DataFrame:
    """Insights with the first reason against them (`reason`, null when there is none)."""
    cited = insights.select("insight_id", "snapshot_id", F.posexplode("evidence").alias("_at", "_e")).select(
        "insight_id", "snapshot_id", "_at", F.col("_e.value").alias("_cited"), normalise_figure(F.col("_e.value")).alias("value"))
    # distinct figures are looked up, so a figure cited everywhere is looked up once
    absent = cited.select("snapshot_id", "value").distinct().join(
        paths.select("snapshot_id", "value").distinct(), ["snapshot_id", "value"], "left_anti")
    missing = cited.join(absent, ["snapshot_id", "value"]).groupBy("insight_id").agg(F.min_by("_cited", "_at").alias("_missing"))
    scope = F.col("scope")
    has_code, has_key = F.coalesce(F.col("property_code") != "", F.lit(False)), F.coalesce(F.col("asset_key") != "", F.lit(False))
    fits = F.when(scope == "portfolio", F.col("property_code").isNull() & F.col("asset_key").isNull()).when(
        scope == "asset", has_key & ~has_code).otherwise(has_code & ~has_key)
    exists = F.when(scope == "portfolio", F.lit(True)).when(scope == "asset", F.col("_asset_known")).otherwise(F.col("_code_known"))
    return (
        insights.join(missing, "insight_id", "left")
        .join(codes.select("property_code", F.lit(True).alias("_code_known")), "property_code", "left")
        .join(assets.select("asset_key", F.lit(True).alias("_asset_known")), "asset_key", "left")
        .withColumn("reason", F.when(~fits, "scope/target mismatch").when(
            ~F.coalesce(exists, F.lit(False)),
            F.concat(scope, F.lit(" target '"), F.coalesce("property_code", "asset_key"), F.lit("' does not exist"))).when(
            F.col("_missing").isNotNull(), F.concat(F.lit("evidence value '"), F.col("_missing"), F.lit("' is not in the payload"))))
        .select(*insights.columns, "reason")
    )


def _split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def evidence_gate(insights: DataFrame, paths: DataFrame, codes: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insights whose target exists and whose every cited figure occurs in their snapshot's payload,
    and the others with the first reason against them."""
    return _split(judge(insights, paths, codes, assets))


def import_gate(
    insights: DataFrame, paths: DataFrame, codes: DataFrame, assets: DataFrame, allow_stale: bool = False, allow_empty: bool = False,
    snapshots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decide per snapshot whether its artifact is imported: `(outcome, kept, dropped)`.

    Nothing in the artifact is trusted: its hash is compared with the payload's, its targets are
    normalised and its figures looked up again. `snapshots` names artifacts that may hold no insight. The
    judged insights are stored once, since counts, survivors and drops are all read off them."""
    kept, dropped = _split(cut(judge(normalise_target(insights, codes, assets), paths, codes, assets)))
    count = lambda df, name: df.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias(name))
    claimed = insights.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("read"), F.max("prompt_sha256").alias("artifact_sha256"))
    if snapshots is not None:
        claimed = snapshots.select("snapshot_id").join(claimed, "snapshot_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = (
        claimed.join(fingerprint(paths), "snapshot_id", "left").join(count(kept, "_kept"), "snapshot_id", "left")
        .join(count(dropped, "_dropped"), "snapshot_id", "left")
        .select("snapshot_id", zero("read").alias("read"), zero("_kept").alias("kept"), zero("_dropped").alias("dropped"), "artifact_sha256", "payload_sha256")
        .withColumn("stale", F.col("artifact_sha256") != F.col("payload_sha256"))
    )
    empty = (F.col("read") == 0) & F.lit(not allow_empty)
    stale = F.coalesce(F.col("stale"), F.lit(False)) & F.lit(not allow_stale)
    error = (
        F.when(empty, "artifact contains no insights").when(F.col("payload_sha256").isNull(), "no snapshot loaded")
        .when(stale, "payload changed since generation").when(F.col("kept") == 0, "no insight in the artifact survived the evidence check"))
    outcome = counted.withColumn("error", error).withColumn(
        "status", F.when(F.col("error") == "no snapshot loaded", "failed").when(F.col("error").isNotNull(), "refused").otherwise("succeeded"))
    outcome = outcome.withColumn("inserted", F.when(F.col("status") == "succeeded", F.col("kept")).otherwise(0))
    imported = kept.join(outcome.filter(F.col("status") == "succeeded").select("snapshot_id"), "snapshot_id", "left_semi")
    return outcome, imported, dropped


def positioning_priority(insights: DataFrame, matrix: DataFrame) -> DataFrame:
    """Findings about one book's position: scope, target and category are forced by the book they were
    written for (`book`), priority by its quadrant."""
    by_quadrant = F.create_map(*[F.lit(x) for pair in QUADRANT_PRIORITY.items() for x in pair])
    quadrants = matrix.select("snapshot_id", F.col("property_code").alias("book"), "quadrant")
    return insights.join(quadrants, ["snapshot_id", "book"], "left").withColumns({
        "scope": F.lit("property"), "property_code": F.col("book"), "asset_key": F.lit(None).cast("string"), "category": F.lit("positioning"),
        "priority": F.coalesce(by_quadrant[F.col("quadrant")], F.col("priority"))}).select(*insights.columns)


def first_per_book(kept: DataFrame) -> DataFrame:
    """At most one surviving positioning finding per book: the first written."""
    rest = [c for c in kept.columns if c not in ("snapshot_id", "property_code")]
    return kept.groupBy("snapshot_id", "property_code").agg(F.min_by(F.struct(*rest), "insight_id").alias("r")).select(
        "snapshot_id", "property_code", "r.*")


def staleness(insights: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored hash against the payload as it is now."""
    return insights.join(fingerprint(paths), "snapshot_id", "left").select(
        "insight_id", "snapshot_id", F.col("prompt_sha256").alias("payload_at_generation"), F.col("payload_sha256").alias("payload_current"),
        (~F.col("prompt_sha256").eqNullSafe(F.col("payload_sha256"))).alias("stale"))


def generation_skip(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """The requests (`snapshot_id, prompt_sha256, model`) that already succeeded."""
    keys = ["snapshot_id", "prompt_sha256", "model"]
    return requests.join(runs.filter(F.col("status") == "succeeded").select(*keys), keys, "left_semi")


# ---- fixed values: the wording of the deterministic guidance ------------------
EXCLUSION_HEADLINES = {
    "no_units": "Not scored: no units in this book",
    "no_market_rent": "Not scored: no market rent printed",
    "no_charge_data": "Not scored: no lease-charge lines",
}
EXCLUSION_DETAIL = {
    "no_units": "No current lease row belongs to this book on the report date, so neither axis of the matrix has a value.",
    "no_market_rent": "Asking rents add up to nothing in this report; without them billed revenue has nothing to be measured against.",
    "no_charge_data": "Under half of the current leases come with charge lines. Capture would read low for want of data, so it is left open.",
}
DEFAULT_HEADLINE = "Not scored: no data available"
DEFAULT_DETAIL = "Revenue capture was not worked out for this book and date."
HEADLINES = {
    "performing": "Performing: defend the position",
    "vacancy_led": "Vacancy-led: lease up the empty units",
    "leaking": "Leaking: full but under-collecting",
    "distressed": "Distressed: empty and underpriced",
}
TEXT_PERFORMING = "On target on both axes. Keep the %s notice units let; the capture line is %s away."
TEXT_VACANCY_LED = "Billing holds up, letting does not: %s more units must be occupied, with %s standing empty and %s more about to."
TEXT_LEAKING = "Units are let but %s of monthly billing is missing. Look first at %s, which come to %s."
TEXT_PRICING = "Money is further away than tenants: %s of billing is missing against %s units to let."
TEXT_VACANCY = "Tenants are further away than money: %s units to let against %s of missing billing."


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default))


def positioning_fallback(matrix: DataFrame) -> DataFrame:
    """Headline, detail and evidence for each matrix row, from its own figures."""
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    money = lambda c: F.coalesce(fmt_money(F.col(c)), F.lit("0"))
    cite = lambda metric, text: F.struct(
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), text.alias("value"))
    gap, short, notice, vacant = money("charges_to_threshold"), count("units_to_threshold"), count("notice_units"), count("vacant_units")
    causes = ("concessions", "loss_to_lease", "balance_owed")
    most = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in causes])
    cause = F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit(0)) == most, F.lit(c)) for c in causes])
    share = lambda part, whole: F.when(F.coalesce(F.col(whole), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.col(part), F.lit(0)).cast("double") / F.col(whole).cast("double"))
    pricing_leads = share("charges_to_threshold", "market_rent") >= share("units_to_threshold", "units")
    q, scored = F.col("quadrant"), F.coalesce(F.col("plottable"), F.lit(False))
    detail = (
        F.when(~scored, _lookup(EXCLUSION_DETAIL, F.col("exclusion_reason"), DEFAULT_DETAIL))
        .when(q == "performing", F.format_string(TEXT_PERFORMING, notice, gap))
        .when(q == "vacancy_led", F.format_string(TEXT_VACANCY_LED, short, vacant, notice))
        .when(q == "leaking", F.format_string(TEXT_LEAKING, gap, F.translate(cause, "_", " "), fmt_money(most)))
        .otherwise(F.when(pricing_leads, F.format_string(TEXT_PRICING, gap, short)).otherwise(F.format_string(TEXT_VACANCY, short, gap))))
    evidence = (
        F.when(~scored, F.expr("CAST(array() AS array<struct<metric:string,value:string>>)"))
        .when(q == "performing", F.array(cite("notice_units", notice), cite("charges_to_threshold", gap)))
        .when(q == "vacancy_led", F.array(cite("units_to_threshold", short), cite("vacant_units", vacant), cite("notice_units", notice)))
        .when(q == "leaking", F.array(cite("charges_to_threshold", gap), cite(cause, fmt_money(most))))
        .otherwise(F.array(cite("charges_to_threshold", gap), cite("units_to_threshold", short))))
    headline = F.when(~scored, _lookup(EXCLUSION_HEADLINES, F.col("exclusion_reason"), DEFAULT_HEADLINE)).otherwise(
        _lookup(HEADLINES, q, HEADLINES["distressed"]))
    return matrix.select(
        "snapshot_id", "property_code", headline.alias("headline"), detail.alias("detail"), evidence.alias("evidence"),
        F.when(scored, q).alias("quadrant"), F.lit(True).alias("generic"))
