"""Run ledger and charge-code review."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.functions.scalars import is_concession, trigram_similarity
from leaseloom.sources.literals import literal_rows
from leaseloom.tables import Tables

FACTS = {"leases": "lease", "charges": "lease_charge", "summary_groups": "summary_group",
         "charge_summaries": "charge_summary", "availability": "availability"}


def _count(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "n")


def load_tally(T: Tables, issues: DataFrame) -> DataFrame:
    """Rows per fact, all rows loaded, and issues per severity."""
    facts = reduce(DataFrame.unionByName, [_count(getattr(T, f), m) for m, f in FACTS.items()])
    total = facts.agg(F.sum("n").alias("n")).select(F.lit("rows_loaded").alias("metric"), "n")
    raised = issues.groupBy(F.concat(F.lit("issues_"), "severity").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return facts.unionByName(total).unionByName(raised)


def status_of_run() -> Column:
    """The status of a run from its counts: files_seen, files_failed, errors, warnings."""
    failed = F.col("files_failed")
    return (
        F.when((F.col("errors") > 0) | (failed > 0), F.when(failed == F.col("files_seen"), "failed").otherwise("partial"))
        .when(F.col("warnings") > 0, "partial").otherwise("succeeded"))


def run_status(files: DataFrame, issues: DataFrame) -> DataFrame:
    """`files`: run_id, failed (boolean), one row per file seen. Runs with no file seen and no issue
    are succeeded by definition and have no row."""
    seen = files.groupBy("run_id").agg(F.count(F.lit(1)).alias("files_seen"), F.count_if("failed").alias("files_failed"))
    raised = issues.groupBy("run_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("files_seen", "files_failed", "errors", "warnings")}
    return seen.join(raised, "run_id", "full").select("run_id", *zero.values()).withColumn("status", status_of_run())


def golden_counts(T: Tables) -> DataFrame:
    """The twelve counts a load is checked by."""
    lease = T.lease.agg(
        F.count(F.lit(1)).alias("leases"),
        F.count_if(F.col("section") == "current").alias("leases_current"),
        F.count_if(F.col("section") == "future").alias("leases_future"),
    ).unpivot([], ["leases", "leases_current", "leases_future"], "metric", "n")
    # codes are pre-aggregated, so the distinct count sees one row per code and task
    codes = T.lease_charge.groupBy("charge_code").agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("charges"), F.count(F.lit(1)).alias("charge_codes")
    ).select(F.coalesce("charges", F.lit(0)).alias("charges"), "charge_codes").unpivot(
        [], ["charges", "charge_codes"], "metric", "n")
    rest = {"properties": T.property, "units": T.unit, "unit_types": T.unit_type, "residents": T.resident,
            "summary_groups": T.summary_group, "charge_summaries": T.charge_summary, "availability_rows": T.availability}
    return reduce(DataFrame.unionByName, [lease, codes, *[_count(df, m) for m, df in rest.items()]])


def golden_check(T: Tables, expected: Mapping[str, int]) -> DataFrame:
    want = literal_rows(T.lease.sparkSession, list(expected.items()), "metric string, expected bigint")
    return golden_counts(T).join(want, "metric", "left").withColumn(
        "verdict", F.when(F.col("expected").isNull(), "").when(F.col("n") == F.col("expected"), "ok").otherwise("DIFF"))


def run_issue_rollup(T: Tables, run_id: int | None = None, strict: bool = False) -> DataFrame:
    """Issues of one run (the newest by default) by severity and rule; `fails` marks what makes the
    run fail its check."""
    wanted = F.lit(run_id) if run_id is not None else T.run.agg(F.max("run_id")).scalar()
    failing = ("error", "warning") if strict else ("error",)
    return (
        T.issue.filter(F.col("run_id") == wanted).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("fails", F.col("severity").isin(*failing)).orderBy("severity", "rule")
    )


def reclassify(codes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply `changes` (charge_code, category, description, verified, note, changed_by, changed_at; null
    keeps the old value) and return the new dimension with one audit row per real change. Changes to an
    unknown code or to an invalid category are left out (see `rejected_changes`)."""
    asked = changes.filter(F.col("category").isNull() | F.col("category").isin(*S.CHARGE_CATEGORIES)).select(
        "charge_code", F.col("category").alias("_c"), F.col("description").alias("_d"), F.col("verified").alias("_v"),
        "note", "changed_by", "changed_at")
    both = codes.join(asked, "charge_code", "left").withColumns({
        "new_category": F.coalesce("_c", "category"), "new_description": F.coalesce("_d", "description"),
        "new_verified": F.coalesce("_v", "label_verified")})
    updated = both.select(
        "charge_code", F.col("new_category").alias("category"), F.col("new_description").alias("description"),
        F.col("new_verified").alias("label_verified"), is_concession(F.col("charge_code")).alias("is_concession"))
    moved = (
        ~F.col("category").eqNullSafe(F.col("new_category")) | ~F.col("description").eqNullSafe(F.col("new_description"))
        | ~F.col("label_verified").eqNullSafe(F.col("new_verified")))
    audit = both.filter(moved).select(
        "charge_code", F.col("category").alias("old_category"), "new_category",
        F.col("description").alias("old_description"), "new_description",
        F.col("label_verified").alias("old_verified"), "new_verified", "note", "changed_by", "changed_at")
    return updated, audit


def rejected_changes(codes: DataFrame, changes: DataFrame) -> DataFrame:
    known = codes.select("charge_code", F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "unknown charge code").when(
        ~F.col("category").isin(*S.CHARGE_CATEGORIES), "invalid category")
    return changes.join(known, "charge_code", "left").withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "charge_code", "category", "reason")


def nearest_codes(codes: DataFrame, term: str, n: int = 3) -> DataFrame:
    return (
        codes.select("charge_code", trigram_similarity(F.col("charge_code"), F.lit(term)).alias("similarity"))
        .orderBy(F.desc("similarity"), "charge_code").limit(n)
    )
