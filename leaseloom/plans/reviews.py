"""What people decide about loaded books and what then is stored: imported insights with their runs, and reviewed charge codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.operators import evidence as E
from leaseloom.operators import ledger as L
from leaseloom.operators.scan import cut
from leaseloom.plans.load import BY_CATEGORY, refreshed
from leaseloom.sources.versions import Store
from leaseloom.tables import Tables

STALE_NOTE = "imported although the payload changed since generation"


def import_insights(
    T: Tables, insights: DataFrame, paths: DataFrame, codes: DataFrame, assets: DataFrame, out: str, allow_stale: bool = False,
    allow_empty: bool = False, snapshots: DataFrame | None = None,
) -> tuple[Tables, DataFrame]:
    """Judge the insights and store the survivors: a snapshot that succeeds has its insights replaced whole, a refused or failed one keeps
    what it had. Every snapshot gets a run row, with what was kept, dropped and replaced and why it was refused. Returns the tables with
    `insight` and `insight_run`, and the dropped insights with their reasons."""
    store = Store(insights.sparkSession, out)
    outcome, imported, dropped = E.import_gate(insights, paths, codes, assets, allow_stale, allow_empty, snapshots)
    outcome, imported = cut(outcome), cut(imported)
    stored = store.read("insight") if store.has("insight") else imported.limit(0)
    before = cut(stored.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("_replaced")))
    done = F.col("status") == "succeeded"
    top = T.insight_run.agg(F.max("insight_run_id")).first()[0] if T.insight_run is not None else None
    # one row for each snapshot, and a snapshot is a report date
    numbered = F.row_number().over(Window.orderBy("snapshot_id")) + F.lit(top or 0)
    rows = outcome.join(before, "snapshot_id", "left").select(
        numbered.cast("bigint").alias("insight_run_id"), F.col("snapshot_id").cast("int").alias("snapshot_id"),
        F.col("artifact_sha256").alias("prompt_sha256"), F.lit(None).cast("string").alias("model"), "status",
        F.when(done & F.col("stale"), STALE_NOTE).otherwise(F.col("error")).alias("note"), F.col("kept").cast("bigint").alias("kept"),
        F.col("dropped").cast("bigint").alias("dropped"), F.when(done, F.coalesce("_replaced", F.lit(0))).otherwise(0).cast("bigint").alias("replaced"),
        F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"))
    store.append("insight_run", rows)
    # report dates, so never many
    store.replace("insight", imported, [r.snapshot_id for r in imported.select("snapshot_id").distinct().collect()])
    store.commit()
    return T.with_frames(insight=store.read("insight"), insight_run=store.read("insight_run")), dropped


def apply_review(T: Tables, changes: DataFrame, out: str) -> tuple[Tables, DataFrame]:
    """Apply charge-code changes for good: the dimension is written anew and one audit row is appended for each real change. Of the stored
    marts, those that sum by category are computed anew for the snapshots that hold lines of a code with another category now, and for no
    others. Returns the tables and the charge mix."""
    store = Store(T.charge_code.sparkSession, out)
    T = store.frames(T)
    codes, audit = L.reclassify(T.charge_code, changes)
    audit = cut(audit)
    history = store.append("audit", audit)
    moved = audit.filter(~F.col("old_category").eqNullSafe(F.col("new_category"))).select("charge_code").distinct()
    if store.has("mart_input"):
        # marts times report dates, so never many
        uses = store.read("mart_input").join(moved, "charge_code", "left_semi").groupBy("mart").agg(F.collect_set("snapshot_id").alias("days")).collect()
        stale = {r.mart: sorted(r.days) for r in uses}
    else:
        stale = dict.fromkeys(BY_CATEGORY, sorted(r.snapshot_id for r in T.snapshot.select("snapshot_id").collect()))
    T = T.with_frames(charge_code=store.put("charge_code", codes), audit=history)
    refreshed(store, T, stale)
    store.commit()
    return T, store.read("mart/charge_mix")
