"""The load: report grids in, a star schema stored by snapshot out, with its ledger, findings, aggregates and marts.

Each stage is a lazy frame; the actions are the writes. Files loaded before as they are now are skipped. Books printed in the files that are
loaded are replaced whole, everything else is left as it was. All tables of a load come into sight together, when it is done.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.operators import dimensions as Dm
from leaseloom.operators import grammar as G
from leaseloom.operators import ledger as L
from leaseloom.operators import marts as M
from leaseloom.operators import rules as V
from leaseloom.operators.rollups import ROLLUPS
from leaseloom.operators.scan import cut, two_level_row_number
from leaseloom.sources import sinks
from leaseloom.sources.grids import grid_inventory, grid_schema, skip_unchanged
from leaseloom.sources.literals import literal_rows
from leaseloom.sources.versions import Store
from leaseloom.tables import Tables

SNAPSHOT_ID = "year(as_of_date) * 10000 + month(as_of_date) * 100 + day(as_of_date)"
RENT_ROLL, AVAILABILITY = S.DATASETS
TOOL_VERSION = "3"
#: The marts that are stored, from the stored aggregates.
MARTS = {"property_snapshot_kpi": M.property_snapshot_kpi, "charge_mix": M.charge_mix, "ancillary": lambda T: M.ancillary(M.charge_mix(T)),
         "revenue_bridge": M.revenue_bridge}
#: Which of them depend on the category of a code, and the lines they read.
BY_CATEGORY = {"charge_mix": "true", "ancillary": "true", "revenue_bridge": "section = 'current'"}


@dataclass(frozen=True)
class Loaded:
    """The tables after the load, the stored aggregates among them, the findings of this run, and the stored marts."""

    tables: Tables
    run_id: int
    issues: DataFrame
    marts: dict[str, DataFrame]


def _numbered(df: DataFrame, keys: Sequence[str], name: str, known: DataFrame, bucket: dict[str, Column]) -> DataFrame:
    """Keep the ids of known rows and number the new ones above them, bucket by bucket. `df` is stored, since old and new rows, and the sizes of
    the buckets, are read off it."""
    df = cut(df)
    fresh = df.join(known.select(*keys), list(keys), "left_anti").withColumn("_all", F.lit(0))
    top = known.agg(F.coalesce(F.max(name), F.lit(0))).scalar()
    numbered = two_level_row_number(fresh, ["_all"], bucket, [F.col(k) for k in keys], name, wider=[next(iter(bucket))])
    kind = dict(known.dtypes)[name]
    old = df.join(known.select(*keys, name), list(keys))
    return old.select(*df.columns, name).unionByName(numbered.select(*df.columns, (F.col(name) + top).cast(kind).alias(name)))


def empty_tables(spark: SparkSession) -> Tables:
    def none(ddl: str) -> DataFrame:
        return spark.createDataFrame([], ddl)

    return Tables(
        snapshot=none("snapshot_id int, as_of_date date, report_month date"),
        property=none("property_id int, property_code string, property_name string, asset_key string, book_type string"),
        unit_type=none("property_id int, unit_type_code string"),
        unit=none("unit_id bigint, property_id int, unit_code string, unit_type_code string, unit_sqft int"),
        resident=none("resident_id string, display_name string"), charge_code=sinks.charge_code_seed(spark),
        run=none(S.RUN), file=none(S.FILE), issue=none(S.ISSUE), audit=none(S.AUDIT), insight=none(S.INSIGHT), insight_run=none(S.INSIGHT_RUN),
    )


def load_reports(
    spark: SparkSession, rent_grid: DataFrame | None, availability_grid: DataFrame | None, out: str, known: Tables | None = None,
    force: bool = False, started_at: dt.datetime | None = None,
) -> Loaded:
    """Load the files of the grids that are new or changed (all of them with `force`) into the tables stored under `out`; `known` gives those
    that are not stored there. Either grid may be left out."""
    started_at = started_at or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    store = Store(spark, out)
    known = store.frames(known or empty_tables(spark))
    run_id = (known.run.agg(F.max("run_id")).first()[0] or 0) + 1
    rent_grid = rent_grid if rent_grid is not None else spark.createDataFrame([], grid_schema(S.RENT_ROLL_COLUMNS))
    availability_grid = availability_grid if availability_grid is not None else spark.createDataFrame([], grid_schema(S.AVAILABILITY_COLUMNS))

    inventory = cut(grid_inventory(rent_grid, RENT_ROLL).unionByName(grid_inventory(availability_grid, AVAILABILITY)))
    loaded_before = known.file.filter("status = 'loaded'").select("dataset", "file_name", "sha256").distinct()
    top = known.file.agg(F.max("file_id")).first()[0] or 0
    files = cut(Dm.file_ids(skip_unchanged(inventory, loaded_before, force), top))
    ledger = _Ledger(store, run_id, started_at)
    if store.has("lease") and files.isEmpty():
        return ledger.close(known, inventory, files)
    fresh = lambda grid, dataset: grid.join(files.filter(F.col("dataset") == dataset).select("file_name"), "file_name", "left_semi")

    read = sinks.side_by_side({
        RENT_ROLL: lambda: G.parse_rent_rolls(fresh(rent_grid, RENT_ROLL)),
        AVAILABILITY: lambda: [cut(df) for df in G.availability_row(fresh(availability_grid, AVAILABILITY))],
    })
    parsed, (available, available_issues) = read[RENT_ROLL], read[AVAILABILITY]

    headers = cut(parsed.headers.withColumns({"source_rank": F.lit(0), "dataset": F.lit(RENT_ROLL)}).unionByName(
        available.select("file_name", "property_code", "property_name", "as_of_date", F.lit(None).cast("date").alias("report_month"),
                         F.lit(1).alias("source_rank"), F.lit(AVAILABILITY).alias("dataset"))))
    snapshot = Dm.merge_snapshot(known.snapshot, headers).withColumn("snapshot_id", F.expr(SNAPSHOT_ID).cast("int"))
    prop = _numbered(Dm.merge_property(known.property, headers), ["property_code"], "property_id", known.property, {"_b": F.substring("property_code", 1, 2)})
    put = lambda frames: sinks.side_by_side({name: partial(store.put, name, df) for name, df in frames.items()})
    dims = put({"snapshot": snapshot, "property": prop})
    book = cut(
        headers.withColumn("_code", F.lower("property_code"))
        .join(dims["property"].select(F.lower("property_code").alias("_code"), "property_id"), "_code")
        .join(dims["snapshot"].select("as_of_date", "snapshot_id"), "as_of_date")
        .join(files.select("dataset", "file_name", "file_id"), ["dataset", "file_name"])
        .select("dataset", "file_name", "file_id", "snapshot_id", "property_id")
    )
    books = {d: book.filter(F.col("dataset") == d).drop("dataset") for d in S.DATASETS}
    keyed = lambda df, dataset=RENT_ROLL: Dm.resolve_keys(df, [(books[dataset], ["file_name"])])
    id_of = lambda row: Dm.row_id(F.col("file_id"), F.col(row))

    lease = keyed(parsed.leases).withColumn("lease_id", id_of("sheet_row"))
    seen = lease.select("property_id", "unit_code", "unit_type_code", "unit_sqft", "resident_id", "resident_name", "file_name", "sheet_row")
    unit = _numbered(Dm.merge_unit(known.unit, seen), ["property_id", "unit_code"], "unit_id", known.unit,
                     {"_b": F.col("property_id"), "_lead": F.substring("unit_code", 1, 3)})
    codes, unknown = Dm.unknown_codes(parsed.lines, parsed.charge_summary, known.charge_code)
    dims |= put({"unit": unit, "unit_type": Dm.merge_unit_type(known.unit_type, seen), "resident": Dm.merge_resident(known.resident, seen), "charge_code": codes})
    facts = {
        "lease": lease.join(dims["unit"].select("property_id", "unit_code", "unit_id"), ["property_id", "unit_code"]).drop("file_name", "sentinel", "resident_name"),
        "lease_charge": keyed(parsed.lines).select(
            id_of("owner").alias("lease_id"), "snapshot_id", "property_id", "section", "occupancy_status", "line_no", "charge_code",
            F.col("amount").cast("decimal(12,2)").alias("amount"), "sheet_row"),
        "summary_group": Dm.upsert_rollups(keyed(parsed.groups), ["snapshot_id", "property_id", "group_label"]).drop("file_name", "sheet_row"),
        "charge_summary": Dm.upsert_rollups(keyed(parsed.charge_summary), ["snapshot_id", "property_id", "charge_code"]).drop("file_name", "sheet_row"),
        "availability": Dm.upsert_availability(keyed(available.drop("property_code", "property_name", "as_of_date"), AVAILABILITY)).drop("file_name"),
    }
    # report dates, so never many
    snapshots = sorted(r.snapshot_id for r in book.select("snapshot_id").distinct().collect())
    # a rent roll replaces its book's leases and printed rollups, an availability report its own row
    touched = {d: books[d].select("snapshot_id", "property_id").distinct() for d in S.DATASETS}
    older = {name for name in ROLLUPS if store.has("lease") and not store.has(name)}
    stored = sinks.side_by_side({
        name: partial(store.replace, name, ledger.counted(name, df), snapshots, touched[AVAILABILITY if name == "availability" else RENT_ROLL])
        for name, df in facts.items()})
    T = known.with_frames(**dims, **stored)
    T = T.with_frames(**_rolled_up(store, T, snapshots, touched[RENT_ROLL], older))
    done = sinks.side_by_side({
        "findings": lambda: cut(_findings(T, parsed.issues, available_issues, unknown, files, snapshots)),
        "marts": lambda: refreshed(store, T, dict.fromkeys(MARTS, _stale(known.property, dims["property"], T, snapshots)))})
    return ledger.close(T, inventory, files, headers.select("dataset", "file_name").distinct(), done["findings"])


def _rolled_up(store: Store, T: Tables, snapshots: list[int], touched: DataFrame, older: set[str]) -> dict[str, DataFrame]:
    """The stored aggregates of the facts, with those of the touched books alone computed anew. Those in `older`, which the store has not
    got though it has leases, are computed of all its books."""
    of = lambda df: df.filter(F.col("snapshot_id").isin(*snapshots)).join(touched, ["snapshot_id", "property_id"], "left_semi") if snapshots else df.limit(0)
    books = T.with_frames(lease=of(T.lease), lease_charge=of(T.lease_charge))
    every = sorted(r.snapshot_id for r in T.snapshot.select("snapshot_id").collect()) if older else []
    jobs = {name: partial(store.replace, name, rollup(T), every) if name in older else partial(store.replace, name, rollup(books), snapshots, touched)
            for name, rollup in ROLLUPS.items()}
    return sinks.side_by_side(jobs)


def _stale(before: DataFrame, now: DataFrame, T: Tables, snapshots: list[int]) -> list[int]:
    """The snapshots whose marts are out of date: those loaded, and all of them where a book was named anew, since marts show names."""
    renamed = before.join(now, before.columns, "left_anti")
    return snapshots if renamed.isEmpty() else sorted(r.snapshot_id for r in T.snapshot.select("snapshot_id").collect())


def refreshed(store: Store, T: Tables, snapshots: dict[str, list[int]]) -> dict[str, DataFrame]:
    """The stored marts named in `snapshots`, computed anew for their snapshots alone, with the codes that these depend on."""
    def one(name: str, days: list[int]) -> DataFrame:
        df = MARTS[name](T)
        rows = df.filter(F.col("snapshot_id").isin(*days)) if days else df.limit(0)
        return store.replace(f"mart/{name}", rows, days)

    jobs = {name: partial(one, name, days) for name, days in snapshots.items()}
    done = sinks.side_by_side(jobs | {"": partial(_inputs, store, T, sorted(set().union(*snapshots.values())))})
    return {name: done[name] for name in snapshots}


def _inputs(store: Store, T: Tables, days: list[int]) -> DataFrame:
    """(charge_code, mart, snapshot_id): the marts of a snapshot that hold lines of a code under its category."""
    uses = ROLLUPS["book_code_charges"](T)
    every = [uses.filter(lines).select("charge_code", F.lit(name).alias("mart"), "snapshot_id").distinct() for name, lines in BY_CATEGORY.items()]
    rows = reduce(DataFrame.unionByName, every)
    return store.replace("mart_input", rows.filter(F.col("snapshot_id").isin(*days)) if days else rows.limit(0), days)


class _Ledger:
    """What a load did: rows counted while they are written, findings, files and the run, stored last."""

    def __init__(self, store: Store, run_id: int, started_at: dt.datetime):
        self.store, self.run_id, self.started_at, self.rows = store, run_id, started_at, []

    def counted(self, name: str, df: DataFrame) -> DataFrame:
        self.rows.append(Observation(f"rows of {name}"))
        return df.observe(self.rows[-1], F.count(F.lit(1)).alias("n"))

    def close(self, T: Tables, inventory: DataFrame, files: DataFrame, whole: DataFrame | None = None, found: DataFrame | None = None) -> Loaded:
        """Store the findings, the files (those in `whole` were read to the end) and the run, and let all of the load be seen."""
        store, spark = self.store, self.store.spark
        run_id = F.lit(self.run_id).cast("bigint")
        seen, raised = Observation("files"), Observation("findings")
        rows = inventory.join(files.select("dataset", "file_name", "file_id"), ["dataset", "file_name"], "left")
        rows = rows.join(whole.withColumn("_read", F.lit(True)), ["dataset", "file_name"], "left") if whole is not None else rows.withColumn("_read", F.lit(False))
        state = F.when(F.col("file_id").isNull(), "skipped").when(F.col("_read"), "loaded").otherwise("failed")
        jobs = {"file": partial(store.append, "file", rows.select("file_id", run_id.alias("run_id"), "dataset", "file_name", "sha256", state.alias("status")).observe(
            seen, *[F.count_if(F.col("status") == s).alias(s) for s in ("loaded", "skipped", "failed")]))}
        if found is not None:
            jobs["issue"] = partial(store.append, "issue", _issues(found, run_id, T.issue.agg(F.max("issue_id")).first()[0] or 0).observe(
                raised, *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning")]))
        sinks.side_by_side(jobs)
        counts = _observed(seen, "loaded", "skipped", "failed") | (_observed(raised, "errors", "warnings") if found is not None else {"errors": 0, "warnings": 0})
        run = literal_rows(spark, [(self.run_id, *(counts[c] for c in ("loaded", "skipped", "failed", "errors", "warnings")), sum(_observed(o, "n")["n"] for o in self.rows))],
                           "run_id bigint, files_loaded bigint, files_skipped bigint, files_failed bigint, errors bigint, warnings bigint, rows_loaded bigint")
        store.append("run", run.withColumn("files_seen", F.col("files_loaded") + F.col("files_skipped") + F.col("files_failed")).select(
            "run_id", F.lit(self.started_at).cast("timestamp").alias("started_at"), F.current_timestamp().alias("finished_at"), L.status_of_run().alias("status"),
            "files_loaded", "files_skipped", "files_failed", "rows_loaded", F.lit(TOOL_VERSION).alias("tool_version")))
        store.commit()
        T = store.frames(T)
        marts = {name: store.read(f"mart/{name}") for name in MARTS} | {"expiration_schedule": T.book_expirations}
        return Loaded(T, self.run_id, T.issue.filter(F.col("run_id") == self.run_id), marts)


def _observed(observation: Observation, *names: str) -> dict[str, int]:
    """What was counted during a write. A frame that turned out empty is taken out of the plan with its counters: that is none."""
    return observation.get if observation._jo.getRow().length() else dict.fromkeys(names, 0)


def _issues(found: DataFrame, run_id: Column, last: int) -> DataFrame:
    """Findings numbered by rule, file and row; those of one rule and some rows of a file are sorted together, never all of a rule or file."""
    files, file = F.coalesce(F.floor(F.col("file_id") / 256), F.lit(-1)), F.coalesce("file_id", F.lit(-1))
    rows = F.coalesce(F.floor(F.col("sheet_row") / 65536), F.lit(-1))
    return two_level_row_number(found.withColumn("_all", F.lit(0)), ["_all"], {"_rule": F.col("rule"), "_files": files, "_file": file, "_rows": rows},
                                [F.col("rule"), F.col("file_id"), F.col("sheet_row"), F.to_json("detail")], "issue_id", wider=["_rule", "_files"]).select(
        (F.col("issue_id") + last).alias("issue_id"), run_id.alias("run_id"), "file_id", "severity", "rule", "sheet_row", "detail")


def _findings(T: Tables, parse: DataFrame, availability: DataFrame, unknown: DataFrame, files: DataFrame, snapshots: list[int]) -> DataFrame:
    """Parse findings with their file, then the reconciliation rules and constraints over the snapshots that were loaded."""
    columns = ["file_id", "severity", "rule", "sheet_row", "detail"]
    by_file = lambda df, dataset: df.join(
        files.filter(F.col("dataset") == dataset).select("file_name", "file_id"), "file_name", "left").select(*columns)
    nowhere = lambda df: df.select(F.lit(None).cast("bigint").alias("file_id"), "severity", "rule", F.lit(None).cast("int").alias("sheet_row"), "detail")
    rules = [rule(T, snapshots) for rule in V.RULES.values()] if snapshots else []
    frames = [by_file(parse, RENT_ROLL), by_file(availability, AVAILABILITY), nowhere(unknown), *map(nowhere, rules)]
    if snapshots:
        loaded = T.lease.filter(F.col("snapshot_id").isin(snapshots))
        where = F.create_map(F.lit("unit_code"), F.col("unit_code"), F.lit("section"), F.col("section"))
        frames.append(V.violations(loaded, V.lease_constraints()).select(
            "file_id", F.lit("error").alias("severity"), F.col("violated").alias("rule"), F.lit(None).cast("int").alias("sheet_row"), where.alias("detail")))
        again = V.duplicate_keys(loaded, ["snapshot_id", "property_id", "unit_code", "section"])
        frames.append(nowhere(again.select(F.lit("error").alias("severity"), F.lit("lease_unit_unique").alias("rule"), where.alias("detail"))))
    return reduce(DataFrame.unionByName, frames)
