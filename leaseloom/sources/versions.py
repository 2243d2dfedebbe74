"""Tables that change together.

A store is a folder of tables. What is written goes to folders of its own, and one small state file says which folders a table is made of;
readers see a write when the next state file is in place, and all of its tables at once. A job that dies before leaves the old state as it
was. Old folders stay readable until they are swept."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leaseloom.sources.sinks import balanced
from leaseloom.tables import Tables

PARTITION = "snapshot_id"


def _version() -> str:
    """A folder that no other write has."""
    return f"version=v{uuid.uuid4().hex}"


class Store:
    """The newest state of the tables under `path`, and what this writer has added to it so far.

    A table is partitioned by report date if it is written by `replace`; report dates are calendar days, which bounds the state file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        states = [s for s in self._names("_state") if s.endswith(".json")]
        self.number = max((int(s.removesuffix(".json")) for s in states), default=0)
        self.tables: dict[str, dict] = self._state(self.number) if self.number else {}

    # ---- files -------------------------------------------------------------
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("_state").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _state(self, number: int) -> dict[str, dict]:
        return json.loads(self.spark.read.text(f"{self.path}/_state/{number:08d}.json", wholetext=True).first()[0])

    # ---- reading -----------------------------------------------------------
    def has(self, name: str) -> bool:
        return name in self.tables

    def read(self, name: str) -> DataFrame:
        """The table with what this writer has added, under its declared schema, which also an empty one has."""
        table = self.tables[name]
        schema = StructType.fromJson(table["schema"])
        if not table["parts"]:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/{name}"
        # the reader finds the version in the folder names and adds it behind the declared columns
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{p}" for p in table["parts"]]).select(*schema.names)

    def frames(self, known: Tables) -> Tables:
        """`known` with the stored tables it has a place for."""
        return known.with_frames(**{n: self.read(n) for n in self.tables if n in Tables.__dataclass_fields__})

    # ---- writing -----------------------------------------------------------
    def _put(self, name: str, df: DataFrame, parts: list[str]) -> DataFrame:
        self.tables[name] = {"schema": df.schema.jsonValue(), "parts": parts}
        return self.read(name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """`df` is all of the table."""
        version = _version()
        df.write.parquet(f"{self.path}/{name}/{version}")
        return self._put(name, df, [version])

    def append(self, name: str, df: DataFrame) -> DataFrame:
        before, version = self.tables[name]["parts"] if self.has(name) else [], _version()
        df.write.parquet(f"{self.path}/{name}/{version}")
        return self._put(name, df, [*before, version])

    def replace(self, name: str, df: DataFrame, snapshots: Sequence[int], touched: DataFrame | None = None) -> DataFrame:
        """`df` is all that the table has of these report dates, or of the books in `touched` (snapshot_id, property_id) alone: the other
        books of these dates are carried over then. Written once; other dates keep their folders, and a date without rows loses its own."""
        rows = df
        if touched is not None and self.has(name):
            kept = self.read(name).filter(F.col(PARTITION).isin(*snapshots)) if snapshots else self.read(name).limit(0)
            rows = df.unionByName(kept.join(touched.select(PARTITION, "property_id"), [PARTITION, "property_id"], "left_anti").select(*df.columns))
        version = _version()
        folder = f"{name}/{version}"
        balanced(rows, (PARTITION,)).write.partitionBy(PARTITION).parquet(f"{self.path}/{folder}")
        found = [s for s in self._names(folder) if s.startswith(f"{PARTITION}=")]
        dated = {f"{PARTITION}={s}" for s in snapshots}
        if not set(found) <= dated:
            raise ValueError(f"{name}: rows of report dates that are not replaced: {sorted(set(found) - dated)[:3]}")
        before = self.tables[name]["parts"] if self.has(name) else []
        others = [p for p in before if p.rsplit("/", 1)[-1] not in dated]
        return self._put(name, df, [*others, *(f"{version}/{s}" for s in found)])

    def commit(self) -> None:
        """Let readers see it. Fails if another writer was faster; what this one wrote is then seen by nobody."""
        files, name = self._files(), f"_state/{self.number + 1:08d}.json"
        draft, target = self._path(f"_state/{_version()}.draft"), self._path(name)
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(self.tables).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"{self.path}: state {self.number + 1} is there already; another writer was faster")
        self.number += 1

    def sweep(self, keep: int = 1) -> None:
        """Delete the folders that none of the newest `keep` states is made of, and the older states. Not while a writer is at work."""
        files, states = self._files(), [s for s in self._names("_state") if s.endswith(".json")]
        kept = states[-max(keep, 1):]
        used = {(name, part.split("/")[0]) for s in kept for name, t in self._state(int(s.removesuffix(".json"))).items() for part in t["parts"]}
        dated = {(name, part) for s in kept for name, t in self._state(int(s.removesuffix(".json"))).items() for part in t["parts"] if "/" in part}
        for name in {n for s in states for n in self._state(int(s.removesuffix(".json")))}:
            for version in self._names(name):
                if (name, version) not in used:
                    files.delete(self._path(f"{name}/{version}"), True)
                    continue
                for day in self._names(f"{name}/{version}"):
                    if day.startswith(f"{PARTITION}=") and (name, f"{version}/{day}") not in dated:
                        files.delete(self._path(f"{name}/{version}/{day}"), True)
        for s in states[:-len(kept)]:
            files.delete(self._path(f"_state/{s}"), False)


def replace_snapshot_insights(store: Store, df: DataFrame, snapshot_id: int, allow_empty: bool = False) -> DataFrame:
    """Replace one snapshot's insights wholesale; an empty replacement is refused unless allowed."""
    rows = df.filter(F.col(PARTITION) == snapshot_id)
    if not allow_empty and rows.isEmpty():
        raise ValueError(f"no insight survived for snapshot {snapshot_id}; refusing to replace")
    insights = store.replace("insight", rows, [snapshot_id])
    store.commit()
    return insights
