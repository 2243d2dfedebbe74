"""The registered queries: output columns, the Spark plan and, where SQL can say it, the oracle body."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.operators import grammar as G
from leaseloom.operators import marts as M
from leaseloom.operators import payload as P
from leaseloom.operators.scan import cut
from leaseloom.plans import driver_tables as D
from leaseloom.plans import report_grids
from leaseloom.plans.load import Loaded, load_reports
from leaseloom.sources.folders import shared_folder
from leaseloom.sources.grids import grid_source
from leaseloom.sources.sinks import bulk_write, side_by_side
from leaseloom.tables import Tables


class Context:
    """The loaded core frames of one data directory; loaded once per application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def T(self) -> Tables:
        return D.core_tables(self.spark, self.sf_dir)

    @cached_property
    def kpi(self) -> DataFrame:
        return M.property_snapshot_kpi(self.T)

    @cached_property
    def matrix(self) -> DataFrame:
        return M.property_profitability(self.T)

    def _stored(self, grid: DataFrame, n_cols: int) -> DataFrame:
        # a grid is input data: it is stored once and read back through the grid source
        path = shared_folder(self.spark)
        bulk_write(grid, path)
        return grid_source(self.spark, path, n_cols)

    @cached_property
    def rent_grid(self) -> DataFrame:
        return self._stored(report_grids.rent_roll_grid(self.T), S.RENT_ROLL_COLUMNS)

    @cached_property
    def availability_grid(self) -> DataFrame:
        return self._stored(report_grids.availability_grid(self.T), S.AVAILABILITY_COLUMNS)

    @cached_property
    def rows(self) -> DataFrame:
        return self.parsed.rows

    @cached_property
    def parsed(self) -> G.ParsedRentRolls:
        return G.parse_rent_rolls(self.rent_grid)

    @cached_property
    def loads(self) -> list[Loaded]:
        """Three loads into one place: the reports up to 1997, the later ones, and all of them again."""
        out, T, loads = shared_folder(self.spark), None, []
        number = F.regexp_extract("file_name", r"_(\d+)", 1).cast("int")
        for wanted in (number < 199_800, number >= 199_800, F.lit(True)):
            loads.append(load_reports(self.spark, self.rent_grid.filter(wanted), self.availability_grid.filter(wanted), out, known=T))
            T = loads[-1].tables
        return loads

    @cached_property
    def sections(self) -> dict[str, DataFrame]:
        """The payload's row sets, stored: lineage, chunks, hashes and exports all read them."""
        return side_by_side({name: partial(cut, df) for name, df in P.payload_sections(self.T).items()})

    @cached_property
    def paths(self) -> DataFrame:
        """Every figure of every snapshot's payload, stored once for the checks that look figures up."""
        return cut(P.flatten_paths(self.sections))

    def raw(self, name: str) -> DataFrame:
        return D.read(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Entry:
    columns: dict[str, str]
    build: Callable[[Context], DataFrame]
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def register(key: str, columns: str, build: Callable[[Context], DataFrame], sql: str | None = None) -> None:
    """`columns` is `name:kind ...` with kinds i(nteger) d(ouble) s(tring) t (date) b(oolean)."""
    if key in ENTRIES:
        raise ValueError(f"{key} registered twice")
    ENTRIES[key] = Entry(dict(c.split(":") for c in columns.split()), build, sql)


_TYPES = {"i": "bigint", "d": "double", "s": "string", "t": "date", "b": "boolean"}


def present(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Plain output types: money as double, counts as long, arrays and maps as text."""
    kinds = dict(df.dtypes)

    def one(name: str, kind: str):
        c, t = F.col(name), kinds[name]
        if kind == "s" and t == "array<string>":
            c = F.array_join(c, ",")
        elif kind == "s" and t.startswith(("map", "struct", "array")):
            c = F.to_json(c)
        c = c.cast(_TYPES[kind])
        return (c + F.lit(0.0)).alias(name) if kind == "d" else c.alias(name)

    return df.select(*[one(n, k) for n, k in columns.items()])


_contexts: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    return _contexts.setdefault((spark.sparkContext.applicationId, sf_dir), Context(spark, sf_dir))


def run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = ENTRIES[key]
    return present(entry.build(context(spark, sf_dir)), entry.columns)
