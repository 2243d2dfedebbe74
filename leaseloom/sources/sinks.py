"""Sinks and seeds: bulk writes, mart materialisation, exports. Replacement is in `versions`."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaseloom import schemas as S
from leaseloom.functions.scalars import canonical_json, is_concession
from leaseloom.sources.literals import literal_rows

T = TypeVar("T")


def charge_code_seed(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """The seeded charge-code dimension; codes already present keep their own classification."""
    seed = literal_rows(spark, S.CHARGE_CODES, S.CHARGE_CODE_SCHEMA).withColumn(
        "is_concession", is_concession(F.col("charge_code"))
    )
    if existing is None:
        return seed
    return existing.unionByName(seed.join(existing.select("charge_code"), "charge_code", "left_anti"))


def balanced(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of one output partition together, split again where a partition is large and merged where
    it is small, so neither a hot partition nor a tiny one sets the file count."""
    return df.hint("rebalance", *keys) if keys else df


def side_by_side(jobs: Mapping[str, Callable[[], T]], at_once: int = 4) -> dict[str, T]:
    """Run independent writes as concurrent Spark jobs, so that small ones fill the idle cores."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def bulk_write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = balanced(df, partition_by).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def materialise_marts(marts: Mapping[str, Callable[[], DataFrame]], out: str) -> dict[str, str]:
    """Write each mart under `out`, in the order given (dependencies first), one folder per mart."""
    paths = {}
    for name, build in marts.items():
        paths[name] = f"{out}/{name}"
        build().write.mode("overwrite").partitionBy("snapshot_id").parquet(paths[name])
    return paths


def write_csv(df: DataFrame, out: str) -> None:
    """CSV with a header, nulls as empty fields; arrays as their text form."""
    flat = df.select(*[
        F.array_join(c, ",").alias(c) if t.startswith("array") else
        F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c)
        for c, t in df.dtypes
    ])
    flat.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(out)


def payload_export(sections: Mapping[str, DataFrame], out: str) -> None:
    """The analytical payload as JSON lines: one folder per section, one canonical object per row."""
    for name, df in sections.items():
        df.select(canonical_json(df).alias("value")).write.mode("overwrite").text(f"{out}/{name}")
