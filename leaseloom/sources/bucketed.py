"""The two facts as bucketed tables, so that leases and their lines meet on `lease_id` without a shuffle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from leaseloom.sources.folders import shared_folder
from leaseloom.tables import Tables

FACTS = ("lease", "lease_charge")


def bucket_table(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """`df` as a catalog table, a folder for each snapshot and in it a sorted file for each bucket of leases."""
    spark = df.sparkSession
    (
        df.repartition(buckets, "lease_id").write.mode("overwrite").format("parquet").option("path", f"{shared_folder(spark)}/{table}")
        .partitionBy("snapshot_id").bucketBy(buckets, "lease_id").sortBy("lease_id").saveAsTable(table)
    )
    return spark.table(table)


def co_located(T: Tables, prefix: str, buckets: int) -> Tables:
    """The bundle with its facts as bucketed tables named `prefix`_lease and `prefix`_lease_charge. A bucket holds a lease and all of its
    lines, and they meet on its id alone, so what is joined or summed by lease stays where it is read; `buckets` suits the facts when a snapshot's bucket of lines fits a
    task. Stored aggregates stay with the bundle: the rows are the same."""
    kept = {n: getattr(T, n) for n in T.__dataclass_fields__ if n.startswith("book_")}
    facts = {n: bucket_table(getattr(T, n), f"{prefix}_{n}", buckets) for n in FACTS}
    return replace(T.with_frames(**facts, **kept), lease_key=("lease_id",))
