"""Small fixed tables as literal relations, whose exact size the planner knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """`rows` under the DDL `schema`, as a literal relation (not a parallelised collection)."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    relation = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")
    return relation.select(*[F.col(n).cast(t).alias(n) for n, t in fields])
