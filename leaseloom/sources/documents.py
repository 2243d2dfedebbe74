"""Figures of stored JSON documents, whatever they are nested like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaseloom.functions.scalars import normalise_figure
from leaseloom.operators.payload import SECTION_ORDER, sort_lead
from leaseloom.operators.scan import cut, two_level_row_number


def variant_paths(documents: DataFrame, keys: list[str], root: str = "path") -> DataFrame:
    """Every scalar of the VARIANT column `value` that is neither null nor a boolean: `keys`, path and raw text. `root` is the column with the
    path of the document itself. Objects and lists are opened level by level, all documents together; a level is stored before the next one
    is opened, and the deepest document sets how many there are."""
    spark, found = documents.sparkSession, []
    level = cut(documents.select(*keys, F.col(root).alias("path"), "value"))
    while True:
        kind = F.schema_of_variant("value")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        scalar = ~inner & ~kind.isin("VOID", "BOOLEAN")
        found.append(level.filter(scalar).select(*keys, "path", F.variant_get("value", "$", "string").alias("raw")))
        boxes = level.filter(inner).withColumnsRenamed({"path": "_path", "value": "_value"})
        if boxes.isEmpty():
            return reduce(DataFrame.unionByName, found)
        opened = boxes.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = cut(opened.select(*keys, F.concat("_path", step).alias("path"), "value"))


def stored_payload_paths(spark: SparkSession, path: str) -> DataFrame:
    """The figures of a payload that `sinks.payload_export` wrote, as `payload.flatten_paths` gives them of the payload itself: snapshot_id,
    path, raw, value. A row's place in its section is that of the section's order, so it does not matter how the lines lie."""
    frames = []
    for name, order in SECTION_ORDER.items():
        rows = spark.read.text(f"{path}/{name}").select(F.parse_json("value").alias("value"))
        rows = rows.withColumn("snapshot_id", F.variant_get("value", "$.snapshot_id", "int"))
        if order:
            kinds = {"revenue_capture_pct": "decimal(38,2)", "expiry_month": "date"}
            rows = rows.withColumns({f"_{c}": F.variant_get("value", f"$.{c}", kinds.get(c, "string")) for c in order})
            by = [F.col(f"_{c}") for c in order]
            rows = two_level_row_number(rows, ["snapshot_id"], {"_lead": sort_lead(name, by[0])}, by, "_i")
            rows = rows.withColumn("path", F.concat(F.lit(f"$.{name}["), (F.col("_i") - 1).cast("string"), F.lit("]")))
        else:
            rows = rows.withColumn("path", F.lit(f"$.{name}"))
        frames.append(rows.select("snapshot_id", "path", "value"))
    every = variant_paths(reduce(DataFrame.unionByName, frames), ["snapshot_id"])
    return every.filter(~F.col("path").endswith(".snapshot_id")).withColumn("value", normalise_figure(F.col("raw")))
