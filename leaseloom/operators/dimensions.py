"""Dimension merges and load-time key resolution.

"The last one wins" is a `max_by` aggregate ordered by (source, file, sheet row): it combines on the
map side, so a key printed in very many rows never has to be sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.functions.scalars import derive_asset_key, derive_book_type, is_concession
from leaseloom.operators.scan import cut, two_level_row_number

SEEN = ("file_name", "sheet_row")
SHEET_BITS = 32  # a sheet row is an int, so the ids of two rows never meet


def _last(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def merge_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """`as_of_date, report_month`: the first non-null month of the new files (`file_name`) in file order, else the old one."""
    first = F.min_by("report_month", F.when(F.col("report_month").isNotNull(), F.col("file_name")))
    months = new.groupBy("as_of_date").agg(first.alias("_new"))
    return months.join(old.select("as_of_date", F.col("report_month").alias("_old")), "as_of_date", "full").select(
        "as_of_date", F.coalesce("_new", "_old").alias("report_month"))


def merge_property(old: DataFrame, new: DataFrame) -> DataFrame:
    """`property_code, property_name, asset_key, book_type`. `new` carries `source_rank` (availability
    after rent roll) and `file_name`; codes are one property whatever their case, and a known property
    keeps its spelling."""
    seen = new.groupBy(F.lower("property_code").alias("_key")).agg(
        F.max_by(F.struct("property_code", "property_name"), F.struct("source_rank", "file_name")).alias("n"))
    known = old.select(F.lower("property_code").alias("_key"), F.struct("property_code", "property_name").alias("o"))
    merged = seen.join(known, "_key", "full").select(
        F.coalesce("o.property_code", "n.property_code").alias("property_code"),
        F.coalesce("n.property_name", "o.property_name").alias("property_name"))
    return merged.withColumns({
        "asset_key": derive_asset_key(F.col("property_code")), "book_type": derive_book_type(F.col("property_code"))})


def merge_unit_type(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["property_id", "unit_type_code"]
    seen = new.filter(F.col("unit_type_code").isNotNull()).select(*keys).distinct()
    return old.select(*keys).unionByName(seen.join(old, keys, "left_anti"))


def merge_unit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per (property, unit) the last non-null type and area, falling back on what was known."""
    keys = ["property_id", "unit_code"]
    order = F.struct(*SEEN)
    seen = new.groupBy(*keys).agg(
        _last(F.col("unit_type_code"), order).alias("_t"), _last(F.col("unit_sqft"), order).alias("_s"))
    known = old.select(*keys, F.col("unit_type_code").alias("_ot"), F.col("unit_sqft").alias("_os"))
    return seen.join(known, keys, "full").select(
        *keys, F.coalesce("_t", "_ot").alias("unit_type_code"), F.coalesce("_s", "_os").alias("unit_sqft"))


def merge_resident(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest printed name; a resident printed without one is named by its id."""
    seen = new.filter(F.col("resident_id").isNotNull()).groupBy("resident_id").agg(
        F.max_by(F.coalesce("resident_name", "resident_id"), F.struct(*SEEN)).alias("_n"))
    return seen.join(old.select("resident_id", F.col("display_name").alias("_o")), "resident_id", "full").select(
        "resident_id", F.coalesce("_n", "_o").alias("display_name"))


def unknown_codes(lines: DataFrame, summaries: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The code dimension with the codes it lacked (as `other`, unverified), and a warning for each. The codes are stored, since both are read
    off them."""
    seen = cut(lines.select("charge_code").distinct().unionByName(summaries.select("charge_code").distinct()).distinct())
    missing = seen.join(codes.select("charge_code"), "charge_code", "left_anti")
    added = missing.select(
        "charge_code", F.lit("other").alias("category"), F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("label_verified"), is_concession(F.col("charge_code")).alias("is_concession"))
    issues = missing.select(
        F.lit("warning").alias("severity"), F.lit("unknown_charge_code").alias("rule"),
        F.create_map(F.lit("charge_code"), F.col("charge_code")).alias("detail"))
    return codes.unionByName(added), issues


def file_ids(files: DataFrame, start: int = 0) -> DataFrame:
    """Number the files above `start`; files are bucketed by the head of their hash, so numbering is
    spread over the tasks."""
    named = files.withColumn("_all", F.lit(0))
    numbered = two_level_row_number(
        named, ["_all"], {"_bucket": F.substring("sha256", 1, 3)}, [F.col("sha256"), F.col("file_name")], "file_id")
    return numbered.withColumn("file_id", F.col("file_id") + start).drop("_all")


def row_id(file_id: Column, sheet_row: Column) -> Column:
    """The identity of a sheet row: the file in the upper half, the row in the lower."""
    return F.shiftleft(file_id.cast("bigint"), SHEET_BITS) + sheet_row


def resolve_keys(facts: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Join each dimension's ids onto the facts by its natural key."""
    for dim, natural in dims:
        facts = facts.join(dim, list(natural))
    return facts


def upsert_rollups(df: DataFrame, keys: Sequence[str], order: Sequence[str] = SEEN) -> DataFrame:
    """The last printed row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert_availability(df: DataFrame) -> DataFrame:
    return upsert_rollups(df, ["snapshot_id", "property_id"], ["file_name"])
