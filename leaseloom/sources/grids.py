"""Cell grids, file inventory and the insight artifact source."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaseloom import schemas as S
from leaseloom.operators.grammar import cells
from leaseloom.sources.streams import file_sha256


def grid_schema(n_cols: int) -> T.StructType:
    return T.StructType(
        [T.StructField("file_name", T.StringType()), T.StructField("sheet_row", T.IntegerType())]
        + [T.StructField(c, T.StringType()) for c in cells(n_cols)])


def grid_source(spark: SparkSession, path: str, n_cols: int, fmt: str = "parquet") -> DataFrame:
    """A table of sheet rows; columns the source lacks are blank, columns beyond `n_cols` are dropped."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.schema(grid_schema(n_cols)).format(fmt).load(path)


def file_inventory(spark: SparkSession, dirs: Mapping[str, str], pattern: str = "*.xlsx") -> DataFrame:
    """Files per dataset directory with size, time and SHA-256; lock files are left out. A file may be of any size: its content is read as a
    stream, where its hash is asked for."""
    def one(dataset: str, path: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(
            F.lit(dataset).alias("dataset"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("file_path"),
            file_sha256(spark, F.col("path")).alias("sha256"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at"))

    frames = [one(d, p) for d, p in dirs.items()]
    return reduce(DataFrame.unionByName, frames).filter(~F.col("file_name").startswith("~$"))


def grid_inventory(grid: DataFrame, dataset: str) -> DataFrame:
    """The files of a grid with a fingerprint of what is printed in them: two hashes of each row, added up, which combines before the
    shuffle and does not depend on the order the rows come in."""
    # each cell with its column, or a blank cell would let its neighbour's text move over
    cells = [F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit("")) for c in sorted(grid.columns) if c != "file_name"]
    lanes = [F.sum(F.xxhash64(F.lit(salt), *cells).cast("decimal(20,0)")).cast("string") for salt in ("rows", "again")]
    return grid.groupBy("file_name").agg(F.concat_ws(",", *lanes, F.count(F.lit(1)).cast("string")).alias("_s")).select(
        F.lit(dataset).alias("dataset"), "file_name", F.sha2("_s", 256).alias("sha256"))


def skip_unchanged(inventory: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """The files not loaded before byte for byte."""
    return inventory if force else inventory.join(manifest, ["dataset", "file_name", "sha256"], "left_anti")


_ARTIFACT = (
    "artifact_version int, as_of date, prompt_sha256 string, model string, generated_at timestamp, payload_source string, "
    "generator string, stats string, insights array<struct<scope:string,property_code:string,asset_key:string,category:string,"
    "priority:string,headline:string,detail:string,evidence:array<struct<metric:string,value:string,comparison:string>>,source_chunk:string>>"
)
# ---- fixed values of the artifact contract
ARTIFACT_VERSION = 1
_ARTIFACT_KEYS = ("artifact_version", "as_of", "prompt_sha256", "model", "generated_at", "payload_source", "generator", "stats", "insights")
_INSIGHT_KEYS = ("scope", "property_code", "asset_key", "category", "priority", "headline", "detail", "evidence", "source_chunk")


def insight_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Insights of the valid artifacts (one JSON document per file), and one reject row per invalid one."""
    docs = spark.read.option("wholetext", True).text(path).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("artifact"), "value")
    loose = F.from_json("value", "map<string,string>")
    strict = F.from_json("value", _ARTIFACT)
    each = F.from_json(F.col("raw")["insights"], "array<map<string,string>>")
    parsed = docs.withColumns({"raw": loose, "a": strict}).withColumn("items", F.coalesce(each, F.array().cast("array<map<string,string>>")))
    unknown = F.size(F.array_except(F.map_keys("raw"), F.array(*[F.lit(k) for k in _ARTIFACT_KEYS]))) > 0
    unknown_item = F.exists("items", lambda m: F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in _INSIGHT_KEYS]))) > 0)

    def broken(i):
        head, detail, n = F.length(i["headline"]), F.length(i["detail"]), F.size(i["evidence"])
        ok = (
            i["scope"].isin(*S.INSIGHT_SCOPES) & i["category"].isin(*S.INSIGHT_CATEGORIES) & i["priority"].isin(*S.PRIORITIES)
            & head.between(8, 120) & detail.between(10, 600) & n.between(1, 10)
            & ~F.exists(i["evidence"], lambda e: e["metric"].isNull() | e["value"].isNull()))
        return ~F.coalesce(ok, F.lit(False))

    reason = (
        F.when(F.col("raw").isNull(), "not a JSON object")
        .when(~F.col("a.artifact_version").eqNullSafe(F.lit(ARTIFACT_VERSION)), "artifact version not readable")
        .when(unknown | unknown_item, "unknown key")
        .when(F.col("a.as_of").isNull() | F.col("a.model").isNull() | F.col("a.generated_at").isNull(), "missing field")
        .when(~F.coalesce(F.col("a.prompt_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad prompt hash")
        .when(~F.coalesce(F.col("a.payload_source").isin("database", "file"), F.lit(False)), "bad payload source")
        .when(F.exists(F.coalesce("a.insights", F.array().cast("array<struct<scope:string,property_code:string,asset_key:string,category:string,priority:string,headline:string,detail:string,evidence:array<struct<metric:string,value:string,comparison:string>>,source_chunk:string>>")), broken), "bad insight"))
    checked = parsed.withColumn("reason", reason)
    rows = checked.filter(F.col("reason").isNull()).select(
        "artifact", "a.as_of", "a.prompt_sha256", "a.model", "a.generated_at", F.posexplode("a.insights").alias("seq", "i")
    ).select("artifact", "as_of", "prompt_sha256", "model", "generated_at", "seq", "i.*")
    rejects = checked.filter(F.col("reason").isNotNull()).select("artifact", "reason")
    return rows, rejects
