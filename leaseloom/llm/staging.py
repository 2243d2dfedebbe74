"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leaseloom.sources.folders import shared_folder


class Work:
    """A work folder: `stored` tables are deleted when the block ends, `kept` ones stay for the result that is read from them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.names = spark, shared_folder(spark), []

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *error: object) -> None:
        for name in self.names:
            self.delete(name)

    def delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        self.names.append(name)
        return self.kept(name, df)


def set_aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns of these names under others, so that an operator can use the names, and the names they had."""
    taken, aside = set(df.columns) | names, {}
    for column in df.columns:
        if column in names:
            free = f"{column}_"
            while free in taken:
                free += "_"
            taken.add(free)
            aside[column] = free
    return df.withColumnsRenamed(aside), {free: column for column, free in aside.items()}
