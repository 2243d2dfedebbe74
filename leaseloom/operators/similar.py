"""Names that look alike, for many names at once: trigrams as a posting table instead of every name against every other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.functions.scalars import trigrams


def _spread(names: DataFrame, column: str, key: str, size: str) -> DataFrame:
    """(key, size, gram): each distinct name with each of its trigrams, and how many it has."""
    grams = names.select(F.col(column).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_g", trigrams(F.col(key)))
    return grams.select(key, F.size("_g").alias(size), F.explode("_g").alias("gram"))


def postings(names: DataFrame, column: str) -> DataFrame:
    """The posting table of a column of names: gram, name and how many grams the name has. Stored, it answers any number of lookups."""
    return _spread(names, column, "name", "grams").select("gram", "name", "grams")


def similar_names(asked: DataFrame, posted: DataFrame, least: float = 0.0) -> DataFrame:
    """(term, name, similarity) of every asked `term` and name that share a trigram and are at least that similar. Only names that have a
    gram in common meet, and of these only those whose number of grams allows the similarity."""
    terms = _spread(asked, "term", "term", "_asked")
    met = terms.join(posted, "gram")
    if least > 0:
        # |a & b| / |a | b| can be no more than the smaller over the larger
        met = met.filter((F.col("grams") >= F.ceil(F.col("_asked") * least)) & (F.col("grams") <= F.floor(F.col("_asked") / least)))
    shared = met.groupBy("term", "name").agg(F.count(F.lit(1)).alias("_n"), F.first("_asked").alias("_a"), F.first("grams").alias("_b"))
    similarity = F.col("_n").cast("double") / (F.col("_a") + F.col("_b") - F.col("_n"))
    return shared.select("term", "name", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def nearest_names(asked: DataFrame, posted: DataFrame, names: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The `n` names most similar to each asked `term`, equal ones by name: term, place, name, similarity.

    A term that fewer than `n` names share a gram with is filled up with the first other names, at 0: of the first 2n names, more than n
    are left in any case, so these are all that is looked at."""
    first = [r[0] for r in names.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(2 * n).collect()]
    fill = asked.select("term").filter(F.col("term").isNotNull()).distinct().select(
        "term", F.explode(F.array(*[F.lit(x) for x in first]).cast("array<string>")).alias("name"), F.lit(0.0).alias("similarity"))
    every = similar_names(asked, posted).unionByName(fill).groupBy("term", "name").agg(F.max("similarity").alias("similarity"))
    place = Window.partitionBy("term").orderBy(F.desc("similarity"), "name")
    return every.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n).select("term", "place", "name", "similarity")
