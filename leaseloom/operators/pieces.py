"""Chunks that exceed a context, cut between their rows into as many documents as they need.

The rows of a chunk keep their order. Where a row begins is the sum of the lengths before it, so the piece it goes to is a division of that
sum: a prefix sum and no loop. Each piece repeats the parts that are no lists, so each can be read by itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.functions.scalars import tokens_of_length
from leaseloom.operators import payload as P
from leaseloom.operators.scan import cut, two_level_row_number

CHUNK = ["snapshot_id", "chunk"]
PIECE = [*CHUNK, "piece"]


def longest_document(num_ctx: int, headroom: float = 1.3) -> int:
    """The most characters whose token estimate, with headroom, still fits."""
    tokens = int(num_ctx / headroom)
    while (tokens + 1) * headroom <= num_ctx:
        tokens += 1
    while tokens * headroom > num_ctx:
        tokens -= 1
    return 4 * tokens + 3


def piece_plan(parts: DataFrame, expected: Mapping[str, bool], num_ctx: int, headroom: float = 1.3) -> DataFrame:
    """How each chunk is cut: `length` as one document, `whole` if that fits, and else `stride`, the characters of rows that begin in one
    piece. A piece holds less than a stride and one more row, so with the longest row taken off what is left beside the other parts, it
    fits. Where nothing is left there is no stride, and `reason` says why."""
    most = longest_document(num_ctx, headroom)
    per_part = parts.groupBy(*CHUNK, "part", "is_list").agg(
        F.sum(F.length("json")).alias("_chars"), F.count(F.lit(1)).alias("_n"), F.max(F.length("json")).alias("_longest"))
    listed = F.col("is_list")
    per_chunk = per_part.groupBy(*CHUNK).agg(
        (F.sum(F.col("_chars") + F.when(listed, F.col("_n") - 1).otherwise(0)) + P.frame_length(expected)).alias("length"),
        (F.coalesce(F.sum(F.when(~listed, F.col("_chars"))), F.lit(0)) + P.frame_length(expected)).alias("_fixed"),
        F.coalesce(F.max(F.when(listed, F.col("_longest"))), F.lit(0)).alias("_row"))
    # a row costs its comma too
    stride = F.lit(most) - F.col("_fixed") - F.col("_row")
    whole = F.col("length") <= most
    reason = F.when(~whole & (stride < 1), F.format_string(
        "a row of %d characters does not fit beside %d characters of other parts: %d fit", "_row", "_fixed", F.lit(most)))
    return per_chunk.select(*CHUNK, F.col("length").cast("bigint").alias("length"), whole.alias("whole"),
                            F.when(~whole & (stride >= 1), stride).cast("bigint").alias("stride"), reason.alias("reason"))


def split_rows(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """The parts with the piece they go to, from 1: list rows stand in one piece, other parts in every piece of their chunk. Chunks without
    a stride that are not whole have none."""
    planned = parts.join(plan.filter(F.col("whole") | F.col("stride").isNotNull()).select(*CHUNK, "whole", "stride"), CHUNK)
    long = planned.filter(F.col("is_list") & ~F.col("whole"))
    # what begins alike is one bucket, so a chunk with very many rows is not sorted in one task
    placed = two_level_row_number(long, CHUNK, {"_part": F.col("part"), "_lead": F.substring("seq", 1, 12)}, [F.col("seq"), F.col("json")], "_at",
                                  weight=F.length("json") + 1).withColumn("_bin", F.floor(F.col("_at") / F.col("stride")))
    # a row longer than a stride leaves bins empty: pieces are numbered without them, by one row a bin
    bins = two_level_row_number(placed.select(*CHUNK, "_bin").distinct(), CHUNK, {"_all": F.floor(F.col("_bin") / 4096)}, [F.col("_bin")], "piece")
    columns = [*PIECE, "part", "is_list", "seq", "json"]
    rows = placed.join(bins, [*CHUNK, "_bin"]).select(*columns)
    shared = planned.filter(~F.col("is_list") & ~F.col("whole")).join(bins.select(*PIECE), CHUNK).select(*columns)
    return planned.filter("whole").withColumn("piece", F.lit(1).cast("bigint")).select(*columns).unionByName(rows).unionByName(shared)


def split_documents(parts: DataFrame, expected: Mapping[str, bool], num_ctx: int, headroom: float = 1.3) -> DataFrame:
    """One row for each piece of each chunk: its document and `tokens`, which fit the context with headroom. The pieces of a chunk hold each of
    its rows once, in order. A chunk of which a single row does not fit has one row without a document, with the reason."""
    # both are read several times: rows, pieces and verdicts come from them
    parts = cut(parts)
    plan = cut(piece_plan(parts, expected, num_ctx, headroom))
    documents = P.documents(split_rows(parts, plan), PIECE, expected)
    counted = documents.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("pieces"))
    made = documents.join(counted, CHUNK).select(
        *PIECE, "pieces", "document", tokens_of_length(F.length("document")).alias("tokens"), F.lit(None).cast("string").alias("reason"))
    none: Column = F.lit(None)
    refused = plan.filter(F.col("reason").isNotNull()).select(
        *CHUNK, none.cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("pieces"), none.cast("string").alias("document"),
        tokens_of_length(F.col("length")).alias("tokens"), "reason")
    return made.unionByName(refused)


def size_report(asset_parts: DataFrame, positioning: DataFrame, reduce_parts: DataFrame, num_ctx: int, headroom: float = 1.3) -> DataFrame:
    """Length, tokens and fit of every chunk of a run, whatever its kind, before any document is asked for."""
    sizes = [P.chunk_sizes(asset_parts, P.ASSET_PARTS), P.chunk_sizes(reduce_parts, P.REDUCE_PARTS),
             positioning.select(*CHUNK, F.length("document").cast("bigint").alias("length")).withColumn("tokens", tokens_of_length(F.col("length")))]
    every = sizes[0].unionByName(sizes[1]).unionByName(sizes[2])
    return P.chunk_fit(every, num_ctx, headroom).withColumn("kind", F.split_part("chunk", F.lit(":"), F.lit(1)))
