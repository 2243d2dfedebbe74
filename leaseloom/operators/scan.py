"""Ordered prefix operators that never put a whole group into one task.

A plain window over one key sorts that key's rows in a single task. Here the rows of a key are cut
into position chunks; a window runs inside each chunk, the chunk totals (one row per chunk) are
scanned, and what earlier chunks hand over is joined back on (key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.sources.folders import shared_folder

CHUNK_ROWS = 1 << 17
CHUNK = "_chunk"


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read back: what is built on it reads the table
    instead of repeating the plan, and lost executors cost nothing before it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_chunks(df: DataFrame, pos: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the chunk that each row belongs to; rows of a key and chunk are worked on together."""
    return df.withColumn(CHUNK, F.floor(F.col(pos) / F.lit(chunk_rows)))


def chunk_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys, _last, _n`: the last chunk and the rows of each key, stored, so that the planner knows how few they are."""
    return cut(df.groupBy(*keys).agg(F.max(CHUNK).alias("_last"), F.count(F.lit(1)).alias("_n")))


def dealt_by_chunk(df: DataFrame, keys: Sequence[str], pos: str, n_rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with whole chunks in as many tasks as its `n_rows` make chunks, each sorted once for all scans that follow. A partition so holds
    about a chunk in memory, however well its rows compress on the way there."""
    tasks = max(-(-n_rows // chunk_rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys, CHUNK).sortWithinPartitions(*keys, CHUNK, pos)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    *,
    lasts: Mapping[str, Column] | None = None,
    prior_lasts: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    handing: DataFrame | None = None,
    whole: bool = False,
) -> DataFrame:
    """Running columns over `keys` in `pos` order; `df` comes from `with_chunks`.

    `lasts` is the last non-null value up to and including the row, `prior_lasts` up to but
    excluding it, `sums` the inclusive running sum. The chunk totals are taken from `handing`: the rows of
    `df` whose key has more than one chunk, or all of them where it is not given. With `whole` every key is known to be one chunk, and
    nothing is handed over.
    """
    lasts, prior_lasts, sums = dict(lasts or {}), dict(prior_lasts or {}), dict(sums or {})
    wanted = {**lasts, **prior_lasts, **sums}
    inputs = {f"_in_{n}": c for n, c in wanted.items()}
    staged = df.withColumns(inputs)
    group = [*keys, CHUNK]

    local = Window.partitionBy(*group).orderBy(pos)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = staged.withColumns(
        {
            **{f"_l_{n}": F.last(f"_in_{n}", ignorenulls=True).over(upto) for n in lasts},
            **{f"_l_{n}": F.last(f"_in_{n}", ignorenulls=True).over(earlier) for n in prior_lasts},
            **{f"_l_{n}": F.sum(f"_in_{n}").over(upto) for n in sums},
        }
    )
    if whole:
        return rows.select(
            *df.columns, *[F.col(f"_l_{n}").alias(n) for n in (*lasts, *prior_lasts)], *[F.coalesce(f"_l_{n}", F.lit(0)).alias(n) for n in sums])
    # what each chunk hands to the later chunks of its key
    totals = (staged if handing is None else handing.withColumns(inputs)).groupBy(*group).agg(
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(pos))).alias(f"_t_{n}")
            for n in (*lasts, *prior_lasts)
        ],
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *group,
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in (*lasts, *prior_lasts)],
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
    ).filter(F.col(CHUNK) > 0)
    return rows.join(carry, group, "left").select(
        *df.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in (*lasts, *prior_lasts)],
        *[(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def two_level_row_number(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Mapping[str, Column],
    order: Sequence[Column],
    name: str,
    weight: Column | None = None,
    wider: Sequence[str] = (),
) -> DataFrame:
    """`row_number()` over `keys`, numbered bucket by bucket.

    `bucket` columns must sort in agreement with `order`: every row of a smaller bucket precedes
    every row of a larger one. With `weight` the result is the exclusive running sum of the weights
    (the start offset of each row) instead of the row number. Where there may be many buckets, `wider` names the first of the bucket
    columns, by which the buckets themselves are placed in two levels.
    """
    names = list(bucket)
    staged = df.withColumns({**dict(bucket), "_w": weight if weight is not None else F.lit(1)})
    group = [*keys, *names]
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(*group).agg(F.sum("_w").alias("_n"))
    if wider:
        offsets = two_level_row_number(totals, keys, {n: F.col(n) for n in wider}, [F.col(n) for n in names], "_base", weight=F.col("_n")).drop("_n")
    else:
        offsets = totals.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*group).orderBy(*order)
    if weight is None:
        within = F.row_number().over(local)
    else:
        within = F.coalesce(F.sum("_w").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        staged.withColumn("_within", within)
        .join(offsets, group)
        .select(*df.columns, (F.col("_base") + F.col("_within")).cast("bigint").alias(name))
    )


def grouped_median_disc(
    df: DataFrame, keys: Sequence[str], value: str, width: Column
) -> DataFrame:
    """Exact discrete median per group: `keys, median, n`.

    Values are first counted per (group, value), then located in two steps: the value range
    [k*width, (k+1)*width) holding the middle row, and the value inside it. No step sees more rows of
    a group than it has ranges, or than a range has distinct values.
    """
    # both steps read the counts: they are stored, so that `df` is read once
    counted = cut(df.groupBy(*keys, F.floor(F.col(value) / width).alias("_range"), value).agg(F.count(F.lit(1)).alias("_n")))
    in_group = Window.partitionBy(*keys)
    ranges = (
        counted.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
        .withColumn("_upto", F.sum("_rn").over(in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_rn").over(in_group))
        .withColumn("_target", F.floor((F.col("n") + 1) / F.lit(2)))
        .filter((F.col("_upto") - F.col("_rn") < F.col("_target")) & (F.col("_target") <= F.col("_upto")))
        .select(*keys, "_range", "n", "_target", (F.col("_upto") - F.col("_rn")).alias("_before"))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(value)
    return (
        counted.join(ranges, [*keys, "_range"])
        .withColumn("_cum", F.col("_before") + F.sum("_n").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_cum") - F.col("_n") < F.col("_target")) & (F.col("_target") <= F.col("_cum")))
        .select(*keys, F.col(value).alias("median"), "n")
    )
