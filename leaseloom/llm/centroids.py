"""Centroid clustering of book profiles, with Ptolemaic pivots.

For a profile x, a centroid c and two pivots p and s, Ptolemy's inequality gives |x c| >= | |x p| |c s| - |x s| |c p| | / |p s|. The pivots
are fixed (the first centroids) and the profiles' distances to them are stored with the profiles, so a round computes those of the centroids
alone, bounds every distance from below, and looks only at the centroids whose bound does not exceed a distance already known. Those are compared in whole
numbers, so rounding never decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaseloom.llm.staging import Work
from leaseloom.sources.literals import literal_rows

#: Figures become floor(256 x); what does not fit is an error, so that squared distances are whole numbers of 64 bits.
SCALE, LARGEST = 256, 1 << 27
#: Pivots at most, and profiles worked on at once.
PIVOTS, _ROWS = 64, 1024
#: Stored distances are rounded to 24 bits: what that may add to a product, doubled, and a little more for the other steps.
_SLACK, _SHRINK = 2.0**-22, 1 - 2.0**-40


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b."""
    gap = a - b
    return (gap * gap).sum(-1)


def pivots_of(points: np.ndarray, count: int) -> np.ndarray:
    """`count` of the points at most, all different: the first one and then always the one farthest from those taken (of equal ones the
    first)."""
    taken = [0]
    gaps = squared(points, points[0])
    while len(taken) < count and gaps.max() > 0:
        taken.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, squared(points, points[taken[-1]]))
    return points[taken]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(rows, p) for p in pivots], 1).astype(float))


@dataclass(frozen=True)
class Round:
    """The centroids of a round with what bounds need: their distances to the pivots and those between the pivots."""

    centroids: np.ndarray
    to_pivots: np.ndarray
    gaps: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, pivots: np.ndarray) -> Round:
        return Round(centroids.copy(), distances(centroids, pivots), distances(pivots, pivots))

    def lower_bounds(self, known: np.ndarray) -> np.ndarray:
        """Squared distances that no profile falls below, from `known`, its stored distances to the pivots. Of all pairs of pivots, those of
        the pivot nearest to the centroid and the two nearest to the profile are tried: they leave the least room."""
        bound = np.zeros((len(known), len(self.centroids)))
        if len(self.gaps) < 2:
            return bound
        rows, others = np.arange(len(known)), np.arange(len(self.centroids))
        p = self.to_pivots.argmin(1)
        for s in np.argpartition(known, 1, 1)[:, :2].T:
            one = known[:, p] * self.to_pivots[:, s].T
            two = known[rows, s][:, None] * self.to_pivots[others, p]
            gap = self.gaps[s][:, p]
            fits = gap > 0
            room = (np.abs(one - two) - _SLACK * (one + two)) / np.where(fits, gap, 1)
            np.maximum(bound, np.where(fits, room, 0), out=bound)
        return bound * bound * _SHRINK

    def nearest(self, rows: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each profile the number of its nearest centroid (of equally near ones the smallest), the exact squared distance, and how many
        centroids were compared exactly."""
        bound = self.lower_bounds(known)
        best = squared(rows, self.centroids[bound.argmin(1)])
        left = bound <= best[:, None].astype(float)
        at, c = np.nonzero(left)
        distance = np.full(left.shape, np.iinfo(np.int64).max)
        distance[at, c] = squared(rows[at], self.centroids[c])
        cluster = distance.argmin(1)
        return cluster, distance[np.arange(len(rows)), cluster], left.sum(1)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            b = batch.slice(at, _ROWS)
            yield b.column("profile_id"), _matrix(b, "cells", width).astype(np.int64), _matrix(b, "known", pivots).astype(float)


def _sums(now: Round):
    """Rows (cluster, place, total): the sums of each cluster's cells in what this task read; place -1 counts its profiles."""
    width = now.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(now.centroids), width + 1), np.int64)
        for _, rows, known in _blocks(batches, width, len(now.gaps)):
            cluster, _, _ = now.nearest(rows, known)
            np.add.at(totals, cluster, np.concatenate([rows, np.ones((len(rows), 1), np.int64)], 1))
        some = np.flatnonzero(totals[:, width])
        place = np.tile(np.append(np.arange(width), -1), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width + 1), pa.int32()), pa.array(place, pa.int32()), pa.array(totals[some].reshape(-1))],
                                         ["cluster", "place", "total"])

    return run


def _assigned(now: Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, known in _blocks(batches, now.centroids.shape[1], len(now.gaps)):
            cluster, distance, compared = now.nearest(rows, known)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(compared, pa.int32())],
                                             ["profile_id", "cluster", "distance", "compared"])

    return run


def book_profiles(matrix: DataFrame, metrics: list[str]) -> DataFrame:
    """The rows of a book mart (snapshot_id, property_id and `metrics`, such as the profitability matrix) as profiles: the id holds both
    keys, the figures stand in the order of `metrics`. A row with a null metric is no whole profile and is left out by the clustering."""
    key = F.shiftleft(F.col("snapshot_id").cast("bigint"), 32) + F.col("property_id").cast("bigint")
    return matrix.select(key.alias("profile_id"), F.array(*[F.col(m).cast("double") for m in metrics]).alias("figures"))


def cluster_profiles(profiles: DataFrame, width: int, clusters: int = 40, rounds: int = 5, seed: str = "2:", pivots: int = PIVOTS) -> DataFrame:
    """Group profiles (profile_id, figures: an array of numbers; other columns are ignored) around `clusters` centroids.

    Only profiles of exactly `width` figures, none null or non-finite, are grouped; the others give no row. A figure x counts as floor(256 x).
    The centroids begin as the profiles whose `sha2(seed || profile_id)` is smallest (a null id last, equal ones by their figures; fewer
    profiles, fewer centroids). In each round every profile goes to the nearest centroid, of equally near ones to the one with the smallest
    number, and then each centroid that has profiles becomes the floor of their mean; the others stay. After the rounds they are
    dealt once more.

    Gives one row per grouped profile: profile_id, cluster, distance (squared), compared (centroids looked at exactly), cluster_inertia and
    inertia (distances summed over the cluster, over all) and centroid_sha256 (of its components, comma-joined). Repeated rows count each;
    no profiles, no rows. A figure beyond 2^19 either way is an error: its square would not fit.

    Driver and tasks hold the centroids and at most `pivots` of the first ones as pivots; of the profiles only sums by cluster are ever gathered."""
    spark = profiles.sparkSession
    work = Work(spark)
    with work:
        whole = profiles.select("profile_id", F.col("figures").cast("array<double>").alias("figures")).filter(
            (F.size("figures") == width) & F.forall("figures", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
        fits = F.forall("figures", lambda x: F.abs(x) * SCALE <= LARGEST)
        cells = F.transform("figures", lambda x: F.floor(x * SCALE).cast("int"))
        cells = F.when(fits, cells).otherwise(F.raise_error("a figure too large to be squared").cast("array<int>"))
        plain = work.stored("cells", whole.select("profile_id", cells.alias("cells")))
        begin = plain.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(seed), F.col("profile_id").cast("string")), 256)), "cells").limit(clusters).collect()
        if not begin:
            kind = profiles.schema["profile_id"].dataType.simpleString()
            return spark.createDataFrame([], f"profile_id {kind}, cluster int, distance bigint, compared int, cluster_inertia bigint, inertia bigint, "
                                             "centroid_sha256 string")
        centroids = np.array([r.cells for r in begin], np.int64)
        fixed = pivots_of(centroids, pivots)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    b = batch.slice(at, _ROWS)
                    known = distances(_matrix(b, "cells", width).astype(np.int64), fixed).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(known), pa.list_(pa.float32()))], ["profile_id", "cells", "known"])

        id_kind = profiles.schema["profile_id"].dataType.simpleString()
        measured = work.stored("measured", plain.mapInArrow(measure, f"profile_id {id_kind}, cells array<int>, known array<float>"))
        for _ in range(rounds):
            rows = measured.mapInArrow(_sums(Round.of(centroids, fixed)), "cluster int, place int, total bigint").groupBy("cluster", "place").agg(
                F.sum("total").alias("total")).collect()
            sizes = {r.cluster: r.total for r in rows if r.place < 0}
            for r in rows:
                if r.place >= 0:
                    centroids[r.cluster, r.place] = r.total // sizes[r.cluster]
        last = measured.mapInArrow(_assigned(Round.of(centroids, fixed)), f"profile_id {id_kind}, cluster int, distance bigint, compared int")
        dealt = work.kept("dealt", last)
        sums = {r.cluster: r.total for r in dealt.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = literal_rows(spark, [(c, total, sum(sums.values()), digest(c)) for c, total in sorted(sums.items())],
                         "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return dealt.join(F.broadcast(about), "cluster").select(
        "profile_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256")
