"""A quality classifier for insight details: naive Bayes support vectors.

The n-grams of a detail (single words and word pairs as they are written, and runs of one to three word shapes) are indicators, each
scaled by how much likelier it is in well reviewed details than in badly reviewed ones: the log of the ratio of its shares of the counts
of both classes. A linear model with hinge loss is fitted on them by dual coordinate descent, and a sigmoid over margins of reviewed
insights that the fit has not seen turns its margin into a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.llm import text_arrays as A

#: Reviewed insights that the model is fitted on, at most; those with the smallest hash of their id. One in five of them sets the sigmoid.
SAMPLE_ROWS = 6_000
CALIBRATION_SHARE = 5
#: Hashed n-grams: 2 to that power.
CELL_BITS = 18
#: Added to every count, and the bound on a text's weight in the fit (C of the hinge loss).
SMOOTHING, COST = 1.0, 1.0
#: An n-gram in fewer reviewed details says nothing.
LEAST_TEXTS = 3
_PIECE = 256 << 10
_SALTS = (0x3C6EF372, 0x5BE0CD19, 0x6A09E667, 0x1F83D9AB, 0x510E527F, 0x428A2F98)

_BYTE = np.arange(256)
_upper = (_BYTE >= 65) & (_BYTE <= 90)
_lower = (_BYTE >= 97) & (_BYTE <= 122)
_digit = (_BYTE >= 48) & (_BYTE <= 57)
#: What a word's last byte is: a letter (anything beyond ASCII too), a digit, a mark that ends or parts clauses, another sign.
_last = np.select([_upper | _lower | (_BYTE >= 128), _digit, np.isin(_BYTE, list(b".,;:")), np.isin(_BYTE, list(b"!?"))], [0, 1, 2, 3], 4)


def held_out(insight_id: Column) -> Column:
    """A fifth of the insights, by their id, of which no label is learned."""
    return F.coalesce(F.crc32(insight_id.cast("string")) % 5 == 0, F.lit(False))


def _shapes(data: np.ndarray, w: A.Words) -> np.ndarray:
    """A small number for what each word looks like: case, length, last sign, and whether it or its window of three came before."""
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags[data])])
    up, low, number = sums(_upper), sums(_lower), sums(_digit)
    ups, lows, digits = (s[w.ends] - s[w.starts] for s in (up, low, number))
    size = w.ends - w.starts
    case = np.select([(ups >= 2) & (lows == 0), (ups > 0) & _upper[data[w.starts]], ups > 0, lows > 0, digits > 0], [0, 1, 2, 3, 4], 5)
    length = np.searchsorted([2, 5, 11, 21], size, "right")
    same = np.zeros(len(size), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.offsets[:-1][w.counts > 0]] = 0
    first, hashes = A.window_hashes(w, 3)
    many, _ = A.repeated(hashes ^ A.mix(w.owner[first].astype(np.uint64) + np.uint64(1)))
    again = A.covered(first[many], 3, len(size)).astype(np.int64)
    return (((case * 5 + length) * 5 + _last[data[w.ends - 1]]) * 2 + same) * 2 + again


def ngram_cells(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts, each once a text: cell and text, ordered by text. Cells that are not `known` are left out, if given."""
    w = A.words(data, offsets, A.NOT_SPACE, lower=False)
    shapes = A.mix(_shapes(data, w).astype(np.uint64) + np.uint64(1)) if len(w.starts) else np.zeros(0, np.uint64)
    owner, cells, owners = w.owner, [], []
    for salt, k, symbols in zip(_SALTS, (1, 2, 1, 2, 3), (w.hashes, w.hashes, shapes, shapes, shapes), strict=False):
        first, hashes = A.window_hashes(A.Words(w.starts, w.ends, symbols, w.offsets), k)
        cells.append(A.mix(hashes ^ np.uint64(salt)))
        owners.append(owner[first])
    # how long the text is, by powers of two
    sizes = np.floor(np.log2(w.counts + 1)).astype(np.uint64)
    cells.append(A.mix(sizes ^ np.uint64(_SALTS[5])))
    owners.append(np.arange(len(offsets) - 1))
    cell, owner = (np.concatenate(cells) >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.concatenate(owners).astype(np.int64)
    if known is not None:
        cell, owner = cell[known[cell]], owner[known[cell]]
    keys = np.unique(owner << CELL_BITS | cell)
    return keys & ((1 << CELL_BITS) - 1), keys >> CELL_BITS


@dataclass(frozen=True)
class QualityModel:
    """A weight for each cell (its log-count ratio times the fitted one), how much of a text's length each cell is worth, and the sigmoid."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    level: float

    def margin(self, cells: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Of texts scaled to length one."""
        size = np.sqrt(np.maximum(np.bincount(owner, self.square[cells], texts), 1e-12))
        return np.bincount(owner, self.weight[cells], texts) / size + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.margin(*ngram_cells(data, offsets, self.square > 0), len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -30, 30)))


def log_count_ratios(texts: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of (share of the n-gram in the counts of good texts / its share in those of bad ones); 0 for those of too few texts. A text's
    cells are distinct."""
    size = 1 << CELL_BITS
    up, down = np.zeros(size), np.zeros(size)
    for cells, is_good in zip(texts, good, strict=True):
        (up if is_good else down)[cells] += 1
    known = up + down >= LEAST_TEXTS
    up, down = (np.where(known, n + SMOOTHING, 0) for n in (up, down))
    return np.where(known, np.log(np.maximum(up / max(up.sum(), 1e-12), 1e-12) / np.maximum(down / max(down.sum(), 1e-12), 1e-12)), 0)


def hinge_by_dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, size: int,
                          turns: int = 40, enough: float = 0.05) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i max(0, 1 - sign_i (w x_i + b)) over its dual, a coordinate at a time in a fixed random order; the bias is
    the weight of one more feature of value 1. `rows` are (features, values) of each x_i. Ends when no coordinate's projected gradient
    differs from another's by `enough`."""
    weight, bias = np.zeros(size), 0.0
    dual, square = np.zeros(len(rows)), np.array([1 + v @ v for _, v in rows])
    random = np.random.default_rng(11)
    for _ in range(turns):
        least, most = np.inf, -np.inf
        for i in random.permutation(len(rows)):
            at, value = rows[i]
            slope = sign[i] * (weight[at] @ value + bias) - 1
            pull = min(slope, 0.0) if dual[i] <= 0 else max(slope, 0.0) if dual[i] >= cost[i] else slope
            least, most = min(least, pull), max(most, pull)
            if abs(pull) > 1e-9:
                now = min(max(dual[i] - slope / square[i], 0.0), cost[i])
                change = (now - dual[i]) * sign[i]
                weight[at] += change * value
                bias += change
                dual[i] = now
        if most - least < enough:
            break
    return weight, bias


def fit_sigmoid(margin: np.ndarray, good: np.ndarray, turns: int = 60) -> tuple[float, float]:
    """Slope and level of the sigmoid that makes the labels likeliest, by Newton steps; targets keep off 0 and 1 and the slope off 0."""
    up, down = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (up + 1) / (up + 2), 1 / (down + 2))
    slope, level = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(turns if len(good) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + level, -30, 30)))
        error, spread = p - target, p * (1 - p)
        a, b, c = (spread * margin * margin).sum() + 1e-3, (spread * margin).sum(), spread.sum() + 1e-3
        ds, dl = (error * margin).sum() + 1e-3 * (slope - 1), error.sum()
        det = max(a * c - b * b, 1e-9)
        slope, level = slope - np.clip((c * ds - b * dl) / det, -1, 1), level - np.clip((a * dl - b * ds) / det, -1, 1)
    return float(max(slope, 0.05)), float(level)


def fit_model(texts: list[np.ndarray], good: np.ndarray, calibrates: np.ndarray) -> QualityModel:
    """The model of texts (their cells), labels 1 or 0, and which of them only set the sigmoid. With labels of one kind alone, or none,
    every text gets their share (or one half)."""
    size = 1 << CELL_BITS
    learned = np.flatnonzero(~calibrates)
    if not len(learned) or good[learned].min() == good[learned].max():
        share = np.clip(good.mean(), 0.02, 0.98) if len(good) else 0.5
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratios([texts[i] for i in learned], good[learned])
    rows = []
    for i in learned:
        at = texts[i][ratio[texts[i]] != 0]
        value = ratio[at].astype(np.float32)
        rows.append((at, value / max(np.sqrt(value @ value), 1e-6)))
    up = good[learned].mean()
    # both classes weigh alike
    cost = np.where(good[learned] > 0, 0.5 / up, 0.5 / (1 - up)) * COST
    weight, bias = hinge_by_dual_descent(rows, np.where(good[learned] > 0, 1.0, -1.0), cost, size)
    model = QualityModel((weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)
    seen = np.flatnonzero(calibrates)
    if not len(seen):
        return model
    margins = np.array([model.margin(texts[i], np.zeros(len(texts[i]), np.int64), 1)[0] for i in seen])
    slope, level = fit_sigmoid(margins, good[seen])
    return QualityModel(model.weight, model.square, bias, slope, level)


def fit_quality(insights: DataFrame, reviews: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """The model of at most `rows` reviewed insights (insights: insight_id, detail; reviews: insight_id, quality 0 or 1) that are not held
    out, those whose ids hash smallest. An id reviewed several times counts as bad if one review says so; of the rows of a repeated id
    the least detail is read; details with the same n-grams and label count once; null ids and null verdicts are left out."""
    chosen = (
        reviews.filter("insight_id is not null and quality is not null").filter(~held_out(F.col("insight_id"))).groupBy("insight_id")
        .agg(F.min("quality").cast("int").alias("_good")).orderBy(F.xxhash64("insight_id"), "insight_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            cells, owner = ngram_cells(*A.utf8(b.column("detail")))
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            cells = cells.astype("<u4")
            raw = [cells[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), b.column("_good"), pa.array(raw, pa.binary())], ["insight_id", "good", "cells"])

    one = insights.select("insight_id", "detail").join(chosen, "insight_id").groupBy("insight_id", "_good").agg(F.min("detail").alias("detail"))
    found = one.mapInArrow(run, "insight_id bigint, good int, cells binary").collect()
    unlike: dict[tuple[bytes, int], int] = {}
    for r in sorted(found, key=lambda r: r.insight_id):
        unlike.setdefault((bytes(r.cells), r.good), r.insight_id)
    ids = np.array(list(unlike.values()), np.int64)
    calibrates = A.mix(ids.view(np.uint64)) % np.uint64(CALIBRATION_SHARE) == 0 if len(ids) else np.zeros(0, bool)
    return fit_model([np.frombuffer(cells, "<u4") for cells, _ in unlike], np.array([float(good > 0) for _, good in unlike]), calibrates)


def score_quality(insights: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Score the whole detail of every insight (insight_id, detail; other columns, such as its book or source, are never read).

    One row per input row: insight_id, held_out, score (0 to 1, higher: a good review is likelier) and predicted (1 from `threshold` on).
    A null or empty detail has its length as only n-gram; repeated rows score alike; a null id stays null and is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), pa.array(model.score(*A.utf8(b.column("detail"))))], ["insight_id", "score"])

    return insights.select("insight_id", "detail").mapInArrow(run, "insight_id bigint, score double").select(
        "insight_id", held_out(F.col("insight_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
