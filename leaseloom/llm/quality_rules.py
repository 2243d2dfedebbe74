"""Quality rules for the written details of insights: fixed base rules and a boosted-tree verdict over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaseloom.llm import text_arrays as A
from leaseloom.llm.boosted_trees import Forest, train

SYMBOLS = b"#*$%&|<>"
#: Reviewed insights that the trees are fitted on, at most; those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_upper", "n_digits", "n_marks", "n_lines",
          "n_distinct_words", "n_long_words")
OUT = ("insight_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
       "base_failed boolean, score double, kept boolean")
#: Features of which more is never better: symbols, repeated lines, repeated windows.
FALLING = (1, 2, 3)

_symbol = np.isin(np.arange(256), list(SYMBOLS))
_upper = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_digit = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_mark = np.isin(np.arange(256), list(b"!?.,;:'\"()[]{}"))
_starts_char = (np.arange(256) & 0xC0) != 0x80


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, a row a text."""
    w = A.words(data, offsets, A.NOT_SPACE, lower=False)
    n = len(offsets) - 1
    inside = A.NOT_SPACE[data]
    count = lambda flags: A.by_text(flags, offsets)
    starts, ends = A.runs(data != 10, offsets)
    seen = np.concatenate([[0], np.cumsum(inside)])
    filled = seen[ends] > seen[starts]
    starts, ends = starts[filled], ends[filled]
    sums = A.prefix_hashes(data)
    line_of = np.searchsorted(offsets, starts, "right") - 1
    of = A.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    _, later = A.repeated(A.stretch_hashes(sums, starts, ends) ^ of[line_of])
    first, hashes = A.window_hashes(w, 5)
    owner = w.owner
    many, _ = A.repeated(hashes ^ of[owner[first]])
    repeat = A.covered(first[many], 5, len(w.starts))
    _, again = A.repeated(w.hashes ^ of[owner])
    per = lambda index, flags: np.bincount(index[flags], minlength=n)
    return np.stack([
        w.counts, count(inside & _starts_char[data]), count(_symbol[data]), per(line_of, later), per(owner, repeat),
        np.diff(offsets), count(_upper[data]), count(_digit[data]), count(_mark[data]), np.bincount(line_of, minlength=n),
        per(owner, ~again), per(owner, (w.ends - w.starts) > 20),
    ], 1).astype(np.int64)


def features(c: np.ndarray) -> np.ndarray:
    """Rates from COUNTS, so that a long text is judged as a short one is."""
    c = c.astype(float)
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    return np.stack([
        np.log1p(c[:, 0]), c[:, 2] / words, c[:, 3] / np.maximum(c[:, 9], 1), c[:, 4] / words, c[:, 1] / words,
        c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words, c[:, 10] / words, c[:, 11] / words, c[:, 9] / words,
    ], 1)


def base_failed(c: np.ndarray) -> np.ndarray:
    """Fewer than 10 words, or over a fifth of the words in 5-word windows that occur again."""
    return (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])


def _stats(insights: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail"):
            c = text_counts(*A.utf8(b.column("detail")))
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), *map(pa.array, c.T)], ["insight_id", *COUNTS])

    return insights.select("insight_id", "detail").mapInArrow(run, "insight_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def fit_verdict(insights: DataFrame, reviews: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees fitted on at most `sample_rows` reviewed insights (reviews: insight_id, quality 0 or 1; null verdicts are left out)."""
    chosen = (
        reviews.filter("insight_id is not null and quality is not null").groupBy("insight_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("insight_id"), "insight_id").limit(sample_rows)
    )
    rows = _stats(insights.join(chosen.select("insight_id"), "insight_id", "left_semi")).join(chosen, "insight_id").toPandas()
    rows = rows.sort_values(["insight_id", *COUNTS])
    return train(features(rows[list(COUNTS)].to_numpy()), rows["_quality"].to_numpy(float), FALLING)


def quality_rules(insights: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Judge the whole detail of every insight (insight_id, detail; other columns are ignored).

    One row per input row: insight_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (the trees'
    probability of a good text) and kept, which is false when a base rule fails or the score is below `threshold`.
    A null or empty detail has no words and fails the base rules; repeated rows are judged alike; a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail"):
            c = text_counts(*A.utf8(b.column("detail")))
            failed, score = base_failed(c), forest.score(features(c))
            yield pa.RecordBatch.from_arrays(
                [b.column("insight_id"), *map(pa.array, c.T[:5]), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                [x.split()[0] for x in OUT.split(", ")])

    return insights.select("insight_id", "detail").mapInArrow(run, OUT)


def good_insights(insights: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """The rows of `insights` (insight_id, detail and any other columns) that `quality_rules` keeps, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail"):
            c = text_counts(*A.utf8(b.column("detail")))
            yield b.filter(pa.array(~base_failed(c) & (forest.score(features(c)) >= threshold)))

    return insights.mapInArrow(run, insights.schema)
