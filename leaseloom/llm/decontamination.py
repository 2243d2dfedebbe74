"""Benchmark decontamination: held-out texts are looked up in an FM-index of each shard of insight details."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leaseloom.llm import text_arrays as A
from leaseloom.llm.fm_index import FMIndex
from leaseloom.llm.staging import Work, set_aside

#: Words of a window, and held-out bytes looked up at once: more are taken in blocks of about that size, one pass after the other.
WINDOW_WORDS = 10
BLOCK_BYTES = 8 << 20
#: What a pass adds to the rows.
_FOUND = "_held_words bigint, _held_spans array<struct<first:bigint,last:bigint>>, _held_items array<string>"
_NAMES = ["_held_words", "_held_spans", "_held_items"]


class Windows:
    """The distinct windows of a block of held-out texts as rows of word numbers, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int = WINDOW_WORDS):
        data, offsets = A.utf8(pa.array([text for _, text in items], pa.large_string()))
        w = A.words(data, offsets, A.WORD)
        self.length = length
        self.vocabulary, number = np.unique(w.hashes, return_inverse=True)
        rows, owners = [], []
        for k, (item_id, _) in enumerate(items):
            own = number[w.offsets[k]:w.offsets[k + 1]]
            if len(own) >= length:
                found = np.lib.stride_tricks.sliding_window_view(own, length)
            elif len(own):
                found = np.full((1, length), -1)
                found[0, :len(own)] = own
            else:
                continue
            rows.append(found)
            owners += [item_id] * len(found)
        every = np.concatenate(rows) if rows else np.zeros((0, length), np.int64)
        self.patterns, which = np.unique(every, axis=0, return_inverse=True)
        self.items: list[list[str]] = [[] for _ in self.patterns]
        for row, item_id in zip(which.reshape(-1), owners, strict=True):
            if item_id is not None and (not self.items[row] or self.items[row][-1] != item_id):
                self.items[row].append(item_id)
        self.lengths = (self.patterns >= 0).sum(1)

    def hits(self, w: A.Words) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in a shard's texts: the window's number and the index of the first word."""
        none = np.zeros(0, np.int64)
        if not len(self.patterns) or not len(w.hashes):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == w.hashes
        starts, ends = A.runs(known, w.offsets)
        long = ends - starts >= self.lengths.min()  # no window fits into a shorter run of known words
        starts, counts = starts[long], (ends - starts)[long]
        # the runs one after the other, each followed by a symbol that no window has
        source = A.ranges(starts, counts + 1)
        symbols = np.where(A.ranges(np.zeros(len(starts), np.int64), counts + 1) == np.repeat(counts, counts + 1),
                           len(self.vocabulary), at[np.minimum(source, len(at) - 1)])
        if not len(symbols):
            return none, none
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        which, place = index.locate(*index.search(self.patterns))
        return which, source[place]


def _cut_out(detail: pa.Array, spans: list[list[dict]]) -> pa.Array:
    """The details without the words of their spans."""
    cut = [x for x, s in enumerate(spans) if s]
    if not cut:
        return detail
    details = detail.to_pylist()
    for x in cut:
        details[x] = _without(details[x], spans[x])
    return pa.array(details, pa.string())


def _scan(windows: Windows, first: bool, cut: bool = False):
    """What a block finds, added to the rows; or with `cut`, the rows without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail"):
            w = A.words(*A.utf8(b.column("detail")), A.WORD)
            which, place = windows.hits(w)
            change = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(change, place, 1)
            np.add.at(change, place + windows.lengths[which], -1)
            starts, ends = A.runs(np.cumsum(change[:-1]) > 0, w.offsets)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)] if first else b.column("_held_spans").to_pylist()
            items: list[list[str]] = [[] for _ in range(b.num_rows)] if first else b.column("_held_items").to_pylist()
            span_of, place_of = (np.searchsorted(w.offsets, x, "right") - 1 for x in (starts, place))
            for d, s, e in zip(span_of.tolist(), starts.tolist(), ends.tolist(), strict=True):
                spans[d].append({"first": s - int(w.offsets[d]), "last": e - int(w.offsets[d]) - 1})
            for d, k in set(zip(place_of.tolist(), which.tolist(), strict=True)):
                items[d] += windows.items[k]
            others = [c for c in b.schema.names if c not in _NAMES]
            if cut:
                detail = _cut_out(b.column("detail"), spans)
                yield pa.RecordBatch.from_arrays([detail if c == "detail" else b.column(c) for c in others], others)
                continue
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in others), pa.array(w.counts),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], [*others, *_NAMES])

    return run


def _blocks(held_out: DataFrame, window_words: int, block_bytes: int) -> Iterator[tuple[int, Windows]]:
    """How many blocks are still to come, and the windows of each block, collected one after the other."""
    held_out = held_out.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = held_out.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        block = held_out.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else held_out
        yield blocks - 1 - k, Windows(
            sorted(((r.item_id, r.text) for r in block.filter("text is not null").collect()), key=lambda r: (r[0] or "", r[1])), window_words)


def _found(insights: DataFrame, held_out: DataFrame, window_words: int, block_bytes: int, cut: bool = False) -> DataFrame:
    """The insights with _FOUND: one pass for each block of the held-out texts, one after the other over the same rows. With `cut` and only
    one block, the insights without what it finds, in the same pass."""
    work, frame = Work(insights.sparkSession), insights
    plain = frame.schema
    schema = StructType([*plain.fields, *StructType.fromDDL(_FOUND).fields])
    for k, (more, windows) in enumerate(_blocks(held_out, window_words, block_bytes)):
        if cut and not k and not more:
            return frame.mapInArrow(_scan(windows, True, cut=True), plain)
        frame = frame.mapInArrow(_scan(windows, k == 0), schema)
        if more:
            # stored before the next block is looked up, so that a task holds one block's windows whatever their number
            frame = work.kept(f"block_{k}", frame)
            work.delete(f"block_{k - 1}")
    return frame.withColumn("_held_spans", merged_spans(F.col("_held_spans"))) if k else frame


def find_held_out(insights: DataFrame, held_out: DataFrame, window_words: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find the windows of `held_out` (item_id, text) in the details of `insights` (insight_id, detail).

    Words are lower-cased runs of ASCII letters and digits and of everything beyond ASCII. A window is `window_words` consecutive
    words of an item, or all of them if it has fewer; an item without words has none. Gives one row per insight: insight_id, detail,
    n_words, spans (merged stretches of hit words, first and last counted from 0) and items (sorted distinct ids of items with an
    occurring window). A null detail or text has no words; the text of a null item_id
    counts too, its id does not; repeated rows are judged alike.

    The held-out texts are taken in blocks of about `block_bytes`, one pass each over the rows as the pass before stored them, so what a task
    or the driver holds of them does not grow."""
    return _found(insights.select("insight_id", "detail"), held_out, window_words, block_bytes).select(
        "insight_id", "detail", *(F.col(c).alias(name) for c, name in zip(_NAMES, ("n_words", "spans", "items"), strict=True)))


def merged_spans(spans):
    """Overlapping and touching spans as one."""
    return F.aggregate(
        F.array_sort(spans), F.slice(spans, 1, 0),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(s))))


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)


def _without(detail: str | None, spans: list) -> str | None:
    data, offsets = A.utf8(pa.array([detail], pa.large_string()))
    w = A.words(data, offsets, A.WORD)
    raw, at, kept = data.tobytes(), 0, []
    for s in spans:
        kept.append(raw[at:int(w.starts[s["first"]])])
        at = int(w.ends[s["last"]])
    return b"".join([*kept, raw[at:]]).decode()


def without_held_out(insights: DataFrame, held_out: DataFrame, window_words: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `insights` (insight_id, detail and any other columns) with the hit stretches cut out of the detail, from the first
    hit word's start to the last one's end. Rows without a hit stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            detail = _cut_out(b.column("detail"), b.column("_held_spans").to_pylist())
            others = [c for c in b.schema.names if c not in _NAMES]
            yield pa.RecordBatch.from_arrays([detail if c == "detail" else b.column(c) for c in others], others)

    plain, back = set_aside(insights, set(_NAMES))
    found = _found(plain, held_out, window_words, block_bytes, cut=True)
    whole = found.mapInArrow(run, plain.schema) if set(_NAMES) <= set(found.columns) else found
    return whole.withColumnsRenamed(back)
