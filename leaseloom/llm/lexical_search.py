"""Ranked lexical search: which insights' details say best what a headline says.

No index of the insights is kept. The terms of all headlines are one Aho-Corasick automaton, each term guarded by a blank on both sides, and
it runs over the texts themselves; a match tells the term, and the term tells the headlines that hold it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaseloom.llm import text_arrays as A
from leaseloom.llm.staging import Work

#: Terms are the maximal runs of letters and digits, and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms, and headlines, that are searched at once: they bound the automaton and the lists of the best.
BLOCK_BYTES, BLOCK_HEADLINES = 2 << 20, 8_192
#: Scores of a piece of the texts that a task holds at once.
_CELLS = 1 << 21
_PARTS = 64
_BLANKED = np.where(A.WORD, np.arange(256), 32).astype(np.uint8)[A._LOWER]
_is_start = (np.arange(256) & 0xC0) != 0x80
_LAST = np.iinfo(np.int64).max


def terms(text: str) -> F.Column:
    """The terms of a text column, A-Z lower-cased; none of a null."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


class Automaton:
    """All terms of a block, numbered as they stand, found in whole texts wherever blanks stand around them."""

    def __init__(self, words: list[str]):
        self.size, self.words = len(words), ahocorasick.Automaton()
        for number, word in enumerate(words):
            self.words.add_word(f" {word} ", number)
        self.words.make_automaton()

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each text has, repeats included; and for each text and block term in it: text, term, occurrences."""
        inside = A.WORD[A._LOWER[data]]
        starts, _ = A.runs(inside, offsets)
        sizes = np.diff(np.searchsorted(starts, offsets))
        # each text between blanks; anything but a term's bytes is a blank too
        n = len(offsets) - 1
        blanked = np.full(len(data) + n + 1, 32, np.uint8)
        blanked[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))] = _BLANKED[data]
        chars = np.cumsum(_is_start[blanked])[offsets + np.arange(n + 1)]  # characters up to the blank before each text
        none = np.zeros(0, np.int64)
        if not self.size:
            return sizes, none, none, none
        found = np.fromiter(chain.from_iterable(self.words.iter(blanked.tobytes().decode())), np.int64).reshape(-1, 2)
        # a match ends on the blank behind its term: that of a text's last word is the next text's first
        text = np.searchsorted(chars, found[:, 0], "left") - 1
        keys, times = np.unique(text * self.size + found[:, 1], return_counts=True)
        return sizes, keys // self.size, keys % self.size, times


class Headlines:
    """A block of headlines: their distinct terms, and for each term the headlines that hold it."""

    def __init__(self, pairs: list[tuple[int, str]]):
        self.numbers = sorted({number for number, _ in pairs})
        self.words = sorted({word for _, word in pairs})
        word_at, number_at = ({x: k for k, x in enumerate(xs)} for xs in (self.words, self.numbers))
        held = sorted({(word_at[word], number_at[number]) for number, word in pairs})
        self.starts = np.searchsorted(np.array([w for w, _ in held], np.int64), np.arange(len(self.words) + 1))
        self.holders = np.array([h for _, h in held], np.int64)


class Best:
    """The `top` highest scores of each headline so far, equal ones by ascending id; more are gathered before the rest goes."""

    def __init__(self, headlines: int, top: int):
        self.top, self.least = top, np.ones(headlines, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.enough = 0, 2 * headlines * top + (1 << 16)

    def add(self, headline: np.ndarray, insight: np.ndarray, score: np.ndarray) -> None:
        new = score >= self.least[headline]
        self.rows.append((headline[new], insight[new], score[new]))
        self.held += int(new.sum())
        if self.held > self.enough:
            self.rows = [self.kept()]
            self.held = len(self.rows[0][0])

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return (np.zeros(0, np.int64),) * 3
        headline, insight, score = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((insight, -score, headline))
        headline, insight, score = headline[order], insight[order], score[order]
        place = np.arange(len(headline)) - np.searchsorted(headline, headline)
        last = place == self.top - 1
        self.least[headline[last]] = score[last]
        keep = place < self.top
        return headline[keep], insight[keep], score[keep]


def _statistics(words: list[str]):
    """Rows (term, n): the texts that hold each term of the block; -1 counts the texts with a term at all, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, holding, texts, total = Automaton(words), np.zeros(len(words), np.int64), 0, 0
        for b in A.pieces(batches, "detail"):
            sizes, _, term, _ = automaton.counts(*A.utf8(b.column("detail")))
            holding += np.bincount(term, minlength=len(words))
            texts, total = texts + int((sizes > 0).sum()), total + int(sizes.sum())
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([texts, total, *holding[some].tolist()], pa.int64())],
                                         ["term", "n"])

    return run


def term_weights(texts: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 texts + 2) / (2 holding + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * h + 1))) for h in holding.tolist()], np.int64)


def _scores(block: Headlines, weight: np.ndarray, texts: int, total: int, top: int):
    """Rows (headline, insight_id, score): the best of what this task read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best, wide = Automaton(block.words), Best(len(block.numbers), top), len(block.numbers)
        fanout = np.diff(block.starts)
        for b in A.pieces(batches, "detail"):
            ids = b.column("insight_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            sizes, text, term, times = automaton.counts(*A.utf8(b.column("detail")))
            middling = 50 + np.array([50 * n * texts // total for n in sizes.tolist()], np.int64) if total else np.zeros(len(sizes), np.int64)
            share = weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * middling[text]))
            for first in range(0, b.num_rows, max(1, _CELLS // max(wide, 1))):
                upto = min(b.num_rows, first + max(1, _CELLS // max(wide, 1)))
                lo, hi = np.searchsorted(text, [first, upto])
                counts = fanout[term[lo:hi]]
                cell = np.repeat((text[lo:hi] - first) * wide, counts) + block.holders[A.ranges(block.starts[term[lo:hi]], counts)]
                score = np.zeros((upto - first) * wide, np.int64)
                np.add.at(score, cell, np.repeat(share[lo:hi], counts))
                some = np.flatnonzero(score > 0)
                best.add(some % wide, ids[first + some // wide], score[some])
        headline, insight, score = best.kept()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(block.numbers, np.int64)[headline]), pa.array(insight, mask=insight == _LAST), pa.array(score)],
            ["headline", "insight_id", "score"])

    return run


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("insight_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rank_details(insights: DataFrame, headlines: DataFrame, top: int = 50, block_bytes: int = BLOCK_BYTES,
                 block_headlines: int = BLOCK_HEADLINES) -> DataFrame:
    """For each headline, the `top` insights whose details score highest.

    `insights` has insight_id and detail, `headlines` has headline_id and headline; other columns of both are ignored. With N details that
    hold a term, L terms in all of them, n in one, df details with a term and tf occurrences of it in one, a detail scores the sum of
    floor(1000 ln((2N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 20 (50 + 50 n N div L))) over the headline's distinct terms, in whole numbers.

    Gives headline_id, rank (from 1), insight_id and score; scores of 0 are left out, equal scores go by ascending insight_id, a null id
    last. A null or empty detail or headline has no terms: it is no match, and a headline without terms gives no row. Rows of one
    headline_id are one headline with the terms of all, null ids among them; rows of one insight_id are insights of their own.

    The headlines are taken in blocks of about `block_bytes` of terms and `block_headlines`, two passes over the texts each; one headline
    is never split. A task holds one block's automaton and its best lists, whatever it reads."""
    spark = insights.sparkSession
    texts = insights.select("insight_id", "detail")
    work = Work(spark)
    with work:
        said = headlines.select("headline_id", F.explode(F.array_distinct(terms("headline"))).alias("term")).distinct()
        # hash of the id, so that a lost task numbers them as before; ids of one hash differ in the second part
        number = F.xxhash64("headline_id")
        said = work.stored("said", said.withColumn("block_key", number))
        told = said.agg(F.sum(F.octet_length("term")).alias("bytes"), F.count_distinct("block_key").alias("headlines")).first()
        blocks = max(1, math.ceil((told.bytes or 0) / block_bytes), math.ceil(told.headlines / block_headlines))
        found = []
        for k in range(blocks):
            pairs = said.filter(F.pmod("block_key", F.lit(blocks)) == k).select("headline_id", "term").collect()
            ids = sorted({r.headline_id for r in pairs}, key=lambda x: (x is None, x))
            at = {x: n for n, x in enumerate(ids)}
            block = Headlines([(at[r.headline_id], r.term) for r in pairs])
            if not block.words:
                continue
            rows = texts.select("detail").mapInArrow(_statistics(block.words), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
            counted = {r.term: r.n for r in rows}
            held = np.array([counted.get(t, 0) for t in range(len(block.words))], np.int64)
            n, total = counted.get(-1, 0), counted.get(-2, 0)
            scored = texts.mapInArrow(_scores(block, term_weights(n, held), n, total, top), "headline bigint, insight_id bigint, score bigint")
            # a headline's rows from all tasks meet in parts first, so that no task sees them all
            some = _best(scored.withColumn("part", F.pmod(F.xxhash64("insight_id"), F.lit(_PARTS))), ["headline", "part"], top).drop("part")
            names = spark.createDataFrame(list(enumerate(ids)), f"headline bigint, headline_id {headlines.schema['headline_id'].dataType.simpleString()}")
            found.append(work.kept(f"ranked_{k}", _best(some.drop("rank"), ["headline"], top).join(F.broadcast(names), "headline").select(
                "headline_id", F.col("rank").cast("int").alias("rank"), "insight_id", "score")))
    if not found:
        kind = headlines.schema["headline_id"].dataType.simpleString()
        return spark.createDataFrame([], f"headline_id {kind}, rank int, insight_id bigint, score bigint")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every
