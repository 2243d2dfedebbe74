"""Toxicity of insight details by weak supervision.

Word and stem lexicons are mined from reviewed insights, and together with surface patterns they are the voters. A generative label model
estimates, from the votes on all insights and without their labels, how often each voter fires on toxic and on clean texts and how far
voters repeat each other. Its posterior labels train a linear classifier over hashed words and stems, which gives the score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.llm import text_arrays as A
from leaseloom.llm.staging import Work

#: Reviewed insights the lexicons are mined from, and insights the classifier is trained on, at most: those whose ids hash smallest.
MINED_ROWS, TRAINED_ROWS = 20_000, 10_000
#: A lexicon entry stands in so many reviewed toxic texts, in such a share of them, and so much likelier (log odds) there than in clean ones;
#: so many entries at most.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, LEXICON_ENTRIES = 4, 0.005, 3.0, 20_000
#: Hashes whose smallest windows must all agree for two texts to count as copies.
SKETCH_MINIMA = 4
#: Characters of a stem, of words longer than that.
STEMS = (4, 5)
LEXICONS = 4
#: Hashed features of the classifier: 2 to that power.
FEATURE_BITS = 18
_PIECE = 1 << 20
_SALT = (0, 0x1F3D5B79, 0x2E4C6A88)
_STEP = 0x51ED270B3A5C6D17
_is_start = (np.arange(256) & 0xC0) != 0x80
_upper = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def held_out(insight_id: Column) -> Column:
    """A fifth of the insights, by their id, of which no label is learned."""
    return F.coalesce(F.crc32(insight_id.cast("string")) % 5 == 0, F.lit(False))


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, A.Words]:
    """All words and stems of the texts: hash, kind (0 a word, else the number of its stem length) and text."""
    w = A.words(data, offsets, A.WORD)
    lower = A._LOWER[data]
    firsts = np.flatnonzero(_is_start[lower]) if len(lower) else np.zeros(0, np.int64)
    number = np.cumsum(_is_start[lower]) - 1
    sums = A.prefix_hashes(lower)
    owner = w.owner
    hashes, kinds, owners = [w.hashes], [np.zeros(len(owner), np.int8)], [owner]
    bounds = np.append(firsts, len(lower))
    for k, length in enumerate(STEMS, 1):
        at = np.minimum(number[w.starts] + length, len(firsts)) if len(w.starts) else np.zeros(0, np.int64)
        ends = bounds[at]
        long = ends < w.ends
        hashes.append(A.mix(A.stretch_hashes(sums, w.starts[long], ends[long]) ^ np.uint64(_SALT[k])))
        kinds.append(np.full(int(long.sum()), k, np.int8))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate(owners), w


def _once(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each hash once for each text."""
    _, again = A.repeated(hashes ^ A.mix(owner.astype(np.uint64) + np.uint64(1)))
    return ~again


@dataclass(frozen=True)
class Voters:
    """The sorted hashes of the lexicons of words and stems; each is dealt over LEXICONS voters."""

    words: np.ndarray
    stems: np.ndarray

    @property
    def count(self) -> int:
        return 2 * LEXICONS + 5

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A bit for each voter that fires on each text."""
        hashes, kinds, owner, w = text_features(data, offsets)
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        for k, (lexicon, wanted) in enumerate(((self.words, kinds == 0), (self.stems, kinds > 0))):
            own, of = hashes[wanted], owner[wanted]
            known = np.isin(own, lexicon)
            own, of = own[known], of[known]
            new = _once(own, of)
            own, of = own[new], of[new]
            np.bitwise_or.at(out, of, np.int64(1) << (LEXICONS * k + (own % np.uint64(LEXICONS)).astype(np.int64)))
            out |= (np.bincount(of, minlength=n) > 1).astype(np.int64) << (2 * LEXICONS + k)
        words, chars = np.maximum(w.counts, 1), np.maximum(np.diff(offsets), 1)
        for k, fires in enumerate((A.by_text(data == 33, offsets) > 0.05 * words, A.by_text(_upper[data], offsets) > 0.3 * chars,
                                   A.by_text(data == 63, offsets) > 0.05 * words)):
            out |= fires.astype(np.int64) << (2 * LEXICONS + 2 + k)
        return out


@dataclass(frozen=True)
class LabelModel:
    """What each voter does on toxic (1) and clean (0) texts, the share of toxic texts, and how much each voter says of its own."""

    fires: np.ndarray
    share: float
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bits = (votes[:, None] >> np.arange(self.fires.shape[1])) & 1
        odds = np.log(self.fires[1] / self.fires[0]) * bits + np.log((1 - self.fires[1]) / (1 - self.fires[0])) * (1 - bits)
        return 1 / (1 + np.exp(-np.clip(np.log(self.share / (1 - self.share)) + odds @ self.weight, -30, 30)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, voters: int, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over the distinct vote patterns and how often each came. Midway the correlations of the voters, within
    toxic and within clean texts, are estimated, and a voter that repeats others weighs less from then on."""
    bits = ((patterns[:, None] >> np.arange(voters)) & 1).astype(float)
    lexical = np.arange(voters) < 2 * LEXICONS + 2
    model = LabelModel(np.stack([np.where(lexical, 0.02, 0.1), np.where(lexical, 0.5, 0.15)]), 0.1, np.ones(voters))
    total = counts.sum()
    for turn in range(rounds if total else 0):
        p = model.posterior(patterns)
        sizes = np.array([((1 - p) * counts).sum(), (p * counts).sum()])
        fires = np.stack([((1 - p) * counts) @ bits, (p * counts) @ bits])
        # a few texts in advance keep every chance inside (0, 1), and a lexicon voter never speaks for a clean text
        fires = (fires + np.array([[0.05], [1.0]])) / (sizes[:, None] + 2)
        fires[1, lexical] = np.maximum(fires[1, lexical], fires[0, lexical])
        weight = model.weight
        if turn == rounds // 2:
            alike = np.zeros((voters, voters))
            for y, mass in enumerate((1 - p, p)):
                centred = bits - fires[y]
                cover = (centred * (mass * counts)[:, None]).T @ centred / max(sizes[y], 1)
                spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
                alike = np.maximum(alike, np.where(spread[:, None] * spread > 1e-6, cover / (spread[:, None] * spread), 0))
            np.fill_diagonal(alike, 0)
            weight = 1 / (1 + np.clip(alike, 0, 1).sum(1))
        model = LabelModel(fires, float(np.clip(sizes[1] / total, 0.001, 0.5)), weight)
    return model


@dataclass(frozen=True)
class Classifier:
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, _, owner, _ = text_features(data, offsets)
        cell = (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        said = self.weight[cell] != 0
        cell, owner = cell[said], owner[said]
        new = _once(cell.astype(np.uint64), owner)
        total = self.bias + np.bincount(owner[new], self.weight[cell[new]], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_classifier(cells: list[np.ndarray], labels: np.ndarray, rounds: int = 150, least_texts: int = 3, penalty: float = 1e-4) -> Classifier:
    """Logistic regression on soft labels by accelerated descent, each text with its features at unit length scale; weights of rare features stay 0."""
    size = 1 << FEATURE_BITS
    weight, bias = np.zeros(size), 0.0
    if not len(labels):
        return Classifier(weight, bias)
    flat, owner = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    seen = np.bincount(flat, minlength=size)
    toxic = np.bincount(flat, labels[owner], size)
    share = labels.mean()
    # features that say something: much likelier, or much rarer, with the one label
    lift = (toxic + 0.5 * share) / (seen + 0.5) / max(share, 1e-6)
    useful = (seen >= least_texts) & ((lift > 2) | (lift < 0.5) & (seen * share > 5))
    said = useful[flat]
    flat, owner = flat[said], owner[said]
    balance = np.where(labels > 0.5, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    look, look_bias, before, before_bias = weight, bias, weight, bias
    step = 8.0 / max(1.0, np.sqrt(len(flat) / len(labels)))
    for turn in range(rounds):
        margin = look_bias + np.bincount(owner, look[flat], len(labels))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * balance / len(labels)
        weight = look - step * (np.bincount(flat, error[owner], size) + penalty * look)
        bias = look_bias - 0.2 * step * error.sum()
        pull = turn / (turn + 3)
        look, look_bias = weight + pull * (weight - before), bias + pull * (bias - before_bias)
        before, before_bias = weight, bias
    weight = np.where(np.abs(weight) < 1e-3, 0, weight)
    return Classifier(weight, float(bias))


def text_sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each text that copies share: its smallest five-word windows by several hashes together, or the text if it has none.
    Texts whose windows are alike to a share s have the same one with a chance of s to the power of SKETCH_MINIMA."""
    w = A.words(data, offsets, A.WORD)
    first, hashes = A.window_hashes(w, 5)
    owner = w.owner[first]
    out = np.zeros(len(offsets) - 1, np.uint64)
    for k in range(SKETCH_MINIMA):
        least = np.full(len(out), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, owner, A.mix(hashes + np.uint64(k * _STEP % (1 << 64))))
        out = A.mix(out ^ least)
    short = np.bincount(owner, minlength=len(out)) == 0
    out[short] = A.stretch_hashes(A.prefix_hashes(data), offsets[:-1], offsets[1:])[short]
    return out.view(np.int64)


def _chosen(found: DataFrame, keys: list[str], kept: list[str], rows: int) -> DataFrame:
    """At most `rows` insights of `found`, those whose ids hash smallest; of insights that agree in `keys` only the first of them counts.
    The choice hangs on ids and texts alone, so it comes out the same however tasks run, and a group of any size is reduced where it lies."""
    first = F.min(F.struct(F.xxhash64("insight_id").alias("_turn"), "insight_id", *kept)).alias("first")
    return found.groupBy(*keys).agg(first).select("first.*").distinct().orderBy("_turn", "insight_id").limit(rows).drop("_turn")


def _details(insights: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen insights with their detail; of several rows with one id the smallest detail. `chosen` has a bounded number of rows, a
    parameter of its caller, so it goes to every task and no detail of another insight moves."""
    kept = [c for c in chosen.columns if c != "insight_id"]
    return insights.select("insight_id", "detail").join(F.broadcast(chosen), "insight_id").groupBy("insight_id", *kept).agg(F.min("detail").alias("detail"))


def _to_learn(insights: DataFrame) -> DataFrame:
    return insights.select("insight_id", "detail").filter("insight_id is not null").filter(~held_out(F.col("insight_id")))


def mine_voters(insights: DataFrame, reviews: DataFrame, rows: int = MINED_ROWS) -> Voters:
    """Lexicons from at most `rows` reviewed insights (reviews: insight_id, toxic 0 or 1) that are not held out. Copies of one label count
    once, before that bound is applied; an insight with several reviews is toxic if one of them says so."""
    labels = reviews.filter("insight_id is not null and toxic is not null").groupBy("insight_id").agg(F.max("toxic").cast("int").alias("_toxic"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), pa.array(text_sketches(*A.utf8(b.column("detail"))))], ["insight_id", "sketch"])

    sketched = _to_learn(insights).mapInArrow(sketches, "insight_id bigint, sketch bigint")
    chosen = _chosen(sketched.join(labels, "insight_id"), ["sketch", "_toxic"], ["_toxic"], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            hashes, kinds, owner, _ = text_features(*A.utf8(b.column("detail")))
            new = _once(hashes, owner)
            hashes, stem, toxic = hashes[new], kinds[new] > 0, b.column("_toxic").to_numpy()[owner[new]] == 1
            for is_stem in (False, True):
                known, number = np.unique(hashes[stem == is_stem], return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(known.view(np.int64)), pa.array(np.full(len(known), is_stem)),
                    pa.array(np.bincount(number, toxic[stem == is_stem], len(known)).astype(np.int64)),
                    pa.array(np.bincount(number, minlength=len(known)))], ["feature", "stem", "toxic", "texts"])

    with Work(insights.sparkSession) as work:
        # stored: the totals are of the very texts that are counted, without copies and without reviews that have no insight
        read = work.stored("read", _details(insights, chosen))
        counts = read.mapInArrow(run, "feature bigint, stem boolean, toxic bigint, texts bigint").groupBy("feature", "stem").agg(
            F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
        totals = read.agg(F.sum("_toxic").alias("toxic"), F.count("*").alias("texts")).first()
        toxic, clean = totals.toxic or 0, totals.texts - (totals.toxic or 0)
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("texts") - F.col("toxic") + 0.5) / (clean + 1))
        found = counts.filter(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).filter(odds >= LEAST_ODDS).orderBy(
            odds.desc(), "feature").limit(LEXICON_ENTRIES).collect()
    lexicon = lambda stem: np.sort(np.array([r.feature for r in found if r.stem == stem], np.int64).view(np.uint64))
    return Voters(lexicon(False), lexicon(True))


def cast_votes(insights: DataFrame, voters: Voters) -> DataFrame:
    """The votes on every insight, and its sketch: insight_id, votes, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            data, offsets = A.utf8(b.column("detail"))
            yield pa.RecordBatch.from_arrays(
                [b.column("insight_id"), pa.array(voters.votes(data, offsets)), pa.array(text_sketches(data, offsets))], ["insight_id", "votes", "sketch"])

    return insights.select("insight_id", "detail").mapInArrow(run, "insight_id bigint, votes bigint, sketch bigint")


def label_votes(votes: DataFrame, voters: Voters) -> LabelModel:
    """The label model over the votes on all insights; only the distinct patterns of votes, 2 to the number of voters at most, come to the
    driver."""
    rows = votes.groupBy("votes").agg(F.count("*").alias("n")).collect()
    rows.sort()
    return fit_label_model(np.array([r.votes for r in rows], np.int64), np.array([r.n for r in rows], float), voters.count)


def train_classifier(insights: DataFrame, votes: DataFrame, voters: Voters, model: LabelModel, rows: int = TRAINED_ROWS) -> Classifier:
    """A classifier trained on the posterior labels of at most `rows` insights that are not held out. Copies with the same votes count once,
    before that bound is applied."""
    chosen = _chosen(votes.filter("insight_id is not null").filter(~held_out(F.col("insight_id"))), ["sketch", "votes"], [], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            data, offsets = A.utf8(b.column("detail"))
            hashes, _, owner, _ = text_features(data, offsets)
            cell = (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.uint64)
            new = _once(cell, owner)
            cell, owner = cell[new].astype("<u4"), owner[new]
            order = np.argsort(owner * len(owner) + np.arange(len(owner)))
            ends = np.searchsorted(owner[order], np.arange(b.num_rows + 1))
            raw = [cell[order[s:e]].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            label = pa.array(model.posterior(voters.votes(data, offsets)))
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), label, pa.array(raw, pa.binary())], ["insight_id", "label", "cells"])

    found = _details(insights, chosen).mapInArrow(run, "insight_id bigint, label double, cells binary").collect()
    found.sort(key=lambda r: r.insight_id)
    return fit_classifier([np.frombuffer(r.cells, "<u4").astype(np.int64) for r in found], np.array([r.label for r in found]))


def fit_toxicity(insights: DataFrame, reviews: DataFrame, mined_rows: int = MINED_ROWS, trained_rows: int = TRAINED_ROWS) -> Classifier:
    """A classifier of toxic details, from `insights` (insight_id, detail) and `reviews` (insight_id, toxic 0 or 1; null: no review).

    The lexicons, of at most LEXICON_ENTRIES entries, come from at most `mined_rows` reviewed insights; the label model is fitted on the
    votes on all insights; the classifier on the posterior labels of at most `trained_rows` of them. Insights that are held out, or have no
    id, are neither mined nor trained on. A null or empty detail says nothing. Copies of a text count once where their label, or their
    votes, are the same; of rows with one id the smallest detail speaks. Without insights or reviews every score is that of a text that
    says nothing. Other columns are never read. The same tables give the same classifier, in whatever order their rows come."""
    written = insights.select("insight_id", "detail")
    with Work(insights.sparkSession) as work:
        voters = mine_voters(written, reviews, mined_rows)
        votes = work.stored("votes", cast_votes(written, voters))
        return train_classifier(written, votes, voters, label_votes(votes, voters), trained_rows)


def score_toxicity(insights: DataFrame, classifier: Classifier) -> DataFrame:
    """Score the whole detail of every insight (insight_id, detail; other columns, such as its book or source, are never read).

    One row per input row: insight_id, held_out, score (0 to 1, higher: toxic is likelier) and predicted (1 from 0.5 on). A null or empty
    detail has no features and gets the score of a text that says nothing; repeated rows score alike; a null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", _PIECE):
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), pa.array(classifier.score(*A.utf8(b.column("detail"))))], ["insight_id", "score"])

    return insights.select("insight_id", "detail").mapInArrow(run, "insight_id bigint, score double").select(
        "insight_id", held_out(F.col("insight_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
