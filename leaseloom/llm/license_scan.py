"""License scan of insight details by diagonal voting.

Every window of two words of a detail is joined to the places where the templates have it. A place in the detail less the place in the
template is a diagonal; a template's words in order pile up on one, or, where words were put in or left out, on its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leaseloom.llm import text_arrays as A

GRAM_WORDS = 2
#: Windows of a template: a bit each in 64.
MOST_GRAMS = 63
#: Diagonals that far apart still belong to one passage, and the share of a template's windows that a passage must have.
SLACK_WORDS = 2
LEAST_SHARE = 0.9

# ---- fixed values: phrases that count wherever they stand, and their labels ----
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# ---- fixed values: wordings of license notices, and their labels ----
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
    ("all rights reserved", "proprietary"),
)
# ---- fixed values: what names a label's license in its notices; these words must stand there unbroken ----
NAMES = {
    "mit": ("mit license", "hereby granted"),
    "apache-2.0": ("apache license", "2 0"),
    "gpl": ("gnu general public license",),
    "gpl-3.0": ("gnu general public license", "version 3"),
    "gpl-2.0": ("gnu general public license", "version 2"),
    "lgpl": ("gnu lesser general public license",),
    "bsd": ("are permitted",),
    "cc-by-nc-4.0": ("cc by nc 4 0",),
    "cc-by-sa-4.0": ("cc by sa 4 0",),
    "cc-by-4.0": ("cc by 4 0",),
    "mpl": ("mozilla public license",),
    "proprietary": ("all rights reserved",),
}

# ---- fixed values: words that turn a notice into its denial, where it does not have them itself ----
DENIALS = ("not", "never", "cannot", "no")
#: Words before a passage in which a denial counts too.
BEFORE_WORDS = 2

SCAN = "insight_id bigint, digest bigint, n_words bigint, place bigint, gram bigint, denied_before bigint, denied_upto bigint, denied_after bigint"

_denials = A.words(*A.utf8(pa.array([" ".join(DENIALS)])), A.WORD).hashes


def _denied(w: A.Words) -> np.ndarray:
    """How many words before each word, all texts together, deny something."""
    return np.concatenate([[0], np.cumsum(np.isin(w.hashes, _denials))])


def _grams(w: A.Words) -> tuple[np.ndarray, np.ndarray]:
    first, hashes = A.window_hashes(w, GRAM_WORDS)
    return first, hashes.view(np.int64)


def _named(text: str, label: str) -> int:
    """A bit for each window of the notice that lies in a phrase naming its license."""
    words, bits = text.split(), 0
    for name in (n.split() for n in NAMES.get(label, ())):
        for at in range(len(words) - len(name) + 1):
            if words[at:at + len(name)] == name:
                bits |= ((1 << (len(name) - GRAM_WORDS + 1)) - 1) << at
    return bits


def templates(spark: SparkSession, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Each window of each template: template, label, base, template_grams, full and named (bits of all its windows, and of those it cannot
    do without), at (its place in the template), gram, own_before, own_upto and own_after (its denials before the window, up to
    its end, and up to the word behind it)."""
    rows = []
    for number, (text, label) in enumerate((*base, *notices)):
        w = A.words(*A.utf8(pa.array([text])), A.WORD)
        _, grams = _grams(w)
        if len(grams) > MOST_GRAMS:
            raise ValueError(f"a template of {len(grams)} windows, {MOST_GRAMS} fit: {text[:60]} ...")
        bits, denied = ((1 << len(grams)) - 1, _named(text, label)), _denied(w)
        rows += [(number, label, number < len(base), len(grams), *bits, at, int(g), int(denied[at]), int(denied[at + GRAM_WORDS]),
                  int(denied[min(at + GRAM_WORDS + 1, len(grams) + 1)])) for at, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, template_grams int, full bigint, named bigint, at bigint, gram bigint, "
                                       "own_before bigint, own_upto bigint, own_after bigint")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each detail (place and gram null), and one for each window of it."""
    for b in A.pieces(batches, "detail"):
        data, offsets = A.utf8(b.column("detail"))
        w = A.words(data, offsets, A.WORD)
        n = b.num_rows
        digest = A.stretch_hashes(A.prefix_hashes(data), offsets[:-1], offsets[1:]).view(np.int64)
        first, grams = _grams(w)
        owner = w.owner[first]
        ids, names = b.column("insight_id"), [x.split()[0] for x in SCAN.split(", ")]
        yield pa.RecordBatch.from_arrays([ids, pa.array(digest), pa.array(w.counts), *[pa.nulls(n, pa.int64())] * 5], names)
        if len(first):
            begins, ends, denied = w.offsets[owner], w.offsets[owner + 1], _denied(w)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), pa.array(digest[owner]), pa.array(w.counts[owner]), pa.array(first - begins), pa.array(grams),
                 pa.array(denied[np.maximum(first - BEFORE_WORDS, begins)] - denied[begins]), pa.array(denied[first + GRAM_WORDS] - denied[begins]),
                 pa.array(denied[np.minimum(first + GRAM_WORDS + 1, ends)] - denied[begins])], names)


def _span_of_denials() -> list[Column]:
    """Denials up to the first and the last window of what is grouped, in the detail and in the template."""
    return [F.min(c).alias(c) if c.endswith("before") else F.max(c).alias(c) for c in (
        "denied_before", "denied_upto", "denied_after", "own_before", "own_upto", "own_after")]


def scan_licenses(insights: DataFrame, slack_words: int = SLACK_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Find license phrases and notices in the whole details of `insights` (insight_id, detail).

    One row per input row: insight_id, n_words, n_base (places of the base phrases), first_word and last_word (the smallest and largest
    place where one begins, words counted from 0; null if none), base_labels, labels (those and the notices', distinct, sorted,
    comma-joined) and score (the largest share of a template's windows found together, 0 if none). A notice counts from `least_share` of its
    windows on, on diagonals up to `slack_words` apart, and also when one window or two neighbouring ones are missing (one place with words
    put in, or one word changed or left out); never when a window of the words that name its license (NAMES) is missing, or when a word of
    DENIALS stands in it, right before it, or where it breaks off, that the notice does not have. A null detail is empty. Rows with one id and one detail are judged once and
    given as often as they came; a null id is a value like any other here. Other columns are ignored.

    The templates are a fixed list of some hundred windows, no more than 63 each, so they are broadcast."""
    scanned = insights.select("insight_id", "detail").mapInArrow(_scan, SCAN)
    key = ["insight_id", "digest", "n_words"]
    found = scanned.join(F.broadcast(templates(insights.sparkSession)), "gram", "left").filter("place is null or template is not null")
    diagonal = found.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*key, "template", "diagonal").agg(
        F.count("*").alias("rows"), F.bit_or(F.expr("shiftleft(1L, cast(at as int))")).alias("hits"), F.min("place").alias("low"), F.max("place").alias("high"),
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("template_grams").alias("grams"), F.first("full").alias("full"), F.first("named").alias("named"), *_span_of_denials())
    # neighbouring diagonals of a template, as long as they lie close in the detail too, are one passage
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > slack_words) | (
        F.col("low") - F.lag("high").over(order) > F.col("grams") + slack_words)
    whole = F.bit_count("hits") == F.col("grams")
    passage = diagonal.withColumn("passage", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order)).groupBy(*key, "template", "passage").agg(
        F.max("rows").alias("rows"), F.bit_or("hits").alias("hits"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.first("grams").alias("grams"), F.first("full").alias("full"), F.first("named").alias("named"), *_span_of_denials(), F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_place"), F.max(F.when(whole, F.col("diagonal"))).alias("last_place"))
    # the passage as it was found: which of the template's windows it has, each counted once
    share = F.bit_count("hits") / F.col("grams")
    missed = F.col("full").bitwiseXOR(F.col("hits"))
    one_edit = (F.bit_count(missed) == 1) | (F.bit_count(missed) == 2) & (missed.bitwiseAND(F.shiftleft(missed, 1)) != 0)
    # a notice that breaks off may be denied by the word behind it
    upto = lambda c: F.when(missed < F.expr("shiftleft(1L, cast(grams - 1 as int))"), F.col(f"{c}_upto")).otherwise(F.col(f"{c}_after"))
    # the words that name the license stand there, and no more denials than the notice has itself
    meant = (missed.bitwiseAND(F.col("named")) == 0) & (
        upto("denied") - F.col("denied_before") <= upto("own") - F.col("own_before"))
    base_label = F.when(F.col("base") & (F.col("places") > 0), F.col("label"))
    label = F.when(F.when(F.col("base"), F.col("places") > 0).otherwise(((share >= least_share) | one_edit) & meant), F.col("label"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    judged = passage.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("base"), F.col("places"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_place"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("last_place"))).alias("last_word"),
        joined(base_label).alias("base_labels"), joined(label).alias("labels"), F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("_rows"))
    return judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_rows"))).drop("_rows", "_copy", "digest")
