import math
from collections import Counter

import numpy as np
import pyarrow as pa

from leaseloom.llm import quality_classifier as Q
from leaseloom.llm import text_arrays as A

TEXTS = ["Rent rose at 115r, rent rose again.", "UNITS!! UNITS!! VACANT!!", None, "", " \n ", "a", "é ü é ü é ü", "x " * 3000]


def cells_of(texts):
    cells, owner = Q.ngram_cells(*A.utf8(pa.array(texts, pa.string())))
    return [cells[owner == k] for k in range(len(texts))]


def test_each_text_has_its_own_ngrams_once():
    every = cells_of(TEXTS)
    assert all(len(set(c.tolist())) == len(c) for c in every)
    for text, cells in zip(TEXTS, every, strict=True):
        assert np.array_equal(cells_of([text])[0], cells)  # whatever stands before or behind
    assert np.array_equal(every[2], every[3]) and np.array_equal(every[3], every[4]) and len(every[3]) == 1
    # word n-grams stop at the end of a text
    assert not set(cells_of(["b c"])[0].tolist()) <= set(np.concatenate(cells_of(["a b", "c d"])).tolist())


def test_ratios_and_descent_against_plain_statements():
    r = np.random.default_rng(4)
    good = (r.random(300) < 0.7).astype(float)
    texts = [np.unique(r.integers(0, 40, 12) + (20 if g else 0)) for g in good]
    ratio = Q.log_count_ratios(texts, good)
    up, down = Counter(), Counter()
    for t, g in zip(texts, good, strict=True):
        (up if g else down).update(t.tolist())
    known = [c for c in set(up) | set(down) if up[c] + down[c] >= Q.LEAST_TEXTS]
    for c in known:
        want = math.log((up[c] + 1) / sum(up[x] + 1 for x in known)) - math.log((down[c] + 1) / sum(down[x] + 1 for x in known))
        assert abs(ratio[c] - want) < 1e-9
    # the dual solution meets the primal's value, as it does only at the optimum
    rows = [(t, ratio[t] / np.sqrt((ratio[t] ** 2).sum())) for t in texts]
    sign, cost = np.where(good > 0, 1.0, -1.0), np.full(300, 0.7)
    weight, bias = Q.hinge_by_dual_descent(rows, sign, cost, 1 << Q.CELL_BITS, turns=2000, enough=1e-6)
    value = lambda w, b: (w @ w + b * b) / 2 + sum(c * max(0, 1 - s * (w[at] @ v + b)) for (at, v), s, c in zip(rows, sign, cost, strict=True))
    best = value(weight, bias)
    for _ in range(200):
        assert value(weight + np.where(ratio != 0, r.normal(0, 0.01, len(weight)), 0), bias + r.normal(0, 0.01)) >= best - 1e-6


def test_one_kind_of_labels_or_none():
    cells = cells_of(TEXTS)
    off = np.zeros(len(TEXTS), bool)
    only = Q.fit_model(cells, np.ones(len(TEXTS)), off)
    assert (only.score(*A.utf8(pa.array(TEXTS))) > 0.9).all()
    none = Q.fit_model([], np.zeros(0), np.zeros(0, bool))
    assert none.score(*A.utf8(pa.array(TEXTS))).tolist() == [0.5] * len(TEXTS)


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    insights = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as insight_id", "text as detail", "lang", "1 as score", "2 as _good")
    reviews = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id as insight_id", "quality", "'x' as detail")
    model = Q.fit_quality(insights, reviews)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (-3, "x"), (-3, "x")], "insight_id bigint, detail string")
    scored = Q.score_quality(insights.select("insight_id", "detail").unionByName(odd), model)
    found = scored.join(reviews, "insight_id").filter("held_out").toPandas()
    assert found[found.quality == 1].predicted.mean() > 0.98 and found[found.quality == 0].predicted.mean() < 0.1
    strange = scored.filter("insight_id is null or insight_id < 0").collect()
    assert len(strange) == 5 and all(0 <= r.score <= 1 for r in strange) and len({r.score for r in strange if r.insight_id == -3}) == 1
    assert [r.held_out for r in strange if r.insight_id is None] == [False]


def test_repeated_ids_and_verdicts_and_held_out_labels(spark):
    words = [f"steady w{k % 7} line {k}" for k in range(200)] + [f"JUNK!! w{k % 7} ### {k}" for k in range(200)]
    insights = spark.createDataFrame([(k, t) for k, t in enumerate(words)] * 3 + [(None, "JUNK!!")], "insight_id bigint, detail string")
    marked = [(k, int(k < 200)) for k in range(400)]
    reviews = spark.createDataFrame(marked * 2 + [(7, None), (None, 1), (9_999, 0)], "insight_id bigint, quality int")
    model = Q.fit_quality(insights, reviews)
    scores = {r.insight_id: r for r in Q.score_quality(insights, model).collect()}
    assert all(scores[k].predicted == int(k < 200) for k in range(400))
    # labels of held-out insights change nothing
    turned = reviews.selectExpr("insight_id", "case when crc32(cast(insight_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    again = Q.fit_quality(insights, turned)
    assert np.array_equal(again.weight, model.weight) and (again.bias, again.slope, again.level) == (model.bias, model.slope, model.level)
    assert Q.score_quality(insights.limit(0), Q.fit_quality(insights.limit(0), reviews)).collect() == []
