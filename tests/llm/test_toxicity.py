import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leaseloom.llm import text_arrays as A
from leaseloom.llm import toxicity as T


def test_label_model_finds_accuracies_and_discounts_echoes():
    r = np.random.default_rng(3)
    toxic = r.random(20_000) < 0.1
    v = 2 * T.LEXICONS + 5
    votes = np.zeros(20_000, np.int64)
    for k in range(v):
        fires = r.random(20_000) < np.where(toxic, 0.7 if k < 2 * T.LEXICONS + 2 else 0.1, 0.02)
        votes |= fires.astype(np.int64) << k
    votes = votes & ~np.int64(2) | ((votes & 1) << 1)  # the second voter repeats the first
    known, counts = np.unique(votes, return_counts=True)
    model = T.fit_label_model(known, counts.astype(float), v)
    assert abs(model.fires[1, 4] - 0.7) < 0.05 and abs(model.share - 0.1) < 0.02
    assert model.weight[0] < 0.7 < model.weight[4]
    assert ((model.posterior(votes) > 0.5) == toxic).mean() > 0.99


def plain_label_model(votes, voters, rounds=60):
    """The same estimates text by text: no patterns, no arrays."""
    lexical = [k < 2 * T.LEXICONS + 2 for k in range(voters)]
    fires = [[0.02 if x else 0.1 for x in lexical], [0.5 if x else 0.15 for x in lexical]]
    share, weight = 0.1, [1.0] * voters
    bits = [[v >> k & 1 for k in range(voters)] for v in votes]

    def posterior(b):
        odds = math.log(share / (1 - share))
        for k in range(voters):
            odds += weight[k] * (math.log(fires[1][k] / fires[0][k]) if b[k] else math.log((1 - fires[1][k]) / (1 - fires[0][k])))
        return 1 / (1 + math.exp(-max(-30, min(30, odds))))

    for turn in range(rounds):
        p = [posterior(b) for b in bits]
        masses = [[1 - x for x in p], p]
        sizes = [sum(m) for m in masses]
        new = [[(sum(m * b[k] for m, b in zip(masses[y], bits, strict=True)) + (0.05, 1.0)[y]) / (sizes[y] + 2) for k in range(voters)] for y in (0, 1)]
        for k in range(voters):
            if lexical[k]:
                new[1][k] = max(new[1][k], new[0][k])
        if turn == rounds // 2:
            alike = [[0.0] * voters for _ in range(voters)]
            for y in (0, 1):
                cover = [[sum(m * (b[i] - new[y][i]) * (b[j] - new[y][j]) for m, b in zip(masses[y], bits, strict=True)) / max(sizes[y], 1) for j in range(voters)] for i in range(voters)]
                spread = [math.sqrt(max(cover[i][i], 1e-9)) for i in range(voters)]
                for i in range(voters):
                    for j in range(voters):
                        if spread[i] * spread[j] > 1e-6:
                            alike[i][j] = max(alike[i][j], cover[i][j] / (spread[i] * spread[j]))
                        else:
                            alike[i][j] = max(alike[i][j], 0.0)
            weight = [1 / (1 + sum(min(1, max(0, alike[i][j])) for j in range(voters) if j != i)) for i in range(voters)]
        fires, share = new, min(0.5, max(0.001, sizes[1] / len(votes)))
    return fires, share, weight, [posterior(b) for b in bits]


def test_label_model_against_a_plain_statement():
    r = np.random.default_rng(8)
    v = 2 * T.LEXICONS + 5
    toxic = r.random(250) < 0.2
    votes = np.zeros(250, np.int64)
    for k in range(v):
        votes |= (r.random(250) < np.where(toxic, 0.5, 0.05)).astype(np.int64) << k
    known, counts = np.unique(votes, return_counts=True)
    model = T.fit_label_model(known, counts.astype(float), v)
    fires, share, weight, scores = plain_label_model(votes.tolist(), v)
    assert np.allclose(model.fires, fires, atol=1e-9) and abs(model.share - share) < 1e-9 and np.allclose(model.weight, weight, atol=1e-9)
    assert np.allclose(model.posterior(votes), scores, atol=1e-9)


def test_scores_against_a_plain_statement():
    r = np.random.default_rng(6)
    texts = ["you vile thing", "a calm day, a calm day", "", None, "vileness everywhere vile"]
    weight = np.where(r.random(1 << T.FEATURE_BITS) < 0.5, r.normal(0, 2, 1 << T.FEATURE_BITS), 0)
    classifier = T.Classifier(weight, -0.4)
    hashes, _, owner, _ = T.text_features(*A.utf8(pa.array(texts)))
    for k in range(len(texts)):
        cells = {int(h) >> (64 - T.FEATURE_BITS) for h, o in zip(hashes.tolist(), owner.tolist(), strict=True) if o == k}
        want = 1 / (1 + math.exp(-(-0.4 + sum(weight[c] for c in cells))))
        assert abs(classifier.score(*A.utf8(pa.array(texts)))[k] - want) < 1e-9


def test_stems_are_counted_in_characters():
    hashes, kinds, owner, _ = T.text_features(*A.utf8(pa.array(["véquée", "véquaire", "véqu", None])))
    stem = lambda d, k: set(hashes[(owner == d) & (kinds == k)].tolist())
    assert stem(0, 1) == stem(1, 1) != set() and stem(0, 2) != stem(1, 2) and not stem(2, 1) and not (owner == 3).any()


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    insights = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as insight_id", "text as detail", "lang", "1 as score")
    reviews = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id as insight_id", "toxic")
    classifier = T.fit_toxicity(insights, reviews)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x")], "insight_id bigint, detail string")
    scored = T.score_toxicity(insights.select("insight_id", "detail").unionByName(odd), classifier)
    found = scored.join(reviews, "insight_id").filter("held_out").toPandas()
    assert found[found.toxic == 1].predicted.mean() > 0.85 and found[found.toxic == 0].predicted.mean() < 0.02
    assert [r.predicted for r in scored.filter("insight_id is null or insight_id < 0").collect()] == [0, 0, 0]


def test_copies_and_reviews_without_insights_leave_the_lexicons_alone(spark):
    toxic = [(k, f"vile{k % 30} scorn{k % 30} some words here and number n{k} to tell it by") for k in range(300)]
    clean = [(k, f"some words here and calm c{k} to tell it by in peace p{k}") for k in range(300, 3300)]
    hot = [(k, "one rude line that very many people copied word for word") for k in range(3300, 7300)]
    lost = [(k, 1) for k in range(10_000, 14_000)]
    schema = "insight_id bigint, detail string"
    alone = T.mine_voters(spark.createDataFrame(toxic + clean, schema), spark.createDataFrame([(k, int(k < 300)) for k, _ in toxic + clean], "insight_id bigint, toxic int"))
    every = toxic + clean + hot
    marked = [(k, int(k < 300 or k >= 3300)) for k, _ in every] + lost
    heavy = T.mine_voters(spark.createDataFrame(every, schema), spark.createDataFrame(marked, "insight_id bigint, toxic int"))
    assert len(alone.words) >= 60 and set(alone.words.tolist()) <= set(heavy.words.tolist())
    assert len(alone.stems) > 0 and set(alone.stems.tolist()) <= set(heavy.stems.tolist())


def test_sketches_tell_variants_apart_and_copies_not():
    words = [f"w{k}" for k in range(60)]
    base = " ".join(words)
    half = " ".join(words[:30] + [f"x{k}" for k in range(30)])
    found = T.text_sketches(*A.utf8(pa.array([base, base.upper() + " ", half, "a b", "a b", "a c", "", None])))
    assert found[0] == found[1] and found[3] == found[4] and found[6] == found[7]
    assert len({found[0], found[3], found[5], found[6]}) == 4
    # texts alike to a third have one sketch once in 81
    pair = lambda n: [" ".join(f"{n}w{k}" for k in range(60)), " ".join(f"{n}w{k}" if k < 30 else f"{n}x{k}" for k in range(60))]
    assert sum(len(set(T.text_sketches(*A.utf8(pa.array(pair(n)))).tolist())) == 1 for n in range(200)) < 15


def test_choice_hangs_on_ids_and_texts_alone(spark):
    """Copies go before the bound is applied, a toxic variant stays beside its clean copies, and the order of rows plays no part."""
    r = np.random.default_rng(5)
    copies = [(k, "one calm line that very many people copied word for word") for k in range(2000)]
    others = [(k, " ".join(f"n{x}" for x in r.integers(0, 400, 12))) for k in range(2000, 2300)]
    found = spark.createDataFrame([(k, int(k == 7), s) for (k, _), s in zip(copies + others, T.text_sketches(*A.utf8(pa.array(
        [t for _, t in copies + others]))).tolist(), strict=True)], "insight_id bigint, votes bigint, sketch bigint")
    ids = lambda df, n: [x.insight_id for x in T._chosen(df, ["sketch", "votes"], ["votes"], n).collect()]
    every = set(ids(found, 1000))
    assert 7 in every and len([k for k in every if k < 2000]) == 2 and every >= set(range(2000, 2300))
    assert set(ids(found, 50)) == set(ids(found.orderBy("votes", F.desc("insight_id")).repartition(7), 50)) and len(ids(found, 50)) == 50
    insights = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "insight_id bigint, detail string")
    chosen = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "insight_id bigint, votes bigint")
    assert sorted((x.insight_id, x.votes, x.detail) for x in T._details(insights, chosen).collect()) == [(1, 5, "a"), (2, 6, None)]


def test_same_classifier_from_any_order_of_rows(spark):
    r = np.random.default_rng(9)
    rows = [(k, " ".join(([f"vile{r.integers(12)}", f"scorn{r.integers(12)}"] if k % 8 == 0 else []) + [f"w{x}" for x in r.integers(0, 300, 20)]))
            for k in range(1500)]
    rows += [(k + 5000, rows[k][1]) for k in range(0, 1500, 3)] + rows[:40]
    insights = spark.createDataFrame(rows, "insight_id bigint, detail string")
    reviews = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(1500)], "insight_id bigint, toxic int")
    one = T.fit_toxicity(insights.repartition(3), reviews)
    two = T.fit_toxicity(insights.repartition(11, "detail").sortWithinPartitions(F.desc("insight_id")), reviews.repartition(5))
    assert one.bias == two.bias and np.array_equal(one.weight, two.weight) and (one.weight != 0).any()


def test_no_reviews(spark):
    insights = spark.createDataFrame([(1, "a b"), (2, None)], "insight_id bigint, detail string")
    classifier = T.fit_toxicity(insights, spark.createDataFrame([], "insight_id bigint, toxic int"))
    assert all(0 <= r.score <= 1 for r in T.score_toxicity(insights, classifier).collect())
    empty = insights.limit(0)
    assert T.score_toxicity(empty, T.fit_toxicity(empty, spark.createDataFrame([], "insight_id bigint, toxic int"))).collect() == []
