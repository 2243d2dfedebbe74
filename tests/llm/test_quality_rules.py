import numpy as np
import pyarrow as pa

import brute
from leaseloom.llm import quality_rules as Q
from leaseloom.llm import text_arrays as A
from leaseloom.llm.boosted_trees import train

TEXTS = ["a b c d e a b c d e f", "x\n\nx\nx ", None, "", "é ü\tß\n#*$%&|<>", "one\n" * 30, "a a a a a a a", "w " * 5000, " \n \n", "so it is that this text has some more than ten words, all different ones"]


def test_counts_against_brute_force():
    got = Q.text_counts(*A.utf8(pa.array(TEXTS)))[:, :5].tolist()
    assert got == [list(brute.text_counts(t)) for t in TEXTS]


def test_slices_of_a_batch_are_read_from_their_place():
    batch = pa.record_batch([pa.array(TEXTS)], names=["detail"])
    parts = [Q.text_counts(*A.utf8(b.column("detail"))) for b in A.pieces(iter([batch]), "detail", 40)]
    assert len(parts) > 3 and np.array_equal(np.concatenate(parts), Q.text_counts(*A.utf8(pa.array(TEXTS))))


def test_base_rules_and_trees_against_plain_statements():
    texts = [*TEXTS, "one two three four five six seven eight nine ten", "a b c d e f g h i", ("x y z w v " * 2 + "q r s t u ") * 2, "r s t u v w " * 3]
    counts = Q.text_counts(*A.utf8(pa.array(texts)))
    for t, failed in zip(texts, Q.base_failed(counts).tolist(), strict=True):
        n_words, *_, n_repeat = brute.text_counts(t)
        assert failed == (n_words < 10 or 100 * n_repeat > 20 * n_words)
    r = np.random.default_rng(2)
    x, y = r.random((500, 3)), (r.random(500) < 0.4).astype(float)
    forest = train(x, y, falling=(0,))

    def walk(row):
        total = forest.bias
        for node in forest.roots.tolist():
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:200]), [walk(row) for row in x[:200]], atol=1e-12)


def test_trees_learn_and_never_rise_with_a_falling_feature():
    r = np.random.default_rng(5)
    x = r.random((4000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 2] > 0.2) ^ (r.random(4000) < 0.05)).astype(float)
    forest = train(x, y, falling=(0, 1))
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.93
    grid = np.repeat(r.random((50, 3)), 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_verdicts_and_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet").selectExpr("doc_id as insight_id", "text as detail", "1 as score")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/labels.parquet").selectExpr("doc_id as insight_id", "quality")
    forest = Q.fit_verdict(docs, labels.filter("insight_id % 3 <> 0"))
    judged = Q.quality_rules(docs, forest).join(labels.filter("insight_id % 3 = 0"), "insight_id").filter("not base_failed").toPandas()
    assert (judged.kept == (judged.quality == 1)).mean() > 0.97
    rows = spark.createDataFrame([(1, "a", TEXTS[-1]), (2, "b", None), (None, "c", "short")], "insight_id bigint, kept string, detail string")
    assert sorted(r.base_failed for r in Q.quality_rules(rows, forest).collect()) == [False, True, True]
    assert {r.insight_id for r in Q.good_insights(rows, forest).collect()} <= {1}
