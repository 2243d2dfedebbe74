import math
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from leaseloom.llm import lexical_search as L
from leaseloom.llm import text_arrays as A


def ranked(insights, headlines, top):
    docs = [(i, Counter(brute.WORD.findall(brute.lower(t)))) for i, t in insights]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    said = {}
    for i, t in headlines:
        said.setdefault(i, set()).update(brute.WORD.findall(brute.lower(t)))
    out = []
    for h, words in said.items():
        rows = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs // total if total else 0)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                rows.append((-score, brute.place(i), i))
        rows.sort(key=lambda r: r[:2])
        out += [(h, k, i, -s) for k, (s, _, i) in enumerate(rows[:top], 1)]
    return sorted(out, key=str)


INSIGHTS = [
    (1, "Rent rose; rent ROSE again at 115r"), (2, "Vacancy fell."), (3, None), (4, ""), (5, "rent-free weeks, 2 weeks"), (6, "Ünits vacant\nünits ünits"),
    (7, "rent rent rent rent"), (None, "rent rose"), (8, "Rent rose; rent ROSE again at 115r"), (8, "Rent rose; rent ROSE again at 115r"), (9, "rents roses"),
    (10, "...!?"), (11, "lease " * 20_000 + "rose"), (12, "\x00rent\x7frose\x00"), (13, "ü"), (14, "rent")]
HEADLINES = [(1, "Rent rose"), (2, "units vacant"), (3, None), (4, ""), (5, "ÜNITS ünits VACANT"), (6, "weeks"), (6, "fell weeks"), (None, "lease"), (None, "again"), (7, "absent"),
             (8, "ü rent")]


@pytest.mark.parametrize(("top", "size", "many"), [(50, 1 << 20, 8_192), (2, 1 << 20, 8_192), (3, 16, 8_192), (50, 1 << 20, 2)])
def test_against_brute_force(spark, top, size, many):
    insights = spark.createDataFrame([(i, t, 1, 2) for i, t in INSIGHTS], "insight_id bigint, detail string, score int, headline int").repartition(3)
    headlines = spark.createDataFrame([(i, t, "x") for i, t in HEADLINES], "headline_id bigint, headline string, detail string")
    got = L.rank_details(insights, headlines, top, size, many)
    assert got.columns == ["headline_id", "rank", "insight_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(INSIGHTS, HEADLINES, top)


def test_many_copies_and_ties_are_whole(spark):
    rows = [(k, "occupancy is low") for k in range(4000)] + [(k, f"occupancy {k}") for k in range(4000, 4100)]
    asked = [(1, "occupancy low"), (2, "occupancy"), (3, "4050")]
    got = L.rank_details(spark.createDataFrame(rows, "insight_id bigint, detail string").repartition(16), spark.createDataFrame(asked, "headline_id bigint, headline string"))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, asked, 50)


def test_empty_tables(spark):
    insights, headlines = spark.createDataFrame(INSIGHTS, "insight_id bigint, detail string"), spark.createDataFrame(HEADLINES, "headline_id bigint, headline string")
    for got in (L.rank_details(insights.limit(0), headlines), L.rank_details(insights, headlines.limit(0)), L.rank_details(insights.filter("insight_id in (3, 4, 10)"), headlines)):
        assert got.columns == ["headline_id", "rank", "insight_id", "score"] and got.collect() == []


def test_the_best_lists_keep_ties_whatever_the_order():
    r = np.random.default_rng(2)
    headline, insight, score = r.integers(0, 5, 60_000), r.permutation(60_000), r.integers(0, 9, 60_000)
    best = L.Best(5, 7)
    best.enough = 500
    for part in np.array_split(np.arange(60_000), 90):
        best.add(headline[part], insight[part], score[part])
    got = sorted(zip(*(x.tolist() for x in best.kept()), strict=True))
    want = [x for h in range(5) for x in sorted(((h, int(i), int(s)) for i, s in zip(insight[headline == h], score[headline == h], strict=True)), key=lambda x: (-x[2], x[1]))[:7]]
    assert got == sorted(want)


def test_counts_of_a_slice():
    automaton = L.Automaton(["a", "ab", "é", "b"])
    batch = pa.record_batch([pa.array(["zz", "a ab A-b", None, "éé é", "", "b"])], names=["detail"])
    sizes, text, term, times = automaton.counts(*A.utf8(batch.slice(1, 5).column("detail")))
    assert sizes.tolist() == [4, 0, 2, 0, 1]
    assert list(zip(text.tolist(), term.tolist(), times.tolist(), strict=True)) == [(0, 0, 2), (0, 1, 1), (0, 3, 1), (2, 2, 1), (4, 3, 1)]
