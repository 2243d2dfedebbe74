import hashlib
import math

import numpy as np
import pytest

from leaseloom.llm import centroids as C
from leaseloom.operators import marts as M
from leaseloom.plans import catalog


def clustered(rows, width, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [v for _, v in order[:clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    deal = lambda: [min((gap(v, c), k) for k, c in enumerate(now)) for _, v in kept]
    for _ in range(rounds):
        dealt = deal()
        for k in range(len(now)):
            own = [v for (_, v), (_, c) in zip(kept, dealt, strict=True) if c == k]
            if own:
                now[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    dealt = deal()
    inertia = {k: sum(d for d, c in dealt if c == k) for k in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, dealt, strict=True)), key=str)


COLUMNS = ["profile_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = "profile_id bigint, figures array<double>, cluster string, cells int"


def run(spark, rows, width, clusters, rounds, pivots=64):
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(4)
    return C.cluster_profiles(frame, width, clusters, rounds, pivots=pivots)


@pytest.mark.parametrize(("clusters", "pivots"), [(5, 64), (40, 64), (40, 3), (7, 1)])
def test_against_brute_force(spark, clusters, pivots):
    r = np.random.default_rng(clusters)
    homes = r.normal(0, 2, (6, 4))
    rows = [(k, (homes[k % 6] + r.normal(0, 0.2, 4)).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(200)] + [(3, rows[3][1])] * 3  # one hot profile, and repeated rows
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, None, 2.0, 3.0]), (2004, [1.0, float("nan"), 2.0, 3.0]),
             (2005, [1.0, float("inf"), 2.0, 3.0]), (2006, [-0.001, 0.0, 0.001, -1e5]), (None, [0.5, 0.5, 0.5, 0.5]), (2007, [1.0] * 5)]
    got = run(spark, rows, 4, clusters, 3, pivots).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, 4, clusters, 3)


def test_few_or_equal_or_no_profiles(spark):
    for rows in ([(1, [0.1, 0.2])], [(k, [0.1, 0.2]) for k in range(60)], [(1, [0.1])]):
        assert sorted(map(tuple, run(spark, rows, 2, 4, 5).select(COLUMNS).collect()), key=str) == clustered(rows, 2, 4, 5)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e300, 0.0])], 2, 4, 1).collect()


def test_bounds_never_exceed_the_distance_and_spare_far_centroids():
    r = np.random.default_rng(9)
    homes = r.integers(-40_000, 40_000, (30, 16))
    rows = homes[r.integers(0, 30, 4000)] + r.integers(-300, 300, (4000, 16))
    first = rows[:60]
    pivots = C.pivots_of(first, 64)
    known = C.distances(rows, pivots).astype(np.float32).astype(float)
    for drift in (0, 3, 500):
        now = C.Round.of(first + r.integers(-drift, drift + 1, first.shape), pivots)
        every = np.stack([C.squared(rows, c) for c in now.centroids], 1)
        assert (now.lower_bounds(known) <= every).all()
        cluster, distance, compared = now.nearest(rows, known)
        assert np.array_equal(cluster, every.argmin(1)) and np.array_equal(distance, every.min(1))
        assert compared.mean() < 10


def test_books_by_their_profitability(spark, sf_dir):
    matrix = M.property_profitability(catalog.context(spark, sf_dir).T).filter("plottable")
    books = C.book_profiles(matrix, ["revenue_capture_pct", "pct_occupied"])
    got = C.cluster_profiles(books, 2, clusters=4, rounds=5).toPandas()
    assert len(got) == matrix.count() and got.cluster.nunique() > 1
    want = clustered([(r.profile_id, r.figures) for r in books.collect()], 2, 4, 5)
    assert sorted(map(tuple, got[COLUMNS].itertuples(index=False)), key=str) == want
