import random

import numpy as np
import pytest

import brute
from leaseloom.llm import suffix_dedup as D
from leaseloom.llm.suffix_array import common_prefixes, packed_bytes, suffix_array

EDGE = [(1, "ab" * 60), (2, "ab" * 40), (None, "ab" * 60), (3, None), (3, ""), (4, "x" * 49), (5, "x" * 50), (6, "x" * 51), (6, "x" * 51),
        (6, "y" * 10 + "x" * 60), (None, None), (7, "é" * 30 + "ab" * 30), (-4, "ü" + "é" * 30)]


def passages(seed, n=120):
    """Insights that share some passages, whole or in part, near, at and beyond the 50 bytes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            a = r.randrange(len(p))
            parts += [p[a:a + r.randint(30, 150)], word()]
        rows.append((i, "".join(parts)))
    return rows + [(n + 1, "\n".join(shared) * 20)]


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 300, b"abracadabra" * 7, bytes(random.Random(1).choices(b"ab", k=2000))])
def test_suffix_array_and_common_prefixes(data):
    codes = np.frombuffer(data, np.uint8)
    packed = packed_bytes(codes) if len(codes) else np.zeros(0, np.uint64)
    order, rank = suffix_array(packed, 8)
    want = sorted(range(len(data)), key=lambda k: data[k:])
    assert order.tolist() == want and rank[order].tolist() == list(range(len(data)))
    shared = lambda a, b: next((k for k in range(50) if data[a + k:a + k + 1] != data[b + k:b + k + 1] or a + k >= len(data) or b + k >= len(data)), 50)
    assert common_prefixes(packed, order, rank, 50, lanes=7).tolist() == [0] * bool(data) + [shared(a, b) for a, b in zip(want, want[1:])]


@pytest.mark.parametrize("rows, shard", [(EDGE, 50), (EDGE + passages(2), 700), (passages(3), 1 << 20), ([], 100)])
def test_against_brute_force(spark, rows, shard):
    df = spark.createDataFrame(rows, "insight_id bigint, detail string").selectExpr("insight_id", "detail", "1 as first_id", "'x' as text_key", "'y' as kept")
    got = [tuple(r) for r in D.repeated_passages(df, shard_bytes=shard).collect()]
    assert sorted(got, key=str) == sorted(brute.repeated_passages(rows), key=str)


def test_rows_without_repeats(spark):
    rows = [(1, "p", "a" * 60), (2, "q", "b" + "a" * 60), (3, "r", None), (4, "s", "é" * 40), (5, "t", "ü" + "é" * 40)]
    df = spark.createDataFrame(rows, "insight_id bigint, headline string, detail string")
    out = D.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "p", "a" * 60), (2, "q", "b"), (3, "r", ""), (4, "s", "é" * 40), (5, "t", "ü")]


def test_the_callers_columns_come_back_whatever_they_are_called(spark):
    names = ["text_key", "kept", "n_bytes", "first_id", "n_removed", "n_spans", "kept_sha256", "_order", "_text", "kept_"]
    df = spark.createDataFrame([(1, "a" * 60, *names), (2, "b" + "a" * 60, *names)], f"insight_id bigint, detail string, {', '.join(f'{n} string' for n in names)}")
    out = D.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a" * 60, *names), (2, "b", *names)]


def test_strings_with_one_hash_are_still_told_apart(monkeypatch):
    body = np.frombuffer(b"a" * 50 + b"b" * 50 + b"a" * 50, np.uint8)
    monkeypatch.setattr(D.A, "stretch_hashes", lambda sums, starts, ends: np.zeros(len(starts), np.uint64))
    number = D._string_numbers(body, np.array([0, 50, 100]), 50)
    assert number[0] == number[2] != number[1]
