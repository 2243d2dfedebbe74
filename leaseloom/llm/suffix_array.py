"""Suffix arrays by Larsson-Sadakane refinement, and common prefixes by Kasai's rule, on whole numpy arrays."""

from __future__ import annotations

import numpy as np


def packed_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts as they do; zeros follow the last byte."""
    b = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    two = (b[:-1] << np.uint64(8)) | b[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def suffix_array(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and each one's place in that order.

    `keys` sorts the suffixes by their first `step` symbols. Each round doubles that depth: only groups of suffixes still equal are
    sorted again, by the rank of what follows the part that is known to be equal, until every group is a single suffix."""
    n = len(keys)
    order = np.argsort(keys)
    rank = np.empty(n, np.int64)
    at, members, sort_key = np.arange(n), order, keys[order]
    depth = step
    while True:
        head = np.ones(len(at), bool)
        head[1:] = sort_key[1:] != sort_key[:-1]
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, len(at)))
        rank[members] = np.repeat(at[first], sizes)
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            return order, rank
        at, members = at[open_], members[open_]
        follow = members + depth
        beyond = follow >= n
        following = np.where(beyond, 0, rank[np.where(beyond, 0, follow)] + 1)
        sort_key = rank[members] * (n + 1) + following
        again = np.argsort(sort_key)
        members, sort_key = members[again], sort_key[again]
        order[at] = members
        depth *= 2


def common_prefixes(packed: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 8192) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before it, counted up to `most`.

    Kasai's rule: going through the text, the shared length falls by one at most from a place to the next. The text is cut in `lanes`
    stretches that are gone through side by side."""
    n = len(packed)
    out = np.zeros(n, np.int16)
    if n < 2:
        return out
    lanes = min(lanes, n)
    stretch = -(-n // lanes)
    starts = np.arange(0, n, stretch)
    shared = np.zeros(len(starts), np.int64)
    for t in range(stretch):
        i = starts + t
        if i[-1] >= n:
            i, starts, shared = i[:-1], starts[:-1], shared[:-1]
        r = rank[i]
        j = order[r - 1]
        shared = np.where(r > 0, np.maximum(shared - 1, 0), 0)
        live = np.flatnonzero((r > 0) & (shared < most))
        while len(live):
            a, b = i[live] + shared[live], j[live] + shared[live]
            inside = (a < n) & (b < n)
            live, a, b = live[inside], a[inside], b[inside]
            differ = packed[a] ^ packed[b]
            equal = np.zeros(len(live), np.int64)
            for bits in range(8, 72, 8):
                equal += differ < np.uint64(1 << (64 - bits)) if bits < 64 else differ == 0
            room = n - np.maximum(a, b)
            shared[live] += np.minimum(equal, room)
            live = live[(equal == 8) & (room > 8) & (shared[live] < most)]
        out[r] = np.minimum(shared, most)
    return out
