"""Whole texts as numpy arrays: the words, lines and rolling hashes of an Arrow batch without a Python loop over characters.

Texts are UTF-8; both word classes used here hold every byte from 0x80 up, so splitting bytes is splitting code points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; it bounds the memory of a task, never what a text may hold. A longer text is a piece of its own.
PIECE_BYTES = 512 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.arange(256)
#: Word bytes: 0-9, a-z and everything beyond ASCII (texts are lower-cased first).
WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
#: Bytes of words that only white space parts.
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93
_TABLE = np.array([((b + 1) * _ODD ^ ((b + 1) << 17)) * 0xBF58476D1CE4E5B9 & _MASK for b in range(256)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (one more offset than texts); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first = int(offsets[0])
    raw = np.frombuffer(data, np.uint8)[first:int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - first


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of the next start, and so on."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if total else out


@dataclass
class Words:
    """Words of a batch in text order; `offsets[d]:offsets[d + 1]` are those of text d."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch: (sums[end] - sums[start]) times the inverse power of start."""
    powers, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[:len(data)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of `inside` bytes of each text, A-Z lower-cased first if `lower`."""
    if lower:
        data = _LOWER[data]
    starts, ends = runs(inside[data], offsets)
    return Words(starts, ends, stretch_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, offsets))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags that do not cross the offsets."""
    n = len(flags)
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] |= flags[cuts]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    last[cuts - 1] |= flags[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def window_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of k consecutive words of a text: the index of its first word, and its hash."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(_ODD) + w.hashes[j:n - k + 1 + j]
    left = np.repeat(w.offsets[1:], w.counts) - np.arange(n)  # words up to the end of the text
    first = np.flatnonzero(left[:len(h)] >= k)
    return first, mix(h[first])


def by_text(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `counted` over each text."""
    sums = np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which have an equal one before them."""
    many, later = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        ordered = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        later[np.minimum.reduceat(order, heads)] = False
        sizes = np.diff(np.append(heads, len(keys)))
        many[order] = np.repeat(sizes > 1, sizes)
    return many, later


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Flags of the places that a stretch of `length` from any of the starts covers."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
