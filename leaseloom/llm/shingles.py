"""Sets of word shingles of whole texts, and their MinHash signatures, on numpy arrays."""

from __future__ import annotations

import numpy as np

from leaseloom.llm import text_arrays as A

SHINGLE_WORDS = 5
#: Universal hashes h -> (a h + b) / 2^32 modulo 2^64; fixed, so signatures of different runs compare.
SIGNATURE = 128
_random = np.random.default_rng(20_240_917)
_MULTIPLY = _random.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, and where each text's begin. A text of fewer words has its whole sequence
    as the only one; a text without words has none."""
    w = A.words(data, offsets, A.NOT_SPACE)
    n = len(offsets) - 1
    first, hashes = A.window_hashes(w, words)
    owner = w.owner[first]
    few = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            has = w.counts[few] > j
            whole[has] = whole[has] * np.uint64(A._ODD) + w.hashes[w.offsets[few[has]] + j]
        place = np.searchsorted(owner, few)
        owner, hashes = np.insert(owner, place, few), np.insert(hashes, place, A.mix(whole + w.counts[few].astype(np.uint64)))
    of = A.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    _, again = A.repeated(hashes ^ of[owner])
    hashes, owner = hashes[~again], owner[~again]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sixteen bytes for each set, equal for equal sets."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k, salt in enumerate((0x51ED270B, 0xC3A5C85C97CB3127)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(hashes ^ np.uint64(salt)))])
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    return out


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over each set; all ones for an empty set."""
    n = len(offsets) - 1
    out = np.full((n, SIGNATURE), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        for k in range(SIGNATURE):
            out[filled, k] = np.minimum.reduceat((hashes * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), offsets[filled])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` rows of each signature; bands do not meet each other."""
    n, width = signature.shape
    parts = signature.reshape(n, width // rows, rows).astype(np.uint64)
    h = np.arange(width // rows, dtype=np.uint64)[None, :] + np.zeros((n, 1), np.uint64)
    for j in range(rows):
        h = A.mix(h * np.uint64(A._ODD) + parts[:, :, j])
    return h
