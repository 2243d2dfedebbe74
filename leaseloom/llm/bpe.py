"""BPE encoding and decoding of insight details with forced boundaries.

A byte pair that stands inside no vocabulary token is never merged over, so a text is cut there for certain. The pieces between such cuts
are encoded on their own, remembered, and put together again."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leaseloom.llm import text_arrays as A

#: Words, and pieces of words, remembered by a task before it starts afresh, and characters of a word that is; they bound memory only.
REMEMBERED, REMEMBERED_LENGTH = 500_000, 60
#: Bytes of a piece that is remembered apart from its word.
SHORT = 6
#: Parts of a piece from which on the best pair is taken from a heap.
LONG = 300
PIECE_BYTES = 512 << 10
OUT = "insight_id bigint, token_ids array<int>"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where it is printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class BytePairs:
    """The tokenizer of a vocabulary file: lower-cased words with word ends, and added tokens taken from the text as they stand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.merges = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(model["merges"])}
        kinds = [n["type"] for n in (spec.get("normalizer") or {"normalizers": []})["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: only lower-cased word vocabularies are read")
        self.word = regex.compile(steps[0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # a group keeps the added tokens among what is split
        self.adds = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.tokens = {v: k for k, v in self.vocabulary.items()} | {v: k for k, v in self.added.items()}
        self.characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.characters)}
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocabulary:
            codes = [byte_of[c] for c in (token.removesuffix(self.end) if self.end else token)]
            self.inside[codes[:-1], codes[1:]] = True
        # for each two bytes, whether a token may span them
        self.joins = self.inside.tobytes()
        self.pieces: dict[tuple[bytes, bool], list[int]] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if not self.adds or not self.adds.search(text):
            return self._plain(text)
        return b"".join(np.array([self.added[part]], "<i4").tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.adds.split(text)))

    def _plain(self, text: str) -> bytes:
        # capitals one by one: a sigma's form does not depend on its place in the word
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words, out = self.words, []
        for word in self.word.findall(plain):
            ids = words.get(word)
            if ids is None:
                ids = np.array(self._word(word.encode()), "<i4").tobytes()
                if len(word) <= REMEMBERED_LENGTH:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def _word(self, word: bytes) -> list[int]:
        joins = self.joins
        cuts = [k for k, (a, b) in enumerate(zip(word, word[1:], strict=False), 1) if not joins[a << 8 | b]]
        if not cuts:
            return self._piece(word, True)
        out, at = [], 0
        for cut in cuts:
            out += self._piece(word[at:cut], False)
            at = cut
        return out + self._piece(word[at:], True)

    def _piece(self, piece: bytes, last: bool) -> list[int]:
        known = self.pieces.get((piece, last))
        if known is not None:
            return known
        parts = [self.characters[b] for b in piece]
        if last:
            parts[-1] += self.end
        if len(parts) > LONG:
            return [self.vocabulary[p] for p in self._merged(parts)]
        rank, never = self.merges.get, len(self.merges)
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            # only the pairs on either side of the merged one are new
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), never)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), never)
        ids = [self.vocabulary[p] for p in parts]
        if len(piece) <= SHORT:  # longer ones hardly come again
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            self.pieces[piece, last] = ids
        return ids

    def _merged(self, parts: list[str]) -> list[str]:
        """The same merges in the same order, the best pair from a heap and the parts in a linked list: a long piece costs n log n."""
        rank, n = self.merges.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapify(heap)
        gone = bytearray(n)
        while heap:
            best, k = heappop(heap)
            second = after[k]
            # a pair that one of its parts has left since
            if gone[k] or second == n or rank((parts[k], parts[second])) != best:
                continue
            parts[k] += parts[second]
            gone[second] = 1
            third = after[k] = after[second]
            if third < n:
                before[third] = k
                if (r := rank((parts[k], parts[third]))) is not None:
                    heappush(heap, (r, k))
            first = before[k]
            if first >= 0 and (r := rank((parts[first], parts[k]))) is not None:
                heappush(heap, (r, first))
        return [part for part, is_gone in zip(parts, gone, strict=True) if not is_gone]

    @property
    def names(self) -> np.ndarray:
        out = np.full(max(self.tokens) + 1, "", object)
        out[list(self.tokens)] = list(self.tokens.values())
        return out


@cache
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _list(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def decoded(ids: pa.Array, path: str) -> pa.Array:
    """The tokens of each list with a space between them, as a vocabulary without a decoder gives them; unknown ids are left out."""
    pairs = byte_pairs(path)
    names = pairs.names
    flat = np.asarray(ids.flatten())
    known = (flat >= 0) & (flat < len(names))
    words = names[np.where(known, flat, 0)]
    words[~known] = ""
    ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
    return pa.array([" ".join(filter(None, words[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def encode_details(insights: DataFrame, tokenizer_path: str, with_decoded: bool = False) -> DataFrame:
    """The token ids of every whole detail of `insights` (insight_id, detail), under the vocabulary file `tokenizer_path`, which every
    executor has: insight_id and token_ids, and with `with_decoded` what the ids decode to, in the same pass.

    One row per input row. A null or empty detail has no ids; strings of added tokens in a detail become those tokens; repeated rows are
    encoded alike; a null id stays null. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer_path)
        for b in A.pieces(batches, "detail", PIECE_BYTES):
            ids = _list([pairs.encode(t or "") for t in b.column("detail").to_pylist()])
            columns = [b.column("insight_id"), ids, *([decoded(ids, tokenizer_path)] if with_decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, ["insight_id", "token_ids", "decoded"][:len(columns)])

    return insights.select("insight_id", "detail").mapInArrow(run, OUT + (", decoded string" if with_decoded else ""))


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The text of each row of token_ids (insight_id, token_ids); null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("token_ids")
            yield pa.RecordBatch.from_arrays([b.column("insight_id"), decoded(ids, tokenizer_path)], ["insight_id", "detail"])

    return encoded.select("insight_id", "token_ids").mapInArrow(run, "insight_id bigint, detail string")
