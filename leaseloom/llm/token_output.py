"""Insight details as files of token ids: one stream in the order of the ids, range coded in pages of independent blocks.

A page is a row of a Parquet file: the insights it holds, the ids before it in its part, and a payload. The payload is `TOK1`, the block
length, the number of ids and of blocks and a flag for ids of 2^16 and more (five little-endian 32-bit numbers), then for each block
its size and the CRC-32 of its ids, then the blocks. Spark commits files task by task, so a lost executor leaves no half page."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leaseloom.llm import text_arrays as A
from leaseloom.llm.bpe import byte_characters
from leaseloom.llm.range_coder import BLOCK_IDS, LANES, decode_blocks, encode_blocks

#: Ids of a page, at most, but for an insight that is longer alone.
PAGE_IDS = BLOCK_IDS * LANES
PIECE_BYTES = 4 << 20
#: Pieces of text whose ids a task remembers before it starts afresh; it bounds memory only.
REMEMBERED = 1_000_000
#: New pieces encoded at once, and plain ones.
JOINED, JOINED_PLAIN = 1000, 200
PAGE = "part int, page int, before bigint, n_ids bigint, insight_ids array<bigint>, lengths array<bigint>, payload binary"
_PAGE = pa.schema([("part", pa.int32()), ("page", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                   ("insight_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
#: Two characters of white space in a row, as Python knows it, for Arrow.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_CUT = re.compile(r"(?<=\S) (?=\S)")
# plain pieces: Latin letters, single marks and line ends between them
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ",.;:?!"
_PLAIN = f"\\A[{_LETTERS}]+(?:(?:[{_MARKS}]\n?|\n)[{_LETTERS}]+)*[{_MARKS}]?\\z"


def _parts_plain(spec: dict) -> bool:
    """Whether the parts the vocabulary's own rule cuts plain pieces into are those its tokens keep apart anyway: no token of the bytes of
    plain pieces holds two kinds of characters, but for a space before others."""
    model, steps = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
        return False
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    shown = byte_characters()
    kinds = {shown[b]: "l" for b in range(256) if chr(b).isascii() and chr(b).isalpha() or 0x80 <= b < 0xC0 or 0xC3 <= b < 0xCA}
    kinds |= {shown[ord(c)]: "m" for c in _MARKS} | {shown[10]: "n", shown[32]: "s"}
    for token in model["vocab"]:
        found = [kinds.get(c) for c in token]
        if None not in found and any(a != b and (k or a != "s") for k, (a, b) in enumerate(zip(found, found[1:], strict=False))):
            return False
    return True


class _Encoder:
    """The tokenizers library over pieces of text, the ids of which are remembered. A space between two other characters always begins a
    new piece, which holds it; only there is a text cut. New pieces are encoded many at a time, one after the other as a text, and told
    apart by the bytes of their tokens. Plain ones go to the library's model without its rule for cutting texts, where that changes nothing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        def tokenizer() -> Tokenizer:
            found = Tokenizer.from_file(path)
            found.no_truncation()
            found.no_padding()
            return found

        self.tokenizer, self.uncut = tokenizer(), tokenizer()
        self.uncut.pre_tokenizer = pre_tokenizers.Sequence([])
        with open(path, encoding="utf-8") as f:
            self.plain = _parts_plain(json.load(f))
        self.shown = dict(enumerate(byte_characters()))
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each token: a character of a vocabulary entry is a byte, an added token is its own text.
        self.sizes = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.sizes[i] = len(name.encode()) if name in added else len(name)
        self._forget()

    def _forget(self) -> None:
        self.first: dict[str, int] = {}  # pieces that begin a text
        self.later: dict[str, int] = {}  # pieces after a space, which is left out here
        #: Ids of the pieces in the order of their numbers, and where those of a piece end.
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, known: dict[str, int], pieces: list[str], ids: list[np.ndarray], counts: np.ndarray) -> None:
        known.update(zip(pieces, range(len(self.ends) - 1, len(self.ends) - 1 + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _learn(self, known: dict[str, int], new: list[str], texts: list[str]) -> None:
        found = [np.array(f.ids, np.int32) for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(known, new, found, np.array([len(f) for f in found], np.int64))

    def _learn_joined(self, new: list[str], joined: int, plain: bool) -> None:
        texts = [" " + " ".join(new[at:at + joined]) for at in range(0, len(new), joined)]
        if plain:
            texts = [text.encode().decode("latin-1").translate(self.shown) for text in texts]
        # one text at a time for the other pieces, which the library cuts with copies of its own
        batches = [texts] if plain else [[text] for text in texts]
        used = self.uncut if plain else self.tokenizer
        ids = np.concatenate([np.array(f.ids, np.int32) for batch in batches for f in used.encode_batch_fast(batch, add_special_tokens=False)])
        ends = np.cumsum(pc.binary_length(pa.array(new, pa.string())).to_numpy().astype(np.int64) + 1)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        self._add(self.later, new, [ids], np.diff(cuts, prepend=0))

    def _learn_later(self, new: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(new, pa.string()), _PLAIN).to_pylist() if self.plain else [False] * len(new)
        others = [p for p, is_plain in zip(new, plain, strict=True) if not is_plain]
        if len(others) < len(new):
            self._learn_joined([p for p, is_plain in zip(new, plain, strict=True) if is_plain], JOINED_PLAIN, True)
        inner = [p for p in others if p and not p[0].isspace() and not p[-1].isspace()]
        if inner:
            self._learn_joined(inner, JOINED, False)
        rest = list(set(others).difference(inner))
        if rest:
            self._learn(self.later, rest, [" " + p for p in rest])

    def encode(self, texts: pa.Array) -> list[bytes]:
        if len(self.first) + len(self.later) > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        white = pc.match_substring_regex(texts, _WHITE).to_numpy(zero_copy_only=False)
        kept = [[*range(len(texts))]] if not white.any() else [np.flatnonzero(~white).tolist(), np.flatnonzero(white).tolist()]
        out: list[bytes] = [b""] * len(texts)
        for k, rows in enumerate(kept):
            if not rows:
                continue
            own = texts.take(pa.array(rows)) if len(rows) < len(texts) else texts
            cut = pa.array([_CUT.split(t) for t in own.to_pylist()], pa.list_(pa.string())) if k else pc.split_pattern(own, " ")
            lengths = cut.value_lengths().to_numpy()
            ends = np.cumsum(lengths.astype(np.int64))
            pieces = cut.flatten()
            coded = pieces.dictionary_encode()
            names, heads = coded.dictionary.to_pylist(), pieces.take(pa.array(ends - lengths)).to_pylist()
            known = list(map(self.later.get, names))
            new = [p for p, number in zip(names, known, strict=True) if number is None]
            if new:
                self._learn_later(new)
                known = [self.later[p] if number is None else number for p, number in zip(names, known, strict=True)]
            new = list(set(heads).difference(self.first))
            if new:
                self._learn(self.first, new, new)
            numbers = np.array(known, np.int64)[coded.indices.to_numpy()]
            numbers[ends - lengths] = [self.first[p] for p in heads]
            taken = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.ids)).take(pa.array(numbers))
            raw = taken.flatten().to_numpy().astype("<i4", copy=False).tobytes()
            upto = 4 * taken.offsets.to_numpy()[ends].astype(np.int64)
            for row, a, b in zip(rows, [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
                out[row] = raw[a:b]
        return out


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def payload(ids: np.ndarray, length: int = BLOCK_IDS) -> bytes:
    blocks, sums = encode_blocks(ids, length)
    head = struct.pack("<4s5I", b"TOK1", length, len(ids), len(blocks), int((ids > 0xFFFF).any()), 0)
    return head + np.array([[len(b), s] for b, s in zip(blocks, sums, strict=True)], "<u4").tobytes() + b"".join(blocks)


def payload_ids(data: bytes) -> np.ndarray:
    """The ids of a payload; a damaged block is an error."""
    mark, length, total, count, wide, _ = struct.unpack_from("<4s5I", data)
    if mark != b"TOK1":
        raise ValueError("not a payload of token ids")
    table = np.frombuffer(data, "<u4", 2 * count, 24).reshape(count, 2)
    ends = 24 + 8 * count + np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
    blocks = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return decode_blocks(blocks, table[:, 1].tolist(), total, bool(wide), length)


def _pages(tokenizer_path: str, end_id: int, page_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, page, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        owners: list[int | None] = []
        held = 0
        end = np.array([end_id], "<i4").tobytes()

        def full() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(ids), np.int32)
            return pa.RecordBatch.from_pylist([{
                "part": part, "page": page, "before": before, "n_ids": len(stream), "insight_ids": owners,
                "lengths": [len(x) // 4 for x in ids], "payload": payload(stream)}], _PAGE)

        for b in A.pieces(batches, "detail", PIECE_BYTES):
            found = _encoder(tokenizer_path).encode(b.column("detail"))
            for owner, own in zip(b.column("insight_id").to_pylist(), found, strict=True):
                own += end
                if ids and held + len(own) // 4 > page_ids:
                    yield full()
                    page, before, ids, owners, held = page + 1, before + held, [], [], 0
                ids.append(own)
                owners.append(owner)
                held += len(own) // 4
        if ids:
            yield full()

    return run


def write_token_files(insights: DataFrame, path: str, tokenizer_path: str, end_id: int, page_ids: int = PAGE_IDS) -> None:
    """Encode every whole detail of `insights` (insight_id, detail), append `end_id`, and write the ids under `path` in ascending order of
    insight_id.

    The vocabulary file `tokenizer_path` is on every executor. A null or empty detail is `end_id` alone. Null ids come first; rows of one
    id stand in the order of their details. Other columns are ignored; no rows give no pages."""
    parts = int(insights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = insights.select("insight_id", "detail").repartitionByRange(parts, "insight_id").sortWithinPartitions("insight_id", "detail")
    ordered.mapInArrow(_pages(tokenizer_path, end_id, page_ids), PAGE).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The insights of token files: insight_id, start (ids of all insights before it), n_tokens (its end id included), ids_crc32 (of its ids
    as little-endian unsigned 32-bit integers) and, unless left out, token_ids."""
    pages = spark.read.schema(PAGE).parquet(path)
    # one row for each part, and a part is a task of the writer
    sizes = pages.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    based = pages.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "insight_ids", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = payload_ids(b.column("payload")[k].as_py())
                lengths = b.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [b.column("insight_ids")[k].values, pa.array(b.column("start")[k].as_py() + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, ["insight_id", "start", "n_tokens", "ids_crc32", "token_ids"][:len(columns)])

    return based.mapInArrow(run, "insight_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", token_ids array<int>" if with_ids else ""))
