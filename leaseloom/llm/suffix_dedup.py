"""Suffix-array removal of passages that an earlier insight has already.

Each shard of whole details is sorted by a suffix array; suffixes next to each other that share `min_bytes` bytes begin equal strings,
so a shard knows which of its strings begin in an insight with a smaller id. Across shards, strings are told apart by fingerprints
chosen by content: any `min_bytes` bytes have a smallest fingerprint among their grams, and equal strings have the same one. Shards first
send only fingerprints; those that two shards hold are looked up again, and just the stretches around them are sent, merged by binary
search over sorted strings, and answered with the strings that another shard has in an earlier insight."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.llm import slices as S
from leaseloom.llm import text_arrays as A
from leaseloom.llm.staging import Work, set_aside
from leaseloom.llm.suffix_array import common_prefixes, packed_bytes, suffix_array

MIN_BYTES = 50
#: Bytes of a gram. A string of MIN_BYTES has MIN_BYTES - GRAM_BYTES + 1 of them.
GRAM_BYTES = 24
#: Bytes of details in a shard; a longer detail is a shard of its own.
SHARD_BYTES = 512 << 10
LAST_ID = (1 << 63) - 1

SHARD = ("shard bigint, keys array<binary>, ids array<bigint>, lengths array<bigint>, n_bytes bigint, text binary, repeats binary")
_SHARD = pa.schema([("shard", pa.int64()), ("keys", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    ("n_bytes", pa.int64()), ("text", pa.binary()), ("repeats", pa.binary())])
_STRETCH = np.dtype([("id", "<i8"), ("place", "<u4"), ("windows", "<u4")])
_RUN = np.dtype([("place", "<u4"), ("windows", "<u4")])
RESULT = "text_key binary, first_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def whole_windows(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which places have `size` bytes up to the end of their text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(int(offsets[-1])) + size <= ends


def repeats_in_shard(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Which places begin a string of `size` bytes that also begins in a text of the shard with a smaller id."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < size:
        return out
    packed = packed_bytes(data)
    order, rank = suffix_array(packed, 8)
    new = common_prefixes(packed, order, rank, size) < size
    whole = whole_windows(offsets, size)
    owner = np.where(whole, np.repeat(ids, np.diff(offsets)), LAST_ID)[order]
    heads = np.flatnonzero(new)
    first = np.minimum.reduceat(owner, heads)
    out[order] = owner > np.repeat(first, np.diff(np.append(heads, n)))
    return out & whole


def window_fingerprints(data: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For each place, the smallest hash of the grams in the `size` bytes from there on (of places with so many)."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = A.prefix_hashes(data)
    _, inverse = A._power_tables(n + 1)
    h = A.mix((sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1])
    width, done = size - gram + 1, 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:len(h) - (width - done)], h[width - done:]) if done < width else h


class Shard:
    """A shard read back: bytes, offsets of its texts, ids, and the flags of strings repeated within it."""

    def __init__(self, row: dict):
        self.shard, self.keys, self.ids = row["shard"], row["keys"], np.array(row["ids"], np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["text"]), np.uint8) if row["n_bytes"] else np.zeros(0, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))])
        change = np.zeros(len(self.data) + 1, np.int64)
        runs = np.frombuffer(row["repeats"], _RUN)
        change[runs["place"].astype(np.int64)] += 1
        change[runs["place"].astype(np.int64) + runs["windows"]] -= 1
        self.repeats = np.cumsum(change[:-1]) > 0

    def stretches(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretches of neighbouring strings of a text with one fingerprint, as far as they are not repeats within the shard:
        fingerprint, first place, number of strings."""
        h = window_fingerprints(self.data, size, gram)
        open_ = (whole_windows(self.offsets, size) & ~self.repeats)[:len(h)]
        starts, ends = A.runs(open_, self.offsets[self.offsets <= len(h)])
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        turn = np.flatnonzero((h[1:] != h[:-1]) & open_[1:] & open_[:-1]) + 1
        starts = np.union1d(starts, turn)
        # a stretch ends where the next begins, or where its run ends
        ends = np.minimum(ends[np.searchsorted(ends, starts, "right")], np.append(starts[1:], len(h)))
        return h[starts], starts, ends - starts


def _pack(size: int, shard_bytes: int):
    def shard(rows: list[tuple[bytes, int, bytes]], number: int) -> dict:
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        lengths, ids = np.array([len(r[2]) for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        starts, ends = A.runs(repeats_in_shard(data, offsets, ids, size), offsets)
        runs = np.zeros(len(starts), _RUN)
        runs["place"], runs["windows"] = starts, ends - starts
        return {"shard": number, "keys": [r[0] for r in rows], "ids": ids.tolist(), "lengths": lengths.tolist(), "n_bytes": len(data),
                "text": zstandard.compress(data.tobytes(), 1), "repeats": runs.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for k in range(b.num_rows):
                text = texts[k].as_py()
                if rows and held + len(text) > shard_bytes:
                    yield pa.RecordBatch.from_pylist([shard(rows, number)], _SHARD)
                    number, rows, held = number + 1, [], 0
                rows.append((b.column("text_key")[k].as_py(), b.column("first_id")[k].as_py(), text))
                held += len(text)
        if rows:
            yield pa.RecordBatch.from_pylist([shard(rows, number)], _SHARD)

    return run


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list[bytes]]]:
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield Shard(row), row.get("answer") or []


def _send_fingerprints(size: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = S.Sender(buckets)
        for shard, _ in _each_shard(batches):
            found = np.unique(shard.stretches(size, gram)[0])
            sender.add(shard.shard, found, found)
            if sender.full():
                yield from sender.give()
        yield from sender.give()

    return run


def _common_fingerprints(table: pa.Table) -> pa.Table:
    """Fingerprints that several shards hold, found again in each shard's by binary search."""
    shard, found, _ = S.received(table, np.uint64)
    merged = np.sort(found)
    common = np.unique(merged[1:][merged[1:] == merged[:-1]])
    if not len(common):
        return S.answers(shard[:0], found[:0])
    mine = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return S.answers(shard[mine], found[mine])


def _send_stretches(size: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = S.Sender(buckets)
        for shard, answer in _each_shard(batches):
            wanted = np.sort(np.frombuffer(b"".join(answer), np.uint64))
            if not len(wanted):
                continue
            found, starts, counts = shard.stretches(size, gram)
            hit = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found
            found, starts, counts = found[hit], starts[hit], counts[hit]
            records = np.zeros(len(starts), _STRETCH)
            records["id"] = shard.ids[np.searchsorted(shard.offsets, starts, "right") - 1]
            records["place"], records["windows"] = starts, counts
            lengths = counts + size - 1
            sender.add(shard.shard, found, records, shard.data[A.ranges(starts, lengths)], lengths)
            if sender.full():
                yield from sender.give()
        yield from sender.give()

    return run


def _string_numbers(body: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A number for each string of `size` bytes, equal for equal strings: its hash's place among the sorted distinct hashes, found by
    binary search; where two different strings have one hash, its place among the sorted strings themselves."""
    hashes = A.stretch_hashes(A.prefix_hashes(body), places, places + size)
    merged = np.sort(hashes)
    known = merged[np.concatenate([[True], merged[1:] != merged[:-1]])]
    number = np.searchsorted(known, hashes)
    leader = np.zeros(len(known), np.int64)
    leader[number] = places
    packed = packed_bytes(body)
    for step in [*range(0, size - 7, 8), size - 8]:
        if not np.array_equal(packed[places + step], packed[leader[number] + step]):
            strings = np.ascontiguousarray(body[places[:, None] + np.arange(size)]).view(f"V{size}").reshape(-1)
            return np.unique(strings, return_inverse=True)[1]
    return number


def _merge_stretches(size: int):
    def run(table: pa.Table) -> pa.Table:
        shard, records, body = S.received(table, _STRETCH)
        windows = records["windows"].astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(windows + size - 1)])[:-1]
        places = A.ranges(begins, windows)
        string = _string_numbers(body, places, size)
        ids = np.repeat(records["id"], windows)
        earliest = np.full(int(string.max()) + 1, LAST_ID)
        np.minimum.at(earliest, string, ids)
        starts, ends = A.runs(ids > earliest[string], np.concatenate([[0], np.cumsum(windows)]))
        owner = np.searchsorted(np.cumsum(windows), starts, "right")
        out = np.zeros(len(starts), _RUN)
        out["place"] = records["place"][owner] + (places[starts] - begins[owner]).astype(np.uint32)
        out["windows"] = ends - starts
        return S.answers(shard[owner], out)

    return run


def _judge(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, answer in _each_shard(batches):
            n = len(shard.data)
            change = np.zeros(n + size + 1, np.int64)
            runs = np.frombuffer(b"".join(answer), _RUN)
            own_starts, own_ends = A.runs(shard.repeats, shard.offsets)
            for starts, ends in ((own_starts, own_ends), (runs["place"].astype(np.int64), runs["place"].astype(np.int64) + runs["windows"])):
                np.add.at(change, starts, 1)
                np.add.at(change, ends + size - 1, -1)
            gone = np.cumsum(change[:n]) > 0
            starts, _ = A.runs(gone, shard.offsets)
            kept = [shard.data[a:b][~gone[a:b]].tobytes() for a, b in zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True)]
            columns = [
                pa.array(shard.keys, pa.binary()), pa.array(shard.ids), pa.array(np.diff(shard.offsets)), pa.array(A.by_text(gone, shard.offsets)),
                pa.array(np.bincount(np.searchsorted(shard.offsets, starts, "right") - 1, minlength=len(shard.ids))),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = [x.split()[0] for x in RESULT.split(", ")]
            if with_text:
                columns.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


#: What a row has beside its own columns while it is judged.
_WORK_COLUMNS = {"_order", "_text", "text_key", "first_id", *(c.split()[0] for c in RESULT.split(", ")), "kept"}


def _judged(insights: DataFrame, min_bytes: int, gram_bytes: int, shard_bytes: int, with_text: bool) -> tuple[DataFrame, Column]:
    """The rows with what became of their text (RESULT; the detail itself left out), and which of them are later copies of a whole text."""
    spark = insights.sparkSession
    keyed = insights.withColumn("_order", F.coalesce("insight_id", F.lit(LAST_ID))).withColumn("_text", F.coalesce("detail", F.lit("")))
    keyed = keyed.withColumn("text_key", F.unhex(F.sha2("_text", 256)))
    texts = keyed.groupBy("text_key").agg(F.min("_order").alias("first_id"), F.first("_text").alias("text"))
    with Work(spark) as work:
        shards = work.stored("shards", texts.select("text_key", "first_id", "text").mapInArrow(_pack(min_bytes, shard_bytes), SHARD))
        buckets = S.bucket_count(spark, shards.agg(F.sum("n_bytes").alias("n")).first().n or 0)
        sent = shards.mapInArrow(_send_fingerprints(min_bytes, gram_bytes, buckets), S.SLICE)
        common = work.stored("common", sent.groupBy("bucket").applyInArrow(_common_fingerprints, S.ANSWER))
        sent = S.with_answers(shards, common).mapInArrow(_send_stretches(min_bytes, gram_bytes, buckets), S.SLICE)
        gone = work.stored("gone", sent.groupBy("bucket").applyInArrow(_merge_stretches(min_bytes), S.ANSWER))
        result = work.kept("result", S.with_answers(shards, gone).mapInArrow(
            _judge(min_bytes, with_text), RESULT + (", kept string" if with_text else "")))
    return keyed.drop("detail", "_text").join(result, "text_key"), (F.col("_order") > F.col("first_id")) & (F.col("n_bytes") >= min_bytes)


def repeated_passages(insights: DataFrame, min_bytes: int = MIN_BYTES, gram_bytes: int = GRAM_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What goes from each detail of `insights` (insight_id, detail) when every byte is removed that a string of `min_bytes` bytes covers
    which also begins in an insight with a smaller insight_id. Matches never cross insights; overlapping ones count; all are judged
    on the input.

    One row per input row: insight_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes. A null
    detail is empty; equal ids are not smaller than each other, so their rows keep what they share; a null id comes after all others.
    Other columns are ignored.

    Equal details are one text to begin with: their first insight is judged, the later ones go as a whole if they have `min_bytes`."""
    rows, copy = _judged(insights.select("insight_id", "detail"), min_bytes, gram_bytes, shard_bytes, False)
    return rows.select(
        "insight_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def without_repeats(insights: DataFrame, min_bytes: int = MIN_BYTES, gram_bytes: int = GRAM_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of `insights` (insight_id, detail and any other columns) without those bytes; what is left of a character that was cut
    through goes too, and a null detail comes back empty. No row goes."""
    plain, back = set_aside(insights, _WORK_COLUMNS)
    rows, copy = _judged(plain, min_bytes, gram_bytes, shard_bytes, True)
    return rows.withColumn("detail", F.when(copy, F.lit("")).otherwise(F.col("kept"))).select(*plain.columns).withColumnsRenamed(back)
