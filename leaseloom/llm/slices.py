"""What shards send each other: sorted numpy arrays cut into buckets, one row a bucket, so that a shuffle moves whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = "bucket int, shards array<bigint>, counts array<bigint>, records binary, body binary"
_SLICE = pa.schema([("bucket", pa.int32()), ("shards", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                    ("records", pa.binary()), ("body", pa.binary())])
ANSWER = "shard bigint, records binary"
_ANSWER = pa.schema([("shard", pa.int64()), ("records", pa.binary())])
#: Bytes that a task gathers before it sends them on, and bytes of text that a bucket stands for.
HELD_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20


def bucket_count(spark: SparkSession, text_bytes: int) -> int:
    """Buckets for that much text: their size stays, their number grows, and a few go to each shuffle partition."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // BUCKET_BYTES))


class Sender:
    """Gathers (bucket, record, body) of several shards and gives them out by bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, shard: int, key: np.ndarray, records: np.ndarray, body: np.ndarray | None = None, lengths: np.ndarray | None = None) -> None:
        """`key` deals the records out; `body` holds `lengths` bytes for each record, if given."""
        if not len(records):
            return
        bucket = ((key >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        body = np.zeros(0, np.uint8) if body is None else body
        lengths = np.zeros(len(records), np.int64) if lengths is None else lengths
        self.parts.append((shard, bucket, records, body, lengths))
        self.size += records.nbytes + body.nbytes

    def full(self) -> bool:
        return self.size >= HELD_BYTES

    def give(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        shard = np.repeat(np.array([p[0] for p in self.parts]), [len(p[1]) for p in self.parts])
        bucket, records, body, lengths = (np.concatenate([p[k] for p in self.parts]) for k in range(1, 5))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        order = np.argsort(bucket * len(bucket) + np.arange(len(bucket)))
        heads = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0]))
        rows = []
        for at, end in zip(heads, [*heads[1:], len(order)], strict=True):
            own = order[at:end]
            first = np.flatnonzero(np.concatenate([[True], np.diff(shard[own]) != 0]))
            rows.append({
                "bucket": int(bucket[own[0]]), "shards": shard[own[first]].tolist(), "counts": np.diff(np.append(first, len(own))).tolist(),
                "records": records[own].tobytes(), "body": b"".join(body[starts[k]:starts[k] + lengths[k]] for k in own.tolist()) if len(body) else b""})
        yield pa.RecordBatch.from_pylist(rows, _SLICE)
        self._clear()


def received(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard of each record, the records and their bodies, of all rows of a bucket."""
    rows = table.select(["shards", "counts"]).to_pylist()
    shard = np.concatenate([np.repeat(np.array(r["shards"], np.int64), r["counts"]) for r in rows])
    records = np.frombuffer(b"".join(table.column("records").to_pylist()), dtype)
    return shard, records, np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)


def answers(shard: np.ndarray, records: np.ndarray) -> pa.Table:
    """One row for each shard with its records."""
    if not len(shard):
        return _ANSWER.empty_table()
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
    rows = [{"shard": int(shard[order[at]]), "records": records[order[at:end]].tobytes()}
            for at, end in zip(heads, [*heads[1:], len(order)], strict=True)]
    return pa.Table.from_pylist(rows, _ANSWER)


def with_answers(shards: DataFrame, given: DataFrame) -> DataFrame:
    """Each shard with what it was answered (`answer`: binaries, null where there is none); no more than it had asked for."""
    gathered = given.groupBy("shard").agg(F.collect_list("records").alias("answer"))
    return shards.join(gathered.hint("shuffle_hash"), "shard", "left")
