"""MinHash near-duplicates of insight details: signatures in bands, links confirmed on whole shingle sets, connected components.

A node is a distinct shingle set, named by its smallest insight id and its key, so copies never meet in pairs. Sets that share a band form
stars around the smallest node, first within a task, then across tasks. Stars are checked by signature and then on the sets. Links
between two leaves of a star can be missing; where the sets that bands bring together are not one component by then, those outside the
main component are compared with all others of their cluster, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from leaseloom.llm import shingles as H
from leaseloom.llm import slices as S
from leaseloom.llm import text_arrays as A
from leaseloom.llm.components import connected_components
from leaseloom.llm.staging import Work, set_aside

#: Links need an intersection of at least so many hundredths of the union.
LEAST_PERCENT = 80
#: Rows of a band: 32 bands of 4 rows miss a link of similarity 0.8 once in 20 million, of 0.85 once in 10 billion.
BAND_ROWS = 4
PIECE_BYTES = 512 << 10
#: Sets outside the main component, and sets of their cluster, that are compared in one task.
OUTSIDERS, MEMBERS = 256, 2048
#: Places that the sets of one cluster are dealt to before they go to their blocks.
SALTS = 64
LAST_ID = (1 << 63) - 1
_STAR = np.dtype([("band", "<u8"), ("node", "V16")])


def node_names(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """16 bytes for each set that sort by id, then by key."""
    out = np.zeros((len(ids), 2), ">u8")
    out[:, 0] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = keys[:, 0]
    return out.view("V16").reshape(-1)


def node_id(node):
    """The smallest insight id of the set that a node names."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


def _binaries(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in A.pieces(batches, "detail", PIECE_BYTES):
        hashes, offsets = H.shingle_sets(*A.utf8(b.column("detail")))
        yield pa.RecordBatch.from_arrays(
            [b.column("insight_id"), b.column("place"), pa.array(np.diff(offsets)), _binaries(H.set_keys(hashes, offsets)),
             _binaries(H.signatures(hashes, offsets))], ["insight_id", "place", "n_shingles", "set_key", "signature"])


def _signature_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    signature = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, H.SIGNATURE)
    keys = np.frombuffer(b"".join(b.column("set_key").to_pylist()), np.uint64).reshape(-1, 2)
    return signature, node_names(b.column("place").to_numpy(), keys)


def _stars(band: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For equal bands the smallest node and the others: the bands, their smallest nodes, and the pairs (smallest, other)."""
    name = node.view(">u8").reshape(-1, 2)
    order = np.lexsort((name[:, 1], name[:, 0], band))
    heads = np.flatnonzero(np.concatenate([[True], band[order][1:] != band[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    hub = np.repeat(node[order[heads]], np.diff(np.append(heads, len(order))))
    leaf = node[order]
    other = np.ones(len(order), bool)
    other[heads] = False
    other &= (hub.view(">u8").reshape(-1, 2) != leaf.view(">u8").reshape(-1, 2)).any(1)
    return band[order[heads]], node[order[heads]], hub[other], leaf[other]


def _pairs(hub: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.concatenate([hub.view("u1").reshape(-1, 16), leaf.view("u1").reshape(-1, 16)], 1), axis=0)
    return pa.RecordBatch.from_arrays([_binaries(both[:, :16]), _binaries(both[:, 16:])], ["a", "b"])


def _band_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The stars of a task's own sets, some thousand sets at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            signature, node = _signature_rows(b.slice(at, 1024))
            bands = H.band_keys(signature, BAND_ROWS)
            held.append((bands.reshape(-1), np.repeat(node, bands.shape[1])))
            size += bands.size
            if size >= 1 << 18:
                yield _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _own_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, hub, leaf in _band_groups(batches):
        yield _pairs(hub, leaf)


def _send_hubs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = S.Sender(buckets)
        for band, node, _, _ in _band_groups(batches):
            records = np.zeros(len(band), _STAR)
            records["band"], records["node"] = band, node
            sender.add(0, band, records)
            if sender.full():
                yield from sender.give()
        yield from sender.give()

    return run


def _hub_stars(table: pa.Table) -> pa.Table:
    _, records, _ = S.received(table, _STAR)
    _, _, hub, leaf = _stars(np.ascontiguousarray(records["band"]), np.ascontiguousarray(records["node"]))
    return pa.Table.from_batches([_pairs(hub, leaf)])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of the insights that name a node, sorted, with their signatures."""
    for b in A.pieces(batches, "detail", PIECE_BYTES):
        hashes, offsets = H.shingle_sets(*A.utf8(b.column("detail")))
        node = node_names(b.column("place").to_numpy(), H.set_keys(hashes, offsets)).view("u1").reshape(-1, 16)
        sets = [np.sort(hashes[s:e]).tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([_binaries(node), _binaries(H.signatures(hashes, offsets)), pa.array(sets, pa.binary())],
                                         ["node", "signature", "shingles"])


def least_matches(percent: int) -> int:
    """Signature rows that a pair of this similarity agrees in, less seven standard deviations: no link is lost below it."""
    p = percent / 100
    return max(0, math.floor(H.SIGNATURE * p - 7 * math.sqrt(H.SIGNATURE * p * (1 - p))))


def _check(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, y = (np.frombuffer(b"".join(part.column(f"signature_{e}").to_pylist()), np.uint32).reshape(-1, H.SIGNATURE) for e in "ab")
                alike[at:at + 1024] = (x == y).sum(1) >= least_matches(percent)
            for k in np.flatnonzero(alike).tolist():
                x, y = (np.frombuffer(b.column(f"shingles_{e}")[k].as_py(), np.uint64) for e in "ab")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield b.select(["a", "b"]).filter(pa.array(alike))

    return run


def _compare_block(percent: int):
    """Links between outsiders and members of other components, one for each pair of components."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["label", "outside", "shingles"]).to_pylist()
        outside = [r for r in rows if r["outside"]]
        members = [r for r in rows if not r["outside"]]
        found: set[tuple[bytes, bytes]] = set()
        if outside and members:
            sizes = np.array([len(r["shingles"]) // 8 for r in outside])
            hashes = np.frombuffer(b"".join(r["shingles"] for r in outside), np.uint64)
            owner = np.repeat(np.arange(len(outside)), sizes)
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            for m in members:
                own = np.frombuffer(m["shingles"], np.uint64)
                low = np.searchsorted(hashes, own, "left")
                hit = owner[A.ranges(low, np.searchsorted(hashes, own, "right") - low)]
                shared = np.bincount(hit, minlength=len(outside))
                for k in np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared)).tolist():
                    if outside[k]["label"] != m["label"]:
                        found.add(tuple(sorted((outside[k]["label"], m["label"]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return run


def _left_over(sets: DataFrame, clusters: DataFrame, labels: DataFrame, percent: int, outsiders: int, members: int) -> DataFrame:
    """Links (a, b) between components of one cluster that no star has tried. `sets`: node, shingles; `clusters` and `labels`: node and
    the cluster, or component so far, that it belongs to."""
    placed = (
        sets.join(clusters.withColumnRenamed("component", "cluster"), "node", "left").join(labels.withColumnRenamed("component", "label"), "node", "left")
        .select("node", "shingles", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("label", "node").alias("label"))
    )
    size = placed.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    state = size.groupBy("cluster").agg(
        F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")
    ).filter("labels > 1 and n > 2").select(
        "cluster", F.col("main.label").alias("main"), F.ceil(F.col("n") / members).cast("int").alias("member_blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / outsiders).cast("int").alias("outside_blocks"))
    # a cluster may hold a third of all sets: its rows meet its state in SALTS places
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    open_ = salted.join(state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cluster", "salt"])
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = open_.filter("label <> main").select(
        "cluster", "label", "shingles", F.lit(True).alias("outside"), block(F.col("outside_blocks")).alias("ob"), every("member_blocks").alias("mb"))
    among = open_.select(
        "cluster", "label", "shingles", F.lit(False).alias("outside"), block(F.col("member_blocks")).alias("mb"), every("outside_blocks").alias("ob"))
    return asked.unionByName(among).groupBy("cluster", "ob", "mb").applyInArrow(_compare_block(percent), "a binary, b binary")


def _grouped(insights: DataFrame, work: Work, least_percent: int, outsiders: int, members: int) -> tuple[DataFrame, DataFrame]:
    """The features of the rows, and for each distinct set the smallest place of its component and whether it is its first node."""
    rows = insights.select("insight_id", F.coalesce("insight_id", F.lit(LAST_ID)).alias("place"), "detail")
    features = work.kept("features", rows.mapInArrow(
        _features, "insight_id bigint, place bigint, n_shingles bigint, set_key binary, signature binary"))
    sets = work.stored("sets", features.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("place").alias("place"), F.first("signature").alias("signature")))
    pair = "a binary, b binary"
    buckets = S.bucket_count(insights.sparkSession, sets.count() * H.SIGNATURE)
    stars = work.stored("stars", sets.mapInArrow(_own_stars, pair).unionByName(
        sets.mapInArrow(_send_hubs(buckets), S.SLICE).groupBy("bucket").applyInArrow(_hub_stars, pair)).distinct())
    nodes = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = work.stored("full", rows.join(nodes.select(node_id(F.col("node")).alias("place")).distinct(), "place", "left_semi").select("place", "detail")
                       .mapInArrow(_full_sets, "node binary, signature binary, shingles binary")
                       .join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    end = lambda e: full.select(F.col("node").alias(e), F.col("signature").alias(f"signature_{e}"), F.col("shingles").alias(f"shingles_{e}"))
    links = work.stored("links", stars.join(end("a"), "a").join(end("b"), "b").mapInArrow(_check(least_percent), pair))
    labels = connected_components(links, work, "labels")
    clusters = connected_components(stars, work, "clusters")
    more = work.stored("more", _left_over(full.select("node", "shingles"), clusters, labels, least_percent, outsiders, members))
    joined = connected_components(more, work, "joined")
    node = sets.select("set_key", "place").mapInArrow(_named, "set_key binary, node binary")
    label = node.join(labels.withColumnRenamed("component", "label"), "node", "left").select(
        "set_key", F.col("node").alias("own"), F.coalesce("label", "node").alias("node"))
    first = F.coalesce("component", "node")
    return features.drop("signature"), work.kept("result", label.join(joined, "node", "left").select(
        "set_key", node_id(first).alias("smallest"), (F.col("own") == first).alias("is_first")))


def near_duplicates(insights: DataFrame, least_percent: int = LEAST_PERCENT, outsiders: int = OUTSIDERS, members: int = MEMBERS) -> DataFrame:
    """Group the whole details of `insights` (insight_id, detail) by near-equality of their sets of five-word shingles.

    Two insights are linked when 100 times the size of the intersection is at least `least_percent` times that of the union. One row per
    input row: insight_id, n_shingles, component_id (the smallest insight_id reachable, its own included) and kept (it is that one).
    Fewer than five words make one shingle; without words, or with a null detail, an insight has none and is linked with nothing. Rows
    with equal details have one set. A null id comes after all others. Other columns are ignored."""
    with Work(insights.sparkSession) as work:
        features, result = _grouped(insights, work, least_percent, outsiders, members)
    smallest = F.coalesce("smallest", "place")
    return features.join(result, "set_key", "left").select(
        "insight_id", "n_shingles", F.when(smallest != LAST_ID, smallest).alias("component_id"), (F.col("place") == smallest).alias("kept"))


def one_of_each(insights: DataFrame, least_percent: int = LEAST_PERCENT, outsiders: int = OUTSIDERS, members: int = MEMBERS) -> DataFrame:
    """The rows of `insights` (insight_id, detail and any other columns) with one row of each group of near-duplicates: the one with the
    smallest insight_id, of rows with that id one. Rows without words all stay."""
    with Work(insights.sparkSession) as work:
        _, result = _grouped(insights, work, least_percent, outsiders, members)
        work.delete("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches, "detail", PIECE_BYTES):
            hashes, offsets = H.shingle_sets(*A.utf8(b.column("detail")))
            key = pa.array([k if n else None for k, n in zip(_binaries(H.set_keys(hashes, offsets)).to_pylist(), np.diff(offsets), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, key], [*b.schema.names, "_set_key"])

    insights, back = set_aside(insights, {"_set_key", "_place"})
    own = insights.columns
    keyed = insights.mapInArrow(run, StructType([*insights.schema.fields, StructField("_set_key", BinaryType())])).withColumn(
        "_place", F.coalesce("insight_id", F.lit(LAST_ID)))
    first = result.filter("is_first").select(F.col("set_key").alias("_set_key"), F.col("smallest").alias("_place"))
    chosen = keyed.join(first, ["_set_key", "_place"], "left_semi").dropDuplicates(["_set_key", "_place"])
    return chosen.unionByName(keyed.filter("_set_key is null")).select(*own).withColumnsRenamed(back)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column("set_key").to_pylist()), np.uint64).reshape(-1, 2)
        node = node_names(b.column("place").to_numpy(), keys).view("u1").reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([b.column("set_key"), _binaries(node)], ["set_key", "node"])
