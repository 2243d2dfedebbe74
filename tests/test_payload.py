import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from leaseloom.operators import evidence as E
from leaseloom.operators import payload as P
from leaseloom.operators import pieces
from leaseloom.plans import catalog, queries_payload  # noqa: F401
from leaseloom.sources.folders import shared_folder
from leaseloom.sources.versions import Store, replace_snapshot_insights


@pytest.fixture(scope="module")
def ctx(spark):
    return catalog.context(spark, "/root/testdata/sf0.01")


def test_documents_have_the_announced_length_and_parse(ctx):
    for parts, expected in (
        (P.asset_chunks(ctx.sections), P.ASSET_PARTS),
        (P.reduce_chunk(ctx.sections, ctx.sections["assets"].select("snapshot_id", "asset_key", F.lit("headline").alias("headline"))), P.REDUCE_PARTS),
    ):
        fit = P.chunk_fit(P.chunk_sizes(parts, expected), num_ctx=10**6)
        lengths = {(r.snapshot_id, r.chunk): r.length for r in fit.collect()}
        documents = P.assemble_chunks(parts, fit, expected).collect()
        assert len(documents) == len(lengths) > 0
        for d in documents:
            assert len(d.document) == lengths[d.snapshot_id, d.chunk]
            loaded = json.loads(d.document)
            assert json.dumps(loaded, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == d.document
            assert set(loaded) == set(expected)


def test_large_chunks_are_refused_not_cut(ctx):
    parts = P.asset_chunks(ctx.sections)
    fit = P.chunk_fit(P.chunk_sizes(parts, P.ASSET_PARTS), num_ctx=1500)
    verdicts = {r.fits for r in fit.collect()}
    assert verdicts == {True, False}
    made = P.assemble_chunks(parts, fit, P.ASSET_PARTS).collect()
    assert len(made) == fit.count()
    refused = [r for r in made if r.document is None]
    assert len(refused) == fit.filter("not fits").count() > 0
    assert all(r.needed > r.num_ctx == 1500 and str(r.needed) in r.reason for r in refused)
    assert all(r.reason is None for r in made if r.document is not None)


def test_verdicts_count_refused_documents(spark, sf_dir):
    ctx = catalog.context(spark, sf_dir)

    def documents(sections):
        parts = P.asset_chunks(sections)
        return {(r.snapshot_id, r.chunk): r.document for r in P.assemble_chunks(parts, P.chunk_fit(P.chunk_sizes(parts, P.ASSET_PARTS), num_ctx=10**6), P.ASSET_PARTS).collect()}

    (snapshot, chunk), document = min(documents(ctx.sections).items())
    other = max(c for s, c in documents(ctx.sections) if s == snapshot and c != chunk)
    label, key = F.col("asset_label"), F.concat(F.lit("map:"), F.col("asset_key"))
    # one document of 1539 tokens, so of 2000.7 with headroom, and a large one
    padded = F.when((F.col("snapshot_id") == snapshot) & (key == chunk), F.concat(label, F.repeat(F.lit("x"), 4 * 1539 - len(document)))).when(
        (F.col("snapshot_id") == snapshot) & (key == other), F.repeat(F.lit("x"), 9000)).otherwise(label)
    sections = {**ctx.sections, "assets": ctx.sections["assets"].withColumn("asset_label", padded)}
    fits = {k: max(1, len(d) // 4) * 1.3 <= 2000 for k, d in documents(sections).items()}
    assert not fits[snapshot, chunk] and not fits[snapshot, other] and any(fits.values())
    entry = catalog.ENTRIES["i3_asset_document_verdicts"]
    got = catalog.present(entry.build(SimpleNamespace(sections=sections)), entry.columns).collect()
    assert {(r.snapshot_id, r.chunk): (r.refused, r.made, r.num_ctx) for r in got} == {k: (int(not f), int(f), 2000) for k, f in fits.items()}
    assert len(got) == len(fits)


def test_fingerprint_follows_every_figure(ctx):
    def hashes(paths):
        return {r.snapshot_id: r.payload_sha256 for r in P.fingerprint(paths).collect()}

    before = hashes(ctx.paths)
    assert hashes(ctx.paths.repartition(17)) == before
    changed = hashes(ctx.paths.withColumn("raw", F.when((F.col("snapshot_id") == 1998) & (F.col("path") == "$.portfolio.units"), "1").otherwise(F.col("raw"))))
    assert {k for k in before if before[k] != changed[k]} == {1998}


def test_targets_and_evidence(spark, ctx):
    schema = ("insight_id bigint, snapshot_id int, scope string, property_code string, asset_key string, "
              "evidence array<struct<metric:string,value:string,comparison:string>>")
    paths = spark.createDataFrame([(1, "$.a", "96.00", "96")], "snapshot_id int, path string, raw string, value string")
    ok, bad = [("m", "96%", None)], [("m", "96.00", None), ("m", "7", None)]
    rows = spark.createDataFrame([
        (1, 1, "property", "115R", "115", ok), (2, 1, "asset", None, "115r", ok), (3, 1, "property", "115", None, ok), (4, 1, "portfolio", "115r", None, ok),
        (5, 1, "property", "999x", None, bad), (6, 1, "property", "115r", None, bad), (7, 1, "asset", None, None, ok)], schema)
    codes = spark.createDataFrame([("115r",)], "property_code string")
    assets = spark.createDataFrame([("115",)], "asset_key string")
    fixed = E.normalise_target(rows, codes, assets)
    assert {r.insight_id: (r.scope, r.property_code, r.asset_key) for r in fixed.collect()} == {
        1: ("property", "115r", None), 2: ("property", "115r", None), 3: ("asset", None, "115"), 4: ("portfolio", None, None),
        5: ("property", "999x", None), 6: ("property", "115r", None), 7: ("asset", None, None)}
    kept, dropped = E.evidence_gate(fixed, paths, codes, assets)
    assert {r.insight_id for r in kept.collect()} == {1, 2, 3, 4}
    assert {r.insight_id: r.reason for r in dropped.collect()} == {
        5: "property target '999x' does not exist", 6: "evidence value '7' is not in the payload", 7: "scope/target mismatch"}


def test_empty_replacement_is_refused(spark):
    store = Store(spark, shared_folder(spark))
    rows = spark.createDataFrame([(1, 1), (2, 2)], "insight_id bigint, snapshot_id int")
    store.replace("insight", rows, [1, 2])
    store.commit()
    with pytest.raises(ValueError, match="refusing"):
        replace_snapshot_insights(store, rows.filter("false"), 1)
    assert Store(spark, store.path).read("insight").count() == 2
    replace_snapshot_insights(store, rows.filter("false"), 1, allow_empty=True)
    assert [r.insight_id for r in Store(spark, store.path).read("insight").collect()] == [2]


@pytest.mark.parametrize("num_ctx", [700, 2000, 10**6])
def test_pieces_hold_every_row_once_and_fit(ctx, num_ctx):
    parts = P.asset_chunks(ctx.sections)
    made = pieces.split_documents(parts, P.ASSET_PARTS, num_ctx).collect()
    whole = {(r.snapshot_id, r.chunk): json.loads(r.document)
             for r in P.assemble_chunks(parts, P.chunk_fit(P.chunk_sizes(parts, P.ASSET_PARTS), num_ctx=10**6), P.ASSET_PARTS).collect()}
    by_chunk = {}
    for r in sorted(made, key=lambda r: (r.snapshot_id, r.chunk, r.piece)):
        assert r.reason is None and r.tokens == max(1, len(r.document) // 4) and r.tokens * 1.3 <= num_ctx
        by_chunk.setdefault((r.snapshot_id, r.chunk), []).append(json.loads(r.document))
        assert r.piece == len(by_chunk[r.snapshot_id, r.chunk])
    assert by_chunk.keys() == whole.keys()
    assert (max(map(len, by_chunk.values())) > 1) == (num_ctx < 10**6)
    for key, documents in by_chunk.items():
        for name, is_list in P.ASSET_PARTS.items():
            if is_list:
                assert [x for d in documents for x in d[name]] == whole[key][name]
            else:
                assert all(d[name] == whole[key][name] for d in documents)
        assert len(documents) == 1 or all(any(d[n] for n, is_list in P.ASSET_PARTS.items() if is_list) for d in documents)


def test_long_rows_leave_no_empty_piece_and_too_long_ones_are_named(spark):
    row = lambda chunk, part, is_list, seq, size: (1, chunk, part, is_list, seq, "x" * size)
    expected = {"a": False, "l": True}
    rows = [row("c", "a", False, "", 10)] + [row("c", "l", True, f"{k:04d}", 5 + 150 * (k % 7 == 0)) for k in range(100)]
    rows += [row("d", "a", False, "", 10), row("d", "l", True, "1", 500), row("e", "a", False, "", 900), row("f", "a", False, "", 3)]
    parts = spark.createDataFrame(rows, "snapshot_id int, chunk string, part string, is_list boolean, seq string, json string")
    assert pieces.longest_document(130) == 403
    got = pieces.split_documents(parts, expected, 130).collect()
    c = sorted((r.piece, r.pieces, r.document) for r in got if r.chunk == "c")
    assert [p for p, _, _ in c] == list(range(1, len(c) + 1)) and {n for _, n, _ in c} == {len(c)} and all(len(d) <= 403 for _, _, d in c)
    assert sum(d.count("x") for _, _, d in c) == sum(len(r[5]) for r in rows if r[1] == "c") + 10 * (len(c) - 1)
    assert {(r.chunk, r.document, r.pieces) for r in got if r.reason} == {("d", None, 0), ("e", None, 0)}
    assert [(r.piece, r.document) for r in got if r.chunk == "f"] == [(1, '{"a":xxx,"l":[]}')]
    assert pieces.split_documents(parts.limit(0), expected, 130).collect() == []
