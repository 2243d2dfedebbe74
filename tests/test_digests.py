"""The digest tree, figures of stored documents, and what they say of an insight."""

import json

import pytest
from pyspark.sql import functions as F

from leaseloom.operators import payload as P
from leaseloom.operators.digests import LEVELS, changed_nodes, digest_tree, insight_staleness, stale_books
from leaseloom.operators.scan import cut
from leaseloom.plans import catalog
from leaseloom.sources import sinks
from leaseloom.sources.documents import stored_payload_paths, variant_paths
from leaseloom.sources.folders import shared_folder


@pytest.fixture(scope="module")
def sections(spark, sf_dir):
    return catalog.context(spark, sf_dir).sections


@pytest.fixture(scope="module")
def tree(sections):
    return cut(digest_tree(sections))


def with_rent(sections, change):
    hit = (F.col("snapshot_id") == 1998) & (F.col("property_code") == "100r")
    return sections | {"properties": sections["properties"].withColumn("market_rent", F.when(hit, change(F.col("market_rent"))).otherwise(F.col("market_rent")))}


def test_one_figure_changes_one_path(sections, tree):
    changed = changed_nodes(tree, digest_tree(with_rent(sections, lambda c: c + 1))).collect()
    assert {(r.snapshot_id, r.level, r.section, r.book, r.change) for r in changed} == {
        (1998, "snapshot", None, None, "changed"), (1998, "section", "properties", None, "changed"), (1998, "branch", "properties", None, "changed"),
        (1998, "book", "properties", "100r", "changed")}
    assert len(changed) == len(LEVELS)
    # the same figure printed another way, and rows that come in another order, change nothing
    same = {name: df.repartition(5) for name, df in with_rent(sections, lambda c: c.cast("decimal(30,4)")).items()}
    assert changed_nodes(tree, digest_tree(same)).isEmpty()


def test_books_that_come_and_go_are_named(sections, tree):
    less = sections | {"expirations": sections["expirations"].filter("property_code <> '100r'"), "assets": sections["assets"].filter("snapshot_id <> 1997")}
    gone = stale_books(tree, digest_tree(less)).collect()
    assert {r.change for r in gone} == {"removed"} and {r.section for r in gone} == {"expirations", "assets"}
    assert {r.book for r in gone if r.section == "expirations"} == {"100r"} and {r.snapshot_id for r in gone if r.section == "assets"} == {1997}
    back = stale_books(digest_tree(less), tree).collect()
    assert {(r.snapshot_id, r.section, r.book) for r in back} == {(r.snapshot_id, r.section, r.book) for r in gone} and {r.change for r in back} == {"added"}


def test_insights_are_stale_by_what_they_are_about(spark, sections, tree):
    insights = spark.createDataFrame(
        [(1, 1998, "property", "100r", None), (2, 1998, "property", "102r", None), (3, 1997, "property", "100r", None), (4, 1998, "portfolio", None, None), (5, 1998, "asset", None, "100")],
        "insight_id bigint, snapshot_id int, scope string, property_code string, asset_key string")
    got = {r.insight_id: (r.stale, r.sections) for r in insight_staleness(insights, tree, digest_tree(with_rent(sections, lambda c: c + 1))).collect()}
    assert got == {1: (True, ["properties"]), 2: (False, None), 3: (False, None), 4: (True, ["properties"]), 5: (False, None)}


def walked(value, path):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in walked(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in walked(v, f"{path}[{k}]")]
    return [] if value is None or isinstance(value, bool) else [(path, str(value))]


def test_scalars_of_any_nesting(spark):
    documents = [{"a": 1, "b": {"c": [1, "x", None, True, {"d": [[], [2.5]]}], "e": {}}}, [], 7, "text", None, [[["deep"]]]]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents)], "id int, doc string")
    got = variant_paths(rows.select("id", F.lit("$").alias("path"), F.parse_json("doc").alias("value")), ["id"]).collect()
    assert sorted(map(tuple, got)) == sorted((k, p, v) for k, d in enumerate(documents) for p, v in walked(d, "$"))
    assert variant_paths(rows.limit(0).select("id", F.lit("$").alias("path"), F.parse_json("doc").alias("value")), ["id"]).collect() == []


def test_stored_payloads_have_the_paths_of_the_payload(spark, sections):
    out = shared_folder(spark)
    sinks.payload_export({n: sections[n] for n in P.SECTION_ORDER}, out)
    want = P.flatten_paths(sections).filter(F.col("section_no").between(1, len(P.SECTION_ORDER))).select("snapshot_id", "path", "value")
    got = stored_payload_paths(spark, out).select("snapshot_id", "path", "value")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
