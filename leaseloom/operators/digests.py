"""A payload's figures as a digest tree: which sections and books changed, not only that something did.

A row's digest is over its figures, a book's over its rows in a section, a branch's over the books whose names hash alike, a section's over its
branches, a snapshot's over its sections. SHA-256 throughout. Branches bound what one node is made of: a few thousand branches a section, and
a few thousandths of the books a branch. A changed figure changes one path, and two trees are compared downwards from what differs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.functions.scalars import normalise_figure
from leaseloom.operators.payload import SECTION_ORDER, row_entries
from leaseloom.operators.scan import cut

LEVELS = ("snapshot", "section", "branch", "book")
NODE = ["snapshot_id", "level", "section", "branch", "book"]
#: Hex digits of a book name's hash that make its branch.
BRANCH_DIGITS = 3


def _book(df: DataFrame, section: str) -> Column:
    """What the rows of a section belong to: their book, their asset, or what they are ordered by."""
    order = SECTION_ORDER[section]
    named = "property_code" if "property_code" in df.columns else order[0] if order else None
    return F.coalesce(F.col(named).cast("string"), F.lit("")) if named else F.lit("")


def _node(name: Column, digest: Column) -> Column:
    """A node's digest: over its children's names and digests, by name."""
    lines = F.sort_array(F.collect_list(F.concat(name, F.lit("="), digest)))
    return F.sha2(F.array_join(lines, "\n"), 256)


def row_digests(sections: Mapping[str, DataFrame]) -> DataFrame:
    """(snapshot_id, section, branch, book, digest) of each row: over its figures' names and normalised values, in column order."""
    frames = []
    for section in SECTION_ORDER:
        df = sections[section]
        figures = F.transform(row_entries(df), lambda e: F.concat(e["leaf"], F.lit("="), normalise_figure(e["raw"])))
        frames.append(df.select("snapshot_id", F.lit(section).alias("section"), _book(df, section).alias("book"),
                                F.sha2(F.array_join(figures, "\n"), 256).alias("digest")))
    rows = reduce(DataFrame.unionByName, frames)
    return rows.withColumn("branch", F.substring(F.sha2("book", 256), 1, BRANCH_DIGITS))


def digest_tree(sections: Mapping[str, DataFrame]) -> DataFrame:
    """The nodes of every snapshot's tree: snapshot_id, level, section, branch, book (null above a node's own level) and digest."""
    none = F.lit(None).cast("string")
    # a book has a row for each month or category at most
    books = row_digests(sections).groupBy("snapshot_id", "section", "branch", "book").agg(_node(F.lit(""), F.col("digest")).alias("digest"))
    branches = books.groupBy("snapshot_id", "section", "branch").agg(_node(F.col("book"), F.col("digest")).alias("digest"))
    per_section = branches.groupBy("snapshot_id", "section").agg(_node(F.col("branch"), F.col("digest")).alias("digest"))
    roots = per_section.groupBy("snapshot_id").agg(_node(F.col("section"), F.col("digest")).alias("digest"))
    levels = {
        "book": books, "branch": branches.withColumn("book", none), "section": per_section.withColumns({"branch": none, "book": none}),
        "snapshot": roots.withColumns({"section": none, "branch": none, "book": none})}
    return reduce(DataFrame.unionByName, [df.select("snapshot_id", F.lit(level).alias("level"), "section", "branch", "book", "digest") for level, df in levels.items()])


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The nodes that two trees do not have in common, with `change`: changed, added or removed. A level is compared only below the nodes that
    differ above it."""
    # both are read level by level
    before, after, found, open_ = cut(before), cut(after), [], None
    for depth, level in enumerate(LEVELS):
        keys = ["snapshot_id", *NODE[2:2 + depth]]
        one, two = (df.filter(F.col("level") == level).select(*keys, F.col("digest").alias(name)) for df, name in ((before, "_was"), (after, "_is")))
        if open_ is not None:
            above = keys[:-1]
            one, two = (df.join(open_.select(*above), above, "left_semi") for df in (one, two))
        differing = one.join(two, keys, "full").filter(~F.col("_was").eqNullSafe(F.col("_is")))
        change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("changed")
        open_ = differing.select(*keys, change.alias("change"))
        found.append(open_.select(
            "snapshot_id", F.lit(level).alias("level"), *[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in NODE[2:]], "change"))
    return reduce(DataFrame.unionByName, found)


def stale_books(before: DataFrame, after: DataFrame) -> DataFrame:
    """The sections and books whose figures are not those of the tree before: snapshot_id, section, book, change."""
    return changed_nodes(before, after).filter("level = 'book'").select("snapshot_id", "section", "book", "change")


def insight_staleness(insights: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """For each insight (insight_id, snapshot_id, scope, property_code, asset_key) the sections that changed under it since the tree before:
    of its book, of its asset, or of any book for one on the portfolio."""
    gone = stale_books(before, after)
    near = (F.col("i.scope") == "portfolio") | (F.col("g.book") == F.coalesce("i.property_code", "i.asset_key"))
    hit = insights.alias("i").join(gone.alias("g"), (F.col("i.snapshot_id") == F.col("g.snapshot_id")) & near)
    sections = hit.groupBy("i.insight_id").agg(F.sort_array(F.collect_set("g.section")).alias("sections"))
    return insights.select("insight_id", "snapshot_id").join(sections, "insight_id", "left").withColumn("stale", F.col("sections").isNotNull())
