"""URL filters with redirect equivalence: a page without a rule of its own takes the decision of the pages it is an alias of.

The lease books have no record with a URL, so this operator is general: it works on pages and links."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaseloom.llm.components import connected_components
from leaseloom.llm.staging import Work

# ---- fixed values: rules (host, path, verdict) ------------------------------
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A canonical link or an immediate refresh in a page's head, and where it leads.
_CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (as `host` and `path` written together) that fits; of equal ones an allow."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _node(host: Column, path: Column) -> Column:
    """Pages that differ in scheme, query, fragment or a last slash are one node; a URL without a host has none."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/$", "")))


def resolved(target: Column, source: Column) -> Column:
    """Where a link on the page `source` leads: an address with `://` as it is; one that begins with `//`, with `/` or with a name under the
    page's scheme, host or folder, dots in it followed; null for an address within the page, of another kind (`mailto:`), or on a page
    whose own url has no `://`."""
    scheme, root = F.regexp_extract(source, r"^(.*?:)//", 1), F.regexp_extract(source, r"^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(target, r"^[^?#]*", 0)
    folder = F.regexp_extract(path_of(source), r"^(.*)/[^/]*$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    # one step after the other: `..` goes back one, `.` stays
    steps = F.aggregate(F.slice(F.split(whole, "/"), 2, 1 << 20), F.lit(""), lambda at, step: F.when(
        step == "..", F.regexp_replace(at, "/[^/]*$", "")).when(step == ".", at).otherwise(F.concat(at, F.lit("/"), step)))
    return (
        F.when(target.contains("://"), target)
        .when(~source.contains("://") | (path == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, target))
        .otherwise(F.concat(root, steps)))


def page_links(pages: DataFrame) -> DataFrame:
    """Links (source, target) from each page's url to its canonical addresses and to where it is sent on, all of a page's tags, resolved
    against the page. `pages`: url, html; a null url or html has none."""
    targets = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(1)))
    links = pages.filter("html is not null and url is not null").select(F.col("url").alias("source"), F.explode(targets).alias("target"))
    return links.select("source", resolved(F.col("target"), F.col("source")).alias("target")).filter("target is not null")


def filter_urls(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge the url of each of `pages` (page_id, url), with `links` (source, target) as redirects and canonical addresses.

    One row per input row: page_id, url, host, path, rule (null if none fits) and verdict. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest decides. A page without a rule takes the decision of its component over the links: allow if
    any alias is allowed by a rule, else block if one is blocked, else allow. Links with a null end or without `://` connect nothing; a
    null url has no host, no path and no alias; repeated rows are judged alike. `rules` are a short list, part of the plan."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_node", _node(F.col("host"), F.col("path"))).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    end = lambda c: _node(host_of(F.col(c)), path_of(F.col(c)))
    with Work(pages.sparkSession) as work:
        edges = work.stored("edges", links.select(end("source").alias("a"), end("target").alias("b"), "source", "target").filter(
            "a is not null and b is not null and a <> b"))
        member = connected_components(edges.select("a", "b"), work, "aliases")
        url = F.explode(F.array("source", "target"))
        decided = judged.select(F.col("_node").alias("node"), F.col("_rule.verdict").alias("verdict")).unionByName(
            edges.select(url.alias("url")).distinct().select(
                _node(host, path).alias("node"), rule_for(host, path, rules)["verdict"].alias("verdict"))
        ).filter("verdict is not null").distinct()
        placed = decided.join(member, "node", "left").select(F.coalesce("component", "node").alias("component"), "verdict")
        # an allow before a block
        decision = placed.groupBy("component").agg(F.min("verdict").alias("_alias_verdict"))
        aliases = work.kept("decisions", member.unionByName(member.select(F.col("component").alias("node"), "component").distinct()).join(
            decision, "component").select(F.col("node").alias("_node"), "_alias_verdict"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.col("_alias_verdict"), F.lit("allow"))
    return judged.join(aliases, "_node", "left").select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
