import duckdb

from leaseloom.llm import oracle
from leaseloom.llm import url_filter as U

PAGES = [
    (1, "http://a.org/x"), (2, "http://b.net/es/q"), (3, "http://c.org/"), (4, "https://c.org?u=1"), (5, None), (6, "junk"), (7, "http://d.org/k"),
    (8, "http://ok.com/z"), (9, "http://b.net/es/q2"), (10, "https://WWW.Example.com/en/1#a?b"), (11, "http://example.com/en/"), (11, "http://example.com/en/"),
    (12, "http://notexample.com/en/"), (13, "http://x.example.com/en"), (14, "a://b://c.net/fr/"), (15, "http://n.net"), (None, "http://m.net/fr/é?x")]
LINKS = [("http://a.org/x", "http://b.net/es/q"), ("http://c.org", "http://a.org/x"), ("http://d.org/k", "http://ok.com/z"),
         ("http://d.org/k", "http://b.net/es/q2"), (None, "x"), ("http://z.org", "http://z.org/"), ("http://n.net", "http://gone.net/fr/")]


def test_rules_aliases_and_precedence(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, url string").selectExpr("*", "'x' as rule", "'y' as node")
    out = U.filter_urls(pages, spark.createDataFrame(LINKS, "source string, target string"))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted([
        (1, "a.org", "/x", None, "block"), (2, "b.net", "/es/q", "net/es/", "block"), (3, "c.org", "/", None, "block"), (4, "c.org", "", None, "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "d.org", "/k", None, "allow"), (8, "ok.com", "/z", "com/", "allow"),
        (9, "b.net", "/es/q2", "net/es/", "block"), (10, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (11, "example.com", "/en/", "example.com/en/", "block"), (11, "example.com", "/en/", "example.com/en/", "block"),
        (12, "notexample.com", "/en/", "com/", "allow"), (13, "x.example.com", "/en", "com/", "allow"), (14, "b:", "//c.net/fr/", None, "allow"),
        (15, "n.net", "", None, "block"), (None, "m.net", "/fr/é", "net/fr/", "block")], key=str)


def test_links_from_pages(spark):
    html = ['<head><link href="https://x.org/1" rel="canonical"><link rel="canonical" href="//y.org/2"></head>', "<LINK rel=canonical href=https://x.org/2>", None, "",
            '<meta http-equiv="refresh" content="0; url=http://y.org/">', '<link rel="stylesheet" href="http://z.org/s.css">', '<link rel="canonical" href="/relative?q">',
            '<link rel="canonical" href="next"><link rel="canonical" href="../up/./x/../y"><link rel="canonical" href="#top"><link rel="canonical" href="mailto:a@b">']
    pages = spark.createDataFrame([(f"http://p.org/d/{k}", h) for k, h in enumerate(html)] + [("junk", html[6]), (None, html[0]), ("http://p.org", html[7])], "url string, html string")
    assert sorted(tuple(r) for r in U.page_links(pages).collect()) == [
        ("http://p.org", "http://p.org/next"), ("http://p.org", "http://p.org/up/y"),
        ("http://p.org/d/0", "http://y.org/2"), ("http://p.org/d/0", "https://x.org/1"), ("http://p.org/d/1", "https://x.org/2"), ("http://p.org/d/4", "http://y.org/"),
        ("http://p.org/d/6", "http://p.org/relative"), ("http://p.org/d/7", "http://p.org/d/next"), ("http://p.org/d/7", "http://p.org/up/y")]


def test_chains_of_pages_against_the_oracle(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    chain = [(k, f"http://chain.org/{k}", link.format(f"/{k + 1}")) for k in range(12)] + [(12, "http://chain.org/12", link.format("http://bad.net/es/1"))]
    more = [(20, "http://b.org/x/y", link.format("../z")), (21, "http://b.org/z", '<meta http-equiv=refresh content="0;url=//ok.com/1">'), (22, "http://b.org/q", link.format("x/y")),
            (23, "http://bad.net/fr/9", link.format("http://b.org/q")), (24, "http://c.org/a", link.format("b") + link.format("//d.net/fr/1")), (25, "http://c.org/b", None),
            (26, None, link.format("/x")), (27, "junk", link.format("/x")), (28, "http://alone.org", ""), (28, "http://alone.org", "")]
    pages = spark.createDataFrame(chain + more, "page_id bigint, url string, html string")
    got = U.filter_urls(pages.select("page_id", "url"), U.page_links(pages)).drop("url").collect()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(oracle.URL_FILTERS).fetchall(), key=str)
    verdicts = {r.page_id: r.verdict for r in got}
    assert {verdicts[k] for k in range(13)} == {"block"} and verdicts[20] == verdicts[21] == verdicts[22] == "allow" and verdicts[23] == "block"
    assert verdicts[24] == verdicts[25] == "block" and verdicts[28] == "allow"


def test_no_pages_and_no_links(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert U.filter_urls(spark.createDataFrame([], "page_id int, url string"), none).collect() == []
    [row] = U.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string"), none).collect()
    assert row.verdict == "allow"
