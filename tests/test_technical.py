import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import host_of, jaccard, normalize_url, occurrences, page_key, path_of, slug, url_key, word_set
from plumbline.operators import links, market
from plumbline.operators import technical as t


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("url", "host", "path", "page", "key", "norm"), [
    ("HTTPS://WWW.Shop.Example/a/b/?q=1#top", "shop.example", "/a/b/?q=1", "shop.example/a/b?q=1", "shop.example/a/b", "https://www.shop.example/a/b/?q=1"),
    ("http://x.example", "x.example", "", "x.example/", "x.example/", "http://x.example/"),
    ("http://x.example:8080/a/", "x.example", "/a/", "x.example/a", "x.example/a", "http://x.example:8080/a"),
])
def test_url_keys(spark, url, host, path, page, key, norm):
    got = [one(spark, f(F.col("u")), u=url) for f in (host_of, path_of, page_key, url_key, normalize_url)]
    assert got == [host, path, page, key, norm]


def test_text_functions(spark):
    assert one(spark, slug("x"), x=" Über Cool! Things ") == "ber-cool-things"
    assert sorted(one(spark, word_set("x"), x="The cat's the dog ox")) == ["cat's", "dog", "the"]
    assert one(spark, jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, occurrences(F.col("x"), F.lit("aa")), x="aaaaa") == 2


@pytest.mark.parametrize(("url", "canonicals", "state"), [
    ("https://a.example/p", [], "missing"),
    ("https://a.example/p", ["https://a.example/p/"], "self"),
    ("https://a.example/p", ["https://a.example/p", "https://a.example/q"], "multiple"),
    ("https://a.example/p", ["/p q"], "invalid"),
    ("https://a.example/p", ["http://a.example/p"], "protocol_mismatch"),
    ("https://a.example/p", ["https://www.a.example/p"], "host_variant"),
    ("https://a.example/p", ["https://a.example/q"], "other_page"),
    ("https://a.example/p", ["https://b.example/p"], "cross_domain"),
])
def test_canonical_states(spark, url, canonicals, state):
    assert one(spark, t.canonical_state(F.col("u"), F.col("c")), u=url, c=canonicals) == state


@pytest.mark.parametrize(("a", "b", "kind"), [("http://a.e/x", "http://a.e/x/", "slash"), ("http://a.e/x", "https://a.e/x", "protocol"), ("https://a.e/x", "https://www.a.e/x", "www"), ("https://a.e/x", "https://a.e/y", "other")])
def test_redirect_kinds(spark, a, b, kind):
    assert one(spark, t.redirect_kind(F.col("a"), F.col("b")), a=a, b=b) == kind


def test_fetch_kinds(spark):
    df = spark.createDataFrame([(200,), (301,), (404,), (410,), (429,), (403,), (503,), (418,), (None,)], "status int")
    assert [r.k for r in df.select(links.fetch_kind().alias("k")).collect()] == ["ok", "redirect", "broken", "broken", "rate_limited", "restricted", "server_error", "broken", "unreachable"]


def test_robots(spark):
    text = "User-agent: a\nUser-agent: b\nDisallow: /x # note\nAllow: /x/open\n\nUser-agent: *\nDisallow: /*.pdf\nDisallow:\nSitemap: https://s.example/s.xml"
    rules = t.parse_robots(spark.createDataFrame([("s", text)], "site string, text string"))
    assert {(r.agent, r.pattern, r.allow) for r in rules.collect()} == {("a", "/x", False), ("a", "/x/open", True), ("b", "/x", False), ("b", "/x/open", True), ("*", "/*.pdf", False)}
    urls = spark.createDataFrame([("s", "/x/1"), ("s", "/x/open/1"), ("s", "/f.pdf"), ("s", "/"), ("other", "/x")], "site string, path string")
    for agent, blocked in (("a", {"/x/1"}), ("zzz", {"/f.pdf"})):
        got = t.robots_allowed(urls, rules, agent)
        assert {r.path for r in got.collect() if not r.allowed} == blocked


def test_redirect_chains(spark):
    r = "array<struct<status:int,`from`:string,`to`:string>>"
    rows = [("u", [(301, "https://a/1", "http://a/2"), (301, "http://a/2", "https://a/3")]), ("v", [(301, "https://a/1", "https://a/2"), (301, "https://a/1", "https://a/2")]), ("w", [])]
    got = {x.url: x for x in links.redirect_chains(spark.createDataFrame(rows, f"url string, redirects {r}").withColumn("site_id", F.lit("s"))).collect()}
    assert got["u"].is_chain and got["u"].downgrade and not got["u"].loop and got["u"].chain == "https://a/1 > http://a/2 > https://a/3"
    assert got["v"].loop and "w" not in got


def test_directives_hreflang_types_and_vitals(spark):
    for content, want in (("noindex, follow", (True, False)), ("NONE", (True, True)), (None, (False, False))):
        assert tuple(one(spark, x, c=content) for x in t.directives(F.col("c"))) == want
    assert [one(spark, market.hreflang_ok(F.col("c")), c=c) for c in ("en", "en-GB", "x-default", "zh-Hant-TW", "english", "en_GB")] == [True, True, True, True, False, False]
    html = '<script type="application/ld+json">{"@type": "FAQPage", "x": {"@type": ["Question", "Thing"]}}</script><div itemtype="https://schema.org/Product"><p typeof="schema:Person">'
    assert one(spark, t.structured_types(F.col("h")), h=html) == ["FAQPage", "Question", "Thing", "Product", "Person"]
    assert [one(spark, t.vital_rating("lcp", F.col("v")), v=v) for v in (2500.0, 3000.0, 4001.0)] == ["good", "needs improvement", "poor"]


@pytest.mark.parametrize(("metas", "header", "want"), [
    (["noindex"], None, (True, False, "meta")), ([], "noindex, nofollow", (True, True, "header")), ([], "otherbot: noindex", (False, False, None)),
    (["nofollow"], "googlebot: noindex", (True, True, "header")), (["none"], "otherbot: nofollow, googlebot: noindex", (True, True, "meta")),
])
def test_page_directives(spark, metas, header, want):
    row = spark.createDataFrame([(metas, header)], "m array<string>, h string").select(t.page_directives(F.col("m"), F.col("h")).alias("d")).first().d
    assert (row.noindex, row.nofollow, row.source) == want


def test_whole_sites_kept_out(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /"), ("b", "User-agent: *\nDisallow: /x\nSITEMAP: https://b.example/s.xml")], "site string, text string")
    rules = t.parse_robots(files)
    assert {(r.site, r.blocked) for r in t.blocks_site(files, rules).collect()} == {("a", True), ("b", False)}
    assert [tuple(r) for r in t.robots_sitemaps(files).collect()] == [("b", "https://b.example/s.xml")]
