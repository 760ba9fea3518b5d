import json


from plumbline.operators import competitors as c
from plumbline.sources import landed as m


def test_serp_payloads(spark):
    body = {"organic_results": [{"position": 3, "title": " A  b ", "link": "https://a.example/x"}, {"title": "ftp", "link": "ftp://no"}, {"title": "B", "link": "http://b.example"}], "related_searches": [{"query": "one two"}, {"query": "x"}, {"query": "one  two"}], "related_questions": [{"question": "why so"}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "not json")], "check_id long, body string")
    assert [tuple(r) for r in m.parse_serp_responses(df).orderBy("rank").collect()] == [(1, 2, "B", "http://b.example"), (1, 3, "A b", "https://a.example/x")]
    assert {(r.kind, r.text) for r in m.parse_serp_related(df).collect()} == {("search", "one two"), ("question", "why so")}


def test_payload_shapes(spark):
    df = spark.createDataFrame([(1, '[{"rank":1,"title":"a","url":"u"}]'), (2, '{"results":[{"rank":2,"title":"b","url":"v"},{"rank":3}]}'), (3, None)], "check_id long, top_results string")
    assert sorted(tuple(r) for r in m.unpack_top(df).collect()) == [(1, 1, "a", "u"), (2, 2, "b", "v")]


def test_files(spark):
    rss = "<rss><item><title><![CDATA[A &amp; b]]></title><link>https://a/1</link><pubDate>x</pubDate></item><item><title>No link</title></item></rss>"
    atom = '<feed><entry><title>C</title><link href="https://c/1"/><updated>2024</updated></entry></feed>'
    feeds = spark.createDataFrame([("s", rss), ("t", atom)], "site string, body string")
    assert sorted(tuple(r) for r in m.parse_feeds(feeds).collect()) == [("s", "A & b", "https://a/1", "x"), ("t", "C", "https://c/1", "2024")]
    maps = spark.createDataFrame([("s", "<urlset><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url></urlset>"), ("i", "<sitemapindex><loc>https://a/s.xml</loc></sitemapindex>"), ("x", "<html>")], "site string, body string")
    assert {tuple(r) for r in m.parse_sitemaps(maps).collect()} == {("s", "https://a/1", False, True, False), ("s", "https://a/2", False, True, False), ("i", "https://a/s.xml", True, True, False), ("x", None, False, False, False)}
    posts = spark.createDataFrame([("s", '[{"link":"https://a/p","date":"2024-01-02T03:04:05","title":{"rendered":"P &amp; q"}},{"link":"x"}]')], "site string, body string")
    assert [tuple(r) for r in m.parse_cms_posts(posts).collect()] == [("s", "P & q", "https://a/p", "2024-01-02")]


def test_xml_files_of_every_kind(spark):
    spaced = '<?xml version="1.0"?>\n<s:urlset xmlns:s="x"><s:url><s:loc> https://a/1?x=1&amp;y </s:loc></s:url><s:url><s:loc><![CDATA[https://a/2]]></s:loc></s:url></s:urlset>'
    cut = "\ufeff<urlset><url><loc>https://a/3</loc></url><url><loc>https://a/4"
    index = "<sitemapindex><sitemap><loc>https://www.a.e/one.xml</loc></sitemap><sitemap><loc>https://b.e/other.xml</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([("s", "a.e", spaced), ("c", "a.e", cut), ("i", "a.e", index), ("n", "a.e", None), ("e", "a.e", "")], "site string, host string, body string")
    got = {tuple(r) for r in m.parse_sitemaps(files).collect()}
    assert got == {("s", "https://a/1?x=1&y", False, True, False), ("s", "https://a/2", False, True, False), ("c", "https://a/3", False, True, True), ("i", "https://www.a.e/one.xml", True, True, True), ("n", None, False, False, False), ("e", None, False, False, False)}
    tree = [("a.e", "https://a.e/i.xml", index.replace("b.e/other", "a.e/i2")), ("a.e", "https://a.e/i2.xml", index.replace("b.e/other", "a.e/gone").replace("www.a.e/one", "a.e/i")), ("a.e", "https://www.a.e/one.xml", spaced), ("a.e", "https://a.e/lost.xml", cut)]
    tree[1] = (tree[1][0], "https://a.e/i2.xml", tree[1][2])
    files = spark.createDataFrame(tree, "site string, url string, body string")
    urls, states = m.sitemap_urls(files, spark.createDataFrame([("a.e", "https://a.e/i.xml"), ("z.e", "https://z.e/none.xml")], "site string, url string"))
    assert {tuple(r) for r in urls.collect()} == {("a.e", "https://a/1?x=1&y", "https://www.a.e/one.xml"), ("a.e", "https://a/2", "https://www.a.e/one.xml")}
    assert {tuple(r) for r in states.collect()} == {("a.e", "https://a.e/i.xml", "read"), ("a.e", "https://a.e/i2.xml", "read"), ("a.e", "https://www.a.e/one.xml", "read"), ("a.e", "https://a.e/gone.xml", "missing"), ("z.e", "https://z.e/none.xml", "missing")}
    feeds = [("r", '<rss xmlns:dc="d"><channel><title>F</title><item><title>A <b>x</b> &amp;amp; y</title><link> https://a/1 </link><pubDate>Mon</pubDate></item><item><title></title><link>https://a/2</link></item></channel></rss>'),
             ("f", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T</title><link rel="self" href="https://a/self"/><link rel="alternate" href="https://a/3"/><updated>2024</updated></entry></feed>'),
             ("x", "<rss><channel><item><title>Whole</title><link>https://a/5</link></item><item><title>Cut")]
    got = {tuple(r) for r in m.parse_feeds(spark.createDataFrame(feeds, "site string, body string")).collect()}
    assert got == {("r", "A x & y", "https://a/1", "Mon"), ("f", "T", "https://a/3", "2024"), ("x", "Whole", "https://a/5", None)}


def test_vitals_and_csv(spark, tmp_path):
    body = {"loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 2600}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12}}}, "lighthouseResult": {"categories": {"performance": {"score": 0.615}}, "audits": {"largest-contentful-paint": {"title": "LCP", "numericValue": 2100.5}, "a": {"title": "A", "details": {"overallSavingsMs": 900}}, "b": {"title": "B", "details": {"overallSavingsMs": 299}}, "c": {"title": "C", "details": {"overallSavingsMs": 1200}}}}}
    r = m.parse_vitals(spark.createDataFrame([("u", "mobile", json.dumps(body))], "url string, strategy string, body string")).first()
    assert (r.score, r.field_lcp, r.field_inp, r.field_cls, r.lab_lcp, r.savings) == (62, 2600.0, None, 0.12, 2100.5, ["C", "A"])
    rows = spark.createDataFrame([('say "hi", you', 1, 2, 0.1234, 3.25, None)], "query string, clicks long, impressions long, ctr double, position double, top_page string").coalesce(1)
    m.write_query_csv(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.splitlines()[0] == "query,clicks,impressions,ctr,position,top_page" and text.splitlines()[1].startswith('"say ""hi"", you",1,2,12.34%,3.')


def test_clusters_and_phrases(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in c.connected(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    shape = "site_id string, page_id long, phrase string, score long, in_title boolean, in_h1 boolean"
    rows = [("s", 1, "red boots", 6, True, False), ("s", 2, "soft boots", 5, True, False), ("s", 2, "blue sea", 9, False, False), ("s", 3, "the red sea", 1, True, True)]
    rows += [("s", k, "services", 4, True, False) for k in range(1, 7)] + [("s", k, "services list", 1, False, False) for k in (1, 2)] + [("t", 9, "red boots", 1, True, False)]
    cands = spark.createDataFrame(rows, shape)
    got = c.keyword_clusters(cands, spark.createDataFrame([("s", 6), ("t", 1)], "site_id string, site_pages long"))
    # "red" and "sea" are too short to link, "services" stands on too many pages
    assert {(r.site_id, r.cluster, r.phrase, r.links_pages) for r in got.collect()} == {("s", "red boots", "red boots", True), ("s", "red boots", "soft boots", True), ("s", "blue sea", "blue sea", True), ("s", "the red sea", "the red sea", True), ("s", "services", "services", False), ("s", "services list", "services list", True), ("t", "red boots", "red boots", True)}
    assert [tuple(r) for r in c.cannibalization(cands, got).collect()] == [("s", "red boots", 2)]
    heads = spark.createDataFrame([("k", "u1", 3, "grade nine science notes"), ("l", "u2", 3, "grade nine science notes"), ("l", "u3", 1, "science notes")], "competitor string, url string, weight int, text string")
    kept = {r.phrase: r.pages for r in c.page_phrases(heads).collect()}
    assert kept["grade nine science notes"] == 2 and kept.get("science notes") == 3 and "nine science" not in kept


def test_slots_authority_questions_citations(spark):
    topics = spark.createDataFrame([("s", 1, "b"), ("s", 2, "a"), ("z", 1, "c")], "site_id string, place int, topic string")
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "day string")
    taken = spark.createDataFrame([("s", "2024-01-01"), ("z", "2024-01-09")], "site_id string, day string")
    assert {tuple(r) for r in c.slots(topics, days, taken).collect()} == {("s", "b", "2024-01-02"), ("s", "a", "2024-01-03"), ("z", "c", "2024-01-01")}
    hosts = spark.createDataFrame([("x.gov.uk",), ("mit.edu",), ("who.int",), ("a.org",), ("b.com",)], "host string")
    assert [r.a for r in hosts.select(c.authority("host").alias("a")).collect()] == ["Government", "Education / research", "International body", "Organisation", "Other"]
    qs = spark.createDataFrame([("k", "u", "heading", "How so, really?"), ("l", "v", "faq", "how SO really"), ("l", "v", "text", "Is Lbrand good?")], "competitor string, url string, source string, text string")
    ours = spark.createDataFrame([("So really, how", "https://us.e/faq")], "text string, url string")
    brands = spark.createDataFrame([("l", "Lbrand")], "competitor string, brand string")
    assert [(r.key, r.text, r.competitors, r.pages, r.sources, r.answered, r.our_url) for r in c.question_bank(qs, ours, brands).collect()] == [("how so really", "how SO really", 2, "u v", "faq,heading", "yes", "https://us.e/faq")]
    ls = spark.createDataFrame([("k", "k.e", "https://a.example/d?x=1", "x"), ("l", "l.e", "http://www.a.example/d", "y"), ("l", "l.e", "https://b.example/", "z")], "competitor string, host_of_page string, url string, anchor string")
    assert [(r.key, r.links, r.competitors) for r in c.citations(ls).collect()] == [("a.example/d", 2, 2)]


def test_backlinks_and_comparison(spark):
    shape = "site_id string, page_ord long, page string, title string, h1 string, link_ord long, target string, anchor string"
    page = ("s", 1, "https://www.s.e/a", "Our partners", "x")
    other = ("s", 2, "https://www.s.e/b", "Tea", "Tea")
    links = [(*page, 1, "https://s.e/own", ""), (*page, 2, "https://yellowpages.e/x", ""), (*page, 3, "https://m.facebook.com/s", ""), (*page, 4, "https://acme.e/1", "Certified by Acme"), (*page, 5, "https://acme.e/2", ""), (*other, 1, "https://acme.e/3", ""), (*other, 2, "https://the-times.e/n", "partner"), (*other, 3, "https://club.org/", ""), (*other, 4, "https://netflix.com/", "")]
    got = {r.host: (r.type, r.pages, r.resource_mentions, r.examples) for r in c.backlink_domains(spark.createDataFrame(links, shape)).collect()}
    assert got == {
        "yellowpages.e": ("Directory", 1, 1, "https://yellowpages.e/x"), "acme.e": ("Partner mention", 2, 2, "https://acme.e/1 https://acme.e/2 https://acme.e/3"), "the-times.e": ("Association/Publication", 1, 0, "https://the-times.e/n"), "club.org": ("Association/Publication", 1, 0, "https://club.org/"),
    }
    pages = spark.createDataFrame([("s", "s/", True, 100, ["A", "B"]), ("s", "s/x", False, 301, ["A"]), ("s", "s/y", False, 50, None), ("t", "t/", True, 10, [])], "site_id string, page string, is_start boolean, word_count int, schema_types array<string>")
    inbound = spark.createDataFrame([("s", "s/x"), ("s", "s/x"), ("t", "s/y")], "site_id string, dst string")
    flags = spark.createDataFrame([("s", 40, 60), ("t", 10, 20)], "site_id string, aeo_score long, geo_score long")
    sites = c.comparison(pages, inbound, flags)
    assert {tuple(r) for r in sites.collect()} == {("s", 3, 150, "A,B", 33, 40, 60), ("t", 1, 10, "", 0, 10, 20)}
    assert {(r.measure, r.ours, r.theirs) for r in c.compared(sites, "s").collect()} == {("pages", 3, 1), ("avg_words", 150, 10), ("orphan_percent", 33, 0), ("aeo_score", 40, 10), ("geo_score", 60, 20)}


def test_backlinks_read_hosts_once_and_sort_no_host(spark):
    shape = "site_id string, page_ord long, page string, title string, h1 string, link_ord long, target string, anchor string"
    links = [("s", 1, "https://s.e/a", "t", "h", 1, "https://a.e/x", a) for a in ("Our partner", "none")] + [("s", k, "https://s.e/b", "t", None, 1, f"https://a.e/{k}", None) for k in range(2, 9)]
    out = c.backlink_domains(spark.createDataFrame(links, shape))
    assert [tuple(r) for r in out.collect()] == [("s", "a.e", "Other", 8, 0, "https://a.e/x https://a.e/x https://a.e/2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "regexp" not in plan.lower()
