"""Content, record and market operators on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from plumbline.operators import competitors as cp
from plumbline.operators import content as c
from plumbline.operators import market as mk
from plumbline.operators import records as rc
from plumbline.operators import search_perf as sp
from plumbline.operators import similarity as sim


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DRAFT = "site_id string, id string, markdown string, title string, description string, keyword string, intent string, word_target int, first_hand boolean, sources array<struct<n:int,url:string>>, internal_urls array<string>"


def test_draft_checks(spark):
    body = " ".join(["Green tea brewing needs care."] * 3 + ["Water matters a lot here."] * 20)
    good = f"# Green tea brewing\n{body}\n## One\nFact [1] and [2].\n## Two\n[a](https://s.e/a) [b](https://s.e/b)\n## FAQ\nDone."
    rows = [("s", "good", good, "Green tea brewing for people who like it", "x" * 110 + " green tea brewing", "green tea brewing", "Informational", 100, True, [(1, "https://o.e"), (2, "https://p.e")], ["https://s.e/a", "https://s.e/b"]),
            ("s", "bad", "### Up\nIn conclusion we delve. [3] [ADD: author] [x](https://evil.e)", "Hi", "short", "green tea", "Informational", 1000, False, [(1, "https://o.e")], [])]
    got = {(r.id, r.check): r.status for r in c.draft_checks(make(spark, rows, DRAFT)).collect()}
    assert len(got) == 26
    assert {k: got["good", k] for k in ("title", "headings", "kw_early", "citations", "links", "placeholders", "experience", "filler", "faq", "length")} == dict.fromkeys(("title", "headings", "kw_early", "citations", "links", "placeholders", "experience", "filler", "faq", "length"), "pass")
    assert {k: got["bad", k] for k in ("title", "meta", "headings", "citations", "links", "length")} == dict.fromkeys(("title", "meta", "headings", "citations", "links", "length"), "fail")
    assert {got["bad", k] for k in ("placeholders", "experience", "filler", "faq", "kw_early")} == {"warn"}


def test_suggestion_checks(spark):
    pages = make(spark, [("s", "https://shop.e/1", "Tea & cake shop", "desc", "We sell green tea and cake in London every day"), ("s", "https://shop.e/2", "Other page", "desc", "nothing")], "site_id string, url string, title string, description string, body string")
    drafts = make(spark, [("s", "https://shop.e/1", "title", t) for t in ("", "Tea and cake shop", "Other Page", "GREEN TEA AND CAKE LONDON", "Quantum rocket engines certified worldwide", "Green tea and cake in London today")], "site_id string, url string, kind string, text string").withColumn("n", F.monotonically_increasing_id())
    got = [r.warnings for r in c.suggestion_checks(drafts.withColumn("url", F.col("url")), pages).join(drafts.select("text").distinct(), F.lit(True)).select("warnings").distinct().collect()]
    assert set(got) == {"EMPTY", "TOO_SHORT,UNCHANGED", "TOO_SHORT,DUPLICATE", "ALL_CAPS", "UNGROUNDED", ""}


TOPIC = "site_id string, id string, title string, primary_keyword string, intent string, funnel string, format string, angle string, pillar string, grounding_id string"


def test_topics(spark):
    rows = [("s", "a", "How to brew green tea at home safely", "brew green tea", "I", "F", "G", "x" * 50, "tea", "Q1"), ("s", "b", "Ultimate guide", "tea", None, "F", "G", "short", "", "Z9"), ("s", "c", "What tea does for the tired mind", "coffee beans", "I", "F", "G", "x" * 50, "tea", "SITE")]
    t = make(spark, rows, TOPIC)
    got = {r.id: r.reasons for r in c.topic_quality(t).collect()}
    assert got["a"] == "" and got["c"] == "keyword not in title"
    assert got["b"].split(",") == ["title length", "title too short", "generic title", "keyword length", "no intent", " funnel or format", "no angle", "no cluster"]
    items = make(spark, [("s", "Q1"), ("other", "Z9")], "site_id string, id string")
    assert {r.id for r in c.grounded_topics(t, items).collect()} == {"a", "c"}


def test_dedupe_and_schedule(spark):
    topics = make(spark, [("s", "a", 1, "Brew green tea at home", "k1"), ("s", "b", 2, "Brewing green tea at home", "k1"), ("s", "c", 3, "Old page title here", ""), ("s", "d", 4, "Coffee roasting basics", ""), ("z", "e", 1, "Brew green tea at home", "")], "site_id string, id string, ord int, title string, keyword string")
    existing = make(spark, [("s", "The old page title")], "site_id string, title string")
    assert {r.id: r.kept for r in c.dedupe_topics(topics, existing).collect()} == {"a": True, "b": False, "c": False, "d": True, "e": True}
    plan = make(spark, [("s", "a", "tea", "Q", True, ""), ("s", "b", "Tea", "Q", False, ""), ("s", "c", "cake", "P", False, "Case study"), ("z", "d", "tea", "SITE", False, "")], "site_id string, id string, pillar string, grounding_kind string, has_links boolean, format string")
    taken = make(spark, [("s", "2024-01-02")], "site_id string, day string")
    got = {r.id: (str(r.day), r.priority) for r in c.schedule(plan, "2024-01-01", taken).collect()}
    assert got == {"a": ("2024-01-01", "High"), "c": ("2024-01-03", "Low"), "b": ("2024-01-04", "High"), "d": ("2024-01-01", "Low")}


def test_coverage(spark):
    s = "site_id string, title string"
    index = c.coverage_index(make(spark, [("s", "Pasted title")], s), make(spark, [("s", "Fish schemes", "https://s.e/blog/fish")], s + ", url string"), make(spark, [("s", "Home", "h", "https://s.e/"), ("s", "Fish again", "h", "https://www.s.e/blog/fish/")], s + ", h1 string, url string"), make(spark, [("s", "Planned", "kw")], s + ", keyword string"))
    assert {(r.title, r.source) for r in index.collect()} == {("Pasted title", "pasted"), ("Fish schemes", "feed"), ("Planned", "planner")}
    assert [r.title for r in c.existing_titles(index).orderBy("place").collect()] == ["Pasted title", "Planned", "Fish schemes"]
    words = make(spark, [("Schemes, classes and categories 2024 of grade 9 bus",)], "t string").select(c.stemmed("t").alias("w")).first().w
    assert words == ["scheme", "class", "category", "grade", "9", "bus"]


def test_urls_ideas_and_items(spark):
    urls = make(spark, [("https://a.e/",), ("https://a.e/tag/x",), ("https://a.e/blog/page/2",), ("https://a.e/f.pdf",), ("https://a.e/blog/grade-9-list.html",), ("https://a.e/123",)], "u string")
    got = urls.select(c.content_url("u").alias("k"), c.title_from_slug("u").alias("t"), c.sitemap_priority("u").alias("p")).collect()
    assert [r.k for r in got] == [False, False, False, False, True, True] and got[4].t == "Grade 9 list" and got[5].t == "" and [r.p for r in got][4] == 0
    ideas = make(spark, [("Idea", False, "x", None), ("Ready", False, "x", None), ("Idea", True, "x", datetime.date(2024, 1, 5)), ("Idea", False, "Content refresh", datetime.date(2024, 3, 1))], "status string, has_draft boolean, source string, scheduled_for date")
    kept, replace = c.split_regenerate(ideas)
    assert (kept.count(), replace.count(), c.due_topics(ideas, datetime.date(2024, 1, 1)).count()) == (3, 1, 2)
    seen = make(spark, [("s", 1, "Old  one"), ("s", 2, "New")], "site_id string, at int, title string")
    assert [r.title for r in c.remember_rejected(seen, seen.selectExpr("site_id", "at + 5 as at", "upper(title) as title")).orderBy("place").collect()] == ["NEW", "OLD ONE"]
    items = c.calendar_items({"Q": make(spark, [("s", 5, "tea", "n"), ("s", 9, "cake", "n"), ("s", 1, "Tea", "n")], "site_id string, weight int, text string, note string")})
    assert sorted((r.id, r.text) for r in items.collect()) == [("Q1", "cake"), ("Q2", "Tea")]
    topics = c.to_topics(queries=make(spark, [("s", "green tea", "u")], "site_id string, query string, top_page string"), areas=make(spark, [("s", "Tea", "Kent")], "site_id string, offer string, area string"))
    assert {(r.title, r.source) for r in topics.collect()} == {("Green tea", "Search Console query"), ("Tea in Kent", "Added by you")}
    kinds = make(spark, [("Add FAQ schema",), ("Fix broken https://a.e/canonical",), ("Thin content",), ("hello",)], "t string").select(c.fix_kind("t").alias("k"))
    assert [r.k for r in kinds.collect()] == ["schema", "general", "content_update", "general"]


def test_pages_for(spark):
    pages = make(spark, [("s", "https://a.e/", True), ("s", "https://a.e/x", False), ("s", "https://a.e/y", False)], "site_id string, url string, is_start boolean")
    opps = make(spark, [("s", "1", ["https://a.e/y/"], "see https://a.e/x."), ("s", "2", None, "nothing")], "site_id string, id string, urls array<string>, text string")
    assert sorted((r.id, r.place, r.url) for r in c.pages_for(opps, pages).collect()) == [("1", 1, "https://a.e/y"), ("1", 2, "https://a.e/x"), ("2", 1, "https://a.e/")]


def test_records(spark):
    old = make(spark, [("s", 1, "uni_aeo_q1", "m", None, " T ", "meta fix", "HIGH", "low", "Crawled Data", None, None, "applied", 1), ("s", 2, "saeor_q1", "m", None, "T2", "x", "x", "x", "", None, None, "x", 2), ("s", 3, None, "", "observed", "", "x", "x", "x", "", None, None, "x", 3)], "site_id string, id long, source_id string, module string, kind string, title string, type string, priority string, confidence string, source string, country string, crawl_id string, status string, created_at int")
    got = {r.source_id: r for r in rc.migrate_records(old).collect()}
    assert set(got) == {"saeor_q1", "manual_3"} and got["saeor_q1"].id == 2 and got["manual_3"].title == "Untitled action" and got["manual_3"].priority == "Medium"
    cands = make(spark, [("s", "a", "M", "One"), ("s", "b", "M", "Two"), ("s", "c", "M", "Three")], "site_id string, source_id string, module string, title string")
    recs = make(spark, [("s", 10, "a", "M", "One!", "Applied", "c1", "Kenya"), ("s", 11, "old", "m", "two", "New", "c2", None), ("s", 12, "gone", "M", "Gone", "Rejected", "c2", "Chile")], "site_id string, id long, source_id string, module string, title string, status string, crawl_id string, country string")
    now = make(spark, [("s", "c2", "Kenya")], "site_id string, crawl_id string, market string")
    m = {(r.source_id): (r.record_id, r.state, r.current, r.stale, r.other_market) for r in rc.match_records(cands, recs, now).collect()}
    assert m == {"a": (10, "Applied", True, True, False), "b": (11, "New", True, False, False), "c": (None, "Open", True, False, False), "gone": (12, "Rejected", False, False, True)}


def test_tracking_staleness_vitals_and_scores(spark):
    links = make(spark, [("s", "a", "t"), ("s", "b", "t"), ("s", "a", "u")], "site_id string, source string, target string")
    tracked = make(spark, [("s", "a", "t", "Applied"), ("s", "b", "t", "Tracked")], "site_id string, source string, target string, status string")
    assert {r.target: r.state for r in rc.link_tracking(links, tracked).collect()} == {"t": "in_actions", "u": "new"}
    res = make(spark, [("s", "aeo", "c1", 5), ("s", "aeo", "c2", 3), ("s", "aeo", "c2", 4), ("s", "geo", None, 1)], "site_id string, kind string, crawl_id string, seq int")
    cur = make(spark, [("s", "c2")], "site_id string, crawl_id string")
    assert {(r.kind, r.seq) for r in rc.staleness_guard(res, cur).collect()} == {("aeo", 4), ("geo", 1)}
    v = make(spark, [("s", "u", "mobile", 5000.0, None, 0.2, 1.0, 0.0)], "site_id string, url string, strategy string, field_lcp double, field_inp double, field_cls double, lab_lcp double, lab_cls double")
    assert [(r.place, r.metric, r.rating) for r in rc.weak_vitals(v).orderBy("place").collect()] == [(1, "lcp", "poor"), (2, "cls", "needs improvement")]
    items = make(spark, [("s", "g", "a", 0, 10, None), ("s", "g", "b", 2, 10, None), ("s", "h", "c", 5, 10, None), ("s", "h", "d", None, None, None), ("s", "h", "e", None, None, "pass")], "site_id string, group string, item string, bad int, of int, manual string")
    assert {r.group: r.score for r in rc.scorecard(items).collect()} == {"g": 75, "h": 50, "all": 63}
    ids = make(spark, [("mkt_x", "C", "T", ["u"]), ("rec_3", "On-Page", "Missing H1", ["u"]), ("site_duptitle_0", "C", "T", ["b", "a"])], "n string, c string, t string, u array<string>")
    assert [r.i for r in ids.select(rc.issue_id("n", "c", "t", "u").alias("i")).collect()] == ["mkt:mkt_x", "tech:rec:on-page-missing-h1", "tech:site_duptitle:a-b"]


MARKETS = "country string, code string, languages array<string>, currencies array<string>, dial string"


def test_market_and_local(spark):
    from plumbline.operators.pages import contact_text, records, tel_links

    ld = '<script type="application/ld+json">{"@type": "Store", "name": "Fins", "address": {"@type": "PostalAddress", "addressCountry": "US"}, "telephone": "+1 212 555 0100", "priceCurrency": "USD"}</script>'
    pages = make(spark, [("s", 1, "https://s.e/", f'<html lang="fr"><head>{ld}<link rel="alternate" hreflang="fr_FR" href="/fr"><link rel="alternate" hreflang="fr" href="https://s.e/fr"></head><body>Fins, 1 Dock Road, Kent. Call 0712345678</body></html>'), ("s", 2, "https://s.e/kent", "<html><head><title>Fish in Kent</title></head><body>x</body></html>")], "site_id string, page_id long, url string, html string")
    r = mk.structured_facts(records(pages))
    facts = r.withColumn("tel_links", tel_links(r)).withColumn("contact_text", contact_text(r)).withColumn("is_start", F.col("page_id") == 1).withColumn("page_type", F.lit("content"))
    profiles = make(spark, [("Kenya", "KE", ["en", "sw"], ["KES"], "254")], MARKETS)
    sites = make(spark, [("s", "Kenya", "https://s.e/"), ("w", "Worldwide", "https://w.e/")], "site_id string, country string, start_url string")
    found = {x.finding: (x.severity, x.urls) for x in mk.market_findings(facts, sites, profiles).collect()}
    assert found == {"lang_mismatch": ("Medium", 1), "lang_missing": ("Low", 1), "hreflang_invalid": ("Medium", 1), "hreflang_relative": ("Medium", 1), "hreflang_no_self": ("Medium", 1), "hreflang_no_default": ("Low", 1), "hreflang_market_missing": ("Medium", 1), "schema_country": ("Medium", 1), "schema_currency": ("Low", 1), "phone_country": ("Low", 1)}
    local = make(spark, [("s", "Fins Ltd", "1 Dock Road", "+254 712 345 678")], "site_id string, name string, address string, phone string")
    checks = {x.check: x.status for x in mk.local_checks(facts, local).collect()}
    assert checks == {"name": "pass", "address": "pass", "phone": "pass", "other_phones": "warn", "tel_links": "warn", "schema": "warn", "map": "warn", "reviews": "warn"}
    areas = make(spark, [("s", "Kent"), ("s", "Dock"), ("s", "Mars")], "site_id string, area string")
    assert {x.area: x.status for x in mk.area_coverage(facts, areas).collect()} == {"Kent": "page", "Dock": "mention", "Mars": "none"}
    assert mk.local_prefill(facts).first().name == "Fins"


def test_competitors(spark):
    q = make(spark, [("c1", "u1", "heading", "How do I brew green tea?"), ("c2", "u2", "faq", "How do I brew green tea"), ("c1", "u1", "text", "Is AcmeTea any good for me?")], "competitor string, url string, source string, text string")
    bank = cp.question_bank(q, make(spark, [("Brew green tea", "our")], "text string, url string"), make(spark, [("c1", "acmetea")], "competitor string, brand string")).collect()
    assert [(b.text, b.competitors, b.answered, b.our_url) for b in bank] == [("How do I brew green tea", 2, "yes", "our")]
    pairs = make(spark, [("t", "o", "Lesson plan guide Lesson plans")], "theirs string, ours string, topic string")
    theirs = make(spark, [("t", 1, "What is a lesson plan?"), ("t", 2, "Parts of a lesson plan"), ("t", 3, "Common mistakes"), ("t", 4, "Time keeping"), ("t", 5, "Contact us")], "page string, place int, heading string")
    ours = make(spark, [("o", 1, "Parts of the plan"), ("o", 2, "About lessons")], "page string, place int, heading string")
    assert [r.section for r in cp.missing_sections(pairs, theirs, ours).orderBy("place").collect()] == ["What is a lesson plan?", "Common mistakes", "Time keeping"]
    un = make(spark, [("s", 1, "c1", "u1", "Green tea brewing", 300), ("s", 2, "c2", "u2", "Brewing green tea", 500), ("s", 3, "c1", "u3", "Coffee roasting", 400)], "site_id string, ord long, competitor string, url string, title string, words int")
    groups = cp.page_groups(un)
    assert sorted((r.leader, r.competitors, r.url) for r in cp.missing_pages(un, groups).collect()) == [(1, 2, "u2"), (3, 1, "u3")]
    ideas = cp.keyword_ideas(make(spark, [("Green Tea",)], "text string"), make(spark, [("green tea",), ("cake",)], "text string"), make(spark, [("Is tea good?",)], "text string"), make(spark, [("Cake!",)], "text string"))
    assert sorted((r.key, r.sources) for r in ideas.collect()) == [("green tea", "competitors,related"), ("is tea good", "questions")]
    cites = cp.citations(make(spark, [("c1", "c1.e", "https://www.who.int/tea/report", "tea report"), ("c2", "c2.e", "https://www.who.int/tea/report?x", "WHO"), ("c1", "c1.e", "https://blog.e/tea-cups", ""), ("c1", "c1.e", "https://x.c1.e/own", ""), ("c1", "c1.e", "https://t.co/a", ""), ("c1", "c1.e", "https://home.e/", "")], "competitor string, host_of_page string, url string, anchor string"))
    assert {r.key: (r.links, r.competitors, r.authority) for r in cites.collect()} == {"who.int/tea/report": (2, 2, "International body"), "blog.e/tea-cups": (1, 1, "Other")}
    topic = cp.citations_for_topic(cites, make(spark, [("green tea cups",), ("coffee",)], "topic string"))
    assert sorted((r.topic, r.place, r.host) for r in topic.collect()) == [("coffee", 1, "who.int"), ("green tea cups", 1, "who.int"), ("green tea cups", 2, "blog.e")]
    src = cp.source_candidates(make(spark, [("t", "https://a.gov/1", 3), ("t", "https://a.gov/2", 1), ("t", "https://b.e/1", 2)], "topic string, url string, place int"))
    assert [(r.rank, r.url) for r in src.orderBy("rank").collect()] == [(1, "https://a.gov/2"), (2, "https://b.e/1")]
    hints = cp.outline_hints(make(spark, [("p1", "Green tea guide", 1, "Choosing leaves"), ("p1", "Green tea guide", 2, "Choosing the leaves"), ("p1", "Green tea guide", 3, "Water"), ("p2", "Cars", 1, "Wheels")], "page string, title string, ord int, heading string"), make(spark, [("Green tea",)], "topic string"))
    assert [r.heading for r in hints.orderBy("place").collect()] == ["Choosing leaves", "Water"]
    placed = cp.keyword_placement(make(spark, [("k1", "Green teas", "Brew", "all about green tea"), ("k2", "Green tea", "Green tea", "green tea")], "page_key string, title string, h1 string, body string"), make(spark, [("k1", "green tea"), ("k2", "green tea")], "page_key string, query string"))
    assert [(r.page_key, r.in_title, r.in_h1, r.in_start) for r in placed.collect()] == [("k1", True, False, True)]


def test_slim_pages_and_similarity(spark):
    from plumbline.operators.pages import records

    html = "<body><h2>How fresh is the fish today?</h2><h2>Menu</h2><p>Where can I buy the fish? Here.</p><a href='https://o.e/a/b'>src</a></body>"
    slim = cp.slim_pages(records(make(spark, [("c", 1, "https://c.e/", html)], "site_id string, page_id long, url string, html string"))).first()
    assert [(x.q, x.src) for x in slim.questions] == [("How fresh is the fish today?", "heading")] or len(slim.questions) == 2
    assert slim.cites[0].url == "https://o.e/a/b" and len(slim.headings) == 2
    t = make(spark, [(1, ["tea", "9"]), (2, ["cake", "pie"])], "id int, words array<string>")
    e = make(spark, [(7, ["tea", "9", "list"]), (8, ["tea", "9", "10"]), (9, ["x"])], "id int, words array<string>")
    top = make(spark, [(9, ["cake", "pie"])], "id int, words array<string>")
    assert sorted(tuple(r) for r in sim.covered_or_alike(t, e, top).collect()) == [(1, 7, "title"), (2, 9, "query")]


def test_no_impressions_and_caps(spark):
    pages = make(spark, [("a", "https://a.e/1", 200, False), ("a", "https://a.e/2", 200, False), ("a", "https://a.e/3", 404, False), ("b", "https://b.e/1", 200, False), ("c", "https://c.e/1", 200, False)], "site_id string, url string, status int, noindex boolean")
    seen = make(spark, [("a", "https://a.e/1/"), ("c", "https://c.e/9")], "site_id string, page string")
    cut = make(spark, [("c",)], "site_id string")
    assert [r.url for r in sp.no_impressions(pages, seen, cut).collect()] == ["https://a.e/2"]
    day = datetime.date(2024, 1, 10)
    log = make(spark, [("a", day, f"q{k}", "https://a.e/1", "d", "ke", k, 10, 3.0) for k in range(4)], "site_id string, date date, query string, page string, device string, country string, clicks long, impressions long, position double")
    got = sp.search_report(log, 7, datetime.date(2024, 1, 14), {"query": 2}).where("dimension = 'query'").collect()
    assert sorted(r.key for r in got) == ["q2", "q3"] and all(r.truncated for r in got)


def test_candidates_count_each_page_in_its_own_row(spark):
    """Ties, stop words, odd white space, nulls and non-overlapping occurrences; and no shuffle, which grew with every phrase of every page."""
    from plumbline.operators import keywords as kw

    rows = [("a", 1, "Red Ring of\u00a0Steel", "ring's", "", None, "", "Red ring, red RING: the ring-fence. aa aaaa", "product"), ("b", 2, None, "", "", "", "", "", ""), ("b", 3, "of the it", "x yz", "", "", "", "yz", "")]
    df = kw.candidates(make(spark, rows, "site_id string, page_id long, title string, h1 string, h2h3 string, description string, alt string, body string, schema string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.page_id, r.phrase): (r.score, r.in_title, r.in_h1, r.in_description, r.in_body) for r in df.collect()}
    assert got[1, "red ring"] == (8, True, False, None, 2)
    assert got[1, "ring"] == (8, True, True, None, 3)
    assert got[1, "steel"] == (6, True, False, None, 0) and (1, "ring of steel") not in got
    assert got[1, "aaaa"][4] == 1 and (1, "aa") not in got and (1, "ring red") not in got
    assert {page for page, _ in got} == {1}


def test_near_pairs_by_sketches_lose_no_link(spark):
    """Pairs at, just above and just below the threshold, also where sets are larger than sketches have bits; candidates that differ in too many bits are not shuffled."""
    import random

    from plumbline.operators import similarity as sim

    rng = random.Random(9)
    base = [f"w{k}" for k in range(900)]
    sets = []
    for size in (4, 20, 57, 300, 800):
        first = rng.sample(base, size)
        for swap in range(0, max(2, size // 8), max(1, size // 40)):
            sets.append(sorted(set(first[swap:]) | {f"x{size}-{k}" for k in range(rng.choice([0, swap]))}))
    rows = [(k, s, k) for k, s in enumerate(sets)]
    pairs = sim.near_pairs(spark.createDataFrame(rows, "id long, words array<string>, rep long"), "id", 0.85)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and share(a, b) >= 0.85}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 20


def test_site_rank_spreads_hosts_and_not_results(spark):
    """The suffixes of a host are joined once for each host: results were sent to one task by the suffix all share."""
    from plumbline.operators import ranks

    results = make(spark, [(c, h, c + k) for c in range(3) for k, h in enumerate(("a.shop.com", "shop.com", "b.org"))], "check_id long, host string, rank long")
    df = ranks.site_rank(results, make(spark, [("shop.com",), ("shop.com",), ("b.org",)], "site string"))
    assert {(r.check_id, r.site): (r.rank, r.host) for r in df.collect()} == {(c, s): v for c in range(3) for s, v in (("shop.com", (c, "a.shop.com")), ("b.org", (c + 2, "b.org")))}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate") and plan.count("Generate") == 1 and "Aggregate [host" in plan


def test_citations_count_equal_links_before_reading_their_hosts(spark):
    """Hosts and keys were read by pattern once for every link; equal links are one row now, and all are counted."""
    rows = [("a", "a.e", "https://b.org/x?u=1", "B")] * 5 + [("a", "a.e", "https://b.org/x", None)] * 2 + [("c", "c.e", "https://www.b.org/x/", "C")]
    df = cp.citations(make(spark, rows, "competitor string, host_of_page string, url string, anchor string"))
    assert [(r.key, r.links, r.competitors, r.anchors) for r in df.collect()] == [("b.org/x", 8, 2, "B | C")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [competitor") >= 1


def test_nearest_pages_are_compared_in_bounded_blocks(spark):
    """All pairs by their definition, whatever the blocks; equal sets and ties go to the smaller id, and no pair is a row."""
    import random

    from plumbline.operators import similarity as sim

    rng = random.Random(7)
    side = lambda first, n: [(first + k, rng.sample("abcdefghij", rng.randrange(0, 6))) for k in range(n)]
    ours, theirs = side(1000, 80), side(0, 60)
    shape = "id long, words array<string>"
    want = {}
    for i, a in theirs:
        near = [(-len({*a} & {*b}) / len({*a} | {*b}), j) for j, b in ours if {*a} & {*b}]
        if near and -min(near)[0] >= 0.34:
            want[i] = (min(near)[1], -min(near)[0])
    for block in (7, 16384):
        out = sim.nearest(spark.createDataFrame(theirs, shape), spark.createDataFrame(ours, shape), 0.34, block)
        assert {r.l: (r.r, r.similarity) for r in out.collect()} == want
    assert sim.nearest(spark.createDataFrame([], shape), spark.createDataFrame(ours, shape)).collect() == []
