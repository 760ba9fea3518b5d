import datetime

from plumbline.operators import playbook, ranks


def test_items_and_scores(spark):
    sites = spark.createDataFrame([("s",), ("t",)], "site_id string")
    shares = spark.createDataFrame([("s", "thin", 1, 5), ("s", "orphan", 2, 5), ("s", "no_schema", 5, 5), ("s", "long_url", 0, 5), ("s", "gbp", 2, 5), ("s", "area_without_page", 3, 3)], "site_id string, measure string, bad long, of long")
    counts = spark.createDataFrame([("s", "pages", 5), ("s", "keywords", 9), ("s", "keywords", 1), ("s", "cannibals", 2), ("s", "faq_pages", 0), ("s", "questions", 1)], "site_id string, measure string, n long")
    found = spark.createDataFrame([("s", "tech_redirect_chains"), ("s", "tech_home_noindex"), ("t", "tech_no_robots")], "site_id string, finding string")
    marks = spark.createDataFrame([("s", "s_bing", "done"), ("s", "c_depth", "na")], "site_id string, item string, mark string")
    judged = playbook.items(sites, shares, counts, found, marks)
    got = {(r.site_id, r.item): r.status for r in judged.collect()}
    assert len(got) == 2 * len(playbook.ITEMS)
    want = {"c_depth": "na", "o_orphan": "fail", "t_schema": "fail", "o_url": "pass", "l_gbp": "warn", "l_pages": "fail", "c_related": "pass", "c_cannibal": "warn", "c_faq": "fail", "c_paa": "warn", "t_redirects": "warn", "s_index": "fail", "t_links": "pass", "s_bing": "pass", "s_ga4": "todo", "t_302": "unknown", "t_cwv": "unknown"}
    assert {k: got["s", k] for k in want} == want
    # nothing was looked at on the other site
    assert {got["t", k] for k in ("o_url", "t_robots", "c_faq", "c_refresh", "l_pages")} == {"unknown"} and got["t", "l_reviews"] == got["t", "f_find"] == "todo"
    rows = {(r.site_id, r.group): r for r in playbook.rollup(judged).collect()}
    setup = [got["s", i] for g, i, *_ in playbook.ITEMS if g == "setup"]
    assert rows["s", "setup"].score == int(100 * sum({"pass": 1, "warn": 0.5}.get(x, 0) for x in setup) / len(setup) + 0.5) and rows["s", "all"].items == len(playbook.ITEMS)


def test_targeting_pages_and_check_opportunities(spark):
    pages = spark.createDataFrame([("s.e", 1, "/1", "Green teas", None), ("s.e", 2, "/2", "Evergreen", "Tea for all"), ("s.e", 3, "/3", "Tea", "Green"), ("t.e", 1, "/x", "green tea", "")], "site_id string, page_ord long, url string, title string, h1 string")
    queries = spark.createDataFrame([("s.e", "green tea"), ("s.e", "GREEN for"), ("s.e", "coffee"), ("s.e", "??"), ("t.e", "tea")], "site_id string, query string")
    # parts of words count, and the first page wins
    assert {tuple(r) for r in ranks.targeting_pages(queries, pages).collect()} == {("s.e", "green tea", "/1"), ("s.e", "GREEN for", "/2"), ("t.e", "tea", "/x")}
    day = datetime.datetime
    checks = spark.createDataFrame([(1, "s.e", "Green tea", day(2024, 1, 1)), (2, "s.e", "coffee", day(2024, 1, 20)), (3, "s.e", "tea", day(2024, 1, 20)), (4, "s.e", "none", day(2024, 1, 20))], "check_id long, site_id string, query string, observed_at timestamp")
    results = spark.createDataFrame([(1, "a.e", 1), (1, "b.e", 2), (2, "a.e", 1), (2, "b.e", 2), (2, "c.e", 3), (2, "shop.s.e", 4), (3, "s.e", 3)], "check_id long, host string, rank long")
    demand = spark.createDataFrame([("s.e", "green TEA", 50), ("s.e", "coffee", 99)], "site_id string, query string, impressions long")
    tracked = spark.createDataFrame([], "site_id string, query string")
    got = {tuple(r) for r in ranks.check_opportunities(checks, results, pages, demand, tracked, day(2024, 1, 21)).collect()}
    assert got == {(1, "s.e", "Green tea", None, "not in results", "High", "Low", 20, "a.e, b.e", "/1"), (2, "s.e", "coffee", 4, "room to climb", "Medium", "Medium", 1, "a.e, b.e, c.e", None)}
