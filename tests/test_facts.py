from pyspark.sql import functions as F

from plumbline.operators import content, stack, structured, technical


def test_stack_evidence(spark):
    shape = "site_id string, page_id long, html string, headers map<string,string>"
    pages = [
        ("w", 1, '<meta name=generator content=" WordPress 6"><link rel=stylesheet href="/WP-content/x.css"><div class=wp-block-a>' + "word " * 60, {"Server": "nginx", "CF-Ray": "1"}), ("w", 2, "<p>x", {"server": "GitHub.com"}),
        ("r", 1, "<div id='root'></div><script src=/static/js/main.1.js></script>", None), ("r", 2, "<p>" + "word " * 60, {"server": "Apache"}), ("m", 1, "<div id=\"app\"></div>", None), ("n", 1, None, None),
        ("a", 1, "<astro-island></astro-island><script src='https://x/jquery.js'></script>" + "word " * 60, {"x-powered-by": "Next.JS"}),
    ]
    found = stack.signals(spark.createDataFrame(pages, shape))
    got = {(r.site_id, r.name, r.confidence) for r in stack.technologies(found).collect()}
    # the first page's server counts, and a plain one does not beside a telling host; a bare mount point proves nothing
    assert got == {("w", "WordPress", "high"), ("w", "Cloudflare (CDN or Pages)", "medium"), ("r", "React", "high"), ("r", "Apache", "low"), ("a", "Astro", "high"), ("a", "jQuery", "high"), ("a", "Next.js", "high")}
    rows = {r.site_id: r for r in stack.detect(found).collect()}
    assert (rows["w"].summary, rows["w"].rendering, rows["w"].pull_requests) == ("WordPress · on Cloudflare (CDN or Pages)", "platform-rendered", "low")
    assert (rows["r"].rendering, rows["r"].client_pages, rows["r"].pages, rows["r"].summary) == ("client-rendered", 1, 2, "React · on Apache · renders in the browser")
    assert (rows["m"].summary, rows["m"].pull_requests, rows["n"].rendering) == ("Plain HTML", "high", "static-html")
    assert (rows["a"].rendering, rows["a"].technologies, rows["a"].pull_requests) == ("pre-rendered", "Next.js + Astro + jQuery", "medium")


def test_structured_facts_to_a_depth(spark):
    deep = '{"@type":"A","x":' * 6 + '{"telephone":"1"}' + "}" * 6
    deeper = '{"@type":"A","x":' * 9 + '{"telephone":"2"}' + "}" * 9
    lds = ['[{"@graph":[{"@graph":{"@type":"schema:B"}}]},"text",5,null]', deep, deeper, "{broken", '{"@type":"Dentist","name":["no"],"openingHours":"","geo":{},"address":{"addressCountry":5,"@type":["PostalAddress"],"postalCode":" 1 "}}']
    df = spark.createDataFrame([("s", 1, lds), ("s", 2, None), ("s", 3, [])], "site_id string, page_id long, ld array<string>")
    plan = structured.structured_facts(df)
    got = {r.page_id: r.ld_facts for r in plan.collect()}
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in plan._jdf.queryExecution().executedPlan().toString()
    f = got[1]
    assert (sorted(f.types), f.telephones, f.invalid, f.local_types, f.names, f.postal_codes) == (["A", "B", "Dentist"], ["1"], 1, ["Dentist"], [], ["1"])
    assert (f.has_address, f.has_hours, f.has_geo, f.has_same_as, f.countries) == (True, False, True, False, [])
    assert got[2].types == got[3].types == [] and not got[2].has_address and got[2].invalid == 0


def test_robots_patterns(spark):
    text = "User-agent: bot\nCrawl-delay: 2\nUser-agent: *\nDisallow: /a$b\nDisallow: /x*y$\nAllow: /x*yy$\nDisallow: /p.q?r\nDisallow: *z\nDisallow: /same\nAllow: /same"
    rules = technical.parse_robots(spark.createDataFrame([("s", text)], "site string, text string"))
    paths = ["/a$b/1", "/a", "/xy", "/x1y", "/x1yy", "/x1yq", "/p.q?r=1", "/pzq", "/pXq?r", "/same/1", "/"]
    urls = spark.createDataFrame([("s", p) for p in paths] + [("t", "/a$b")], "site string, path string")
    found = technical.robots_allowed(urls, rules, "Other")
    assert {r.path for r in found.collect() if not r.allowed} == {"/a$b/1", "/xy", "/x1y", "/p.q?r=1", "/pzq"}
    # "bot" has a group without rules, so everything is open to it
    assert all(r.allowed for r in technical.robots_allowed(urls, rules, "MyBot").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_of_days_merge(spark):
    rows = spark.range(0, 60_000).select(F.lit("s").alias("site_id"), (F.col("id") % 30).alias("day"), (F.col("id") % 20_011).alias("url"), (F.col("id") % 7).alias("kind"))
    kept = content.daily_sketches(rows, "day", ["url", "kind"])
    r = content.merged_counts(kept, ["url", "kind"]).first()
    assert abs(r.url - 20_011) < 20_011 * 3 * 1.04 / 2**6 and r.kind == 7
    assert kept.select(F.max(F.length("url"))).first()[0] < 5_000
