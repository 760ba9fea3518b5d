"""Registered queries of site facts: technologies, JSON-LD, robots rules, tag tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import html
from plumbline.functions.text import host_of
from plumbline.operators import content, playbook, stack, structured, technical
from plumbline.operators import pages as pg
from plumbline.plans.pages import _ISSUES, HOST, REC
from plumbline.sources import driver_tables as src
from plumbline.sources import landed

#: What pages are given at the start of their body, by their id, and what their hosts answer with.
SNIPPETS = (
    '<meta name="generator" content="WordPress 6.4"><script src="/wp-content/A.js"></script>', '<script src="https://cdn.shopify.com/s.js"></script>', '<div id="__next"></div><script id="__NEXT_DATA__" src="/_next/static/x.js"></script>',
    "<div id=\"root\"></div><script src='/static/js/main.ab.js'></script>", '<div id="app"></div>', '<link rel="stylesheet" href="/css/Bootstrap.min.css"><script src="/js/jquery.js"></script>', '<meta content="Hugo 0.1" name=generator>',
    '<script src="/assets/index-abc123XY.js"></script>',
)


def _stacked(spark, sf):
    """The given pages with signs of their making; every fourth page is cut down to them."""
    p = src.pages(spark, sf)
    snippet = F.coalesce(F.get(F.array(*[F.lit(s) for s in SNIPPETS]), ((F.col("page_id") * 7 + F.length("site_id")) % 12).cast("int")), F.lit(""))
    k = F.col("page_id") % 7
    headers = F.when(k == 0, F.create_map(F.lit("Server"), F.lit("nginx/1.2"))).when(k == 1, F.create_map(F.lit("server"), F.lit("cloudflare"), F.lit("cf-ray"), F.lit("8f"))).when(k == 2, F.create_map(F.lit("X-Vercel-Id"), F.lit("iad1"))).when(k == 3, F.create_map(F.lit("server"), F.lit("Apache")))
    html = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<body>"), snippet, F.lit("</body>"))).otherwise(F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), snippet)))
    return stack.signals(p.select("site_id", "page_id", html.alias("html"), headers.alias("headers")))


def stack_technologies(spark, sf):
    return stack.technologies(_stacked(spark, sf)).select("site_id", "name", "kind", "confidence", F.size(F.split("evidence", r" \| ")).alias("n_evidence"))


def stack_detect(spark, sf):
    return stack.detect(_stacked(spark, sf))


def _ld(spark, sf):
    """Suppliers as local businesses: a page with two JSON-LD blocks each, every fifth with a broken one, wrapped in every way that pages use."""
    s, n, p = (src.table(spark, sf, t) for t in ("supplier", "nation", "part"))
    rows = s.join(n.hint("merge"), s.s_nationkey == n.n_nationkey)
    parts = p.select((F.col("p_partkey") % 50).alias("m"), "p_name").groupBy("m").agg(F.min("p_name").alias("p_name"))
    rows = rows.join(parts.hint("merge"), F.col("s_suppkey") % 50 == F.col("m"))
    key = F.col("s_suppkey").cast("string")
    country = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"@type":"Country","name":"'), "n_name", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"')))
    business = F.concat(
        F.lit('{"@context":"https://schema.org","@graph":[{"@type":["Organization","https://schema.org/Store"],"name":" '), "s_name", F.lit('","telephone":"+254 '), key, F.lit('","sameAs":['), F.when(F.col("s_suppkey") % 3 == 0, '"https://x.e"').otherwise(""),
        F.lit('],"geo":'), F.when(F.col("s_suppkey") % 4 == 0, '{"latitude":1}').otherwise("null"), F.lit(',"address":{"@type":"PostalAddress","streetAddress":"'), key, F.lit(' Road","addressCountry":'), country,
        F.lit('},"makesOffer":[{"@type":"Offer","price":5,"priceCurrency":"kes"},{"price":"6","priceCurrency":7}]},{"@type":"WebSite","publisher":{"@type":"Person"}}]}'),
    )
    faq = F.concat(F.lit('<!--[{"@type":"schema:FAQPage","mainEntity":[{"@type":"Question","name":"What  is '), "p_name", F.lit('?"},{"@type":"Question","name":"Why?"},{"@type":"Question","name":8}]}]-->'))
    broken = F.when(F.col("s_suppkey") % 5 == 0, '<script type="application/ld+json">{"@type":</script>').otherwise("")
    script = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    html = F.concat(F.lit("<html><head>"), script(business), broken, script(faq), F.lit("</head><body></body></html>"))
    url = F.concat(F.lit("https://supplier"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".example/"), key)
    pages = rows.select(host_of(url).alias("site_id"), F.col("s_suppkey").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    return structured.structured_facts(pg.records(pages))


def structured_data(spark, sf):
    f = F.col("ld_facts")
    joined = lambda k: F.array_join(F.array_sort(f[k]), "|").alias(k)
    return _ld(spark, sf).select("site_id", "page_id", *[joined(k) for k in ("types", "countries", "currencies", "telephones", "local_types", "names", "streets")], F.col("ld_facts.invalid").cast("long").alias("invalid"), *[f[k].alias(k) for k in ("has_address", "has_hours", "has_geo", "has_same_as")])


def faq_questions(spark, sf):
    return structured.faq_questions(_ld(spark, sf))


def _robots(spark, sf):
    """A robots file for each language, a line for every fifth document, and the documents' paths."""
    docs = src.table(spark, sf, "documents")
    k, kind = F.col("doc_id"), F.floor(F.col("doc_id") / 5) % 7
    line = (
        F.when(kind == 0, F.concat(F.lit("User-agent: "), F.when(k % 3 == 0, "*").otherwise(F.concat(F.lit("Bot"), (k % 2).cast("string"))))).when(kind == 1, F.concat(F.lit("Disallow: /"), "source", F.lit("/"), (k % 100).cast("string"), F.lit(" # old")))
        .when(kind == 2, F.concat(F.lit("Allow: /"), "source", F.lit("/*"), (k % 10).cast("string"), F.lit("$"))).when(kind == 3, F.concat(F.lit("disallow : /*/"), (k % 9).cast("string"), F.lit("*x=1"))).when(kind == 4, "Disallow:")
        .when(kind == 5, F.concat(F.lit("Allow: /"), "source", F.lit("/"), (k % 100).cast("string"))).otherwise(F.when(k % 2 == 0, "Crawl-delay: 3").otherwise("Sitemap: https://e.example/s.xml"))
    )
    files = docs.where("doc_id % 5 = 0").groupBy(F.col("lang").alias("site")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    paths = docs.select(F.col("lang").alias("site"), F.concat(F.lit("/"), "source", F.lit("/"), (k % 997).cast("string"), F.when(k % 4 == 0, "?x=1").otherwise("")).alias("path")).distinct()
    return technical.parse_robots(files), paths


def robots_rules(spark, sf):
    return _robots(spark, sf)[0].groupBy("site", "group_id", "agent", "allow", "pattern").agg(F.count("*").alias("times"))


def robots_blocked(spark, sf):
    """What two agents may fetch: one that has groups of its own, one that has none."""
    rules, paths = _robots(spark, sf)
    parts = [technical.robots_allowed(paths, rules, a).withColumn("agent", F.lit(a)) for a in ("MyBot1/2.0", "other")]
    return parts[0].unionByName(parts[1])


def robots_blocks_site(spark, sf):
    rules, paths = _robots(spark, sf)
    return technical.blocks_site(paths, rules, "bot0")


def _sitemaps(spark, sf):
    """An index and two sitemaps for each site of the pages, one of them with prefixes and references, the other with sections; some are cut off, some are not there."""
    p = src.pages(spark, sf).select("site_id", "page_id", "url").withColumn("half", F.col("page_id") % 2)
    loc = F.when(F.col("half") == 0, F.concat(F.lit("<s:url><s:loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("?a=1&amp;b </s:loc><s:lastmod>2024</s:lastmod></s:url>"))).otherwise(F.concat(F.lit("<url>\n<loc><![CDATA["), "url", F.lit("]]></loc></url>")))
    maps = p.groupBy("site_id", "half").agg(F.array_join(F.array_sort(F.collect_list(loc)), "").alias("locs"))
    short = F.length("site_id") % 4 == 0
    body = F.when(F.col("half") == 0, F.concat(F.lit('<?xml version="1.0"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">'), "locs", F.lit("</s:urlset>"))).otherwise(F.concat(F.lit("<urlset>"), "locs", F.when(short, "<url><loc>https://cut").otherwise("</urlset>")))
    name = lambda k: F.concat(F.lit("https://"), "site_id", F.lit("/map-"), k, F.lit(".xml"))
    children = maps.select(F.col("site_id").alias("site"), name(F.col("half").cast("string")).alias("url"), body.alias("body"))
    sites = p.select("site_id").distinct()
    entry = lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))
    index = F.concat(F.lit("<sitemapindex>"), entry(name(F.lit("0"))), entry(name(F.lit("1"))), entry(F.lit("https://elsewhere.example/map.xml")), entry(name(F.lit("index"))), F.lit("</sitemapindex>"))
    files = children.unionByName(sites.select(F.col("site_id").alias("site"), name(F.lit("index")).alias("url"), index.alias("body")))
    return landed.sitemap_urls(files, sites.select(F.col("site_id").alias("site"), name(F.lit("index")).alias("url")))


def sitemap_urls(spark, sf):
    return _sitemaps(spark, sf)[0]


def sitemap_states(spark, sf):
    return _sitemaps(spark, sf)[1]


def html_tags(spark, sf):
    """Tags of every page by name, with the links that they hold, by the table function."""
    html.register_html_tags(spark)
    src.pages(spark, sf).select("page_id", "html").createOrReplaceTempView("plumbline_tagged_pages")
    rows = spark.sql("select p.page_id, t.pos, t.name, t.attrs, t.text from plumbline_tagged_pages p, lateral html_tags(p.html) t")
    return rows.groupBy("page_id", "name").agg(F.count("*").alias("tags"), F.array_join(F.array_sort(F.collect_list(F.col("attrs")["href"])), " ").alias("hrefs"), F.min("pos").cast("long").alias("first"))


def distinct_by_day(spark, sf):
    """Pages and queries of each site, exactly and by merging the sketches of its days."""
    log = src.search_log(spark, sf)
    exact = content.distinct_counts(log, ["page", "query"])
    merged = content.merged_counts(content.daily_sketches(log, "date", ["page", "query"]), ["page", "query"]).withColumnsRenamed({c: f"{c}_about" for c in ("page", "query")})
    near = lambda c: (F.abs(F.col(f"{c}_about") - F.col(c)) <= F.greatest(F.lit(1), F.col(c) * 0.05)).alias(f"{c}_near")
    return exact.join(merged.hint("merge"), "site_id").select("site_id", "page", "query", near("page"), near("query"))


def _scorecard(spark, sf):
    """Page faults of the sites, counts and findings by their name's length, marks by customers."""
    r = pg.records(src.pages(spark, sf))
    sites = r.select("site_id").distinct()
    k = F.length("site_id")
    n = lambda m, x: F.struct(F.lit(m).alias("measure"), x.cast("long").alias("n"))
    counts = sites.select("site_id", F.explode(F.array(n("pages", k), n("search_rows", k % 2), n("keywords", k), n("questions", k % 6), n("refresh_pages", k % 5), n("competitors", k % 4), n("faq_pages", k % 4))).alias("c")).select("site_id", "c.*")
    found = sites.select("site_id", F.explode(F.array_compact(F.array(F.when(k % 3 == 0, "tech_redirect_loops"), F.when(k % 4 == 1, "tech_noindex_pages"), F.when(k % 5 == 2, "tech_no_robots")))).alias("finding"))
    marks = sites.select("site_id", F.explode(F.array(F.struct(F.lit("s_bing").alias("item"), F.lit("done").alias("mark")), F.struct(F.lit("l_gbp").alias("item"), F.lit("na").alias("mark")), F.struct(F.lit("o_title").alias("item"), F.when(k % 2 == 0, "na").alias("mark")))).alias("m")).select("site_id", "m.*")
    shares = playbook.page_shares(r, pg.issues(r)).unionByName(sites.select("site_id", F.lit("citations").alias("measure"), (k % 3).cast("long").alias("bad"), F.lit(2).cast("long").alias("of")))
    return playbook.items(sites, shares, counts, found, marks)


def scorecard_items(spark, sf):
    return _scorecard(spark, sf)


def scorecard(spark, sf):
    return playbook.rollup(_scorecard(spark, sf))


QUERIES = {f.__name__: f for f in (stack_technologies, stack_detect, structured_data, faq_questions, robots_rules, robots_blocked, robots_blocks_site, sitemap_urls, sitemap_states, html_tags, distinct_by_day, scorecard_items, scorecard)}

_STACK = f"""st as (select *, (page_id*7+length(site_id))%12 as k, page_id%7 as h, page_id%4 = 0 as cut from (select *, {HOST} as site_id from pages)),
  hit as (select distinct site_id, unnest(case k when 0 then [1, 2, 3] when 1 then [4] when 2 then [5, 6] when 3 then [7, 8] when 4 then [9] when 5 then [10, 11] when 6 then [12] when 7 then [13] else [] end) as r from st),
  head as (select site_id, arg_min(h, page_id) filter (where h in (0, 1, 3)) as server, bool_or(h = 1) as ray, bool_or(h = 2) as vercel from st group by site_id),
  tech as (select site_id, name, kind, sum(w) as w, count(*) as n, min(r) as place from hit join (values (1, 'WordPress', 'cms', 3), (2, 'WordPress', 'cms', 3), (3, 'WordPress', 'cms', 1), (4, 'Shopify', 'cms', 3), (5, 'Next.js', 'framework', 3), (6, 'Next.js', 'framework', 3),
    (7, 'React', 'framework', 2), (8, 'React', 'framework', 1), (9, 'Vue', 'framework', 1), (10, 'jQuery', 'library', 3), (11, 'Bootstrap', 'library', 3), (12, 'Hugo', 'static-generator', 3), (13, 'Vite build', 'tooling', 2)) t(r, name, kind, w) using (r) group by site_id, name, kind having name <> 'Vue'),
  hosts as (select site_id, 'Vercel' as name, 3 as w, 1 as n, 1 as place from head where vercel union all select site_id, 'Cloudflare (CDN or Pages)', 2*(case when server = 1 then 1 else 0 end + ray::int), case when server = 1 then 1 else 0 end + ray::int, 2 from head where ray
    union all select site_id, case server when 0 then 'nginx' else 'Apache' end, 1, 1, 3 from head where server in (0, 3) and not vercel and not ray),
  every as (select site_id, name, kind, w, n, case name when 'WordPress' then 1 when 'Shopify' then 2 when 'Next.js' then 3 when 'React' then 4 when 'Vite build' then 5 when 'Hugo' then 6 when 'jQuery' then 7 else 8 end as place from tech union all select site_id, name, 'hosting', w, n, place from hosts)"""

_ROBOTS = """ln as (select lang as site, doc_id as k, case doc_id//5%7 when 0 then 'user-agent' when 1 then 'disallow' when 2 then 'allow' when 3 then 'disallow' when 4 then 'disallow' when 5 then 'allow' else case when doc_id%2 = 0 then 'crawl-delay' else 'sitemap' end end as key,
    case doc_id//5%7 when 0 then case when doc_id%3 = 0 then '*' else 'Bot'||doc_id%2 end when 1 then '/'||source||'/'||doc_id%100 when 2 then '/'||source||'/*'||doc_id%10||'$' when 3 then '/*/'||doc_id%9||'*x=1' when 5 then '/'||source||'/'||doc_id%100 else '' end as value from documents where doc_id%5 = 0),
  ag as (select *, coalesce(lag(key) over (partition by site order by k), '') as before from ln where key <> 'sitemap'), gr as (select *, sum(case when key = 'user-agent' and before <> 'user-agent' then 1 else 0 end) over (partition by site order by k) as group_id from ag),
  rules as (select a.site, a.group_id, a.agent, r.key = 'allow' as allow, r.value as pattern, r.k from (select distinct site, group_id, lower(value) as agent from gr where key = 'user-agent') a left join gr r on r.site = a.site and r.group_id = a.group_id and r.key in ('allow', 'disallow') and r.value <> ''),
  paths as (select distinct lang as site, '/'||source||'/'||doc_id%997||case when doc_id%4 = 0 then '?x=1' else '' end as path from documents)"""
_ALLOWED = lambda paths, agent, own: f"""select p.site, p.path, coalesce((select arg_max(r.allow, (length(r.pattern), r.allow)) from rules r where r.site = p.site and r.agent = case when exists (select 1 from rules o where o.site = p.site and o.agent = '{own}') then '{own}' else '*' end and r.pattern is not null
  and regexp_matches(p.path, '^'||replace(replace(replace(r.pattern, '?', '\\?'), '.', '\\.'), '*', '.*'))), true) as allowed, '{agent}' as agent from {paths} p"""  # noqa: E731

_MANUAL = "setup s_bing s_ga4 s_plugin s_submit s_manual technical t_toxic t_dupver onpage o_stuffing local l_nearme l_geoimages content c_intent c_snippets c_audit c_lists c_readability offpage f_analyze f_gap f_pr f_mentions f_social f_haro f_ugc f_influencer f_monitor advanced a_voice a_ai a_eeat a_trends a_zeroclick a_programmatic a_youtube ai ai_crawlers ai_llms"
_SHARED = "technical t_mobile no_viewport, technical t_canonical missing_canonical, technical t_schema no_schema, onpage o_title missing_title|long_title, onpage o_meta missing_description|long_description, onpage o_h1 missing_h1|many_h1, onpage o_headings heading_skip, onpage o_url long_url, onpage o_alt missing_alt, onpage o_anchors vague_anchors, content c_depth thin"
_UNSEEN = "technical t_cwv, technical t_clean_urls, technical t_302, technical t_http_links, technical t_depth, onpage o_early, onpage o_links, onpage o_orphan, local l_nap, local l_pages, content c_cannibal, ai ai_structure"
_TODO = "content c_comp_kw, content c_clusters, offpage f_links, offpage f_find, offpage f_guest, offpage f_directory, ai ai_visibility"
_PASSES = "technical t_links, technical t_sitemap, local l_schema"
_pairs = lambda text: ", ".join("('" + "', '".join(x.split()) + "')" for x in text.split(", "))


def _manual() -> str:
    rows, group = [], ""
    for word in _MANUAL.split():
        if "_" in word:
            rows.append(f"('{group}', '{word}')")
        else:
            group = word
    return ", ".join(rows)


_CARD = f"""{REC}, {_ISSUES}, s as (select site_id, length(site_id) as k, count(*) as n, count(*) filter (where images = 0) as bare from rec group by site_id),
  shared as (select s.site_id, grp, item, s.n, (select count(distinct page_id) from iss where iss.site_id = s.site_id and list_contains(string_split(rules, '|'), rule)) as bad from s, (values {_pairs(_SHARED)}) v(grp, item, rules)),
  raw as (select site_id, grp, item, case when bad = 0 then 'pass' when bad*5 <= n then 'warn' else 'fail' end as status from shared union all select site_id, 'content', 'c_visuals', case when bare = 0 then 'pass' when bare*5 <= n then 'warn' else 'fail' end from s
    union all select site_id, grp, item, 'unknown' from s, (values {_pairs(_UNSEEN)}) v(grp, item) union all select site_id, grp, item, 'todo' from s, (values {_pairs(_TODO)}) v(grp, item) union all select site_id, grp, item, 'pass' from s, (values {_pairs(_PASSES)}) v(grp, item)
    union all select site_id, grp, item, case when item = 's_bing' then 'pass' else 'todo' end from s, (values {_manual()}) v(grp, item)
    union all select site_id, 'setup', 's_gsc', case when k%2 = 1 then 'pass' else 'todo' end from s union all select site_id, 'advanced', 'a_shifts', case when k%2 = 1 then 'pass' else 'todo' end from s union all select site_id, 'setup', 's_index', case when k%4 = 1 then 'warn' else 'pass' end from s
    union all select site_id, 'technical', 't_https', 'pass' from s union all select site_id, 'technical', 't_robots', case when k%5 = 2 then 'warn' else 'pass' end from s union all select site_id, 'technical', 't_crawl', case when k%3 = 0 then 'fail' else 'pass' end from s
    union all select site_id, 'technical', 't_redirects', case when k%3 = 0 then 'fail' else 'pass' end from s union all select site_id, 'local', 'l_gbp', 'na' from s union all select site_id, 'local', 'l_reviews', 'todo' from s union all select site_id, 'local', 'l_citations', case k%3 when 0 then 'pass' when 1 then 'warn' else 'todo' end from s
    union all select site_id, 'content', 'c_related', case when k >= 10 then 'pass' else 'warn' end from s union all select site_id, 'content', 'c_paa', case when k%6 >= 5 then 'pass' when k%6 > 0 then 'warn' else 'todo' end from s union all select site_id, 'content', 'c_refresh', case when k%5 = 0 then 'pass' when k%5 > 3 then 'fail' else 'warn' end from s
    union all select site_id, 'content', 'c_faq', case when k%4 >= 3 then 'pass' when k%4 > 0 then 'warn' else 'fail' end from s union all select site_id, 'advanced', 'a_competitors', case when k%4 >= 3 then 'pass' when k%4 > 0 then 'warn' else 'todo' end from s),
  card as (select site_id, grp, item, case when item = 'o_title' and length(site_id)%2 = 0 then 'na' else status end as status from raw)"""

ORACLE_SQL = {
    "scorecard_items": f"with {_CARD} select site_id, grp as \"group\", item, status from card",
    "scorecard": f"""with {_CARD} select site_id, coalesce(grp, 'all') as \"group\", count(*) as items, count(*) filter (where status in ('pass', 'warn', 'fail', 'todo')) as measured, count(*) filter (where status = 'unknown') as unknown,
  cast(floor(sum(case status when 'pass' then 1 when 'warn' then 0.5 else 0 end)/nullif(count(*) filter (where status in ('pass', 'warn', 'fail', 'todo')), 0)*100+0.5) as bigint) as score from card group by grouping sets ((site_id, grp), (site_id))""",
    "robots_rules": f"with {_ROBOTS} select site, cast(group_id as bigint) as group_id, agent, allow, pattern, count(*) as times from rules group by all",
    "robots_blocked": f"with {_ROBOTS} {_ALLOWED('paths', 'MyBot1/2.0', 'bot1')} union all {_ALLOWED('paths', 'other', '-')}",
    "robots_blocks_site": f"with {_ROBOTS}, tried as (select distinct site, unnest(['/', '/about', '/blog/post', '/products/item-1?x=1']) as path from paths) select site, not bool_or(allowed) as blocked from ({_ALLOWED('tried', 'x', 'bot0')}) group by site",
    "sitemap_urls": f"select {HOST} as site, case when page_id%2 = 0 then url||'?a=1&b' else url end as loc, 'https://'||{HOST}||'/map-'||min(page_id%2)||'.xml' as sitemap from pages group by 1, 2",
    "sitemap_states": f"""with s as (select distinct {HOST} as site from pages) select site, 'https://'||site||'/map-index.xml' as sitemap, 'read' as state from s union all select site, 'https://'||site||'/map-'||k||'.xml', case when not exists (select 1 from pages where {HOST} = s.site and page_id%2 = k) then 'missing' when k = 1 and length(site)%4 = 0 then 'broken' else 'read' end from s, range(0, 2) r(k)""",
    "html_tags": """with t as (select page_id, unnest(l) as name, generate_subscripts(l, 1)-1 as pos from (select page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)', 1) as l from pages)), h as (select page_id, list_transform(regexp_extract_all(html, '<a href="([^"]+)"', 1), lambda x: replace(x, '&amp;', '&')) as hrefs from pages)
  select t.page_id, name, count(*) as tags, case when name = 'a' then array_to_string(list_sort(any_value(hrefs)), ' ') else '' end as hrefs, min(pos) as first from t join h on h.page_id = t.page_id group by t.page_id, name""",
    "distinct_by_day": f"with {src.SEARCH_LOG} select site_id, count(distinct page) as page, count(distinct query) as query, true as page_near, true as query_near from search_log group by site_id",
    "structured_data": """select 'supplier'||s_suppkey%10||'.example' as site_id, s_suppkey as page_id, 'FAQPage|Organization|Store|WebSite' as types, n_name as countries, 'KES' as currencies, '+254 '||s_suppkey as telephones, 'Store' as local_types, s_name as names, s_suppkey||' Road' as streets,
  case when s_suppkey%5 = 0 then 1 else 0 end as invalid, true as has_address, false as has_hours, s_suppkey%4 = 0 as has_geo, true as has_same_as from supplier join nation on s_nationkey = n_nationkey where s_suppkey%50 in (select p_partkey%50 from part)""",
    "faq_questions": """select 'supplier'||s_suppkey%10||'.example' as site_id, s_suppkey as page_id, 0 as place, 'What is '||p_name||'?' as question from supplier join (select p_partkey%50 as m, min(p_name) as p_name from part group by 1) on m = s_suppkey%50""",
    "stack_technologies": f"with {_STACK} select site_id, name, kind, case when w >= 3 then 'high' when w = 2 then 'medium' else 'low' end as confidence, n as n_evidence from every",
    "stack_detect": f"""with {_STACK}, per as (select site_id, string_agg(name, ' + ' order by place) filter (where kind <> 'hosting') as technologies, string_agg(name, ' + ' order by place) filter (where kind = 'hosting') as hosting,
    string_agg(name, ' + ' order by place) filter (where kind not in ('hosting', 'library', 'tooling') and w > 1) as lead, bool_or(kind = 'cms') as platform, bool_or(name = 'Next.js') as pre, bool_or(kind = 'static-generator') as gen, bool_or(kind = 'framework') as fw from every group by site_id),
  pg as (select site_id, count(*) as pages, count(*) filter (where cut and k in (2, 3)) as client_pages from st group by site_id),
  r as (select pg.site_id, pages, client_pages, technologies, hosting, lead, platform, gen, fw, case when client_pages*2 >= pages then 'client-rendered' when client_pages > 0 then 'mixed' when platform then 'platform-rendered' when pre then 'pre-rendered' when gen then 'static-generated' when fw then 'unknown-framework-rendering' else 'static-html' end as rendering from pg left join per on per.site_id = pg.site_id)
  select site_id, concat_ws(' · ', coalesce(lead, case rendering when 'client-rendered' then 'Renders in the browser (content appears after JavaScript runs)' when 'mixed' then 'Some pages render in the browser' else 'Plain HTML' end), 'on '||string_split(hosting, ' + ')[1], case when rendering in ('client-rendered', 'mixed') then 'renders in the browser' end) as summary,
  rendering, client_pages, pages, coalesce(hosting, '') as hosting, coalesce(technologies, '') as technologies, case when platform then 'low' when gen or fw then 'medium' when rendering = 'static-html' then 'high' else 'unknown' end as pull_requests from r""",
}
