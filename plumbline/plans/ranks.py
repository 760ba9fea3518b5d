"""Registered rank, search-result and link-graph queries and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from plumbline.operators import links, ranks
from plumbline.sources import driver_tables as src

NOW = datetime.datetime(1998, 7, 1)
GENERIC, OWN = ["host3.example.com", "host7.example.com"], "host5.example.com"


def rank_summary(spark, sf):
    return ranks.rank_summary(src.rank_snapshots(spark, sf))


def rank_best_so_far(spark, sf):
    return ranks.best_so_far(src.rank_snapshots(spark, sf))


def latest_two_checks(spark, sf):
    return ranks.latest_n(src.rank_snapshots(spark, sf), 2)


def _keywords(spark, sf):
    last = src.rank_snapshots(spark, sf).groupBy("keyword_id").agg(F.max("checked_at").alias("last_checked_at"))
    every = src.table(spark, sf, "customer").select((F.col("c_custkey") % 3).cast("long").alias("site_id"), F.col("c_custkey").cast("long").alias("keyword_id"), (F.col("c_acctbal") > 0).alias("active"))
    return every.join(last, "keyword_id", "left")


def due_keywords(spark, sf):
    return ranks.due_keywords(_keywords(spark, sf), NOW, 30, 50).select("site_id", "keyword_id", "last_checked_at")


def budget_used(spark, sf):
    return ranks.budget_used(src.rank_snapshots(spark, sf))


def budget_gate(spark, sf):
    used = ranks.budget_used(src.rank_snapshots(spark, sf)).where(F.col("month") == F.lit(datetime.date(1997, 7, 1)))
    return ranks.budget_gate(due_keywords(spark, sf), used, monthly=90, per_run=40, reserve=10)


def ignore_duplicates(spark, sf):
    """Keywords of the orders' customers that are not tracked yet, up to 25 a site."""
    current = src.table(spark, sf, "customer").where("c_acctbal > 0 and c_custkey % 70 = 0").select((F.col("c_custkey") % 3).cast("long").alias("site_id"), F.col("c_custkey").cast("long").alias("keyword_id"))
    incoming = src.rank_snapshots(spark, sf).select("site_id", "keyword_id")
    return ranks.ignore_duplicates(current, incoming, ["site_id", "keyword_id"], 25)


def last_checked(spark, sf):
    """Keywords with their last check after the snapshots are appended."""
    keywords = src.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("keyword_id"))
    return ranks.with_last_checked(keywords, src.rank_snapshots(spark, sf))


def property_match(spark, sf):
    """The best search property of each supplier's host."""
    hosts = src.table(spark, sf, "supplier").select(F.concat(F.lit("shop"), F.col("s_suppkey").cast("string"), F.lit(".nation"), F.col("s_nationkey").cast("string"), F.lit(".example.com")).alias("site"), "s_suppkey", "s_nationkey")
    exact = hosts.where("s_suppkey % 3 = 0").select(F.concat(F.lit("https://"), "site", F.lit("/")).alias("property"))
    domain = hosts.where("s_suppkey % 5 = 0").select(F.concat(F.lit("sc-domain:"), "site").alias("property"))
    parent = hosts.where("s_nationkey < 12").select(F.concat(F.lit("sc-domain:nation"), F.col("s_nationkey").cast("string"), F.lit(".example.com")).alias("property")).distinct()
    return ranks.property_match(hosts.select("site"), exact.union(domain).union(parent))


def serp_prospects(spark, sf):
    results = src.serp_results(spark, sf)
    return ranks.prospects(results, spark.createDataFrame([(h,) for h in [*GENERIC, OWN]], "host string"))


def serp_owners(spark, sf):
    return ranks.owners(src.serp_results(spark, sf), GENERIC, OWN, 12)


def site_rank(spark, sf):
    sites = src.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("host"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("site"))
    return ranks.site_rank(src.serp_results(spark, sf), sites)


def _two_lists(spark, sf):
    two = ranks.latest_n(src.rank_snapshots(spark, sf), 2).select("keyword_id", "place", F.col("snapshot_id").alias("check_id"))
    rows = src.serp_results(spark, sf).join(two, "check_id")
    return rows.where("place = 1"), rows.where("place = 2")


def serp_movement(spark, sf):
    return ranks.movement(*_two_lists(spark, sf))


def serp_opportunities(spark, sf):
    """Orders as saved checks of two sites, suppliers' hosts as results, parts as the sites' pages, events as demand."""
    k = F.col("o_orderkey")
    colour = F.element_at(F.array(F.lit("Red"), F.lit("blu"), F.lit("small"), F.lit("een b"), F.lit("zzz")), (k % 5 + 1).cast("int"))
    checks = src.table(spark, sf, "orders").select(
        k.cast("long").alias("check_id"), F.when(k % 2 == 0, OWN).otherwise("host8.example.com").alias("site_id"), F.concat(colour, F.lit(" "), F.element_at(F.array(F.lit("ring"), F.lit("bolt"), F.lit("")), (k % 3 + 1).cast("int"))).alias("query"), F.col("o_orderdate").cast("timestamp").alias("observed_at"),
    )
    part = src.table(spark, sf, "part")
    pages = part.select(F.when(F.col("p_partkey") % 2 == 0, OWN).otherwise("host8.example.com").alias("site_id"), F.col("p_partkey").cast("long").alias("page_ord"), F.concat(F.lit("/p/"), "p_partkey").alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("h1"))
    events = src.table(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, OWN).otherwise("host8.example.com").alias("site_id"), F.element_at(F.array(F.lit("RED ring"), F.lit("small bolt"), F.lit("zzz ")), (F.col("user_id") % 3 + 1).cast("int")).alias("query"), F.col("user_id"))
    demand = events.where("user_id % 7 = 0").groupBy("site_id", "query").agg(F.count("*").alias("impressions"))
    tracked = events.where("user_id = 11").select("site_id", "query")
    return ranks.check_opportunities(checks, src.serp_results(spark, sf), pages, demand, tracked, datetime.datetime(2001, 7, 31))


def tracked_results(spark, sf):
    results = src.serp_results(spark, sf).select("check_id", "host", "rank", F.concat(F.lit("Q"), (F.col("check_id") % 40).cast("string")).alias("query"), F.lit("us").alias("country"), F.lit("desktop").alias("device"))
    tracked = src.table(spark, sf, "supplier").select(F.concat(F.lit("host"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("host"), F.concat(F.lit("q"), (F.col("s_suppkey") % 40).cast("string")).alias("query"), F.lit("us").alias("country"), F.lit("desktop").alias("device"), (F.col("s_nationkey") < 12).alias("active"))
    return ranks.tracked_only(results, tracked).select("check_id", "host", "rank", "query")


def inbound_links(spark, sf):
    return links.inbound(src.link_edges(spark, sf), unique=True)


def orphans(spark, sf):
    return links.orphans(src.link_pages(spark, sf), src.link_edges(spark, sf))


def weak_pages(spark, sf):
    return links.weak_pages(src.link_pages(spark, sf), src.link_edges(spark, sf))


def click_depth(spark, sf):
    return links.click_depth(src.link_pages(spark, sf), src.link_edges(spark, sf))


def fetch_kinds(spark, sf):
    return src.fetch_status(spark, sf).groupBy("site_id", links.fetch_kind().alias("kind")).agg(F.count("*").alias("pages"))


def broken_links(spark, sf):
    return links.linked_status(src.fetch_status(spark, sf), src.link_edges(spark, sf), src.link_pages(spark, sf)).where("kind = 'broken'")


def _sitemap(spark, sf):
    return src.table(spark, sf, "part").where("p_size > 15").select((F.col("p_partkey") % 4).cast("long").alias("site_id"), F.col("p_partkey").cast("long").alias("page"))


def sitemap_errors(spark, sf):
    return links.sitemap_vs_status(_sitemap(spark, sf), src.fetch_status(spark, sf))


def _noindex(spark, sf):
    return src.table(spark, sf, "part").where("p_size % 10 = 3").select((F.col("p_partkey") % 4).cast("long").alias("site_id"), F.col("p_partkey").cast("long").alias("page"))


def sitemap_conflicts(spark, sf):
    pages = src.table(spark, sf, "part").select((F.col("p_partkey") % 4).cast("long").alias("site_id"), F.col("p_partkey").cast("long").alias("page"), (F.col("p_size") % 10 == 3).alias("noindex"), F.when(F.col("p_size") % 9 == 0, "other_page").otherwise("self").alias("canonical_state"))
    return links.sitemap_vs_pages(_sitemap(spark, sf), pages)


def sitemap_missing(spark, sf):
    complete = src.link_pages(spark, sf).where("site_id < 3").select("site_id").distinct()
    return links.sitemap_missing(src.fetch_status(spark, sf), src.link_edges(spark, sf), _sitemap(spark, sf), complete, _noindex(spark, sf))


def _canonicals(spark, sf):
    return src.link_edges(spark, sf).groupBy("site_id", F.col("src").alias("page")).agg(F.min("dst").alias("target"))


def canonical_targets(spark, sf):
    return links.canonical_targets(_canonicals(spark, sf), src.fetch_status(spark, sf), _noindex(spark, sf))


def resolved_links(spark, sf):
    aliases = src.fetch_status(spark, sf).where("status = 301").select("site_id", F.col("page").alias("requested"), (F.col("page") + 4).alias("landed"))
    return links.inbound(links.resolved(src.link_edges(spark, sf), aliases))


def check_frontier(spark, sf):
    known = src.fetch_status(spark, sf).where("status = 200").select("site_id", "page")
    return links.check_frontier(src.link_edges(spark, sf), _sitemap(spark, sf), _canonicals(spark, sf), known, _noindex(spark, sf))


QUERIES = {f.__name__: f for f in (
    rank_summary, rank_best_so_far, latest_two_checks, due_keywords, budget_used, budget_gate, ignore_duplicates, last_checked, property_match, serp_prospects, serp_owners, site_rank, serp_movement, serp_opportunities, tracked_results,
    inbound_links, orphans, weak_pages, click_depth, fetch_kinds, broken_links, sitemap_errors, sitemap_conflicts, sitemap_missing, canonical_targets, resolved_links, check_frontier,
)}

_KIND = "case when status = 404 then 'broken' when status = 301 then 'redirect' else 'ok' end"
_DUE = """due as (select c_custkey%3 as site_id, c_custkey as keyword_id, last_checked_at from customer left join (select keyword_id, max(checked_at) as last_checked_at from rank_snapshots group by 1) on keyword_id = c_custkey
  where c_acctbal > 0 and (last_checked_at is null or date_diff('second', cast(last_checked_at as timestamp), timestamp '1998-07-01') / 86400 >= 30 - 2/24)
  qualify row_number() over (partition by c_custkey%3 order by last_checked_at nulls first, c_custkey) <= 50)"""
_TWO = """two as (select keyword_id, snapshot_id, row_number() over (partition by keyword_id order by checked_at desc, snapshot_id desc) as place from rank_snapshots qualify place <= 2),
  lists as (select keyword_id, place, host, min(rank) as rank from serp_results join two on check_id = snapshot_id group by all)"""
_IN = "inb as (select site_id, dst, count(*) as links, count(distinct src) as sources, min(src) as first_source from link_edges where src <> dst group by site_id, dst)"
_MAP = "sitemap as (select p_partkey%4 as site_id, p_partkey as page from part where p_size > 15), hidden as (select p_partkey as page from part where p_size%10 = 3)"
_CAN = "can as (select site_id, src as page, min(dst) as target from link_edges group by site_id, src)"
_W = lambda *c: "with " + ",\n".join(c) + "\n"

ORACLE_SQL = {
    "rank_summary": _W(src.RANK_SNAPSHOTS) + """select keyword_id, count(*) as checks, l[-1] as latest, case when len(l) > 1 then l[-2] end as previous, case when len(l) > 1 then l[-2] end - l[-1] as change, best,
  array_to_string(list_transform(l, lambda x: coalesce(cast(x as varchar), '-')), ',') as series from (select keyword_id, list(position order by checked_at, snapshot_id) as l, min(position) as best from rank_snapshots group by 1)
  , (select 1) group by keyword_id, l, best""".replace("count(*) as checks", "cast(len(l) as bigint) as checks"),
    "rank_best_so_far": _W(src.RANK_SNAPSHOTS) + """select keyword_id, snapshot_id, position, lag(position) over w as previous, lag(position) over w - position as change,
  min(position) over (partition by keyword_id order by checked_at, snapshot_id rows between unbounded preceding and current row) as best_so_far from rank_snapshots window w as (partition by keyword_id order by checked_at, snapshot_id)""",
    "latest_two_checks": _W(src.RANK_SNAPSHOTS) + "select *, row_number() over (partition by keyword_id order by checked_at desc, snapshot_id desc) as place from rank_snapshots qualify place <= 2",
    "due_keywords": _W(src.RANK_SNAPSHOTS, _DUE) + "select * from due",
    "budget_used": _W(src.RANK_SNAPSHOTS) + "select site_id, cast(date_trunc('month', checked_at) as date) as month, count(*) as used, count(distinct checked_at) as days from rank_snapshots group by site_id, cast(date_trunc('month', checked_at) as date)",
    "budget_gate": _W(src.RANK_SNAPSHOTS, _DUE, "used as (select site_id, count(*) as used from rank_snapshots where date_trunc('month', checked_at) = date '1997-07-01' group by site_id)") + "select due.*, row_number() over (partition by due.site_id order by last_checked_at nulls first, keyword_id) as place from due left join used on due.site_id = used.site_id qualify place <= greatest(0, least(40, 80 - coalesce(used.used, 0)))",
    "ignore_duplicates": _W(src.RANK_SNAPSHOTS, "cur as (select c_custkey%3 as site_id, c_custkey as keyword_id from customer where c_acctbal > 0 and c_custkey%70 = 0)") + "select i.site_id, keyword_id from (select distinct site_id, keyword_id from rank_snapshots where keyword_id not in (select keyword_id from cur)) i left join (select site_id, count(*) as n from cur group by site_id) c on c.site_id = i.site_id qualify row_number() over (partition by i.site_id order by keyword_id) <= 25 - coalesce(n, 0)",
    "last_checked": "select c_custkey as keyword_id, max(o_orderdate)::date as last_checked_at from customer left join orders on o_custkey = c_custkey group by c_custkey",
    "property_match": """select 'shop'||s_suppkey||'.nation'||s_nationkey||'.example.com' as site, case when s_suppkey%3 = 0 then 'https://shop'||s_suppkey||'.nation'||s_nationkey||'.example.com/' when s_suppkey%5 = 0 then 'sc-domain:shop'||s_suppkey||'.nation'||s_nationkey||'.example.com'
  when s_nationkey < 12 then 'sc-domain:nation'||s_nationkey||'.example.com' end as property, case when s_suppkey%3 = 0 then 3 when s_suppkey%5 = 0 then 2 when s_nationkey < 12 then 1 end as points from supplier""",
    "serp_prospects": _W(src.SERP_RESULTS) + f"select host, count(*) as appearances, min(rank) as best_rank, floor(avg(rank)*100+0.5)/100 as avg_rank from (select check_id, host, min(rank) as rank from serp_results group by all) where host not in {(*GENERIC, OWN)} group by host",
    "serp_owners": _W(src.SERP_RESULTS) + f"select host, count(*) as keywords, floor(avg(rank)*10+0.5)/10 as avg_rank, min(rank) as best_rank from (select check_id, host, min(rank) as rank from serp_results group by all) where host not in {(*GENERIC, OWN)} group by host order by keywords desc, avg_rank, host limit 12",
    "site_rank": _W(src.SERP_RESULTS) + "select check_id, host as site, min(rank) as rank, host from serp_results where host in (select 'host'||s_suppkey||'.example.com' from supplier where s_acctbal > 0) group by check_id, host",
    "serp_movement": _W(src.SERP_RESULTS, src.RANK_SNAPSHOTS, _TWO) + """select coalesce(a.keyword_id, b.keyword_id) as keyword_id, coalesce(a.host, b.host) as host, a.rank as rank_now, b.rank as rank_before, b.rank - a.rank as change,
  b.rank is null and coalesce(a.keyword_id, b.keyword_id) in (select keyword_id from lists where place = 2) as is_new, a.rank is null as dropped
  from (select * from lists where place = 1) a full join (select * from lists where place = 2) b on a.keyword_id = b.keyword_id and a.host = b.host""",
    "serp_opportunities": _W(src.SERP_RESULTS) + f"""select check_id, site_id, query, rank, case when rank is null then 'not in results' else 'room to climb' end as kind, case when (rank is null and (impressions >= 50 or is_tracked)) or (rank is not null and impressions >= 100) then 'High' else 'Medium' end as priority,
  case when age > 14 then 'Low' else 'Medium' end as confidence, age as age_days, array_to_string(list_transform(list_filter(listed, lambda x: rank is null or x.r < rank)[1:3], lambda x: x.h), ', ') as ahead,
  case when rank is null then (select arg_min('/p/'||p_partkey, p_partkey) from part where p_partkey%2 = o%2 and list_bool_and(list_transform(list_filter(string_split(lower(query), ' '), lambda w: w <> ''), lambda w: contains(lower(p_name||' '||p_type), w)))) end as url
  from (select o_orderkey as check_id, o_orderkey as o, case when o_orderkey%2 = 0 then '{OWN}' else 'host8.example.com' end as site_id, ['Red', 'blu', 'small', 'een b', 'zzz'][o_orderkey%5+1]||' '||['ring', 'bolt', ''][o_orderkey%3+1] as query, cast(floor(date_diff('second', cast(o_orderdate as timestamp), timestamp '2001-07-31') / 86400) as bigint) as age from orders) c
  join (select check_id, list({{'r': rank, 'h': host}} order by rank) as listed from serp_results group by 1) l using (check_id) left join (select check_id, host as site_id, min(rank) as rank from serp_results group by 1, 2) m using (check_id, site_id)
  left join (select site_id, lower(query) as lq, count(*) filter (where u%7 = 0) as impressions, bool_or(u = 11) as is_tracked from (select user_id as u, case when user_id%2 = 0 then '{OWN}' else 'host8.example.com' end as site_id, ['RED ring', 'small bolt', 'zzz '][user_id%3+1] as query from events) group by 1, 2) d on d.site_id = c.site_id and d.lq = lower(c.query)
  where rank is null or rank > 3""",
    "tracked_results": _W(src.SERP_RESULTS) + """select check_id, host, rank, 'q'||(check_id%40) as query from serp_results where (host, 'q'||(check_id%40)) in
  (select ('host'||s_suppkey||'.example.com', 'q'||(s_suppkey%40)) from supplier where s_nationkey < 12)""",
    "inbound_links": _W(src.LINK_EDGES, _IN) + "select * from inb",
    "orphans": _W(src.LINK_EDGES, _IN) + "select site_id, page from link_pages where page not in (select dst from inb) and not is_start",
    "weak_pages": _W(src.LINK_EDGES, _IN) + "select site_id, page from link_pages where page in (select dst from inb where links = 1)",
    "click_depth": "with recursive " + src.LINK_EDGES + """, walk(site_id, page, depth) as (select site_id, page, cast(0 as bigint) from link_pages where is_start union select e.site_id, e.dst, w.depth + 1 from walk w join link_edges e on e.src = w.page and e.src <> e.dst where w.depth < 40)
  select site_id, page, min(depth) as depth from walk group by site_id, page""",
    "fetch_kinds": _W(src.FETCH_STATUS) + f"select site_id, {_KIND} as kind, count(*) as pages from fetch_status group by site_id, {_KIND}",
    "broken_links": _W(src.LINK_EDGES, src.FETCH_STATUS, _IN) + f"select f.site_id, page, cast(status as bigint) as status, {_KIND} as kind, sources from fetch_status f join inb on dst = page where page >= 4 and status = 404",
    "sitemap_errors": _W(src.FETCH_STATUS, _MAP) + f"select f.site_id, page, cast(status as bigint) as status, {_KIND} as kind from fetch_status f join sitemap using (page) where status <> 200",
    "sitemap_conflicts": _W(_MAP) + "select site_id, page, page in (select page from hidden) as noindex, p_size%9 = 0 as canonical_elsewhere from sitemap join part on p_partkey = page where p_size%9 = 0 or page in (select page from hidden)",
    "sitemap_missing": _W(src.LINK_EDGES, src.FETCH_STATUS, _IN, _MAP) + "select site_id, page from fetch_status where status = 200 and site_id < 3 and page in (select dst from inb) and page not in (select page from sitemap) and page not in (select page from hidden)",
    "canonical_targets": _W(src.LINK_EDGES, src.FETCH_STATUS, _CAN, _MAP) + """select * from (select c.site_id, c.page, c.target, case when s.status is null then 'unknown' when s.status = 404 then 'broken' when s.status = 301 then 'redirect' else 'ok' end as kind, coalesce(o.target <> c.target, false) as chained,
  c.target in (select page from hidden) and c.page <> c.target as target_noindex, c.page in (select page from hidden) and c.page <> c.target as conflict
  from can c left join fetch_status s on s.page = c.target left join can o on o.page = c.target) where kind not in ('ok', 'unknown') or chained or target_noindex or conflict""",
    "resolved_links": _W(src.LINK_EDGES, src.FETCH_STATUS, "landed as (select e.site_id, src, case when status = 301 then dst + 4 else dst end as dst from link_edges e left join fetch_status on page = dst)") + "select site_id, dst, count(*) as links, count(distinct src) as sources, min(src) as first_source from landed where src <> dst group by site_id, dst",
    "check_frontier": _W(src.LINK_EDGES, src.FETCH_STATUS, _IN, _CAN, _MAP) + """select site_id, place, page, rank from (select *, row_number() over (partition by site_id order by rank, links desc, page) as place from (select site_id, page, min(rank) as rank, max(links) as links from
  (select site_id, target as page, 0 as rank, 0 as links from can union all select site_id, dst, 1, links from inb union all select site_id, page, 2, 0 from sitemap) group by site_id, page) where page not in (select page from fetch_status where status = 200) and page not in (select page from hidden)) where place <= 40""",
}
