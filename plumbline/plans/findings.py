"""Registered technical findings and their SQL.

Pages are parts of four sites, fetch states come from orders, links from line items; a part's size says whether a page asks not to be indexed,
its retail price which canonical it names, and its brand whether it may be fetched.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import findings as op
from plumbline.sources import driver_tables as src


def _url(c: str):
    return F.col(c).cast("string")


def _facts(spark, sf) -> op.Facts:
    part = src.table(spark, sf, "part").withColumn("site_id", (F.col("p_partkey") % 4).cast("long")).withColumn("url", _url("p_partkey"))
    n = F.col("p_partkey") % 9
    state = F.when(n == 1, "other_page").when(n == 2, "cross_domain").when(n == 3, "multiple").when(n == 4, "missing").when(n == 5, "protocol_mismatch").otherwise("self")
    pages = part.select("site_id", "url", (F.col("p_partkey") < 4).alias("is_start"), (F.col("p_size") % 10 == 3).alias("noindex"), state.alias("canonical_state"), F.when(n == 1, (F.col("p_partkey") + 4).cast("string")).alias("canonical"))
    statuses = src.fetch_status(spark, sf)
    hop = F.col("page") % 5
    moved = F.col("status") == 301
    statuses = statuses.select(
        "site_id", _url("page").alias("url"), "status", F.when(moved & (hop == 4), "REDIRECT_LOOP").when(~moved & (hop == 4) & (F.col("page") % 3 == 0), "NETWORK").alias("error_code"), F.lit("text/html").alias("content_type"),
        F.when(moved, F.when(hop == 0, "slash").otherwise("other")).alias("redirect_kind"), F.when(moved, 1 + hop % 3).otherwise(0).alias("hops"), (moved & (hop == 3)).alias("downgrade"),
    )
    edges = src.link_edges(spark, sf).where("src <> dst")
    inbound = edges.select("site_id", _url("dst").alias("url"), _url("src").alias("source"))
    sitemap = part.where("p_size > 15").select("site_id", "url")
    info = part.groupBy("site_id").agg(F.min("url").alias("url"), F.count("*").alias("n")).select("site_id", "url", (F.col("site_id") < 3).alias("complete"), (F.col("site_id") == 3).alias("missing_confirmed"), (F.col("site_id") == 2).alias("parse_error"), F.when(F.col("site_id") == 1, F.col("n")).otherwise(0).alias("mismatch_count"))
    robots = part.groupBy("site_id").agg(F.min("url").alias("url")).select("site_id", "url", F.when(F.col("site_id") == 0, 404).otherwise(200).alias("status"), (F.col("site_id") == 1).alias("blocks_search"))
    return op.Facts(pages, statuses, inbound, sitemap, info, robots, part.where("p_brand like '%1'").select("site_id", "url"))


def technical_findings(spark, sf):
    return op.technical_findings(_facts(spark, sf))


def technical_penalty(spark, sf):
    return op.site_penalty(op.technical_findings(_facts(spark, sf)))


def technical_summary(spark, sf):
    return op.technical_summary(_facts(spark, sf))


QUERIES = {f.__name__: f for f in (technical_findings, technical_penalty, technical_summary)}

_BASE = f"""with {src.LINK_EDGES}, {src.FETCH_STATUS},
pg as (select p_partkey%4 as site_id, cast(p_partkey as varchar) as url, p_partkey < 4 as home, p_size%10 = 3 as noindex, p_size > 15 as listed, p_brand like '%1' as blocked,
  case p_partkey%9 when 1 then 'other_page' when 2 then 'cross_domain' when 3 then 'multiple' when 4 then 'missing' when 5 then 'protocol_mismatch' else 'self' end as state, case when p_partkey%9 = 1 then cast(p_partkey+4 as varchar) end as canonical from part),
st as (select site_id, cast(page as varchar) as url, status, case when status = 301 and page%5 = 4 then 'redirect_loop' when page%5 = 4 and page%3 = 0 then 'unreachable' when status = 301 then 'redirect' when status = 404 then 'broken' else 'ok' end as kind,
  case when status = 301 then 1+page%5%3 else 0 end as hops, status = 301 and page%5 = 3 as downgrade, status = 301 and page%5 = 0 as slash from fetch_status),
lk as (select site_id, cast(dst as varchar) as url, bool_or(src < 4) as from_home from link_edges where src <> dst group by site_id, dst),
ls as (select st.*, from_home from st join lk using (site_id, url) where url not in (select url from pg where home)),
tg as (select p.site_id, p.url, s.kind, q.noindex as target_noindex, q.state as target_state from pg p left join st s on s.url = p.canonical and s.site_id = p.site_id left join pg q on q.url = p.canonical and q.site_id = p.site_id where p.state = 'other_page'),
one as (select site_id, min(url) as url from pg group by site_id),
f as (
  select site_id, url, 'home_noindex' as finding, 'Indexing' as category, 'Critical' as severity from pg where noindex and home
  union all select site_id, url, 'robots_blocks_search', 'Indexing', 'Critical' from one where site_id = 1
  union all select site_id, url, 'robots_missing', 'Indexing', 'Low' from one where site_id = 0
  union all select p.site_id, url, 'noindex_pages', 'Indexing', case when share >= 0.25 then 'Medium' else 'Low' end from pg p join (select site_id, count(*) filter (where noindex and not home)/count(*) as share from pg group by site_id) x on x.site_id = p.site_id where noindex and not home
  union all select p.site_id, p.url, 'links_blocked_by_robots', 'Indexing', 'Low' from pg p join lk on lk.url = p.url and lk.site_id = p.site_id where blocked
  union all select site_id, url, 'broken_links', 'Technical', case when from_home then 'Critical' else 'High' end from ls where kind = 'broken'
  union all select site_id, url, 'unreachable_links', 'Technical', 'Medium' from ls where kind = 'unreachable'
  union all select site_id, url, 'redirecting_links', 'Technical', 'Medium' from ls where kind = 'redirect' and not slash
  union all select site_id, url, 'slash_redirects', 'Technical', 'Low' from ls where kind = 'redirect' and slash
  union all select site_id, url, 'redirect_chains', 'Technical', case when hops >= 3 then 'High' else 'Medium' end from st where hops >= 2
  union all select site_id, url, 'redirect_loops', 'Technical', 'High' from st where kind = 'redirect_loop'
  union all select site_id, url, 'https_downgrade', 'Technical', 'High' from st where downgrade
  union all select site_id, url, 'canonical_multiple', 'Technical', 'Medium' from pg where state = 'multiple'
  union all select site_id, url, 'canonical_protocol', 'Technical', 'High' from pg where state = 'protocol_mismatch'
  union all select site_id, url, 'canonical_cross_domain', 'Technical', 'Medium' from pg where state = 'cross_domain'
  union all select site_id, url, 'canonical_bad_target', 'Technical', case when kind = 'redirect' then 'Medium' else 'High' end from tg where kind in ('broken', 'redirect')
  union all select site_id, url, 'canonical_noindex_target', 'Technical', 'High' from tg where target_noindex
  union all select site_id, url, 'canonical_chain', 'Technical', 'Medium' from tg where target_state in ('other_page', 'cross_domain')
  union all select site_id, url, 'canonical_noindex_conflict', 'Technical', 'Medium' from pg where noindex and state in ('other_page', 'cross_domain')
  union all select site_id, url, 'sitemap_host_mismatch', 'Indexing', 'High' from one where site_id = 1
  union all select site_id, url, 'sitemap_missing', 'Indexing', 'Medium' from one where site_id = 3
  union all select site_id, url, 'sitemap_invalid', 'Indexing', 'Medium' from one where site_id = 2
  union all select st.site_id, st.url, 'sitemap_errors', 'Indexing', 'High' from st join pg on st.url = pg.url and st.site_id = pg.site_id where listed and kind = 'broken'
  union all select st.site_id, st.url, 'sitemap_redirects', 'Indexing', 'Medium' from st join pg on st.url = pg.url and st.site_id = pg.site_id where listed and kind = 'redirect' and not slash
  union all select site_id, url, 'sitemap_noindex', 'Indexing', 'High' from pg where listed and noindex
  union all select site_id, url, 'sitemap_noncanonical', 'Indexing', 'Medium' from pg where listed and state in ('other_page', 'cross_domain', 'protocol_mismatch')
  union all select site_id, url, 'sitemap_blocked', 'Indexing', 'High' from pg where listed and blocked
  union all select site_id, url, 'sitemap_missing_pages', 'Indexing', 'Low' from ls where kind = 'ok' and site_id < 3 and url not in (select url from pg where listed or noindex or state not in ('self', 'missing'))),
found as (select site_id, finding, category, arg_max(severity, case severity when 'Critical' then 3 when 'High' then 2 when 'Medium' then 1 else 0 end) as severity, count(distinct url) as urls, array_to_string(list_sort(list_distinct(list(url)))[1:25], ' ') as evidence from f group by site_id, finding, category)
"""
ORACLE_SQL = {
    "technical_findings": _BASE + "select * from found",
    "technical_penalty": _BASE + "select site_id, cast(least(35, sum(case severity when 'Critical' then 11 when 'High' then 7 when 'Medium' then 4 else 2 end)) as bigint) as penalty from found group by site_id",
    "technical_summary": _BASE + """select site_id, count(*) as pages, (select count(distinct url) from st where st.site_id = pg.site_id) as urls_checked, count(*) filter (where noindex) as noindex_pages,
  (select count(*) from ls where ls.site_id = pg.site_id and kind = 'broken') as broken_links, (select count(*) from ls where ls.site_id = pg.site_id and kind = 'redirect' and not slash) as redirecting_links,
  count(*) filter (where state in ('multiple', 'protocol_mismatch', 'cross_domain')) + (select count(*) from tg where tg.site_id = pg.site_id and kind in ('broken', 'redirect')) as canonical_problems,
  count(*) filter (where listed) as sitemap_urls, (select count(*) from st join pg q on st.url = q.url and st.site_id = q.site_id where q.site_id = pg.site_id and q.listed) as sitemap_checked from pg group by site_id""",
}
