"""Registered queries over landed payloads, clusters and phrases, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import competitors as op
from plumbline.operators import pages as pg
from plumbline.plans import text
from plumbline.functions.text import page_key
from plumbline.plans.pages import _GEO, AEO, REC
from plumbline.sources import driver_tables as src
from plumbline.sources import landed


def _payloads(spark, sf):
    """Search results as a provider would send them."""
    r = src.serp_results(spark, sf)
    one = F.struct(F.col("rank").cast("int").alias("position"), F.concat(F.lit("Result "), "host").alias("title"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("link"))
    return r.groupBy("check_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("organic_results"))).alias("body"))


def parse_serp_responses(spark, sf):
    return landed.parse_serp_responses(_payloads(spark, sf))


def snapshot_payloads(spark, sf):
    """Packed and unpacked again."""
    return landed.unpack_top(landed.pack_top(landed.parse_serp_responses(_payloads(spark, sf))))


def keyword_clusters(spark, sf):
    return op.keyword_clusters(text.keyword_candidates(spark, sf), text._site_pages(spark, sf))


def cannibalization(spark, sf):
    cands = text.keyword_candidates(spark, sf)
    return op.cannibalization(cands, op.keyword_clusters(cands, text._site_pages(spark, sf)))


def page_phrases(spark, sf):
    r = pg.records(src.pages(spark, sf)).select(F.col("site_id").alias("competitor"), "url", "title", "h1_text")
    return op.page_phrases(r.select("competitor", "url", F.lit(3).alias("weight"), F.explode(F.array("title", "h1_text")).alias("text")))


def citations(spark, sf):
    """Outside pages that the sites' pages link to."""
    rows = src.outside_links(spark, sf)
    return op.citations(rows.select(F.col("site_id").alias("competitor"), F.col("site_id").alias("host_of_page"), F.col("target").alias("url"), "anchor"))


def backlink_domains(spark, sf):
    return op.backlink_domains(src.outside_links(spark, sf))


def site_comparison(spark, sf):
    r = pg.records(src.pages(spark, sf))
    pages = r.select("site_id", page_key("url").alias("page"), F.col("url").rlike("^[a-z]+://[^/]+/?$").alias("is_start"), "word_count", "schema_types")
    edges = r.select("site_id", page_key("url").alias("src"), F.explode("anchors.target").alias("target")).select("site_id", "src", page_key("target").alias("dst")).where("src <> dst")
    return op.comparison(pages, edges.select("site_id", "dst"), pg.site_flag_scores(r))


def sites_compared(spark, sf):
    """The sites beside the one that comes first."""
    sites = site_comparison(spark, sf)
    first = src.pages(spark, sf).agg(F.min("site_id").alias("s")).first()["s"]
    return op.compared(sites, first)


QUERIES = {f.__name__: f for f in (parse_serp_responses, snapshot_payloads, keyword_clusters, cannibalization, page_phrases, citations, backlink_domains, site_comparison, sites_compared)}

_KEY = lambda u: f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', ''), ':.*$', '')||case when rtrim(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' then '/' else rtrim(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') end||regexp_extract({u}, '(\\?[^#]*)', 1)"
_ANY = lambda weights: "cast(floor((" + "+".join(f"case when {k} then {w} else 0 end" for k, w in weights.items()) + ")*100.0/100+0.5) as bigint)"
_SITES = f"""with {REC}, {AEO}, {_GEO}, pg as (select site_id, {_KEY('url')} as page, regexp_matches(url, '^[a-z]+://[^/]+/?$') as is_start, word_count, schema_types from rec),
  ed as (select site_id, {_KEY('url')} as a, {_KEY('t')} as b from (select site_id, url, case when starts_with(href, '/') then origin||href when regexp_matches(href, '^https?://') then href else origin||'/'||href end as t from (select site_id, url, origin, unnest(hrefs) as href from rec))),
  fl as (select site_id, {", ".join(f"bool_or({k}) as {k}" for k in (*pg.AEO_WEIGHTS, *pg.GEO_WEIGHTS))} from (select aeo.*, geo.* exclude (site_id, page_id) from aeo join geo on aeo.page_id = geo.page_id) group by site_id),
  sites as (select pg.site_id, count(*) as pages, cast(floor(avg(word_count)+0.5) as bigint) as avg_words, array_to_string(list_sort(list_distinct(flatten(list(schema_types)))), ',') as schema_types,
  cast(floor(avg(case when not is_start and not exists (select 1 from ed where ed.site_id = pg.site_id and ed.b = pg.page and ed.a <> ed.b) then 100.0 else 0 end)+0.5) as bigint) as orphan_percent, any_value({_ANY(pg.AEO_WEIGHTS)}) as aeo_score, any_value({_ANY(pg.GEO_WEIGHTS)}) as geo_score from pg join fl on fl.site_id = pg.site_id group by pg.site_id),
  long as (select site_id, unnest(['pages', 'avg_words', 'orphan_percent', 'aeo_score', 'geo_score']) as measure, unnest([pages, avg_words, orphan_percent, aeo_score, geo_score]) as value from sites) """
_TOP = f"with {src.SERP_RESULTS} select check_id, rank, 'Result '||host as title, 'https://'||host||'/' as url from serp_results where rank <= 10"
ORACLE_SQL = {
    "keyword_clusters": text._w(REC, text._CANDS, text.CLUSTERS).replace("with ", "with recursive ", 1) + "select * from clusters",
    "cannibalization": text._w(REC, text._CANDS, text.CLUSTERS).replace("with ", "with recursive ", 1) + "select * from cannibals",
    "parse_serp_responses": _TOP,
    "snapshot_payloads": _TOP,
    "page_phrases": f"""with {REC}, toks as (select site_id, url, list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+'), lambda w: w <> '') as words from (select site_id, url, title as t from rec union all select site_id, url, h1_text from rec)),
  grams as ({" union all ".join(f"select site_id, url, {n} as n, unnest(list_transform(list_filter(range(1, len(words)-{n - 1}+1), lambda i: {text._EDGE('words[i]')} and {text._EDGE(f'words[i+{n - 1}]')}), lambda i: array_to_string(words[i:i+{n - 1}], ' '))) as phrase from toks" for n in (2, 3, 4))}),
  l as (select phrase, any_value(n) as n, count(*) as pages, count(distinct site_id) as competitors, cast(count(*)*3 as bigint) as score from (select distinct site_id, url, n, phrase from grams) group by phrase),
  k4 as (select * from l where n = 4), k3 as (select * from l where n = 3 and not exists (select 1 from k4 where contains(' '||k4.phrase||' ', ' '||l.phrase||' ') and k4.pages >= l.pages*0.7)),
  k34 as (select * from k4 union all select * from k3), k2 as (select * from l where n = 2 and not exists (select 1 from k34 where contains(' '||k34.phrase||' ', ' '||l.phrase||' ') and k34.pages >= l.pages*0.7))
  select phrase, pages, competitors, score, n from k34 union all select phrase, pages, competitors, score, n from k2""",
    "citations": f"""with {src.OUTSIDE_LINKS}, k as (select *, regexp_replace(regexp_replace(target, '^https?://(www\\.)?', ''), '[?#].*$', '') as raw from outside_links)
  select key, min(host) as host, count(*) as links, count(distinct site_id) as competitors, coalesce(array_to_string(list_sort(list(distinct anchor) filter (where anchor <> ''))[1:3], ' | '), '') as anchors,
  case when regexp_matches(min(host), '\\.gov$') then 'Government' when min(host) = 'who.int' then 'International body' when regexp_matches(min(host), '\\.edu$') then 'Education / research' when regexp_matches(min(host), '\\.org$') then 'Organisation' else 'Other' end as authority
  from (select *, regexp_replace(raw, '/$', '') as key from k) where contains(key, '/') and host <> 'm.facebook.com' and host <> site_id and not ends_with(host, '.'||site_id) group by key""",
    "backlink_domains": f"""with {src.OUTSIDE_LINKS}, l as (select *, case when contains(host, 'directory') then 'Directory' when ends_with(host, '.org') or contains(host, 'alliance') or contains(host, 'herald') then 'Association/Publication' when contains(lower(anchor), 'partner') then 'Partner mention' else 'Other' end as kind,
  contains(lower(title), 'recommended') as listed from outside_links where host <> site_id and host <> 'm.facebook.com')
  select site_id, host, arg_min(kind, (page_ord, link_ord, target)) as type, count(distinct page_ord) as pages, count(*) filter (where listed) as resource_mentions, array_to_string(list(target order by page_ord, link_ord, target)[1:3], ' ') as examples from l group by site_id, host""",
    "site_comparison": _SITES + "select * from sites",
    "sites_compared": _SITES + f"""select t.site_id, t.measure, o.value as ours, t.value as theirs from long t join long o on o.measure = t.measure and o.site_id = (select min(site_id) from rec) where t.site_id <> o.site_id""",
}
