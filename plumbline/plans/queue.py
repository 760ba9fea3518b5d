"""Registered queue, merge and streaming queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import page_key, scaled, slug, url_key
from plumbline.operators import pages as pg
from plumbline.operators import queue as op
from plumbline.plans import findings as findings_plan
from plumbline.plans import pages as pages_plan
from plumbline.plans import search
from plumbline.sources import driver_tables as src
from plumbline.streaming import jobs

LIMIT, MINUTES = 2, 10


def _audit(spark, sf):
    rows = pg.recurring(pg.issues(pg.records(src.pages(spark, sf))))
    return rows.select(
        "site_id", F.concat(F.lit("audit:"), "rule").alias("id"), F.lit("technical").alias("type"), F.lit("Site audit").alias("module"), F.replace("rule", F.lit("_"), F.lit(" ")).alias("title"),
        F.concat(F.col("pages").cast("string"), F.lit(" pages")).alias("evidence"), F.col("severity").alias("priority"), F.lit("High").alias("confidence"), F.col("pages").alias("breadth"),
    )


def _low_ctr(spark, sf):
    return search.low_ctr_pages(spark, sf).select(
        "site_id", F.concat(F.lit("gsc:lowctr:"), slug(page_key("page"))).alias("id"), F.lit("search").alias("type"), F.lit("Search data").alias("module"), F.concat(F.lit("Low click-through rate on "), page_key("page")).alias("title"),
        F.concat(F.col("gain").cast("string"), F.lit(" more clicks")).alias("evidence"), "priority", F.lit("Medium").alias("confidence"), "breadth",
    )


def _declining(spark, sf):
    return search.declining_pages(spark, sf).select(
        "site_id", F.concat(F.lit("gsc:decline:"), slug("page_key")).alias("id"), F.lit("search").alias("type"), F.lit("Search data").alias("module"), F.concat(F.lit("Clicks lost on "), F.col("page_key")).alias("title"),
        F.concat(F.col("lost").cast("string"), F.lit(" clicks lost")).alias("evidence"), "priority", F.lit("High").alias("confidence"), F.least(F.lit(10), F.ceil(F.col("lost") / scaled(20, search.DAYS))).cast("long").alias("breadth"),
    )


def _duplicate_titles(spark, sf):
    return pg.duplicates(pg.records(src.pages(spark, sf)), "title").select(
        "site_id", F.concat(F.lit("dup:"), F.col("first_page").cast("string")).alias("id"), F.lit("content").alias("type"), F.lit("Content").alias("module"), F.concat(F.lit("Pages share the title "), F.col("value")).alias("title"),
        F.concat(F.col("pages").cast("string"), F.lit(" pages")).alias("evidence"), F.when(F.col("pages") > 5, "High").otherwise("Low").alias("priority"), F.lit("Low").alias("confidence"), F.col("pages").alias("breadth"),
    )


def _technical(spark, sf):
    rows = findings_plan.technical_findings(spark, sf)
    return rows.select(
        F.concat(F.lit("parts"), F.col("site_id").cast("string")).alias("site_id"), F.concat(F.lit("tech:"), "finding").alias("id"), F.lit("technical").alias("type"), F.lit("Technical checks").alias("module"), F.replace("finding", F.lit("_"), F.lit(" ")).alias("title"),
        F.concat(F.col("urls").cast("string"), F.lit(" urls")).alias("evidence"), F.col("severity").alias("priority"), F.lit("High").alias("confidence"), F.col("urls").alias("breadth"),
    )


def _competing(spark, sf):
    return search.query_cannibalization(spark, sf).select(
        "site_id", F.concat(F.lit("gsc:compete:"), slug("pages")).alias("id"), F.lit("search").alias("type"), F.lit("Search data").alias("module"), F.concat(F.lit("Pages compete: "), F.col("pages")).alias("title"),
        F.concat(F.col("n_queries").cast("string"), F.lit(" queries")).alias("evidence"), "priority", F.lit("Medium").alias("confidence"), F.col("n_pages").alias("breadth"),
    )


def _striking(spark, sf):
    return search.striking_distance(spark, sf).select(
        "site_id", F.concat(F.lit("gsc:striking:"), slug("query")).alias("id"), F.lit("keyword").alias("type"), F.lit("Search data").alias("module"), F.concat(F.lit("Within reach: "), F.col("query")).alias("title"),
        F.concat(F.col("gain").cast("string"), F.lit(" more clicks")).alias("evidence"), "priority", F.lit("Medium").alias("confidence"), F.lit(1).cast("long").alias("breadth"),
    )


for _name, _build in (("audit", _audit), ("low_ctr", _low_ctr), ("declining", _declining), ("duplicate_titles", _duplicate_titles), ("technical", _technical), ("competing", _competing), ("striking", _striking)):
    op.register_source(_name, _build)


def _queue(spark, sf):
    rows = op.deduped(op.scored(op.union_sources([build(spark, sf) for build in op.SOURCES.values()])))
    sites = src.pages(spark, sf).select("site_id", F.concat(F.lit("dup:"), F.col("page_id").cast("string")).alias("source_id"))
    who = src.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("action_id"), F.concat(F.lit("dup:"), F.col("c_custkey").cast("string")).alias("source_id"), F.when(F.col("c_acctbal") > 5000, "Applied").when(F.col("c_acctbal") < 0, "Rejected").otherwise("Planned").alias("status"))
    return op.with_state(rows, who.join(sites.hint("merge"), "source_id"))


def opportunity_queue(spark, sf):
    return op.ordered(_queue(spark, sf)).select("site_id", "id", "type", "title", "evidence", "priority", "score", "aliases", "sources", "modules", "state")


def queue_summary(spark, sf):
    return op.summary(_queue(spark, sf))


def queue_filter(spark, sf):
    return op.filtered(_queue(spark, sf), priorities=["High", "Critical"], search="pages").select("site_id", "id", "score", "state")


def upsert_latest(spark, sf):
    rows = src.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("event_id").cast("long").alias("event_id"))
    return op.upsert_latest(rows, ["user_id", "event_type"], "event_id", 2, "user_id")


def insert_missing(spark, sf):
    sites = src.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("site"), F.col("c_custkey").cast("string")).alias("url"))
    incoming = src.table(spark, sf, "orders").select((F.col("o_custkey") * 2).cast("long").alias("id"), F.concat(F.lit("site"), (F.col("o_custkey") + 700).cast("string")).alias("url"))
    return op.insert_missing(sites, incoming).groupBy("outcome").agg(F.count("*").alias("rows"))


def merge_content_index(spark, sf):
    r = pg.records(src.pages(spark, sf)).select("site_id", url_key("url").alias("key"), "title", "h1_text", "page_id")
    first = r.select("site_id", "key", "title", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("date"))
    second = r.select("site_id", "key", F.col("h1_text").alias("title"), F.lit(2).alias("rank"), F.col("page_id").alias("date"))
    return op.merge_index(first.unionByName(second), 2)


def queue_demoted(spark, sf):
    """Orders as opportunities of crawls, markets and reports that may be out of date, scored after that."""
    k = F.col("o_orderkey")
    rows = src.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 5).cast("long").alias("site_id"), k.cast("long").alias("id"), F.col("o_orderpriority").alias("title"), F.when(k % 3 == 0, "High").otherwise("Critical").alias("priority"), F.when(k % 2 == 0, "High").otherwise("Medium").alias("confidence"),
        (k % 13).cast("long").alias("breadth"), F.when(k % 4 > 0, F.concat(F.lit("c"), (k % 7).cast("string"))).alias("crawl_id"), F.when(k % 5 > 0, F.when(k % 6 == 0, "KE").otherwise("DE")).alias("market"), (k % 20).cast("long").alias("age_days"),
    )
    current = src.table(spark, sf, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("long").alias("site_id"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("crawl_id"), F.lit("KE").alias("market"))
    return op.scored(op.demoted(rows, current)).select("site_id", "id", "confidence", "note", "score")


def _hits(df):
    return df.select(F.col("user_id").cast("long").alias("client"), F.col("ts").cast("timestamp").alias("ts"))


def _plain(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def window_counts(spark, sf):
    return _plain(jobs.window_counts(_hits(src.table(spark, sf, "events")), LIMIT, MINUTES))


def daily_totals(spark, sf):
    return jobs.daily_totals(_hits(src.table(spark, sf, "events")))


def stream_window_counts(spark, sf):
    out = jobs.run_once(jobs.window_counts(_hits(jobs.table_stream(spark, sf, "events")), LIMIT, MINUTES), "update")
    return _plain(out.groupBy("client", "start").agg(F.max("hits").alias("hits"), F.bool_or("over").alias("over")))


def stream_daily_totals(spark, sf):
    """All days, the last ones included: each is given out again as it grows."""
    out = jobs.run_once(jobs.daily_totals(_hits(jobs.table_stream(spark, sf, "events"))), "update")
    return out.groupBy("day").agg(F.max("hits").alias("hits"))


def stream_dedupe(spark, sf):
    rows = jobs.table_stream(spark, sf, "events").select(F.col("user_id").cast("long").alias("client"), F.to_date("ts").alias("run_day"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.run_once(jobs.dedupe(rows, ["client", "run_day"]), "append").select("client", "run_day")


def stream_rank_state(spark, sf):
    orders = jobs.table_stream(spark, sf, "orders")
    position = 1 + F.col("o_orderkey") % 12
    snaps = orders.select(F.col("o_custkey").cast("long").alias("keyword_id"), F.col("o_orderdate").cast("date").alias("checked_at"), F.col("o_orderkey").cast("long").alias("snapshot_id"), F.when(position <= 10, position).cast("long").alias("position"))
    return jobs.latest_states(jobs.run_once(jobs.rank_states(snaps), "update"), "keyword_id")


QUERIES = {f.__name__: f for f in (queue_demoted, opportunity_queue, queue_summary, queue_filter, upsert_latest, insert_missing, merge_content_index, window_counts, daily_totals, stream_window_counts, stream_daily_totals, stream_dedupe, stream_rank_state)}

_SLUG = lambda x: f"substr(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"
_PAGE = "replace(page, 'https://', '')"
_Q = f"""with {pages_plan.REC}, {pages_plan._ISSUES}, {pages_plan._RECUR}, low as ({search.ORACLE_SQL['low_ctr_pages']}), falling as ({search.ORACLE_SQL['declining_pages']}), tech as ({findings_plan.ORACLE_SQL['technical_findings']}), fights as ({search.ORACLE_SQL['query_cannibalization']}), near_ as ({search.ORACLE_SQL['striking_distance']}),
raw as (select site_id, 'audit:'||rule as id, 'technical' as type, 'Site audit' as module, replace(rule, '_', ' ') as title, pages||' pages' as evidence, severity as priority, 'High' as confidence, pages as breadth from recur
  union all select site_id, 'gsc:lowctr:'||{_SLUG(_PAGE)}, 'search', 'Search data', 'Low click-through rate on '||{_PAGE}, gain||' more clicks', priority, 'Medium', breadth from low
  union all select site_id, 'gsc:decline:'||{_SLUG('page_key')}, 'search', 'Search data', 'Clicks lost on '||page_key, lost||' clicks lost', priority, 'High', cast(least(10, ceil(lost/{scaled(20, search.DAYS)})) as bigint) from falling
  union all select site_id, 'dup:'||min(page_id), 'content', 'Content', 'Pages share the title '||title, count(*)||' pages', case when count(*) > 5 then 'High' else 'Low' end, 'Low', count(*) from rec where title <> '' group by site_id, title having count(*) > 1
  union all select 'parts'||site_id, 'tech:'||finding, 'technical', 'Technical checks', replace(finding, '_', ' '), urls||' urls', severity, 'High', urls from tech
  union all select site_id, 'gsc:compete:'||{_SLUG('pages')}, 'search', 'Search data', 'Pages compete: '||pages, n_queries||' queries', priority, 'Medium', n_pages from fights
  union all select site_id, 'gsc:striking:'||{_SLUG('query')}, 'keyword', 'Search data', 'Within reach: '||query, gain||' more clicks', priority, 'Medium', 1 from near_),
sc as (select *, cast(floor(case priority when 'Critical' then 100 when 'High' then 75 when 'Medium' then 50 else 25 end * case confidence when 'High' then 1.0 when 'Medium' then 0.85 else 0.7 end + least(10, breadth) + 0.5) as bigint) as score, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as tk from raw),
best as (select *, count(*) over w as sources, list(id) over w as ids, list(module) over w as mods, row_number() over (partition by site_id, tk order by score desc, id) as place from sc window w as (partition by site_id, tk)),
one as (select *, list_sort(list_distinct(list_filter(ids, lambda x: x <> id))) as other from best where place = 1),
st as (select o.site_id, o.id, arg_min(case when c_acctbal > 5000 then 'Applied' when c_acctbal < 0 then 'Rejected' else 'Planned' end, c_custkey) as status from (select site_id, id, unnest(list_concat([id], other)) as sid from one) o join customer on sid = 'dup:'||c_custkey join rec on rec.page_id = c_custkey and rec.site_id = o.site_id group by o.site_id, o.id),
q as (select one.site_id, one.id, type, title, evidence, priority, score, array_to_string(other, ',') as aliases, sources, array_to_string(list_sort(list_distinct(mods)), ',') as modules, module, case when status is null then 'new' when status = 'Applied' then 'done' when status = 'Rejected' then 'rejected' else 'in_actions' end as state from one left join st on st.id = one.id and st.site_id = one.site_id)
"""

ORACLE_SQL = {
    "queue_demoted": """with o as (select o_custkey%5 as site_id, o_orderkey as id, case when o_orderkey%3 = 0 then 75 else 100 end as points, o_orderkey%2 = 0 as sure, o_orderkey%13 as breadth, case when o_orderkey%4 > 0 then 'c'||o_orderkey%7 end as crawl, case when o_orderkey%5 > 0 then case when o_orderkey%6 = 0 then 'KE' else 'DE' end end as market, o_orderkey%20 as age from orders),
  n as (select o.*, concat_ws(', ', case when site_id < 4 and crawl <> 'c'||site_id then 'older crawl' end, case when site_id < 4 and market <> 'KE' then 'other market' end, case when age > 14 then 'older than 14 days' end) as note from o)
  select site_id, id, case when note <> '' then 'Low' when sure then 'High' else 'Medium' end as confidence, note, cast(floor(points*case when note <> '' then 0.7 when sure then 1.0 else 0.85 end+least(10, breadth)+0.5) as bigint) as score from n""",
    "opportunity_queue": _Q + "select * exclude (module) from q",
    "queue_summary": _Q + "select site_id, coalesce(type, 'all') as type, coalesce(state, 'all') as state, count(*) as n, max(score) as best from q group by grouping sets ((site_id), (site_id, type), (site_id, state), (site_id, type, state))",
    "queue_filter": _Q + "select site_id, id, score, state from q where priority in ('High', 'Critical') and state in ('new', 'in_actions') and contains(lower(title||' '||evidence||' '||module), 'pages')",
    "upsert_latest": """select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id desc, event_type) as place from (select user_id, event_type, max(event_id) as event_id from events group by all) qualify place <= 2""",
    "insert_missing": """select outcome, count(*) as rows from (select case when i.id in (select c_custkey from customer) then 'known id' when i.url in (select 'site'||c_custkey from customer) then 'known url' when row_number() over (partition by id order by url) > 1 or row_number() over (partition by url order by id) > 1 then 'repeated' else 'added' end as outcome
  from (select distinct o_custkey*2 as id, 'site'||(o_custkey+700) as url from orders) i) group by 1""",
    "merge_content_index": f"""with {pages_plan.REC}, joined as (select site_id, site_id||case when bare = '' then '/' else bare end as key, title, h1_text, page_id from (select *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as bare from rec))
  select site_id, key, min(title) as title, 1 as rank, max(page_id) as date from joined group by site_id, key qualify row_number() over (partition by site_id order by key) <= 2""",
    "window_counts": f"select user_id as client, time_bucket(interval {MINUTES} minute, ts) as start, count(*) as hits, count(*) > {LIMIT} as over from events group by 1, 2",
    "daily_totals": "select cast(ts as date) as day, count(*) as hits from events group by 1",
    "stream_window_counts": f"select user_id as client, time_bucket(interval {MINUTES} minute, ts) as start, count(*) as hits, count(*) > {LIMIT} as over from events group by 1, 2",
    "stream_daily_totals": "select cast(ts as date) as day, count(*) as hits from events group by 1",
    "stream_dedupe": "select distinct user_id as client, cast(ts as date) as run_day from events",
    "stream_rank_state": f"with {src.RANK_SNAPSHOTS} select keyword_id, cast(len(l) as bigint) as checks, coalesce(l[-1], -1) as latest, case when len(l) > 1 then coalesce(l[-2], -1) else -1 end as previous, coalesce(best, -1) as best from (select keyword_id, list(position order by checked_at, snapshot_id) as l, min(position) as best from rank_snapshots group by 1)",
}
