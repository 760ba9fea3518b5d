"""Registered search-performance queries and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import priority_rank, scaled, slug
from plumbline.operators import search_perf as op
from plumbline.sources import driver_tables as src

DAYS, TODAY = 7, datetime.date(2024, 1, 30)
BEFORE, FIRST, LAST = op.ranges(DAYS, TODAY)


def _by(spark: SparkSession, sf: str, *keys: str, period: str = "current") -> DataFrame:
    return op.by(src.search_log(spark, sf), DAYS, TODAY, *keys, period=period)


def _model(spark: SparkSession, sf: str) -> DataFrame:
    return op.ctr_model(_by(spark, sf, "query"), DAYS)


def search_report(spark, sf):
    return op.search_report(src.search_log(spark, sf), DAYS, TODAY)


def ctr_model(spark, sf):
    return _model(spark, sf)


def low_ctr_pages(spark, sf):
    return op.low_ctr_pages(_by(spark, sf, "page"), _model(spark, sf), DAYS)


def striking_distance(spark, sf):
    return op.striking_distance(_by(spark, sf, "query"), _by(spark, sf, "query", "page"), _model(spark, sf), DAYS)


def declining_pages(spark, sf):
    return op.declining_pages(_by(spark, sf, "page"), _by(spark, sf, "page", period="previous"), DAYS)


def period_compare(spark, sf):
    return op.period_compare(_by(spark, sf, "page"), _by(spark, sf, "page", period="previous"))


def refresh_candidates(spark, sf):
    return op.refresh_candidates(_by(spark, sf, "page"), _by(spark, sf, "page", period="previous"), DAYS)


def site_trend(spark, sf):
    return op.site_trend(_by(spark, sf), _by(spark, sf, period="previous"), DAYS)


def query_cannibalization(spark, sf):
    return op.query_cannibalization(_by(spark, sf, "query", "page"), DAYS)


def top_query_by_page(spark, sf):
    return op.top_queries(_by(spark, sf, "query", "page"), 5)


def brand_free_queries(spark, sf):
    """The best query of each page that does not hold the digit that stands for the site's brand."""
    brands = src.search_log(spark, sf).select("site_id", F.substring("site_id", -1, 1).alias("brand")).distinct()
    return op.top_queries(_by(spark, sf, "query", "page"), 1, brands, scaled(20, DAYS))


def host_rows(spark, sf):
    return op.host_scope(_by(spark, sf, "page"), "www.shop1.example.com").select("page", "clicks", "impressions")


def trend_windows(spark, sf):
    return op.trend_windows(src.search_log(spark, sf), 7)


def _tracked(spark, sf):
    return src.search_log(spark, sf).where("clicks = 1 and device = 'desktop' and position > 12").select("site_id", "query").distinct()


def query_labels(spark, sf):
    return op.query_labels(_by(spark, sf, "query"), _by(spark, sf, "query", "page"), _model(spark, sf), _tracked(spark, sf), DAYS)


def filter_quick_wins(spark, sf):
    return op.filter_queries(query_labels(spark, sf), "quick_win").select("site_id", "query", "impressions", "position")


def filter_not_tracked(spark, sf):
    return op.filter_queries(query_labels(spark, sf), "not_tracked", "1").select("site_id", "query", "impressions")


def scored_queries(spark, sf):
    """Every query of the period with labels and an opportunity score: the flagship query."""
    rows = query_labels(spark, sf)
    points = F.when(F.col("low_ctr"), 75).when(F.col("quick_win"), 50).otherwise(25)
    score = points + F.least(F.lit(10), F.floor(F.col("impressions") / scaled(20, DAYS)))
    return rows.withColumn("id", F.concat(F.lit("query:"), slug("query"))).withColumn("score", score.cast("long")).orderBy(F.desc("score"), "site_id", "query")


R = "floor(({})*{}+0.5)/{}"
_METRICS = "cast(sum(clicks) as bigint) as clicks, cast(sum(impressions) as bigint) as impressions, floor(sum(clicks)/sum(impressions)*10000+0.5)/10000 as ctr, floor(sum(impressions*position)/sum(impressions)*10+0.5)/10 as position"
_NOW = f"cur as (select * from search_log where date between date '{FIRST}' and date '{LAST}')"
_PREV = f"prev as (select * from search_log where date between date '{BEFORE}' and date '{FIRST - datetime.timedelta(1)}')"
_Q = f"queries as (select site_id, query, {_METRICS} from cur group by site_id, query)"
_P = f"pages_now as (select site_id, page, {_METRICS} from cur group by site_id, page)"
_PP = f"pages_before as (select site_id, page, {_METRICS} from prev group by site_id, page)"
_QP = f"query_pages as (select site_id, query, page, {_METRICS} from cur group by site_id, query, page)"
_GENERIC = "case least(10, greatest(1, b)) " + " ".join(f"when {k} then {v}" for k, v in {1: 0.28, 2: 0.15, 3: 0.1, 4: 0.07, 5: 0.055, 6: 0.045, 7: 0.035, 8: 0.03, 9: 0.025, 10: 0.02}.items()) + " end"
_BUCKET = "cast(least(20, greatest(1, floor(position+0.5))) as bigint)"
_MODEL = f"""own as (select site_id, {_BUCKET} as b, count(*) as n_own, median(ctr) as own from queries where impressions >= {scaled(20, DAYS)} and position > 0 group by site_id, {_BUCKET}),
model as (select site_id, b as bucket, coalesce(n_own, 0) as n_own, cast(case when coalesce(n_own, 0) >= 5 then own else {_GENERIC} end as double) as expected,
  case when coalesce(n_own, 0) >= 5 then 'own' else 'generic' end as basis from (select distinct site_id, b from queries, (select range as b from range(1, 21))) left join own using (site_id, b))"""
_KEY = "replace(page, 'https://', '')"
_PRIORITY = f"case when gain >= {scaled(100, DAYS)} then 'High' when gain >= {scaled(30, DAYS)} then 'Medium' else 'Low' end"
_LABELS = f"""per as (select q.site_id, q.query, count(*) as n_pages, count(*) filter (where p.impressions >= greatest({float(scaled(10, DAYS))}, q.impressions*0.15)) as n_meaningful,
  arg_max(p.page, (p.impressions, p.page)) as top_page from query_pages p join queries q on p.site_id = q.site_id and p.query = q.query group by q.site_id, q.query),
labels_ as (select q.site_id, q.query, clicks, impressions, ctr, position, coalesce(n_pages, 0) as n_pages, coalesce(top_page, '') as top_page,
  position between 4 and 20 and impressions >= {scaled(30, DAYS)} as quick_win,
  position > 0 and position <= 10 and impressions >= {scaled(50, DAYS)} and ctr < expected*0.6 as low_ctr,
  regexp_matches(q.query, '^(who|what|when|where|why|how)\\b') or q.query like '%?' as is_question, coalesce(n_meaningful, 0) >= 2 as compete,
  (q.site_id, q.query) in (select (site_id, query) from search_log where clicks = 1 and device = 'desktop' and position > 12) as tracked
  from queries q join model m on {_BUCKET} = bucket and q.site_id = m.site_id left join per on per.site_id = q.site_id and per.query = q.query)"""


def _sql(*ctes: str, body: str) -> str:
    return "with " + ",\n".join([src.SEARCH_LOG, *ctes]) + "\n" + body


def _report_sql() -> str:
    parts = []
    for period, view in (("current", "cur"), ("previous", "prev")):
        for name, key, group in (
            ("total", "''", ""), ("date", "cast(date as varchar)", ", date"), ("query", "query", ", query"), ("page", "page", ", page"),
            ("query+page", "query||'|'||page", ", query, page"), ("device", "device", ", device"), ("country", "country", ", country"),
        ):
            parts.append(f"select site_id, '{period}' as period, '{name}' as dimension, {key} as key, {_METRICS}, false as truncated from {view} group by site_id{group}")
    return "\nunion all ".join(parts)


QUERIES = {f.__name__: f for f in (search_report, ctr_model, low_ctr_pages, striking_distance, declining_pages, period_compare, refresh_candidates, site_trend, query_cannibalization, top_query_by_page, brand_free_queries, host_rows, trend_windows, query_labels, filter_quick_wins, filter_not_tracked, scored_queries)}

_site = lambda a, b: f"{a}.site_id = {b}.site_id"
ORACLE_SQL = {
    "search_report": _sql(_NOW, _PREV, body=_report_sql()),
    "ctr_model": _sql(_NOW, _Q, _MODEL, body="select * from model"),
    "low_ctr_pages": _sql(_NOW, _Q, _P, _MODEL, body=f"""select site_id, page, clicks, impressions, ctr, position, floor(expected*10000+0.5)/10000 as expected, gain, {_PRIORITY} as priority,
  cast(least(10, ceil(gain/{scaled(20, DAYS)})) as bigint) as breadth from (select p.*, expected, cast(floor((expected-ctr)*impressions+0.5) as bigint) as gain from pages_now p join model m on {_BUCKET} = bucket and p.site_id = m.site_id
  where impressions >= {scaled(100, DAYS)} and position between 1 and 20 and ctr < expected*0.6) where gain >= {scaled(10, DAYS)}"""),
    "striking_distance": _sql(_NOW, _Q, _QP, _MODEL, body=f"""select s.site_id, s.query, s.clicks, s.impressions, s.ctr, s.position, gain, t.page as top_page, {_PRIORITY} as priority
  from (select * from (select q.*, cast(floor(greatest(0, expected-ctr)*impressions+0.5) as bigint) as gain from queries q join model m on q.site_id = m.site_id and bucket = 5
  where position between 8 and 20 and impressions >= {scaled(50, DAYS)}) where gain >= {scaled(5, DAYS)} qualify row_number() over (partition by site_id order by gain desc, query) <= 15) s
  left join (select site_id, query, page from query_pages qualify row_number() over (partition by site_id, query order by impressions desc, page) = 1) t on s.site_id = t.site_id and s.query = t.query"""),
    "declining_pages": _sql(_NOW, _PREV, _P, _PP, body=f"""select *, cast(floor(lost/before*100+0.5) as bigint) as drop_percent, case when lost >= {scaled(50, DAYS)} then 'High' else 'Medium' end as priority
  from (select b.site_id, {_KEY.replace('page', 'b.page')} as page_key, b.page, b.clicks as before, coalesce(n.clicks, 0) as after, b.clicks-coalesce(n.clicks, 0) as lost
  from pages_before b left join pages_now n on b.page = n.page where b.clicks >= {scaled(20, DAYS)}) where after <= before*0.7"""),
    "period_compare": _sql(_NOW, _PREV, _P, _PP, body=f"""select site_id, {_KEY} as page_key, coalesce(n.clicks, 0) as clicks_now, coalesce(n.impressions, 0) as impressions_now,
  coalesce(b.clicks, 0) as clicks_before, coalesce(b.impressions, 0) as impressions_before from pages_now n full join pages_before b using (site_id, page)"""),
    "refresh_candidates": _sql(_NOW, _PREV, _P, _PP, body=f"""select * exclude (c, i, p), floor((case when c then (clicks_before-clicks_now)*2.0 else 0 end + case when i then (impressions_before-impressions_now)/50 else 0 end
  + case when p then floor((position_now-position_before)*10+0.5)/10*3 else 0 end)*1000+0.5)/1000 as weight, concat_ws(',', case when c then 'clicks' end, case when i then 'impressions' end, case when p then 'position' end) as reasons
  from (select b.site_id, {_KEY.replace('page', 'b.page')} as page_key, b.clicks as clicks_before, b.impressions as impressions_before, b.position as position_before, n.clicks as clicks_now, n.impressions as impressions_now, n.position as position_now,
  b.clicks >= {scaled(10, DAYS)} and (b.clicks-n.clicks)/b.clicks >= 0.3 as c, b.impressions >= {scaled(100, DAYS)} and (b.impressions-n.impressions)/b.impressions >= 0.3 as i,
  b.position > 0 and floor((n.position-b.position)*10+0.5)/10 >= 3 and n.impressions >= {scaled(100, DAYS)} as p from pages_before b join pages_now n on b.page = n.page) where c or i or p qualify row_number() over (partition by site_id order by weight desc, page_key) <= 12"""),
    "site_trend": _sql(_NOW, _PREV, body=f"""select *, floor((clicks_before-clicks_now)/clicks_before*10000+0.5)/10000 as "drop", clicks_before >= {scaled(100, DAYS)} and clicks_now <= clicks_before*0.8 as is_finding
  from (select site_id, cast(sum(clicks) as bigint) as clicks_now, cast(sum(impressions) as bigint) as impressions_now from cur group by site_id) join (select site_id, cast(sum(clicks) as bigint) as clicks_before, cast(sum(impressions) as bigint) as impressions_before from prev group by site_id) using (site_id)"""),
    "query_cannibalization": _sql(_NOW, _QP, body=f"""select site_id, pages, n_pages, count(*) as n_queries, cast(sum(total) as bigint) as impressions, case when sum(total) >= {scaled(500, DAYS)} then 'High' else 'Medium' end as priority
  from (select site_id, query, string_agg(page_key, '|' order by page_key) as pages, count(*) as n_pages, max(total) as total from (select site_id, query, {_KEY} as page_key, impressions,
  row_number() over (partition by site_id, query order by impressions desc, page) as place, max(impressions) over (partition by site_id, query) as top, sum(impressions) over (partition by site_id, query) as total from query_pages)
  where total >= {scaled(50, DAYS)} and (place = 1 or (impressions >= {scaled(10, DAYS)} and impressions >= top*0.25)) group by site_id, query having count(*) > 1) group by site_id, pages, n_pages qualify row_number() over (partition by site_id order by impressions desc, pages) <= 8"""),
    "top_query_by_page": _sql(_NOW, _QP, body=f"select site_id, {_KEY} as page_key, row_number() over (partition by page order by impressions desc, query) as place, query, impressions from query_pages qualify place <= 5"),
    "brand_free_queries": _sql(_NOW, _QP, body=f"select site_id, {_KEY} as page_key, row_number() over (partition by page order by impressions desc, query) as place, query, impressions from query_pages where impressions >= {scaled(20, DAYS)} and not contains(query, right(site_id, 1)) qualify place = 1"),
    "host_rows": _sql(_NOW, _P, body="select page, clicks, impressions from pages_now where page like 'https://shop1.example.com/%'"),
    "trend_windows": _sql(body="""select site_id, cast(first_day as date) as first_day, cast(sum(clicks) as bigint) as clicks, cast(sum(impressions) as bigint) as impressions
  from search_log, (select unnest(generate_series(date '2023-12-20', date '2024-02-05', interval 1 day)) as first_day) where date >= first_day and date < first_day + interval 7 day group by site_id, cast(first_day as date)"""),
    "query_labels": _sql(_NOW, _Q, _QP, _MODEL, _LABELS, body="select * from labels_"),
    "filter_quick_wins": _sql(_NOW, _Q, _QP, _MODEL, _LABELS, body="select site_id, query, impressions, position from labels_ where quick_win"),
    "filter_not_tracked": _sql(_NOW, _Q, _QP, _MODEL, _LABELS, body="select site_id, query, impressions from labels_ where not tracked and contains(query, '1')"),
    "scored_queries": _sql(_NOW, _Q, _QP, _MODEL, _LABELS, body=f"select *, 'query:'||query as id, cast(case when low_ctr then 75 when quick_win then 50 else 25 end + least(10, floor(impressions/{scaled(20, DAYS)})) as bigint) as score from labels_"),
}
