"""Registered streams that give each answer once, and the SQL of what they have given out when the input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.streaming import jobs

LIMITS = {"view": 3, "click": 2, "error": 0}
MINUTES = 120


def stream_policy_counts(spark, sf):
    """Closed windows of each client and kind of event."""
    e = jobs.table_stream(spark, sf, "events").select(F.col("user_id").cast("long").alias("client"), F.col("event_type").alias("policy"), F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.run_once(jobs.policy_counts(e, LIMITS, MINUTES), "append")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_trend_windows(spark, sf):
    """Closed weeks, a new one each day."""
    e = jobs.table_stream(spark, sf, "events").where("event_type in ('view', 'click')")
    log = e.select((F.col("user_id") % 3).cast("long").alias("site_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("clicks"), F.lit(1).alias("impressions"))
    return jobs.run_once(jobs.trend_windows(log), "append")


def stream_budget(spark, sf):
    """Grants of each site and month."""
    o = jobs.table_stream(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    due = o.select((F.col("o_custkey") % 3).cast("long").alias("site_id"), F.col("o_orderkey").cast("long").alias("keyword_id"), F.when(F.col("o_orderstatus") != "O", day).alias("last_checked_at"), day.alias("ts"))
    return jobs.budget_stream(due, jobs.stream_dir(spark), 40, 25, 10).drop("batch")


def stream_fresh_results(spark, sf):
    """Errors announce a new crawl; every other event is a result of a crawl that may have been replaced since."""
    e, k = jobs.table_stream(spark, sf, "events"), F.col("event_id")
    crawl = lambda n: F.concat(F.lit("c"), F.floor(n / 500).cast("string"))
    announced = F.col("event_type") == "error"
    rows = e.select(
        (F.col("user_id") % 20).cast("long").alias("site_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(~announced, F.col("event_type")).alias("kind"),
        F.when(announced | (k % 3 == 0), crawl(k)).when(k % 3 == 1, crawl(k - k % 400)).alias("crawl_id"), F.when(~announced, k * 10 - (k * 37) % 3000 + 3000).alias("seq"),
    )
    return jobs.run_once(jobs.fresh_results(rows), "append")


QUERIES = {f.__name__: f for f in (stream_policy_counts, stream_trend_windows, stream_budget, stream_fresh_results)}

ORACLE_SQL = {
    "stream_policy_counts": f"""with c as (select user_id as client, event_type as policy, time_bucket(interval {MINUTES} minute, ts) as start, count(*) as hits, max(ts) as last from events where event_type in ('view', 'click', 'error') group by all)
  select client, policy, start, hits, hits > most as over, case when hits > most then cast(ceil(epoch_us(start + interval {MINUTES} minute)/1e6-epoch_us(last)/1e6) as bigint) end as retry_after from c join (values ('view', 3), ('click', 2), ('error', 0)) l(policy, most) using (policy)
  where start + interval {MINUTES} minute <= (select max(ts) from events where event_type in ('view', 'click', 'error')) - interval 10 minute""",
    "stream_trend_windows": """with e as (select user_id%3 as site_id, ts, event_type from events where event_type in ('view', 'click')), w as (select *, cast(ts as date) - cast(unnest(range(0, 7)) as int) as start from e)
  select site_id, start, count(*) filter (where event_type = 'click') as clicks, count(*) as impressions from w where start + interval 7 day <= (select max(ts) from e) - interval 3 day group by site_id, start""",
    "stream_budget": "select o_custkey%3 as site_id, o_orderkey as keyword_id, cast(date_trunc('month', o_orderdate) as date) as month, row_number() over (partition by o_custkey%3, date_trunc('month', o_orderdate) order by case when o_orderstatus <> 'O' then o_orderdate end nulls first, o_orderkey) as place from orders qualify place <= 25",
    "stream_fresh_results": """with e as (select user_id%20 as site_id, ts, case when event_type <> 'error' then event_type end as kind, case when event_type = 'error' or event_id%3 = 0 then 'c'||event_id//500 when event_id%3 = 1 then 'c'||(event_id-event_id%400)//500 end as crawl_id, event_id*10-(event_id*37)%3000+3000 as seq from events),
  n as (select *, last_value(case when kind is null then crawl_id end ignore nulls) over (partition by site_id order by ts, case when kind is null then -1 else seq end) as current from e),
  good as (select *, max(seq) over (partition by site_id, kind order by ts, seq rows between unbounded preceding and 1 preceding) as before from n where kind is not null and (crawl_id is null or current is null or crawl_id = current))
  select site_id, kind, crawl_id, seq from good where before is null or seq > before""",
}
