"""Views of the test tables in the shapes the operators read, and the same views as SQL.

Every view carries a ``site_id``, and every one has several sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import host_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One impression a row: site_id, date, query, page, device, country, impressions, clicks, position.  All views and clicks are used."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id") % 20
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    early = F.col("ts") < F.lit("2024-01-21").cast("timestamp")
    clicked = (F.col("event_type") == "click") & ((user % 3 != 0) | (F.col("event_id") % 8 == 0)) & ((user != 5) | early)
    return rows.select(
        F.concat(F.lit("shop"), (user % 2).cast("string")).alias("site_id"),
        F.to_date("ts").alias("date"),
        F.concat(F.lit("q"), (k % 40).cast("string")).alias("query"),
        F.concat(F.lit("https://shop"), (user % 2).cast("string"), F.lit(".example.com/p/"), user.cast("string")).alias("page"),
        F.when(F.col("event_id") % 2 == 0, "desktop").otherwise("mobile").alias("device"),
        F.when(F.col("event_id") % 3 == 0, "ken").otherwise("deu").alias("country"),
        F.lit(1).cast("long").alias("impressions"),
        F.when(clicked, 1).otherwise(0).cast("long").alias("clicks"),
        (1 + (k * 7) % 15 + F.floor(F.least(F.col("value"), F.lit(50.0)) / 25)).cast("double").alias("position"),
    )


def serp_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_id, host, rank."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("check_id"),
        F.concat(F.lit("host"), F.col("l_suppkey").cast("string"), F.lit(".example.com")).alias("host"),
        F.row_number().over(order).cast("long").alias("rank"),
    )


def rank_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, keyword_id, checked_at, snapshot_id, position; a keyword belongs to one of three sites."""
    position = 1 + F.col("o_orderkey") % 12
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).cast("long").alias("site_id"),
        F.col("o_custkey").cast("long").alias("keyword_id"),
        F.col("o_orderdate").cast("date").alias("checked_at"),
        F.col("o_orderkey").cast("long").alias("snapshot_id"),
        F.when(position <= 10, position).cast("long").alias("position"),
    )


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, src, dst: every line item is a link of its part to a page of the same site (one of four); self-links are left in.

    Targets come from squares, so some pages are never linked.
    """
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))  # one row: the number of pages
    spot = (F.col("l_orderkey").cast("long") * F.col("l_orderkey").cast("long") * 31) % F.col("n")
    site = F.col("l_partkey") % 4
    return rows.select(site.cast("long").alias("site_id"), F.col("l_partkey").cast("long").alias("src"), (spot - spot % 4 + site).cast("long").alias("dst")).distinct()


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, page, is_start: the smallest page of a site is its start."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).cast("long").alias("site_id"), F.col("p_partkey").cast("long").alias("page"), (F.col("p_partkey") < 4).alias("is_start"))


def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, page, status: one status for each page that some order names."""
    status = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 301).otherwise(404)
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).cast("long").alias("site_id"), F.col("o_orderkey").cast("long").alias("page"), status.cast("long").alias("status"))


#: Hosts that outside links lead to, by supplier.
OUTSIDE = ("green-directory{}.example", "trade-alliance{}.example", "city-herald{}.example", "club{}.org", "m.facebook.com", "shop{}.example", "stats{}.gov", "www.who.int", "site0.example.com", "lab{}.edu")


def outside_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, page_ord, page, title, h1, link_ord, target, anchor: every line item is a link from its part's page to its supplier's site."""
    key, supplier = F.col("p_partkey"), F.col("l_suppkey")
    parts = table(spark, sf_dir, "part")
    host = F.replace(F.element_at(F.array(*[F.lit(h) for h in OUTSIDE]), (supplier % len(OUTSIDE) + 1).cast("int")), F.lit("{}"), (supplier % 4).cast("string"))
    target = F.concat(F.lit("https://"), host, F.lit("/"), F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.concat(F.lit("doc/"), (F.col("l_orderkey") % 3).cast("string"), F.when(F.col("l_tax") > 0.04, "?x=1").otherwise(""))))
    anchor = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Our partner "), "p_brand")).when(F.col("l_returnflag") == "N", "").otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "lineitem").join(parts.hint("merge"), F.col("l_partkey") == key)
    return rows.select(
        F.concat(F.lit("site"), (key % 4).cast("string"), F.lit(".example.com")).alias("site_id"), key.cast("long").alias("page_ord"), F.concat(F.lit("https://site"), (key % 4).cast("string"), F.lit(".example.com/p/"), key.cast("string")).alias("page"),
        F.when(key % 9 == 0, F.concat(F.lit("Recommended: "), "p_name")).otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("h1"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("link_ord"), target.alias("target"), anchor.alias("anchor"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages with their host as site."""
    return table(spark, sf_dir, "pages").withColumn("site_id", host_of("url"))


#: The same views as DuckDB SQL.
SEARCH_LOG = """search_log as (select 'shop'||(user_id%20%2) as site_id, cast(ts as date) as date, 'q'||(k%40) as query, 'https://shop'||(user_id%20%2)||'.example.com/p/'||(user_id%20) as page,
  case when event_id%2=0 then 'desktop' else 'mobile' end as device, case when event_id%3=0 then 'ken' else 'deu' end as country, 1 as impressions,
  case when event_type='click' and (user_id%20%3<>0 or event_id%8=0) and (user_id%20<>5 or ts<timestamp '2024-01-21') then 1 else 0 end as clicks,
  cast(1+(k*7)%15+floor(least(value,50)/25) as double) as position
from (select *, cast(json_extract_string(props,'$.k') as int) k from events) where event_type in ('view','click'))"""
SERP_RESULTS = """serp_results as (select l_orderkey as check_id, 'host'||l_suppkey||'.example.com' as host,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rank from lineitem)"""
RANK_SNAPSHOTS = """rank_snapshots as (select o_custkey%3 as site_id, o_custkey as keyword_id, cast(o_orderdate as date) as checked_at, o_orderkey as snapshot_id,
  case when 1+o_orderkey%12<=10 then 1+o_orderkey%12 end as position from orders)"""
LINK_EDGES = """link_edges as (select distinct l_partkey%4 as site_id, l_partkey as src, spot-spot%4+l_partkey%4 as dst
  from (select l_partkey, (cast(l_orderkey as bigint)*l_orderkey*31)%(select count(*) from part) as spot from lineitem)),
  link_pages as (select p_partkey%4 as site_id, p_partkey as page, p_partkey < 4 as is_start from part)"""
OUTSIDE_LINKS = """outside_links as (select 'site'||p_partkey%4||'.example.com' as site_id, cast(p_partkey as bigint) as page_ord, 'https://site'||p_partkey%4||'.example.com/p/'||p_partkey as page, case when p_partkey%9 = 0 then 'Recommended: '||p_name else p_name end as title, p_type as h1,
  cast(l_orderkey as bigint)*10+l_linenumber as link_ord, 'https://'||host||'/'||case when l_linenumber%5 = 0 then '' else 'doc/'||l_orderkey%3||case when l_tax > 0.04 then '?x=1' else '' end end as target, case l_returnflag when 'A' then 'Our partner '||p_brand when 'N' then '' else p_type end as anchor, regexp_replace(host, '^www\\.', '') as host
  from (select *, replace(['green-directory{}.example', 'trade-alliance{}.example', 'city-herald{}.example', 'club{}.org', 'm.facebook.com', 'shop{}.example', 'stats{}.gov', 'www.who.int', 'site0.example.com', 'lab{}.edu'][l_suppkey%10+1], '{}', cast(l_suppkey%4 as varchar)) as host from lineitem) join part on l_partkey = p_partkey)"""
FETCH_STATUS = """fetch_status as (select o_orderkey%4 as site_id, o_orderkey as page, case o_orderstatus when 'F' then 200 when 'O' then 301 else 404 end as status from orders)"""
