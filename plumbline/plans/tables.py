"""Registered queries over kept tables and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.sources import driver_tables as src
from plumbline.sources.rank_tables import RankTables
from plumbline.streaming.jobs import stream_dir


def rank_tables(spark, sf):
    """Customers as tracked keywords, orders as snapshots in three batches, one of which comes twice."""
    kept = RankTables(spark, f"plumbline_{uuid.uuid4().hex}", stream_dir(spark), 4).create()
    people = src.table(spark, sf, "customer")
    keywords = people.select(
        F.col("c_custkey").alias("keyword_id"), F.concat(F.lit("site"), (F.col("c_nationkey") % 3).cast("string")).alias("site_id"), F.concat(F.lit("q"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("query"),
        F.lit("ken").alias("country"), F.lit("desktop").alias("device"), F.lit(True).alias("active"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    kept.track(keywords)
    kept.track(keywords)
    o = src.table(spark, sf, "orders")
    for batch in (0, 1, 2, 1):
        part = o.where(F.col("o_orderkey") % 3 == batch)
        kept.append(part.select(F.col("o_custkey").alias("keyword_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("checked_at"), (F.col("o_orderkey") % 100 + 1).alias("position"), F.lit(None).cast("string").alias("ranking_url")), batch, run_day=f"2024-01-0{batch + 1}")
    return kept.last_checked().withColumn("last_checked_at", F.to_date("last_checked_at"))


QUERIES = {"rank_tables": rank_tables}

ORACLE_SQL = {
    "rank_tables": """with k as (select c_custkey as keyword_id, 'site'||c_nationkey%3 as site_id, 'q'||c_custkey//2 as query from customer qualify row_number() over (partition by c_nationkey%3, c_custkey//2 order by c_custkey) = 1)
  select keyword_id, site_id, query, count(o_orderkey) as checks, max(cast(o_orderdate as date)) as last_checked_at from k left join orders on o_custkey = keyword_id group by all""",
}
