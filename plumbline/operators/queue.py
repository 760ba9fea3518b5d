"""The opportunity queue: one shape for all sources, scores, dedupe, action state, order, summaries, and keyed merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import rounded, title_key

POINTS = {"Critical": 100, "High": 75, "Medium": 50, "Low": 25}
FACTORS = {"High": 1.0, "Medium": 0.85, "Low": 0.7}
TYPES = ("technical", "market", "search", "keyword", "aeo", "geo", "internal_link", "competitor", "content")
SHAPE = ("site_id", "id", "type", "module", "title", "evidence", "priority", "confidence", "breadth")
#: Sources of the queue by name: functions of a session and a folder that give rows of SHAPE.
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, build: Callable[..., DataFrame]) -> None:
    """Add a source to the queue, or replace the one of that name."""
    SOURCES[name] = build


def _lookup(c: str, table: dict[str, float], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(c)), F.lit(float(table[other])))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources by name; blank titles are dropped."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return rows.where(F.trim(F.coalesce("title", F.lit(""))) != "")


def scored(rows: DataFrame) -> DataFrame:
    """Priority points times confidence, plus up to ten for breadth."""
    score = _lookup("priority", POINTS, "Medium") * _lookup("confidence", FACTORS, "Medium") + F.least(F.lit(10), F.coalesce("breadth", F.lit(0)))
    return rows.withColumn("score", rounded(score).cast("long"))


def demoted(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Low confidence, and why, for rows of an old crawl, another market or a report older than 14 days; call it before ``scored``.

    ``rows`` may have crawl_id, market and age_days; ``current`` has site_id, crawl_id, market.  What is not known is not held against a row.
    """
    now = current.select("site_id", F.col("crawl_id").alias("_crawl"), F.col("market").alias("_market"))
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    old, other, aged = has("crawl_id") != F.col("_crawl"), has("market") != F.col("_market"), has("age_days") > 14
    note = F.concat_ws(", ", F.when(old, "older crawl"), F.when(other, "other market"), F.when(aged, "older than 14 days"))
    joined = rows.join(now.hint("merge"), "site_id", "left").withColumn("note", note)
    return joined.withColumn("confidence", F.when(F.col("note") != "", "Low").otherwise(F.col("confidence"))).drop("_crawl", "_market")


def deduped(rows: DataFrame) -> DataFrame:
    """One row for each normalised title of a site, the highest score (then the smallest id); other ids become aliases."""
    best = rows.groupBy("site_id", title_key("title").alias("title_key")).agg(
        F.min_by(F.struct(*rows.columns), F.struct(-F.col("score"), F.col("id"))).alias("r"), F.array_sort(F.collect_set("id")).alias("ids"), F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules")
    )
    return best.select("r.*", F.array_join(F.array_except("ids", F.array("r.id")), ",").alias("aliases"), "sources", "modules")


def with_state(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """State from the first action (by id) of the site on any of a row's ids.  ``actions``: site_id, action_id, source_id, status."""
    ids = rows.select("site_id", "id", F.explode(F.array_union(F.array("id"), F.filter(F.split("aliases", ","), lambda x: x != ""))).alias("source_id"))
    first = ids.join(actions.hint("merge"), ["site_id", "source_id"]).groupBy("site_id", "id").agg(F.min_by("status", "action_id").alias("status"))
    state = F.when(F.col("status").isNull(), "new").when(F.col("status").isin("Applied", "Verified"), "done").when(F.col("status") == "Rejected", "rejected").otherwise("in_actions")
    return rows.join(first.hint("merge"), ["site_id", "id"], "left").withColumn("state", state).drop("status")


def ordered(rows: DataFrame) -> DataFrame:
    """By score, type and title."""
    place = F.lit(len(TYPES))
    for k, t in enumerate(TYPES):
        place = F.when(F.col("type") == t, k).otherwise(place)
    return rows.orderBy("site_id", F.desc("score"), place, "title", "id")


def filtered(rows: DataFrame, types: list[str] | None = None, priorities: list[str] | None = None, states: tuple[str, ...] = ("new", "in_actions"), search: str = "") -> DataFrame:
    if types:
        rows = rows.where(F.col("type").isin(types))
    if priorities:
        rows = rows.where(F.col("priority").isin(priorities))
    rows = rows.where(F.col("state").isin(list(states)))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "evidence", "module")), F.lit(search.lower()))) if search else rows


def summary(rows: DataFrame) -> DataFrame:
    """Counts by type and state, with totals, of each site, by grouping sets."""
    cube = rows.groupingSets([["site_id"], ["site_id", "type"], ["site_id", "state"], ["site_id", "type", "state"]], "site_id", "type", "state").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return cube.select("site_id", F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("state", F.lit("all")).alias("state"), "n", "best")


def upsert_latest(rows: DataFrame, keys: list[str], newest: str, most: int, group: str) -> DataFrame:
    """The newest row of each key, then the newest ``most`` of each group."""
    one = Window.partitionBy(*keys).orderBy(F.desc(newest), *[F.desc(c) for c in rows.columns if c not in keys and c != newest])
    latest = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    top = Window.partitionBy(group).orderBy(F.desc(newest), *keys)
    return latest.withColumn("place", F.row_number().over(top).cast("long")).where(F.col("place") <= most)


def insert_missing(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (id, url) with what becomes of them: added, or skipped as a known id, a known url or a repeat of either."""
    ids, urls = current.select("id").distinct().withColumn("_id", F.lit(True)), current.select("url").distinct().withColumn("_url", F.lit(True))
    rows = incoming.select("id", "url").distinct().join(ids, "id", "left").join(urls, "url", "left")
    again = (F.row_number().over(Window.partitionBy("id").orderBy("url")) > 1) | (F.row_number().over(Window.partitionBy("url").orderBy("id")) > 1)
    outcome = F.when(F.col("_id"), "known id").when(F.col("_url"), "known url").when(again, "repeated").otherwise("added")
    return rows.select("id", "url", outcome.alias("outcome"))


def merge_index(sources: DataFrame, most: int) -> DataFrame:
    """First source wins for each key of a site (rank), the date filled from the others; the first ``most`` a site by rank and key."""
    rows = sources.groupBy("site_id", "key").agg(F.min_by("title", F.struct("rank", "title")).alias("title"), F.min("rank").alias("rank"), F.max("date").alias("date"))
    order = Window.partitionBy("site_id").orderBy("rank", "key")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
