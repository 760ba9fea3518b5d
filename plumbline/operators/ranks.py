"""Rank history and search-result operators."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import rounded

#: Two hours, as a share of a day: a daily job must not skip a keyword by minutes.
TOLERANCE_DAYS = 2 / 24


def rank_summary(snapshots: DataFrame) -> DataFrame:
    """One row a keyword: checks, latest and previous position, change (positive is up), best, ordered series.

    Latest and previous come from two aggregates over ordered structs, so nothing is sorted but the series.
    """
    point = F.struct("checked_at", "snapshot_id", "position")
    rows = snapshots.groupBy("keyword_id").agg(F.count("*").alias("checks"), F.min("position").alias("best"), F.array_sort(F.collect_list(point)).alias("points"))
    last, before = F.try_element_at("points", F.lit(-1)), F.try_element_at("points", F.lit(-2))
    series = F.transform("points", lambda p: F.coalesce(p["position"].cast("string"), F.lit("-")))
    return rows.select(
        "keyword_id", "checks", last["position"].alias("latest"), before["position"].alias("previous"),
        (before["position"] - last["position"]).alias("change"), "best", F.array_join(series, ",").alias("series"),
    )


def best_so_far(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the position before it, the change, and the best position up to it."""
    order = Window.partitionBy("keyword_id").orderBy("checked_at", "snapshot_id")
    before = F.lag("position").over(order)
    best = F.min("position").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return snapshots.select("keyword_id", "snapshot_id", "position", before.alias("previous"), (before - F.col("position")).alias("change"), best.alias("best_so_far"))


def latest_n(snapshots: DataFrame, n: int = 2) -> DataFrame:
    order = Window.partitionBy("keyword_id").orderBy(F.desc("checked_at"), F.desc("snapshot_id"))
    return snapshots.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def due_keywords(keywords: DataFrame, now: datetime.datetime, interval_days: int = 7, limit: int = 5) -> DataFrame:
    """Each site's active keywords never checked, or not within the interval less two hours: never checked first, then the oldest; ``limit`` a site."""
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.col("last_checked_at").cast("timestamp"))) / 86400
    due = keywords.where(F.coalesce("active", F.lit(True)) & (F.col("last_checked_at").isNull() | (age >= max(0.0, interval_days - TOLERANCE_DAYS))))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.asc_nulls_first("last_checked_at"), "keyword_id"))
    return due.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def budget_used(snapshots: DataFrame) -> DataFrame:
    """Snapshots of each site and month, and on how many days."""
    month = F.to_date(F.date_trunc("month", F.col("checked_at").cast("timestamp")))
    return snapshots.groupBy("site_id", month.alias("month")).agg(F.count("*").alias("used"), F.count_distinct("checked_at").alias("days"))


def budget_gate(due: DataFrame, used: DataFrame, monthly: int, per_run: int, reserve: int) -> DataFrame:
    """The first keywords of each site's due list that its budget allows.  ``used`` (site_id, used): counts of the month."""
    allowed = F.greatest(F.lit(0), F.least(F.lit(per_run), F.lit(monthly - reserve) - F.coalesce("used", F.lit(0))))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.asc_nulls_first("last_checked_at"), "keyword_id"))
    return due.withColumn("place", place.cast("long")).join(used.select("site_id", "used").hint("merge"), "site_id", "left").where(F.col("place") <= allowed).drop("used")


def ignore_duplicates(current: DataFrame, incoming: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Incoming keys that are not there yet, once each, up to ``most`` a site with those it has.  Both have site_id and the keys."""
    new = incoming.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")
    had = current.groupBy("site_id").agg(F.count("*").alias("_had"))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(*[k for k in keys if k != "site_id"]))
    rows = new.withColumn("_place", place).join(had.hint("merge"), "site_id", "left")
    return rows.where(F.col("_place") <= most - F.coalesce("_had", F.lit(0))).select(*keys)


def with_last_checked(keywords: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Keywords with the time of their newest snapshot: what appending snapshots does to them."""
    last = snapshots.groupBy("keyword_id").agg(F.max("checked_at").alias("last_checked_at"))
    return keywords.join(last.hint("merge"), "keyword_id", "left")


#: The tables of rank tracking, their keys, and what must hold in them.
RANK_TABLES = {
    "tracked_keywords": ("keyword_id long, site_id string, query string, country string, device string, active boolean, last_checked_at timestamp, created_at timestamp", ["site_id", "query", "country", "device"], "query <> '' and device in ('desktop', 'mobile')"),
    "rank_snapshots": ("snapshot_id long, keyword_id long, checked_at timestamp, position int, ranking_url string, provider string, trigger string, top_results string", ["snapshot_id"], "position is null or position between 1 and 100"),
    "job_runs": ("job string, run_day date, started_at timestamp, finished_at timestamp, status string, checked int", ["job", "run_day"], "status in ('running', 'done', 'failed')"),
}


def rank_table(name: str, rows: DataFrame) -> DataFrame:
    """Rows in a rank table's shape: one for each key (the last written, by the remaining columns), those that break its rule dropped."""
    schema, keys, rule = RANK_TABLES[name]
    fields = [f.strip().split(" ") for f in schema.split(",")]
    shaped = rows.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).where(rule)
    order = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(n) for n, _ in fields if n not in keys])
    return shaped.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def suffixes(host: str):
    """All domain suffixes of a host: a.b.c gives a.b.c, b.c and c."""
    parts = F.split(F.col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def site_rank(results: DataFrame, sites: DataFrame) -> DataFrame:
    """The best result of each site or its subdomains in each check: an equi-join on host suffixes.

    Suffixes are those of distinct hosts, so no result is sent to the task of a suffix that all hosts share.
    """
    hosts = results.select("host").distinct().withColumn("site", F.explode(suffixes("host")))
    known = hosts.join(sites.select("site").distinct().hint("merge"), "site")
    return results.join(known.hint("merge"), "host").groupBy("check_id", "site").agg(F.min("rank").alias("rank"), F.min_by("host", F.struct("rank", "host")).alias("host"))


def best_by_host(results: DataFrame, key: str = "check_id") -> DataFrame:
    return results.groupBy(key, "host").agg(F.min("rank").alias("rank"))


def movement(now: DataFrame, before: DataFrame, key: str = "keyword_id") -> DataFrame:
    """Each host's rank now and before, the change (positive is up), whether it is new or dropped."""
    a = best_by_host(now, key).withColumnRenamed("rank", "rank_now")
    b = best_by_host(before, key).withColumnRenamed("rank", "rank_before")
    had = before.select(key).distinct().withColumn("_had", F.lit(True))
    rows = a.join(b, [key, "host"], "full_outer").join(had, key, "left")
    return rows.select(
        key, "host", "rank_now", "rank_before", (F.col("rank_before") - F.col("rank_now")).alias("change"),
        (F.col("rank_before").isNull() & F.coalesce("_had", F.lit(False))).alias("is_new"), F.col("rank_now").isNull().alias("dropped"),
    )


def owners(results: DataFrame, generic: list[str], site: str, limit: int = 12) -> DataFrame:
    """Hosts across checks: in how many, average and best rank; generic hosts and the own site left out."""
    hosts = best_by_host(results).where(~F.col("host").isin(generic) & ~((F.col("host") == site) | F.col("host").endswith("." + site)))
    rows = hosts.groupBy("host").agg(F.count("*").alias("keywords"), rounded(F.avg("rank"), 1).alias("avg_rank"), F.min("rank").alias("best_rank"))
    return rows.orderBy(F.desc("keywords"), "avg_rank", "host").limit(limit)


def prospects(results: DataFrame, exclude: DataFrame) -> DataFrame:
    """Hosts by appearances, once a check, less the excluded ones (``host``)."""
    rows = best_by_host(results).join(exclude.select("host").distinct(), "host", "left_anti")
    return rows.groupBy("host").agg(F.count("*").alias("appearances"), F.min("rank").alias("best_rank"), rounded(F.avg("rank"), 2).alias("avg_rank"))


def targeting_pages(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """The first page of a site whose title and H1 hold every word of a query, also within longer words: ``site_id, query, url``.

    ``queries``: site_id, query; ``pages``: site_id, page_ord, url, title, h1.  A query is looked for by the word of its that the fewest of the site's title words hold, by
    an index of the parts of these words; the pages found are then tested for all of them.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("h1", F.lit(""))))
    held = pages.select("site_id", "page_ord", "url", hay.alias("hay"))
    tokens = held.select("site_id", "page_ord", F.explode(words(F.col("hay"))).alias("token"))
    spread = tokens.groupBy("site_id", "token").agg(F.count("*").alias("df"))
    size = F.length("token")
    parts = spread.select("site_id", "token", "df", F.explode(F.sequence(F.lit(1), size)).alias("at")).select("site_id", "token", "df", F.explode(F.expr("transform(sequence(1, length(token) - at + 1), n -> substring(token, at, n))")).alias("part")).distinct()
    asked = queries.select("site_id", "query", words(F.col("query")).alias("need")).distinct().where(F.size("need") > 0)
    each = asked.select("site_id", "query", F.explode("need").alias("part"))
    common = parts.join(each.select("site_id", "part").distinct().hint("merge"), ["site_id", "part"])
    often = common.groupBy("site_id", "part").agg(F.sum("df").alias("df"))
    rare = each.join(often.hint("merge"), ["site_id", "part"], "left").groupBy("site_id", "query").agg(F.min_by("part", F.struct(F.coalesce("df", F.lit(0)), "part")).alias("part"))
    near = rare.join(common.select("site_id", "part", "token").hint("merge"), ["site_id", "part"]).join(tokens.hint("merge"), ["site_id", "token"]).select("site_id", "query", "page_ord").distinct()
    tested = near.join(held.hint("merge"), ["site_id", "page_ord"]).join(asked.hint("merge"), ["site_id", "query"]).where(F.forall("need", lambda w: F.contains("hay", w)))
    return tested.groupBy("site_id", "query").agg(F.min_by("url", "page_ord").alias("url"))


#: Days after which a check is no longer fresh, and impressions that show a query is wanted, or wanted much.
STALE_DAYS, WANTED, MUCH = 14, 50, 100


def check_opportunities(checks: DataFrame, results: DataFrame, pages: DataFrame, demand: DataFrame, tracked: DataFrame, now: datetime.datetime) -> DataFrame:
    """Saved checks in which a site is below rank 3 or absent: ``check_id, site_id, query, rank, kind, priority, confidence, age_days, ahead, url``.

    ``checks``: check_id, site_id (a host), query, observed_at; ``results``: check_id, host, rank; ``pages``: as of ``targeting_pages``; ``demand``: site_id, query (lower case),
    impressions; ``tracked``: site_id, query.  A check without results says nothing.  ``ahead``: the first three hosts before the site's own; ``url``: for a site that is
    absent, its page that targets the query.  Confidence is medium at best, and low from ``STALE_DAYS``.
    """
    mine = checks.select("check_id", F.col("site_id").alias("site"))
    ranks = site_rank(results, mine).select("check_id", F.col("site").alias("site_id"), "rank")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "host")))  # one page of results
    listed = results.where("rank is not null and host is not null").groupBy("check_id").agg(ordered.alias("listed"))
    rows = checks.join(listed.hint("merge"), "check_id").join(ranks.hint("merge"), ["check_id", "site_id"], "left").where("rank is null or rank > 3")
    wanted = demand.groupBy("site_id", F.lower("query").alias("_q")).agg(F.max("impressions").alias("impressions"))
    known = tracked.select("site_id", F.lower("query").alias("_q")).distinct().withColumn("is_tracked", F.lit(True))
    rows = rows.withColumn("_q", F.lower("query")).join(wanted.hint("merge"), ["site_id", "_q"], "left").join(known.hint("merge"), ["site_id", "_q"], "left")
    seen = F.coalesce("impressions", F.lit(0))
    absent = F.col("rank").isNull()
    high = F.when(absent, (seen >= WANTED) | F.coalesce("is_tracked", F.lit(False))).otherwise(seen >= MUCH)
    age = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp("observed_at")) / 86400)
    before = F.filter("listed", lambda r: absent | (r["rank"] < F.col("rank")))
    target = targeting_pages(rows.where(absent).select("site_id", "query"), pages)
    rows = rows.join(target.hint("merge"), ["site_id", "query"], "left")
    return rows.select(
        "check_id", "site_id", "query", "rank", F.when(absent, "not in results").otherwise("room to climb").alias("kind"), F.when(high, "High").otherwise("Medium").alias("priority"),
        F.when(age > STALE_DAYS, "Low").otherwise("Medium").alias("confidence"), age.alias("age_days"), F.array_join(F.transform(F.slice(before, 1, 3), lambda r: r["host"]), ", ").alias("ahead"), F.when(absent, F.col("url")).alias("url"),
    )


def tracked_only(results: DataFrame, tracked: DataFrame) -> DataFrame:
    """Results whose host, query, country and device are actively tracked."""
    keys = ["host", "query", "country", "device"]
    active = tracked.where(F.coalesce("active", F.lit(True))).select("host", F.lower("query").alias("query"), "country", "device").distinct()
    return results.withColumn("query", F.lower("query")).join(active, keys, "left_semi")


def property_match(sites: DataFrame, properties: DataFrame) -> DataFrame:
    """Each site's best property: its own host (3), its exact domain (2), a parent domain (1).

    ``sites`` has ``site``; ``properties`` has ``property`` (a URL or ``sc-domain:`` name).
    """
    domain = F.regexp_extract("property", "^sc-domain:(.*)$", 1)
    host = F.regexp_replace(F.regexp_extract("property", "^https?://([^/]+)", 1), r"^www\.", "")
    named = properties.select("property", F.when(domain != "", domain).otherwise(host).alias("name"), (domain != "").alias("is_domain"))
    spread = sites.select("site", F.explode(suffixes("site")).alias("name")).join(named.hint("merge"), "name")
    points = F.when(~F.col("is_domain") & (F.col("name") == F.col("site")), 3).when(F.col("is_domain") & (F.col("name") == F.col("site")), 2).when(F.col("is_domain"), 1)
    scored = spread.withColumn("points", points).where("points is not null")
    best = scored.groupBy("site").agg(F.max_by("property", F.struct("points", F.length("name"), "property")).alias("property"), F.max("points").alias("points"))
    return sites.join(best.hint("merge"), "site", "left")
