"""Search-performance operators over a log of site_id, date, query, page, device, country, impressions, clicks and position.

Every answer is for one site: keys and windows begin with ``site_id``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import bonus, generic_ctr, host_of, page_key, priority_for, rounded, scaled

ALLOWED_DAYS, LAG_DAYS = (7, 28, 90, 180), 3


def ranges(days: int, today: datetime.date) -> tuple[datetime.date, datetime.date, datetime.date]:
    """First day of the previous period, first and last day of the current one, which ends three days ago."""
    days = days if days in ALLOWED_DAYS else 28
    last = today - datetime.timedelta(LAG_DAYS)
    first = last - datetime.timedelta(days - 1)
    return first - datetime.timedelta(days), first, last


def metrics() -> list[Column]:
    """Clicks, impressions, click-through rate to four places, impression-weighted position to one."""
    clicks, shown = F.sum("clicks"), F.sum("impressions")
    return [
        clicks.cast("long").alias("clicks"),
        shown.cast("long").alias("impressions"),
        F.when(shown > 0, rounded(clicks / shown, 4)).otherwise(0.0).alias("ctr"),
        F.when(shown > 0, rounded(F.sum("weighted") / shown, 1)).otherwise(0.0).alias("position"),
    ]


def periods(log: DataFrame, days: int, today: datetime.date) -> DataFrame:
    """Rows of both periods, summed to the finest grain, with ``period``; the date filter reaches the scan."""
    before, first, last = ranges(days, today)
    rows = log.where(F.col("date").between(F.lit(before), F.lit(last)))
    rows = rows.withColumn("period", F.when(F.col("date") >= F.lit(first), "current").otherwise("previous"))
    return rows.groupBy("site_id", "period", "date", "query", "page", "device", "country").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("impressions") * F.col("position")).alias("weighted")
    )


def by(log: DataFrame, days: int, today: datetime.date, *keys: str, period: str = "current") -> DataFrame:
    return periods(log, days, today).where(F.col("period") == period).groupBy("site_id", *keys).agg(*metrics())


def search_report(log: DataFrame, days: int, today: datetime.date, caps: dict[str, int] | None = None) -> DataFrame:
    """``site_id, period, dimension, key, clicks, impressions, ctr, position, truncated`` by grouping sets over both periods.

    ``caps`` keeps the most clicked keys of a dimension (of each site and period) and marks what is left as truncated; without it nothing is cut.
    """
    parts = ("date", "query", "page", "device", "country")
    sets = [[], ["date"], ["query"], ["page"], ["query", "page"], ["device"], ["country"]]
    rows = periods(log, days, today)
    grouped = rows.groupingSets([[F.col(c) for c in ("site_id", "period", *s)] for s in sets], "site_id", "period", *parts).agg(F.grouping_id().alias("g"), *metrics())
    bits = {c: 1 << (len(parts) - 1 - k) for k, c in enumerate(parts)}
    has = lambda c: F.col("g").bitwiseAND(bits[c]) == 0
    dimension = F.concat_ws("+", *[F.when(has(c), c) for c in parts])
    key = F.concat_ws("|", *[F.when(has(c), F.col(c).cast("string")) for c in parts])
    out = grouped.select("site_id", "period", F.when(dimension == "", "total").otherwise(dimension).alias("dimension"), key.alias("key"), "clicks", "impressions", "ctr", "position")
    if not caps:
        return out.withColumn("truncated", F.lit(False))
    most = F.lit(None).cast("int")
    for name, n in caps.items():
        most = F.when(F.col("dimension") == name, n).otherwise(most)
    whole = Window.partitionBy("site_id", "period", "dimension")
    ranked = out.withColumn("place", F.row_number().over(whole.orderBy(F.desc("clicks"), F.desc("impressions"), "key"))).withColumn("n", F.count("*").over(whole)).withColumn("most", most)
    return ranked.where("most is null or place <= most").withColumn("truncated", F.coalesce(F.col("n") > F.col("most"), F.lit(False))).drop("place", "n", "most")


def bucket(position: Column | str) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return F.least(F.lit(20), F.greatest(F.lit(1), F.floor(p + 0.5))).cast("long")


def ctr_model(queries: DataFrame, days: int, least: int = 5) -> DataFrame:
    """Median rate of each site's own queries per position bucket 1 to 20, else the generic curve: ``site_id, bucket, n_own, expected, basis``."""
    used = (F.col("impressions") >= scaled(20, days)) & (F.col("position") > 0)
    own = queries.groupBy("site_id", bucket("position").alias("bucket")).agg(F.count_if(used).alias("n_own"), F.median(F.when(used, F.col("ctr"))).alias("own"))
    sites = own.select("site_id").distinct().select("site_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("bucket"))
    joined = sites.join(own.hint("merge"), ["site_id", "bucket"], "left")
    enough = F.coalesce("n_own", F.lit(0)) >= least
    generic = F.when(F.col("bucket") <= 10, generic_ctr(F.col("bucket").cast("double"))).otherwise(generic_ctr(F.lit(10.0)))
    return joined.select(
        "site_id", "bucket", F.coalesce("n_own", F.lit(0)).cast("long").alias("n_own"),
        F.when(enough, F.col("own")).otherwise(generic).alias("expected"), F.when(enough, "own").otherwise("generic").alias("basis"),
    )


def with_expected(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds the rate that the site's model expects at each row's position."""
    return rows.withColumn("bucket", bucket("position")).join(model.select("site_id", "bucket", "expected", "basis").hint("merge"), ["site_id", "bucket"], "left").drop("bucket")


def top_per_site(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` rows of each site in an order."""
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def low_ctr_pages(pages: DataFrame, model: DataFrame, days: int) -> DataFrame:
    rows = with_expected(pages.where((F.col("impressions") >= scaled(100, days)) & F.col("position").between(1, 20)), model)
    rows = rows.where(F.col("ctr") < F.col("expected") * 0.6).withColumn("gain", rounded((F.col("expected") - F.col("ctr")) * F.col("impressions")).cast("long"))
    rows = rows.where(F.col("gain") >= scaled(10, days))
    return rows.select("site_id", "page", "clicks", "impressions", "ctr", "position", rounded("expected", 4).alias("expected"), "gain", priority_for(F.col("gain"), days).alias("priority"), bonus(F.col("gain"), days).alias("breadth"))


def striking_distance(queries: DataFrame, query_pages: DataFrame, model: DataFrame, days: int, most: int = 15) -> DataFrame:
    """Queries on positions 8 to 20 that would gain clicks at position 5, each site's best ``most`` with their top page."""
    target = model.where("bucket = 5").select("site_id", F.col("expected").alias("target"))
    rows = queries.where(F.col("position").between(8, 20) & (F.col("impressions") >= scaled(50, days))).join(target.hint("merge"), "site_id")
    rows = rows.withColumn("gain", rounded(F.greatest(F.lit(0.0), F.col("target") - F.col("ctr")) * F.col("impressions")).cast("long"))
    rows = top_per_site(rows.where(F.col("gain") >= scaled(5, days)), most, F.desc("gain"), "query")
    seen = query_pages.join(rows.select("site_id", "query").hint("merge"), ["site_id", "query"], "left_semi")
    top = top_pages(seen, 1).select("site_id", "query", F.col("page").alias("top_page"))
    return rows.join(top.hint("merge"), ["site_id", "query"], "left").select("site_id", "query", "clicks", "impressions", "ctr", "position", "gain", "top_page", priority_for(F.col("gain"), days).alias("priority"))


def top_pages(query_pages: DataFrame, most: int = 5) -> DataFrame:
    order = Window.partitionBy("site_id", "query").orderBy(F.desc("impressions"), "page")
    return query_pages.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def top_queries(query_pages: DataFrame, most: int = 5, without: DataFrame | None = None, least: int = 0) -> DataFrame:
    """The best queries of each page: ``site_id, page_key, place, query, impressions``.

    ``without`` (site_id, brand) drops queries that name the site's brand; ``least`` is the fewest impressions that count.
    """
    rows = query_pages.groupBy("site_id", page_key("page").alias("page_key"), "query").agg(F.sum("impressions").cast("long").alias("impressions")).where(F.col("impressions") >= least)
    if without is not None:
        brands = without.groupBy("site_id").agg(F.collect_set(F.lower("brand")).alias("brands"))
        rows = rows.join(brands.hint("merge"), "site_id", "left")
        rows = rows.where(~F.exists(F.coalesce("brands", F.array().cast("array<string>")), lambda b: F.contains(F.lower("query"), b))).drop("brands")
    order = Window.partitionBy("site_id", "page_key").orderBy(F.desc("impressions"), "query")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("site_id", "page_key", "place", "query", "impressions")


def declining_pages(now: DataFrame, before: DataFrame, days: int) -> DataFrame:
    """Pages with clicks at 70 % of the previous period or less: a full comparison by page key, left from the past."""
    key = lambda df, s: df.groupBy("site_id", page_key("page").alias("page_key")).agg(F.max_by(F.struct("page", "clicks", "position"), F.struct("clicks", "page")).alias(s))
    rows = key(before.where(F.col("clicks") >= scaled(20, days)), "b").join(key(now, "n"), ["site_id", "page_key"], "left")
    rows = rows.select("site_id", "page_key", F.col("b.page").alias("page"), F.col("b.clicks").alias("before"), F.coalesce("n.clicks", F.lit(0)).cast("long").alias("after"))
    rows = rows.where(F.col("after") <= F.col("before") * 0.7).withColumn("lost", F.col("before") - F.col("after"))
    drop = rounded(F.col("lost") / F.col("before") * 100).cast("long")
    return rows.select("site_id", "page_key", "page", "before", "after", "lost", drop.alias("drop_percent"), F.when(F.col("lost") >= scaled(50, days), "High").otherwise("Medium").alias("priority"))


def period_compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """Every page of either period: clicks and impressions now and before, by a full outer join on the page key."""
    key = lambda df, s: df.groupBy("site_id", page_key("page").alias("page_key")).agg(F.sum("clicks").cast("long").alias(f"clicks_{s}"), F.sum("impressions").cast("long").alias(f"impressions_{s}"))
    rows = key(now, "now").join(key(before, "before"), ["site_id", "page_key"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("site_id", "page_key", *[zero(c) for c in ("clicks_now", "impressions_now", "clicks_before", "impressions_before")])


def site_trend(totals_now: DataFrame, totals_before: DataFrame, days: int) -> DataFrame:
    """Each site's clicks now and before, the drop, and whether it is a finding (previous clicks enough, now 80 % or less)."""
    a = totals_now.select("site_id", F.col("clicks").alias("clicks_now"), F.col("impressions").alias("impressions_now"))
    b = totals_before.select("site_id", F.col("clicks").alias("clicks_before"), F.col("impressions").alias("impressions_before"))
    rows = a.join(b.hint("merge"), "site_id")
    drop = F.when(F.col("clicks_before") > 0, rounded((F.col("clicks_before") - F.col("clicks_now")) / F.col("clicks_before"), 4))
    found = (F.col("clicks_before") >= scaled(100, days)) & (F.col("clicks_now") <= F.col("clicks_before") * 0.8)
    return rows.select("*", drop.alias("drop"), found.alias("is_finding"))


def query_cannibalization(query_pages: DataFrame, days: int, most: int = 8) -> DataFrame:
    """Sets of pages that contend for the same queries: ``pages, n_pages, n_queries, impressions, priority``."""
    rows = query_pages.groupBy("site_id", "query", page_key("page").alias("page_key")).agg(F.max("impressions").alias("impressions"))
    whole = Window.partitionBy("site_id", "query")
    place = F.row_number().over(whole.orderBy(F.desc("impressions"), "page_key"))
    rows = rows.select("*", place.alias("place"), F.max("impressions").over(whole).alias("top"), F.sum("impressions").over(whole).alias("total"))
    rows = rows.where((F.col("total") >= scaled(50, days)) & ((F.col("place") == 1) | ((F.col("impressions") >= scaled(10, days)) & (F.col("impressions") >= F.col("top") * 0.25))))
    sets = rows.groupBy("site_id", "query").agg(F.concat_ws("|", F.array_sort(F.collect_list("page_key"))).alias("pages"), F.count("*").alias("n_pages"), F.max("total").alias("total")).where("n_pages > 1")
    groups = sets.groupBy("site_id", "pages").agg(F.max("n_pages").cast("long").alias("n_pages"), F.count("*").alias("n_queries"), F.sum("total").cast("long").alias("impressions"))
    return top_per_site(groups, most, F.desc("impressions"), "pages").withColumn("priority", F.when(F.col("impressions") >= scaled(500, days), "High").otherwise("Medium"))


QUESTION = r"^(who|what|when|where|why|how|which|can|could|does|do|did|is|are|was|were|should|will|would|has|have)\b"


def query_labels(queries: DataFrame, query_pages: DataFrame, model: DataFrame, tracked: DataFrame, days: int) -> DataFrame:
    """Each query with its top page and labels: quick win, low rate, question, pages compete, tracked.  ``tracked`` has ``site_id`` and ``query``."""
    shown = queries.select("site_id", F.lower("query").alias("q"), F.col("impressions").alias("query_impressions"))
    seen = query_pages.withColumn("q", F.lower("query")).join(shown.hint("merge"), ["site_id", "q"])
    meaningful = F.col("impressions") >= F.greatest(F.lit(float(scaled(10, days))), F.col("query_impressions") * 0.15)
    per = seen.groupBy("site_id", "q").agg(F.count("*").alias("n_pages"), F.count_if(meaningful).alias("n_meaningful"), F.max_by("page", F.struct("impressions", F.col("page"))).alias("top_page"))
    known = tracked.select("site_id", F.lower(F.trim("query")).alias("q")).distinct().withColumn("is_tracked", F.lit(True))
    rows = with_expected(queries, model).withColumn("q", F.lower("query")).join(per.hint("merge"), ["site_id", "q"], "left").join(known.hint("merge"), ["site_id", "q"], "left")
    return rows.select(
        "site_id", "query", "clicks", "impressions", "ctr", "position",
        F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"),
        F.coalesce("top_page", F.lit("")).alias("top_page"),
        (F.col("position").between(4, 20) & (F.col("impressions") >= scaled(30, days))).alias("quick_win"),
        ((F.col("position") > 0) & (F.col("position") <= 10) & (F.col("impressions") >= scaled(50, days)) & (F.col("ctr") < F.col("expected") * 0.6)).alias("low_ctr"),
        (F.lower(F.trim("query")).rlike(QUESTION) | F.trim("query").endswith("?")).alias("is_question"),
        (F.coalesce("n_meaningful", F.lit(0)) >= 2).alias("compete"),
        F.coalesce("is_tracked", F.lit(False)).alias("tracked"),
    )


def filter_queries(rows: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """The labelled queries of one kind (quick_win, low_ctr, question, compete, not_tracked) that contain a text."""
    tests = {"quick_win": F.col("quick_win"), "low_ctr": F.col("low_ctr"), "question": F.col("is_question"), "compete": F.col("compete"), "not_tracked": ~F.col("tracked")}
    if kind in tests:
        rows = rows.where(tests[kind])
    return rows.where(F.contains(F.lower("query"), F.lit(text.strip().lower()))) if text.strip() else rows


def trend_windows(log: DataFrame, days: int = 7) -> DataFrame:
    """Clicks and impressions of every window of ``days`` that slides by a day."""
    rows = log.groupBy("site_id", "date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    w = F.window(F.col("date").cast("timestamp"), f"{days} days", "1 day")
    return rows.groupBy("site_id", w.alias("w")).agg(F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions")).select("site_id", F.to_date("w.start").alias("first_day"), "clicks", "impressions")


def refresh_candidates(now: DataFrame, before: DataFrame, days: int, most: int = 12, sizes: DataFrame | None = None) -> DataFrame:
    """Each site's pages that lost clicks or impressions (30 %) or positions (3), or are thin, weighted by what was lost.

    ``sizes`` has site_id, page_key and word_count: a page under 500 words that is shown enough counts as thin.
    """
    key = lambda df, s: df.groupBy("site_id", page_key("page").alias("page_key")).agg(*[F.max_by(c, F.struct("impressions", "page")).alias(f"{c}_{s}") for c in ("clicks", "impressions", "position")])
    keys = ["site_id", "page_key"]
    rows = key(before, "before").join(key(now, "now").hint("merge"), keys)
    if sizes is not None:
        rows = rows.join(sizes.select(*keys, "word_count").hint("merge"), keys, "left")
    lost, unseen = F.col("clicks_before") - F.col("clicks_now"), F.col("impressions_before") - F.col("impressions_now")
    slip = rounded(F.col("position_now") - F.col("position_before"), 1)
    tests = {
        "clicks": ((F.col("clicks_before") >= scaled(10, days)) & (lost / F.col("clicks_before") >= 0.3), lost * 2.0),
        "impressions": ((F.col("impressions_before") >= scaled(100, days)) & (unseen / F.col("impressions_before") >= 0.3), unseen / 50),
        "position": ((F.col("position_before") > 0) & (slip >= 3) & (F.col("impressions_now") >= scaled(100, days)), slip * 3),
    }
    if sizes is not None:
        tests["thin"] = ((F.col("word_count") > 0) & (F.col("word_count") < 500) & (F.col("impressions_now") >= scaled(100, days)), F.col("impressions_now") / 100)
    weight = sum((F.when(t, w).otherwise(0.0) for t, w in tests.values()), F.lit(0.0))
    rows = rows.withColumn("reasons", F.concat_ws(",", *[F.when(t, k) for k, (t, _) in tests.items()])).where("reasons <> ''")
    return top_per_site(rows.withColumn("weight", rounded(weight, 3)), most, F.desc("weight"), "page_key")


def host_scope(rows: DataFrame, host: Column | str, column: str = "page") -> DataFrame:
    """Rows of a property of many hosts that belong to one host (``www.`` does not matter)."""
    return rows.where(host_of(column) == F.regexp_replace(F.lower(host if isinstance(host, Column) else F.lit(host)), r"^www[.]", ""))


def no_impressions(pages: DataFrame, query_pages: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """Indexable pages (site_id, url, status, noindex) that no search row names; sites without any row, or with a truncated report, give none."""
    seen = query_pages.select("site_id", page_key("page").alias("page_key")).distinct()
    judged = seen.select("site_id").distinct()
    if truncated is not None:
        judged = judged.join(truncated.select("site_id").distinct().hint("merge"), "site_id", "left_anti")
    rows = pages.where("status = 200 and not noindex").select("site_id", "url", page_key("url").alias("page_key")).join(judged.hint("merge"), "site_id", "left_semi")
    return rows.join(seen.hint("merge"), ["site_id", "page_key"], "left_anti").select("site_id", "url")
