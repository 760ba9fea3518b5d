"""Stored records beside current findings: matching, migration, staleness, orders, and a site's report figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import priority_rank, rounded, slug

# Enums with their fallback, and prefixes that old ids began with.
PRIORITIES, CONFIDENCES = ("Critical", "High", "Medium", "Low"), ("High", "Medium", "Low")
ACTION_TYPES = ("Meta Fix", "Content Update", "Schema Markup", "Internal Link", "Technical Fix", "FAQ Addition")
STATUSES = ("New", "Pending Approval", "Approved", "Rejected", "Applied", "Verified")
KINDS = ("observed", "ai_analysis", "ai_estimate")
LEGACY_PREFIXES = (("uni_kw_", ""), ("uni_aeo_", "saeor_"), ("uni_geo_", "sgeoo_"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def enum(x: Column | str, names: tuple[str, ...], other: str) -> Column:
    """The known spelling of a value whatever its case, else ``other``."""
    table = F.create_map(*[v for n in names for v in (F.lit(n.lower()), F.lit(n))])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(_col(x)))), F.lit(other))


def stable_id(*parts: Column | str) -> Column:
    """A short id from content, the same wherever it is computed."""
    return F.lower(F.hex(F.xxhash64(*parts)))


def issue_id(name: Column | str, category: Column | str, title: Column | str, urls: Column | str) -> Column:
    """The id of a finding by what it describes: findings with ids of their own keep them, numbered ones are named by their pages or title."""
    n = _col(name)
    base = F.regexp_replace(n, "_[0-9]+$", "")
    said = F.array_join(F.slice(F.array_sort(_col(urls)), 1, 3), "|")
    return (
        F.when(n.startswith("mkt_"), F.concat(F.lit("mkt:"), n))
        .when(n.startswith("tech_") | n.isin("site_orphan", "site_weak"), F.concat(F.lit("tech:"), n))
        .when(base == "rec", F.concat(F.lit("tech:rec:"), slug(F.concat_ws(" ", _col(category), _col(title)), 80)))
        .otherwise(F.concat(F.lit("tech:"), base, F.lit(":"), slug(F.when(said != "", said).otherwise(_col(title)), 80)))
    )


def age_days(at: Column | str, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(_col(at).cast("timestamp"))) / 86400)


def pct_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, rounded((now - before) / before * 100, 1))


def canonical_source_id(x: Column | str) -> Column:
    s = _col(x)
    out = s
    for old, new in LEGACY_PREFIXES:
        out = F.when(s.startswith(old), F.concat(F.lit(new), F.substring(s, len(old) + 1, 300))).otherwise(out)
    return out


def candidates_distinct(rows: DataFrame) -> DataFrame:
    """The first candidate (by ord) of each source id of a site; those without id or title are dropped."""
    good = rows.where((F.trim(F.coalesce("source_id", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    first = F.row_number().over(Window.partitionBy("site_id", "source_id").orderBy("ord"))
    return good.withColumn("_n", first).where("_n = 1").drop("_n")


def migrate_records(records: DataFrame) -> DataFrame:
    """Stored records in today's shape, the newest of each source id: ids, enums and provenance normalised; what is unknown stays null.

    ``records``: site_id, id, source_id, module, kind, title, type, priority, confidence, source, country, crawl_id, status, created_at.
    """
    said = F.concat_ws(" ", "source", "module")
    inferred = F.when(said.rlike("(?i)Crawled Data|crawl signals|Site-wide Audit"), "observed").when(said.rlike("(?i)Simulat"), "ai_estimate").otherwise("ai_analysis")
    shaped = records.withColumns({
        "source_id": F.coalesce(canonical_source_id("source_id"), F.concat(F.lit("manual_"), F.col("id").cast("string"))), "kind": F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(inferred),
        "title": F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Untitled action").otherwise(F.trim("title")), "module": F.coalesce(F.nullif(F.trim("module"), F.lit("")), F.lit("Other")),
        "type": enum("type", ACTION_TYPES, "Content Update"), "priority": enum("priority", PRIORITIES, "Medium"), "confidence": enum("confidence", CONFIDENCES, "Medium"), "status": enum("status", STATUSES, "New"),
    })
    newest = F.row_number().over(Window.partitionBy("site_id", "source_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id")))
    return shaped.withColumn("_n", newest).where("_n = 1").drop("_n")


def match_records(candidates: DataFrame, records: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates with their stored record, by source id or else by module and title, and records that no candidate brings up any more.

    ``candidates``: site_id, source_id, module, title; ``records``: those and id, status, crawl_id, country; ``current``: site_id, crawl_id, market.
    Returns ``site_id, source_id, title, record_id, state, current, stale, other_market``.
    """
    key = F.concat_ws("|", F.lower("module"), F.lower("title"))
    mine = records.select("site_id", F.col("source_id").alias("rs"), F.col("id").alias("record_id"), F.col("title").alias("record_title"), "status", "crawl_id", "country", key.alias("key"))
    rows = candidates.select("site_id", "source_id", "title", key.alias("key"))
    named = rows.join(mine.drop("key").hint("merge"), (rows.site_id == mine.site_id) & (F.col("source_id") == F.col("rs")), "left").drop(mine.site_id)
    found = named.where("record_id is not null")
    spare = mine.join(found.select("site_id", "record_id").hint("merge"), ["site_id", "record_id"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("site_id", "key").orderBy("record_id"))).where("_n = 1").drop("_n")
    rest = named.where("record_id is null").select("site_id", "source_id", "title", "key").withColumn("_n", F.row_number().over(Window.partitionBy("site_id", "key").orderBy("source_id")))
    again = rest.join(spare.withColumn("_n", F.lit(1)).hint("merge"), ["site_id", "key", "_n"], "left")
    columns = ["site_id", "source_id", "title", "record_id", "record_title", "status", "crawl_id", "country"]
    matched = found.select(*columns).unionByName(again.select(*columns)).withColumn("current", F.lit(True))
    gone = mine.join(matched.where("record_id is not null").select("site_id", "record_id").hint("merge"), ["site_id", "record_id"], "left_anti")
    gone = gone.select("site_id", F.col("rs").alias("source_id"), F.col("record_title").alias("title"), "record_id", "record_title", "status", "crawl_id", "country", F.lit(False).alias("current"))
    now = current.select("site_id", F.col("crawl_id").alias("_crawl"), F.col("market").alias("_market"))
    out = matched.unionByName(gone).join(now.hint("merge"), "site_id", "left")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False)) & F.col("record_id").isNotNull()
    return out.select("site_id", "source_id", F.coalesce("record_title", "title").alias("title"), "record_id", F.coalesce("status", F.lit("Open")).alias("state"), "current", differs("crawl_id", "_crawl").alias("stale"), differs("country", "_market").alias("other_market"))


def record_order(rows: DataFrame) -> DataFrame:
    """Priority, then proof over inference, then indexing and technical findings, then how many pages, then the title."""
    kind = F.when(F.col("kind") == "observed", 0).when(F.col("kind") == "ai_analysis", 1).when(F.col("kind") == "ai_estimate", 2).otherwise(3)
    category = F.when(F.col("category") == "Indexing", 0).when(F.col("category") == "Technical", 1).otherwise(2)
    return rows.orderBy("site_id", priority_rank("priority"), kind, category, F.desc("breadth"), F.collate("title", "UNICODE"))


def audit_order(rows: DataFrame) -> DataFrame:
    """Severity, then how many URLs are affected."""
    return rows.orderBy("site_id", priority_rank("severity"), F.desc("urls"), "finding")


def link_tracking(links: DataFrame, tracked: DataFrame) -> DataFrame:
    """How many of the suggested links of each target are tracked and applied, and the state that gives: ``site_id, target, links, tracked, applied, state``.

    ``links``: site_id, source, target; ``tracked``: those and status.
    """
    keys = ["site_id", "source", "target"]
    known = tracked.groupBy(*keys).agg(F.bool_or(F.col("status") == "Applied").alias("applied"))
    rows = links.select(*keys).distinct().join(known.hint("merge"), keys, "left").groupBy("site_id", "target").agg(F.count("*").alias("links"), F.count("applied").alias("tracked"), F.count_if(F.coalesce("applied", F.lit(False))).alias("applied"))
    return rows.withColumn("state", F.when(F.col("applied") == F.col("links"), "done").when(F.col("tracked") == F.col("links"), "in_actions").otherwise("new"))


def staleness_guard(results: DataFrame, crawls: DataFrame) -> DataFrame:
    """Derived results that still hold: of the site's current crawl (or of no known one), and the newest request of their kind.

    ``results``: site_id, kind, crawl_id, seq; ``crawls``: site_id, crawl_id (the current one).
    """
    now = crawls.select("site_id", F.col("crawl_id").alias("_now"))
    rows = results.join(now.hint("merge"), "site_id", "left").where("crawl_id is null or _now is null or crawl_id = _now").drop("_now")
    newest = F.row_number().over(Window.partitionBy("site_id", "kind").orderBy(F.desc("seq")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")


# Bounds of the vitals (good up to, poor above) and their order.
VITALS = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.1, 0.25)}


def weak_vitals(vitals: DataFrame) -> DataFrame:
    """Vitals of each page that are not good, field data before lab data, poor ones first: ``site_id, url, strategy, place, metric, value, source, rating``.

    ``vitals``: site_id, url, strategy, field_lcp, field_inp, field_cls, lab_lcp, lab_cls.
    """
    parts = []
    for name, (good, poor) in VITALS.items():
        field, lab = F.col(f"field_{name}"), F.col(f"lab_{name}") if name != "inp" else F.lit(None).cast("double")
        value = F.coalesce(field, lab)
        rating = F.when(value <= good, "good").when(value <= poor, "needs improvement").otherwise("poor")
        parts.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("metric"), value.alias("value"), F.when(field.isNotNull(), "field").otherwise("lab").alias("source"), rating.alias("rating"))))
    rows = vitals.select("site_id", "url", "strategy", F.explode(F.array_compact(F.array(*parts))).alias("v")).select("site_id", "url", "strategy", "v.*").where("rating <> 'good'")
    order = Window.partitionBy("site_id", "url", "strategy").orderBy(F.when(F.col("rating") == "poor", 0).otherwise(1), "source", "metric")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def site_report_metrics(findings: DataFrame, totals: DataFrame, queries: DataFrame, vitals: DataFrame, topics: DataFrame) -> DataFrame:
    """The figures of a site's report, one row each: ``site_id, section, metric, value``.

    ``findings``: site_id, severity; ``totals``: site_id, clicks_now, clicks_before, impressions_now, impressions_before; ``queries``: site_id, quick_win;
    ``vitals``: site_id, rating; ``topics``: site_id, stage.
    """
    count = lambda df, section, by: df.groupBy("site_id", F.col(by).alias("metric")).agg(F.count("*").cast("double").alias("value")).select("site_id", F.lit(section).alias("section"), "metric", "value")
    change = lambda m: F.struct(F.lit(f"{m}_change").alias("metric"), pct_change(F.col(f"{m}_now"), F.col(f"{m}_before")).alias("value"))
    moved = totals.select("site_id", F.lit("search").alias("section"), F.explode(F.array(change("clicks"), change("impressions"))).alias("m")).select("site_id", "section", "m.metric", "m.value")
    wins = queries.where("quick_win").groupBy("site_id").agg(F.count("*").cast("double").alias("value")).select("site_id", F.lit("search").alias("section"), F.lit("quick_wins").alias("metric"), "value")
    return reduce(DataFrame.unionByName, [count(findings, "issues", "severity"), moved, wins, count(vitals, "vitals", "rating"), count(topics, "content", "stage")])


def scorecard(items: DataFrame) -> DataFrame:
    """Scores of each group of a site and of the whole site, by rollup: ``site_id, group, passed, warned, failed, score``.

    ``items``: site_id, group, item, bad, of (how many of how many pages fail; both null where it was not measured, ``of`` 0 where it does not apply),
    manual (pass, fail or todo, or null).  A share of 0 passes, up to a fifth warns; the score is passes and half the warnings of what was measured.
    """
    share = F.col("bad") / F.col("of")
    status = F.when(F.col("manual").isNotNull(), F.col("manual")).when(F.col("bad").isNull(), "unknown").when(F.col("of") == 0, "na").when(share == 0, "pass").when(share <= 0.2, "warn").otherwise("fail")
    rows = items.withColumn("status", status)
    out = rows.groupingSets([["site_id", "group"], ["site_id"]], "site_id", "group").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"))])
    measured = F.col("passed") + F.col("warned") + F.col("failed")
    return out.select("site_id", F.coalesce("group", F.lit("all")).alias("group"), "passed", "warned", "failed", F.when(measured > 0, rounded((F.col("passed") + F.col("warned") * 0.5) / measured * 100)).cast("long").alias("score"))


def page_items(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Scorecard items from page rules: every rule of every site, with how many of its pages break it.  ``issues``: site_id, rule."""
    from plumbline.operators.pages import RULES

    group = {"On-Page": "On-page", "Technical": "Technical", "Content": "Content", "Schema": "Structured data"}
    sites = records.groupBy("site_id").agg(F.count("*").alias("of"))
    names = F.explode(F.array(*[F.struct(F.lit(group[c]).alias("group"), F.lit(k).alias("item")) for k, (c, _) in RULES.items()]))
    every = sites.select("site_id", "of", names.alias("x")).select("site_id", "of", "x.*")
    broken = issues.groupBy("site_id", F.col("rule").alias("item")).agg(F.count("*").alias("bad"))
    rows = every.join(broken.hint("merge"), ["site_id", "item"], "left")
    return rows.select("site_id", "group", "item", F.coalesce("bad", F.lit(0)).alias("bad"), "of", F.lit(None).cast("string").alias("manual"))
