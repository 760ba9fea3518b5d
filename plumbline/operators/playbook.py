"""The playbook: every item of eight groups judged for every site from three tables of facts and the owner's marks, and one rollup of scores.

Items are a fixed table.  Facts are ``shares`` (site_id, measure, bad, of), ``counts`` (site_id, measure, n) and ``found`` (site_id, finding); each kind of item reads them by one
rule, so there is one join for each table and no plan for each item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import rounded

#: Points of a status, and the share of pages up to which a fault is a warning.
POINTS = {"pass": 1.0, "warn": 0.5, "fail": 0.0, "todo": 0.0}
WARNING_SHARE = 0.2
#: Group, item, kind, measure (for ``found``: what must have been looked at), numbers or findings of the kind.
ITEMS = [
    ("setup", "s_gsc", "count", "search_rows", 1), ("setup", "s_index", "found", "pages", (("tech_home_noindex", "tech_robots_blocks_search"), ("tech_noindex_pages", "tech_sitemap_noindex"))),
    ("technical", "t_https", "found", "pages", (("play_https_site",), ("play_https_pages", "insecure"))), ("technical", "t_cwv", "found", "speed_tests", (("poor_vital",), ("weak_vital",))),
    ("technical", "t_links", "found", "pages", (("tech_broken_links",), ())), ("technical", "t_mobile", "share", "no_viewport", None), ("technical", "t_sitemap", "found", "pages", (("tech_no_sitemap",), ("tech_sitemap_errors", "tech_sitemap_noindex"))),
    ("technical", "t_robots", "found", "pages", (("tech_robots_blocks_search",), ("tech_no_robots",))), ("technical", "t_canonical", "share", "missing_canonical", None), ("technical", "t_schema", "share_or_none", "no_schema", None),
    ("technical", "t_crawl", "found", "pages", (("tech_redirect_loops", "tech_server_errors", "tech_unreachable", "tech_restricted", "tech_robots_blocks_search", "tech_home_noindex"), ())), ("technical", "t_clean_urls", "share", "messy_url", None),
    ("technical", "t_redirects", "found", "pages", (("tech_redirect_loops", "tech_https_downgrade"), ("tech_redirect_chains", "tech_redirecting_links"))), ("technical", "t_302", "share", "temporary_redirect", None),
    ("technical", "t_http_links", "share", "http_links", None), ("technical", "t_depth", "share", "deep_page", None),
    ("onpage", "o_title", "share", "bad_title", None), ("onpage", "o_meta", "share", "bad_description", None), ("onpage", "o_h1", "share", "not_one_h1", None), ("onpage", "o_headings", "share", "heading_skip", None), ("onpage", "o_early", "share", "query_not_early", None),
    ("onpage", "o_url", "share", "long_url", None), ("onpage", "o_links", "share", "weakly_linked", None), ("onpage", "o_orphan", "share", "orphan", None), ("onpage", "o_alt", "share", "missing_alt", None), ("onpage", "o_anchors", "share", "vague_anchors", None),
    ("local", "l_gbp", "progress", "gbp", None), ("local", "l_citations", "progress", "citations", None), ("local", "l_nap", "found", "business_profile", (("nap_fail",), ("nap_warn",))), ("local", "l_reviews", "progress", "reviews", None),
    ("local", "l_schema", "found", "pages", (("local_schema_fail",), ("local_schema_warn",))), ("local", "l_pages", "cover", "area_without_page", None),
    ("content", "c_depth", "share", "thin", None), ("content", "c_related", "count", "keywords", 10), ("content", "c_comp_kw", "count", "analysed_competitors", 1), ("content", "c_paa", "count", "questions", 5), ("content", "c_refresh", "over", "refresh_pages", 3),
    ("content", "c_clusters", "count", "clusters", 3), ("content", "c_cannibal", "over", "cannibals", 2), ("content", "c_faq", "count_on_pages", "faq_pages", 3), ("content", "c_visuals", "share", "no_images", None),
    ("offpage", "f_links", "count", "links_submitted", 3), ("offpage", "f_find", "count", "links_found", 5), ("offpage", "f_guest", "count", "guest_posts", 1), ("offpage", "f_directory", "count", "directory_links", 1),
    ("advanced", "a_competitors", "count", "competitors", 3), ("advanced", "a_shifts", "count", "search_rows", 1), ("ai", "ai_visibility", "count", "visibility_checks", 1), ("ai", "ai_structure", "count_on_pages", "answer_pages", 3),
] + [
    (group, item, "manual", "", None)
    for group, names in {
        "setup": "s_bing s_ga4 s_plugin s_submit s_manual", "technical": "t_toxic t_dupver", "onpage": "o_stuffing", "local": "l_nearme l_geoimages", "content": "c_intent c_snippets c_audit c_lists c_readability",
        "offpage": "f_analyze f_gap f_pr f_mentions f_social f_haro f_ugc f_influencer f_monitor", "advanced": "a_voice a_ai a_eeat a_trends a_zeroclick a_programmatic a_youtube", "ai": "ai_crawlers ai_llms",
    }.items()
    for item in names.split()
]


def items(sites: DataFrame, shares: DataFrame, counts: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """``site_id, group, item, status`` for every item of every site: pass, warn, fail, todo, unknown or na.

    ``marks``: site_id, item, mark (done or na).  ``share``: none of the pages passes, up to a fifth of them warns; unknown where nothing was counted.  ``progress`` and ``cover``: all done
    passes, some warns.  ``count``: enough passes, some warns, none is to do (of pages: fails, or is unknown without a row).  ``over``: none passes, few warn.  ``found``: findings that fail or
    warn, unknown where nothing was looked at.
    """
    spec = "struct<group:string,item:string,kind:string,measure:string,least:int,failing:array<string>,warning:array<string>>"
    rows = [{"group": g, "item": i, "kind": k, "measure": m, "least": a if isinstance(a, int) else None, "failing": list(a[0]) if k == "found" else [], "warning": list(a[1]) if k == "found" else []} for g, i, k, m, a in ITEMS]
    every = sites.select("site_id").distinct().select("site_id", F.explode(F.from_json(F.lit(_json(rows)), f"array<{spec}>")).alias("x")).select("site_id", "x.*")
    share = shares.groupBy("site_id", "measure").agg(F.sum("bad").alias("bad"), F.sum("of").alias("of"))
    count = counts.groupBy("site_id", "measure").agg(F.sum("n").alias("n"))
    seen = found.groupBy("site_id").agg(F.collect_set("finding").alias("seen"))  # kinds of findings, a fixed list
    at = ["site_id", "measure"]
    rows = every.join(share.hint("merge"), at, "left").join(count.hint("merge"), at, "left").join(seen.hint("merge"), "site_id", "left").join(marks.select("site_id", "item", "mark").hint("merge"), ["site_id", "item"], "left")
    none = F.coalesce("seen", F.array().cast("array<string>"))
    part, n = F.col("bad") / F.col("of"), F.coalesce("n", F.lit(0))
    by_share = F.when(F.coalesce("of", F.lit(0)) == 0, "unknown").when(F.col("bad") == 0, "pass").when(part <= WARNING_SHARE, "warn").otherwise("fail")
    kinds = {
        "share": by_share, "share_or_none": F.when(F.col("bad") == F.col("of"), F.when(F.col("of") > 0, "fail").otherwise("unknown")).otherwise(by_share),
        "progress": F.when(F.coalesce("of", F.lit(0)) == 0, "todo").when(F.col("bad") == 0, "pass").when(F.col("bad") < F.col("of"), "warn").otherwise("todo"), "cover": F.when(F.coalesce("of", F.lit(0)) == 0, "unknown").when(F.col("bad") == 0, "pass").when(F.col("bad") < F.col("of"), "warn").otherwise("fail"),
        "count": F.when(n >= F.col("least"), "pass").when(n > 0, "warn").otherwise("todo"), "count_on_pages": F.when(F.col("n").isNull(), "unknown").when(n >= F.col("least"), "pass").when(n > 0, "warn").otherwise("fail"),
        "over": F.when(F.col("n").isNull(), "unknown").when(n == 0, "pass").when(n > F.col("least"), "fail").otherwise("warn"),
        "found": F.when(n == 0, "unknown").when(F.arrays_overlap(none, "failing"), "fail").when(F.arrays_overlap(none, "warning"), "warn").otherwise("pass"), "manual": F.when(F.col("mark") == "done", "pass").otherwise("todo"),
    }
    status = F.lit(None).cast("string")
    for kind, rule in kinds.items():
        status = F.when(F.col("kind") == kind, rule).otherwise(status)
    return rows.select("site_id", "group", "item", F.when(F.col("mark") == "na", "na").otherwise(status).alias("status"))


def _json(rows: list[dict]) -> str:
    import json

    return json.dumps(rows)


def rollup(judged: DataFrame) -> DataFrame:
    """Scores of each group of a site and of the site: ``site_id, group, items, measured, unknown, score``; what is to do counts as measured, without points."""
    points = F.lit(None).cast("double")
    for status, value in POINTS.items():
        points = F.when(F.col("status") == status, value).otherwise(points)
    out = judged.withColumn("points", points).groupingSets([["site_id", "group"], ["site_id"]], "site_id", "group").agg(
        F.count("*").alias("items"), F.count("points").alias("measured"), F.count_if(F.col("status") == "unknown").alias("unknown"), F.sum("points").alias("sum")
    )
    return out.select("site_id", F.coalesce("group", F.lit("all")).alias("group"), "items", "measured", "unknown", rounded(F.col("sum") / F.nullif("measured", F.lit(0)) * 100).cast("long").alias("score"))


def page_shares(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Shares that page records and their issues (site_id, page_id, rule) give: how many of a site's pages have each fault."""
    sites = records.groupBy("site_id").agg(F.count("*").alias("of"), F.count_if(F.col("images") == 0).alias("no_images"))
    several = {"bad_title": ("missing_title", "long_title"), "bad_description": ("missing_description", "long_description"), "not_one_h1": ("missing_h1", "many_h1")}
    single = ("no_viewport", "missing_canonical", "no_schema", "heading_skip", "long_url", "missing_alt", "vague_anchors", "thin")
    measure = F.lit(None).cast("string")
    for name, rules in (several | {r: (r,) for r in single}).items():
        measure = F.when(F.col("rule").isin(*rules), name).otherwise(measure)
    faults = issues.select("site_id", "page_id", measure.alias("measure")).where("measure is not null").distinct().groupBy("site_id", "measure").agg(F.count("*").alias("bad"))
    named = sites.select("site_id", "of", F.explode(F.array(*[F.lit(m) for m in (*several, *single)])).alias("measure"))
    rows = named.join(faults.hint("merge"), ["site_id", "measure"], "left").select("site_id", "measure", F.coalesce("bad", F.lit(0)).alias("bad"), "of")
    return rows.unionByName(sites.select("site_id", F.lit("no_images").alias("measure"), F.col("no_images").alias("bad"), "of"))
