"""Technical findings of each site: one builder a finding, all unioned, with severities that depend on what was found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.links import _cut, fetch_kind

#: URLs shown as evidence of a finding, and the points that findings cost a site's technical score, at most.
EVIDENCE, MOST_LOST = 25, 35
COST = {"Critical": 11, "High": 7, "Medium": 4, "Low": 2}
RANK = {"Critical": 3, "High": 2, "Medium": 1, "Low": 0}
ELSEWHERE = ("other_page", "cross_domain", "host_variant")


@dataclass
class Facts:
    """Tables of a crawl; every one has ``site_id``.

    pages: url, is_start, noindex, canonical_state, canonical (target url or null)
    statuses: url, status, error_code, content_type, redirect_kind (null without redirects), hops, downgrade
    inbound: url, source (pages that link to it, self-links dropped, aliases resolved)
    sitemap: url;  sitemap_info: url, complete, missing_confirmed, parse_error, mismatch_count
    robots: url, status, blocks_search;  blocked: url (may not be fetched)
    """

    pages: DataFrame
    statuses: DataFrame
    inbound: DataFrame
    sitemap: DataFrame
    sitemap_info: DataFrame
    robots: DataFrame
    blocked: DataFrame
    shared: dict[str, DataFrame] | None = None

    def settled(self) -> Facts:
        """The same facts with what several findings share written to the shared folder once."""
        if self.shared is None:
            names = ("kinds", "linked", "listed", "targets")
            plain = {n: getattr(self, n) for n in names}
            kinds = _cut(plain["kinds"]())
            self.shared = {"kinds": kinds}
            self.shared |= {n: _cut(plain[n]()) for n in names[1:]}
        return self

    def kinds(self) -> DataFrame:
        if self.shared and "kinds" in self.shared:
            return self.shared["kinds"]
        kind = fetch_kind("status", F.col("content_type"), F.col("error_code"))
        followed = (kind == "ok") & (F.coalesce("hops", F.lit(0)) > 0)
        return self.statuses.withColumn("kind", F.when(followed, "redirect").otherwise(kind))

    def linked(self) -> DataFrame:
        """Fetch states of linked URLs, start pages left out, with whether a start page links to them."""
        if self.shared and "linked" in self.shared:
            return self.shared["linked"]
        starts = self.pages.where("is_start").select("site_id", "url")
        home = starts.select("site_id", F.col("url").alias("source")).withColumn("home", F.lit(True))
        linked = self.inbound.join(home, ["site_id", "source"], "left").groupBy("site_id", "url").agg(F.coalesce(F.bool_or("home"), F.lit(False)).alias("from_home"))
        return self.kinds().join(linked.hint("merge"), ["site_id", "url"]).join(starts, ["site_id", "url"], "left_anti")

    def listed(self) -> DataFrame:
        if self.shared and "listed" in self.shared:
            return self.shared["listed"]
        return self.sitemap.select("site_id", "url").distinct()

    def targets(self) -> DataFrame:
        """Pages whose canonical is another page of the site, with what is known of that."""
        if self.shared and "targets" in self.shared:
            return self.shared["targets"]
        own = self.pages.where("canonical_state = 'other_page'").select("site_id", "url", F.col("canonical").alias("target"))
        state = self.kinds().select("site_id", F.col("url").alias("target"), "kind")
        page = self.pages.select("site_id", F.col("url").alias("target"), F.col("noindex").alias("target_noindex"), F.col("canonical_state").alias("target_state"))
        return own.join(state.hint("merge"), ["site_id", "target"], "left").join(page.hint("merge"), ["site_id", "target"], "left")


Builder = Callable[[Facts], DataFrame]
#: id: (category, builder of site_id, url, severity), in the order of report.
FINDINGS: dict[str, tuple[str, Builder]] = {}


def register_finding(name: str, category: str) -> Callable[[Builder], Builder]:
    """Add a finding: a function from the facts to ``site_id, url, severity``, one row for each URL concerned."""

    def add(build: Builder) -> Builder:
        FINDINGS[name] = (category, build)
        return build

    return add


def _rows(df: DataFrame, severity: str | Column) -> DataFrame:
    return df.select("site_id", "url", (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))


def _of_pages(test: str, severity: str) -> Builder:
    return lambda t: _rows(t.pages.where(test), severity)


def _of_linked(test: str, severity: str) -> Builder:
    return lambda t: _rows(t.linked().where(test), severity)


def _of_states(test: str, severity: str) -> Builder:
    return lambda t: _rows(t.kinds().where(test), severity)


def _of_listed(test: str, severity: str) -> Builder:
    return lambda t: _rows(t.kinds().join(t.listed().hint("merge"), ["site_id", "url"], "left_semi").where(test), severity)


def _of_info(test: str, severity: str) -> Builder:
    return lambda t: _rows(t.sitemap_info.where(test), severity)


def _share_of_noindex(t: Facts) -> DataFrame:
    share = t.pages.groupBy("site_id").agg((F.count_if(F.col("noindex") & ~F.col("is_start")) / F.count("*")).alias("share"))
    rows = t.pages.where("noindex and not is_start").join(share.hint("merge"), "site_id")
    return _rows(rows, F.when(F.col("share") >= 0.25, "Medium").otherwise("Low"))


def _missing_from_sitemap(t: Facts) -> DataFrame:
    keys = ["site_id", "url"]
    unfit = t.pages.where("noindex or canonical_state not in ('self', 'missing')").select(*keys)
    rows = t.linked().where("kind = 'ok' and not contains(url, '?')").join(t.listed(), keys, "left_anti").join(unfit, keys, "left_anti")
    return _rows(rows.join(t.sitemap_info.where("complete").select("site_id"), "site_id", "left_semi").join(t.listed().select("site_id"), "site_id", "left_semi"), "Low")


def _blocked(listed: bool, severity: str) -> Builder:
    def build(t: Facts) -> DataFrame:
        known = t.listed() if listed else t.inbound.select("site_id", "url").distinct()
        return _rows(t.blocked.join(known, ["site_id", "url"], "left_semi").distinct(), severity)

    return build


_elsewhere = "canonical_state in ('other_page', 'cross_domain', 'host_variant')"
# Ids, categories, severities.
for _name, _category, _build in (
    ("home_noindex", "Indexing", _of_pages("noindex and is_start", "Critical")),
    ("robots_blocks_search", "Indexing", lambda t: _rows(t.robots.where("blocks_search"), "Critical")),
    ("robots_missing", "Indexing", lambda t: _rows(t.robots.where("status in (404, 410)"), "Low")),
    ("noindex_pages", "Indexing", _share_of_noindex),
    ("links_blocked_by_robots", "Indexing", _blocked(False, "Low")),
    ("broken_links", "Technical", lambda t: _rows(t.linked().where("kind = 'broken'"), F.when(F.col("from_home"), "Critical").otherwise("High"))),
    ("server_errors", "Technical", _of_linked("kind = 'server_error'", "High")),
    ("restricted_links", "Technical", _of_linked("kind = 'restricted'", "Low")),
    ("unreachable_links", "Technical", _of_linked("kind = 'unreachable'", "Medium")),
    ("redirecting_links", "Technical", _of_linked("kind = 'redirect' and coalesce(redirect_kind, '') <> 'slash'", "Medium")),
    ("slash_redirects", "Technical", _of_linked("kind = 'redirect' and redirect_kind = 'slash'", "Low")),
    ("redirect_chains", "Technical", lambda t: _rows(t.kinds().where("hops >= 2"), F.when(F.col("hops") >= 3, "High").otherwise("Medium"))),
    ("redirect_loops", "Technical", _of_states("kind = 'redirect_loop'", "High")),
    ("https_downgrade", "Technical", _of_states("downgrade", "High")),
    ("offsite_redirects", "Technical", _of_linked("kind = 'redirect_offsite'", "Low")),
    ("canonical_multiple", "Technical", _of_pages("canonical_state = 'multiple'", "Medium")),
    ("canonical_invalid", "Technical", _of_pages("canonical_state = 'invalid'", "High")),
    ("canonical_protocol", "Technical", _of_pages("canonical_state = 'protocol_mismatch'", "High")),
    ("canonical_host", "Technical", _of_pages("canonical_state = 'host_variant'", "Medium")),
    ("canonical_cross_domain", "Technical", _of_pages("canonical_state = 'cross_domain'", "Medium")),
    ("canonical_bad_target", "Technical", lambda t: _rows(t.targets().where("kind in ('broken', 'server_error', 'redirect')"), F.when(F.col("kind") == "redirect", "Medium").otherwise("High"))),
    ("canonical_noindex_target", "Technical", lambda t: _rows(t.targets().where("target_noindex"), "High")),
    ("canonical_chain", "Technical", lambda t: _rows(t.targets().where(F.col("target_state").isin(*ELSEWHERE)), "Medium")),
    ("canonical_noindex_conflict", "Technical", _of_pages(f"noindex and {_elsewhere}", "Medium")),
    ("sitemap_host_mismatch", "Indexing", _of_info("mismatch_count > 0", "High")),
    ("sitemap_missing", "Indexing", _of_info("missing_confirmed", "Medium")),
    ("sitemap_invalid", "Indexing", _of_info("parse_error", "Medium")),
    ("sitemap_errors", "Indexing", _of_listed("kind in ('broken', 'server_error')", "High")),
    ("sitemap_redirects", "Indexing", _of_listed("kind = 'redirect' and coalesce(redirect_kind, '') <> 'slash'", "Medium")),
    ("sitemap_noindex", "Indexing", lambda t: _rows(t.pages.where("noindex").join(t.listed(), ["site_id", "url"], "left_semi"), "High")),
    ("sitemap_noncanonical", "Indexing", lambda t: _rows(t.pages.where(f"{_elsewhere} or canonical_state = 'protocol_mismatch'").join(t.listed(), ["site_id", "url"], "left_semi"), "Medium")),
    ("sitemap_blocked", "Indexing", _blocked(True, "High")),
    ("sitemap_missing_pages", "Indexing", _missing_from_sitemap),
):
    register_finding(_name, _category)(_build)


def severity_rank(severity: Column | str) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(0)
    for k, v in RANK.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def technical_findings(facts: Facts) -> DataFrame:
    """``site_id, finding, category, severity, urls, evidence``: the worst severity of a finding's URLs, how many, and the first EVIDENCE of them."""
    facts = facts.settled()
    parts = [build(facts).withColumn("finding", F.lit(k)).withColumn("category", F.lit(c)) for k, (c, build) in FINDINGS.items()]
    rows = reduce(DataFrame.unionByName, parts)
    grouped = rows.groupBy("site_id", "finding", "category").agg(F.max_by("severity", severity_rank("severity")).alias("severity"), F.count_distinct("url").alias("urls"), F.array_sort(F.collect_set("url")).alias("all"))
    return grouped.select("site_id", "finding", "category", "severity", "urls", F.array_join(F.slice("all", 1, EVIDENCE), " ").alias("evidence"))


def site_penalty(findings: DataFrame) -> DataFrame:
    """Points that a site's technical score loses: ``site_id, penalty``."""
    cost = F.lit(0)
    for k, v in COST.items():
        cost = F.when(F.col("severity") == k, v).otherwise(cost)
    return findings.groupBy("site_id").agg(F.least(F.lit(MOST_LOST), F.sum(cost)).cast("long").alias("penalty"))


def technical_summary(facts: Facts) -> DataFrame:
    """Counts of each site: pages, URLs checked, noindex pages, broken and redirecting links, canonical problems, sitemap URLs and how many were checked."""
    facts = facts.settled()
    bad = F.col("canonical_state").isin("multiple", "invalid", "protocol_mismatch", "host_variant", "cross_domain")
    pages = facts.pages.groupBy("site_id").agg(F.count("*").alias("pages"), F.count_if("noindex").alias("noindex_pages"), F.count_if(bad).alias("canonical_bad"))
    checked = facts.statuses.groupBy("site_id").agg(F.count_distinct("url").alias("urls_checked"))
    linked = facts.linked().groupBy("site_id").agg(F.count_if(F.col("kind") == "broken").alias("broken_links"), F.count_if((F.col("kind") == "redirect") & (F.coalesce("redirect_kind", F.lit("")) != "slash")).alias("redirecting_links"))
    targets = facts.targets().where("kind in ('broken', 'server_error', 'redirect')").groupBy("site_id").agg(F.count("*").alias("bad_targets"))
    listed = facts.listed().join(facts.statuses.select("site_id", "url").distinct().withColumn("seen", F.lit(1)), ["site_id", "url"], "left").groupBy("site_id").agg(F.count("*").alias("sitemap_urls"), F.count("seen").alias("sitemap_checked"))
    rows = pages
    for part in (checked, linked, targets, listed):
        rows = rows.join(part.hint("merge"), "site_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("site_id", "pages", zero("urls_checked").alias("urls_checked"), "noindex_pages", zero("broken_links").alias("broken_links"), zero("redirecting_links").alias("redirecting_links"), (F.col("canonical_bad") + zero("bad_targets")).alias("canonical_problems"), zero("sitemap_urls").alias("sitemap_urls"), zero("sitemap_checked").alias("sitemap_checked"))
