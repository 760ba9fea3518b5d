"""Crawl directives and states: robots rules, meta directives, canonicals, redirects, hreflang, structured data, vitals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import host_of, normalize_url
from plumbline.operators.records import VITALS


def parse_robots(files: DataFrame) -> DataFrame:
    """Rules of robots files (site, text): ``site, group_id, agent, allow, pattern``.

    Agent lines in a row share a group, so a group starts at an agent line that follows another kind of line.
    """
    lines = files.select("site", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    pair = lines.select("site", "pos", F.lower(F.trim(F.regexp_extract(line, "^([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract(line, "^[^:]+:(.*)$", 1)).alias("value"))
    pair = pair.where("key <> '' and key <> 'sitemap'")  # other directives end a run of agent lines
    order = Window.partitionBy("site").orderBy("pos")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = pair.withColumn("group_id", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("key = 'user-agent' and value <> ''").select("site", "group_id", F.lower("value").alias("agent")).distinct()
    rules = grouped.where("key in ('allow', 'disallow') and value <> ''").select("site", "group_id", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(rules.hint("merge"), ["site", "group_id"], "left")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """Sitemap lines of robots files (site, text): ``site, url``."""
    lines = files.select("site", F.explode(F.split("text", "\r?\n")).alias("line"))
    return lines.select("site", F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)).alias("url")).where("url <> ''").distinct()


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for an agent: ``site, allow, pattern``.  Of the agent names within its own the longest one's groups count, else those for all."""
    fits = F.when((F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent")), F.length("agent"))
    best = rules.groupBy("site").agg(F.max_by("agent", F.struct(fits, "agent")).alias("own"), F.max(fits).alias("fits"))
    used = rules.join(best.hint("merge"), "site").where(F.col("agent") == F.when(F.col("fits").isNull(), F.lit("*")).otherwise(F.col("own")))
    return used.where("pattern is not null").select("site", "allow", "pattern").distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Whether each (site, path) may be fetched: the longest matching pattern decides, allow wins ties, none allows.

    A rule is found by the part of its pattern before the first wildcard: a path's beginnings, of the lengths that its site's rules have, are joined with
    these, so no site meets all its rules with all its paths.  Only patterns that go on after that part are tested as regular expressions.
    """
    literal = F.regexp_extract("pattern", r"^((?:[^*$]|\$(?!$))*)", 1)
    used = rules_for(rules, agent).withColumn("start", literal)
    quoted = F.regexp_replace("pattern", r"([\\.+?()\[\]{}^|]|\$(?!$))", r"\\$1")
    used = used.select("site", "allow", "start", F.length("pattern").alias("size"), F.when(F.col("start") != F.col("pattern"), F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))).alias("regex"))
    lengths = used.groupBy("site").agg(F.collect_set(F.length("start")).alias("lengths"))  # as many as a path has characters at most
    asked = urls.select("site", "path").distinct()
    begun = asked.join(lengths.hint("merge"), "site").select("site", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    begun = begun.select("site", "path", F.expr("substring(path, 1, n)").alias("start"))
    hits = begun.join(used.hint("merge"), ["site", "start"]).where("regex is null or path rlike regex")
    best = hits.groupBy("site", "path").agg(F.max_by("allow", F.struct("size", "allow")).alias("allowed"))
    return urls.join(best.hint("merge"), ["site", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def blocks_site(sites: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Whether an agent is kept out of a whole site: ``site, blocked``, by sample paths of every kind."""
    paths = sites.select("site").distinct().select("site", F.explode(F.array(*[F.lit(p) for p in ("/", "/about", "/blog/post", "/products/item-1?x=1")])).alias("path"))
    return robots_allowed(paths, rules, agent).groupBy("site").agg((~F.bool_or("allowed")).alias("blocked"))


def directives(content: Column) -> tuple[Column, Column]:
    """noindex and nofollow of a robots content; ``none`` means both."""
    words = F.transform(F.split(F.lower(F.coalesce(content, F.lit(""))), ","), lambda w: F.trim(w))
    none = F.array_contains(words, "none")
    return F.array_contains(words, "noindex") | none, F.array_contains(words, "nofollow") | none


def page_directives(metas: Column, header: Column) -> Column:
    """noindex, nofollow and where noindex comes from, of a page's robots contents and its X-Robots-Tag header.

    Parts of the header that name another agent than googlebot are left out; the page's own tags come first.
    """
    meta_no = F.exists(metas, lambda m: directives(m)[0])
    meta_follow = F.exists(metas, lambda m: directives(m)[1])
    named = r"^([a-z][a-z0-9_*-]*)\s*:\s*(.*)$"
    # an agent's name holds until the next one: carried along the comma-separated parts
    parts = F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), lambda w: F.trim(w))
    start = F.struct(F.lit("").alias("agent"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        told = F.regexp_extract(p, named, 1)
        has = (told != "") & ~told.isin("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after")
        agent = F.when(has, told).otherwise(acc["agent"])
        word = F.when(has, F.regexp_extract(p, named, 2)).otherwise(p)
        kept = F.when(agent.isin("", "*", "googlebot"), F.concat(acc["kept"], F.array(word))).otherwise(acc["kept"])
        return F.struct(agent.alias("agent"), kept.alias("kept"))

    own = F.array_join(F.aggregate(parts, start, step)["kept"], ",")
    head_no, head_follow = directives(own)
    return F.struct((meta_no | head_no).alias("noindex"), (meta_follow | head_follow).alias("nofollow"), F.when(meta_no, "meta").when(head_no, "header").alias("source"))


def canonical_state(url: Column, canonicals: Column) -> Column:
    """missing, multiple, invalid, self, protocol_mismatch, host_variant, other_page or cross_domain."""
    target = F.try_element_at(canonicals, F.lit(1))
    a, b = normalize_url(url), normalize_url(target)
    bare = lambda x: F.regexp_replace(x, "^https?://", "")
    wide = lambda x: F.regexp_replace(bare(x), r"^www\.", "")
    return (
        F.when(F.size(canonicals) == 0, "missing")
        .when(F.size(F.array_distinct(F.transform(canonicals, normalize_url))) > 1, "multiple")
        .when(~target.rlike("(?i)^https?://[^/ ]+"), "invalid")
        .when(a == b, "self")
        .when(bare(a) == bare(b), "protocol_mismatch")
        .when(wide(a) == wide(b), "host_variant")
        .when(host_of(url) == host_of(target), "other_page")
        .otherwise("cross_domain")
    )


def redirect_kind(source: Column, target: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "^https?://", "")
    no_slash = lambda x: F.regexp_replace(x, "/+$", "")
    www = lambda x: F.regexp_replace(bare(x), r"^www\.", "")
    return F.when((source != target) & (no_slash(source) == no_slash(target)), "slash").when(no_slash(bare(source)) == no_slash(bare(target)), "protocol").when(no_slash(www(source)) == no_slash(www(target)), "www").otherwise("other")


def structured_types(html: Column) -> Column:
    """Distinct types of JSON-LD, microdata and RDFa in page order."""
    json = F.regexp_extract_all(html, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))
    lists = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r'"@type"\s*:\s*\[([^\]]*)\]'), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1))))
    micro = F.regexp_extract_all(html, F.lit(r'itemtype="https?://schema\.org/([^"]+)"'), F.lit(1))
    rdfa = F.regexp_extract_all(html, F.lit(r'typeof="(?:schema:)?([A-Za-z]+)"'), F.lit(1))
    return F.array_distinct(F.concat(json, lists, micro, rdfa))


def vital_rating(name: str, value: Column) -> Column:
    good, poor = VITALS[name]
    return F.when(value.isNull(), None).when(value <= good, "good").when(value <= poor, "needs improvement").otherwise("poor")
