"""Landed provider payloads to tables: search results, related searches, sitemaps, feeds, posts, vitals, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import host_of

_RESULT = "array<struct<position:int,title:string,link:string>>"


def parse_serp_responses(payloads: DataFrame, most: int = 10) -> DataFrame:
    """Provider JSON (check_id, body) to ranked organic results: ``check_id, rank, title, url``.

    Results without an http(s) link are dropped; a missing position is the running number; the first ``most`` stay.
    """
    parsed = payloads.select("check_id", F.from_json("body", f"struct<organic_results:{_RESULT}>")["organic_results"].alias("results"))
    rows = parsed.select("check_id", F.posexplode("results").alias("pos", "r")).where(F.col("r.link").rlike("(?i)^https?://"))
    order = Window.partitionBy("check_id").orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    clip = lambda c, n: F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), 1, n)
    return rows.select("check_id", F.coalesce("r.position", "n").cast("long").alias("rank"), clip("r.title", 200).alias("title"), clip("r.link", 500).alias("url"))


def parse_serp_related(payloads: DataFrame) -> DataFrame:
    """Related searches (12) and questions (8) of each check, distinct in order: ``check_id, kind, place, text``."""
    shape = "struct<related_searches:array<struct<query:string>>,related_questions:array<struct<question:string>>>"
    parsed = payloads.select("check_id", F.from_json("body", shape).alias("j"))

    def of(kind: str, path: str, field: str, most: int) -> DataFrame:
        clean = F.transform(F.coalesce(F.col(path), F.array()), lambda x: F.substring(F.trim(F.regexp_replace(x[field], r"\s+", " ")), 1, 160))
        kept = F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 3)), 1, most)
        return parsed.select("check_id", F.lit(kind).alias("kind"), F.posexplode(kept).alias("place", "text"))

    return of("search", "j.related_searches", "query", 12).unionByName(of("question", "j.related_questions", "question", 8))


def _tags(name: str, body: str = "body"):
    return F.regexp_extract_all(F.col(body), F.lit(rf"(?is)<(?:[a-z]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[a-z]+:)?{name}>"), F.lit(1))


def _text(x):
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "(?s)<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: Landed page fetches and search rows (the shapes that readers expect).
RAW_PAGES = "site_id string, crawl_id string, page_id long, url string, html string, status int, headers map<string,string>, redirects array<struct<status:int,from:string,to:string>>, load_ms int, fetched_at timestamp, page_ord int"
SEARCH_ROWS = "site_id string, date date, query string, page string, device string, country string, clicks long, impressions long, position double"


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page fetches, with the shape fixed so that filters and columns reach the scan."""
    return spark.read.schema(RAW_PAGES).parquet(path)


def read_search_log(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Landed search rows, written by date (``parquet``), or as provider lines (``json``)."""
    return spark.read.schema(SEARCH_ROWS).format(kind).load(path)


_XML = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}


def _sitemap(body: str = "body") -> Column:
    """A sitemap or index file as XML, whatever its namespaces, sections and references: ``urls``, ``sitemaps`` and ``broken``.

    A file that is no whole XML, as one that was cut off, is ``broken``; its locations are then taken by their tags, so none that is there is lost.
    """
    entry = "array<struct<loc:string>>"
    x = F.from_xml(F.trim(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"^\x{feff}", "")), f"url {entry}, sitemap {entry}, loc array<string>, broken string", _XML)
    plain = lambda locs: F.filter(F.transform(F.coalesce(locs, F.array().cast(entry)), lambda e: F.trim(F.regexp_replace(e["loc"], r"\s+", " "))), lambda u: u.rlike("(?i)^https?://"))
    tagged = F.filter(F.transform(_tags("loc", body), _text), lambda u: u.rlike("(?i)^https?://"))
    none = F.array().cast("array<string>")
    is_index = F.coalesce(F.col(body).rlike("(?i)<([a-z]+:)?sitemapindex"), F.lit(False))
    bare = lambda v: F.transform(v["loc"], lambda u: F.struct(u.alias("loc")))  # noqa: E731  locations without an element of their own
    read = lambda v: F.struct(F.when(v["broken"].isNull(), F.concat(plain(v["url"]), F.when(is_index, none).otherwise(plain(bare(v))))).otherwise(F.when(is_index, none).otherwise(tagged)).alias("urls"), F.when(v["broken"].isNull(), F.concat(plain(v["sitemap"]), F.when(is_index, plain(bare(v))).otherwise(none))).otherwise(F.when(is_index, tagged).otherwise(none)).alias("sitemaps"), v["broken"].isNotNull().alias("broken"))
    return F.element_at(F.transform(F.array(x), read), 1)


def _is_sitemap(body: str = "body") -> Column:
    return F.coalesce(F.col(body).rlike("(?i)<([a-z]+:)?(urlset|sitemapindex)"), F.lit(False))


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """Sitemap or index files (site, body, and url and host if known): ``site, loc, is_index, valid, incomplete`` with one null loc for files without any.

    An index names only sub-sitemaps of its own host; ``incomplete`` marks one that names others too, and a file that is no whole XML.  Locations that are no http(s) URLs are dropped.
    """
    host = F.col("host") if "host" in files.columns else F.lit(None).cast("string")
    rows = files.select("site", host.alias("host"), F.coalesce(F.col("body").rlike("(?i)<([a-z]+:)?sitemapindex"), F.lit(False)).alias("is_index"), _is_sitemap().alias("valid"), _sitemap().alias("x"))
    own = lambda u: F.col("host").isNull() | (host_of(u) == F.regexp_replace(F.lower("host"), r"^www[.]", ""))
    rows = rows.withColumn("kept", F.when(F.col("is_index"), F.filter("x.sitemaps", own)).otherwise(F.col("x.urls")))
    incomplete = F.col("valid") & (F.col("x.broken") | (F.col("is_index") & (F.size("kept") < F.size("x.sitemaps"))))
    return rows.select("site", F.explode_outer("kept").alias("loc"), "is_index", "valid", incomplete.alias("incomplete"))


def sitemap_urls(files: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a site's sitemaps list, indexes followed to the files that they name: ``site, loc, sitemap`` and ``site, sitemap, state``.

    ``files``: site, url, body, as fetched; ``roots``: site, url, where a site's sitemaps begin.  A file is read once however often it is named; states are
    read, broken, not a sitemap and missing.  A round for each level of indexes.
    """
    from plumbline.operators.links import _cut

    parsed = _cut(files.select("site", F.col("url").alias("sitemap"), F.when(~_is_sitemap(), "not a sitemap").when(_sitemap()["broken"], "broken").otherwise("read").alias("state"), _sitemap().alias("x")).dropDuplicates(["site", "sitemap"]))
    names = parsed.select("site", "sitemap", F.explode("x.sitemaps").alias("child")).where(host_of("child") == F.regexp_replace(F.lower("site"), r"^www[.]", ""))
    seen = new = _cut(roots.select("site", F.col("url").alias("sitemap")).distinct())
    while not new.isEmpty():
        found = names.join(new.hint("merge"), ["site", "sitemap"]).select("site", F.col("child").alias("sitemap")).distinct()
        new = _cut(found.join(seen.hint("merge"), ["site", "sitemap"], "left_anti"))
        seen = seen.unionByName(new)
    states = seen.join(parsed.select("site", "sitemap", "state").hint("merge"), ["site", "sitemap"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    listed = parsed.join(seen.hint("merge"), ["site", "sitemap"], "left_semi").select("site", "sitemap", F.explode("x.urls").alias("loc"))
    return listed.groupBy("site", "loc").agg(F.min("sitemap").alias("sitemap")), states


def sitemap_facts(files: DataFrame) -> DataFrame:
    """What is known of each site's sitemaps: ``site, urls, mismatch_count, mismatch_host, complete, missing_confirmed, parse_error``.

    ``files``: site, host, status, body, truncated (whether its fetch was cut).  A sitemap is complete if every file was read whole and parsed.
    """
    answered = F.col("status") == 200
    valid = answered & _is_sitemap()
    locs = F.when(valid, _sitemap()["urls"]).otherwise(F.array().cast("array<string>"))
    per = files.groupBy("site").agg(
        F.bool_and(F.col("status").isin(404, 410)).alias("missing_confirmed"), F.bool_or(answered & ~valid).alias("parse_error"), F.bool_and(valid & ~F.coalesce("truncated", F.lit(False))).alias("complete")
    )
    found = files.select("site", "host", F.explode(F.array_distinct(locs)).alias("url")).distinct().withColumn("own", host_of("url") == F.regexp_replace(F.lower("host"), r"^www[.]", ""))
    counts = found.groupBy("site").agg(F.count_if("own").alias("urls"), F.count_if(~F.col("own")).alias("mismatch_count"), F.min(F.when(~F.col("own"), host_of("url"))).alias("mismatch_host"))
    rows = per.join(counts.hint("merge"), "site", "left")
    return rows.select("site", F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("mismatch_count", F.lit(0)).alias("mismatch_count"), "mismatch_host", "complete", "missing_confirmed", "parse_error")


def parse_feeds(files: DataFrame) -> DataFrame:
    """RSS and Atom files (site, body): ``site, title, url, date``; a title and an http(s) url are required.

    Read as XML; of a file that is no whole XML the items that are whole are taken by their tags.
    """
    item = "array<struct<title:string,link:string,pubDate:string,date:string>>"
    entry = "array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string>>"
    x = F.from_xml(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\x{feff}", "")), f"channel struct<item:{item}>, item {item}, entry {entry}, broken string", _XML)
    rows = files.select("site", "body", x.alias("x"))
    some = lambda a, kind: F.coalesce(a, F.array().cast(kind))
    rss = F.transform(F.concat(some(F.col("x.channel.item"), item), some(F.col("x.item"), item)), lambda i: F.struct(_text(i["title"]).alias("title"), F.trim(i["link"]).alias("url"), F.trim(F.coalesce(i["pubDate"], i["date"])).alias("date")))
    best = lambda links: F.coalesce(F.try_element_at(F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(1)), F.try_element_at(links, F.lit(1)))["_href"]
    atom = F.transform(some(F.col("x.entry"), entry), lambda e: F.struct(_text(e["title"]).alias("title"), best(e["link"]).alias("url"), F.trim(F.coalesce(e["published"], e["updated"])).alias("date")))
    whole = rows.where("x.broken is null").select("site", F.explode(F.concat(rss, atom)).alias("i")).select("site", "i.*")
    cut = rows.where("x.broken is not null").select("site", F.explode(F.concat(_tags("item"), _tags("entry"))).alias("body"))
    first = lambda name: F.coalesce(_text(F.try_element_at(_tags(name), F.lit(1))), F.lit(""))
    href = F.regexp_extract("body", r'(?is)<link[^>]*href="([^"]+)"', 1)
    date = F.coalesce(*[F.nullif(first(n), F.lit("")) for n in ("pubDate", "published", "updated")])
    tagged = cut.select("site", first("title").alias("title"), F.when(first("link") != "", first("link")).otherwise(href).alias("url"), date.alias("date"))
    return whole.unionByName(tagged).where("title <> '' and url rlike '^https?://'")


def parse_cms_posts(payloads: DataFrame) -> DataFrame:
    """Post API arrays (site, body): ``site, title, url, date``."""
    posts = F.from_json("body", "array<struct<link:string,date:string,title:struct<rendered:string>>>")
    rows = payloads.select("site", F.explode(posts).alias("p"))
    return rows.select("site", _text(F.col("p.title.rendered")).alias("title"), F.col("p.link").alias("url"), F.substring("p.date", 1, 10).alias("date")).where("title <> '' and url rlike '^https?://'")


def parse_vitals(payloads: DataFrame) -> DataFrame:
    """Page-speed JSON (url, strategy, body): field and lab values, ratings and up to five savings of 300 ms or more."""
    metric = "struct<percentile:double>"
    shape = (
        f"struct<loadingExperience:struct<metrics:struct<LARGEST_CONTENTFUL_PAINT_MS:{metric},INTERACTION_TO_NEXT_PAINT:{metric},CUMULATIVE_LAYOUT_SHIFT_SCORE:{metric}>>,"
        "lighthouseResult:struct<categories:struct<performance:struct<score:double>>,audits:map<string,struct<title:string,numericValue:double,details:struct<overallSavingsMs:double>>>>>"
    )
    j = payloads.select("url", "strategy", F.from_json("body", shape).alias("j"))
    field = lambda n: F.col(f"j.loadingExperience.metrics.{n}.percentile")
    audits = F.col("j.lighthouseResult.audits")
    lab = lambda n: F.try_element_at(audits, F.lit(n))["numericValue"]
    saved = F.transform(F.map_values(audits), lambda a: F.struct((-F.coalesce(a["details"]["overallSavingsMs"], F.lit(0.0))).alias("less"), a["title"].alias("title")))
    savings = F.slice(F.array_sort(F.filter(saved, lambda s: s["less"] <= -300)), 1, 5)
    return j.select(
        "url", "strategy", F.floor(F.col("j.lighthouseResult.categories.performance.score") * 100 + 0.5).cast("int").alias("score"),
        field("LARGEST_CONTENTFUL_PAINT_MS").alias("field_lcp"), field("INTERACTION_TO_NEXT_PAINT").alias("field_inp"), (field("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100).alias("field_cls"),
        lab("largest-contentful-paint").alias("lab_lcp"), lab("cumulative-layout-shift").alias("lab_cls"), F.transform(savings, lambda s: s["title"]).alias("savings"),
    )


def pack_top(results: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """The first ten results of each check, with its related searches and questions, as one JSON payload: ``check_id, top_results``."""
    top = results.where("rank <= 10").groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url"))).alias("results"))
    if related is None:
        return top.select("check_id", F.to_json(F.struct("results")).alias("top_results"))
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "text")))), lambda x: x["text"])
    more = related.groupBy("check_id").agg(texts("search").alias("searches"), texts("question").alias("questions"))
    rows = top.join(more.hint("merge"), "check_id", "left")
    return rows.select("check_id", F.to_json(F.struct("results", F.struct("searches", "questions").alias("related"))).alias("top_results"))


def unpack_related(snapshots: DataFrame) -> DataFrame:
    """Related searches and questions of payloads that have them: ``check_id, kind, place, text``."""
    inside = F.from_json("top_results", "struct<related:struct<searches:array<string>,questions:array<string>>>")["related"]
    rows = snapshots.where(~F.ltrim("top_results").startswith("[")).select("check_id", inside.alias("r"))
    of = lambda field, kind: rows.select("check_id", F.lit(kind).alias("kind"), F.posexplode(f"r.{field}").alias("place", "text"))
    return of("searches", "search").unionByName(of("questions", "question"))


def unpack_top(snapshots: DataFrame) -> DataFrame:
    """Results of either payload shape, the plain array or the object: ``check_id, rank, title, url``."""
    shape = "array<struct<rank:int,title:string,url:string>>"
    plain = F.from_json("top_results", shape)
    inside = F.from_json("top_results", f"struct<results:{shape}>")["results"]
    rows = snapshots.select("check_id", F.explode(F.when(F.ltrim("top_results").startswith("["), plain).otherwise(inside)).alias("r"))
    return rows.select("check_id", F.col("r.rank").cast("long").alias("rank"), "r.title", "r.url").where("url is not null")


def write_query_csv(rows: DataFrame, path: str) -> None:
    """Queries as CSV: rate in percent to two places, position to one, quotes doubled."""
    shown = rows.select("query", "clicks", "impressions", F.format_string("%.2f%%", F.col("ctr") * 100).alias("ctr"), F.format_string("%.1f", "position").alias("position"), F.coalesce("top_page", F.lit("")).alias("top_page"))
    shown.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
