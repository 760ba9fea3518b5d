"""Content planning in bulk: draft and suggestion checks, topics, coverage, calendars and ideas.  Tables carry ``site_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import host_of, page_key
from plumbline.operators.greedy import alternated, free_places, kept_in_order, set_key
from plumbline.operators.pages import sentences
from plumbline.operators.similarity import title_words


def _words(x: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.col(x) if isinstance(x, str) else x), r"[^\p{L}\p{N}']+"), lambda w: w != "")


# Stock phrases, sizes of titles and descriptions.
STOCK_PHRASES = (
    r"(?i)in today'?s (fast[- ]paced|digital|modern) world", r"(?i)\bdelve\b", r"(?i)\bin the realm of\b", r"(?i)\bit'?s (important|worth) to note that\b", r"(?i)\bin conclusion\b", r"(?i)\bunlock the (power|potential)\b",
    r"(?i)\bgame[- ]chang", r"(?i)\bnavigate the (complex|ever-changing)", r"(?i)\bevolving landscape\b", r"(?i)\bat the end of the day\b",
)
LIMITS = {"title": (20, 60), "description": (70, 160)}


def draft_checks(drafts: DataFrame) -> DataFrame:
    """Thirteen checks of each draft: ``site_id, id, check, status`` (pass, warn, fail).

    ``drafts``: site_id, id, markdown, title, description, keyword, intent, word_target, first_hand, sources (array of n, url), internal_urls.
    """
    md = F.coalesce("markdown", F.lit(""))
    bare = F.regexp_replace(md, r"(?s)```.*?```", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"[#*_>`|-]", " ")
    rows = drafts.withColumns({"body": F.regexp_replace(bare, r"\[\d+\]", " ")})
    rows = rows.withColumns({
        "all": _words("body"), "need": F.array_distinct(F.filter(_words("keyword"), lambda w: F.length(w) > 2)), "phrase": F.array_join(_words("keyword"), " "),
        "levels": F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^(#{1,6})\s+.+$"), F.lit(1)), F.length),
        "cited": F.array_distinct(F.regexp_extract_all(md, F.lit(r"\[(\d{1,2})\]"), F.lit(1)).cast("array<int>")),
        "links": F.regexp_extract_all(md, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1)), "open_spots": F.size(F.regexp_extract_all(md, F.lit(r"\[ADD:[^\]]*\]"), F.lit(0))),
        "given": F.transform("sources", lambda s: s["n"]), "given_urls": F.transform("sources", lambda s: s["url"]),
        "spoken": F.size(F.filter(sentences(F.regexp_replace(F.col("body"), r"\s+", " ")), lambda s: F.size(_words(s)) > 2)),
    })
    holds = lambda words: F.size(F.array_except("need", words)) == 0
    status = lambda good, fair: F.when(good, "pass").when(fair, "warn").otherwise("fail")
    total = F.size("all")
    tl, ml = F.length("title"), F.length("description")
    h1, h2 = F.size(F.filter("levels", lambda x: x == 1)), F.size(F.filter("levels", lambda x: x == 2))
    steps = F.zip_with(F.slice("levels", F.lit(1), F.greatest(F.size("levels") - 1, F.lit(0))), F.slice("levels", F.lit(2), F.greatest(F.size("levels") - 1, F.lit(0))), lambda a, b: b > a + 1)
    skipped = F.exists(steps, lambda x: x)
    joined = F.array_join("all", " ")
    times = F.when(F.col("phrase") != "", (F.length(joined) - F.length(F.replace(joined, F.col("phrase"), F.lit("")))) / F.length("phrase")).otherwise(0)
    density = F.when(total > 0, times * F.greatest(F.lit(1), F.size(_words("keyword"))) / total * 100).otherwise(0)
    dangling = F.size(F.array_except("cited", "given"))
    invented = F.size(F.array_except(F.array_except("links", "internal_urls"), "given_urls"))
    internal = F.size(F.filter("links", lambda u: F.array_contains("internal_urls", u)))
    average = F.when(F.col("spoken") > 0, total / F.col("spoken")).otherwise(0)
    stock = sum((F.when(md.rlike(p), 1).otherwise(0) for p in STOCK_PHRASES), F.lit(0))
    faq = md.rlike(r"(?im)^##\s+(frequently asked|faq)")
    checks = {
        "title": status(tl.between(30, 60) & holds(_words("title")), tl.between(20, 70)),
        "meta": status(ml.between(120, 160) & holds(_words("description")), ml.between(90, 175)),
        "headings": status((h1 == 1) & (h2 >= 3) & ~skipped, (h1 == 1) & (h2 >= 2)),
        "kw_early": F.when(holds(F.slice("all", 1, 100)), "pass").otherwise("warn"),
        "stuffing": status(density <= 2.5, density <= 3.5),
        "length": status(total >= F.col("word_target") * 0.85, total >= F.col("word_target") * 0.6),
        "citations": F.when(dangling > 0, "fail").when(F.size("cited") >= 2, "pass").when(F.size("cited") == 1, "warn").when(F.size("sources") > 0, "fail").otherwise("warn"),
        "links": F.when(invented > 0, "fail").when(internal >= 2, "pass").otherwise("warn"),
        "placeholders": F.when(F.col("open_spots") == 0, "pass").otherwise("warn"), "experience": F.when(F.col("first_hand"), "pass").otherwise("warn"),
        "readability": status(average <= 24, average <= 30), "filler": F.when(stock == 0, "pass").otherwise("warn"),
        "faq": F.when(~F.coalesce(F.col("intent").rlike("Informational|Commercial"), F.lit(False)) | faq, "pass").otherwise("warn"),
    }
    return rows.select("site_id", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()])).alias("c")).select("site_id", "id", "c.check", "c.status")


SUGGESTION_STOPWORDS = (
    "about above after again also been before being between both could does doing down during each further from having have here into itself just more most much must only other over same should some such than that their them then "
    "there these they this those through under until very were what when where which while will with would your yours onto upon the and for are but not you all can had her was one our out has his how its may new now see way who why best top get got use used using"
).split(" ")


def suggestion_checks(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """What is wrong with drafted titles and descriptions: ``site_id, url, kind, warnings`` (comma-joined codes).

    ``drafts``: site_id, url, kind (title or description), text; ``pages``: site_id, url, title, description, body.  A duplicate is the same wording
    on another page; the pages' own wordings are counted, not compared one by one.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), r"[^\p{L}\p{N}]+", " "))
    long_words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))
    kinds = pages.select("site_id", "url", "body", F.explode(F.array(F.struct(F.lit("title").alias("kind"), F.col("title").alias("current")), F.struct(F.lit("description").alias("kind"), F.col("description").alias("current")))).alias("k")).select("site_id", "url", "body", "k.*")
    used = kinds.select("site_id", "kind", "url", plain(F.col("current")).alias("same")).where("same <> ''").groupBy("site_id", "kind", "same").agg(F.count_distinct("url").alias("_n"), F.min("url").alias("_one"))
    rows = drafts.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("same", plain(F.col("text")))
    rows = rows.join(kinds.hint("merge"), ["site_id", "url", "kind"], "left").join(used.hint("merge"), ["site_id", "kind", "same"], "left")
    size = F.length("text")
    low = F.when(F.col("kind") == "description", LIMITS["description"][0]).otherwise(LIMITS["title"][0])
    high = F.when(F.col("kind") == "description", LIMITS["description"][1]).otherwise(LIMITS["title"][1])
    allowed = long_words(F.concat_ws(" ", "body", host_of("url"), "current"))
    content = F.filter(long_words(F.col("text")), lambda w: ~w.isin(SUGGESTION_STOPWORDS))
    near = lambda a, w: (F.length(a) >= 5) & (F.startswith(a, w) | F.startswith(w, a)) & (F.abs(F.length(a) - F.length(w)) <= 3)
    unknown = F.filter(content, lambda w: ~F.array_contains(allowed, w) & ~F.exists(allowed, lambda a: near(a, w)))
    warn = F.concat_ws(
        ",", F.when(size > high, "TOO_LONG").when(size < low, "TOO_SHORT"), F.when((size >= 12) & (F.col("text") == F.upper("text")) & F.col("text").rlike("[A-Z]"), "ALL_CAPS"),
        F.when(plain(F.col("current")) == F.col("same"), "UNCHANGED"), F.when((F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_one") != F.col("url"))), "DUPLICATE"),
        F.when((F.size(content) >= 3) & (F.size(unknown) > F.size(content) * 0.4), "UNGROUNDED"),
    )
    return rows.select("site_id", "url", "kind", F.when(size == 0, "EMPTY").otherwise(warn).alias("warnings"))


# Titles that say nothing of their own.
GENERIC_TITLES = (
    r"(?i)\bultimate guide\b|\beverything you (need|should|must) (to )?know\b|\bcomplete guide to\b|\bgame[- ]chang|\bsecrets?\b|\bunlock(ing)?\b|\bsupercharge|\bskyrocket|\bmust[- ]know\b|\bhacks?\b"
    r"|\b(top|best) \d+ (tips|ways|reasons|tricks)\b|^\d+ (tips|ways|reasons|tricks)\b"
)
GROUNDING_WEIGHT = {"Q": 5, "K": 4, "S": 4, "A": 3, "C": 3, "R": 3, "T": 3, "E": 3, "P": 2, "SITE": 1}


def grounded_topics(topics: DataFrame, items: DataFrame) -> DataFrame:
    """Topics (site_id, id, grounding_id) that cite an item (site_id, id) of their site, or the site itself."""
    keys = items.select("site_id", F.col("id").alias("grounding_id")).distinct()
    cited = topics.where("grounding_id <> 'SITE'").join(keys.hint("merge"), ["site_id", "grounding_id"], "left_semi")
    return cited.unionByName(topics.where("grounding_id = 'SITE'").select(*cited.columns))


def topic_quality(topics: DataFrame) -> DataFrame:
    """Why topics are not good enough: ``site_id, id, reasons`` (comma-joined, empty if they are).

    ``topics``: site_id, id, title, primary_keyword, intent, funnel, format, angle, pillar.
    """
    plain = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    kw = title_words("primary_keyword")
    shared = F.size(F.array_intersect(kw, title_words("title")))
    n = F.size(plain(F.col("primary_keyword")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reasons = F.concat_ws(
        ",", F.when(~F.length("title").between(25, 100), "title length"), F.when(F.size(plain(F.col("title"))) < 4, "title too short"), F.when(F.col("title").rlike(GENERIC_TITLES), "generic title"),
        F.when(~n.between(2, 7), "keyword length").when((F.size(kw) > 0) & (shared < F.ceil(F.size(kw) / 2)), "keyword not in title"), F.when(blank("intent") | blank("funnel") | blank("format"), "no intent, funnel or format"),
        F.when(F.length(F.coalesce("angle", F.lit(""))) < 40, "no angle"), F.when(blank("pillar"), "no cluster"),
    )
    return topics.select("site_id", "id", reasons.alias("reasons"))


def dedupe_topics(topics: DataFrame, existing: DataFrame, least: float = 0.6) -> DataFrame:
    """Topics of a site that are neither like an existing title nor like a kept earlier topic, nor have its keyword: ``site_id, id, kept``.

    ``topics``: site_id, id, ord, title, keyword; ``existing``: site_id, title.
    """
    rows = topics.select("site_id", "id", "ord", set_key(title_words("title")).alias("set"), F.col("keyword").alias("label"))
    return kept_in_order(rows, existing.select("site_id", set_key(title_words("title")).alias("set")), least)


def schedule(topics: DataFrame, start: str, taken: DataFrame, size: int = 30) -> DataFrame:
    """Each site's best topics on consecutive free days, no two of one pillar in a row where that can be helped: ``site_id, id, day, priority``.

    ``topics``: site_id, id, pillar, grounding_kind, has_links, format; ``taken``: site_id, day.  Only a plan's worth of topics is ordered as one array.
    """
    weight = F.coalesce(*[F.when(F.col("grounding_kind") == k, F.lit(float(w))) for k, w in GROUNDING_WEIGHT.items()], F.lit(1.0))
    score = weight + F.when(F.col("has_links"), 1.0).otherwise(0.0) + F.when(F.col("format").isin("Data-driven analysis", "Case study"), 0.5).otherwise(0.0)
    best = topics.withColumn("score", score).withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("score"), "id"))).where(F.col("n") <= size)
    plan = best.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "pillar", "score"))).alias("plan"))
    placed = plan.select("site_id", F.posexplode(alternated(F.col("plan"), "pillar")).alias("n", "t")).withColumn("n", F.col("n") + 1)
    busy = taken.select("site_id", (F.datediff(F.col("day").cast("date"), F.lit(start).cast("date")) + 1).alias("n"))
    days = free_places(placed.select("site_id", "n"), busy)
    priority = F.when(F.col("t.score") >= 5, "High").when(F.col("t.score") >= 3.5, "Medium").otherwise("Low")
    rows = placed.join(days.hint("merge"), ["site_id", "n"])
    return rows.select("site_id", "t.id", F.date_add(F.lit(start).cast("date"), F.col("place").cast("int") - 1).alias("day"), priority.alias("priority"))


# Words that tell no topics apart.
COVER_STOPWORDS = (
    "the and for with your you our how what why when who which does this that from are can best guide guides tips tip complete ultimate easy simple free new step steps ways way top need know about vs using use into make"
).split(" ")


def stemmed(x: Column | str) -> Column:
    """Distinct topic words: light plurals off, numbers kept, years dropped."""
    words = F.split(F.lower(F.col(x) if isinstance(x, str) else x), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: ((F.length(w) > 2) | w.rlike("^[0-9]+$")) & ~w.isin(COVER_STOPWORDS) & ~w.rlike("^(19|20)[0-9]{2}$"))
    one = lambda w: (
        F.when(w.rlike("(sses|xes|ches|shes)$"), F.regexp_replace(w, "es$", "")).when(w.rlike("^.{2,}ies$") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y")).when(w.rlike("s$") & ~w.rlike("(ss|us|is)$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
    )
    return F.array_distinct(F.transform(kept, one))


def coverage_index(pasted: DataFrame, posts: DataFrame, pages: DataFrame, planned: DataFrame) -> DataFrame:
    """Everything a site has or plans, the first source of each page or title: ``site_id, title, url, source, words``; home pages left out.

    ``pasted``: site_id, title; ``posts``: site_id, title, url; ``pages``: site_id, title, h1, url; ``planned``: site_id, title, keyword.
    """
    none = F.lit(None).cast("string")
    parts = [
        pasted.select("site_id", "title", none.alias("url"), F.lit("").alias("more"), F.lit(0).alias("rank"), F.lit("pasted").alias("source")),
        posts.select("site_id", "title", "url", F.lit("").alias("more"), F.lit(1).alias("rank"), F.lit("feed").alias("source")),
        pages.select("site_id", "title", "url", F.col("h1").alias("more"), F.lit(2).alias("rank"), F.lit("crawl").alias("source")),
        planned.select("site_id", "title", none.alias("url"), F.coalesce("keyword", F.lit("")).alias("more"), F.lit(3).alias("rank"), F.lit("planner").alias("source")),
    ]
    rows = reduce(DataFrame.unionByName, parts).where(F.trim(F.coalesce("title", F.lit(""))) != "")
    rows = rows.withColumn("key", F.coalesce(page_key("url"), F.concat(F.lit("t:"), F.lower("title")))).where("url is null or not key rlike '^[^/]+/$'")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "key").orderBy("rank", "title"))).where("n = 1")
    slug = F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)), F.lit("")), "[-_/]+", " ")
    return one.select("site_id", "title", "url", "source", stemmed(F.concat_ws(" ", "title", "more", slug)).alias("words"))


def existing_titles(index: DataFrame, most: int = 300) -> DataFrame:
    """Distinct titles of a site, the most telling first: ``site_id, place, title``.  ``index``: site_id, title, source, url."""
    blog = F.coalesce(F.col("url").rlike(r"(?i)/(blog|blogs|post|posts|news|article|articles|insights?|guides?|resources?|learn|stories|journal|tips)/"), F.lit(False))
    rank = F.when(F.col("source") == "pasted", 0).when(F.col("source") == "planner", 1).when((F.col("source") == "feed") | blog, 2).otherwise(4)
    one = index.groupBy("site_id", F.lower("title").alias("key")).agg(F.min_by("title", F.struct(rank, "title")).alias("title"), F.min(rank).alias("rank"))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("rank", "key"))
    return one.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("site_id", "place", "title")


# Paths that are no content, and sitemaps that more likely hold articles.
NOT_CONTENT = r"(?i)^/(tag|tags|category|categories|author|authors|page|wp-content|wp-json|wp-admin|feed|cart|checkout|my-account|search|login|register|cdn-cgi)(/|$)"
FILES = r"(?i)\.(jpe?g|png|gif|webp|svg|ico|pdf|css|js|json|xml|txt|zip|mp4|mp3|woff2?|docx?|xlsx?)$"


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"(?i)^[a-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")


def content_url(url: Column | str, origin: Column | None = None) -> Column:
    """Whether a URL looks like an article or page: not the home page, a tag, author or paging page, or a file; of the given host if there is one."""
    u = F.col(url) if isinstance(url, str) else url
    path = _path(u)
    good = u.rlike("(?i)^https?://") & (path != "") & ~path.rlike(FILES) & ~path.rlike(NOT_CONTENT) & ~path.rlike(r"(?i)/page/[0-9]+$")
    return good if origin is None else good & (host_of(u) == origin)


def title_from_slug(url: Column | str) -> Column:
    """A readable title from the last part of the path; empty if it is too short or a number."""
    u = F.col(url) if isinstance(url, str) else url
    part = F.regexp_extract(_path(u), "([^/]+)$", 1)
    said = F.regexp_replace(F.coalesce(F.try_url_decode(part), part), r"(?i)\.(html?|php|aspx?)$", "")
    said = F.trim(F.regexp_replace(F.regexp_replace(said, "[-_+]+", " "), r"\s+", " "))
    return F.when((F.length(said) < 4) | said.rlike("^[0-9]+$"), "").otherwise(F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 10_000)))


def sitemap_priority(url: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.when(u.rlike("(?i)post|blog|news|article|insight|guide|learn|resource|stories|journal"), 0).when(u.rlike("(?i)page|product|category|tag|author|image|video"), 2).otherwise(1)


OWN_SOURCES = ("Added by you", "Search Console query", "Content refresh")


def idea_stage(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "Published", "published").when(s.isin("Drafting", "Ready"), "draft").otherwise("idea")


def is_marked(status: str = "status", draft: str = "has_draft", source: str = "source") -> Column:
    """The owner has touched it: past an idea, with a draft, or added by hand."""
    return (idea_stage(status) != "idea") | F.coalesce(F.col(draft), F.lit(False)) | F.coalesce(F.col(source).isin(*OWN_SOURCES), F.lit(False))


def split_regenerate(ideas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ideas to keep and ideas to replace."""
    return ideas.where(is_marked()), ideas.where(~is_marked())


def remember_rejected(known: DataFrame, new: DataFrame, most: int = 80) -> DataFrame:
    """Rejected titles (site_id, at, title) of each site, newest first, without repeats, up to ``most``: ``site_id, place, title``."""
    rows = known.unionByName(new).withColumn("title", F.substring(F.trim(F.regexp_replace("title", r"\s+", " ")), 1, 160)).where("title <> ''")
    one = rows.groupBy("site_id", F.lower("title").alias("key")).agg(F.max_by("title", F.struct("at", "title")).alias("title"), F.max("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("at"), "key"))
    return one.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("site_id", "place", "title")


def due_topics(topics: DataFrame, today, lead_days: int = 7) -> DataFrame:
    """Ideas without a date, or within ``lead_days`` of it."""
    return topics.where((F.col("status") == "Idea") & (F.col("scheduled_for").isNull() | (F.date_diff(F.col("scheduled_for").cast("date"), F.lit(today).cast("date")) <= lead_days)))


#: Most items of each kind that a calendar is built from (fixed values).
CALENDAR_LIMITS = {"Q": 25, "K": 12, "A": 15, "E": 10, "S": 10, "C": 18, "R": 14, "T": 12, "P": 15}


def calendar_items(sources: dict[str, DataFrame]) -> DataFrame:
    """Items that a calendar may cite, numbered by kind: ``site_id, id, text, note``.

    ``sources``: kind to rows of site_id, weight, text, note; the weightiest of each kind and site come first, wordings once.
    """
    parts = []
    for kind, rows in sources.items():
        clipped = rows.select("site_id", "weight", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 240).alias("text"), F.substring(F.coalesce("note", F.lit("")), 1, 200).alias("note")).where("text <> ''")
        one = clipped.groupBy("site_id", F.lower("text").alias("key")).agg(F.max("weight").alias("weight"), F.min("text").alias("text"), F.min("note").alias("note"))
        n = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("weight"), "key"))
        parts.append(one.withColumn("n", n).where(F.col("n") <= CALENDAR_LIMITS[kind]).select("site_id", F.concat(F.lit(kind), F.col("n").cast("string")).alias("id"), "text", "note"))
    return reduce(DataFrame.unionByName, parts)


def to_topics(queries: DataFrame | None = None, refresh: DataFrame | None = None, areas: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """Rows of several tools in the shape of topics: ``site_id, title, primary_keyword, source, target_url``.

    queries: site_id, query, top_page; refresh: site_id, page_key, query; areas: site_id, offer, area; covered: site_id, topic, url.
    """
    said = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    parts = []
    if queries is not None:
        parts.append(queries.select("site_id", said("query").alias("title"), F.col("query").alias("primary_keyword"), F.lit("Search Console query").alias("source"), F.col("top_page").alias("target_url")))
    if refresh is not None:
        parts.append(refresh.select("site_id", F.concat(F.lit("Refresh: "), "page_key").alias("title"), F.coalesce("query", F.lit("")).alias("primary_keyword"), F.lit("Content refresh").alias("source"), F.col("page_key").alias("target_url")))
    if areas is not None:
        parts.append(areas.select("site_id", F.concat_ws(" in ", "offer", "area").alias("title"), F.lower(F.concat_ws(" ", "offer", "area")).alias("primary_keyword"), F.lit("Added by you").alias("source"), F.lit("").alias("target_url")))
    if covered is not None:
        parts.append(covered.select("site_id", F.concat(F.lit("Update: "), "topic").alias("title"), F.lower("topic").alias("primary_keyword"), F.lit("Content refresh").alias("source"), F.col("url").alias("target_url")))
    return reduce(DataFrame.unionByName, parts)


# What a fix should produce, the first that fits.
FIX_KINDS = {
    "schema": r"(?i)schema|structured data|json-?ld|rich result|markup",
    "entity": r"(?i)geo\b|entity|about page|contact page|credential|testimonial|authority signal|e-e-a-t|trust",
    "aeo_answer": r"(?i)\baeo\b|\bfaq\b|answer|question|people also ask|featured snippet|ai visibility|simulator",
    "internal_link": r"(?i)internal link|anchor text|orphan|weakly linked|inbound link|link to this page",
    "outreach": r"(?i)backlink|outreach|link building|guest post|citation|mention",
    "competitor_response": r"(?i)competitor|content gap|they rank|outrank",
    "metadata": r"(?i)meta description|title tag|\btitle\b.*(long|short|missing|duplicate)|\bh1\b|heading|open graph|snippet",
    "technical": r"(?i)redirect|canonical|robots|sitemap|hreflang|noindex|status code|404|speed|core web|alt text|alt attribute|https|viewport|crawl|index",
    "content_update": r"(?i)keyword|content|cannibal|rewrite|\bthin\b|ranks? #|room to climb|top 10|impressions|search console|page two|position",
}


def fix_kind(*texts: Column | str) -> Column:
    """What a fix for a finding should produce; URLs in its texts do not count."""
    said = F.regexp_replace(F.concat_ws(" ", *texts), r"https?://\S+", " ")
    out = F.lit("general")
    for name, pattern in reversed(FIX_KINDS.items()):
        out = F.when(said.rlike(pattern), name).otherwise(out)
    return out


def pages_for(opportunities: DataFrame, pages: DataFrame, most: int = 2) -> DataFrame:
    """The pages that an opportunity names in its urls or texts, up to ``most``, else the site's home page: ``site_id, id, place, url``.

    ``opportunities``: site_id, id, urls, text; ``pages``: site_id, url, is_start.
    """
    found = F.transform(F.regexp_extract_all("text", F.lit(r"""https?://[^\s"'<>)\],]+"""), F.lit(0)), lambda u: F.regexp_replace(u, "[.;:]+$", ""))
    bare = lambda c: F.regexp_replace(c, "/$", "")
    named = opportunities.select("site_id", "id", F.posexplode(F.array_distinct(F.concat(F.coalesce("urls", F.array().cast("array<string>")), found)))).withColumn("key", bare(F.col("col")))
    hit = named.join(pages.select("site_id", "url", bare(F.col("url")).alias("key")).hint("merge"), ["site_id", "key"]).groupBy("site_id", "id", "url").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("site_id", "id").orderBy("pos", "url"))
    first = hit.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("site_id", "id", "place", "url")
    rest = opportunities.select("site_id", "id").join(first.select("site_id", "id").distinct().hint("merge"), ["site_id", "id"], "left_anti")
    home = pages.where("is_start").groupBy("site_id").agg(F.min("url").alias("url"))
    return first.unionByName(rest.join(home.hint("merge"), "site_id").select("site_id", "id", F.lit(1).cast("long").alias("place"), "url"))


def distinct_counts(rows: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """How many distinct values each column has in a site, exactly or by sketch."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return rows.groupBy("site_id").agg(*[count(c).alias(c) for c in columns])


#: Base-two logarithm of a sketch's buckets: a standard error of 1.04 / sqrt(2 ** 12), about 1.6 %.
SKETCH_BITS = 12


def daily_sketches(rows: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """A sketch of each column's values by site and day: ``site_id, day`` and a binary column each, of a fixed size; a table to keep, to which a day is added once."""
    return rows.groupBy("site_id", F.col(day).alias("day")).agg(*[F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(c) for c in columns])


def merged_counts(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """About how many distinct values each site has over all days of ``sketches``, without the rows: ``site_id`` and a number each."""
    return sketches.groupBy("site_id").agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
