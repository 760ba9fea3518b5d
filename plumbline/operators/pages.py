"""Page records from raw html, page rules and site summaries, by native expressions.  Every row carries its ``site_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.html import attribute, blocks, body_of, clean, decoded, has_attribute, inner, let, resolve, tags, visible
from plumbline.functions.text import host_of, rounded

# Anchor words that say nothing, penalties, rules with category and severity, flag weights and phrases.
VAGUE = ("click here", "here", "read more", "learn more", "more", "this", "this link", "link", "click", "read on", "details", "view more", "see more", "continue reading")
PENALTY = {"Critical": 22, "High": 14, "Medium": 8, "Low": 3}
RULES = {
    "missing_title": ("On-Page", "Critical"), "long_title": ("On-Page", "Low"), "missing_description": ("On-Page", "Medium"), "long_description": ("On-Page", "Low"),
    "missing_h1": ("On-Page", "High"), "many_h1": ("On-Page", "Low"), "missing_canonical": ("Technical", "Medium"), "noindex": ("Technical", "Low"), "missing_alt": ("On-Page", "Medium"),
    "thin": ("Content", "High"), "invalid_schema": ("Schema", "High"), "no_schema": ("Schema", "High"), "no_viewport": ("Technical", "High"), "zoom_block": ("Technical", "Low"),
    "insecure": ("Technical", "High"), "long_url": ("On-Page", "Low"), "heading_skip": ("On-Page", "Low"), "vague_anchors": ("On-Page", "Low"), "slow": ("Technical", "Medium"),
}
AEO_WEIGHTS = {"faq_schema": 18, "howto_schema": 6, "qa_schema": 6, "any_schema": 8, "list_markup": 10, "table_markup": 6, "multiple_headings": 12, "question_heading": 12, "direct_answer": 10, "existing_questions": 6, "content_depth": 6}
GEO_WEIGHTS = {"organization_schema": 16, "product_schema": 10, "article_schema": 6, "contact": 12, "about": 12, "location": 10, "audience": 10, "credential": 8, "social_proof": 10, "policy": 4, "clear_naming": 2}
QUESTION_HEADING = r"(?i)^(what|how|why|where|which|who|when|is|are|can|does|do)\b"
DIRECT_ANSWER = r"\b(is a|refers to|means|is defined as|is the process of)\b"
GEO_PHRASES = {
    "contact": "contact us|contact form|get in touch", "about": "about us|our story|who we are|our mission", "location": "located in|based in|headquartered|address|nairobi|kenya|our office",
    "audience": "for small businesses|for startups|for teams|for enterprises|designed for|built for", "credential": "certified|licensed|accredited|award|years of experience|trusted by",
    "social_proof": "testimonial|review|case study|client says|customers say|rated", "policy": "privacy policy|terms of service|refund policy|terms and conditions",
}
QUESTION_START = r"(?i)^(who|what|when|where|why|how|can|could|do|does|did|is|are|was|were|should|will|would|which|may|am)\b"
MOUNTS = ("root", "app", "__next", "__nuxt", "___gatsby", "svelte")


def _first(x: Column) -> Column:
    return F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))


def _meta(name: str) -> Column:
    """Content of the first meta tag of a name, from ``named`` (name and content of every one)."""
    return _first(F.transform(F.filter("named", lambda m: m["name"] == name), lambda m: m["content"]))


def is_question(text: Column, strict: bool = False) -> Column:
    """Ends with a question mark, or begins like a question and is as long as a sentence; ``strict`` asks for both."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    starts = t.rlike(QUESTION_START)
    marked = t.endswith("?")
    fits = F.length(t).between(12, 160)
    return fits & ((marked & starts) if strict else (marked | (starts & (F.size(F.split(t, " ")) >= 4) & ~t.rlike("[.!]$"))))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.?!])\s+", "$1\u0001"), "\u0001")


def existing_questions(text: Column, most: int = 20) -> Column:
    """Sentences that end with a question mark: cut at stops first, so the work grows with the text only."""
    return F.slice(F.filter(sentences(text), lambda s: s.endswith("?") & (F.length(F.trim(s)) > 8)), 1, most)


def _texts(level: int) -> Column:
    return F.transform(F.filter("headings", lambda h: h["level"] == level), lambda h: h["text"])


def records(pages: DataFrame) -> DataFrame:
    """One record a page: head, headings, body text, links, images, schema types.

    Input: page_id, url, html; ``site_id`` (else the host) and ``load_ms`` are taken over where they are there.
    """
    has = set(pages.columns)
    rows = pages.select(
        (F.col("site_id") if "site_id" in has else host_of("url")).alias("site_id"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        (F.col("load_ms") if "load_ms" in has else F.lit(None).cast("int")).alias("load_ms"),
    )
    rows = rows.withColumns({
        "metas": tags("html", "meta"), "head_links": tags("html", "link"), "imgs": tags("html", "img"), "body_text": visible(body_of("html")),
        "anchor_html": F.regexp_extract_all("html", F.lit(r"""(?is)<a(?=[\s>])(?:[^>"']|"[^"]*"|'[^']*')*>.*?</a\s*>"""), F.lit(0)),
        "heading_html": F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6])(?=[\s>])[^>]*>.*?</\1\s*>"), F.lit(0)),
        "ld": F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1)), _ld_text), lambda x: x != ""),
    })
    rows = rows.withColumn("named", F.transform("metas", lambda t: F.struct(F.lower(attribute(t, "name")).alias("name"), decoded(attribute(t, "content")).alias("content"))))
    level = lambda x: F.substring(x, 3, 1).cast("int")
    rel = lambda t: F.split(F.lower(attribute(t, "rel")), r"\s+")
    resources = F.concat(
        F.transform(tags("html", "img|script|iframe|source|video|audio"), lambda t: attribute(t, "src")),
        F.transform(F.filter("head_links", lambda t: F.lower(attribute(t, "rel")) == "stylesheet"), lambda t: attribute(t, "href")),
    )
    return rows.select(
        "site_id", "page_id", "url", "html", "load_ms", "body_text", "ld", F.substring("body_text", 1, 4000).alias("full_text"),
        clean(F.regexp_extract("html", r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>", 1)).alias("title"),
        _first(F.transform(tags("html", "html"), lambda t: attribute(t, "lang"))).alias("lang"),
        _meta("description").alias("description"), _meta("viewport").alias("viewport"), _meta("generator").alias("generator"),
        F.transform(F.filter("named", lambda m: m["name"].isin("robots", "googlebot")), lambda m: F.lower(m["content"])).alias("robots_meta"),
        F.transform(F.filter("head_links", lambda t: F.array_contains(rel(t), "canonical")), lambda t: F.replace(attribute(t, "href"), F.lit("&amp;"), F.lit("&"))).alias("canonicals"),
        F.slice(F.transform(F.filter("head_links", lambda t: (F.lower(attribute(t, "rel")) == "alternate") & has_attribute(t, "hreflang")), lambda t: F.struct(attribute(t, "hreflang").alias("lang"), attribute(t, "href").alias("href"))), 1, 30).alias("hreflangs"),
        F.transform("heading_html", lambda x: F.struct(level(x).alias("level"), inner(x).alias("text"))).alias("headings"),
        F.transform("anchor_html", lambda x: let(F.replace(attribute(x, "href"), F.lit("&amp;"), F.lit("&")), lambda href: F.struct(href.alias("href"), resolve("url", href).alias("target"), inner(x).alias("text")))).alias("anchors"),
        F.size("imgs").cast("long").alias("images"),
        F.size(F.filter("imgs", lambda t: attribute(t, "alt") == "")).cast("long").alias("images_missing_alt"),
        F.slice(F.array_distinct(F.transform(F.filter("imgs", lambda t: ~has_attribute(t, "alt") & (attribute(t, "src") != "")), lambda t: attribute(t, "src"))), 1, 20).alias("missing_alt_srcs"),
        F.transform(F.filter(F.transform("imgs", lambda t: attribute(t, "alt")), lambda a: a != ""), lambda a: decoded(a)).alias("alts"),
        F.when(F.col("url").rlike("(?i)^https:"), F.size(F.filter(resources, lambda x: x.rlike("(?i)^http://")))).otherwise(0).cast("long").alias("insecure_resources"),
        _types("html").alias("schema_types"),
        F.size(F.filter("ld", lambda x: F.try_parse_json(x).isNull())).cast("long").alias("invalid_ld"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<li[ >]"), F.lit(0))).alias("list_items"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<table[ >]"), F.lit(0))).alias("tables"),
        F.size(tags("html", "script")).alias("scripts"),
        F.size(F.filter(F.split("body_text", " "), lambda w: w != "")).cast("long").alias("word_count"),
    ).withColumns({f"h{n}s": _texts(n) for n in (1, 2, 3)}).withColumn("h1_text", _first(F.col("h1s")))


def _ld_text(x: Column) -> Column:
    """JSON-LD without a byte-order mark, comment or CDATA wrappers."""
    x = F.regexp_replace(x, r"(?s)^\s*\x{feff}?\s*(<!--)?\s*(/\*\s*<!\[CDATA\[\s*\*/|<!\[CDATA\[)?|(/\*\s*\]\]>\s*\*/|\]\]>)?\s*(-->)?\s*$", "")
    return F.trim(x)


def _types(html: str) -> Column:
    """Distinct types of JSON-LD, microdata and RDFa in page order, at most 30, prefixes removed."""
    every = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(1))
    lists = F.flatten(F.transform(every(r'"@type"\s*:\s*\[([^\]]*)\]'), lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1))))
    found = F.concat(every(r'"@type"\s*:\s*"([^"]+)"'), lists, every(r"""itemtype=["']https?://schema\.org/([^"'\s]+)"""), every(r"""typeof=["'](?:schema:)?([A-Za-z]+)["']"""))
    return F.slice(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"^(https?://(www\.)?schema\.org/|schema:)", ""))), 1, 30)


def head(r: DataFrame) -> DataFrame:
    return r.select(
        "site_id", "page_id", "title", "lang", "description", F.array_join("robots_meta", ",").alias("robots"), "viewport", "generator",
        _first(F.col("canonicals")).alias("canonical"), F.size("canonicals").cast("long").alias("n_canonicals"),
        F.array_join(F.transform("hreflangs", lambda h: F.concat(h["lang"], F.lit("="), h["href"])), " ").alias("hreflangs"),
    )


def outline(r: DataFrame) -> Column:
    """H2 to H4 with their text (140 characters), the first 45."""
    kept = F.slice(F.filter("headings", lambda h: h["level"].between(2, 4)), 1, 45)
    return F.filter(F.transform(kept, lambda h: F.struct(h["level"].alias("level"), F.substring(h["text"], 1, 140).alias("text"))), lambda h: h["text"] != "")


def question_headings(r: DataFrame) -> Column:
    """Headings and summaries that ask something, distinct in order, the first 30."""
    summaries = F.slice(F.transform(blocks("html", "summary"), inner), 1, 30)
    return F.slice(F.array_distinct(F.filter(F.concat(F.transform(outline(r), lambda h: h["text"]), summaries), lambda x: is_question(x))), 1, 30)


def headings(r: DataFrame) -> DataFrame:
    two = F.slice(F.filter("h2s", lambda x: x != ""), 1, 6)
    three = F.slice(F.filter("h3s", lambda x: x != ""), 1, 10)
    return r.select(
        "site_id", "page_id", "h1_text", F.size("h1s").cast("long").alias("h1_count"), F.size("h2s").cast("long").alias("h2_count"), F.array_join(F.transform("headings", lambda h: h["level"]), ",").alias("levels"),
        F.array_join(two, " | ").alias("h2_texts"), F.array_join(three, " | ").alias("h3_texts"), F.array_join(F.transform(outline(r), lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["text"])), " | ").alias("outline"),
        F.array_join(question_headings(r), " | ").alias("questions"),
    )


def contact_text(r: DataFrame) -> Column:
    """Text of footers and addresses, 900 characters."""
    found = F.transform(F.concat(blocks("html", "footer"), blocks("html", "address")), inner)
    return F.substring(F.array_join(found, " | "), 1, 900)


def links(r: DataFrame) -> DataFrame:
    """Links of each page, resolved against its url: ``site_id, page_id, target, internal, times, anchor``."""
    rows = r.select("site_id", "page_id", "url", F.explode("anchors").alias("a")).where("a.href <> '' and not a.href like '#%' and a.target is not null")
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]+)", 1))
    rows = rows.select("site_id", "page_id", F.col("a.target").alias("target"), (host("a.target") == host("url")).alias("internal"), F.substring("a.text", 1, 120).alias("text"))
    return rows.groupBy("site_id", "page_id", "target", "internal").agg(F.count("*").alias("times"), F.min("text").alias("anchor"))


def tel_links(r: DataFrame) -> Column:
    numbers = F.transform(F.filter("anchors", lambda a: F.lower(a["href"]).startswith("tel:")), lambda a: F.trim(F.coalesce(F.try_url_decode(F.replace(F.substring(a["href"], 5, 200), F.lit("+"), F.lit("%2B"))), a["href"])))
    return F.slice(F.filter(numbers, lambda x: x != ""), 1, 5)


def heading_skip() -> Column:
    """The first heading that is more than one level below the one before: from, to, text; null if there is none."""
    pairs = F.zip_with(F.slice("headings", F.lit(1), F.greatest(F.size("headings") - 1, F.lit(0))), F.slice("headings", F.lit(2), F.greatest(F.size("headings") - 1, F.lit(0))), lambda a, b: F.struct(a["level"].alias("from"), b["level"].alias("to"), F.substring(b["text"], 1, 80).alias("text")))
    return F.try_element_at(F.filter(pairs, lambda p: p["to"] > p["from"] + 1), F.lit(1))


def weak_anchors() -> Column:
    """Links inside the site whose words say nothing, distinct, the first 10."""
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]+)", 1))
    label = lambda a: F.trim(F.regexp_replace(F.lower(a["text"]), "[.!»›→>…]+$", ""))
    kept = F.filter("anchors", lambda a: a["target"].isNotNull() & ~a["href"].startswith("#") & (host(a["target"]) == host(F.col("url"))) & label(a).isin(*VAGUE))
    return F.slice(F.array_distinct(F.transform(kept, lambda a: F.struct(a["target"].alias("href"), label(a).alias("text")))), 1, 10)


def quality(r: DataFrame) -> DataFrame:
    """Mixed content, the first skipped heading level and vague anchors of each page."""
    skip = heading_skip()
    return r.select("site_id", "page_id", "insecure_resources", skip["from"].alias("skip_from"), skip["to"].alias("skip_to"), F.size(weak_anchors()).cast("long").alias("weak_anchors"), F.array_join(F.transform(weak_anchors(), lambda a: a["text"]), ",").alias("weak_texts"))


def readable(r: DataFrame) -> DataFrame:
    """Title (the shared one first), publish date and main text from article, main or body, boilerplate elements out."""
    meta = lambda p: F.coalesce(*[F.nullif(F.regexp_extract("html", x, 1), F.lit("")) for x in p], F.lit(""))
    prop = lambda n: [rf"""(?is)<meta\b[^>]*property=["']{n}["'][^>]*content=["']([^"']*)""", rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*property=["']{n}["']"""]
    bare = F.col("html")
    for name in ("nav", "header", "footer", "aside", "form", "svg", "iframe"):
        bare = F.regexp_replace(bare, rf"(?is)<{name}(?=[\s>]).*?</{name}\s*>", " ")
    rows = r.withColumn("bare", bare)
    main = F.coalesce(*[F.nullif(F.regexp_extract("bare", rf"(?is)<{n}(?=[\s>])[^>]*>(.*)</{n}\s*>", 1), F.lit("")) for n in ("article", "main")], body_of("bare"))
    shared = decoded(meta(prop("og:title")))
    date = meta([*prop("article:published_time"), r"""(?is)<time\b[^>]*datetime=["']([^"']*)"""])
    return rows.select("site_id", "page_id", F.when(shared != "", F.trim(shared)).otherwise(F.col("title")).alias("title"), F.substring(date, 1, 10).alias("published"), visible(main).alias("text"))


def stack_markers(r: DataFrame) -> DataFrame:
    """Framework marks in the first 400,000 characters and application mount points: ``marks`` (comma-joined), ``mounts``, ``scripts``."""
    h = F.substring("html", 1, 400_000)
    marks = {
        "wordpress": "wp-content|wp-includes", "shopify": r"cdn\.shopify\.com", "wix": r"static\.wixstatic\.com|wix\.com website builder", "squarespace": r"squarespace\.com|static1\.squarespace", "webflow": r"webflow\.(com|js)",
        "next": "__NEXT_DATA__|/_next/", "nuxt": "__NUXT__|/_nuxt/", "gatsby": "___gatsby|gatsby-", "react": r"data-reactroot|react(-dom)?(\.production)?(\.min)?\.js", "vue": r"data-v-app|vue(\.runtime)?(\.min)?\.js",
        "angular": "ng-version", "svelte": "svelte-[a-z0-9]+|__sveltekit", "astro": "astro-island|data-astro", "drupal": "drupal-settings-json|/sites/default/files", "joomla": "/media/jui/|com_content", "ghost": "ghost-(sdk|portal)|content=\"Ghost",
    }
    mounts = F.filter(F.array(*[F.lit(m) for m in MOUNTS]), lambda m: F.contains(h, F.concat(F.lit('id="'), m, F.lit('"'))))
    return r.select("site_id", "page_id", F.concat_ws(",", *[F.when(h.rlike(p), k) for k, p in marks.items()]).alias("marks"), F.array_join(mounts, ",").alias("mounts"), F.col("scripts").cast("long").alias("scripts"), "generator")


def client_rendered(r: DataFrame) -> DataFrame:
    """Pages that are an empty shell: a mount point, under 50 words and at least one script."""
    rows = r.join(stack_markers(r).select("site_id", "page_id", "mounts"), ["site_id", "page_id"])
    return rows.select("site_id", "page_id", ((F.col("mounts") != "") & (F.length("body_text") < 100) & (F.col("word_count") < 50) & (F.col("scripts") >= 1)).alias("client_rendered"))


def issues(r: DataFrame) -> DataFrame:
    """One row for each rule that a page breaks: ``site_id, page_id, url, rule, category, severity``; one narrow pass."""
    tests = {
        "missing_title": F.col("title") == "", "long_title": F.length("title") > 60,
        "missing_description": F.col("description") == "", "long_description": F.length("description") > 160,
        "missing_h1": F.size("h1s") == 0, "many_h1": F.size("h1s") > 1,
        "missing_canonical": _first(F.col("canonicals")) == "", "noindex": F.exists("robots_meta", lambda x: x.rlike(r"(^|[\s,])(noindex|none)([\s,]|$)")),
        "missing_alt": F.col("images_missing_alt") > 0, "thin": (F.col("word_count") > 0) & (F.col("word_count") < 300),
        "invalid_schema": (F.size("schema_types") == 0) & (F.col("invalid_ld") > 0), "no_schema": (F.size("schema_types") == 0) & (F.col("invalid_ld") == 0),
        "no_viewport": F.col("viewport") == "", "zoom_block": F.col("viewport").rlike(r"(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0)?\b"),
        "insecure": F.col("insecure_resources") > 0, "long_url": F.length(F.regexp_extract("url", "(?i)^[a-z]+://[^/?#]+([^#]*)", 1)) > 100,
        "heading_skip": heading_skip().isNotNull(), "vague_anchors": F.size(weak_anchors()) > 0, "slow": F.coalesce(F.col("load_ms") > 3000, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(k).alias("rule"), F.lit(RULES[k][0]).alias("category"), F.lit(RULES[k][1]).alias("severity"))) for k, t in tests.items()]))
    return r.select("site_id", "page_id", "url", F.explode(found).alias("i")).select("site_id", "page_id", "url", "i.rule", "i.category", "i.severity")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(100.0), rounded(x))).cast("long")


def scores(r: DataFrame, found: DataFrame) -> DataFrame:
    """Technical and content score of each page: 100 less the penalties, from 5 to 100."""
    penalty = F.lit(0)
    for k, v in PENALTY.items():
        penalty = F.when(F.col("severity") == k, v).otherwise(penalty)
    tech = F.col("category").isin("Technical", "Schema")
    keys = ["site_id", "page_id"]
    lost = found.groupBy(*keys).agg(F.sum(F.when(tech, penalty).otherwise(0)).alias("t"), F.sum(F.when(~tech, penalty).otherwise(0)).alias("c"))
    rows = r.select(*keys).join(lost.hint("merge"), keys, "left")
    return rows.select(*keys, _clamp(100 - F.coalesce("t", F.lit(0))).alias("technical"), _clamp(100 - F.coalesce("c", F.lit(0))).alias("content"))


def site_scores(pages: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Averages per site of page scores, the technical one less up to 35 for the site's findings: ``site_id, pages, technical, content``.

    ``findings`` has ``site_id`` and ``severity``.
    """
    rows = pages.groupBy("site_id").agg(F.count("*").alias("pages"), F.avg("technical").alias("t"), F.avg("content").alias("c"))
    if findings is None:
        return rows.select("site_id", "pages", _clamp(F.col("t")).alias("technical"), _clamp(F.col("c")).alias("content"))
    cost = F.when(F.col("severity") == "Critical", 11).when(F.col("severity") == "High", 7).when(F.col("severity") == "Medium", 4).otherwise(2)
    lost = findings.groupBy("site_id").agg(F.least(F.lit(35), F.sum(cost)).alias("lost"))
    rows = rows.join(lost.hint("merge"), "site_id", "left")
    return rows.select("site_id", "pages", _clamp(F.col("t") - F.coalesce("lost", F.lit(0))).alias("technical"), _clamp(F.col("c")).alias("content"))


def duplicates(r: DataFrame, column: str) -> DataFrame:
    """Values that more than one page of a site has: ``site_id, value, pages, first_page, urls`` (25 at most)."""
    rows = r.where(F.col(column) != "").groupBy("site_id", F.col(column).alias("value"))
    return rows.agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.array_join(F.slice(F.array_sort(F.collect_set("url")), 1, 25), " ").alias("urls")).where("pages > 1")


def recurring(found: DataFrame) -> DataFrame:
    """Rules that at least two pages of a site break, with their pages' urls (25 at most)."""
    rows = found.groupBy("site_id", "category", "rule", "severity")
    return rows.agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.array_join(F.slice(F.array_sort(F.collect_set("url")), 1, 25), " ").alias("urls")).where("pages > 1")


def https_findings(pages: DataFrame) -> DataFrame:
    """Sites with pages over http: ``site_id, http_pages, https_pages, kind``."""
    rows = pages.groupBy("site_id").agg(F.count_if(F.col("url").startswith("http://")).alias("http_pages"), F.count_if(F.col("url").startswith("https://")).alias("https_pages"))
    return rows.where("http_pages > 0").withColumn("kind", F.when(F.col("https_pages") > 0, "http pages in an https site").otherwise("site on http"))


def url_hygiene(r: DataFrame) -> DataFrame:
    """Capitals, underscores and query strings in urls, and links of https pages to http pages of the same site."""
    path = F.regexp_extract("url", "(?i)^[a-z]+://[^/?#]+([^?#]*)", 1)
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]+)", 1))
    plain = F.filter("anchors", lambda a: a["target"].startswith("http://") & (host(a["target"]) == host(F.col("url"))))
    return r.select("site_id", "page_id", path.rlike("[A-Z]").alias("capitals"), path.contains("_").alias("underscores"), F.col("url").contains("?").alias("query"), F.when(F.col("url").startswith("https://"), F.size(plain)).otherwise(0).cast("long").alias("http_links"))


def _aeo(r: DataFrame) -> dict[str, Column]:
    has = lambda t: F.array_contains("schema_types", t)
    sub = F.concat(F.slice(F.filter("h2s", lambda x: x != ""), 1, 6), F.slice(F.filter("h3s", lambda x: x != ""), 1, 10))
    return {
        "faq_schema": has("FAQPage"), "howto_schema": has("HowTo"), "qa_schema": has("QAPage"), "any_schema": F.size("schema_types") > 0,
        "list_markup": F.col("list_items") >= 3, "table_markup": F.col("tables") >= 1, "multiple_headings": F.size(sub) >= 2,
        "question_heading": F.exists(sub, lambda x: x.rlike(QUESTION_HEADING)), "direct_answer": F.lower("full_text").rlike(DIRECT_ANSWER),
        "existing_questions": F.size(existing_questions(F.col("full_text"))) > 0, "content_depth": F.col("word_count") >= 300,
    }


def _geo(r: DataFrame) -> dict[str, Column]:
    types = lambda *t: F.exists("schema_types", lambda x: x.isin(*t))
    body = F.lower("full_text")
    say = lambda k: body.rlike(GEO_PHRASES[k])
    return {
        "organization_schema": types("Organization", "LocalBusiness", "Corporation"), "product_schema": types("Product", "Service", "Offer"), "article_schema": types("Article", "Person", "BlogPosting", "NewsArticle"),
        "contact": say("contact") | body.rlike(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}") | body.rlike(r"\+?[0-9][0-9 ().-]{7,}[0-9]"),
        "about": say("about") | F.lower("title").contains("about") | F.lower("h1_text").contains("about"), "location": say("location"), "audience": say("audience"), "credential": say("credential"),
        "social_proof": say("social_proof"), "policy": say("policy"), "clear_naming": (F.col("title") != "") & (F.col("h1_text") != ""),
    }


def aeo_flags(r: DataFrame) -> DataFrame:
    return r.select("site_id", "page_id", *[c.alias(k) for k, c in _aeo(r).items()])


def geo_flags(r: DataFrame) -> DataFrame:
    return r.select("site_id", "page_id", *[c.alias(k) for k, c in _geo(r).items()])


#: Signals beside the built-in ones, by name: a function of the records that gives a boolean Column, and its weight.
SIGNALS: dict[str, tuple] = {}


def register_signal(name: str, test, weight: int) -> None:
    """Add a page signal to ``signal_flags``: ``test(records)`` gives a boolean Column (native, or of a pandas UDF)."""
    SIGNALS[name] = (test, weight)


def signal_flags(r: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The answer flags and the registered signals, with all weights."""
    extra = {k: test(r) for k, (test, _) in SIGNALS.items()}
    flags = r.select("site_id", "page_id", *[c.alias(k) for k, c in (_aeo(r) | extra).items()])
    return flags, AEO_WEIGHTS | {k: w for k, (_, w) in SIGNALS.items()}


def both_scores(r: DataFrame) -> DataFrame:
    """Answer and entity score of each page, in one pass."""
    score = lambda flags, weights: rounded(sum((F.when(flags[k], w).otherwise(0) for k, w in weights.items()), F.lit(0)) * 100.0 / sum(weights.values())).cast("long")
    return r.select("site_id", "page_id", score(_aeo(r), AEO_WEIGHTS).alias("aeo_score"), score(_geo(r), GEO_WEIGHTS).alias("geo_score"))


def site_flags(flags: DataFrame) -> DataFrame:
    """Any-page answer, count and the first five pages of each flag of a site, by one unpivot and one aggregate."""
    names = [c for c in flags.columns if c not in ("site_id", "page_id")]
    rows = flags.unpivot(["site_id", "page_id"], names, "flag", "hit")
    hits = F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("page_id"))))
    return rows.groupBy("site_id", "flag").agg(F.bool_or("hit").alias("any_page"), F.count_if("hit").alias("pages"), F.array_join(F.slice(hits, 1, 5), ",").alias("first_pages"))


def flag_scores(flags: DataFrame, weights: dict[str, int]) -> DataFrame:
    total = sum((F.when(F.col(k), w).otherwise(0) for k, w in weights.items()), F.lit(0))
    return flags.select("site_id", "page_id", rounded(total * 100.0 / sum(weights.values())).cast("long").alias("score"))


def site_flag_scores(r: DataFrame) -> DataFrame:
    """Answer and entity score of each site, a flag counting if any page has it: ``site_id, aeo_score, geo_score``."""
    aeo, geo = _aeo(r), _geo(r)
    any_page = r.groupBy("site_id").agg(*[F.bool_or(c).alias(k) for k, c in (aeo | geo).items()])
    score = lambda weights: rounded(sum((F.when(F.col(k), w).otherwise(0) for k, w in weights.items()), F.lit(0)) * 100.0 / sum(weights.values())).cast("long")
    return any_page.select("site_id", score(AEO_WEIGHTS).alias("aeo_score"), score(GEO_WEIGHTS).alias("geo_score"))


def weakest_pages(scored: DataFrame, most: int = 5) -> DataFrame:
    """The pages of each site with the lowest scores: ``site_id, place, page_id, score``."""
    order = Window.partitionBy("site_id").orderBy("score", "page_id")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("site_id", "place", "page_id", "score")


def page_sample(scored: DataFrame, most: int = 20) -> DataFrame:
    """A few pages that stand for a site: ``site_id, place, page_id, why``.  ``scored``: site_id, page_id, is_home, score, word_count.

    The home page, then the weakest pages on half of the places left, then the longest; a site with no more pages than ``most`` gives all of them, by id.  Three ranks within a
    site, of which Spark keeps the first ``most`` rows on each side of the shuffle.
    """
    site = Window.partitionBy("site_id")
    sizes = scored.groupBy("site_id").agg(F.count("*").alias("n_pages"), F.max(F.col("is_home").cast("int")).alias("n_home"))
    small = scored.join(sizes.where(F.col("n_pages") <= most).select("site_id").hint("merge"), "site_id", "left_semi")
    every = small.select("site_id", F.row_number().over(site.orderBy("page_id")).cast("long").alias("place"), "page_id", F.lit("all").alias("why"))
    large = scored.join(sizes.where(F.col("n_pages") > most).hint("merge"), "site_id")
    first = F.row_number().over(site.orderBy(F.desc("is_home"), "page_id"))
    home = large.where("is_home").withColumn("r", first).where("r = 1").select("site_id", "page_id", F.lit(0).alias("step"), "r", F.lit("home").alias("why"))
    rest = large.join(home.select("site_id", "page_id").hint("merge"), ["site_id", "page_id"], "left_anti")
    weakest = rest.withColumn("r", F.row_number().over(site.orderBy("score", "page_id"))).where(F.col("r") <= most)
    weakest = weakest.where(F.col("r") <= F.ceil((most - F.col("n_home")) / 2)).select("site_id", "page_id", F.lit(1).alias("step"), "r", F.lit("weak").alias("why"))
    left = rest.join(weakest.select("site_id", "page_id").hint("merge"), ["site_id", "page_id"], "left_anti")
    longest = left.withColumn("r", F.row_number().over(site.orderBy(F.desc_nulls_last("word_count"), "page_id"))).where(F.col("r") <= most).select("site_id", "page_id", F.lit(2).alias("step"), "r", F.lit("long").alias("why"))
    chosen = home.unionByName(weakest).unionByName(longest).repartitionByRange("site_id", "step", "r")
    placed = chosen.withColumn("place", F.row_number().over(site.orderBy("step", "r")).cast("long")).where(F.col("place") <= most)
    return every.unionByName(placed.select("site_id", "place", "page_id", "why"))


#: Redirects that say the old URL will come back, and the share of pages up to which a fault is a warning.
TEMPORARY, WARNING_SHARE = (302, 303, 307), 0.2


def temporary_redirects(pages: DataFrame) -> DataFrame:
    """Pages of each site that were reached through a temporary redirect: ``site_id, pages, temporary, status``.

    ``pages``: site_id, redirects (an array of structs with a status).  Unknown where no page has recorded its redirects.
    """
    hit = F.exists("redirects", lambda r: r["status"].isin(*TEMPORARY))
    rows = pages.groupBy("site_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce(hit, F.lit(False))).alias("temporary"), F.count("redirects").alias("known"))
    status = F.when(F.col("known") == 0, "unknown").when(F.col("temporary") == 0, "pass").when(F.col("temporary") / F.col("pages") <= WARNING_SHARE, "warn").otherwise("fail")
    return rows.select("site_id", "pages", "temporary", status.alias("status"))


# Page types, the first whose pattern fits the path or (but for articles) the title's first part; flags that do not apply to a type.
PAGE_TYPES = {
    "contact": r"(?i)(^|[/_-])(contact|get-in-touch|support)([/_.-]|$)|contact us",
    "legal": r"(?i)privacy|terms|cookie|refund|disclaimer|legal|gdpr",
    "about": r"(?i)(^|[/_-])about([/_.\s:-]|$)|about us|our story",
    "blog-index": r"(?i)(^|/)blog/?$|^blog\b",
    "article": r"(?i)/blog/|/articles?/|/news/|/guides?/|/resources?/|/posts?/",
}
NOT_APPLICABLE = {
    "contact": ("table_markup", "direct_answer", "howto_schema", "qa_schema", "list_markup", "content_depth"),
    "legal": ("table_markup", "direct_answer", "howto_schema", "qa_schema", "faq_schema", "existing_questions", "content_depth"),
    "blog-index": ("table_markup", "direct_answer", "howto_schema", "qa_schema", "faq_schema", "existing_questions", "content_depth"),
    "about": ("table_markup", "howto_schema", "qa_schema"),
    "home": ("howto_schema", "qa_schema"),
    "content": ("qa_schema",),
}


def page_type(r: DataFrame) -> Column:
    """contact, legal, about, blog-index, article, home or content, by path and the title's first part."""
    path = F.regexp_extract("url", r"(?i)^[a-z]+://[^/?#]+([^?#]*)", 1)
    start = F.element_at(F.split("title", r"[—|–-]"), 1)
    out = F.lit(None).cast("string")
    for name, pattern in PAGE_TYPES.items():
        fits = path.rlike(pattern) if name == "article" else path.rlike(pattern) | start.rlike(pattern)
        out = F.coalesce(out, F.when(fits, name))
    blog = F.col("title").rlike(r"(?i)\bblog\b") & (F.col("word_count") > 600)
    return F.coalesce(out, F.when(blog, "article").when(path.isin("", "/"), "home").otherwise("content"))


def missing_flags(flags: DataFrame, weights: dict[str, int], types: DataFrame | None = None, most: int = 3) -> DataFrame:
    """The costliest flags that each page lacks, with its score now and if they were met: ``site_id, page_id, place, flag, points, score, potential``.

    ``types`` has page_id and page_type; flags that do not apply to the type count neither way.
    """
    points = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])
    keys = ["site_id", "page_id"]
    rows = flags.unpivot(keys, list(weights), "flag", "hit").withColumn("points", F.element_at(points, F.col("flag")).cast("long"))
    if types is not None:
        apply = F.lit(True)
        for name, skipped in NOT_APPLICABLE.items():
            apply = apply & ~((F.col("page_type") == name) & F.col("flag").isin(*skipped))
        rows = rows.join(types.select("page_id", "page_type").hint("merge"), "page_id").where(apply)
    page = Window.partitionBy(*keys)
    rows = rows.withColumn("whole", F.sum("points").over(page)).withColumn("met", F.sum(F.when(F.col("hit"), F.col("points")).otherwise(0)).over(page)).where(~F.col("hit"))
    place = F.row_number().over(page.orderBy(F.desc("points"), "flag"))
    top = rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)
    gain = F.sum("points").over(page)
    percent = lambda x: rounded(x * 100.0 / F.col("whole")).cast("long")
    return top.withColumn("gain", gain).select(*keys, "place", "flag", "points", percent(F.col("met")).alias("score"), percent(F.col("met") + F.col("gain")).alias("potential"))


def market_language(r: DataFrame, languages: list[str]) -> DataFrame:
    """Page languages of each site against a market's: ``site_id, lang, pages, fits``."""
    base = F.lower(F.split(F.col("lang"), "[-_]").getItem(0))
    return r.groupBy("site_id", base.alias("lang")).agg(F.count("*").alias("pages")).withColumn("fits", F.when(F.col("lang") == "", F.lit(None).cast("boolean")).otherwise(F.col("lang").isin(languages)))
