"""Topic clusters, competitor phrases and citations, question bank, content slots."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.html import let
from plumbline.functions.text import host_of, rounded, url_key
from plumbline.operators.greedy import free_places, kept_in_order, leader_groups, set_key
from plumbline.operators.keywords import STOPWORDS, ngrams, tokens
from plumbline.operators.links import _cut


def connected(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node, root``: the smallest node that each reaches; in each round all nodes of a label take the least label that any of them borders on, and the label of that one.

    Labels only fall, and those that border on a smaller one go at once, so the rounds grow with the logarithm of the longest way; where ``most`` rounds do not settle them, it is an error.
    """
    both = _cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = _cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    for _ in count() if most is None else range(most):
        near = both.join(now.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooks = _cut(now.join(near.hint("merge"), "node").groupBy("root").agg(F.least(F.col("root"), F.min("near")).alias("least")))
        if hooks.where("least <> root").isEmpty():
            # no label borders on a smaller one
            return now
        further = hooks.select(F.col("root").alias("least"), F.col("least").alias("further"))
        hooks = hooks.join(further.hint("merge"), "least", "left").select("root", F.coalesce("further", "least").alias("least"))
        now = _cut(now.join(hooks.hint("merge"), "root").select("node", F.col("least").alias("root")))
    raise RuntimeError("connected: no fixed point")


def _gate(site_pages: DataFrame) -> DataFrame:
    """On how many pages of a site a word may stand before it is too common to link anything: ``site_id, gate``."""
    return site_pages.select("site_id", F.greatest(F.lit(4), F.ceil(F.col("site_pages") * 2 / 5)).alias("gate"))


def keyword_clusters(cands: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Phrases of a site that share a word of four letters or more: ``site_id, cluster, phrase, score, pages, links_pages``; the label is the best phrase.

    ``site_pages`` (site_id, site_pages) sets the gate: a word on more pages of the site links no phrases, and a phrase that is such a bare word
    stays in its cluster but says nothing of its pages (``links_pages``).  Each word links its phrases to the first of them, so a
    common word makes a star and not all pairs.
    """
    words = cands.select("site_id", "page_id", "phrase", F.explode(F.array_distinct(F.split(F.lower("phrase"), r"\s+"))).alias("word")).where(F.length("word") >= 4)
    spread = words.groupBy("site_id", "word").agg(F.count_distinct("page_id").alias("on"), F.min("phrase").alias("first")).join(_gate(site_pages).hint("merge"), "site_id")
    usable = spread.where(F.col("on") <= F.col("gate")).select("site_id", "word", "first")
    name = lambda c: F.concat_ws("\u0001", "site_id", c)
    edges = words.join(usable.hint("merge"), ["site_id", "word"]).where("phrase <> first").select(name("phrase").alias("a"), name("first").alias("b")).distinct()
    roots = connected(edges)
    totals = cands.groupBy("site_id", "phrase").agg(F.sum("score").cast("long").alias("score"), F.count_distinct("page_id").alias("pages")).withColumn("node", name("phrase"))
    rows = totals.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(_gate(site_pages).hint("merge"), "site_id")
    best = rows.groupBy("root").agg(F.max_by("phrase", F.struct("score", "phrase")).alias("cluster"))
    telling = F.contains("phrase", F.lit(" ")) | (F.col("pages") <= F.col("gate"))
    return rows.join(best.hint("merge"), "root").select("site_id", "cluster", "phrase", "score", "pages", telling.alias("links_pages"))


def cannibalization(cands: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of a site in which at least two pages have a phrase, other than a bare common word, in title or h1."""
    keys = ["site_id", "phrase"]
    telling = clusters.where("links_pages").select(*keys, "cluster")
    strong = cands.where("in_title or in_h1").join(telling.hint("merge"), keys).groupBy("site_id", "cluster").agg(F.count_distinct("page_id").alias("pages"))
    return strong.where("pages >= 2")


def page_phrases(headings: DataFrame) -> DataFrame:
    """Phrases of two to four words that pages are built around, less those inside a longer kept one.

    ``headings``: competitor, url, weight, text.  A phrase counts once a page at its best weight and stays with two pages or a
    weight of three; a shorter one goes if a longer kept one holds it on 70 % of its pages.  Longer ones are settled first.
    """
    rows = headings.select("competitor", "url", "weight", F.explode(let(tokens("text"), lambda w: ngrams(w, 4))).alias("phrase")).where(F.contains("phrase", F.lit(" ")))
    per = rows.groupBy("competitor", "url", "phrase").agg(F.max("weight").alias("weight"))
    listed = per.groupBy("phrase").agg(F.count("*").alias("pages"), F.count_distinct("competitor").alias("competitors"), F.sum("weight").cast("long").alias("score"), F.max("weight").alias("best"))
    listed = _cut(listed.where("pages >= 2 or best >= 3").withColumn("n", F.size(F.split("phrase", " "))).drop("best"))
    kept = listed.where("n = 4")
    for n in (3, 2):
        w = F.split("phrase", " ")
        inside = kept.select("pages", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))).alias("phrase"))
        longest = inside.groupBy("phrase").agg(F.max("pages").alias("longer"))
        rest = listed.where(F.col("n") == n).join(longest.hint("merge"), "phrase", "left").where("longer is null or longer < pages * 0.7").drop("longer")
        kept = kept.unionByName(rest)
    return kept


# Hosts that are no sources, and kinds of authority in their order.
SKIPPED_HOSTS = r"(^|\.)(bit\.ly|t\.co|goo\.gl|ow\.ly|tinyurl\.com|apps\.apple\.com|play\.google\.com|doubleclick\.net|googleadservices\.com|googletagmanager\.com|wa\.me|api\.whatsapp\.com|paypal\.com|stripe\.com|shopify\.com|wordpress\.org|gravatar\.com|schema\.org|w3\.org)$"
# Hosts that rank for almost everything and are nobody's source or competitor.
GENERIC_HOSTS = (
    "wikipedia.org", "youtube.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "pinterest.com", "tiktok.com",
    "reddit.com", "quora.com", "medium.com", "amazon.com", "ebay.com", "tripadvisor.com", "yelp.com", "google.com", "apple.com", "github.com", "stackoverflow.com",
)
AUTHORITY = (
    ("Government", r"(^|\.)(gov|gob|gouv|govt)(\.[a-z]{2})?$|(^|\.)go\.[a-z]{2}$"), ("International body", r"(^|\.)(un\.org|who\.int|worldbank\.org|oecd\.org|europa\.eu|unesco\.org|unicef\.org|imf\.org)$|\.int$"),
    ("Education / research", r"(^|\.)(edu|ac)(\.[a-z]{2})?$"), ("Organisation", r"\.org(\.[a-z]{2})?$|(^|\.)or\.[a-z]{2}$"),
)


def authority(host: str):
    out = F.lit("Other")
    for name, pattern in reversed(AUTHORITY):
        out = F.when(F.col(host).rlike(pattern), name).otherwise(out)
    return out


def authority_rank(name: Column) -> Column:
    out = F.lit(len(AUTHORITY))
    for k, (a, _) in enumerate(AUTHORITY):
        out = F.when(name == a, k).otherwise(out)
    return out


def generic_host(host: Column) -> Column:
    """Whether a host is one of the generic ones or below it."""
    return F.exists(F.array(*[F.lit(g) for g in GENERIC_HOSTS]), lambda g: F.endswith(F.concat(F.lit("."), host), F.concat(F.lit("."), g)))


def citations(links: DataFrame, own_host: str = "") -> DataFrame:
    """Outside pages that competitors' pages link to: ``key, host, authority, links, competitors, anchors``.

    ``links`` has competitor, host_of_page, url, anchor.  Home pages, links within a competitor, hosts that are no sources and the own host are left out.
    """
    # equal links are one row from here on, so hosts and keys are read once for each
    equal = links.groupBy("competitor", "host_of_page", "url", "anchor").agg(F.count("*").alias("times"))
    rows = equal.withColumn("host", host_of("url")).withColumn("key", F.regexp_replace(url_key("url"), "/$", ""))
    inside = lambda h: (F.col("host") == h) | F.endswith(F.col("host"), F.concat(F.lit("."), h))
    rows = rows.where(F.col("key").contains("/") & F.col("host").isNotNull() & ~F.col("host").rlike(SKIPPED_HOSTS) & ~generic_host(F.col("host")) & ~inside(F.col("host_of_page")))
    if own_host:
        rows = rows.where(~inside(F.lit(own_host)))
    found = rows.groupBy("key").agg(
        F.min("host").alias("host"), F.sum("times").alias("links"), F.count_distinct("competitor").alias("competitors"), F.array_join(F.slice(F.array_sort(F.collect_set(F.nullif("anchor", F.lit("")))), 1, 3), " | ").alias("anchors")
    )
    return found.withColumn("authority", authority("host"))


def citations_for_topic(cites: DataFrame, topics: DataFrame, most: int = 6) -> DataFrame:
    """The citations that fit each topic (topic): words shared with url and anchors first, then authority and count; unrelated ones only with authority."""
    words = lambda c: F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    wanted = topics.select("topic", F.array_distinct(F.filter(words(F.col("topic")), lambda w: F.length(w) > 2)).alias("need"))
    seen = cites.select("key", "host", "authority", "links", words(F.concat_ws(" ", "key", "anchors")).alias("have"))
    # both sides are lists that the caller keeps: topics of a plan and their candidate sources, joined on shared words
    hit = wanted.select("topic", F.explode("need").alias("w")).join(seen.select("key", F.explode("have").alias("w")).hint("merge"), "w").groupBy("topic", "key").agg(F.count("*").alias("overlap"))
    score = F.col("overlap") * 3 + (4 - authority_rank(F.col("authority"))) + F.least(F.col("links"), F.lit(3)) * 0.5
    related = hit.join(seen.drop("have").hint("merge"), "key")
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "key")
    first = related.withColumn("score", score).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)
    # what fills up is the same for all topics: the best of the authoritative
    spare = seen.where("authority <> 'Other'").withColumn("score", (4 - authority_rank(F.col("authority"))) + F.least(F.col("links"), F.lit(3)) * 0.5).orderBy(F.desc("score"), "key").limit(2 * most).drop("have")
    had = first.groupBy("topic").agg(F.count("*").alias("n"))
    gaps = wanted.select("topic").join(had.hint("merge"), "topic", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < most)
    fill = gaps.crossJoin(F.broadcast(spare)).join(hit.select("topic", "key").hint("merge"), ["topic", "key"], "left_anti")
    fill = fill.withColumn("place", (F.col("n") + F.row_number().over(order)).cast("long")).where(F.col("place") <= most)
    columns = ["topic", "place", "key", "host", "authority", "score"]
    return first.select(*columns).unionByName(fill.select(*columns))


def source_candidates(results: DataFrame, most: int = 8) -> DataFrame:
    """One result for each host of a topic (topic, url, place), by authority and then by place."""
    rows = results.withColumn("host", host_of("url")).where("host is not null")
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("topic", "host").orderBy("place"))).where("_n = 1").drop("_n").withColumn("authority", authority("host"))
    order = F.row_number().over(Window.partitionBy("topic").orderBy(authority_rank(F.col("authority")), "place"))
    return one.withColumn("rank", order.cast("long")).where(F.col("rank") <= most).select("topic", "rank", "host", "authority", "url")


SOURCE_WEIGHT = {"faq": 3, "heading": 2, "text": 1}
JUNK_QUESTION = r"(?i)cookie|newsletter|subscribe|log ?in\b|sign ?(up|in)\b|password|privacy policy|terms (of|and)|unsubscribe|captcha|click here|cart\b|checkout|my account"


def norm_question(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def usable_question(x) -> Column:
    """As long as a sentence, without links, and nothing that belongs to the site's furniture."""
    t = F.substring(F.trim(F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"\s+", " ")), 1, 200)
    return F.length(t).between(15, 140) & F.size(F.split(t, " ")).between(3, 26) & ~t.rlike(r"(?i)https?:|www\.") & ~t.rlike(JUNK_QUESTION) & t.rlike(r"\p{L}")


def slim_pages(records: DataFrame) -> DataFrame:
    """What is kept of a competitor's pages: titles, headings (40), questions with their source (25), types, size and outside links (15); no body text."""
    from plumbline.operators.pages import existing_questions, is_question, outline, question_headings

    marked = lambda a, s: F.transform(a, lambda q: F.struct(F.substring(q, 1, 200).alias("q"), F.lit(s).alias("src")))
    stated = F.filter(existing_questions(F.col("full_text")), lambda q: is_question(q, strict=True))
    every = F.filter(F.concat(marked(question_headings(records), "heading"), marked(stated, "text")), lambda x: usable_question(x["q"]))
    once = lambda q: let(F.transform(q, lambda x: norm_question(x["q"])), lambda keys: F.filter(F.transform(q, lambda x, i: F.when(F.array_position(keys, norm_question(x["q"])) == i + 1, x)), lambda x: x.isNotNull()))
    distinct = let(every, once)
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]+)", 1))
    outside = F.filter("anchors", lambda a: a["target"].isNotNull() & (host(a["target"]) != host(F.col("url"))))
    cites = F.slice(F.array_distinct(F.transform(outside, lambda a: F.struct(F.substring(a["target"], 1, 400).alias("url"), F.substring(a["text"], 1, 100).alias("anchor")))), 1, 15)
    return records.select("site_id", "page_id", "url", F.substring("title", 1, 200).alias("title"), F.substring("h1_text", 1, 200).alias("h1"), F.slice(outline(records), 1, 40).alias("headings"), F.slice(distinct, 1, 25).alias("questions"), F.slice("schema_types", 1, 10).alias("schema_types"), "word_count", "list_items", "tables", cites.alias("cites"))


def question_bank(questions: DataFrame, ours: DataFrame, brands: DataFrame) -> DataFrame:
    """Questions of competitors by wording: ``key, text, competitors, pages, sources, answered, our_url``.

    ``questions``: competitor, url, source, text; ``ours``: text, url; ``brands``: competitor, brand.  A question that names its
    competitor's brand is left out.  ``answered`` is yes from a similarity of 0.6 to one of our questions or headings, partial from 0.4.
    """
    weight = F.lit(0)
    for k, w in SOURCE_WEIGHT.items():
        weight = F.when(F.col("source") == k, w).otherwise(weight)
    named = brands.groupBy("competitor").agg(F.collect_set(F.lower("brand")).alias("brands"))
    rows = questions.withColumn("key", norm_question("text")).where("key <> ''").join(named.hint("merge"), "competitor", "left")
    rows = rows.where(~F.exists(F.coalesce("brands", F.array().cast("array<string>")), lambda b: F.contains("key", b))).withColumn("weight", weight)
    bank = rows.groupBy("key").agg(
        F.max_by("text", F.struct("weight", F.hash("text"))).alias("text"), F.count_distinct("competitor").alias("competitors"), F.array_join(F.slice(F.array_sort(F.collect_set("url")), 1, 4), " ").alias("pages"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )
    return bank.join(question_coverage(bank.select(F.col("key").alias("id"), "text"), ours).hint("merge"), F.col("key") == F.col("id"), "left").drop("id")


def question_coverage(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """The best of our texts (text, url) for each of theirs (id, text): ``id, answered, our_url``."""
    from plumbline.operators.similarity import best_matches, overlaps, title_words

    mine = ours.select(F.struct("text", "url").alias("id"), title_words("text").alias("words")).distinct()
    best = best_matches(overlaps(theirs.select("id", title_words("text").alias("words")), mine))
    answered = F.when(F.col("similarity") >= 0.6, "yes").when(F.col("similarity") >= 0.4, "partial").otherwise("no")
    rows = theirs.select("id").join(best.select(F.col("l").alias("id"), "similarity", F.col("r.url").alias("url")).hint("merge"), "id", "left")
    return rows.select("id", answered.alias("answered"), F.when(F.col("similarity") >= 0.4, F.col("url")).otherwise("").alias("our_url"))


def page_match(theirs: DataFrame, mine: DataFrame, least: float = 0.34) -> DataFrame:
    """The nearest of our pages (id, words) for each of theirs, if it is near enough: ``l, r, similarity``."""
    from plumbline.operators.similarity import nearest

    return nearest(theirs, mine, least)


# Headings that are furniture, and words that do not tell sections apart.
FURNITURE = r"(?i)^(contact|contact us|about|about us|menu|navigation|related (posts|articles)|share|share this|comments?|leave a (reply|comment)|footer|newsletter|subscribe|table of contents|search|categories|tags|recent posts|follow us|quick links|resources|faq|faqs|frequently asked questions|conclusion|introduction|overview|summary|read more|you may also like|popular posts)$"
FILLER = ("the", "and", "for", "with", "how", "what", "why", "when", "who", "your", "you", "are", "is", "to", "of", "a", "an", "in", "on", "do", "does", "can", "should")


def missing_sections(pairs: DataFrame, theirs: DataFrame, ours: DataFrame, most: int = 8) -> DataFrame:
    """Sections that their page has and the matched page of ours lacks: ``theirs, ours, place, section``; pages that lack two or more.

    ``pairs``: theirs, ours, topic (the titles and H1s of both); ``theirs`` / ``ours``: page, place, heading.  Words of the topic do not count; where
    nothing else is left, headings must be nearly the same.
    """
    from plumbline.operators.similarity import title_words

    words = lambda c: F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    topic = F.filter(words(F.col("topic")), lambda w: F.length(w) > 2)
    bare = lambda c: F.filter(words(c), lambda w: (w != "") & ~F.array_contains(F.col("about"), w) & ~w.isin(*FILLER))
    alike = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    good = F.length("heading").between(4, 100) & ~F.col("heading").rlike(FURNITURE)
    base = pairs.select("theirs", "ours", topic.alias("about"))
    left = base.join(theirs.where(good).select(F.col("page").alias("theirs"), "place", "heading").hint("merge"), "theirs")
    lists = ours.groupBy(F.col("page").alias("ours")).agg(F.collect_list("heading").alias("have"))  # the headings of one page
    rows = left.join(lists.hint("merge"), "ours", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    mine = bare(F.col("heading"))
    content = lambda a: F.filter(F.array_distinct(a), lambda w: (F.length(w) > 1) & ~w.isin("the", "and"))
    same = F.exists("have", lambda h: F.when((F.size(mine) == 0) | (F.size(bare(h)) == 0), alike(title_words(F.col("heading")), title_words(h)) >= 0.8).otherwise(alike(content(mine), content(bare(h))) >= 0.45))
    lacking = rows.where(~same).withColumn("n", F.row_number().over(Window.partitionBy("theirs", "ours").orderBy("place"))).where(F.col("n") <= most)
    return lacking.withColumn("all", F.count("*").over(Window.partitionBy("theirs", "ours"))).where("all >= 2").select("theirs", "ours", F.col("n").cast("long").alias("place"), F.col("heading").alias("section"))


def page_groups(unmatched: DataFrame, least: float = 0.5) -> DataFrame:
    """Competitors' pages (site_id, ord, title, words) by topic: ``site_id, ord, leader``; the longest page so far speaks for its group."""
    from plumbline.operators.similarity import title_words

    return leader_groups(unmatched.select("site_id", "ord", set_key(title_words("title")).alias("set"), F.col("words").alias("size")), least)


def missing_pages(unmatched: DataFrame, groups: DataFrame) -> DataFrame:
    """Topics that competitors have a page on and we have none: ``site_id, leader, competitors, words, url, title``.

    ``unmatched``: site_id, ord, competitor, url, title, words.  The longest page speaks for its group.
    """
    rows = unmatched.join(groups.hint("merge"), ["site_id", "ord"])
    longest = F.max_by(F.struct("url", "title"), F.struct("words", -F.col("ord")))
    out = rows.groupBy("site_id", "leader").agg(F.count_distinct("competitor").alias("competitors"), F.max("words").alias("words"), longest.alias("p"))
    return out.select("site_id", "leader", "competitors", "words", "p.url", "p.title")


def outline_hints(headings: DataFrame, topics: DataFrame, most: int = 10) -> DataFrame:
    """Headings of pages like a topic, mutually distinct, in order: ``topic, place, heading``.

    ``headings``: page, title, ord, heading; ``topics``: topic.  Pages are found by shared title words; their headings go by page and place, and one that is like an earlier kept one is left out.
    """
    from plumbline.operators.similarity import overlaps, title_words

    pages = headings.select("page", "title").distinct().select(F.col("page").alias("id"), title_words("title").alias("words"))
    near = overlaps(topics.select(F.col("topic").alias("id"), title_words("topic").alias("words")), pages).where("similarity >= 0.3")
    good = F.length("heading").between(4, 100) & ~F.col("heading").rlike(FURNITURE)
    rows = near.select(F.col("l").alias("topic"), F.col("r").alias("page")).join(headings.where(good).select("page", "ord", "heading").hint("merge"), "page")
    listed = rows.select(F.col("topic").alias("site_id"), F.struct("page", "ord", "heading").alias("id")).distinct()
    none = listed.select("site_id", F.lit("").alias("set")).limit(0)
    kept = kept_in_order(listed.select("site_id", "id", F.lit(0).alias("ord"), set_key(title_words(F.col("id.heading"))).alias("set"), F.lit("").alias("label")), none, 0.6).where("kept")
    kept = kept.select(F.col("site_id").alias("topic"), "id.heading", F.row_number().over(Window.partitionBy("site_id").orderBy("id")).cast("long").alias("place"))
    return kept.where(F.col("place") <= most).select("topic", "place", "heading")


def keyword_ideas(phrases: DataFrame, related: DataFrame, asked: DataFrame, seeds: DataFrame) -> DataFrame:
    """Phrases of competitors' pages, related searches and asked questions (text each), one for each wording, without the seeds: ``key, text, sources``."""
    parts = [df.select(F.col("text"), F.lit(name).alias("source")) for name, df in (("competitors", phrases), ("related", related), ("questions", asked))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("key", norm_question("text")).where("key <> ''")
    out = rows.groupBy("key").agg(F.min("text").alias("text"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return out.join(seeds.select(norm_question("text").alias("key")).distinct(), "key", "left_anti")


def phrase_targeting(phrases: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether a site's pages target each phrase: yes if title and H1 hold all its words, partial if the text holds it as whole words, else no.

    ``phrases``: site_id, phrase; ``pages``: site_id, page_id, title, h1, body.  A phrase is joined on its rarest word in the site only.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    held = pages.select("site_id", "page_id", words(F.concat_ws(" ", "title", "h1")).alias("top"), F.concat(F.lit(" "), F.regexp_replace(F.lower("body"), r"[^\p{L}\p{N}]+", " "), F.lit(" ")).alias("body"), words(F.concat_ws(" ", "title", "h1", "body")).alias("all"))
    index = held.select("site_id", "page_id", F.explode("all").alias("word"))
    often = index.groupBy("site_id", "word").agg(F.count("*").alias("df"))
    asked = phrases.select("site_id", "phrase", words(F.col("phrase")).alias("need")).distinct()
    each = asked.select("site_id", "phrase", F.explode("need").alias("word")).join(often.hint("merge"), ["site_id", "word"], "left")
    rare = each.groupBy("site_id", "phrase").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    near = rare.join(index.hint("merge"), ["site_id", "word"]).join(held.hint("merge"), ["site_id", "page_id"]).join(asked.hint("merge"), ["site_id", "phrase"])
    level = F.when(F.size(F.array_except("need", "top")) == 0, 2).when(F.contains("body", F.concat(F.lit(" "), F.regexp_replace(F.lower("phrase"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))), 1).otherwise(0)
    found = near.groupBy("site_id", "phrase").agg(F.max(level).alias("level"))
    rows = asked.join(found.hint("merge"), ["site_id", "phrase"], "left")
    return rows.select("site_id", "phrase", F.when(F.col("level") == 2, "yes").when(F.col("level") == 1, "partial").otherwise("no").alias("targeted"))


def keyword_placement(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Pages whose top query (page_key, query) is missing from title, H1 or the first 100 words: ``page_key, query, in_title, in_h1, in_start``.

    ``pages``: page_key, title, h1, body.  A word counts if one of the text begins with it or it with one of at least four letters; up to two
    words must all be there, of more three quarters.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def holds(text: Column) -> Column:
        have, need = words(text), F.filter(words(F.col("query")), lambda w: F.length(w) > 2)
        hit = F.filter(need, lambda q: F.exists(have, lambda w: (w == q) | F.startswith(w, q) | ((F.length(w) >= 4) & F.startswith(q, w))))
        return (F.size(need) == 0) | F.when(F.size(need) <= 2, F.size(hit) == F.size(need)).otherwise(F.size(hit) >= F.ceil(F.size(need) * 0.75))

    start = F.array_join(F.slice(words(F.col("body")), 1, 100), " ")
    rows = queries.select("page_key", "query").join(pages.hint("merge"), "page_key").select("page_key", "query", holds(F.col("title")).alias("in_title"), holds(F.col("h1")).alias("in_h1"), holds(start).alias("in_start"))
    return rows.where("not (in_title and in_h1 and in_start)")


# What the hosts and anchors of outside links tell of their kind, hosts that are only share icons, and titles of pages that list resources.
DIRECTORY_HOSTS = ("directory", "listing", "yelp.com", "yellowpages", "g2.com", "capterra", "clutch.co", "crunchbase", "producthunt", "trustpilot", "bbb.org", "angi.com", "houzz.com", "manta.com", "foursquare.com")
ASSOCIATION_HOSTS = ("association", "chamber", "institute", "society", "alliance", "federation", "foundation")
PUBLICATION_HOSTS = ("news", "times", "journal", "magazine", "press", "tribune", "gazette", "herald", "blog")
PARTNER_ANCHORS = ("partner", "client", "powered by", "trusted by", "integration", "certified", "member")
RESOURCE_TITLES = ("resource", "resources", "useful link", "link page", "partners", "tools we use", "recommended", "our partners")
ICON_HOSTS = ("facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "whatsapp.com", "google.com", "apple.com", "play.google.com", "apps.apple.com")


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    # the text is made once, not for each word
    return let(text, lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))


def anchor_type(anchor: Column) -> Column:
    return F.when(holds_any(F.lower(F.coalesce(anchor, F.lit(""))), PARTNER_ANCHORS), "Partner mention").otherwise("Other")


def destination_type(host: Column, anchor: Column) -> Column:
    """Kind of a linked site: by its host, else by the words of the link."""
    published = F.endswith(host, F.lit(".org")) | holds_any(host, (*ASSOCIATION_HOSTS, *PUBLICATION_HOSTS))
    return F.when(holds_any(host, DIRECTORY_HOSTS), "Directory").when(published, "Association/Publication").otherwise(anchor_type(anchor))


def backlink_domains(links: DataFrame) -> DataFrame:
    """Outside hosts that a site's pages link to: ``site_id, host, type, pages, resource_mentions, examples`` (the first 3).

    ``links``: site_id, page_ord, page, title, h1, link_ord, target, anchor; links within the page's own host and share icons are left out.  The first
    link decides the type; a mention on a page whose title or H1 promises resources counts as such.
    """
    listed = holds_any(F.lower(F.concat_ws(" ", "title", "h1")), RESOURCE_TITLES)
    # hosts are read once and written: what follows names them often
    rows = _cut(links.select("site_id", "page_ord", "link_ord", "target", "anchor", host_of("target").alias("host"), listed.alias("listed"), host_of("page").alias("own"))).where("host <> own")
    per = rows.groupBy("site_id", "host", "page_ord").agg(F.count_if("listed").alias("mentions"))
    sums = per.groupBy("site_id", "host").agg(F.count("*").alias("pages"), F.sum("mentions").cast("long").alias("resource_mentions"))
    # the first three of each task, then of all: nothing sorts a whole host
    order = Window.partitionBy("site_id", "host").orderBy("page_ord", "link_ord", "target", anchor_type(F.col("anchor")), "anchor")
    first = rows.select("site_id", "host", "page_ord", "link_ord", "target", "anchor").withColumn("n", F.row_number().over(order)).where("n <= 3")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "target"))), lambda e: e["target"]), " ")
    told = first.groupBy("site_id", "host").agg(F.max(F.when(F.col("n") == 1, F.col("anchor"))).alias("anchor"), shown.alias("examples"))
    out = sums.join(told.hint("merge"), ["site_id", "host"]).where(~holds_any(F.col("host"), ICON_HOSTS))
    return out.select("site_id", "host", destination_type(F.col("host"), F.col("anchor")).alias("type"), "pages", "resource_mentions", "examples")


def slots(topics: DataFrame, days: DataFrame, taken: DataFrame) -> DataFrame:
    """The i-th topic (site_id, topic, place) of a site on its i-th free day: ``site_id, topic, day``.  ``days``: day, one calendar; ``taken``: site_id, day."""
    calendar = days.select("day").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))
    ordered = topics.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("place", "topic")))
    busy = taken.select("site_id", "day").join(calendar.hint("merge"), "day").select("site_id", "n")
    rows = ordered.drop("place").join(free_places(ordered.select("site_id", "n"), busy).hint("merge"), ["site_id", "n"])
    return rows.select("site_id", "topic", F.col("place").cast("int").alias("n")).join(calendar.hint("merge"), "n").select("site_id", "topic", "day")


def comparison(pages: DataFrame, inbound: DataFrame, flags: DataFrame) -> DataFrame:
    """What sites are compared by: ``site_id, pages, avg_words, schema_types, orphan_percent, aeo_score, geo_score``.

    ``pages``: site_id, page, is_start, word_count, schema_types (of a page); ``inbound``: site_id, dst, the pages that some other page of the site links to;
    ``flags``: site_id, aeo_score, geo_score.  An orphan is a page, not the start, that no other one links to.
    """
    linked = inbound.select("site_id", F.col("dst").alias("page")).distinct().withColumn("linked", F.lit(True))
    rows = pages.join(linked.hint("merge"), ["site_id", "page"], "left").withColumn("orphan", F.col("linked").isNull() & ~F.col("is_start"))
    types = pages.select("site_id", F.explode("schema_types").alias("t")).distinct().groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("schema_types"))
    sums = rows.groupBy("site_id").agg(F.count("*").alias("pages"), rounded(F.avg("word_count")).cast("long").alias("avg_words"), rounded(F.avg(F.when(F.col("orphan"), 100.0).otherwise(0.0))).cast("long").alias("orphan_percent"))
    out = sums.join(types.hint("merge"), "site_id", "left").join(flags.hint("merge"), "site_id", "left")
    return out.select("site_id", "pages", "avg_words", F.coalesce("schema_types", F.lit("")).alias("schema_types"), "orphan_percent", "aeo_score", "geo_score")


def compared(sites: DataFrame, ours: str) -> DataFrame:
    """Every other site of a comparison beside our own: ``site_id, measure, ours, theirs``."""
    names = ["pages", "avg_words", "orphan_percent", "aeo_score", "geo_score"]
    long = sites.unpivot(["site_id"], [F.col(n).cast("long").alias(n) for n in names], "measure", "value")
    own = long.where(F.col("site_id") == ours).select("measure", F.col("value").alias("ours"))
    return long.where(F.col("site_id") != ours).join(own.hint("merge"), "measure").select("site_id", "measure", "ours", F.col("value").alias("theirs"))
