"""Weighted phrases, site keywords and their audit, entities and phone numbers.  Everything is kept apart by ``site_id``."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.html import let
from plumbline.functions.text import occurrences, rounded

# Words at which no phrase begins or ends, words that tell intent, weights of fields and of placements.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "so", "of", "to", "in", "on", "for", "with", "at", "by", "from",
    "up", "down", "out", "about", "into", "over", "after", "is", "are", "was", "were", "be", "been", "being", "this",
    "that", "these", "those", "it", "its", "as", "we", "you", "your", "our", "us", "i", "they", "he", "she", "them",
    "his", "her", "their", "not", "no", "yes", "can", "will", "would", "should", "could", "may", "might", "must",
    "do", "does", "did", "have", "has", "had", "also", "just", "than", "too", "very", "more", "most", "some", "any",
    "all", "each", "other", "such", "only", "own", "same", "s", "t", "don", "now", "here", "there", "when",
    "where", "why", "how", "what", "which", "who", "whom", "get", "got", "using", "use", "used", "new",
)
STOPWORD_SET = frozenset(STOPWORDS)
QUESTIONS = ("what", "how", "why", "where", "which", "who", "when", "is", "are", "can", "does", "do", "should", "will")
COMMERCIAL = ("price", "pricing", "cost", "cheap", "affordable", "discount", "deal", "buy", "order", "quote", "plan", "plans", "package", "packages")
TRANSACTIONAL = ("buy", "order", "purchase", "sign up", "signup", "get started", "book", "hire", "request demo", "free trial", "subscribe")
LOCAL = ("near me", "in kenya", "nairobi", "location", "branch", "locations", "service area", "delivery area")
NAVIGATIONAL = ("login", "log in", "sign in", "dashboard", "careers", "contact us")
FIELDS = {"title": 6, "h1": 5, "h2h3": 3, "description": 2, "alt": 2, "body": 1}
PLACEMENT = {"title": 30, "h1": 25, "description": 15, "h2h3": 15, "schema": 10, "alt": 5}


def tokens(text: Column | str) -> Column:
    low = F.regexp_replace(F.lower(text), r"[^a-z0-9\s'-]", " ")
    return F.filter(F.split(low, r"\s+"), lambda w: w != "")


def ngrams(words: Column, most: int = 3) -> Column:
    """Phrases of one to ``most`` words that neither begin nor end with a stop word or a single character."""
    edge = lambda w: ~w.isin(*STOPWORDS) & (F.length(w) >= 2)

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        good = F.filter(starts, lambda i: edge(F.element_at(words, i)) & edge(F.element_at(words, i + (n - 1))))
        return F.transform(good, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    parts = [of(n) for n in range(1, most + 1)]
    return F.filter(F.flatten(F.array(*parts)), lambda p: F.length(p) >= 3)


def page_fields(records: DataFrame, body: str = "full_text") -> DataFrame:
    """The fields of page records that phrases are counted in; ``body`` names the text, ``body_text`` being the whole one."""
    two = F.slice(F.filter("h2s", lambda x: x != ""), 1, 6)
    three = F.slice(F.filter("h3s", lambda x: x != ""), 1, 10)
    return records.select(
        "site_id", "page_id", "url", "title", F.col("h1_text").alias("h1"), F.array_join(F.concat(two, three), " . ").alias("h2h3"), "description",
        F.array_join("alts", " . ").alias("alt"), F.col(body).alias("body"), F.lower(F.array_join("schema_types", " ")).alias("schema"),
    )


def _best_phrases(fields: dict[str, str | None], most: int) -> list[tuple[str, int]]:
    """The ``most`` phrases of one page (fields in lower case) with the highest sum of weights, ties to the smaller: the rule of ``tokens`` and ``ngrams``."""
    score: dict[str, int] = {}
    for field, weight in FIELDS.items():
        words = re.findall("[a-z0-9'-]+", fields[field] or "")
        edge = [len(w) >= 2 and w not in STOPWORD_SET for w in words]
        phrases = [w for w, e in zip(words, edge) if e and len(w) >= 3]
        phrases += [f"{a} {b}" for a, b, e, f in zip(words, words[1:], edge, edge[1:]) if e and f]
        phrases += [f"{a} {b} {c}" for a, b, c, e, f in zip(words, words[1:], words[2:], edge, edge[2:]) if e and f]
        for phrase, times in Counter(phrases).items():
            score[phrase] = score.get(phrase, 0) + weight * times
    if len(score) > most:
        least = heapq.nlargest(most, score.values())[-1]
        score = {p: s for p, s in score.items() if s >= least}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:most]


def candidates(rows: DataFrame, most: int = 25) -> DataFrame:
    """The best phrases of each page with score and usage.  Input: site_id, page_id (one row each), FIELDS and schema.

    Phrases are scored over all fields, the best ``most`` of a page are taken, and only then those that no field holds
    are dropped.  A page is counted in its own row, so nothing is shuffled.
    """
    keys, flags = ["site_id", "page_id"], [f for f in (*FIELDS, "schema") if f != "body"]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = {f: batch[f].to_pylist() for f in (*flags, "body")}
            row, phrases, scores, body, held = [], [], [], [], {f: [] for f in flags}
            for k in range(batch.num_rows):
                page = {f: texts[f][k] for f in texts}
                for phrase, score in _best_phrases(page, most):
                    inside = {f: None if page[f] is None else phrase in page[f] for f in flags}
                    times = None if page["body"] is None else page["body"].count(phrase)
                    if times or any(inside[f] for f in flags if f not in ("description", "schema")):
                        row.append(k)
                        phrases.append(phrase)
                        scores.append(score)
                        body.append(times)
                        for f in flags:
                            held[f].append(inside[f])
            at = pa.array(row, pa.int64())
            columns = [*(batch[c].take(at) for c in keys), pa.array(phrases, pa.string()), pa.array(scores, pa.int64()), *(pa.array(held[f], pa.bool_()) for f in flags), pa.array(body, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "phrase", "score", *(f"in_{f}" for f in flags), "in_body"])

    used = rows.select(*keys, *[F.lower(f).alias(f) for f in (*FIELDS, "schema")])
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys]
    return used.mapInArrow(pages, ", ".join([*kinds, "phrase string", "score long", *(f"in_{f} boolean" for f in flags), "in_body long"]))


def _has(p: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(p, w))


def _asks(p: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in QUESTIONS]), lambda w: F.startswith(p, F.concat(w, F.lit(" "))))


def intent(phrase: Column | str) -> Column:
    p = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.when(_asks(p), "Informational").when(_has(p, TRANSACTIONAL), "Transactional").when(_has(p, COMMERCIAL), "Commercial").when(_has(p, NAVIGATIONAL), "Navigational").when(_has(p, LOCAL), "Commercial").otherwise("Informational")


def kind(phrase: Column | str) -> Column:
    p = F.col(phrase) if isinstance(phrase, str) else phrase
    n = F.size(F.split(p, " "))
    return F.when(_asks(p), "Question").when(_has(p, LOCAL), "Local").when(_has(p, TRANSACTIONAL), "Transactional").when(_has(p, COMMERCIAL), "Commercial").when(n == 1, "Primary").when(n == 2, "Secondary").otherwise("Long-tail")


USES = ("title", "description", "h1", "h2h3", "alt", "schema")


def site_keywords(cands: DataFrame, most: int = 24) -> DataFrame:
    """The best ``most`` phrases of each site by summed score, with relevance in percent of the site's best and usage counts."""
    rows = cands.groupBy("site_id", "phrase").agg(
        F.sum("score").cast("long").alias("score"), F.count("*").alias("pages"), *[F.count_if(f"in_{u}").alias(f"n_{u}") for u in USES], F.sum("in_body").cast("long").alias("n_body")
    )
    site = Window.partitionBy("site_id")
    rows = rows.withColumn("place", F.row_number().over(site.orderBy(F.desc("score"), "phrase"))).where(F.col("place") <= most)
    relevance = rounded(F.least(F.lit(100.0), F.col("score") * 100.0 / F.max("score").over(site))).cast("long")
    occurs = sum((F.when(F.col(f"n_{u}") > 0, 1).otherwise(0) for u in USES), F.lit(0)) + F.col("n_body")
    return rows.select("site_id", "phrase", "score", "pages", *[f"n_{u}" for u in USES], "n_body", relevance.alias("relevance"), occurs.cast("long").alias("occurs"), kind("phrase").alias("kind"), intent("phrase").alias("intent"))


def keyword_audit(keywords: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Placement score, status and flags of each site keyword.  ``site_pages``: site_id, site_pages."""
    rows = keywords.join(site_pages.hint("merge"), "site_id")
    rows = rows.withColumn("placement", sum((F.when(F.col(f"n_{u}") > 0, w).otherwise(0) for u, w in PLACEMENT.items()), F.lit(0)).cast("long"))
    flags = F.array_compact(F.array(
        F.when(F.col("n_title") == 0, "no title"), F.when(F.col("n_h1") == 0, "no h1"), F.when(F.col("n_description") == 0, "no description"), F.when((F.col("placement") == 0) & (F.col("n_body") > 0), "body only"),
        F.when((F.col("relevance") >= 60) & (F.col("pages") <= 1) & (F.col("site_pages") > 1), "one page"), F.when((F.col("n_body") >= 8) & (F.col("placement") < 30), "stuffing"),
    ))
    status = F.when(F.col("placement") >= 55, "Strong").when(F.col("placement") >= 25, "Weak").otherwise("Poor")
    return rows.select("site_id", "phrase", "relevance", "placement", status.alias("status"), F.array_join(flags, ",").alias("flags"))


def keyword_priority(audit: DataFrame) -> DataFrame:
    """What to mend first: poor and relevant is Critical, poor or weak and relevant High, weak Medium, else Low."""
    relevant = F.col("relevance") >= 70
    rank = F.when((F.col("status") == "Poor") & relevant, "Critical").when((F.col("status") == "Poor") | ((F.col("status") == "Weak") & relevant), "High").when(F.col("status") == "Weak", "Medium").otherwise("Low")
    return audit.withColumn("priority", rank)


def keyword_score(audit: DataFrame, cannibals: DataFrame) -> DataFrame:
    """Relevance-weighted placement of each site less up to 20 for cannibalised clusters (``site_id``, one row each)."""
    weight = F.greatest(F.lit(1), F.col("relevance"))
    rows = audit.groupBy("site_id").agg(F.count("*").alias("keywords"), (F.sum(F.col("placement") * weight) / F.sum(weight)).alias("base"))
    lost = cannibals.groupBy("site_id").agg(F.count("*").alias("n"))
    rows = rows.join(lost.hint("merge"), "site_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = rounded(F.col("base") - F.least(F.lit(20), F.col("n") * 5))
    return rows.select("site_id", "keywords", F.col("n").alias("cannibals"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).cast("long").alias("score"))


#: The border of a word of ASCII letters, digits and underscores.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
ENTITY = EDGE + r"([A-Z][a-zA-Z0-9&']*(?:\s+[A-Z][a-zA-Z0-9&']*){0,3})" + EDGE


def entity_candidates(rows: DataFrame, key: str, text: str, most: int = 25) -> DataFrame:
    """Runs of one to four capitalised words of each row, the ``most`` commonest: ``site_id, key, entity, times``."""
    found = rows.select("site_id", key, F.explode(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(1))).alias("entity"))
    words = F.split("entity", r"\s+")
    found = found.where(((F.size(words) > 1) | (F.length("entity") >= 3)) & ~F.lower("entity").isin(*STOPWORDS))
    counted = found.groupBy("site_id", key, "entity").agg(F.count("*").alias("times"))
    order = Window.partitionBy("site_id", key).orderBy(F.desc("times"), "entity")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def site_entities(cands: DataFrame, most: int = 20) -> DataFrame:
    """The commonest entities of each site: ``site_id, entity, times``."""
    rows = cands.groupBy("site_id", "entity").agg(F.sum("times").cast("long").alias("times"))
    order = Window.partitionBy("site_id").orderBy(F.desc("times"), "entity")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def phones(text: Column | str, most: int = 8) -> Column:
    """Phone-like numbers of 9 to 15 digits, dates left out, distinct by their last nine digits, in order."""
    raw = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"(?:\+|00)?[0-9][0-9\s().-]{7,18}[0-9]"), F.lit(0))
    kept = F.filter(raw, lambda x: F.length(digits(x)).between(9, 15) & ~F.trim(x).rlike(r"^(19|20)[0-9]{2}[-/.\s]?[0-9]{1,2}[-/.\s]?[0-9]{1,2}$"))
    last = lambda x: F.substring(digits(x), -9, 9)
    shown = lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 24)
    first = let(kept, lambda k: let(F.transform(k, last), lambda same: F.filter(F.transform(k, lambda x, i: F.when(F.array_position(same, last(x)) == i + 1, shown(x))), lambda x: x.isNotNull())))
    return F.slice(first, 1, most)


def same_phone(a: Column, b: Column) -> Column:
    """The last seven to nine digits agree."""
    n = F.least(F.lit(9), F.length(digits(a)), F.length(digits(b)))
    return (n >= 7) & (F.right(digits(a), n) == F.right(digits(b), n))


def other_phones(rows: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """The phone numbers of each site by how many pages show them: ``site_id, last9, pages, first_page``."""
    found = rows.select("site_id", key, F.explode(phones(text)).alias("phone")).withColumn("last9", F.substring(digits(F.col("phone")), -9, 9))
    counted = found.groupBy("site_id", "last9").agg(F.count_distinct(key).alias("pages"), F.min(key).alias("first_page"))
    order = Window.partitionBy("site_id").orderBy(F.desc("pages"), "last9")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def body_occurrences(rows: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Non-overlapping occurrences of given phrases over all rows: ``phrase, rows, times``."""
    low = F.lower(text)
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), occurrences(low, F.lit(p)).alias("n")) for p in phrases])).alias("x")).where("x.n > 0")
    return long.groupBy("x.phrase").agg(F.count("*").alias("rows"), F.sum("x.n").cast("long").alias("times"))
