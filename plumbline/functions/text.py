"""Column expressions for URLs, text keys and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rough click-through rate by position, used only where a site has too little data of its own (fixed values).
GENERIC_CTR = {1: 0.28, 2: 0.15, 3: 0.1, 4: 0.07, 5: 0.055, 6: 0.045, 7: 0.035, 8: 0.03, 9: 0.025, 10: 0.02}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, places: int = 0) -> Column:
    """Round half up by ``floor(x + 0.5)``, the same in every engine."""
    scale = 10**places
    return F.floor(col(x) * F.lit(float(scale)) + F.lit(0.5)).cast("double") / F.lit(float(scale))


def scaled(n: int, days: int) -> int:
    """A threshold written for 28 days, for a report of ``days``."""
    return max(1, int(n * days / 28 + 0.5))


def host_of(url: Column | str) -> Column:
    """Lower-cased host without ``www.``; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(col(url))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)


def page_key(url: Column | str) -> Column:
    """Identity of a page: no protocol, ``www.``, trailing slash or fragment; the query string stays."""
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(col(url), r"(\?[^#]*)", 1)
    bare = F.regexp_replace(path, r"/+$", "")
    return F.concat(host_of(url), F.when(bare == "", F.lit("/")).otherwise(bare), query)


def url_key(url: Column | str) -> Column:
    """Like ``page_key`` without the query string."""
    return F.regexp_replace(page_key(url), r"\?.*$", "")


def normalize_url(url: Column | str) -> Column:
    """Protocol and host in lower case, no fragment, no trailing slash except at the root."""
    head = F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rest = F.regexp_replace(rest, r"/+$", "")
    return F.concat(head, F.when(rest == "", F.lit("/")).otherwise(rest))


def slug(x: Column | str, size: int = 60) -> Column:
    s = F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, size)


def title_key(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def word_set(x: Column | str) -> Column:
    """Distinct words of three or more ASCII letters, digits or apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(x)), F.lit("[a-z0-9']{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences."""
    return F.when(F.length(needle) > 0, (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).otherwise(0).cast("long")


def generic_ctr(position: Column) -> Column:
    at = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(position + 0.5)))
    return F.element_at(F.create_map(*[F.lit(x) for k, v in GENERIC_CTR.items() for x in (k, v)]), at.cast("int"))


def priority_for(gain: Column, days: int) -> Column:
    return F.when(gain >= scaled(100, days), "High").when(gain >= scaled(30, days), "Medium").otherwise("Low")


def bonus(gain: Column, days: int) -> Column:
    return F.least(F.lit(10), F.ceil(gain / scaled(20, days))).cast("long")


PRIORITIES = ("Critical", "High", "Medium", "Low")


def priority_rank(p: Column | str) -> Column:
    out = F.lit(len(PRIORITIES))
    for k, name in enumerate(PRIORITIES):
        out = F.when(col(p) == name, k).otherwise(out)
    return out
