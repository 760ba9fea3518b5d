"""Target-market findings and local-business checks on page records with structured-data facts.

The market profiles are a table of the caller: country, code, languages, currencies, dial.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import normalize_url
from plumbline.operators.keywords import phones, same_phone
from plumbline.operators.structured import faq_questions, structured_facts  # noqa: F401  the facts that this module's operators read

# --- market -----------------------------------------------------------------------------------


def _primary(x: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(x)), "[-_]"), 1)


def lang_fit(lang: Column, languages: Column) -> Column:
    """fits, mismatch, or unknown without a language."""
    blank = F.trim(F.coalesce(lang, F.lit(""))) == ""
    return F.when(blank, "unknown").when(F.array_contains(languages, _primary(lang)) | ((_primary(lang) == "no") & F.array_contains(languages, "nb")), "fits").otherwise("mismatch")


def hreflang_ok(code: Column) -> Column:
    return F.trim(code).rlike("^(?i:x-default)$|^[a-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?$")


def hreflang_relation(value: Column, languages: Column, code: Column) -> Column:
    """x-default, exact, region-only, language or other."""
    v = F.lower(F.trim(value))
    lang, region = F.array_contains(languages, _primary(v)), F.try_element_at(F.split(v, "[-_]"), F.lit(2)) == F.lower(code)
    return F.when(v == "x-default", "x-default").when(lang & region, "exact").when(region, "region-only").when(lang, "language").otherwise("other")


def country_match(said: Column, country: Column, code: Column) -> Column:
    s = F.lower(F.trim(said))
    return (s == F.lower(country)) | (s == F.lower(code)) | ((code == "GB") & s.isin("uk", "great britain")) | ((code == "US") & s.isin("usa", "united states of america"))


def normalize_country(rows: DataFrame, raw: str, profiles: DataFrame) -> DataFrame:
    """Rows with ``country``: a known country's name whatever its case in the column ``raw``, else Worldwide.  ``profiles``: the caller's table of countries."""
    known = profiles.select(F.lower("country").alias("_key"), F.col("country").alias("_name")).groupBy("_key").agg(F.min("_name").alias("_name"))
    out = rows.withColumn("_key", F.lower(F.trim(raw))).join(known.hint("merge"), "_key", "left")
    return out.withColumn("country", F.coalesce("_name", F.lit("Worldwide"))).drop("_key", "_name")


def market_findings(facts: DataFrame, sites: DataFrame, profiles: DataFrame) -> DataFrame:
    """Where a site and its market disagree: ``site_id, finding, severity, urls``.

    ``facts``: structured_facts with tel_links (array); ``sites``: site_id, country, start_url; sites without a known market give nothing.
    """
    market = sites.join(profiles.hint("merge"), "country")
    rows = facts.join(market.hint("merge"), "site_id").withColumn("fit", lang_fit(F.col("lang"), F.col("languages")))
    f = F.col("ld_facts")
    rows = rows.withColumns({"n_alt": F.size("hreflangs"), "codes": F.transform("hreflangs", lambda h: h["lang"])})
    dialled = F.filter(F.concat(F.transform("tel_links", lambda t: F.regexp_replace(t, r"[^0-9+]", "")), F.transform(f["telephones"], lambda t: F.regexp_replace(t, r"[^0-9+]", ""))), lambda d: d.startswith("+"))
    rows = rows.withColumns({"numbers": dialled, "own_numbers": F.filter(dialled, lambda d: F.startswith(F.substring(d, 2, 40), F.col("dial")))})

    def pages(name: str, test: Column, severity: Column | str) -> DataFrame:
        s = F.lit(severity) if isinstance(severity, str) else severity
        return rows.where(test).select("site_id", F.lit(name).alias("finding"), s.alias("severity"), "url")

    def site(name: str, test: Column, of: Column, severity: str, url: Column | None = None) -> DataFrame:
        """Findings that need all pages of a site to agree: ``test`` on the site's aggregates, the pages ``of`` as evidence."""
        good = whole.where(test).select("site_id")
        named = rows.where(of).join(good.hint("merge"), "site_id", "left_semi")
        return named.select("site_id", F.lit(name).alias("finding"), F.lit(severity).alias("severity"), (F.col("url") if url is None else url).alias("url")).distinct()

    relation = F.transform("codes", lambda c: hreflang_relation(c, F.col("languages"), F.col("code")))
    whole = rows.groupBy("site_id").agg(
        F.bool_or(F.exists(relation, lambda r: r.isin("exact", "region-only", "language"))).alias("covered"), F.bool_or(F.exists(f["countries"], lambda c: country_match(c, F.col("country"), F.col("code")))).alias("right_country"),
        F.bool_or(F.arrays_overlap(f["currencies"], "currencies")).alias("right_currency"), F.bool_or(F.size("own_numbers") > 0).alias("right_number"),
        F.bool_or((F.size(f["local_types"]) > 0) | f["has_address"] | (F.size("tel_links") > 0)).alias("local"), (F.count_if(F.col("fit") == "mismatch") / F.greatest(F.lit(1), F.count_if(F.col("fit") != "unknown"))).alias("share"),
    )
    wrong = rows.where("fit = 'mismatch'").join(whole.select("site_id", "share").hint("merge"), "site_id")
    parts = [
        wrong.select("site_id", F.lit("lang_mismatch").alias("finding"), F.when(F.col("share") >= 0.5, "Medium").otherwise("Low").alias("severity"), "url"),
        pages("lang_missing", F.col("fit") == "unknown", "Low"),
        pages("hreflang_invalid", F.exists("codes", lambda c: ~hreflang_ok(c)), "Medium"),
        pages("hreflang_relative", F.exists("hreflangs", lambda h: (h["href"] != "") & ~h["href"].rlike("(?i)^https?://")), "Medium"),
        pages("hreflang_no_self", (F.col("n_alt") > 0) & ~F.exists("hreflangs", lambda h: normalize_url(h["href"]) == normalize_url("url")), "Medium"),
        pages("hreflang_no_default", (F.col("n_alt") >= 2) & ~F.exists("codes", lambda c: F.lower(c) == "x-default"), "Low"),
        site("hreflang_market_missing", ~F.col("covered"), F.col("n_alt") > 0, "Medium"),
        site("schema_country", ~F.col("right_country"), F.size(f["countries"]) > 0, "Medium"),
        site("schema_currency", ~F.col("right_currency"), F.size(f["currencies"]) > 0, "Low"),
        site("phone_country", ~F.col("right_number"), F.size("numbers") > 0, "Low"),
        site("no_local_signals", ~F.col("local"), F.lit(True), "Low", F.col("start_url")),
    ]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("site_id", "finding").agg(F.min("severity").alias("severity"), F.count_distinct("url").alias("urls"), F.array_join(F.slice(F.array_sort(F.collect_set("url")), 1, 25), " ").alias("evidence"))


# --- local business ------------------------------------------------------------------------------

_SMALL = ("the", "and", "ltd", "limited", "inc", "llc", "co", "company", "road", "rd", "street", "st", "avenue", "ave", "floor", "building", "plaza", "house", "box", "po")


def mentions(hay: Column, needle: Column, share: float = 0.7) -> Column:
    """Whether most of the telling words of a name or address are in a text."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    need = F.slice(F.array_distinct(F.filter(words(needle), lambda w: ((F.length(w) > 2) | w.rlike("^[0-9]+$")) & ~w.isin(*_SMALL))), 1, 8)
    return (F.size(need) > 0) & (F.size(F.array_intersect(need, words(hay))) >= F.size(need) * share)


def local_checks(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Checks of each site with a local profile: ``site_id, check, status`` (pass, warn, fail, unknown).

    ``pages``: structured facts with url, is_start, page_type, contact_text, tel_links; ``profiles``: site_id, name, address, phone.
    """
    f = F.col("ld_facts")
    text = F.concat_ws(" ", "body_text", "contact_text", F.array_join(f["names"], " "), F.array_join(f["streets"], " "))
    shown = F.concat(phones("body_text"), F.col("tel_links"), f["telephones"])
    rows = pages.join(profiles.hint("merge"), "site_id").withColumns({"said": text, "shown": shown})
    key = F.col("is_start") | (F.col("page_type") == "contact")
    own = F.exists("shown", lambda p: same_phone(p, F.col("phone")))
    other = F.exists("shown", lambda p: ~same_phone(p, F.col("phone")))
    complete = (F.size(f["local_types"]) > 0) & (F.size(f["names"]) > 0) & f["has_address"] & (F.size(f["telephones"]) > 0) & f["has_hours"]
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    site = rows.groupBy("site_id").agg(
        any_(key & mentions(F.col("said"), F.col("name"))).alias("ok_name"), any_(key & mentions(F.col("said"), F.col("address"))).alias("ok_address"), any_(key & own).alias("ok_phone"), any_(other).alias("others"),
        any_(F.size("tel_links") > 0).alias("tel"), any_(F.size(f["local_types"]) > 0).alias("local"), any_(complete).alias("complete"),
        any_(F.col("html").rlike(r"(?i)google\.[a-z.]+/maps|maps\.app\.goo\.gl|openstreetmap\.org")).alias("map"), any_(F.col("html").rlike(r"(?i)g\.page/|/writereview|trustpilot\.com/review|tripadvisor\.")).alias("review"),
        F.max(F.coalesce("address", F.lit(""))).alias("given_address"), F.max(F.coalesce("phone", F.lit(""))).alias("given_phone"),
    )
    ok = lambda c, bad: F.when(c, "pass").otherwise(bad)
    checks = {
        "name": ok(F.col("ok_name"), "fail"), "address": F.when(F.col("given_address") == "", "unknown").otherwise(ok(F.col("ok_address"), "fail")), "phone": F.when(F.col("given_phone") == "", "unknown").otherwise(ok(F.col("ok_phone"), "fail")),
        "other_phones": ok(~F.col("others"), "warn"), "tel_links": ok(F.col("tel"), "warn"), "schema": F.when(F.col("complete"), "pass").when(F.col("local"), "warn").otherwise("fail"), "map": ok(F.col("map"), "warn"), "reviews": ok(F.col("review"), "warn"),
    }
    return site.select("site_id", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()])).alias("c")).select("site_id", "c.*")


def area_coverage(pages: DataFrame, areas: DataFrame) -> DataFrame:
    """Whether each area (site_id, area) of a site has a page of its own, a mention or nothing: ``site_id, area, status``."""
    rows = areas.join(pages.select("site_id", "url", "title", "h1_text", "body_text").hint("merge"), "site_id", "left")
    head = F.concat_ws(" ", "title", "h1_text", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(.*)$", 1), "[-_/]+", " "))
    level = F.when(mentions(head, F.col("area"), 1.0), 2).when(F.contains(F.lower("body_text"), F.lower("area")), 1).otherwise(0)
    out = rows.groupBy("site_id", "area").agg(F.max(level).alias("level"))
    return out.select("site_id", "area", F.when(F.col("level") == 2, "page").when(F.col("level") == 1, "mention").otherwise("none").alias("status"))


def local_prefill(pages: DataFrame) -> DataFrame:
    """What the first page with local markup says (start pages first, then page order): ``site_id, name, phone, street, locality``."""
    f = F.col("ld_facts")
    one = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    order = Window.partitionBy("site_id").orderBy(F.desc("is_start"), "page_id")
    rows = pages.where(F.size(f["local_types"]) > 0).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select("site_id", one(f["names"]).alias("name"), one(f["telephones"]).alias("phone"), one(f["streets"]).alias("street"), one(f["localities"]).alias("locality"))

