"""Registered page queries and their SQL.

The SQL is written apart from the operators, in patterns that are plain enough for the markup of the given pages; the hand-made pages of
the tests hold what these do not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import host_of, page_key, path_of, slug, url_key
from plumbline.operators import pages as op
from plumbline.sources import driver_tables as src


def _r(spark, sf):
    return op.records(src.pages(spark, sf))


def extract_head(spark, sf):
    return op.head(_r(spark, sf))


def extract_headings(spark, sf):
    return op.headings(_r(spark, sf))


def extract_body(spark, sf):
    r = _r(spark, sf)
    return r.select("site_id", "page_id", "word_count", F.length("body_text").cast("long").alias("n_chars"), F.md5("body_text").alias("text_md5"), op.contact_text(r).alias("contact_text"))


def extract_links(spark, sf):
    return op.links(_r(spark, sf))


def extract_images(spark, sf):
    return _r(spark, sf).select("site_id", "page_id", "images", "images_missing_alt", F.array_join("missing_alt_srcs", " ").alias("missing_alt_srcs"))


def extract_quality(spark, sf):
    return op.quality(_r(spark, sf))


def extract_readable(spark, sf):
    return op.readable(_r(spark, sf)).select("site_id", "page_id", "title", "published", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def stack_markers(spark, sf):
    return op.stack_markers(_r(spark, sf))


def url_keys(spark, sf):
    return src.pages(spark, sf).select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), page_key("url").alias("page_key"), url_key("url").alias("url_key"), slug("url").alias("slug"))


def url_hygiene(spark, sf):
    return op.url_hygiene(_r(spark, sf))


def page_issues(spark, sf):
    return op.issues(_r(spark, sf)).drop("url")


def page_scores(spark, sf):
    r = _r(spark, sf)
    return op.scores(r, op.issues(r))


def site_scores(spark, sf):
    """With the sites' recurring issues as findings."""
    r = _r(spark, sf)
    found = op.issues(r)
    return op.site_scores(op.scores(r, found), op.recurring(found))


def duplicate_titles(spark, sf):
    return op.duplicates(_r(spark, sf), "title")


def duplicate_bodies(spark, sf):
    return op.duplicates(_r(spark, sf).withColumn("body_text", F.md5("body_text")), "body_text")


def recurring_issues(spark, sf):
    return op.recurring(op.issues(_r(spark, sf)))


def https_findings(spark, sf):
    return op.https_findings(src.pages(spark, sf))


def aeo_flags(spark, sf):
    return op.aeo_flags(_r(spark, sf))


def geo_flags(spark, sf):
    return op.geo_flags(_r(spark, sf))


def site_flags(spark, sf):
    return op.site_flags(op.aeo_flags(_r(spark, sf)))


def flag_scores(spark, sf):
    return op.both_scores(_r(spark, sf))


def weakest_pages(spark, sf):
    return op.weakest_pages(op.both_scores(_r(spark, sf)).select("site_id", "page_id", F.col("geo_score").alias("score")))


def page_types(spark, sf):
    r = _r(spark, sf)
    return r.select("site_id", "page_id", op.page_type(r).alias("page_type"))


def page_fixes(spark, sf):
    r = _r(spark, sf)
    return op.missing_flags(op.aeo_flags(r), op.AEO_WEIGHTS, r.select("page_id", op.page_type(r).alias("page_type")))


def market_language(spark, sf):
    return op.market_language(_r(spark, sf), ["en", "fr"])


def page_sample(spark, sf):
    """Three pages of each site."""
    r = _r(spark, sf)
    scored = op.both_scores(r).select("site_id", "page_id", F.col("geo_score").alias("score"))
    return op.page_sample(r.select("site_id", "page_id", (F.col("page_id") % 3 == 0).alias("is_home"), "word_count").join(scored.hint("merge"), ["site_id", "page_id"]), 3)


def temporary_redirects(spark, sf):
    """Pages that were reached by redirects of several kinds."""
    k = F.col("page_id")
    hops = F.transform(F.when(k % 5 == 0, F.array(F.lit(301), F.lit(302))).when(k % 5 == 1, F.array(F.lit(308))).when(k % 11 == 3, F.array(F.lit(307))).when(F.length("site_id") % 3 > 0, F.array().cast("array<int>")), lambda s: F.struct(s.alias("status")))
    return op.temporary_redirects(src.pages(spark, sf).select("site_id", hops.alias("redirects")))


QUERIES = {f.__name__: f for f in (
    page_sample, temporary_redirects,
    extract_head, extract_headings, extract_body, extract_links, extract_images, extract_quality, extract_readable, stack_markers, url_keys, url_hygiene, page_issues, page_scores, site_scores, duplicate_titles, duplicate_bodies,
    recurring_issues, https_findings, aeo_flags, geo_flags, site_flags, flag_scores, weakest_pages, page_types, page_fixes, market_language,
)}

HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '')"
_decode = lambda x: f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_tidy = lambda x: f"trim(regexp_replace({_decode(x)}, '\\s+', ' ', 'g'))"
_plain = lambda x: _tidy(f"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<script>.*?</script>|<style>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")
_inside = lambda tag: f"list_transform(regexp_extract_all(html, '(?s)<{tag}>(.*?)</{tag}>', 1), lambda x: {_tidy('regexp_replace(x, chr(60)||chr(91)||chr(94)||chr(62)||chr(93)||chr(42)||chr(62), chr(32), chr(103))')})"
_meta = lambda n: f"regexp_extract(html, '<meta name=\"{n}\" content=\"([^\"]*)\"', 1)"
REC = f"""rec as (select *, substr(body_text, 1, 4000) as full_text, case when body_text = '' then 0 else len(string_split(body_text, ' ')) end as word_count, coalesce(h1s[1], '') as h1_text,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin from (
  select page_id, url, html, {HOST} as site_id, {_plain("regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)</body>.*', '')")} as body_text, {_tidy("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as title,
  regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, {_meta('description')} as description, {_meta('robots')} as robots, {_meta('viewport')} as viewport, {_meta('generator')} as generator,
  regexp_extract_all(html, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1) as canonicals, {_inside('h1')} as h1s, {_inside('h2')} as h2s, {_inside('h3')} as h3s,
  list_transform(regexp_extract_all(html, '<h([1-6])>', 1), lambda x: cast(x as int)) as levels, list_transform(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1), lambda x: {_decode('x')}) as hrefs,
  list_transform(regexp_extract_all(html, '(?s)<a href=\"[^\"]*\">(.*?)</a>', 1), lambda x: {_tidy('x')}) as anchors,
  len(regexp_extract_all(html, '<img ')) as images, len(regexp_extract_all(html, '<img ')) - len(regexp_extract_all(html, ' alt=\"[^\"]')) as images_missing_alt,
  list_distinct(regexp_extract_all(html, '\"@type\": ?\"([A-Za-z]+)\"', 1)) as schema_types, len(regexp_extract_all(html, '<li>')) as list_items, len(regexp_extract_all(html, '<table>')) as tables
  from pages))"""
_TESTS = {
    "missing_title": "title = ''", "long_title": "length(title) > 60", "missing_description": "description = ''", "long_description": "length(description) > 160", "missing_h1": "len(h1s) = 0", "many_h1": "len(h1s) > 1",
    "missing_canonical": "len(canonicals) = 0", "noindex": "contains(robots, 'noindex')", "missing_alt": "images_missing_alt > 0", "thin": "word_count between 1 and 299", "no_schema": "len(schema_types) = 0",
    "no_viewport": "viewport = ''", "zoom_block": "contains(viewport, 'user-scalable=no')", "insecure": "starts_with(url, 'https://') and contains(html, 'src=\"http://')", "long_url": "length(regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1)) > 100",
    "heading_skip": "len(list_filter(range(2, len(levels)+1), lambda i: levels[i] > levels[i-1]+1)) > 0",
    "vague_anchors": "len(list_filter(anchors, lambda a: lower(a) in ('click here', 'here', 'read more', 'learn more', 'more', 'this', 'this link', 'link', 'click', 'read on', 'details', 'view more', 'see more', 'continue reading'))) > 0",
}
_ISSUES = "iss as (" + "\nunion all ".join(f"select site_id, page_id, url, '{k}' as rule, '{op.RULES[k][0]}' as category, '{op.RULES[k][1]}' as severity from rec where {t}" for k, t in _TESTS.items()) + ")"
_PEN = "case severity when 'Critical' then 22 when 'High' then 14 when 'Medium' then 8 else 3 end"
_SCORES = f"""sc as (select site_id, page_id, cast(greatest(5, least(100, 100-coalesce(t, 0))) as bigint) as technical, cast(greatest(5, least(100, 100-coalesce(c, 0))) as bigint) as content from rec left join
  (select page_id, sum(case when category in ('Technical', 'Schema') then {_PEN} else 0 end) as t, sum(case when category not in ('Technical', 'Schema') then {_PEN} else 0 end) as c from iss group by 1) using (page_id))"""
_RECUR = "recur as (select site_id, category, rule, severity, count(*) as pages, min(page_id) as first_page, array_to_string(list_sort(list_distinct(list(url)))[1:25], ' ') as urls from iss group by site_id, category, rule, severity having count(*) > 1)"
_has = lambda *t: f"list_has_any(schema_types, {list(t)})"
_SUB = "list_concat(list_filter(h2s, lambda x: x <> '')[1:6], list_filter(h3s, lambda x: x <> '')[1:10])"
AEO = f"""aeo as (select site_id, page_id, {_has('FAQPage')} as faq_schema, {_has('HowTo')} as howto_schema, {_has('QAPage')} as qa_schema, len(schema_types) > 0 as any_schema, list_items >= 3 as list_markup, tables >= 1 as table_markup, len({_SUB}) >= 2 as multiple_headings,
  len(list_filter({_SUB}, lambda x: regexp_matches(lower(x), '^(what|how|why|where|which|who|when|is|are|can|does|do)\\b'))) > 0 as question_heading, regexp_matches(lower(full_text), '\\b(is a|refers to|means|is defined as|is the process of)\\b') as direct_answer,
  len(list_filter(string_split_regex(full_text, '[.?!]\\s'), lambda s: false)) > 0 or regexp_matches(full_text, '[^.?!]{{8,}}\\?(\\s|$)') as existing_questions, word_count >= 300 as content_depth from rec)"""
_GEO = f"""geo as (select site_id, page_id, {_has('Organization', 'LocalBusiness', 'Corporation')} as organization_schema, {_has('Product', 'Service', 'Offer')} as product_schema, {_has('Article', 'Person', 'BlogPosting', 'NewsArticle')} as article_schema,
  regexp_matches(b, 'contact us|contact form|get in touch') or regexp_matches(b, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') or regexp_matches(b, '\\+?[0-9][0-9 ().-]{{7,}}[0-9]') as contact,
  regexp_matches(b, 'about us|our story|who we are|our mission') or contains(lower(title), 'about') or contains(lower(h1_text), 'about') as about, regexp_matches(b, 'located in|based in|headquartered|address|nairobi|kenya|our office') as location,
  regexp_matches(b, 'for small businesses|for startups|for teams|for enterprises|designed for|built for') as audience, regexp_matches(b, 'certified|licensed|accredited|award|years of experience|trusted by') as credential,
  regexp_matches(b, 'testimonial|review|case study|client says|customers say|rated') as social_proof, regexp_matches(b, 'privacy policy|terms of service|refund policy|terms and conditions') as policy, title <> '' and h1_text <> '' as clear_naming
  from (select *, lower(full_text) as b from rec))"""
_LONG = lambda weights: "unpivoted as (" + " union all ".join(f"select site_id, page_id, '{k}' as flag, {k} as hit, {w} as points from aeo" for k, w in weights.items()) + ")"
flag_sum = lambda weights: "cast(floor((" + "+".join(f"case when {k} then {w} else 0 end" for k, w in weights.items()) + f")*100.0/{sum(weights.values())}+0.5) as bigint)"
_TYPE = """types as (select page_id, case when regexp_matches(lower(p), '(^|[/_-])(contact|get-in-touch|support)([/_.-]|$)|contact us') or regexp_matches(lower(t), '(^|[/_-])(contact|get-in-touch|support)([/_.-]|$)|contact us') then 'contact'
  when regexp_matches(lower(p||chr(10)||t), 'privacy|terms|cookie|refund|disclaimer|legal|gdpr') then 'legal'
  when regexp_matches(lower(p), '(^|[/_-])about([/_.\\s:-]|$)|about us|our story') or regexp_matches(lower(t), '(^|[/_-])about([/_.\\s:-]|$)|about us|our story') then 'about'
  when regexp_matches(lower(p), '(^|/)blog/?$|^blog\\b') or regexp_matches(lower(t), '(^|/)blog/?$|^blog\\b') then 'blog-index'
  when regexp_matches(lower(p), '/(blog|articles?|news|guides?|resources?|posts?)/') then 'article' when regexp_matches(lower(title), '\\bblog\\b') and word_count > 600 then 'article' when p in ('', '/') then 'home' else 'content' end as page_type
  from (select *, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as p, regexp_extract(title, '^([^—|–-]*)', 1) as t from rec))"""
_SKIPPED = " or ".join(f"(page_type = '{k}' and flag in {v if len(v) > 1 else repr(v).replace(',', '')})" for k, v in op.NOT_APPLICABLE.items())
_w = lambda *c: "with " + ",\n".join(c) + "\n"

ORACLE_SQL = {
    "extract_head": _w(REC) + "select site_id, page_id, title, lang, description, robots, viewport, generator, coalesce(canonicals[1], '') as canonical, len(canonicals) as n_canonicals, '' as hreflangs from rec",
    "extract_headings": _w(REC) + "select site_id, page_id, h1_text, len(h1s) as h1_count, len(h2s) as h2_count, array_to_string(levels, ',') as levels, array_to_string(h2s[1:6], ' | ') as h2_texts, array_to_string(h3s[1:10], ' | ') as h3_texts, '' as outline, '' as questions from rec",
    "extract_body": _w(REC) + f"select site_id, page_id, word_count, length(body_text) as n_chars, md5(body_text) as text_md5, substr({_plain(chr(34) + 'f' + chr(34))}, 1, 900) as contact_text from (select *, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) as f from rec)",
    "extract_links": _w(REC) + "select site_id, page_id, case when starts_with(href, '/') then origin||href when regexp_matches(href, '^https?://') then href else origin||'/'||href end as target, not regexp_matches(href, '^https?://') as internal, count(*) as times, min(substr(anchor, 1, 120)) as anchor from (select site_id, page_id, origin, unnest(hrefs) as href, unnest(anchors) as anchor from rec) where not starts_with(href, '#') group by 1, 2, 3, 4",
    "extract_images": _w(REC) + "select site_id, page_id, images, images_missing_alt, '' as missing_alt_srcs from rec",
    "extract_quality": _w(REC) + f"""select r.site_id, r.page_id, case when starts_with(url, 'https://') then len(regexp_extract_all(html, 'src=\"http://')) else 0 end as insecure_resources, levels[jump-1] as skip_from, levels[jump] as skip_to, coalesce(weak_anchors, 0) as weak_anchors, coalesce(weak_texts, '') as weak_texts from (select *, list_filter(range(2, len(levels)+1), lambda i: levels[i] > levels[i-1]+1)[1] as jump from rec) r left join (
  select page_id, count(*) as weak_anchors, string_agg(label, ',' order by spot) as weak_texts from (select page_id, target, label, min(spot) as spot from (select page_id, url, spot, regexp_replace(case when starts_with(href, '/') then origin||href when regexp_matches(href, '^https?://') then href else origin||'/'||href end, '#.*$', '') as target, trim(regexp_replace(lower(anchor), '[.!»›→>…]+$', '')) as label, href
    from (select page_id, url, origin, unnest(hrefs) as href, unnest(anchors) as anchor, generate_subscripts(hrefs, 1) as spot from rec)) where not starts_with(href, '#') and label in {op.VAGUE} and lower(regexp_extract(target, '^[a-z]+://([^/?#]+)', 1)) = lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) group by page_id, target, label
    qualify row_number() over (partition by page_id order by min(spot)) <= 10) group by page_id) w on w.page_id = r.page_id""",
    "extract_readable": _w(REC) + f"select site_id, page_id, title, '' as published, md5(main) as text_md5, length(main) as n_chars from (select site_id, page_id, title, {_plain(chr(34) + 'a' + chr(34))} as main from (select *, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as a from rec))",
    "stack_markers": _w(REC) + "select site_id, page_id, '' as marks, '' as mounts, len(regexp_extract_all(html, '<script>')) as scripts, generator from rec",
    "url_keys": f"""select page_id, host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) as path, host||key||query as page_key, host||key as url_key, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug
  from (select *, {HOST} as host, case when bare = '' then '/' else bare end as key, regexp_extract(url, '(\\?[^#]*)', 1) as query from (select *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as bare from pages))""",
    "url_hygiene": f"select {HOST} as site_id, page_id, regexp_matches(p, '[A-Z]') as capitals, contains(p, '_') as underscores, contains(url, '?') as query, 0 as http_links from (select *, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as p from pages)",
    "page_issues": _w(REC, _ISSUES) + "select site_id, page_id, rule, category, severity from iss",
    "page_scores": _w(REC, _ISSUES, _SCORES) + "select * from sc",
    "site_scores": _w(REC, _ISSUES, _SCORES, _RECUR) + "select site_id, count(*) as pages, cast(greatest(5, least(100, floor(avg(technical)-coalesce(any_value(lost), 0)+0.5))) as bigint) as technical, cast(floor(avg(content)+0.5) as bigint) as content from sc left join (select site_id, least(35, sum(case severity when 'Critical' then 11 when 'High' then 7 when 'Medium' then 4 else 2 end)) as lost from recur group by 1) using (site_id) group by site_id",
    "duplicate_titles": _w(REC) + "select site_id, title as value, count(*) as pages, min(page_id) as first_page, array_to_string(list_sort(list_distinct(list(url)))[1:25], ' ') as urls from rec where title <> '' group by site_id, title having count(*) > 1",
    "duplicate_bodies": _w(REC) + "select site_id, md5(body_text) as value, count(*) as pages, min(page_id) as first_page, array_to_string(list_sort(list_distinct(list(url)))[1:25], ' ') as urls from rec group by site_id, md5(body_text) having count(*) > 1",
    "recurring_issues": _w(REC, _ISSUES, _RECUR) + "select * from recur",
    "https_findings": f"select {HOST} as site_id, count(*) filter (where url like 'http://%') as http_pages, count(*) filter (where url like 'https://%') as https_pages, case when count(*) filter (where url like 'https://%') > 0 then 'http pages in an https site' else 'site on http' end as kind from pages group by {HOST} having count(*) filter (where url like 'http://%') > 0",
    "aeo_flags": _w(REC, AEO) + "select * from aeo",
    "geo_flags": _w(REC, _GEO) + "select * from geo",
    "site_flags": _w(REC, AEO, _LONG(op.AEO_WEIGHTS)) + "select site_id, flag, bool_or(hit) as any_page, count(*) filter (where hit) as pages, coalesce(array_to_string(list_sort(list(page_id) filter (where hit))[1:5], ','), '') as first_pages from unpivoted group by site_id, flag",
    "flag_scores": _w(REC, AEO, _GEO) + f"select aeo.site_id, aeo.page_id, {flag_sum(op.AEO_WEIGHTS)} as aeo_score, {flag_sum(op.GEO_WEIGHTS)} as geo_score from aeo join geo on aeo.page_id = geo.page_id",
    "weakest_pages": _w(REC, _GEO) + f"select site_id, row_number() over (partition by site_id order by score, page_id) as place, page_id, score from (select site_id, page_id, {flag_sum(op.GEO_WEIGHTS)} as score from geo) qualify place <= 5",
    "page_sample": _w(REC, _GEO) + f"""select site_id, row_number() over (partition by site_id order by step, r) as place, page_id, why from (
  select site_id, page_id, case when n <= 3 then 'all' when first then 'home' when weak <= ceil((3-has)/2) then 'weak' else 'long' end as why, case when n <= 3 then 0 when first then 0 when weak <= ceil((3-has)/2) then 1 else 2 end as step, case when n <= 3 then page_id when first then 0 when weak <= ceil((3-has)/2) then weak else long end as r from (
    select *, row_number() over (partition by site_id, first, not first and weak <= ceil((3-has)/2) order by word_count desc, page_id) as long from (
      select *, row_number() over (partition by site_id, first order by score, page_id) as weak from (select rec.site_id, rec.page_id, word_count, {flag_sum(op.GEO_WEIGHTS)} as score, count(*) over (partition by rec.site_id) as n, max((rec.page_id%3 = 0)::int) over (partition by rec.site_id) as has,
        rec.page_id%3 = 0 and row_number() over (partition by rec.site_id, rec.page_id%3 = 0 order by rec.page_id) = 1 as first from rec join geo on geo.page_id = rec.page_id)))) qualify place <= 3""",
    "temporary_redirects": f"""select site_id, count(*) as pages, count(*) filter (where t) as temporary, case when count(*) filter (where known) = 0 then 'unknown' when count(*) filter (where t) = 0 then 'pass' when count(*) filter (where t)*5 <= count(*) then 'warn' else 'fail' end as status
  from (select *, page_id%5 = 0 or (page_id%5 <> 1 and page_id%11 = 3) as t, page_id%5 < 2 or page_id%11 = 3 or length(site_id)%3 > 0 as known from (select page_id, {HOST} as site_id from pages)) group by site_id""",
    "page_types": _w(REC, _TYPE) + "select site_id, page_id, page_type from rec join types using (page_id)",
    "page_fixes": _w(REC, AEO, _LONG(op.AEO_WEIGHTS), _TYPE) + f"""select site_id, page_id, place, flag, cast(points as bigint) as points, cast(floor(met*100.0/whole+0.5) as bigint) as score, cast(floor((met+sum(points) over (partition by page_id))*100.0/whole+0.5) as bigint) as potential from (select *, row_number() over (partition by page_id order by points desc, flag) as place from
  (select u.*, sum(points) over (partition by page_id) as whole, sum(case when hit then points else 0 end) over (partition by page_id) as met from unpivoted u join types using (page_id) where not ({_SKIPPED})) where not hit) where place <= 3""",
    "market_language": _w(REC) + "select site_id, lower(regexp_extract(lang, '^([^-_]*)', 1)) as lang, count(*) as pages, case when lower(regexp_extract(lang, '^([^-_]*)', 1)) = '' then null else lower(regexp_extract(lang, '^([^-_]*)', 1)) in ('en', 'fr') end as fits from rec group by site_id, lower(regexp_extract(lang, '^([^-_]*)', 1))",
}
