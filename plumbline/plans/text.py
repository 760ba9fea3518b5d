"""Registered similarity and keyword queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import word_set
from plumbline.operators import competitors as cp
from plumbline.operators import keywords as kw
from plumbline.operators import links as lk
from plumbline.operators import pages as pg
from plumbline.operators import similarity as sim
from plumbline.plans.pages import REC
from plumbline.sources import driver_tables as src

NEAR = 0.85
PHRASES = ["released under", "license", "the in", "of the"]


def _documents(spark, sf):
    docs = src.table(spark, sf, "documents")
    return sim.word_classes(docs, "doc_id", word_set(F.coalesce("text", F.lit(""))))


def near_duplicates(spark, sf):
    """Pairs of representatives; ``near_duplicate_classes`` has the membership."""
    return sim.close_pairs(src.table(spark, sf, "documents"), "doc_id", word_set(F.coalesce("text", F.lit(""))), NEAR)


def near_duplicate_classes(spark, sf):
    return _documents(spark, sf).select("doc_id", "rep", F.size("words").cast("long").alias("n_words"))


def _records(spark, sf):
    return pg.records(src.pages(spark, sf))


def _titles(spark, sf):
    return sim.word_classes(_records(spark, sf).select("page_id", "title"), "page_id", sim.title_words("title"))


def title_similarity(spark, sf):
    return sim.near_pairs(_titles(spark, sf), "page_id", 0.5)


def covered_topics(spark, sf):
    """H1 texts whose words are all in the title of some page."""
    topics = sim.word_classes(_records(spark, sf).select("page_id", "h1_text"), "page_id", sim.title_words("h1_text")).where("page_id = rep").select(F.col("page_id").alias("id"), "words")
    entries = _titles(spark, sf).where("page_id = rep").select(F.col("page_id").alias("id"), "words")
    return sim.covered(topics, entries)


def page_match(spark, sf):
    """The nearest page over https by title for each page over http."""
    r = _records(spark, sf)
    sets = lambda rows: rows.select(F.col("page_id").alias("id"), sim.title_words("title").alias("words")).where(F.size("words") > 0)
    return cp.page_match(sets(r.where("url like 'http:%'")), sets(r.where("url like 'https:%'")), 0.1).select("l", "r", F.floor(F.col("similarity") * 10000 + 0.5).alias("similarity"))


def link_candidates(spark, sf):
    """Pages of the same site that could link to its thin pages."""
    r = lk._cut(_records(spark, sf).select("site_id", F.col("page_id").alias("page"), "word_count", word_set("full_text").alias("words")))
    return lk.link_candidates(r.where("word_count < 300"), r)


def _candidates(spark, sf, body="full_text"):
    """Written once: what follows reads them several times."""
    return lk._cut(kw.candidates(kw.page_fields(_records(spark, sf), body)))


def _site_pages(spark, sf):
    return src.pages(spark, sf).groupBy("site_id").agg(F.count("*").alias("site_pages"))


def keyword_candidates(spark, sf):
    return _candidates(spark, sf)


def site_keywords(spark, sf):
    return kw.site_keywords(_candidates(spark, sf))


def _audit(spark, sf, cands):
    return kw.keyword_audit(kw.site_keywords(cands), _site_pages(spark, sf))


def keyword_audit(spark, sf):
    return _audit(spark, sf, _candidates(spark, sf))


def keyword_priorities(spark, sf):
    """By the pages' whole texts."""
    return kw.keyword_priority(_audit(spark, sf, _candidates(spark, sf, "body_text"))).select("site_id", "phrase", "priority")


def keyword_score(spark, sf):
    """With the clusters that several pages of the site compete for, by the pages' whole texts."""
    cands = _candidates(spark, sf, "body_text")
    return kw.keyword_score(_audit(spark, sf, cands), cp.cannibalization(cands, cp.keyword_clusters(cands, _site_pages(spark, sf))))


def topic_overlap(spark, sf):
    """Phrases of each site's h1s (ours) against those of its titles (theirs)."""
    cands = _candidates(spark, sf)
    side = lambda use: cands.where(use).groupBy("site_id", F.col("phrase").alias("topic")).agg(F.sum("score").alias("score"))
    return sim.topic_overlap(side("in_body >= 3"), side("in_title"))


def phrase_targeting(spark, sf):
    """Whether each site's pages target the phrases that its bodies repeat."""
    fields = lk._cut(kw.page_fields(_records(spark, sf)))
    phrases = kw.site_keywords(lk._cut(kw.candidates(fields))).select("site_id", "phrase")
    return cp.phrase_targeting(phrases, fields.select("site_id", "page_id", "title", "h1", "body"))


def entities(spark, sf):
    """The commonest entities of each source."""
    docs = src.table(spark, sf, "documents").withColumn("site_id", F.col("source"))
    return kw.site_entities(kw.entity_candidates(docs, "doc_id", "text"))


def extract_phones(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", F.array_join(kw.phones("text"), " | ").alias("phones")).where("phones <> ''")


def other_phones(spark, sf):
    return kw.other_phones(src.table(spark, sf, "documents").withColumn("site_id", F.col("source")), "doc_id", "text")


def phrase_occurrences(spark, sf):
    return kw.body_occurrences(src.table(spark, sf, "documents"), "doc_id", "text", PHRASES)


QUERIES = {f.__name__: f for f in (
    near_duplicates, near_duplicate_classes, title_similarity, covered_topics, page_match, link_candidates, keyword_candidates, site_keywords, keyword_audit, keyword_priorities, keyword_score,
    topic_overlap, phrase_targeting, entities, extract_phones, other_phones, phrase_occurrences,
)}

_w = lambda *c: "with " + ",\n".join(c) + "\n"
_SET = lambda x: f"list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9'']{{3,}}')))"
_STOP = "('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'for', 'on', 'with', 'is', 'are', 'how', 'what', 'your', 'you', 'do', 'does', 'vs', 'by', 'at', 'from', 'as', 'it', 'this', 'that')"
_TOPIC = lambda x: f"list_sort(list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 and w not in {_STOP})))"


def _classes(key: str, words: str, table: str) -> str:
    return f"sets as (select {key} as id, {words} as words from {table}), reps as (select words, min(id) as id, len(words) as n from sets where len(words) > 0 group by words)"


def _pairs(threshold: float) -> str:
    """Shared words of any two sets by an inverted index, verified against the threshold."""
    return f"""ws as (select id, n, unnest(words) as w from reps), pairs as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as k from ws a join ws b on a.w = b.w and a.id < b.id and least(a.n, b.n) >= {threshold}*greatest(a.n, b.n) - 1e-9 group by all)
  select a, b, cast(floor(k/(na+nb-k)*100+0.5) as bigint) as percent from pairs where k/(na+nb-k) >= {threshold}"""


_EDGE = lambda w: f"(not list_contains({list(kw.STOPWORDS)}, {w}) and length({w}) >= 2)"
_GRAMS = " union all ".join(f"select site_id, page_id, weight, unnest(list_transform(list_filter(range(1, len(words)-{n - 1}+1), lambda i: {_EDGE('words[i]')} and {_EDGE(f'words[i+{n - 1}]')}), lambda i: array_to_string(words[i:i+{n - 1}], ' '))) as phrase from toks" for n in (1, 2, 3))
_FLD = "fld as (select site_id, page_id, title, h1_text as h1, array_to_string(list_concat(list_filter(h2s, lambda x: x <> '')[1:6], list_filter(h3s, lambda x: x <> '')[1:10]), ' . ') as h2h3, description, '' as alt, full_text as body, lower(array_to_string(schema_types, ' ')) as schema_ from rec)"
_CANDS = f"""{_FLD}, toks as (select site_id, page_id, weight, list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+'), lambda w: w <> '') as words from
  ({" union all ".join(f"select site_id, page_id, {w} as weight, {f} as t from fld" for f, w in kw.FIELDS.items())})), grams as ({_GRAMS}),
cands as (select * from (select t.site_id, t.page_id, phrase, score, contains(lower(title), phrase) as in_title, contains(lower(h1), phrase) as in_h1, contains(lower(h2h3), phrase) as in_h2h3, contains(lower(description), phrase) as in_description, contains(lower(alt), phrase) as in_alt, contains(schema_, phrase) as in_schema,
  cast((length(lower(body))-length(replace(lower(body), phrase, '')))/length(phrase) as bigint) as in_body from (select site_id, page_id, phrase, cast(sum(weight) as bigint) as score from grams where length(phrase) >= 3 group by site_id, page_id, phrase qualify row_number() over (partition by page_id order by score desc, phrase) <= 25) t join fld using (page_id))
  where in_body > 0 or in_title or in_h1 or in_h2h3 or in_alt)"""
_WHOLE = _CANDS.replace("full_text as body", "body_text as body")
_any = lambda words: "(" + " or ".join(f"contains(phrase, '{w}')" for w in words) + ")"
_QUESTION = "(" + " or ".join(f"starts_with(phrase, '{w} ')" for w in kw.QUESTIONS) + ")"
_SITE = f"""site as (select site_id, phrase, score, pages, n_title, n_description, n_h1, n_h2h3, n_alt, n_schema, n_body, cast(floor(least(100, score*100.0/max(score) over (partition by site_id))+0.5) as bigint) as relevance,
  cast((n_title > 0)::int + (n_description > 0)::int + (n_h1 > 0)::int + (n_h2h3 > 0)::int + (n_alt > 0)::int + (n_schema > 0)::int + n_body as bigint) as occurs,
  case when {_QUESTION} then 'Question' when {_any(kw.LOCAL)} then 'Local' when {_any(kw.TRANSACTIONAL)} then 'Transactional' when {_any(kw.COMMERCIAL)} then 'Commercial' when len(string_split(phrase, ' ')) = 1 then 'Primary' when len(string_split(phrase, ' ')) = 2 then 'Secondary' else 'Long-tail' end as kind,
  case when {_QUESTION} then 'Informational' when {_any(kw.TRANSACTIONAL)} then 'Transactional' when {_any(kw.COMMERCIAL)} then 'Commercial' when {_any(kw.NAVIGATIONAL)} then 'Navigational' when {_any(kw.LOCAL)} then 'Commercial' else 'Informational' end as intent
  from (select site_id, phrase, cast(sum(score) as bigint) as score, count(*) as pages, {", ".join(f"count(*) filter (where in_{u}) as n_{u}" for u in kw.USES)}, cast(sum(in_body) as bigint) as n_body from cands group by site_id, phrase qualify row_number() over (partition by site_id order by sum(score) desc, phrase) <= 24))"""
_AUDIT = """audit as (select site_id, phrase, relevance, placement, case when placement >= 55 then 'Strong' when placement >= 25 then 'Weak' else 'Poor' end as status,
  concat_ws(',', case when n_title = 0 then 'no title' end, case when n_h1 = 0 then 'no h1' end, case when n_description = 0 then 'no description' end, case when placement = 0 and n_body > 0 then 'body only' end, case when relevance >= 60 and pages <= 1 and site_pages > 1 then 'one page' end, case when n_body >= 8 and placement < 30 then 'stuffing' end) as flags
  from (select s.*, site_pages, cast(case when n_title > 0 then 30 else 0 end + case when n_h1 > 0 then 25 else 0 end + case when n_description > 0 then 15 else 0 end + case when n_h2h3 > 0 then 15 else 0 end + case when n_schema > 0 then 10 else 0 end + case when n_alt > 0 then 5 else 0 end as bigint) as placement
  from site s join (select site_id, count(*) as site_pages from rec group by site_id) n on n.site_id = s.site_id))"""
_PHONE = r"(?:\+|00)?[0-9][0-9\s().-]{7,18}[0-9]"
_PH = f"""ph as (select doc_id, source as site_id, raw, pos, right(regexp_replace(raw, '[^0-9]', '', 'g'), 9) as last9 from (select doc_id, source, unnest(l) as raw, generate_subscripts(l, 1) as pos from (select doc_id, source, regexp_extract_all(text, '{_PHONE}') as l from documents))
  where length(regexp_replace(raw, '[^0-9]', '', 'g')) between 9 and 15 and not regexp_matches(trim(raw), '^(19|20)[0-9]{{2}}[-/.\\s]?[0-9]{{1,2}}[-/.\\s]?[0-9]{{1,2}}$')),
ph1 as (select *, row_number() over (partition by doc_id order by pos) as n from (select * from ph qualify row_number() over (partition by doc_id, last9 order by pos) = 1) qualify n <= 8)"""

#: Clusters by recursion: labels spread along shared words until none falls.
CLUSTERS = """gate as (select site_id, greatest(4, ceil(count(*)*2/5)) as gate from rec group by site_id),
  wd as (select distinct site_id, page_id, phrase, unnest(string_split_regex(lower(phrase), '\\s+')) as word from cands), ok as (select w.site_id, word from wd w join gate g on g.site_id = w.site_id where length(word) >= 4 group by w.site_id, word, gate having count(distinct page_id) <= gate),
  pw as (select distinct site_id, phrase, word from wd join ok using (site_id, word)), lk as (select distinct a.site_id, a.phrase as a, b.phrase as b from pw a join pw b on a.site_id = b.site_id and a.word = b.word),
  tot as (select site_id, phrase, cast(sum(score) as bigint) as score, count(distinct page_id) as pages from cands group by site_id, phrase),
  spread as (select site_id, phrase, phrase as root from tot union select l.site_id, l.b, s.root from spread s join lk l on l.site_id = s.site_id and l.a = s.phrase),
  roots as (select site_id, phrase, min(root) as root from spread group by site_id, phrase), named as (select r.site_id, root, arg_max(t.phrase, (t.score, t.phrase)) as cluster from roots r join tot t using (site_id, phrase) group by r.site_id, root),
  clusters as (select t.site_id, n.cluster, t.phrase, t.score, t.pages, contains(t.phrase, ' ') or t.pages <= gate as links_pages from tot t join roots r using (site_id, phrase) join named n on n.site_id = r.site_id and n.root = r.root join gate g on g.site_id = t.site_id),
  cannibals as (select c.site_id, k.cluster, count(distinct c.page_id) as pages from cands c join clusters k on k.site_id = c.site_id and k.phrase = c.phrase and k.links_pages where c.in_title or c.in_h1 group by c.site_id, k.cluster having count(distinct c.page_id) >= 2)"""

ORACLE_SQL = {
    "keyword_score": _w(REC, _WHOLE, _SITE, _AUDIT, CLUSTERS).replace("with ", "with recursive ", 1) + """select site_id, keywords, n as cannibals, cast(greatest(0, least(100, floor(base-least(20, n*5)+0.5))) as bigint) as score from (select a.site_id, count(*) as keywords, sum(placement*greatest(1, relevance))/sum(greatest(1, relevance)) as base, coalesce((select count(*) from cannibals c where c.site_id = a.site_id), 0) as n from audit a group by a.site_id)""",
    "near_duplicates": _w(_classes("doc_id", _SET("text"), "documents")) + ", " + _pairs(NEAR),
    "near_duplicate_classes": _w(_classes("doc_id", _SET("text"), "documents")) + "select s.id as doc_id, r.id as rep, n as n_words from sets s join reps r using (words)",
    "title_similarity": _w(REC, _classes("page_id", _TOPIC("title"), "rec")) + ", " + _pairs(0.5),
    "covered_topics": _w(REC, f"topics as (select {_TOPIC('h1_text')} as words, min(page_id) as id from rec group by 1), entries as (select {_TOPIC('title')} as words, min(page_id) as id from rec group by 1)") + "select t.id as topic, min(e.id) as entry from topics t join entries e on list_has_all(e.words, t.words) and len(list_filter(e.words, lambda w: regexp_matches(w, '^[0-9]+$') and not list_contains(t.words, w))) = 0 where len(t.words) >= 2 group by t.id",
    "page_match": _w(REC, f"s as (select page_id as id, starts_with(url, 'https:') as safe, {_TOPIC('title')} as words from rec)") + """, x as (select id, safe, len(words) as n, unnest(words) as w from s) select l, r, cast(floor(similarity*10000+0.5) as bigint) as similarity from (select a.id as l, b.id as r, count(*)/(any_value(a.n)+any_value(b.n)-count(*)) as similarity from x a join x b on a.w = b.w and not a.safe and b.safe group by a.id, b.id) where similarity >= 0.1
  qualify row_number() over (partition by l order by similarity desc, r) = 1""",
    "link_candidates": _w(REC, f"s as (select site_id, page_id as id, word_count, {_SET('full_text')} as words from rec), x as (select site_id, id, word_count, len(words) as n, unnest(words) as w from s)") + """select site_id, page, row_number() over (partition by page order by percent desc, source) as place, source, percent from (select a.site_id, a.id as page, b.id as source, cast(floor(count(*)/(any_value(a.n)+any_value(b.n)-count(*))*100+0.5) as bigint) as percent from x a join x b on a.w = b.w and a.site_id = b.site_id and a.id <> b.id
  where a.word_count < 300 group by a.site_id, a.id, b.id) where percent > 0 qualify place <= 5""",
    "keyword_candidates": _w(REC, _CANDS) + "select * from cands",
    "site_keywords": _w(REC, _CANDS, _SITE) + "select * from site",
    "keyword_audit": _w(REC, _CANDS, _SITE, _AUDIT) + "select * from audit",
    "keyword_priorities": _w(REC, _WHOLE, _SITE, _AUDIT) + "select site_id, phrase, case when status = 'Poor' and relevance >= 70 then 'Critical' when status = 'Poor' or (status = 'Weak' and relevance >= 70) then 'High' when status = 'Weak' then 'Medium' else 'Low' end as priority from audit",
    "topic_overlap": _w(REC, _CANDS) + """, a as (select site_id, phrase as topic, row_number() over (partition by site_id order by sum(score) desc, phrase) as n from cands where in_body >= 3 group by site_id, phrase qualify n <= 60), b as (select site_id, phrase as topic, row_number() over (partition by site_id order by sum(score) desc, phrase) as n from cands where in_title group by site_id, phrase qualify n <= 60)
  select site_id, kind, row_number() over (partition by site_id, kind order by n, topic) as place, topic from (select *, case when (site_id, topic) in (select (site_id, topic) from b) then 'shared' else 'ours' end as kind from a union all select *, 'theirs' from b where (site_id, topic) not in (select (site_id, topic) from a)) qualify place <= 25""",
    "phrase_targeting": _w(REC, _CANDS, _SITE) + """select s.site_id, s.phrase, case max(case when list_has_all(string_split_regex(lower(title||' '||h1), '[^\\p{L}\\p{N}]+'), list_filter(string_split_regex(phrase, '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) then 2 when contains(' '||regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', ' ', 'g')||' ', ' '||regexp_replace(phrase, '[^\\p{L}\\p{N}]+', ' ', 'g')||' ') then 1 else 0 end) when 2 then 'yes' when 1 then 'partial' else 'no' end as targeted from site s join fld f on f.site_id = s.site_id group by s.site_id, s.phrase""",
    "entities": rf"""select site_id, entity, cast(sum(times) as bigint) as times from (select site_id, doc_id, entity, count(*) as times from (select source as site_id, doc_id, unnest(regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9&'']*(?:\s+[A-Z][a-zA-Z0-9&'']*){{0,3}})\b', 1)) as entity from documents)
  where (regexp_matches(entity, '\s') or length(entity) >= 3) and not list_contains({list(kw.STOPWORDS)}, lower(entity)) group by site_id, doc_id, entity qualify row_number() over (partition by doc_id order by times desc, entity) <= 25) group by site_id, entity qualify row_number() over (partition by site_id order by sum(times) desc, entity) <= 20""",
    "extract_phones": _w(_PH) + "select doc_id, string_agg(substr(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 1, 24), ' | ' order by pos) as phones from ph1 group by doc_id",
    "other_phones": _w(_PH) + "select site_id, last9, count(distinct doc_id) as pages, min(doc_id) as first_page from ph1 group by site_id, last9 qualify row_number() over (partition by site_id order by pages desc, last9) <= 5",
    "phrase_occurrences": " union all ".join(f"select '{p}' as phrase, count(*) as rows, cast(sum(n) as bigint) as times from (select cast((length(lower(text))-length(replace(lower(text), '{p}', '')))/{len(p)} as bigint) as n from documents) where n > 0 having count(*) > 0" for p in PHRASES),
}
