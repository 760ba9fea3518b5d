"""Registered queries of content planning (ordered selection, groups, schedules) and their SQL, the loops written as recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import competitors as cp
from plumbline.operators import content as op
from plumbline.operators.links import _cut
from plumbline.sources import driver_tables as src

START = "2024-01-01"


def _head(n: int):
    return F.array_join(F.slice(F.split(F.trim("text"), r"[ \t\r\n]+"), 1, n), " ")


def _docs(spark, sf):
    """Documents as a site's material: the language is the site, the source the competitor or pillar."""
    return src.table(spark, sf, "documents").withColumn("site_id", F.col("lang"))


def _topics(spark, sf):
    """Every document as a proposed topic, by its first words; those that are labelled good are there already."""
    docs = _docs(spark, sf)
    rows = docs.select("site_id", F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), _head(6).alias("title"), F.lower(_head(2)).alias("keyword"))
    good = src.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return rows.join(good.hint("merge"), "id", "left_anti"), rows.join(good.hint("merge"), "id", "left_semi")


def topic_dedupe(spark, sf):
    topics, existing = _topics(spark, sf)
    return op.dedupe_topics(topics, existing)


def _unmatched(spark, sf):
    rows = _docs(spark, sf)
    words = F.size(F.split(F.trim("text"), r"[ \t\r\n]+")).cast("long")
    return rows.select("site_id", F.col("doc_id").alias("ord"), F.col("source").alias("competitor"), F.concat_ws("/", F.lit("https:/"), "source", "doc_id").alias("url"), _head(4).alias("title"), words.alias("words"))


def missing_pages(spark, sf):
    """Topics by the first words of each source's documents, whose texts are read once."""
    rows = _cut(_unmatched(spark, sf))
    return cp.missing_pages(rows, cp.page_groups(rows))


def schedule(spark, sf):
    kinds = F.array(*[F.lit(k) for k in op.GROUNDING_WEIGHT])
    docs = _docs(spark, sf)
    topics = docs.select(
        "site_id", F.col("doc_id").alias("id"), F.col("source").alias("pillar"), F.element_at(kinds, (F.col("doc_id") % 10 + 1).cast("int")).alias("grounding_kind"), (F.col("doc_id") % 3 == 0).alias("has_links"),
        F.when(F.col("doc_id") % 5 == 0, "Case study").otherwise("Guide").alias("format"),
    )
    taken = docs.where("doc_id % 7 = 0").select("site_id", F.date_add(F.lit(START).cast("date"), (F.col("doc_id") % 60 - 5).cast("int")).alias("day"))
    return op.schedule(topics, START, taken)


QUERIES = {f.__name__: f for f in (topic_dedupe, missing_pages, schedule)}

_FIRST = lambda n: f"array_to_string(string_split_regex(trim(text), '[ \\t\\r\\n]+')[1:{n}], ' ')"
_WORDS = lambda x: f"list_sort(list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 and w not in ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'for', 'on', 'with', 'is', 'are', 'how', 'what', 'your', 'you', 'do', 'does', 'vs', 'by', 'at', 'from', 'as', 'it', 'this', 'that'))))"
_ALIKE = lambda a, b, least: f"(len({a}) > 0 and len({b}) > 0 and len(list_intersect({a}, {b})) >= {least}*len(list_distinct(list_concat({a}, {b}))))"

ORACLE_SQL = {
    "topic_dedupe": f"""with recursive base as (select lang as site_id, doc_id as id, {_FIRST(6)} as title, lower({_FIRST(2)}) as keyword, doc_id in (select doc_id from labels where quality = 1) as there from documents),
  sets as (select *, {_WORDS('title')} as words from base), fresh as (select *, row_number() over (partition by site_id order by id) as i from sets where not there),
  w as (select site_id, id, there, words, keyword, unnest(words) as word from sets),
  near as (select distinct a.site_id, a.id, b.id as other, b.there from w a join w b on a.site_id = b.site_id and a.word = b.word and (b.there or b.id < a.id) and not a.there where {_ALIKE('a.words', 'b.words', 0.6)}),
  labelled as (select a.site_id, a.id, b.id as other from fresh a join fresh b on a.site_id = b.site_id and a.keyword = b.keyword and a.keyword <> '' and b.id < a.id),
  items as (select f.site_id, f.i, f.id, exists (select 1 from near n where n.id = f.id and n.there) as clash, coalesce((select list(other) from (select other from near n where n.id = f.id and not n.there union select other from labelled l where l.id = f.id)), []) as foes from fresh f),
  walk as (select site_id, 0::bigint as i, []::bigint[] as kept from (select distinct site_id from items) union all
    select r.site_id, r.i+1, case when t.clash or list_has_any(r.kept, t.foes) then r.kept else list_append(r.kept, t.id) end from walk r join items t on t.site_id = r.site_id and t.i = r.i+1),
  final as (select site_id, arg_max(kept, i) as kept from walk group by site_id)
  select t.site_id, t.id, list_contains(f.kept, t.id) as kept from items t join final f on f.site_id = t.site_id""",
    "missing_pages": f"""with recursive base as (select lang as site_id, doc_id as ord, source as competitor, 'https://'||source||'/'||doc_id as url, {_FIRST(4)} as title, cast(len(string_split_regex(trim(text), '[ \\t\\r\\n]+')) as bigint) as words from documents),
  items as (select *, {_WORDS('title')} as bag, row_number() over (partition by site_id order by ord) as i from base),
  walk as (select site_id, 0::bigint as i, 0::bigint as leader, []::struct(leader bigint, bag varchar[], size bigint)[] as groups from (select distinct site_id from items) union all
    select site_id, i, case when hit > 0 then groups[hit].leader else ord end, case when hit > 0 then list_transform(groups, lambda g, k: case when k = hit and words > g.size then {{'leader': g.leader, 'bag': bag, 'size': words}} else g end) else list_append(groups, {{'leader': ord, 'bag': bag, 'size': words}}) end
    from (select r.site_id, t.i, t.ord, t.bag, t.words, r.groups, coalesce(list_position(list_transform(r.groups, lambda g: {_ALIKE('g.bag', 't.bag', 0.5)}), true), 0) as hit from walk r join items t on t.site_id = r.site_id and t.i = r.i+1))
  select t.site_id, w.leader, count(distinct competitor) as competitors, max(words) as words, arg_max(url, (words, -ord)) as url, arg_max(title, (words, -ord)) as title from items t join walk w on w.site_id = t.site_id and w.i = t.i group by t.site_id, w.leader""",
    "schedule": f"""with recursive base as (select lang as site_id, doc_id as id, source as pillar, ['Q', 'K', 'S', 'A', 'C', 'R', 'T', 'E', 'P', 'SITE'][doc_id%10+1] as kind, doc_id%3 = 0 as links, doc_id%5 = 0 as study from documents),
  scored as (select site_id, id, pillar, case when kind = 'Q' then 5 when kind in ('K', 'S') then 4 when kind in ('A', 'C', 'R', 'T', 'E') then 3 when kind = 'P' then 2 else 1 end + case when links then 1 else 0 end + case when study then 0.5 else 0 end as score from base),
  best as (select *, row_number() over (partition by site_id order by score desc, id) as n from scored qualify n <= 30),
  walk as (select site_id, 0 as place, null::bigint as id, '' as last, list(id order by n) as pool, list(lower(pillar) order by n) as kinds from best group by site_id union all
    select site_id, place+1, pool[spot], kinds[spot], list_concat(list_slice(pool, 1, spot-1), list_slice(pool, spot+1, len(pool))), list_concat(list_slice(kinds, 1, spot-1), list_slice(kinds, spot+1, len(kinds))) from (select *, coalesce(nullif(list_position(list_transform(kinds, lambda k: k <> last), true), 0), 1) as spot from walk where len(pool) > 0)),
  days as (select s.site_id, d.day, row_number() over (partition by s.site_id order by d.day) as place from (select distinct lang as site_id from documents) s, (select cast(date '{START}' + cast(k as int) as date) as day from range(0, 200) r(k)) d
    where not exists (select 1 from documents where lang = s.site_id and doc_id%7 = 0 and cast(date '{START}' + cast(doc_id%60-5 as int) as date) = d.day))
  select w.site_id, w.id, d.day, case when b.score >= 5 then 'High' when b.score >= 3.5 then 'Medium' else 'Low' end as priority from walk w join best b on b.site_id = w.site_id and b.id = w.id join days d on d.site_id = w.site_id and d.place = w.place""",
}
