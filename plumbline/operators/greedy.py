"""Choices that go through a site's rows in order, made in rounds of joins with the answer of the loop.

Rows are compared by word set, so copies of a text are one set and a site may spread over any number of tasks.  Every round is written to the
shared checkpoint folder.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import jaccard
from plumbline.operators.links import _cut

#: Rows of a site that one task goes through at once; LINKS neighbours of their sets count as a row.
STRETCH, LINKS = 131072, 16


def set_key(words: Column) -> Column:
    """A word set as text; empty without words."""
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


#: Largest word sets that are joined on several words at once.
SHORT = 12


def _signatures(ordered: Column, least: float) -> Column:
    """What a set (words from rare to common) is joined on: ``lo, hi, key``, for each size that an alike set may have.

    Sets of sizes n and m share at least t = (n + m) * least / (1 + least) words, so their rarest n - t + k and m - t + k words share k: up to three
    words are one key.  Where a set of more than ``SHORT`` words takes part, k is 1 and the sizes (0, 0).
    """
    n = F.size(ordered)
    smallest = F.ceil(n * least - 1e-9).cast("int")
    largest = F.floor(n / least + 1e-9).cast("int")

    def of(m: Column) -> Column:
        shared = F.ceil((n + m) * (least / (1 + least)) - 1e-9).cast("int")
        k = F.least(shared, F.lit(3))
        first = F.slice(ordered, F.lit(1), F.greatest(n - shared + k, F.lit(0)))
        after = lambda i: F.slice(first, i + 2, F.size(first))
        twos = F.flatten(F.transform(first, lambda x, i: F.transform(after(i), lambda y: F.concat_ws(" ", x, y))))
        threes = F.flatten(F.transform(first, lambda x, i: F.flatten(F.transform(after(i), lambda y, j: F.transform(F.slice(first, i + j + 3, F.size(first)), lambda z: F.concat_ws(" ", x, y, z))))))
        keys = F.when(k == 1, first).when(k == 2, twos).otherwise(threes)
        return F.transform(keys, lambda key: F.struct(F.least(n, m).alias("lo"), F.greatest(n, m).alias("hi"), key.alias("key")))

    sizes = F.when((n <= SHORT) & (smallest >= 1), F.sequence(F.greatest(smallest, F.lit(1)), F.least(largest, F.lit(SHORT)))).otherwise(F.array().cast("array<int>"))
    long = F.transform(F.slice(ordered, F.lit(1), n - smallest + 1), lambda w: F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), w.alias("key")))
    return F.concat(F.flatten(F.transform(sizes, of)), F.when(largest > SHORT, long).otherwise(F.slice(long, 1, 0)))


def candidates(base: DataFrame, least: float) -> DataFrame:
    """``site_id, a, b``: pairs of sets (site_id, set, words) that may have a Jaccard of ``least``; all that have it are among them."""
    words = base.select("site_id", "set", F.explode("words").alias("word"))
    often = words.groupBy("site_id", "word").agg(F.count("*").alias("df"))
    ranked = words.join(often.hint("merge"), ["site_id", "word"]).groupBy("site_id", "set").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ordered"))
    ordered = ranked.select("site_id", "set", F.transform("ordered", lambda x: x["word"]).alias("ordered"))
    signed = _cut(ordered.select("site_id", "set", F.size("ordered").alias("n"), F.explode(_signatures(F.col("ordered"), least)).alias("k")).select("site_id", "set", "n", "k.*"))
    a, b = signed.withColumnsRenamed({"set": "a", "n": "na"}), signed.withColumnsRenamed({"set": "b", "n": "nb"})
    sizes = (F.col("na") + F.col("nb") == F.col("lo") + F.col("hi")) | ((F.col("lo") == 0) & (F.greatest("na", "nb") > SHORT))
    near = (F.col("a") < F.col("b")) & sizes & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
    return a.join(b.hint("merge"), ["site_id", "lo", "hi", "key"]).where(near).select("site_id", "a", "b").distinct()


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """``site_id, a, b``: every two word sets (``site_id, set``) of a site with a Jaccard of at least ``least``, both ways, each with itself too.

    Only sets that share some of their rarest words, as many as their sizes ask for, are joined, and the candidates are verified.
    """
    base = _cut(sets.where("set <> ''").distinct().withColumn("words", F.split("set", " ")))
    pairs = candidates(base, least).where(jaccard(F.split("a", " "), F.split("b", " ")) >= least)
    own = base.select("site_id", F.col("set").alias("a"), F.col("set").alias("b"))
    return _cut(pairs.union(pairs.select("site_id", F.col("b").alias("a"), F.col("a").alias("b"))).union(own))


def kept_in_order(rows: DataFrame, existing: DataFrame, least: float) -> DataFrame:
    """Which rows (site_id, id, ord, set, label) a pass in order would keep: ``site_id, id, kept``.

    A row goes if an ``existing`` set (site_id, set) or an earlier kept row of its site is similar enough or has the same label; an empty
    set or label is like no other.  Ties of ``ord`` go by ``id``.  In each round whoever comes before all undecided rows that it
    could clash with stays, and what clashes with it goes: the first maximal independent set of the order, which is what the loop keeps.
    """
    every = _cut(rows.select("site_id", "id", F.struct("ord", "id").alias("place"), "set", F.coalesce("label", F.lit("")).alias("label")))
    pairs = similar_sets(every.select("site_id", "set").union(existing.select("site_id", "set")), least)
    sets, labels = ["site_id", "set"], ["site_id", "label"]
    around = pairs.select("site_id", F.col("a").alias("set"), "b")

    def touched(of: DataFrame) -> DataFrame:
        """Sets near those of ``of``."""
        return around.join(of.select("site_id", F.col("set").alias("b")).distinct().hint("merge"), ["site_id", "b"], "left_semi").select(*sets).distinct()

    # of rows with one set and one label only the first can stay
    first = every.where("set <> '' or label <> ''").groupBy("site_id", "set", "label").agg(F.min("place").alias("place"))
    open_ = first.join(touched(existing.where("set <> ''")).hint("merge"), sets, "left_anti")
    open_ = _cut(open_)
    stay: list[DataFrame] = [every.where("set = '' and label = ''").select("site_id", "id")]
    while not open_.isEmpty():
        low = open_.where("set <> ''").groupBy(*sets).agg(F.min("place").alias("low"))
        near = around.join(low.withColumnRenamed("set", "b").hint("merge"), ["site_id", "b"]).groupBy(*sets).agg(F.min("low").alias("near"))
        same = open_.where("label <> ''").groupBy(*labels).agg(F.min("place").alias("same"))
        seen = open_.join(near.hint("merge"), sets, "left").join(same.hint("merge"), labels, "left")
        leads = (F.col("near").isNull() | (F.col("place") == F.col("near"))) & (F.col("same").isNull() | (F.col("place") == F.col("same")))
        new = _cut(seen.where(leads).select(*sets, "label", "place"))
        stay.append(new.select("site_id", F.col("place.id").alias("id")))
        rest = open_.join(touched(new.where("set <> ''")).hint("merge"), sets, "left_anti")
        open_ = _cut(rest.join(new.where("label <> ''").select(*labels).distinct().hint("merge"), labels, "left_anti").join(new.select("site_id", "place").hint("merge"), ["site_id", "place"], "left_anti"))
    found = stay[0]
    for more in stay[1:]:
        found = found.unionByName(more)
    return every.select("site_id", "id").join(found.withColumn("kept", F.lit(True)).hint("merge"), ["site_id", "id"], "left").select("site_id", "id", F.coalesce("kept", F.lit(False)).alias("kept"))


def _walked(cell: pa.Table) -> pa.Table:
    """The loop over the rows of one stretch of a site: ``site_id, ord, leader`` of each, and ``site_id, leader, sid, size`` of groups that got another speaker.

    ``kind`` 0 is a row (sid, x = ord, y = size), 1 two near sets of the stretch (sid, x), 2 a group of before (x, y = size) whose speaker is near ``sid``.
    """
    cell = cell.combine_chunks()
    of = lambda k, *by: [t[c].to_pylist() for t in [cell.filter(pc.equal(cell["kind"], k)).sort_by([(c, "ascending") for c in by])] for c in ("sid", "x", "y")]
    near, heard, size, turn = defaultdict(list), defaultdict(list), {}, defaultdict(int)
    for a, b, _ in zip(*of(1, "sid")):
        near[a].append(b)
    # of each set the groups that it is near to, oldest first; an entry holds until its group's next turn
    for sid, group, top in zip(*of(2, "sid", "x")):
        heard[sid].append((group, 0))
        size[group] = top
    leaders, speaks = [], {}
    sids, ords, sizes = of(0, "x")
    for sid, at, words in zip(sids, ords, sizes):
        groups = heard[sid]
        while groups and turn[groups[0][0]] != groups[0][1]:
            heapq.heappop(groups)
        group = groups[0][0] if groups else at
        leaders.append(group)
        if not groups or (words is not None and size[group] is not None and words > size[group]):
            turn[group] += 1
            size[group], speaks[group] = words, sid
            for other in near[sid]:
                heapq.heappush(heard[other], (group, turn[group]))
    longs = lambda x: pa.array(x, pa.int64())
    none, gone = [None] * len(leaders), [None] * len(speaks)
    site = pa.array([cell["site_id"][0].as_py()] * (len(leaders) + len(speaks)), cell["site_id"].type)
    return pa.table({"site_id": site, "ord": longs(ords + gone), "leader": longs(leaders + list(speaks)), "sid": longs(none + list(speaks.values())), "size": longs(none + [size[g] for g in speaks])})


def leader_groups(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Groups of similar rows as a pass in order makes them: ``site_id, ord, leader`` (the first row of the group).

    ``rows``: site_id, ord (long, one each), set, size.  A row joins the first group whose speaker is similar enough, and speaks for it from
    then on if its size exceeds all before; without such a group, or without words, it opens one.  Rows that hang together with no other are settled; the others of a
    site are gone through in stretches, one after the other (all sites at once): a task gets the rows of a stretch, the pairs of near sets among them and the groups
    of before that they are near to, and the groups' speakers are written between two stretches.
    """
    every = _cut(rows.select("site_id", F.col("ord").cast("long").alias("ord"), "set", F.col("size").cast("long").alias("size")))
    pairs = similar_sets(every.select("site_id", "set"), least)
    # a set goes by its first row; one that no other row is like is settled
    sets = every.where("set <> ''").groupBy("site_id", "set").agg(F.min("ord").alias("sid"), F.count("*").alias("n"))
    around = pairs.groupBy("site_id", F.col("a").alias("set")).agg(F.count("*").alias("around"))
    live = _cut(sets.join(around.hint("merge"), ["site_id", "set"]).where("n > 1 or around > 1").select("site_id", "set", "sid", (1 + F.col("around") / F.col("n") / LINKS).alias("weight")))
    a, b = live.select("site_id", F.col("set").alias("a"), "sid"), live.select("site_id", F.col("set").alias("b"), F.col("sid").alias("to"))
    near = _cut(pairs.join(a.hint("merge"), ["site_id", "a"]).join(b.hint("merge"), ["site_id", "b"]).select("site_id", "sid", "to"))
    so_far = F.sum("weight").over(Window.partitionBy("site_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    now = _cut(every.join(live.hint("merge"), ["site_id", "set"]).select("site_id", "ord", "size", "sid", F.floor(so_far / STRETCH).cast("int").alias("part")))
    kind = every.schema["site_id"].dataType.simpleString()
    led, spoken = every.select("site_id", "ord", F.col("ord").alias("leader")).limit(0), None
    for part in range((now.agg(F.max("part")).first()[0] or 0) + 1):
        own = now.where(F.col("part") == part)
        here = own.select("site_id", "sid").distinct()
        there = here.withColumnRenamed("sid", "to")
        inner = near.join(here.hint("merge"), ["site_id", "sid"], "left_semi").join(there.hint("merge"), ["site_id", "to"], "left_semi")
        task = own.select("site_id", F.lit(0).alias("kind"), "sid", F.col("ord").alias("x"), F.col("size").alias("y"))
        task = task.union(inner.select("site_id", F.lit(1), "sid", "to", F.lit(None).cast("long")))
        if spoken is not None:
            before = spoken.join(near.hint("merge"), ["site_id", "sid"]).join(there.hint("merge"), ["site_id", "to"], "left_semi")
            task = task.union(before.select("site_id", F.lit(2), "to", "leader", "size"))
        done = _cut(task.groupBy("site_id").applyInArrow(_walked, f"site_id {kind}, ord long, leader long, sid long, size long"))
        led = led.union(done.where("ord is not null").select("site_id", "ord", "leader"))
        changed = done.where("ord is null").select("site_id", "leader", "sid", "size")
        spoken = changed if spoken is None else _cut(spoken.join(changed.hint("merge"), ["site_id", "leader"], "left_anti").union(changed))
    return every.select("site_id", "ord").join(led.hint("merge"), ["site_id", "ord"], "left").select("site_id", "ord", F.coalesce("leader", "ord").alias("leader"))


def alternated(rows: Column, kind: str) -> Column:
    """An ordered array of at most a few dozen structs, reordered so that no two of one ``kind`` follow each other where that can be helped:
    each time the first one left whose kind differs from the last one's, else the first one left."""
    empty = F.filter(rows, lambda x: F.lit(False))
    last = lambda out: F.coalesce(F.lower(F.try_element_at(out, F.lit(-1))[kind]), F.lit(""))

    def place(state: Column, _: Column) -> Column:
        out, pool = state["out"], state["pool"]
        other = F.filter(F.sequence(F.lit(1), F.size(pool)), lambda i: F.coalesce(F.lower(F.element_at(pool, i)[kind]), F.lit("")) != last(out))
        at = F.coalesce(F.try_element_at(other, F.lit(1)), F.lit(1))
        return F.struct(F.concat(out, F.slice(pool, at, F.lit(1))).alias("out"), F.filter(pool, lambda x, i: i != at - 1).alias("pool"))

    return F.aggregate(rows, F.struct(empty.alias("out"), rows.alias("pool")), place, lambda s: s["out"])


def free_places(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """The place among all numbers from 1 on that the i-th row (site_id, n = i) gets when ``taken`` ones (site_id, n) are passed over: ``site_id, n, place``.

    The j-th taken number t lies before the i-th free one if ``t - j < i``, so one running count in the order of these keys answers every row.
    """
    passed = taken.where("n >= 1").distinct().withColumn("key", F.col("n") - F.row_number().over(Window.partitionBy("site_id").orderBy("n")))
    # dealt out by ranges, so that the union's sides are shuffled together: where both are hashed by site, Spark 4.1.2 takes the union as it is, but does not
    # lay the sides' partitions together below a merge join, and counts come out wrong
    passed = passed.repartitionByRange("site_id", "key")
    both = rows.select("site_id", F.col("n").alias("key"), F.lit(1).alias("kind"), "n").unionByName(passed.select("site_id", "key", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("n")))
    # a taken number with a key equal to i lies after the i-th free one
    so_far = F.count_if(F.col("kind") == 2).over(Window.partitionBy("site_id").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("place", F.col("key") + so_far).where("kind = 1").select("site_id", "n", "place")
