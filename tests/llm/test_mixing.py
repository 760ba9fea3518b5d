import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, lang string, topic string, probability string, kept int, weight int"


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(900):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}"
        lang = rng.choice(["en", "en", "en", "de", None])
        text = "w " * rng.randrange(0, 60) + rng.choice(["", " | x", " LICENSE"])
        rows.append((k, text, source, lang, None, "clash", 0, 0))
    return rows + [(9000, None, None, None, None, "", 0, 0), rows[5]]


def brute(cells, targets, budget, rounds):
    total = sum(cells.values())
    most = {k: v / (budget * total) for k, v in cells.items()}
    w = {k: min(v / total, most[k]) for k, v in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            have = {}
            for k, v in w.items():
                have[k[d]] = have.get(k[d], 0) + v
            w = {k: min(v * targets[d][k[d]] / have[k[d]] if have[k[d]] else 0, most[k]) for k, v in w.items()}
    return w


def test_raking_against_plain_python(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    cells = m.labelled(df).groupBy(*m.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    plain = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect() if r.tokens}
    targets = []
    for d, c in enumerate(m.MARGINS):
        sums = {}
        for k, v in plain.items():
            sums[k[d]] = sums.get(k[d], 0) + v
        raised = {k: v ** m.EXPONENTS[c] for k, v in sums.items()}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    got = {(r.source, r.lang, r.topic): r.weight for r in m.rake(cells, rounds=6, tolerance=-1).collect()}
    want = brute(plain, targets, m.BUDGET, 6)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("small", [50_000, 0])
def test_targets_are_met_and_draws_are_stable(spark, monkeypatch, small):
    monkeypatch.setattr(m, "SMALL", small)
    df = spark.createDataFrame(corpus(), SCHEMA)
    targets = {"source": {"hot": 0.2, **{f"s{k}": 0.16 for k in range(5)}, "absent": 0.0}, "lang": {"en": 0.5, "de": 0.3, "": 0.2}}
    rows = m.mix(df, targets, budget=0.4).collect()
    assert len(rows) == 902 and all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.probability * r.n_tokens for r in rows)
    for c, want in targets.items():
        for k, t in want.items():
            assert abs(sum(r.probability * r.n_tokens for r in rows if getattr(r, c) == k) / total - t) < 0.01
    drawn = sum(r.n_tokens for r in rows if r.kept)
    assert abs(drawn - total) < 0.1 * total
    assert sorted(map(tuple, m.mix(df.repartition(5), targets, budget=0.4).select("doc_id", "kept").collect())) == sorted((r.doc_id, r.kept) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 9000] == [0]


def test_given_topic_empty_and_blank(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, " ", "a", "en", "t", "", 0, 0), (2, None, None, None, None, "", 0, 0)], SCHEMA)
    assert [r.kept for r in m.mix(blank, topic=F.col("topic")).collect()] == [False, False]


def test_no_python_in_the_plan(spark):
    plan = m.mix(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_topics_follow_content_and_not_length_or_form(spark):
    sport, food = "The team won the match . ", "Cook the bread in butter . "
    texts = [sport, sport * 400, food, food * 400, food + "license", sport.upper(), food + " | x", "Nothing here, steam rematches.", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.topic for r in df.select("i", m.topic_of().alias("topic")).collect()}
    assert [got[i] for i in range(len(texts))] == ["sport", "sport", "food", "food", "food", "sport", "food", "other", "other", "other"]
    assert sum(len(w.split()) for w in m.TOPICS.values()) == len({x for w in m.TOPICS.values() for x in w.split()})


def test_a_subject_with_a_third_of_all_rows_is_raked(spark):
    rows = [(k, ("the team won the match " if k % 3 == 0 else "cook the bread ") + "w " * (k % 50), "s", "en") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = m.mix(df, {"topic": {"sport": 0.1, "food": 0.9}}, budget=0.4).collect()
    total = sum(r.probability * r.n_tokens for r in got)
    assert abs(sum(r.probability * r.n_tokens for r in got if r.topic == "sport") / total - 0.1) < 0.01
