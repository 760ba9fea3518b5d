"""Near pairs of sets of many words."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import similarity as sim
from plumbline.plans import text


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def written(spark):
    """Bytes that all tasks so far have shuffled."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize(("block", "threshold"), [(8192, 0.85), (16, 0.85), (16, 0.5)])
def test_close_pairs_are_all_pairs(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(sim, "SETS", block)
    rng = random.Random(block)
    vocabulary = [f"w{k}" for k in range(900)]
    sets = [[], ["w1"], ["w1", "w2"], ["w1", "w2", "w3"]]
    for size in (5, 12, 40, 64, 65, 130, 260, 520, 700):
        first = rng.sample(vocabulary, size)
        for _ in range(9):
            gone = rng.randrange(0, size // 6 + 2)
            sets.append(first[gone:] + rng.sample(vocabulary, rng.randrange(0, size // 8 + 2)))
    rows = [(k, list(dict.fromkeys(rng.sample(w, len(w))))) for k, w in enumerate(sets + sets[5:20])]
    first = {}
    for k, w in rows:
        first.setdefault(frozenset(w), k)
    kept = {k: w for w, k in first.items() if w}
    want = {(a, b, math.floor(likeness(kept[a], kept[b]) * 100 + 0.5)) for a in kept for b in kept if a < b and likeness(kept[a], kept[b]) >= threshold}
    df = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    got = [tuple(r) for r in sim.close_pairs(df, "id", F.col("words"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_no_sets(spark):
    df = spark.createDataFrame([(1, [])], "id long, words array<string>")
    assert sim.close_pairs(df, "id", F.col("words"), 0.85).collect() == []


def test_words_do_not_travel_with_pairs(spark, tmp_path):
    """A group of 150 near copies has 11,175 pairs; shuffled are its sets a few times, not once for each pair."""
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(400)]
    rows = [(k, " ".join(rng.sample(base, 390) + [f"own{k}"])) for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    assert text.near_duplicates(spark, str(tmp_path)).count() == 150 * 149 // 2
    assert written(spark) - before < 6 * sum(len(t) for _, t in rows)
