import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join
from plumbline.llm.common import components
from plumbline.llm.jaccard_join import Rings, jaccard_groups

SCHEMA = "doc_id long, text string, component_id string, node int"


def sets_of(texts, width):
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    return [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for w in words]


def brute(texts, width, percent):
    sets = sets_of(texts, width)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df, **kw).collect()}
    return [rows[i] for i in range(len(texts))]


def corpus(seed, n, length):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "two words", "two  words", "words two", "a b c", "A B C", "É b c", "é b c"]
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, length))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("width", "percent", "aside"), [(3, 90, False), (5, 80, False), (5, 80, True)])
def test_against_brute_force(spark, width, percent, aside):
    texts = corpus(3, 40, 120)
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [f"{t} {passage}" for t in texts[12:60]]
    assert run(spark, texts, width=width, percent=percent, set_common_aside=aside) == brute(texts, width, percent)


def test_large_regions_are_cut_and_dealt_out(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(jaccard_join, "CUTS", 3)
    assert run(spark, texts, cell=8) == brute(texts, 3, 90)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 2**63, 700).astype(np.uint64)
    for percent, common in ((80, None), (90, None), (80, np.sort(universe[:350]))):
        rings = Rings(percent, common)
        for n in list(range(1, 60)) + [200, 555, 556, 700]:
            a = rng.permutation(universe)[:n]
            for gone in range(0, n // 5 + 1):
                for new in (0, gone):
                    b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
                    shared, union = n - gone, n + new
                    if len(b) and 100 * shared >= percent * union:
                        assert set(rings.signatures(a)) & set(rings.signatures(b))


def test_empty_repeated_and_null_id(spark):
    assert jaccard_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    t = "some words that are long enough"
    rows = jaccard_groups(spark.createDataFrame([(5, t), (5, t), (None, t), (3, t), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows if r.n_shingles) == [(-1, 3), (3, 3), (5, 3), (5, 3)]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in up)


def test_rows_that_share_an_id_are_compared_by_their_own_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near_a, near_b = a + " z", b + " z"
    rows = [(5, a), (5, b), (3, near_a), (2, near_b), (None, a), (None, "only here"), (9, ""), (9, ""), (8, None), (7, "only there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(jaccard_join.jaccard_groups(docs).select("doc_id", "component_id").collect(), key=repr)
    want = [(5, 3), (5, 2), (3, 3), (2, 2), (None, 3), (None, None), (9, 9), (9, 9), (8, 8), (7, 7)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = jaccard_join.one_of_each_group(docs.withColumn("_row", F.lit(1)).withColumn("extra", F.lit("x")).drop("_row"), 3, 90).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(3, near_a), (2, near_b), (None, "only here"), (9, ""), (8, None), (7, "only there")], key=repr)


def test_common_signatures_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ONE_IN", 1)
    monkeypatch.setattr(jaccard_join, "OFTEN", 2)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(80)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(copy))
    assert run(spark, texts) == brute(texts, 3, 90)
