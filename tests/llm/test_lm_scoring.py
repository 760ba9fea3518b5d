import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import lm_scoring as m

SCHEMA = "doc_id long, text string, score string, h int, row int"


def tokens(text):
    low = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def corpus():
    """Texts in which the word before tells much about the next."""
    rng = random.Random(2)
    red, blue = [f"r{k}" for k in range(40)], [f"Blue{k}é" for k in range(40)]
    texts = [None, "", " \n\t", "once", "A a A"]
    for _ in range(300):
        side = rng.choice([red, blue])
        words = []
        for _ in range(rng.randrange(1, 60)):
            words.append(rng.choice(side) if rng.random() > 0.02 else f"rare{rng.randrange(10**6)}")
        texts.append(" ".join(words))
    return texts + [texts[10], texts[10]]


def expected(texts):
    c = Counter()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    for t, h in zip(texts, held, strict=True):
        if not h:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    rows = []
    for t, h in zip(texts, held, strict=True):
        w = tokens(t)
        rows.append((h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return rows


def test_counts_base_and_gain(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = expected(texts)
    for head in (8, m.HEAD):
        rows = {r.doc_id: r for r in m.lm_scores(df, head=head).collect()}
        for i, w in enumerate(want):
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9)
        held = [r for r in rows.values() if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97
        assert all(r.score < 0 for r in rows.values())


def test_probabilities_add_up_to_one(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = m.token_counts(df).toPandas()
    words = m.vocabulary(m.token_counts(df))
    pairs = m.class_pairs(df, words).toPandas()
    near, far = m.train_both(pairs.pair.to_numpy(), pairs.n.to_numpy(), steps=20)
    assert np.allclose(near.sum(axis=1), 1, atol=1e-4) and np.allclose(far.sum(axis=1), 1, atol=1e-4)
    h = counts.h.to_numpy().view(np.uint64)
    k = words.classes(h, counts.ending.to_numpy())
    left = words.ending_total + 0.5 * (words.ending_distinct + 1)
    own = np.where(k > m.COMMON, (counts.c.to_numpy() + 0.5) / left[np.maximum(k - m.COMMON - 1, 0)], 1.0)
    for row in (0, 77, m.COMMON):
        missing = [c for c in range(m.COMMON + 1) if c not in set(k)]
        total = (near[row][k] * own).sum() + (near[row][m.COMMON + 1 :] * 0.5 / left).sum() + near[row][missing].sum()
        assert math.isclose(total, 1, rel_tol=1e-3)


def test_scores_against_brute_force(spark):
    """Token by token in plain Python, from the same model."""
    texts = corpus()[:60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("held_out", m.held_out())
    training = df.where("not held_out")
    words = m.vocabulary(m.token_counts(training))
    pairs = m.class_pairs(training, words).toPandas()
    near, far = m.train_both(pairs.pair.to_numpy(), pairs.n.to_numpy())
    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(tokens(t))
    got = {r.doc_id: r.score for r in m.lm_scores(df.drop("held_out")).collect()}
    for i, t in enumerate(texts):
        h, ending, _ = m._tokens(pa.array([t], pa.string()))
        k = [int(x) for x in words.classes(h, ending)]
        want, before = 0.0, (m.COMMON, m.COMMON)
        for x, w in zip(k, tokens(t), strict=True):
            p = m.NEAR * near[before[1], x] + (1 - m.NEAR) * far[before[0], x]
            if x > m.COMMON:
                e = x - m.COMMON - 1
                p *= (c[w] + 0.5) / (words.ending_total[e] + 0.5 * (words.ending_distinct[e] + 1))
            want += math.log10(p)
            before = (before[1], x)
        assert math.isclose(got[i], want, rel_tol=1e-4)


def test_contexts_stay_inside_a_text():
    _, _, first = m._tokens(pa.array(["a b", "", "c"]))
    e = m.COMMON
    one, two = m._before(np.array([1, 2, e, e, 3, e]), first)
    assert one.tolist() == [e, 1, 2, e, e, 3] and two.tolist() == [e, e, 1, e, e, e]


def test_held_out_gain_on_given_tables(spark):
    rows = m.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    model, base = rows["sum(score)"] / rows["sum(n_tokens)"], rows["sum(base_score)"] / rows["sum(n_tokens)"]
    print("held out, log10 a token:", base, model)
    assert model > base + 0.15


def test_empty_and_untrained(spark):
    assert m.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = m.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (rows[0].train_tokens, rows[0].n_known, rows[0].base_score) == (0, 0, 0.0)
