import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import periodic_runs
from plumbline.llm.common import Words, table

SCHEMA = "doc_id long, text string, start string, n_runs int"


def brute_runs(w):
    """(start, length, period) of every run: each period's maximal stretches, those with a smaller period left out."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.add((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text, plant):
    w = (text or "").encode().split()
    w = planted_words(doc_id, w) if plant else w
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found(texts):
    words = Words(pa.array(texts, pa.string()))
    own, start, end, period = periodic_runs.runs_of(words.hash, words.first)
    return [[(int(s), int(e - s), int(p)) for o, s, e, p in zip(own, start, end, period) if o == d] for d in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_runs_of_small_alphabets(docs):
    assert found([" ".join(d) for d in docs]) == [brute_runs(d) for d in docs]


def test_repeated_stretches_nested_and_across_texts():
    rng = random.Random(5)
    docs = [["x"] * 40, (["a", "b"] * 7 + ["c"]) * 4, ["a", "b", "c"] * 4, ["a", "b", "c"] * 4, ["q"] * 11, ["q"] * 12]
    for _ in range(30):
        w = [rng.randrange(4) for _ in range(rng.randrange(1, 160))]
        a, p = rng.randrange(len(w)), rng.randrange(1, 30)
        docs.append([f"v{x}" for x in (w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))])
    assert found([" ".join(d) for d in docs]) == [brute_runs(d) for d in docs]


def test_extensions_agree_with_comparing_words():
    rng = np.random.default_rng(1)
    row = rng.integers(0, 2, 3000).astype(np.uint64)
    row[1000:2000] = row[:1000]
    row = np.append(row, np.uint64(99))
    levels = periodic_runs.grammar(row)
    assert len(levels[-1].first) == 1
    x, y = rng.integers(0, 3000, 500), rng.integers(0, 3000, 500)
    x, y = x[x != y], y[x != y]
    x, y = np.append(x, 0), np.append(y, 1000)
    got = periodic_runs.common_extension(levels, x, y)
    for a, b, n in zip(x.tolist(), y.tolist(), got.tolist()):
        k = 0
        while max(a, b) + k < len(row) and row[a + k] == row[b + k]:
            k += 1
        assert k == n


def test_rows(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a\x0bb " * 9, "word " * 3000, "é ê " * 8 + "é"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(200))) for _ in range(80)]
    rows = [(k, t, "clash", 0) for k, t in enumerate(texts)] + [(7, texts[7], "again", 1)]
    for plant in (False, True):
        got = periodic_runs.collapsed(spark.createDataFrame(rows, SCHEMA).repartition(3), plant=plant).collect()
        key = lambda r: (r[0], str(r))
        assert sorted(map(tuple, got), key=key) == sorted((expected(k, t, plant) for k, t, *_ in rows), key=key)
    assert periodic_runs.collapsed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(periodic_runs.collapsed(spark.createDataFrame([(None, "a b", "", 0)], SCHEMA), plant=True).collect()) == 1
    only = periodic_runs.collapsed(spark.createDataFrame([(1, "x y " * 20 + "z", "", 0)], SCHEMA), with_text=True).first()
    assert only.collapsed == "x y z"


def test_a_long_text_in_bounded_time(spark):
    text = " ".join(["one two three"] * 60_000)
    r = periodic_runs.collapsed(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 180_000, 3)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    short = [r for r in docs.collect() if len(r.text.split()) <= 700]
    got = {r.doc_id: tuple(r) for r in periodic_runs.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count() and sum(r[1] > 0 for r in got.values()) > 10
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text, True)
