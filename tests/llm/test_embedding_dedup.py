import numpy as np

from plumbline.llm import embedding_dedup as m
from plumbline.llm.embedding_dedup import filters_each
from plumbline.llm.embedding_dedup import first_shared as m_first
from plumbline.llm.embedding_dedup import ProductCode, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep int"


def brute(vectors, cosine=0.95):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.float32(vectors[i]).astype("f8"), np.float32(vectors[j]).astype("f8")
                if a @ b >= cosine * np.linalg.norm(a) * np.linalg.norm(b):
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    return [(links[i], find(i), find(i) == i) for i in range(n)]


def corpus(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    out = [None, [0.0] * dim, [], [1.0, None] * (dim // 2), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [3.0], [5.0], [-1.0]]
    for _ in range(30):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 6)):
            out.append((rng.uniform(0.01, 50) * (base + 0.12 * rng.standard_normal(dim))).tolist())
    return out + [out[20], out[20], out[20]]


def run(spark, vectors, **kw):
    df = spark.createDataFrame([(i, v, i % 3, "clash", 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, **kw).collect()}
    return [rows[i] for i in range(len(vectors))]


def test_against_brute_force_with_whole_lists(spark):
    vectors = corpus()
    assert run(spark, vectors) == brute(vectors)


def test_hot_filters_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    vectors = [(base + 0.1 * rng.standard_normal(16)).tolist() for _ in range(80)]
    assert run(spark, vectors, cell=8) == brute(vectors)


def test_top_words_are_exact():
    rng = np.random.default_rng(2)
    code = ProductCode(12, 600, 10, seed=3)
    x = rng.standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ code.turn
    score = [y[:, a:b] @ c.T for a, b, c in zip(code.cut, code.cut[1:], code.codes, strict=False)]
    whole = score[0]
    for s in score[1:]:
        whole = (whole[:, :, None] + s[:, None, :]).reshape(len(x), -1)
    want = np.sort(np.argsort(-whole, axis=1)[:, :10], axis=1)
    assert (np.sort(code.decode(x), axis=1) == want).all()


def test_recall_at_the_threshold():
    """Pairs of cosine 0.95 in 64 dimensions share a filter of a code for some 50,000 vectors in over 9 of 10 cases."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((2000, 64))
    z -= np.sum(z * x, 1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    codes = [ProductCode(64, 50_000 * m.EACH // m.LOAD, m.EACH, seed) for seed in range(m.CODES)]
    a, b = m.filters_of(x, codes), m.filters_of(y, codes)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) > 0.97


def test_empty_and_repeated_ids(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 4


def test_first_shared_filter_in_blocks():
    rng = np.random.default_rng(3)
    filters = np.sort(rng.integers(0, 60, (50, 12)), axis=1)
    a, b = np.triu_indices(50, 1)
    want = [min(set(filters[i]) & set(filters[j]), default=np.iinfo(np.int64).max) for i, j in zip(a, b, strict=True)]
    assert m_first(filters, a, b, 100).tolist() == want


def test_more_filters_for_more_vectors():
    assert [filters_each(n) for n in (0, 10**3, 10**6, 10**8, 10**9)] == [10, 10, 10, 17, 20]
