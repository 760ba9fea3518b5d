import random
import zlib

import duckdb
import numpy as np
import pytest

from plumbline.llm import toxicity as m

SCHEMA = "doc_id long, text string, score string, toxic string, held_out int"


def brute_kernel(a, b):
    def features(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + 3 + m.GAP)):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + m.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_against_brute_force():
    left, right = ["idiot", "i-d-iot", "straße", "a", "😀x", "banana"], ["idiots", "idol", "strasse", "ananas"]
    want = [[brute_kernel(a, b) for b in right] for a in left]
    assert np.allclose(m.kernel(left, right), want, atol=1e-6)
    assert m.kernel(["idiot"], ["idxiot"])[0, 0] > 0.5 > m.kernel(["idiot"], ["house"])[0, 0]


def test_folded_weights_equal_the_landmark_sum():
    landmarks, alpha = ["moron", "clown", "the"], np.array([1.5, 0.5, -2.0])
    words = ["moron", "morons", "cl*own", "them", "x"]
    got = m._folded(landmarks, alpha, 0.25).word_scores(words)
    assert np.allclose(got, m.kernel(words, landmarks) @ alpha + 0.25, atol=1e-5)


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(1500)]
    bad = ["idiot", "worthless", "scumbag"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        toxic = int(k % 5 == 0)
        for _ in range(toxic * rng.randrange(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(bad).capitalize() + rng.choice(["", ",", "!"]))
        rows.append((k, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t, _ in rows] + [(9000, None, "", "", 0), (9001, " ", "", "", 0), (9001, " ", "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 0, t) for i, _, t in rows] + [(9000, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, m.toxicity(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows, got = scored
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(t, by[i].predicted) for i, _, t in rows if by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(held) > 100


def test_inserted_characters():
    rows = corpus()
    machine = m.train([t for _, t, _ in rows], [y for *_, y in rows])
    p = machine.scores(["such an i.d.i.o.t here", "an i d i o t here", "idixot", "wor*thless", "lane ruse", "", None])
    assert (p[:4] > 0.3).all() and (p[4:] < 0.3).all()


def test_no_labels_empty_and_one_kind(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 1e-6 for r in m.toxicity(docs, none).collect()} == {True}
    ones = spark.createDataFrame([(k, 0, 1) for k in (1, 2)], "doc_id long, quality int, toxic int")
    assert len(m.toxicity(docs, ones).collect()) == 3
    assert m.toxicity(docs.limit(0), ones).collect() == []


def labelled(sf):
    con = duckdb.connect()
    rows = con.sql(f"select doc_id, text, toxic from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id) where toxic in (0, 1)").fetchall()
    rows.sort(key=lambda r: (zlib.crc32(f"order {r[0]}".encode()), r[0]))
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    return [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]


def test_held_out_accuracy_on_given_tables():
    """With 329 toxic texts to learn from; some held-out ones hold nothing that tells them from clean ones."""
    learn, held = labelled("/root/testdata/sf0.1")
    sample = [[r for r in learn if r[2] == k][: m.LABELLED // 2] for k in (0, 1)]
    machine = m.train([r[1] for s in sample for r in s], [r[2] for s in sample for r in s], sum(r[2] for r in learn) / len(learn))
    p = machine.scores([r[1] for r in held])
    toxic = np.array([r[2] for r in held]) == 1
    caught = p >= m.CUT
    assert caught[toxic].mean() >= 0.9
    assert toxic[caught].mean() >= 0.9


def test_very_long_words_and_texts():
    rows = corpus()
    machine = m.train([t for _, t, _ in rows], [y for *_, y in rows])
    long = "lane " * 200_000
    p = machine.scores(["x" * 300_000, "ab" * 100_000 + "idiot" + "ab" * 100_000, long, long + "idiot"])
    assert (p >= 0).all() and (p <= 1).all()
    assert all(len(w) <= m.LONG for w in m.words_of("y" * 1000 + "z" * 1000))


def test_scores_against_a_direct_computation():
    """The kernel sum over landmarks, pooled word by word and put through the curve, without hashing of triples or memory."""
    rows = corpus(300)
    seen = []
    fitted = m._folded

    def spy(landmarks, alpha, bias):
        seen.append((landmarks, alpha, bias))
        return fitted(landmarks, alpha, bias)

    m._folded = spy
    try:
        machine = m.train([t for _, t, _ in rows], [y for *_, y in rows])
    finally:
        m._folded = fitted
    landmarks, alpha, bias = seen[-1]
    for text in (rows[0][1], rows[1][1], "An idiot!", ""):
        score = sorted((sum(a * brute_kernel(w, z) for a, z in zip(alpha, landmarks, strict=True)) + bias for w in m.words_of(text)), reverse=True)
        clipped = [min(1.5, max(-1.0, s)) for s in score]
        above = sum(min(1.0, max(0.0, s)) for s in score)
        x = [*(clipped + [-1.0] * 3)[:3], np.log1p(above), 10 * above / (len(score) + 20), 1.0]
        want = 1 / (1 + np.exp(-np.dot(x, machine.curve)))
        assert abs(machine.scores([text])[0] - want) < 0.02
