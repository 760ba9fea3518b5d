import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.simhash import compare_with_edits, fingerprints, within_radius

SCHEMA = "doc_id long, text string, fp string, part int, n_chars int"


def corpus():
    rng = random.Random(8)
    texts = ["", None, "x", "é😀", "  \t ", "one two"]
    for _ in range(60):
        texts.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 300))))
    texts += [texts[-1], texts[-1], "long " * 3000]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i * 3 - 40, t, "clash", 0, 0) for i, t in enumerate(texts)], SCHEMA)


def expected(texts):
    n = len(texts)
    out = {}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""  # by descending id; after the smallest comes the largest
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        out[i * 3 - 40] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert len(out) == n
    return out


def test_edits_fingerprints_and_likeness(spark, monkeypatch):
    texts = corpus()
    for stretch in (4096, 7):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        rows = {r.doc_id: r for r in compare_with_edits(frame(spark, texts)).collect()}
        assert {k: (r.n_chars, r.edited_sha256) for k, r in rows.items()} == expected(texts)
        for i in range(len(texts)):
            r, after = rows[i * 3 - 40], rows[((i - 1) % len(texts)) * 3 - 40]
            same = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
            assert abs(r.near_edited - same(r.fingerprint, r.edited_fingerprint)) < 1e-12
            assert abs(r.near_next - same(r.fingerprint, after.fingerprint)) < 1e-12
        by_text = {}
        for i, t in enumerate(texts):
            assert by_text.setdefault((t or "").strip(), rows[i * 3 - 40].fingerprint) == rows[i * 3 - 40].fingerprint
        long = [rows[i * 3 - 40] for i in range(6, 66) if len(texts[i]) > 600]
        assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_votes_against_plain_python(spark):
    text = "a b a b c a"
    df = spark.createDataFrame([(text,)], "text string")
    hs = [h & (1 << 64) - 1 for h in df.select(simhash.term_hashes(F.col("text")).alias("t")).first().t]
    assert len(hs) == 6 and len(set(hs)) == 5
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
    got = fingerprints(df.withColumn("k", F.lit(1)), ["k"]).first().fp & (1 << 64) - 1
    assert got == want


def test_block_tables_find_every_pair(spark):
    rng = random.Random(3)
    values = {0, -1, 1 << 63 - 1}
    for _ in range(120):
        x = rng.getrandbits(64)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                y ^= 1 << b
            values |= {x, y}
    signed = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed + signed[:9] + [None]], "fp long")
    for radius in (3, 5):
        got = sorted((r.fp, r.other, r.distance) for r in within_radius(df, radius).collect())
        dist = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
        want = sorted((a, b, dist(a, b)) for a in signed for b in signed if a < b and dist(a, b) <= radius)
        assert got == want and want


def test_empty_single_repeated_and_null(spark):
    assert compare_with_edits(spark.createDataFrame([], SCHEMA)).collect() == []
    one = compare_with_edits(spark.createDataFrame([(4, "abc def ghi")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()
    many = compare_with_edits(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (1, "a")], "doc_id long, text string")).collect()
    assert len(many) == 4


def test_no_python_in_the_plan(spark):
    plan = compare_with_edits(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
