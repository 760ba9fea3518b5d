import hashlib
import random
import re
from collections import Counter

import pytest

from plumbline.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, h string, pos int"


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, **kw).collect()}
    return [rows[i] for i in range(len(texts))]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "é x", "the", "ß", "\x1c", "word,"] + [f"w{k}" for k in range(60)]
    passage = [rng.choice(vocab) for _ in range(50)]
    texts = [None, "", "  \n", "one", "same " * 90, " wide"]
    for k in range(40):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 160))]
        if k % 3 == 0:
            at = rng.randrange(len(body) + 1)
            cut = rng.randrange(30, 51)
            body[at:at] = passage[:cut]
        texts.append(rng.choice([" ", "\n", " \t "]).join(body))
    texts += [texts[10], texts[10], " ".join(passage[2:37]), " ".join(passage[:34])]
    assert run(spark, texts) == brute(texts, 35)


def test_small_window_and_overlap(spark):
    texts = ["x x x x x x", "a b c d e f g", "q a b c d e", "a b c d", "x"]
    assert run(spark, texts, window=5, period=3, cover=(0, 1)) == brute(texts, 5)


def test_long_text_is_whole(spark):
    rng = random.Random(1)
    long = [f"t{rng.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(long), " ".join(long[59_900:]), "short"]
    assert run(spark, texts) == brute(texts, 35)


def test_empty_table_and_null_id(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    t = " ".join(f"w{k}" for k in range(40))
    rows = substring_dedup(spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in rows} == {(None, 40), (1, 40)}


def test_cover_is_checked(spark):
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([], SCHEMA), cover=(0, 1))
