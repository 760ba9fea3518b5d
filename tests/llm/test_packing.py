import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.packing import CapacityTree, best_fit, pack, powers_of_two, public_tokenizer

SCHEMA = "doc_id long, text string, start string, length int"


def corpus():
    rng = random.Random(2)
    texts = [None, "", " \n", "don't stop: 12.5% — ÉCOLE x́ <|endoftext|>x", "ΑΣ σας ΣΑΣ\x1cb", "a" * 5000]
    for _ in range(120):
        texts.append(" ".join(rng.choice(["the", "Tree", "naïve,", "ß", f"w{rng.randrange(999)}"]) for _ in range(rng.randrange(0, 400))))
    texts.append(" ".join(f"n{k}" for k in range(9000)))
    return texts + [texts[7]]


def check(rows, texts, window):
    encoder = Tokenizer.from_file(public_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = np.array(encoder.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes()))
            assert r.length > 0 and r.ids == own.tolist()
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize(("window", "group"), [(4096, 1 << 22), (256, 3000)])
def test_round_trip_and_padding(spark, window, group):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert check(pack(df, public_tokenizer(), window=window, group_tokens=group, with_ids=True).collect(), texts, window) == 0


def test_words_are_forgotten_and_encoded_again(spark, monkeypatch):
    t = packing.WordTokenizer(public_tokenizer(), 2)
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    import pyarrow as pa

    texts = corpus()[:40]
    whole = Tokenizer.from_file(public_tokenizer())
    for at in range(0, 40, 8):
        ids, stop = t.encode(pa.array(texts[at : at + 8], pa.string()))
        for d, x in enumerate(texts[at : at + 8]):
            assert ids[stop[d] : stop[d + 1]].tolist() == whole.encode(x or "", add_special_tokens=False).ids + [2]


def test_capacity_tree_finds_the_tightest():
    rng = random.Random(6)
    tree, rooms = CapacityTree(100), []
    for _ in range(2000):
        if rooms and rng.random() < 0.5:
            x = rooms.pop(rng.randrange(len(rooms)))
            tree.add(x, -1)
        else:
            x = rng.randrange(1, 101)
            rooms.append(x)
            tree.add(x, 1)
        need = rng.randrange(1, 101)
        assert tree.tightest(need) == min((r for r in rooms if r >= need), default=-1)


def test_windows_are_full_and_few_documents_are_cut():
    rng = random.Random(7)
    lengths = [rng.randrange(1, 900) for _ in range(400)] + [5000, 4096, 8192]
    *full, last = best_fit(lengths, 4096)
    assert all(sum(n for _, _, n in w) == 4096 for w in full) and sum(n for _, _, n in last) <= 4096
    assert sum(n for w in [*full, last] for _, _, n in w) == sum(lengths)
    assert sum(len(w) for w in [*full, last]) < len(lengths) + 40
    assert all((s := sum(n for _, _, n in w)) & (s - 1) == 0 for w in powers_of_two(last))


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA), public_tokenizer()).collect() == []
    rows = pack(spark.createDataFrame([(None, None), (1, "x")], "doc_id long, text string"), public_tokenizer()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows)[0][0] == 0 and sum(r.length for r in rows) == 3
