import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import token_counts
from plumbline.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string, extra int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts(texts):
    return token_counts.compiled(PATH).counts(texts).tolist()


def expected(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


EDGES = [
    "", " ", "don't stop: 12.5% — ÉCOLE x́ <|endoftext|>x", "ΑΣ σας ΣΑΣ\x1cb", "''s 'rex 're 'r 'v 've've !'s it's'll'l 'L 'LL", "'", "'r", "'l'", "''ll",
    "<|startoftext|><|endoftext|", "<|ENDOFTEXT|>", "İstanbul ǅ ﬁ ½ ² Ⅷ ٣", "日本語 テキスト 한국어", "ẛ̣ é Å İ", "🙂🙂 👩‍👩‍👧", "x\u0085y z q​w", "\x00\x1f", "a" * 5000, "ab" * 3000,
]


def test_edges(library):
    assert counts(EDGES) == expected(library, EDGES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("'strevldm a1!é<|>\n", max_size=60), st.text("aethinosr", max_size=80)), min_size=1, max_size=5))
def test_any_text(texts):
    assert counts(texts) == expected(Tokenizer.from_file(PATH), texts)


def test_whole_planes_of_code_points(library):
    texts = ["".join(chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 64)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0x3000) if c]
    assert counts(texts) == expected(library, texts)


def test_lanes_and_spans_do_not_change_counts(library, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab 'strl!1é\n") for _ in range(6000)) + "x" * 900 + " 'll"
    want = expected(library, [text, "b", text[::-1]])
    for span, lane in ((64, 1), (300, 7), (1 << 20, 128)):
        monkeypatch.setattr(token_counts, "SPAN", span)
        monkeypatch.setattr(token_counts, "LANE", lane)
        assert counts([text, "b", text[::-1]]) == want


def test_prefix_composition_of_maps():
    maps = np.random.default_rng(0).integers(0, 7, (37, 7)).astype(np.uint8)
    got = token_counts.composed(maps)
    state = np.arange(7)
    for k in range(37):
        state = maps[k][state]
        assert (got[k] == state).all()


def test_machine_is_dropped_when_full(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "LONG", 6)
    texts = [f"word{k} recompilation of extraordinary things {k * k}" for k in range(200)]
    assert [counts([t])[0] for t in texts] == expected(library, texts)


def test_rows(spark, library):
    texts = [None, *EDGES, "to be " * 1023 + "to be", "to be " * 1024 + "x"]
    rows = [(k, t, "clash", 0) for k, t in enumerate(texts)] + [(None, "a b", "", 0), (3, texts[3], "", 0)]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    want = [(k, len((t or "").encode()), n, n > 2048) for (k, t, *_), n in zip(rows, expected(library, [r[1] or "" for r in rows]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.over_limit for r in got} == {False, True}
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_given_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    want = {r.doc_id: (len(r.text.encode()), n) for r, n in zip(docs, expected(library, [r.text for r in docs]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.query(spark, "/root/testdata/sf0.01").collect()} == want
