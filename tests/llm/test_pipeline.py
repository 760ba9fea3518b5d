import random

import pytest

import corpus_pipeline as p
from plumbline.llm import mixing, packing, toxicity
from tests.llm.test_jaccard_join import sets_of


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    docs, labels = [], []
    for k in range(500):
        words = [rng.choice(vocab) for _ in range(rng.randrange(8, 70))]
        toxic = int(k % 6 == 0)
        if toxic:
            words.insert(3, rng.choice(["worthless", "idiot", "scumbag"]))
        if k % 7 == 1:
            words.insert(2, f"user{k % 5}@mail.example.com")
        docs.append((k, " ".join(words), rng.choice(["en", "de"]), "hot" if k % 3 else f"s{k % 5}", 0))
        labels.append((k, 1, toxic))
        if k % 9 == 2 and not toxic:
            copy = list(words)
            copy[-1] = "changed"
            docs.append((1000 + k, " ".join(copy), "en", "hot", 0))
    docs += [docs[1], (5000, None, None, None, None), (5001, "", "en", "hot", 0)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}-{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}-{name}"))
    rows = [d.collect() for d in seen]
    assert all(tuple(d.columns) == p.COLUMNS for d in seen[1:5])
    # toxicity: exactly the rows below the cut stay
    machine = toxicity.train(*toxicity.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = machine.scores([r.text for r in rows[0]])
    assert sorted(map(str, rows[1])) == sorted(str(r) for r, s in zip(rows[0], score, strict=True) if s < toxicity.CUT)
    bad = {r.doc_id for r in rows[0] if r.doc_id < 1000 and r.doc_id % 6 == 0}
    assert len(bad & {r.doc_id for r in rows[1]}) <= 0.05 * len(bad) and len(rows[1]) >= len(rows[0]) - len(bad) - 5
    # near duplicates: no two kept rows are linked, and each dropped row is in the group of a kept one
    sets = dict(zip([r.doc_id for r in rows[1]], sets_of([r.text for r in rows[1]], p.WIDTH), strict=True))
    kept = [r.doc_id for r in rows[2]]
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= p.PERCENT * len(sets[a] | sets[b])
    assert len(kept) == len(set(kept)) and not any(linked(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(linked(d, k) and k < d for k in sets) for d in set(sets) - set(kept))
    # personal data: addresses are gone, everything else is as it was
    before, after = ({r.doc_id: r for r in x} for x in rows[2:4])
    assert before.keys() == after.keys()
    for k, r in after.items():
        old = before[k].text
        assert (r.text == old) == (old is None or "@" not in old)
        assert r.text is None or ("@mail.example" not in r.text and len(r.text) == len(old) == r.n_chars)
    # mixing: the rows that the operator draws
    want = {r.doc_id for r in mixing.mix(seen[3]).where("kept").collect()}
    assert {r.doc_id for r in rows[4]} == want and 0 < len(want) < len(rows[3])
    # packing: every id of every text lies in one piece
    ends = {}
    for r in rows[5]:
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= packing.WINDOW
    assert ends == {r.doc_id: r.doc_tokens for r in rows[5]} and ends.keys() == want


def test_run_equals_its_stages(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert "sequence_id" in out.columns and out.count() > 0 and p.ORACLE_SQL is None


def test_the_key_of_pseudonyms_comes_from_the_session(spark, sf_dir):
    docs = spark.createDataFrame([(1, "write to ann@mail.example now", "en", "s", 29)], "doc_id long, text string, lang string, source string, n_chars long")
    plain = p.hide_personal_data(spark, docs, sf_dir).first().text
    spark.conf.set(p.KEY_SETTING, "another key")
    try:
        keyed = p.hide_personal_data(spark, docs, sf_dir).first().text
    finally:
        spark.conf.unset(p.KEY_SETTING)
    assert len({plain, keyed, docs.first().text}) == 3
