import random

import pytest

from plumbline.operators import greedy


def likeness(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def key(text):
    return " ".join(sorted(set(text.split())))


def some(rng, n, words="abcdefg", most=5):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, most))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_in_order_is_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(site, k, rng.randrange(30), key(t), rng.choice(["", "", "x", "y", "z", None])) for site in ("s", "t") for k, t in enumerate(some(rng, 60))]
    rows += [("hot", k, k, "a b", "q") for k in range(50)]
    old = [("s", key("a b c")), ("t", ""), ("t", "g")]
    want = set()
    for site in ("s", "t", "hot"):
        kept = []
        for _, i, _, t, q in sorted((r for r in rows if r[0] == site), key=lambda r: (r[2], r[1])):
            if not any(likeness(t, e) >= 0.6 for s, e in old if s == site) and not any(likeness(t, k) >= 0.6 or (q and q == p) for k, p in kept):
                kept.append((t, q))
                want.add((site, i))
    df = spark.createDataFrame(rows, "site_id string, id int, ord int, set string, label string")
    got = greedy.kept_in_order(df, spark.createDataFrame(old, "site_id string, set string"), 0.6).collect()
    assert len(got) == len(rows) and {(r.site_id, r.id) for r in got if r.kept} == want


@pytest.mark.parametrize("stretch", [7, 4096])
def test_leader_groups_are_the_loop(spark, monkeypatch, stretch):
    monkeypatch.setattr(greedy, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = [(site, k, key(t), rng.randrange(50)) for site in ("s", "t") for k, t in enumerate(some(rng, 70, "abcdef"))]
    rows += [("hot", k, "a b c", rng.randrange(9)) for k in range(40)] + [("chain", k, key(f"w{k} w{k + 1} w{k + 2}"), k) for k in range(12)]
    want = {}
    for site in ("s", "t", "hot", "chain"):
        groups = []
        for _, k, t, size in (r for r in rows if r[0] == site):
            g = next((g for g in groups if likeness(g["t"], t) >= 0.5), None)
            if g is None:
                groups.append({"t": t, "size": size, "first": k})
                g = groups[-1]
            elif size > g["size"]:
                g["t"], g["size"] = t, size
            want[site, k] = g["first"]
    df = spark.createDataFrame(rows, "site_id string, ord long, set string, size long")
    assert {(r.site_id, r.ord): r.leader for r in greedy.leader_groups(df).collect()} == want


def test_similar_sets_are_all_pairs(spark):
    rng = random.Random(3)
    sets = sorted({key(t) for t in some(rng, 60, "abcdefgh", 7)})
    df = spark.createDataFrame([("s", t) for t in sets] + [("t", "a b")], "site_id string, set string")
    for least in (0.5, 0.6):
        got = {(r.a, r.b) for r in greedy.similar_sets(df, least).collect() if r.site_id == "s"}
        assert got == {(a, b) for a in sets for b in sets if likeness(a, b) >= least}


def test_alternated_and_free_places(spark):
    rng = random.Random(4)
    plans = {s: [(k, rng.choice(["a", "A", "b", "c", None])) for k in range(rng.randrange(1, 25))] for s in range(12)}
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s, p) for s, p in plans.items()], "s int, plan array<struct<k:int,kind:string>>")
    got = {r.s: [x.k for x in r.p] for r in df.select("s", greedy.alternated(F.col("plan"), "kind").alias("p")).collect()}
    for s, pool in plans.items():
        pool, out = list(pool), []
        while pool:
            last = (out[-1][1] or "").lower() if out else ""
            out.append(pool.pop(next((i for i, t in enumerate(pool) if (t[1] or "").lower() != last), 0)))
        assert got[s] == [k for k, _ in out]
    rows = spark.createDataFrame([(s, n) for s in range(5) for n in range(1, 9)], "site_id int, n int")
    taken = [(s, rng.randrange(-2, 14)) for s in range(4) for _ in range(rng.randrange(9))]
    places = {(r.site_id, r.n): r.place for r in greedy.free_places(rows, spark.createDataFrame(taken + taken[:2], "site_id int, n int")).collect()}
    for s in range(5):
        free = [d for d in range(1, 40) if (s, d) not in taken]
        assert [places[s, n] for n in range(1, 9)] == free[:8]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "site_id string, id int, ord int, set string, label string")
    assert greedy.kept_in_order(rows, rows.select("site_id", "set"), 0.6).collect() == []
    assert greedy.leader_groups(spark.createDataFrame([], "site_id string, ord long, set string, size long")).collect() == []


def test_few_candidates_and_long_sets(spark):
    """Sets that share frequent words in pairs only are not compared; sets of more words than are joined at once are found too."""
    rng = random.Random(5)
    short = sorted({key(" ".join(rng.sample([f"w{k}" for k in range(30)], 4))) for _ in range(400)})
    long = [key(" ".join(rng.sample([f"v{k}" for k in range(22)], rng.randrange(9, 20)))) for _ in range(60)]
    sets = sorted({*short, *long})
    df = spark.createDataFrame([("s", t) for t in sets], "site_id string, set string")
    want = {(a, b) for a in sets for b in sets if likeness(a, b) >= 0.5}
    assert {(r.a, r.b) for r in greedy.similar_sets(df, 0.5).collect()} == want
    found = greedy.candidates(df.selectExpr("*", "split(set, ' ') as words"), 0.5).where("size(split(a, ' ')) = 4 and size(split(b, ' ')) = 4").count()
    assert found == sum(a < b and len(a.split()) == len(b.split()) == 4 for a, b in want)


def test_leader_groups_write_as_often_for_long_chains(spark, monkeypatch):
    """Decisions that each wait for the one before are gone through in one piece, and groups are handed on from stretch to stretch."""
    cuts = []
    monkeypatch.setattr(greedy, "_cut", lambda df, cut=greedy._cut: cuts.append(1) or cut(df))
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(48):
        rows.append(("s", k, key(f"w{k:02} w{k + 1:02} w{k + 2:02}"), rng.randrange(6) if k % 3 else 10 + k))
    rows += [("s", 100 + k, key(f"w{k:02} w{k + 1:02} w{k + 2:02}"), 200 - k) for k in range(0, 48, 5)] + [("s", 200, "", 1), ("s", 201, "alone", 1)]
    groups = []
    for _, k, t, size in rows:
        g = next((g for g in groups if likeness(g["t"], t) >= 0.5), None)
        if g is None:
            groups.append({"t": t, "size": size, "first": k})
            g = groups[-1]
        elif size > g["size"]:
            g["t"], g["size"] = t, size
        want[k] = g["first"]
    df = spark.createDataFrame(rows, "site_id string, ord long, set string, size long")
    assert {r.ord: r.leader for r in greedy.leader_groups(df).collect()} == want
    assert len(cuts) <= 8
    monkeypatch.setattr(greedy, "STRETCH", 20)
    assert {r.ord: r.leader for r in greedy.leader_groups(df).collect()} == want
