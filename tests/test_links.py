import random
import re

import pytest

from plumbline.operators import competitors, links
from plumbline.plans import ranks


def test_pages_deeper_than_64_clicks_are_reached_and_sites_stay_apart(spark):
    pages = spark.createDataFrame([(s, k, k == 1) for s in ("a", "b") for k in range(1, 73)], "site_id string, page long, is_start boolean")
    edges = spark.createDataFrame([("a", k, k + 1) for k in range(1, 71)] + [("b", 1, 9), ("b", 9, 1)], "site_id string, src long, dst long")
    got = {(r.site_id, r.page): r.depth for r in links.click_depth(pages, edges).collect()}
    assert got == {("a", k): k - 1 for k in range(1, 72)} | {("b", 1): 0, ("b", 9): 1}
    assert {(r.site_id, r.page) for r in links.orphans(pages, edges).collect()} == {("a", 72)} | {("b", k) for k in range(2, 73) if k != 9}


def test_labels_that_have_not_settled_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a long, b long")
    assert {r.root for r in competitors.connected(edges).collect()} == {1}
    with pytest.raises(RuntimeError):
        competitors.connected(edges, most=1)


def test_link_candidates_by_blocks(spark, monkeypatch):
    """Cells of blocks give what comparing all pairs gives, however small blocks, columns and strips are."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    rows = [(s, p, sorted(rng.sample(words, rng.randint(0, 6)))) for s in ("a", "b") for p in range(23)]
    weak = [(s, p) for s, p, _ in rows if p % 3]
    got = {}
    for block, columns, strip in ((1000, 1024, 512), (4, 3, 2)):
        monkeypatch.setattr(links, "COLUMNS", columns)
        monkeypatch.setattr(links, "STRIP", strip)
        df = links.link_candidates(spark.createDataFrame(weak, "site_id string, page long"), spark.createDataFrame(rows, "site_id string, page long, words array<string>"), 3, block)
        assert df.columns == ["site_id", "page", "place", "source", "percent"]
        got[block] = sorted(map(tuple, df.collect()))
    want = []
    for s, p in weak:
        mine = next(set(w) for a, b, w in rows if (a, b) == (s, p))
        near = sorted((-int(len(mine & set(w)) / len(mine | set(w)) * 100 + 0.5), q) for a, q, w in rows if a == s and q != p and mine & set(w))
        want += [(s, p, n + 1, q, -x) for n, (x, q) in enumerate(near[:3])]
    assert got[1000] == got[4] == sorted(want)


def test_a_long_way_settles_in_few_rounds(spark):
    """Labels hook as a whole: a chain in random order needed a round for each few steps before."""
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.root for r in competitors.connected(edges, most=8).collect()} == {0}


def test_edges_that_come_once_are_grouped_once(spark):
    """inbound_links kept its edges in four tables of a task: to drop repeats, twice to tell sources apart, and by target."""
    edges = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 3, 2), ("a", 2, 2), ("a", None, 2), ("b", 1, 2), ("b", 2, 1)], "site_id string, src long, dst long")
    want = {("a", 2, 2, 2, 1), ("b", 2, 1, 1, 1), ("b", 1, 1, 1, 2)}
    assert {tuple(r) for r in links.inbound(edges.distinct(), unique=True).collect()} == {tuple(r) for r in links.inbound(edges.distinct()).collect()} == want
    assert {tuple(r) for r in links.inbound(edges).collect()} == want - {("a", 2, 2, 2, 1)} | {("a", 2, 3, 2, 1)}
    plan = ranks.inbound_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    by_edge = [x for x in re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan) if "src" in x]
    assert len(by_edge) == 2 and "count(distinct" not in plan  # before and after the shuffle that drops repeats
