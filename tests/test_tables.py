import datetime

import pytest

from plumbline.sources.rank_tables import RankTables

DAY = datetime.datetime(2024, 1, 1)
KEYWORDS = "keyword_id long, site_id string, query string, country string, device string, active boolean, created_at timestamp"
SNAPSHOTS = "keyword_id long, snapshot_id long, checked_at timestamp, position int, ranking_url string"


@pytest.fixture
def kept(spark, tmp_path, request):
    return RankTables(spark, f"t_{abs(hash(request.node.name))}", f"file://{tmp_path}", 4).create()


def keyword(k, site="s", query=None, device="desktop"):
    return k, site, query or f"q{k}", "ken", device, True, DAY


def test_keywords_are_tracked_once(spark, kept):
    assert kept.track(spark.createDataFrame([keyword(1), keyword(2), keyword(3, query="q1"), keyword(4, site="t")], KEYWORDS)) == 3
    assert kept.track(spark.createDataFrame([keyword(5, query="q2"), keyword(6), keyword(7), keyword(8, site="t")], KEYWORDS), 3) == 2
    assert {r.keyword_id for r in kept.table("keywords").collect()} == {1, 2, 4, 6, 8}
    with pytest.raises(ValueError, match="keywords: 1 rows"):
        kept.track(spark.createDataFrame([keyword(9, device="watch")], KEYWORDS))
    with pytest.raises(ValueError, match="keyword_id"):
        kept.track(spark.createDataFrame([keyword(10), keyword(10, query="other")], KEYWORDS))


def test_a_batch_that_comes_again_replaces_itself(spark, kept):
    kept.track(spark.createDataFrame([keyword(k) for k in range(8)], KEYWORDS))
    first = spark.createDataFrame([(1, 1, DAY, 3, None), (2, 2, DAY, None, "u")], SNAPSHOTS)
    second = spark.createDataFrame([(1, 3, datetime.datetime(2024, 1, 5), 100, None)], SNAPSHOTS)
    for rows, batch in ((first, 1), (second, 2), (first, 1)):
        kept.append(rows, batch, run_day=f"2024-01-0{batch}")
    assert sorted((r.keyword_id, r.snapshot_id, r.batch_id) for r in kept.table("snapshots").collect()) == [(1, 1, 1), (1, 3, 2), (2, 2, 1)]
    assert {(r.checks, str(r.last_checked_at)) for r in kept.last_checked().where("keyword_id in (1, 5)").collect()} == {(2, "2024-01-05 00:00:00"), (0, "None")}
    assert kept.table("runs").count() == 2
    with pytest.raises(ValueError, match="snapshots"):
        kept.append(spark.createDataFrame([(1, 9, DAY, 101, None)], SNAPSHOTS), 3)
    assert kept.table("snapshots").count() == 3


def test_joins_by_keyword_shuffle_nothing(spark, kept):
    kept.track(spark.createDataFrame([keyword(k) for k in range(50)], KEYWORDS))
    kept.append(spark.createDataFrame([(k % 50, k, DAY, 1, None) for k in range(200)], SNAPSHOTS), 1)
    plan = kept.last_checked()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
