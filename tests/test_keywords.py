"""Keyword queries on hand-made pages."""

import duckdb
import pytest

from plumbline.plans import text


@pytest.mark.parametrize("name", ["keyword_priorities", "keyword_score"])
def test_whole_texts_count(spark, tmp_path, name):
    """Phrases that a page has far behind its first 4,000 characters only."""
    page = lambda title, end: f"<html><head><title>{title}</title></head><body><p>{'the of and ' * 900}{end}</p></body></html>"
    rows = [(k, f"https://site.example/{k}", page("Zebra" if k < 2 else "Plain", "zebra migration " * 40 + "steppe. ")) for k in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = text.QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(text.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(tuple(r[k] for k in at) for r in rel.fetchall())
    if name == "keyword_priorities":
        assert {"zebra migration", "migration", "steppe"} <= {r[0] for r in got}
    else:
        assert [r[sorted(df.columns).index("keywords")] for r in got] == [len({"zebra", "plain", "migration", "steppe", "zebra migration", "migration zebra", "migration steppe", "zebra migration zebra", "migration zebra migration", "zebra migration steppe"})]
