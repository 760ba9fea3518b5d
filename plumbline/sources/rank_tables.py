"""Rank tables that are kept: tracked keywords, snapshots and runs, bucketed by keyword, with their keys and bounds checked at every write.

A snapshot table is partitioned by the batch that brought its rows, and a batch that is written again replaces itself, so a retried job changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYWORD_KEY = ["site_id", "query", "country", "device"]
#: What a row of each table must meet.
CHECKS = {
    "keywords": "keyword_id is not null and site_id is not null and query is not null and device in ('desktop', 'mobile')",
    "snapshots": "keyword_id is not null and checked_at is not null and (position is null or position between 1 and 100)",
    "runs": "job is not null and run_day is not null",
}
_COLUMNS = {
    "keywords": "keyword_id bigint, site_id string, query string, country string, device string, active boolean, created_at timestamp",
    "snapshots": "keyword_id bigint, snapshot_id bigint, checked_at timestamp, position int, ranking_url string, batch_id bigint",
    "runs": "job string, run_day date, batch_id bigint",
}


@dataclass
class RankTables:
    """The three tables of one place, by names that begin with ``prefix``."""

    spark: SparkSession
    prefix: str
    where: str
    buckets: int = 16

    def create(self) -> RankTables:
        kind = {
            "keywords": f"clustered by (keyword_id) sorted by (keyword_id) into {self.buckets} buckets",
            "snapshots": f"partitioned by (batch_id) clustered by (keyword_id) into {self.buckets} buckets",
            "runs": "partitioned by (batch_id)",
        }
        for name, columns in _COLUMNS.items():
            self.spark.sql(f"create table if not exists {self.prefix}_{name} ({columns}) using parquet {kind[name]} location '{self.where}/{name}'")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def _checked(self, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        """The rows as the table has them; an error if one breaks the table's rule or its key."""
        rows = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _COLUMNS[name].split(", ")])
        bad = rows.agg(F.count_if(~F.coalesce(F.expr(CHECKS[name]), F.lit(False))).alias("n")).first()["n"]
        twice = rows.groupBy(*key).count().where("count > 1").limit(1).count()
        if bad or twice:
            raise ValueError(f"{name}: {bad} rows break {CHECKS[name]}" if bad else f"{name}: rows with one {', '.join(key)}")
        return rows

    def _replace(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Replace one batch of a table, and no other."""
        laid = rows.drop("batch_id")
        laid = laid.repartition(self.buckets, "keyword_id") if "keyword_id" in rows.columns else laid
        self.spark.sql(f"insert overwrite table {self.prefix}_{name} partition (batch_id = {int(batch_id)}) select * from {{rows}}", rows=laid)

    def track(self, rows: DataFrame, most: int | None = None) -> int:
        """Add keywords whose site, query, country and device are new, up to ``most`` a site; how many were added.

        ``keywords`` is written anew as a whole, from a copy that is read before.
        """
        from plumbline.operators.links import _cut

        now = self.table("keywords")
        new = rows.join(now.select(*KEYWORD_KEY).hint("merge"), KEYWORD_KEY, "left_anti")
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYWORD_KEY).orderBy("keyword_id"))).where("_n = 1").drop("_n")
        if most is not None:
            had = now.groupBy("site_id").agg(F.count("*").alias("_had"))
            place = F.row_number().over(Window.partitionBy("site_id").orderBy("created_at", "keyword_id"))
            new = new.withColumn("_n", place).join(had.hint("merge"), "site_id", "left").where(F.col("_n") + F.coalesce("_had", F.lit(0)) <= most).drop("_n", "_had")
        new = _cut(self._checked("keywords", new, ["keyword_id"]))
        both = _cut(now.unionByName(new))
        self._checked("keywords", both, KEYWORD_KEY)
        both.repartition(self.buckets, "keyword_id").write.mode("overwrite").insertInto(f"{self.prefix}_keywords")
        return new.count()

    def append(self, snapshots: DataFrame, batch_id: int, job: str = "daily", run_day: str = "1970-01-01") -> None:
        """Add the snapshots of one batch, and note its run; a batch that comes again replaces what it brought."""
        rows = snapshots.withColumn("batch_id", F.lit(batch_id))
        self._replace("snapshots", self._checked("snapshots", rows, ["keyword_id", "snapshot_id"]), batch_id)
        run = self.spark.range(1).select(F.lit(job).alias("job"), F.lit(run_day).cast("date").alias("run_day"), F.lit(batch_id).cast("long").alias("batch_id"))
        self._replace("runs", self._checked("runs", run, ["job", "run_day"]), batch_id)

    def last_checked(self) -> DataFrame:
        """Every tracked keyword with its checks: ``keyword_id, site_id, query, checks, last_checked_at``; both sides are read by bucket, so nothing is shuffled."""
        seen = self.table("snapshots").groupBy("keyword_id").agg(F.count("*").alias("checks"), F.max("checked_at").alias("last_checked_at"))
        rows = self.table("keywords").join(seen.hint("merge"), "keyword_id", "left")
        return rows.select("keyword_id", "site_id", "query", F.coalesce("checks", F.lit(0)).alias("checks"), "last_checked_at")
