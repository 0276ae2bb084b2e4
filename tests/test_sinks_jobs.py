"""Sinks (write and read back) and the end-to-end jobs."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, same_rows
from viewlens.config import fixture_config
from viewlens.plans.jobs import impression_job, placement_job
from viewlens.plans.registry import all_queries
from viewlens.sources.fixtures import FixtureLogs
from viewlens.sources.sinks import publish, stage


def test_publish_replaces_and_reads_back(spark, tmp_path):
    df = spark.range(100).withColumn("transaction_nbr", F.col("id") % 7)
    out = publish(df, "t1", path=str(tmp_path / "t1"))
    assert out.count() == 100
    out2 = publish(df.limit(10), "t1", path=str(tmp_path / "t1"))
    assert out2.count() == 10
    small = publish(df.groupBy("transaction_nbr").count(), "s", path=str(tmp_path / "s"), laid_out=True)
    assert small.count() == 7
    stage(out2, "t1_view")
    assert spark.table("t1_view").count() == 10


def test_publish_to_work_dir_and_bucketed_table(spark):
    df = spark.range(50).withColumn("transaction_nbr", F.col("id") % 5)
    assert publish(df, "wd_table").count() == 50
    t = publish(df, "bucketed_tx", as_table=True, buckets=4, analyze=True)
    assert t.count() == 50
    spark.sql("DROP TABLE IF EXISTS bucketed_tx")


def test_impression_job_matches_registered_queries(spark):
    logs = FixtureLogs(spark, SF_SMALL)
    out = impression_job(logs.ads, logs.bids, logs.notify, logs.events, fixture_config(), prefix="job_")
    q = all_queries()
    for name in ("transactions", "impression_detail", "issue_rows", "clean_impressions", "browser_summary",
                 "issue_crosstab", "event_rollup_checked", "features", "transactions_multiplicity", "multi_row_count"):
        want = q[name](spark, SF_SMALL)
        assert same_rows(want, out[name]), name


def test_placement_job_matches_registered_queries(spark):
    out = placement_job(FixtureLogs(spark, SF_SMALL).placements, prefix="pjob_", drill=("1", "1"))
    q = all_queries()
    for name in ("daily_summary", "publisher_summary", "placement_summary", "publishers_per_placement",
                 "placement_series", "chart_series"):
        want = q[name](spark, SF_SMALL)
        assert same_rows(want, out[name]), name


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "impressions" in df.columns


def test_bucketed_job_joins_detail_without_shuffle(spark):
    from viewlens.plans import detail as D
    cfg = fixture_config()
    logs = FixtureLogs(spark, SF_SMALL)
    out = impression_job(logs.ads, logs.bids, logs.notify, logs.events, cfg, prefix="bk_", buckets=4)
    tx, summary = spark.table("bk_transactions"), spark.table("bk_event_summary")
    detail = D.impression_detail(tx, summary, cfg)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as at scale: no broadcast
    try:
        plan = D.impression_detail(tx, summary, cfg)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dt_, is_ = spark.table("bk_impression_detail"), spark.table("bk_issue_rows")
        plan2 = D.clean_impressions(dt_, cfg, is_)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "LeftAnti" in plan2 and "Exchange" not in plan2, plan2
    assert same_rows(all_queries()["impression_detail"](spark, SF_SMALL), detail)
    assert same_rows(all_queries()["clean_impressions"](spark, SF_SMALL), out["clean_impressions"])
    for t in ("bk_transactions", "bk_event_summary", "bk_impression_detail", "bk_issue_rows"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_publish_without_the_cluster_key(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "placement_id")
    assert publish(df, "no_key", path=str(tmp_path / "nk")).count() == 10


def test_publishing_a_laid_out_frame_adds_no_shuffle(spark, tmp_path, monkeypatch):
    """A frame grouped by the key is written with its own shuffle only; the hint adds a second one."""
    from pyspark.sql.classic.dataframe import DataFrame
    plans = []
    write = DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(
        lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), write(self))[1]))
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("transaction_nbr")).count()
    publish(df, "one", path=str(tmp_path / "one"), laid_out=True)
    publish(df, "two", path=str(tmp_path / "two"))
    assert [p.count("Exchange") for p in plans] == [1, 2]


def test_published_schema_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "transaction_nbr long, day string")
    assert publish(df, "typed", path=str(tmp_path / "typed")).schema == df.schema
