"""Versions that are switched in one step, statistics taken while writing, durable views."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, same_rows
from viewlens.config import fixture_config
from viewlens.plans.jobs import impression_job, placement_job
from viewlens.sources import statistics as ST
from viewlens.sources.fixtures import FixtureLogs
from viewlens.sources.sinks import publish, publish_durable_view
from viewlens.sources.versions import current_version, drop_old_versions, read_version, versions


def failing(df):
    """The rows of ``df``, but the last of them fails when it is written."""
    return df.withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit(1)))


def test_a_write_that_fails_half_way_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "d")
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    df = spark.range(0, 100, 1, 4)
    first = publish(df.withColumn("x", F.lit(0)), "d", path=path, versioned=True)
    with pytest.raises(Exception, match="lost"):
        publish(failing(df), "d", path=path, versioned=True)
    assert read_version(spark, path).agg(F.sum("x"), F.count("x")).first() == (0, 100)
    assert first.count() == 100 and len(versions(spark, path)) == 2
    second = publish(df.withColumn("x", F.lit(2)), "d", path=path, versioned=True)
    assert read_version(spark, path).agg(F.sum("x")).first()[0] == 200 and second.count() == 100
    assert len(drop_old_versions(spark, path, keep=1)) == 2
    assert [current_version(spark, path).rsplit("/", 1)[-1]] == versions(spark, path)
    assert sorted(f for f in os.listdir(path) if not f.startswith(".")) == ["_current", *versions(spark, path)]


def test_a_dataset_is_rebuilt_from_itself(spark, tmp_path):
    path = str(tmp_path / "d")
    publish(spark.range(10), "d", path=path, versioned=True)
    for _ in range(3):
        publish(read_version(spark, path).withColumn("id", F.col("id") + 1), "d", path=path, versioned=True)
    assert sorted(r.id for r in read_version(spark, path).collect()) == list(range(3, 13))
    with pytest.raises(ValueError):
        publish(spark.range(1), "t", as_table=True, versioned=True)


def test_statistics_equal_a_full_analysis(spark, tmp_path):
    df = FixtureLogs(spark, SF_SMALL).ads.withColumn("note", F.when(F.col("transaction_nbr") % 3 == 0, "ünï")) \
        .withColumn("half", F.col("transaction_nbr") / 2).withColumn("tags", F.array("browser_desc"))
    path = str(tmp_path / "ads")
    out = publish(df, "ads", path=path, statistics=True)
    assert same_rows(df.drop("tags"), out.drop("tags"))  # the statistics' folder is no data
    got = {r["column"]: r for r in ST.read(spark, path).collect()}
    assert set(got) == set(df.columns) - {"tags"}
    out.drop("tags").write.saveAsTable("measured_ads")
    try:
        spark.sql("ANALYZE TABLE measured_ads COMPUTE STATISTICS FOR ALL COLUMNS")
        for c in got:
            full = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED measured_ads `{c}`").collect()}
            exact = out.agg(F.count(F.lit(1)), F.count_if(F.col(c).isNull()), F.min(c).cast("string"),
                            F.max(c).cast("string"), F.count_distinct(c)).first()
            r = got[c]
            assert (r.rows, r.nulls, r.least, r.greatest) == tuple(exact)[:4], c
            assert str(r.nulls) == full["num_nulls"]
            assert abs(r.distinct - exact[4]) <= max(1, 0.05 * exact[4]), (c, r.distinct, exact[4])
        assert got["note"].longest == 5
    finally:
        spark.sql("DROP TABLE measured_ads")


def test_statistics_need_no_second_scan(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    plans = []
    write = DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(
        lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), write(self))[1]))
    publish(FixtureLogs(spark, SF_SMALL).notify, "n", path=str(tmp_path / "n"), statistics=True, laid_out=True)
    assert plans[0].count("FileScan") == 1 and "CollectMetrics" in plans[0]
    assert len(plans) == 2 and "FileScan" not in plans[1]


def test_statistics_of_parts_merge(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") - 500).alias("n"), F.concat(F.lit("k"), F.col("id") % 70).alias("k"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") / 7).alias("x"))
    parts = []
    for k, part in enumerate((df.where("n < -100"), df.where("n >= -100"), df.limit(0))):
        path = str(tmp_path / str(k))
        publish(part, "p", path=path, cluster_by=None, statistics=True)
        parts.append(ST.read(spark, path))
    whole = str(tmp_path / "whole")
    publish(df, "w", path=whole, cluster_by=None, statistics=True)
    both = ST.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), df.schema)
    pick = ("column", "rows", "nulls", "least", "greatest", "longest")
    assert same_rows(ST.read(spark, whole).select(*pick), both.select(*pick))
    distinct = {r["column"]: r.distinct for r in both.collect()}
    assert all(abs(distinct[c] - n) <= 0.05 * n for c, n in (("n", 1000), ("k", 70), ("x", 500)))


def test_durable_views_are_found_by_other_sessions(spark, tmp_path):
    publish(spark.range(10).withColumn("tenant", F.col("id") % 2), "viewed", as_table=True, cluster_by=None)
    path = str(tmp_path / "at")
    publish(spark.range(6).withColumn("tenant", F.col("id") % 3), "at", path=path, cluster_by=None)
    try:
        publish_durable_view(spark, "tenant_one", "viewed", "tenant = 1")
        publish_durable_view(spark, "tenant_two", path, "tenant = 2", is_path=True)
        other = spark.newSession()
        assert sorted(r.id for r in other.table("tenant_one").collect()) == [1, 3, 5, 7, 9]
        assert sorted(r.id for r in other.table("tenant_two").collect()) == [2, 5]
        publish(spark.range(4).withColumn("tenant", F.lit(1).cast("long")), "viewed", as_table=True, cluster_by=None)
        assert other.newSession().table("tenant_one").count() == 4  # shows what is published now
        text = spark.sql("SHOW CREATE TABLE tenant_one").first()[0]
        assert "VIEW" in text and "tenant = 1" in text
    finally:
        for v in ("tenant_one", "tenant_two"):
            spark.sql(f"DROP VIEW IF EXISTS {v}")
        spark.sql("DROP TABLE IF EXISTS viewed")


@pytest.mark.parametrize("codec", ["gzip", "zstd", "snappy"])
def test_the_codec_is_the_files(spark, tmp_path, codec):
    publish(spark.range(100), "c", path=str(tmp_path / "c"), compression=codec)
    file = next(tmp_path.glob("c/part-*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == codec.upper()


def test_jobs_publish_versions_with_statistics_and_leave_nothing_else(spark, tmp_path):
    logs = FixtureLogs(spark, SF_SMALL)
    out = tmp_path / "out"
    for _ in range(2):
        got = impression_job(logs.ads, logs.bids, logs.notify, logs.events, fixture_config(), out_dir=str(out),
                             versioned=True, statistics=True, split_hot_bids=True)
    names = {"transactions", "transactions_multiplicity", "multi_row_transactions", "multi_row_count", "event_summary",
             "features", "event_rollup_checked", "impression_detail", "issue_crosstab", "issue_rows",
             "clean_impressions", "browser_summary"}
    assert set(got) == names == {p.name for p in out.iterdir()}
    for name in names:
        path = str(out / name)
        assert len(versions(spark, path)) == 2
        now = current_version(spark, path)
        assert ST.read(spark, now).first().rows == read_version(spark, path).count() == got[name].count()
    plain = impression_job(logs.ads, logs.bids, logs.notify, logs.events, fixture_config(), out_dir=str(tmp_path / "plain"))
    for name in ("transactions", "clean_impressions", "features"):
        assert same_rows(plain[name], got[name])
    placement_job(logs.placements, out_dir=str(tmp_path / "p"), versioned=True, statistics=True)
    assert read_version(spark, str(tmp_path / "p" / "daily_summary")).count() > 0
