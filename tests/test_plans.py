"""The physical plans keep the properties the design relies on at scale."""

import re

import pytest

from conftest import SF_SMALL
from viewlens.plans.registry import ImpressionRun, all_queries

QUERIES = all_queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rollups_aggregate_map_side_before_shuffle(spark):
    run = ImpressionRun(spark, SF_SMALL)
    from viewlens.plans.events import event_summary
    for df in (run.rollup(), run.tx(), run.notify(), event_summary(run.logs.events, run.cfg)):
        p = plan_of(df)
        assert re.search(r"partial_(min|count|max|sum)", p), p


def test_first_per_key_limits_before_shuffle(spark):
    p = plan_of(ImpressionRun(spark, SF_SMALL).first())
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p, p


def test_no_python_in_any_plan(spark):
    for name, q in QUERIES.items():
        if name.endswith("_order") or name == "detail_snapshot":
            continue
        p = plan_of(q(spark, SF_SMALL))
        assert "EvalPython" not in p and "InPandas" not in p, name


def test_filters_reach_the_scans(spark):
    p = plan_of(QUERIES["transactions"](spark, SF_SMALL))
    scans = [line for line in p.splitlines() if "FileScan" in line]
    assert all("DataFilters: [" in s and "DataFilters: []" not in s for s in scans), scans
    assert any("o_orderdate" in s and "PushedFilters" in s for s in scans)


def test_scans_read_only_used_columns(spark):
    p = plan_of(QUERIES["bid_domains"](spark, SF_SMALL))
    line = next(s for s in p.splitlines() if "FileScan" in s and "lineitem" in s)
    assert "l_extendedprice" not in line and "l_comment" not in line and "l_orderkey" in line


def test_detail_joins_add_no_shuffle_of_their_own(spark, no_broadcast):
    run = ImpressionRun(spark, SF_SMALL)
    p_tx = plan_of(run.tx())
    p_detail = plan_of(run.detail())
    n = lambda p: len(re.findall(r"Exchange hashpartitioning", p))
    # detail = transactions + the one-pass event summary (1 shuffle); the join adds none
    assert n(p_detail) == n(p_tx) + 1, (n(p_tx), n(p_detail))


def test_checked_rollup_is_one_scan_one_shuffle_no_join(spark, no_broadcast):
    p = plan_of(ImpressionRun(spark, SF_SMALL).checked())
    assert len(re.findall("FileScan", p)) == 1 and "Join" not in p, p
    assert len(re.findall("Exchange hashpartitioning", p)) == 1, p


def test_daily_summary_expands_no_rows(spark):
    for name in ("daily_summary", "daily_rates", "placement_totals"):
        assert "Expand" not in plan_of(QUERIES[name](spark, SF_SMALL)), name


def test_placement_series_drills_before_it_counts(spark, no_broadcast):
    p = plan_of(QUERIES["placement_series"](spark, SF_SMALL))
    scans = [x for x in p.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all(re.search(r"DataFilters: \[[^\]]*l_suppkey[^\]]*l_partkey", x) for x in scans), p


def test_day_partitioned_logs_are_pruned_through_the_reader(spark, tmp_path):
    from pyspark.sql import functions as F
    from viewlens.config import fixture_config
    from viewlens.plans import events as EV
    from viewlens.plans import impressions as IM
    from viewlens.sources.fixtures import FixtureLogs
    from viewlens.sources.readers import read_log
    cfg = fixture_config()
    logs = FixtureLogs(spark, SF_SMALL)

    def split(df, prefix):
        day, ts = f"{prefix}_date", f"{prefix}_ts"
        # a few days either side of the window's end are enough to see pruning
        df = df if prefix == "event" else df.where(F.col(ts).between("1999-12-25", "2000-01-05"))
        return df.withColumns({day: F.to_date(ts), f"{prefix}_time": F.date_format(ts, "HH:mm:ss.SSSSSS")}).drop(ts)
    found = {}
    for kind, df, prefix in (("bid", logs.bids, "bid"), ("notify", logs.notify, "dmm"), ("event", logs.events, "event")):
        split(df, prefix).coalesce(1).write.partitionBy(f"{prefix}_date").parquet(str(tmp_path / kind))
        found[kind] = read_log(spark, kind, str(tmp_path / kind))
    plans = {"bid_date": IM.bid_domains(found["bid"], cfg), "dmm_date": IM.view_notify(found["notify"], cfg),
             "event_date": EV.event_rollup(found["event"], cfg)}
    for day, df in plans.items():
        assert re.search(rf"PartitionFilters: \[[^\]]*{day}", plan_of(df)), plan_of(df)
    window = F.col("bid_ts").between("1999-12-25", "2000-01-05")
    want = IM.bid_domains(logs.bids.where(window), cfg)
    assert sorted(map(str, want.collect())) == sorted(map(str, plans["bid_date"].collect())) and want.count() > 0


def test_a_log_without_its_columns_raises(spark, tmp_path):
    from viewlens.sources.readers import read_log
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="bid_ts"):
        read_log(spark, "bid", str(tmp_path / "x"))
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS bid_ts").write.parquet(str(tmp_path / "y"))
    with pytest.raises(ValueError, match="transaction_nbr"):
        read_log(spark, "bid", str(tmp_path / "y"))
