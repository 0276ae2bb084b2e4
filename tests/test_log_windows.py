"""Windows on a day and a time-of-day column, tested without making the timestamp."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from viewlens.config import fixture_config
from viewlens.functions import scalars as S
from viewlens.operators import aggregates as A
from viewlens.operators import filters as FL
from viewlens.plans import impressions as IM
from viewlens.sources.readers import normalise_log, read_log

TIMES = ("00:00:00", "00:00:00.000001", "06:29:59.999999", "06:30:00", "06:30:00.5", "12:00:00", "18:15:30",
         "18:15:30.000000", "18:15:30.000001", "23:59:59.999999", "24:00:00", "24:00:00.000", "7:5:9", "1:02:03.5",
         None, "", "noon", "24:00:01", "99:99:99", "-1:00:00", "12:60:00", "12:00:60", "12:00", " 12:00:00", "12:00:00.",
         "12:00:00.1234567", "1a:00:00", "٣٤:00:00")


def moment(day, text):
    """The timestamp of a day and a text, by Python's own arithmetic; None if the text is no time of day."""
    m = re.fullmatch(r"([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(?:\.([0-9]{1,9}))?", text or "")
    if not m or day is None:
        return None
    h, mi, s, us = int(m[1]), int(m[2]), int(m[3]), int((m[4] or "0").ljust(6, "0")[:6])
    if mi > 59 or s > 59 or h > 24 or h == 24 and (mi, s, us) != (0, 0, 0):
        return None
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=h, minutes=mi, seconds=s, microseconds=us)


def log(spark):
    days = [dt.date(2024, 1, 8) + dt.timedelta(days=k) for k in range(6)] + [None]
    rows = [(d, t) for d in days for t in TIMES]
    return rows, spark.createDataFrame(rows, "d date, t string")


def test_to_ts_reads_times_of_day_only(spark):
    rows, df = log(spark)
    got = [r[0] for r in df.select(S.to_ts("d", "t")).collect()]
    assert got == [moment(*r) for r in rows]
    bad = sum(t is not None and moment(dt.date(2024, 1, 8), t) is None for _, t in rows)
    assert df.agg(A.unreadable_times("t")).first()[0] == bad > 0


def test_day_time_windows_equal_windows_on_the_timestamp(spark):
    rows, df = log(spark)
    rng = random.Random(7)
    edges = [moment(dt.date(2024, 1, 8) + dt.timedelta(days=k), t) for k in range(5) for t in TIMES[:11]]
    windows = [tuple(sorted(rng.sample(edges, 2))) for _ in range(40)]
    windows += [(e, e) for e in edges[::4]] + [(edges[5], edges[0])]
    masks = df.select("d", "t", *[F.coalesce(FL.in_day_time_window("d", "t", *w), F.lit(False)).alias(f"w{k}")
                                  for k, w in enumerate(windows)]).collect()
    for row, (d, t) in zip(masks, rows):
        ts = moment(d, t)
        for k, (a, b) in enumerate(windows):
            assert row[f"w{k}"] == (ts is not None and a <= ts <= b), (d, t, a, b)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_logs_push_the_day_and_make_no_timestamp(spark, tmp_path):
    cfg = fixture_config()
    df = spark.createDataFrame([(1, 1, dt.date(1997, 1, 1), "10:00:00", 3, "http://a.com/x")],
                               "transaction_nbr long, company_id int, bid_date date, bid_time string, "
                               "operation_id int, content_url string")
    df.write.parquet(str(tmp_path / "bid"))
    found = IM.bid_domains(read_log(spark, "bid", str(tmp_path / "bid")), cfg)
    p = plan_of(found)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(bid_date", p), p
    assert "timestamp" not in p.lower(), p
    assert found.count() == 1


def test_logs_with_only_a_timestamp_are_tested_on_it(spark):
    df = spark.sql("SELECT 1L AS transaction_nbr, 1 AS company_id, timestamp_ntz'1997-01-01 10:00:00' AS bid_ts, "
                   "3 AS operation_id, 'http://a.com' AS content_url")
    bids = normalise_log(df, "bid")
    assert "bid_time" not in bids.columns
    assert bids.where(FL.in_log_window(bids, "bid_ts", dt.datetime(1997, 1, 1, 10), dt.datetime(1997, 1, 1, 10))).count() == 1


def test_an_overwritten_day_or_time_column_loses_its_mark(spark):
    df = spark.createDataFrame([(1, 1, dt.date(1997, 1, 1), "10:00:00", 3, "u")],
                               "transaction_nbr long, company_id int, bid_date date, bid_time string, "
                               "operation_id int, content_url string")
    bids = normalise_log(df, "bid").withColumn("bid_date", F.lit(dt.date(2020, 1, 1)))
    assert bids.where(FL.in_log_window(bids, "bid_ts", dt.datetime(1997, 1, 1), dt.datetime(1997, 1, 2))).count() == 1
