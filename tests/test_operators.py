import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import rows
from viewlens.functions.features import FEATURE_COLUMNS, parse_feature_string
from viewlens.operators import aggregates as A
from viewlens.operators import filters as FL
from viewlens.operators import joins as J
from viewlens.operators import windows as W


def test_in_window_includes_both_ends(spark):
    ts = [dt.datetime(2014, 6, 10, 18, 59, 59), dt.datetime(2014, 6, 10, 19), dt.datetime(2014, 6, 23),
          dt.datetime(2014, 6, 23, 0, 0, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    p = FL.in_window("ts", dt.datetime(2014, 6, 10, 19), dt.datetime(2014, 6, 23))
    assert df.where(p).count() == 2


def test_in_day_window_slack(spark):
    df = spark.createDataFrame([(dt.date(2014, 6, d),) for d in (8, 9, 10, 23, 24, 25)], "d date")
    assert df.where(FL.in_day_window("d", dt.date(2014, 6, 10), dt.date(2014, 6, 23), 1)).count() == 4


def test_not_in_drops_null(spark):
    df = spark.createDataFrame([(1,), (35,), (None,)], "m int")
    assert rows(df.where(FL.not_in("m", [35, 37]))) == [(1,)]


def test_differs_null_is_not_evidence(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert df.where(FL.differs("x", "y")).count() == 1


def test_min_max_check_finds_conflict(spark):
    df = spark.createDataFrame([(1, "chrome"), (1, "chrome"), (2, "chrome"), (2, "msie")], "t int, b string")
    got = sorted(rows(df.groupBy("t").agg(*A.min_max_check({"b": ("b", "b_check")}))))
    assert got == [(1, "chrome", "chrome"), (2, "chrome", "msie")]


def test_event_counts_and_times(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 10, 7), (1, 90, None), (2, 11, None)],
                               "t int, event_id int, ms long")
    g = df.groupBy("t").agg(*A.event_counts([10, 90]), *A.event_times([10, 11], ms="ms")).orderBy("t")
    assert rows(g) == [(1, 2, 1, 7, 0), (2, 0, 0, 0, None)]   # all-NULL ms of a one-code group -> NULL


def test_event_detail_min_max(spark):
    df = spark.createDataFrame([(1, 90, "b"), (1, 90, "a"), (1, 10, "z"), (2, 10, "q")], "t int, event_id int, d string")
    g = df.groupBy("t").agg(*A.event_detail(90, detail="d")).orderBy("t")
    assert rows(g) == [(1, "a", "b"), (2, None, None)]


def test_n_unique_counts_null(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (1, None)], "g int, v string")
    r = df.groupBy("g").agg(A.n_unique("v").alias("u"), F.count_distinct("v").alias("c")).first()
    assert (r.u, r.c) == (2, 1)


def test_mean_sd_single_row_is_null(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (2, 3.0)], "g int, x double")
    got = sorted(rows(df.groupBy("g").agg(*A.mean_sd("x", "x"))))
    assert got[0] == (1, 3.0, None) and got[1][1] == 2.0 and abs(got[1][2] - math.sqrt(2)) < 1e-12


def test_count_at_least(spark):
    df = spark.createDataFrame([(99.0,), (100.0,), (1000.0,)], "x double")
    assert df.agg(A.count_at_least("x", 100)).first()[0] == 2


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 9, "z")], "t int, sk int, v string")
    assert sorted(rows(W.first_per_key(df, "t", "sk"))) == [(1, 1, "a"), (2, 9, "z")]


def test_share_of_total(spark):
    df = spark.createDataFrame([(1, 3), (2, 1)], "k int, n long")
    got = dict((r[0], r[2]) for r in rows(W.share_of_total(df, "n", "share", scale=100)))
    assert got == {1: 75.0, 2: 25.0}


def test_with_group_stats_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "k int, x double")
    out = W.with_group_stats(df, ["k"], "x", {"m": "mean", "n": "count"})
    assert sorted(rows(out), key=str) == sorted([(None, 1.0, 2.0, 2), (None, 3.0, 2.0, 2), (1, 5.0, 5.0, 1)], key=str)


def test_order_by_nan_last_descending(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None), (4, 2.0), (5, 2.0)], "k int, x double")
    assert [r[0] for r in rows(W.order_by(df, "x", desc=True, ties=["k"]))] == [4, 5, 2, 1, 3]


def test_with_position_is_global_and_distributed(spark):
    df = spark.range(0, 1000).withColumn("v", (F.col("id") * 7919) % 1000).repartition(7)
    out = W.with_position(df.orderBy("v", "id"), "pos")
    got = sorted((r.pos, r.v) for r in out.collect())
    assert [p for p, _ in got] == list(range(1, 1001))
    assert [v for _, v in got] == sorted(v for _, v in got)


def test_without_is_anti_join_keeping_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "t int, v string")
    bl = spark.createDataFrame([(2,), (2,), (None,)], "t int")
    assert sorted(rows(J.without(df, bl, "t")), key=str) == sorted([(1, "a"), (None, "c")], key=str)


def test_feature_string_layout(spark):
    full = "6;" + "01" * 16 + "1;4;2;1;100;1.5;1024x768;1024x740;800x600;11.3;;;1;;26;mac;webkit;acme"
    df = spark.createDataFrame([(full,), ("6;0101",)], "s string")
    out = rows(df.select(*parse_feature_string("s")))
    assert len(FEATURE_COLUMNS) == 51
    a = dict(zip(FEATURE_COLUMNS, out[0]))
    assert a["version_nbr"] == "6" and a["fontface"] == "0" and a["canvas"] == "1" and a["active_x"] == "1"
    assert a["total_iframes"] == "4" and a["flash_version"] == "11.3" and a["vendor"] == "acme"
    assert a["silverlight_version"] == "" and a["browser_version"] == "26"
    b = dict(zip(FEATURE_COLUMNS, out[1]))  # a short string: past the end gives ''
    assert b["svg"] == "0" and b["vidh264"] == "1" and b["vidogg"] == "" and b["vendor"] == ""


def test_window_literals_ignore_session_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2014, 6, 23),), (dt.datetime(2014, 6, 23, 0, 0, 1),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            p = FL.in_window("ts", dt.datetime(2014, 6, 10, 19), dt.datetime(2014, 6, 23))
            assert df.where(p).count() == 1, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
