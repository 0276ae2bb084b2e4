import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import rows
from viewlens.functions import scalars as S


def test_round_half_even(spark):
    df = spark.createDataFrame([(x,) for x in [0.5, 1.5, 2.5, 3.5, -2.5, 2.4, 2.6]], "x double")
    assert [r[0] for r in rows(df.select(S.round_half_even("x")))] == [0.0, 2.0, 2.0, 4.0, -2.0, 2.0, 3.0]


def test_parse_number_like_r(spark):
    vals = ["12", " 12 ", "1e3", ".5", "+3", "-7.25", "Inf", "-inf", "NaN", "", "abc", "1d", "2.5F", "1,2", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in rows(df.select(S.parse_number("v")))]
    want = [12.0, 12.0, 1000.0, 0.5, 3.0, -7.25, math.inf, -math.inf, "nan", None, None, None, None, None, None]
    for g, w in zip(got, want):
        if w == "nan":
            assert math.isnan(g)
        else:
            assert g == w


def test_zero_if_missing_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in rows(df.select(S.zero_if_missing("x")))] == [1.5, 0.0, 0.0]


def test_strip_and_parse(spark):
    df = spark.createDataFrame([("1,234,567",), ("37%",)], "v string")
    got = rows(df.select(S.parse_number(S.strip_chars("v", ",%"))))
    assert got == [(1234567.0,), (37.0,)]


def test_parse_date_month_first_and_bad_text(spark):
    df = spark.createDataFrame([("06-10-2014",), ("6-1-2014",), ("2014-06-10",), ("",), (None,),
                                (" 06-10-2014 00:00",), ("13-01-2014",), ("02-30-2014",)], "d string")
    got = [r[0] for r in rows(df.select(S.parse_date("d")))]
    assert got == [dt.date(2014, 6, 10), dt.date(2014, 6, 1), None, None, None,
                   dt.date(2014, 6, 10), None, None]


def test_ratio_ieee_and_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (3.0, 0.0), (-3.0, 0.0), (None, 1.0)], "n double, d double")
    ieee = [r[0] for r in rows(df.select(S.ratio("n", "d")))]
    assert ieee[0] == 0.5 and math.isnan(ieee[1]) and ieee[2] == math.inf and ieee[3] == -math.inf
    assert ieee[4] is None
    null = [r[0] for r in rows(df.select(S.ratio("n", "d", on_zero="null")))]
    assert null == [0.5, None, None, None, None]


def test_domain_name_rules(spark):
    urls = ["http://www.Example.com:8080/a?b=1", "https://user:pw@m.site.org/x", "a.com/x",
            "WWW.www.test.net", "https://host#frag", "", None, "/only/path"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in rows(df.select(S.domain_name("u")))]
    assert got == ["example.com", "m.site.org", "a.com", "www.test.net", "host", None, None, None]


def test_label_pastes_na(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    assert [r[0] for r in rows(df.select(S.label("a", "b")))] == ["1 - 2", "NA - 3"]


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 2)], "a int, b int")
    assert [r[0] for r in rows(df.select(S.flag(F.col("a") != F.col("b"))))] == [0, 1, 0]


def test_duration_and_to_ts(spark):
    df = spark.createDataFrame([(dt.date(2014, 6, 10), "19:00:01")], "d date, t string")
    ts = df.select(S.to_ts("d", "t").alias("ts")).first()[0]
    assert ts == dt.datetime(2014, 6, 10, 19, 0, 1)
    df2 = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' s, timestamp_ntz'2024-01-01 00:00:01.5' e")
    assert df2.select(S.duration_us("s", "e")).first()[0] == 1_500_000


def test_to_ts_adds_the_time_to_the_day(spark):
    df = spark.createDataFrame([("2024-01-05", "10:20:30"), ("2024-01-05", "24:00:00"), ("2024-01-05", None),
                                (None, "10:00:00"), ("2024-01-05", "noon"), ("2024-01-05", "1:2:3.000004")],
                               "d string, t string").withColumn("d", F.to_date("d"))
    got = [r[0] for r in df.select(S.to_ts("d", "t")).collect()]
    day = dt.datetime(2024, 1, 5)
    assert got == [day.replace(hour=10, minute=20, second=30), day + dt.timedelta(days=1), None, None, None,
                   day.replace(hour=1, minute=2, second=3, microsecond=4)]


def test_scheme_relative_urls_have_a_domain(spark):
    df = spark.createDataFrame([("//a.com/x",), ("https://www.b.org:8/",), ("c.net/y",), ("/only/path",)], "u string")
    assert [r[0] for r in df.select(S.domain_name("u")).collect()] == ["a.com", "b.org", "c.net", None]
