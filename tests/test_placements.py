"""The placement analysis: reader, R semantics on a literal file, consistency."""

import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from viewlens.plans import placements as P
from viewlens.sources.fixtures import placement_raw
from viewlens.sources.readers import read_placement_csv

CSV = '''Date,Publisher.ID,Placement.ID,% In View,Measured.Impressions,Total.Impressions
06-10-2014,1,10,50%,"1,000","2,000"
06-10-2014,1,11,25%,3,"1,500"
06-10-2014,2,10,,,"1,000"
06-11-2014,1,10,51%,5,0
bad-date,,10,10%,10,10
'''


def _write(tmp_path, text=CSV):
    p = tmp_path / "placements.csv"
    p.write_text(text)
    return str(p)


def test_read_and_clean_like_r(spark, tmp_path):
    clean = P.placement_clean(read_placement_csv(spark, _write(tmp_path)))
    got = rows(clean)
    assert got[0] == (dt.date(2014, 6, 10), "1", "10", 50.0, 1000.0, 2000.0, 500.0)
    assert got[1][-1] == 1.0                  # 25 * 3 / 100 = 0.75 -> 1
    assert got[2][3:] == (0.0, 0.0, 1000.0, 0.0)   # missing values -> 0
    assert got[3][-1] == 3.0                  # 51 * 5 / 100 = 2.55 -> 3
    assert got[4][:3] == (None, None, "10")     # bad date and id -> NA


def test_half_even_viewed(spark):
    df = spark.createDataFrame([("01-01-2020", "1", "1", "50%", "5", "10")],
                               "date string, publisher_id string, placement_id string, in_view string, "
                               "measured_impressions string, total_impressions string")
    assert P.placement_clean(df).first().viewed_impressions == 2.0     # 2.5 -> 2


def test_daily_summary_semantics(spark, tmp_path):
    clean = P.placement_clean(read_placement_csv(spark, _write(tmp_path)))
    d = {r.date: r for r in P.daily_summary(clean).collect()}
    r = d[dt.date(2014, 6, 10)]
    assert (r.publishers, r.pub_placements) == (2, 3)
    assert r.total_impressions == 4500 and r.measured_impressions == 1003
    assert r.more_1000_imps == 3 and r.more_100_meas == 1
    r2 = d[dt.date(2014, 6, 11)]
    assert math.isinf(r2.measured_rate)       # 5 / 0 -> Inf, as R
    r3 = d[None]                              # NA date is a group of its own
    assert r3.publishers == 1                 # NA publisher counted as a value


def test_publisher_summary_nan_spreads_like_r(spark, tmp_path):
    clean = P.placement_clean(read_placement_csv(spark, _write(tmp_path)))
    pd_ = P.publisher_day(clean)
    two = {r.publisher_id: r for r in pd_.where(F.col("publisher_id") == "2").collect()}
    assert math.isnan(two["2"].viewed_rate)     # 0 / 0
    s = {r.publisher_id: r for r in P.publisher_summary(pd_).collect()}
    assert math.isnan(s["2"].mean_viewed_rate) and s["2"].sd_viewed_rate is None and s["1"].days == 2


def test_stable_and_summary_agree(spark):
    clean = P.placement_clean(placement_raw(spark, SF_SMALL))
    st = P.stable_placements(clean)
    assert st.agg(F.min("days")).first()[0] >= 20 and st.agg(F.min("total_impressions")).first()[0] >= 1000
    means = [r.mean_imps for r in st.select("mean_imps").collect()]
    assert means == sorted(means, reverse=True)
    summ = P.placement_summary(clean)
    per = st.groupBy("publisher_id", "placement_id").agg(F.count(F.lit(1)).alias("n"), F.max("sd_imps").alias("sd"))
    j = summ.join(per, ["publisher_id", "placement_id"])
    assert j.count() == summ.count() == per.count()
    assert j.where((F.col("n") != F.col("days")) | (F.abs(F.col("sd") - F.col("sd_imps")) > 1e-6)).count() == 0
    sds = [r.sd_in_view for r in summ.collect()]
    assert sds == sorted(sds, reverse=True)


def test_totals_and_publishers_per_placement(spark):
    clean = P.placement_clean(placement_raw(spark, SF_SMALL))
    tot = P.placement_totals(clean)
    ppp = P.publishers_per_placement(tot)
    assert ppp.agg(F.sum("publishers")).first()[0] == tot.count()
    assert tot.agg(F.sum("total_impressions")).first()[0] == clean.agg(F.sum("total_impressions")).first()[0]


def test_chart_series_shapes(spark):
    clean = P.placement_clean(placement_raw(spark, SF_SMALL))
    stable, summary = P.stable_placements(clean, ordered=False), P.placement_summary(clean, ordered=False)
    one = P.placement_series(clean, "1", "1")
    cs = P.chart_series(P.daily_summary(clean), stable, summary, one)
    days = P.daily_summary(clean).count()
    by_chart = dict(rows(cs.groupBy("chart").count()))
    assert by_chart["daily"] == days * len(P.DAILY_SERIES)
    assert by_chart["stable_in_view"] == P.stable_placements(clean, ordered=False).count()
    assert by_chart["scatter"] == summary.count() * len(P.SCATTER_PAIRS)
    assert by_chart["drill_in_view"] == by_chart["drill_scatter"] == one.count() > 0
    assert cs.where((F.col("day").isNull()) == (F.col("x").isNull())).count() == 0


def test_ids_are_kept_as_read(spark):
    """Ids that are not numbers stay apart, and grouped outputs come in key order on wish."""
    rows_ = [("01-01-2020", p, "x", "50%", "5", "10") for p in ("pubB", "pubA", "pubA", None)]
    raw = spark.createDataFrame(rows_, "date string, publisher_id string, placement_id string, in_view string, "
                                "measured_impressions string, total_impressions string")
    clean = P.placement_clean(raw)
    assert P.daily_summary(clean, ordered=True).first().publishers == 3
    assert [r.publisher_id for r in P.publisher_summary(P.publisher_day(clean), ordered=True).collect()] \
        == ["pubA", "pubB", None]
    assert [r[:2] for r in P.placement_totals(clean, ordered=True).collect()] \
        == [("pubA", "x"), ("pubB", "x"), (None, "x")]
