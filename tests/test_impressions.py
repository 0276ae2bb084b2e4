"""The impression audit on literal logs (brute force) and on the driver tables
(invariants)."""

import dataclasses
import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from viewlens.config import RunConfig
from viewlens.plans import detail as D
from viewlens.plans import impressions as IM
from viewlens.plans.registry import ImpressionRun
from viewlens.sources.schemas import AD_LOG, BID_LOG, NOTIFY_LOG

CFG = RunConfig(ad_start=dt.datetime(2014, 6, 10, 19), ad_end=dt.datetime(2014, 6, 23),
                event_start=dt.date(2014, 6, 10), event_end=dt.date(2014, 6, 23), tenant=7,
                excluded_campaigns=(9001,))
TS = dt.datetime(2014, 6, 12, 10)
DAY = TS.date()


def _ad(t, url, server=0, status=3, campaign=1, company=7, browser="chrome"):
    return (t, company, TS.date(), TS, url, status, 1, 5, campaign, browser, 30, 1, "win", "pc", 1, "10.0.0.1", server)


def _logs(spark):
    ads = spark.createDataFrame([
        _ad(1, "http://a.com/x"), _ad(1, "http://a.com/x", server=1),      # duplicate ad row
        _ad(2, "http://b.com/"), _ad(3, "https://www.c.com/p"),
        _ad(4, "http://d.com/", status=99), _ad(5, "http://e.com/", campaign=9001),
        _ad(6, None), _ad(8, "http://f.com", company=8),
    ], AD_LOG)
    bids = spark.createDataFrame([
        (1, 7, DAY, TS, 3, "http://a.com/1"), (1, 7, DAY, TS, 12, "http://a.com/2"),   # same domain twice
        (1, 7, DAY, TS, 3, "http://z.com/"),                                       # a second bid URL
        (2, 7, DAY, TS, 3, None),                                                  # no URL
        (3, 7, DAY, TS, 5, "http://skip.com/"),                                    # operation not kept
        (6, 7, DAY, TS, 61, "http://g.com/"),
    ], BID_LOG)
    notify = spark.createDataFrame([(1, 7, DAY, TS, 1), (1, 7, DAY, TS, 2), (3, 7, DAY, TS, 35)], NOTIFY_LOG)
    return ads, bids, notify


def _brute_force(spark, ads, bids, notify):
    """Literal form: ads left join raw bids and notifications, then group."""
    for n, df in (("ads", ads), ("b", IM.bid_domains(bids, CFG)), ("n", IM.view_notify(notify, CFG))):
        df.createOrReplaceTempView(n)
    return spark.sql("""
      SELECT a.transaction_nbr, a.content_url AS dmm_url, b.content_url AS bid_url,
             coalesce(b.content_url, lower(regexp_replace(regexp_extract(a.content_url, '^(?:[a-z]+://)?([^:/?#]*)', 1), '^www\\\\.', ''))) AS content_url,
             a.company_id, count(*) AS nrows, max(n.view_notify) AS view_notify, max(a.server_id) AS server_id,
             min(a.browser_desc) AS dmm_browser, max(a.browser_desc) AS browser_check
      FROM ads a LEFT JOIN b ON a.transaction_nbr = b.transaction_nbr AND a.company_id = b.company_id
      LEFT JOIN n ON a.transaction_nbr = n.transaction_nbr
      WHERE a.dmm_ts BETWEEN timestamp_ntz'2014-06-10 19:00:00' AND timestamp_ntz'2014-06-23 00:00:00'
        AND a.company_id = 7 AND a.status_id IN (3, 12, 61) AND a.media_size_id NOT IN (35)
        AND a.message_campaign_id NOT IN (9001)
      GROUP BY 1, 2, 3, 4, 5""")


def test_transactions_equal_literal_join_then_group(spark):
    ads, bids, notify = _logs(spark)
    cols = ["transaction_nbr", "dmm_url", "bid_url", "content_url", "company_id", "nrows",
            "view_notify", "server_id", "dmm_browser", "browser_check"]
    for cfg_tenant in (7, None):
        cfg = dataclasses.replace(CFG, tenant=cfg_tenant)
        got = IM.transactions(ads, IM.bid_domains(bids, cfg), IM.view_notify(notify, cfg), cfg)
        if cfg_tenant is None:
            got = got.where(F.col("company_id") == 7)
        want = _brute_force(spark, ads, bids, notify)
        assert sorted(rows(got, *cols), key=str) == sorted(rows(want, *cols), key=str)
    got = {(r.transaction_nbr, r.bid_url): r for r in
           IM.transactions(ads, IM.bid_domains(bids, CFG), IM.view_notify(notify, CFG), CFG).collect()}
    assert got[(1, "a.com")].nrows == 4 and got[(1, "z.com")].nrows == 2   # 2 ad rows x 2 / x 1 bids
    assert got[(1, "a.com")].view_notify == 1 and got[(1, "a.com")].server_id == 1
    assert got[(2, None)].content_url == "b.com" and got[(3, None)].content_url == "c.com"
    assert got[(3, None)].view_notify is None                              # media size 35 excluded
    assert got[(6, "g.com")].dmm_url is None
    assert {4, 5, 8}.isdisjoint({t for t, _ in got})


def test_multiplicity_and_multi_rows(spark):
    ads, bids, notify = _logs(spark)
    tx = IM.transactions(ads, IM.bid_domains(bids, CFG), IM.view_notify(notify, CFG), CFG)
    m = rows(IM.transactions_multiplicity(tx))
    assert [r[0] for r in m] == sorted(r[0] for r in m)
    assert sum(r[1] for r in m) == tx.count()
    assert abs(sum(r[2] for r in m) - 1) < 1e-12
    assert IM.multi_row_count(tx).first()[0] == IM.multi_row_transactions(tx).count() == 2


def test_audit_invariants_on_driver_tables(spark):
    run = ImpressionRun(spark, SF_SMALL)
    tx, detail = run.tx(), run.detail()
    n_detail = detail.count()
    assert n_detail == tx.count()                              # left joins keep every impression
    ct = D.issue_crosstab(detail).collect()
    assert sum(r.n for r in ct) == n_detail and abs(sum(r.pct for r in ct) - 100) < 1e-9
    assert [r.pct for r in ct] == sorted(r.pct for r in ct)
    issues = D.issue_rows(detail)
    bad = {r[0] for r in issues.select("transaction_nbr").collect()}
    clean = run.clean()
    kept = [r[0] for r in clean.select("transaction_nbr").collect()]
    assert bad and not bad & set(kept)
    assert len(kept) == detail.where(~F.col("transaction_nbr").isin(list(bad))).count()
    # with published issue rows and without
    anti = D.clean_impressions(detail, run.cfg, issues)
    assert sorted(rows(anti), key=str) == sorted(rows(clean), key=str)
    assert len(clean.columns) == 92
    from viewlens.plans.reports import browser_summary
    assert browser_summary(clean, run.cfg).agg(F.sum("impressions")).first()[0] == len(kept)


def test_feature_columns_null_without_event_and_blank_when_short(spark):
    run = ImpressionRun(spark, SF_SMALL)
    d = run.detail()
    no_event = d.where(F.col("script_version_id").isNull()).select("fontface").distinct().collect()
    assert [r[0] for r in no_event] == [None]
    f = run.feats()
    short = f.where(F.col("vidogg") == "").select("fontface", "vidh264", "vendor").distinct().collect()
    assert short and all(tuple(r) == ("0", "1", "") for r in short)   # "6;0101": four flags, then blanks


def test_options_dedupe_bids_extra_flags_length_check(spark):
    ads, bids, notify = _logs(spark)
    cfg = dataclasses.replace(CFG, dedupe_bids=True)
    tx = IM.transactions(ads, IM.bid_domains(bids, cfg), IM.view_notify(notify, cfg), cfg)
    got = {(r.transaction_nbr, r.bid_url): r.nrows for r in tx.collect()}
    assert got[(1, "a.com")] == 2 and got[(1, "z.com")] == 2        # ad rows only
    run = ImpressionRun(spark, SF_SMALL)
    d = run.detail()
    ct = D.issue_crosstab(d, extra_flags=True)
    assert len(ct.columns) == 8 + 7 + 2 and ct.agg(F.sum("n")).first()[0] == d.count()
    # every transaction removed for an ad-vs-event mismatch only shows in the extra flags
    extra = [c for c in ct.columns if "_vs_" in c]
    assert ct.where(F.greatest(*extra) == 1).count() > 0
    from viewlens.plans.events import features
    f = features(run.first(), check_length=True)
    bad = dict(rows(f.groupBy("feature_string_ok").count()))
    assert set(bad) == {0, 1} and bad[0] == f.where(F.col("vidogg") == "").count()


def test_first_feature_event_is_the_same_on_both_paths(spark):
    """Log keys that are missing come last, ties go by text, for the dataset and for the summary."""
    from conftest import same_rows
    from viewlens.plans import events as EV
    run = ImpressionRun(spark, SF_SMALL)
    sk = F.when(F.col("logrec_sk") % 3 != 0, F.col("logrec_sk") % 4)      # many ties and NULLs
    events = run.logs.events.withColumn("logrec_sk", sk)
    for cfg in (run.cfg, dataclasses.replace(run.cfg, feature_tenant=True, check_feature_length=True),
                dataclasses.replace(run.cfg, tenant=2, event_end=dt.date(2024, 1, 10))):
        for ev in (run.logs.events, events):
            summary = EV.event_summary(ev, cfg)
            assert same_rows(EV.features(EV.first_feature_event(ev, cfg), cfg.check_feature_length),
                             EV.features_from_summary(summary))
    one = spark.createDataFrame(
        [(1, None, "null"), (1, 7, "seven"), (1, 9, None), (2, None, "only")],
        "transaction_nbr long, logrec_sk long, event_detail_desc string")
    for c in run.logs.events.columns:
        if c not in one.columns:
            one = one.withColumn(c, F.lit(None).cast(run.logs.events.schema[c].dataType))
    one = one.withColumns({"event_date": F.lit(dt.date(2024, 1, 5)), "event_id": F.lit(10), "script_version_id": F.lit(6)})
    first = dict(rows(EV.first_feature_event(one, run.cfg), "transaction_nbr", "event_detail_desc"))
    assert first == {1: "seven", 2: "only"}
    got = dict(rows(EV.event_summary(one, run.cfg), "transaction_nbr", "version_nbr"))
    assert got == {1: "s", 2: "o"}


def test_checked_rollup_has_no_features_without_a_key(spark):
    from viewlens.plans import events as EV
    run = ImpressionRun(spark, SF_SMALL)
    ev = run.logs.events.withColumn("transaction_nbr", F.when(F.col("transaction_nbr") > 20, F.col("transaction_nbr")))
    r = EV.event_rollup_checked(EV.event_summary(ev, run.cfg), run.cfg).where("transaction_nbr IS NULL").collect()
    assert len(r) == 1 and r[0].version_nbr is None and r[0].event_10s > 0


def test_rows_near_midnight_are_kept(spark):
    """The day bound only follows from the window where the timestamp was made of that day."""
    from viewlens.sources.readers import normalise_log
    cfg = dataclasses.replace(CFG, ad_start=dt.datetime(2014, 6, 10), excluded_campaigns=())
    day = dt.date(2014, 6, 9)
    # a day column that differs from the timestamp's day
    ads = spark.createDataFrame([(1, 7, day, dt.datetime(2014, 6, 10, 0, 30), "http://a.com", 3, 1, 5, 1, "chrome", 30,
                                  1, "win", "pc", 1, "10.0.0.1", 0)], AD_LOG)
    assert IM.served_ads(ads, cfg).count() == 1
    # 24:00:00 of the day before the window is its first moment
    split = ads.drop("dmm_ts").withColumn("dmm_time", F.lit("24:00:00"))
    assert IM.served_ads(normalise_log(split, "ad"), cfg).count() == 1


def test_more_row_counts_than_a_screen(spark, tmp_path):
    """Every row of the histogram is published: 130 distinct row counts."""
    from viewlens.plans.jobs import impression_job
    n = 130
    ads = spark.createDataFrame([_ad(t, f"http://a{t}.com/") for t in range(1, n + 1)], AD_LOG)
    bids = spark.createDataFrame([(t, 7, DAY, TS, 3, "http://b.com/") for t in range(1, n + 1) for _ in range(t)], BID_LOG)
    notify = spark.createDataFrame([], NOTIFY_LOG)
    events = ImpressionRun(spark, SF_SMALL).logs.events
    out = impression_job(ads, bids, notify, events, CFG, out_dir=str(tmp_path))
    m = spark.read.parquet(str(tmp_path / "transactions_multiplicity"))
    assert sorted(rows(m, "nrows", "trans")) == [(k, 1) for k in range(1, n + 1)]
    assert spark.read.parquet(str(tmp_path / "multi_row_count")).first()[0] == n - 1
    assert spark.read.parquet(str(tmp_path / "issue_crosstab")).agg(F.sum("n")).first()[0] == n
    assert spark.table("clean_impressions_of_tenant").count() == out["clean_impressions"].count()


def test_job_with_other_versions_and_codes(spark, tmp_path):
    from viewlens.plans.jobs import impression_job
    run = ImpressionRun(spark, SF_SMALL)
    logs = run.logs
    cfg = dataclasses.replace(run.cfg, versions=(5, 7), event_codes=(10, 30), check_feature_length=True)
    out = impression_job(logs.ads, logs.bids, logs.notify, logs.events, cfg, out_dir=str(tmp_path))
    clean = out["clean_impressions"]
    assert {"event_10s", "event_30_time", "feature_string_ok"} <= set(clean.columns)
    assert not {"event_90s", "event_80s"} & set(clean.columns)
    assert "feature_string_ok" in out["event_rollup_checked"].columns
    s = out["browser_summary"]
    assert {"v5", "v7", "v5_event10", "v7_event30", "total30"} <= set(s.columns) and "total90" not in s.columns
    want = clean.groupBy().agg(F.expr("count_if(script_version_id = 5)"), F.expr("count_if(script_version_id = 7)")).first()
    assert tuple(s.agg(F.sum("v5"), F.sum("v7")).first()) == tuple(want) and want[0] > 0 and want[1] > 0
    assert "multiple_90s" not in out["issue_crosstab"].columns
