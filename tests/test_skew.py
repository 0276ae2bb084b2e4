"""A third of all events on one transaction (and a NULL key): results stay
whole and equal to DuckDB on the same rule."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from oracle.compare import compare, connect
from oracle.sql import with_ctes
from viewlens.config import fixture_config
from viewlens.plans import events as EV
from viewlens.sources.fixtures import FixtureLogs


def _skewed(spark):
    ev = FixtureLogs(spark, SF_SMALL).events
    t = F.col("transaction_nbr")
    hot = F.when(F.col("logrec_sk") % 3 == 0, F.lit(0).cast("bigint")) \
           .when(F.col("logrec_sk") % 11 == 5, F.lit(None).cast("bigint")).otherwise(t)
    return ev.withColumn("transaction_nbr", hot)


SKEW_SQL = """, skewed AS (
  SELECT * REPLACE (CASE WHEN logrec_sk % 3 = 0 THEN 0 WHEN logrec_sk % 11 = 5 THEN NULL
                         ELSE transaction_nbr END AS transaction_nbr)
  FROM event_log)
"""


def test_hot_key_rollup_and_first_event(spark):
    cfg = fixture_config()
    ev = _skewed(spark)
    con = connect(SF_SMALL)
    base = with_ctes(["event_log"])
    roll = EV.event_rollup(ev, cfg).select("transaction_nbr", "start_events", "end_events", "event_10s",
                                          "event_90_time", "browser_desc", "browser_desc_check")
    sql = base + SKEW_SQL + """
SELECT transaction_nbr, min(event_ts) AS start_events, max(event_ts) AS end_events,
       CAST(sum(CASE WHEN event_id = 10 THEN 1 ELSE 0 END) AS BIGINT) AS event_10s,
       max(CASE WHEN event_id = 90 THEN elapsed_time_ms_meas ELSE 0 END) AS event_90_time,
       min(browser_desc) AS browser_desc, max(browser_desc) AS browser_desc_check
FROM skewed WHERE event_date BETWEEN DATE '2023-12-31' AND DATE '2024-01-31' AND company_id = 1
  AND script_version_id IN (6, 7) GROUP BY transaction_nbr"""
    rel = con.sql(sql)
    got = [tuple(r) for r in roll.collect()]
    assert compare(roll.columns, got, rel.columns, rel.fetchall()) is None
    hot = [r for r in got if r[0] == 0][0]
    assert hot[3] > 10                       # the hot transaction's events are all counted
    first = EV.first_feature_event(ev, cfg).select("transaction_nbr", "event_detail_desc")
    rel = con.sql(base + SKEW_SQL + """
SELECT transaction_nbr, event_detail_desc FROM (
  SELECT transaction_nbr, event_detail_desc,
         row_number() OVER (PARTITION BY transaction_nbr ORDER BY logrec_sk) AS rn
  FROM skewed WHERE event_date BETWEEN DATE '2023-12-31' AND DATE '2024-01-31'
    AND event_id IN (10, 90) AND script_version_id IN (6, 7)) a WHERE rn = 1""")
    assert compare(first.columns, [tuple(r) for r in first.collect()], rel.columns, rel.fetchall()) is None


def test_hot_ad_transaction_is_split_in_the_executed_plan(spark):
    """Nine tenths of the ad groups on one transaction: the session's settings let AQE split that join."""
    from viewlens.plans import impressions as IM
    from viewlens.session import DEFAULT_CONF
    cfg = fixture_config()
    logs = FixtureLogs(spark, SF_SMALL)
    hot = F.when(F.rand(1) < 0.9, F.lit(1).cast("bigint")).otherwise(F.col("transaction_nbr"))
    ads = logs.ads.crossJoin(spark.range(40)).withColumn("transaction_nbr", hot) \
        .withColumn("content_url", F.concat("content_url", F.md5(F.rand(2).cast("string")))).drop("id")
    settings = {**{k: v for k, v in DEFAULT_CONF.items() if "skew" in k.lower()},
                "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                # a split needs several map tasks, which these small tables would be coalesced below
                "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        tx = IM.transactions(ads, IM.bid_domains(logs.bids, cfg), IM.view_notify(logs.notify, cfg), cfg)
        tx.collect()
        plan = tx._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan, plan
