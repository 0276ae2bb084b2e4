"""A transaction with nine tenths of the bids: named exactly, split in the executed plan, same rows."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, same_rows
from viewlens.config import fixture_config
from viewlens.operators.skew import hot_keys, salted_left_join
from viewlens.plans import impressions as IM
from viewlens.sources.fixtures import FixtureLogs

def test_hot_keys_are_exact_and_bounded(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 10 == 1, None)
                                  .otherwise(F.col("id") + 10).alias("k"))
    got = {r.k: r.n for r in hot_keys(df, "k", 1 / 100).collect()}
    assert got == {1: 3000}
    assert hot_keys(df.limit(0), "k").count() == 0
    text = df.select(F.col("k").cast("string").alias("k"))
    assert [tuple(r) for r in hot_keys(text, "k", 1 / 100).collect()] == [("1", 3000)]


def test_salted_join_equals_the_left_join(spark):
    left = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (1, 8, "c"), (2, 7, "d"), (3, 7, "e"), (None, 7, "f"),
                                  (1, None, "g"), (9, 7, "h")], "t long, c int, x string")
    right = spark.createDataFrame([(1, 7, f"u{k}") for k in range(50)] + [(2, 7, "v"), (None, 7, "w"), (3, 8, "y")],
                                  "t long, c int, u string")
    for keys in (["t", "c"], ["t"]):
        r = right if "c" in keys else right.drop("c")
        for hot in ([(1,)], [(1,), (9,)], [], [(2,), (3,)]):
            named = spark.createDataFrame(hot, "t long")
            got = salted_left_join(left, r, keys, named, "t", "u", salts=8)
            assert same_rows(left.join(r, keys, "left"), got), (keys, hot)


@pytest.fixture
def skewed(spark):
    logs = FixtureLogs(spark, SF_SMALL)
    cfg = fixture_config()
    bids = IM.bid_domains(logs.bids, cfg)
    served = IM.served_ads(logs.ads, cfg).agg(F.min("transaction_nbr")).first()[0]
    many = spark.range(0, 400_000, 1, 8).select(
        F.lit(1).alias("company_id"), F.lit(served).cast("long").alias("transaction_nbr"),
        F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("content_url"))
    return logs, cfg, bids.unionByName(many), served


def test_hot_bid_transaction_is_dealt_over_tasks(spark, skewed):
    logs, cfg, bids, served = skewed
    hot = IM.hot_bid_transactions(bids, 1 / 10)
    assert [r.transaction_nbr for r in hot.collect()] == [served]
    notify = IM.view_notify(logs.notify, cfg)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        one = IM.transactions(logs.ads, bids, notify, cfg)
        split = IM.transactions(logs.ads, bids, notify, cfg, hot)
        p = split._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(transaction_nbr#\d+L?, _salt#\d+", p), p
        from viewlens.operators.skew import SALTS
        ads = IM.served_ads(logs.ads, cfg).where(F.col("transaction_nbr") == served).select(
            "transaction_nbr", F.lit("x").alias("dmm_url")).distinct()
        groups = bids.groupBy("transaction_nbr", F.col("content_url").alias("bid_url")).count()
        joined = salted_left_join(ads, groups, ["transaction_nbr"], hot, "transaction_nbr", "bid_url")
        sizes = sorted(r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) >= 12 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and SALTS >= 64, sizes
        count = lambda df: df.agg(F.count(F.lit(1)), F.sum("nrows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        assert count(one) == count(split) and count(one)[0] > 400_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
