"""Distinct counts by bitmaps: numbers below zero, far apart and missing."""

import random

from pyspark.sql import functions as F

from conftest import rows
from viewlens.operators.bitmaps import with_distinct_numbers


def test_distinct_numbers_equal_sets(spark):
    rng = random.Random(3)
    numbers = [None, 0, 1, -1, 32767, 32768, 32769, -32768, -32769, 10**6, -10**6, 2**40, *range(200)]
    data = [(rng.choice(["a", "b", None]), rng.choice(numbers), rng.random()) for _ in range(3000)]
    data += [("only missing", None, 1.0), ("one", 7, 2.0), ("one", 7, 3.0)]
    df = spark.createDataFrame(data, "k string, n long, x double").repartition(5)
    want = {}
    for k, n, x in data:
        seen, total = want.setdefault(k, (set(), []))
        seen.add(n)
        total.append(x)
    got = rows(with_distinct_numbers(df, ["k"], F.col("n"), "distinct", ["x"]))
    assert {k: n for k, n, _ in got} == {k: len(seen) for k, (seen, _) in want.items()}
    assert all(abs(x - sum(want[k][1])) < 1e-6 for k, _, x in got)
    assert with_distinct_numbers(df.limit(0), ["k"], F.col("n"), "distinct", ["x"]).count() == 0


def test_placement_totals_hold_groups_and_not_rows(spark):
    """No aggregate sorts whole rows: bitmaps are columns that a hash aggregate changes in place."""
    from conftest import SF_SMALL
    from viewlens.plans.registry import all_queries
    p = all_queries()["placement_totals"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in p and "SortAggregate" not in p and "Sort [" not in p, p
    # at most a row per group and range leaves a task: days, one after the other, repeated and missing
    days = [None, None, *range(8000, 8512), *range(8000, 8512), -1, -512, -513]
    df = spark.createDataFrame([("a", d, 1.0) for d in days], "k string, n int, x double").coalesce(1)
    assert rows(with_distinct_numbers(df, ["k"], F.col("n"), "distinct", ["x"])) == [("a", 516, float(len(days)))]


def test_key_order_sorts_groups_only(spark):
    from conftest import SF_SMALL
    from viewlens.plans import placements as P
    from viewlens.sources.fixtures import placement_raw
    totals = P.placement_totals(P.placement_clean(placement_raw(spark, SF_SMALL)), ordered=True)
    p = totals.select("publisher_id", "placement_id", "days")._jdf.queryExecution().executedPlan().toString()
    # the one sort is that of the result by its keys
    assert "SortAggregate" not in p and p.count("Sort [") == 1, p


def test_key_order_gathers_groups_before_the_hash_aggregate(spark):
    """A read split with rows of many groups fills no hash map: the rows are brought together by group first."""
    from conftest import SF_SMALL
    from viewlens.plans import placements as P
    from viewlens.sources.fixtures import placement_raw
    totals = P.placement_totals(P.placement_clean(placement_raw(spark, SF_SMALL)), ordered=True)
    p = totals.select("publisher_id", "placement_id", "days")._jdf.queryExecution().executedPlan().toString()
    lowest = p[p.rindex("HashAggregate"):]
    # 200 partitions: more would hold rows in memory while the shuffle is written
    assert "REBALANCE_PARTITIONS_BY_COL" in lowest and ", 200), REBALANCE" in lowest, p


def test_hot_group_is_split_and_counted_once(spark):
    days = [i % 700 for i in range(60_000)]
    data = [("hot" if i % 3 else f"k{i % 50}", d, 1.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(data, "k string, n int, x double").repartition(8)
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = with_distinct_numbers(df, ["k"], F.col("n"), "distinct", ["x"])
        got = {k: (n, x) for k, n, x in rows(out)}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = {}
    for k, d, _ in data:
        want.setdefault(k, []).append(d)
    assert got == {k: (len(set(v)), float(len(v))) for k, v in want.items()}
    assert "AQEShuffleRead skewed" in plan or "AQEShuffleRead coalesced and skewed" in plan, plan
