"""The anti join that most rows bypass: same rows, and only possible issue rows are shuffled."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, same_rows
from viewlens.operators.joins import key_filter, without, without_few
from viewlens.plans import detail as D
from viewlens.plans.registry import ImpressionRun


@pytest.mark.parametrize("bits", [1 << 10, 1 << 24])
def test_equals_the_anti_join(spark, bits):
    df = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 900).alias("transaction_nbr"),
                                  F.col("id").alias("x"), F.lit("a").alias("_word"))
    bad = spark.createDataFrame([(k,) for k in range(0, 3000, 13)] * 2 + [(None,)], "transaction_nbr long")
    assert same_rows(without(df, bad), without_few(df, bad, bits=bits))
    assert same_rows(df, without_few(df, bad.limit(0), bits=bits))
    text = df.withColumn("transaction_nbr", F.col("transaction_nbr").cast("string"))
    assert same_rows(without(text, bad.withColumn("transaction_nbr", F.col("transaction_nbr").cast("string"))),
                     without_few(text, bad.withColumn("transaction_nbr", F.col("transaction_nbr").cast("string"))))


def test_the_filter_has_a_fixed_size(spark):
    keys = spark.range(100_000).withColumnRenamed("id", "k")
    assert key_filter(keys, "k", 1 << 12).count() == 64
    assert key_filter(keys.limit(10), "k", 1 << 12).count() <= 10


def exchanges(plan) -> list[tuple[str, int]]:
    """Every shuffle of an executed plan, with the rows that were written to it."""
    found, todo, seen = [], [plan], set()
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if name.startswith("Exchange") and p.id() not in seen:
            seen.add(p.id())
            found.append((p.simpleString(200), p.metrics().apply("shuffleRecordsWritten").value()))
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_only_possible_issue_rows_are_shuffled(spark, tmp_path):
    run = ImpressionRun(spark, SF_SMALL)
    run.detail().write.parquet(str(tmp_path / "detail"))
    stored = spark.read.parquet(str(tmp_path / "detail"))
    plenty = stored.crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    plenty = plenty.withColumn("transaction_nbr", F.col("transaction_nbr") + F.col("copy") * 1_000_000)
    plenty = plenty.withColumn("event_10s", F.when(F.col("copy") == 0, F.col("event_10s")))  # some issues go
    plenty.drop("copy").write.parquet(str(tmp_path / "plenty"))
    detail = spark.read.parquet(str(tmp_path / "plenty"))
    bad = D.issue_rows(detail).where("transaction_nbr < 1000000")
    bad.write.parquet(str(tmp_path / "issues"))
    issues = spark.read.parquet(str(tmp_path / "issues"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        clean = D.clean_impressions(detail, run.cfg, issues, few_issues=True)
        rows = clean.collect()
        moved = exchanges(clean._jdf.queryExecution().executedPlan())
        assert same_rows(D.clean_impressions(detail, run.cfg, issues), clean)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    n, keys = detail.count(), issues.select("transaction_nbr").distinct().count()
    of_issues = detail.join(issues.select("transaction_nbr").distinct(), "transaction_nbr", "left_semi").count()
    assert len(rows) == n - of_issues and 0 < of_issues < n / 5
    # the filter's rows, the keys of the issues, and detail rows of issues with a few false positives
    detail_rows = max(rows for _, rows in moved)
    assert detail_rows <= max(of_issues, issues.count()) + n // 100, (moved, n, of_issues, keys)
