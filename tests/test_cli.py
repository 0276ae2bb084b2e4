"""The command line runs both analyses on files and publishes every dataset."""

from conftest import SF_SMALL, same_rows
from viewlens.__main__ import main
from viewlens.plans.registry import all_queries
from viewlens.sources.fixtures import FixtureLogs


def test_cli_impression_and_placements(spark, tmp_path):
    logs = FixtureLogs(spark, SF_SMALL)
    src = tmp_path / "logs"
    for k in ("ads", "bids", "notify", "events"):
        getattr(logs, k).write.parquet(str(src / k))
    out = tmp_path / "out"
    res = main(["impression", *sum([[f"--{k}", str(src / k)] for k in ("ads", "bids", "notify", "events")], []),
                "--ad-start", "1996-01-01 00:00:00", "--ad-end", "2000-01-01 00:00:00",
                "--event-start", "2024-01-01", "--event-end", "2024-01-30", "--tenant", "1",
                "--exclude-campaigns", "43,44,45", "--out", str(out)])
    q = all_queries()
    assert same_rows(q["browser_summary"](spark, SF_SMALL), spark.read.parquet(str(out / "browser_summary")))
    assert same_rows(q["clean_impressions"](spark, SF_SMALL), res["clean_impressions"])
    csv = tmp_path / "csv"
    logs.placements.coalesce(1).write.option("header", "true").csv(str(csv))
    main(["placements", "--csv", str(csv), "--out", str(out), "--publisher", "1", "--placement", "1"])
    assert same_rows(q["placement_series"](spark, SF_SMALL), spark.read.parquet(str(out / "placement_series")))
    assert same_rows(q["placement_summary"](spark, SF_SMALL), spark.read.parquet(str(out / "placement_summary")))
    assert spark.read.parquet(str(out / "transactions_multiplicity")).count() > 0
    assert spark.read.parquet(str(out / "issue_crosstab")).count() > 0
    assert same_rows(q["daily_summary"](spark, SF_SMALL), spark.read.parquet(str(out / "daily_summary")))
