"""Daily states merge into the one-pass event summary at every split of the days."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, same_rows
from viewlens.plans import events as EV
from viewlens.plans import states as ST
from viewlens.plans.registry import ImpressionRun


@pytest.fixture(scope="module")
def run(spark):
    return ImpressionRun(spark, SF_SMALL)


@pytest.fixture(scope="module")
def events(run):
    """Some events without a key, a log key or a text, and ties of the first event."""
    k = F.col("logrec_sk")
    return run.logs.events.withColumns({
        "transaction_nbr": F.when(k % 17 != 0, F.col("transaction_nbr") % 200),
        "logrec_sk": F.when(k % 5 != 0, F.floor(k / 3)),
        "event_detail_desc": F.when(k % 6 != 0, F.col("event_detail_desc"))})


@pytest.mark.parametrize("feature_tenant", [False, True])
def test_states_of_all_days_equal_the_summary(spark, run, events, feature_tenant):
    cfg = dataclasses.replace(run.cfg, feature_tenant=feature_tenant, check_feature_length=True)
    want = EV.event_summary(events, cfg)
    got = ST.summary_of_states(ST.daily_states(events, cfg), cfg)
    assert sorted(got.columns) == sorted(want.columns)
    assert same_rows(want, got)


def test_every_split_of_the_days_gives_the_same(spark, run, events, tmp_path):
    cfg = run.cfg
    want = EV.event_summary(events, cfg).cache()
    days = [r[0] for r in events.select("event_date").distinct().where("event_date IS NOT NULL").orderBy("event_date").collect()]
    one = dt.timedelta(days=1)
    for cut in (days[0], days[len(days) // 2], days[-1]):
        states = ST.daily_states(events, cfg, last=cut).unionByName(ST.daily_states(events, cfg, first=cut + one))
        assert same_rows(want, ST.summary_of_states(states, cfg)), cut


def test_a_longer_window_reads_new_days_and_late_events_only(spark, run, events, tmp_path):
    path = str(tmp_path / "states")
    cfg, middle, one = run.cfg, dt.date(2024, 1, 15), dt.timedelta(days=1)
    late = F.col("logrec_sk") % 4 == 1  # come after their day was stored
    early = events.where(~F.coalesce(late, F.lit(False)))
    short = dataclasses.replace(cfg, event_end=middle - one)
    first = ST.store_days(early, cfg, path, last=middle)
    assert same_rows(EV.event_summary(early, short), ST.summary_of_states(first, short))
    ST.store_days(events.where(late), cfg, path, last=middle)
    whole = ST.store_days(events, cfg, path, first=middle + one)
    found = ST.summary_of_states(whole, cfg)
    assert same_rows(EV.event_summary(events, cfg), found)
    assert same_rows(EV.event_rollup_checked(EV.event_summary(events, cfg), cfg), EV.event_rollup_checked(found, cfg))
    assert "PartitionFilters: [isnotnull(event_date" in found._jdf.queryExecution().executedPlan().toString()
    merged = ST.merge_days(whole)
    assert merged.count() == merged.select("transaction_nbr", "event_date").distinct().count() < whole.count()
    assert same_rows(found, ST.summary_of_states(merged, cfg))


def test_windows_in_timestamps_are_refused(spark, run):
    cfg = dataclasses.replace(run.cfg, feature_window=(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)))
    with pytest.raises(ValueError):
        ST.daily_states(run.logs.events, cfg)
