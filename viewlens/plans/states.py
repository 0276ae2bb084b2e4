"""The event summary as mergeable states: one per transaction and day.

A state holds what a day's events say of a transaction: least and greatest attribute
values, time span, counts and longest times by event code, and the first feature
event with its place in the order.  All of these are minima, maxima and sums, so the
states of any days merge into the summary of the whole window, in any grouping, and a
window that is longer by some days reads the events of these days only.  Events that
arrive late for a day make a second state of that day, which merges like any other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from viewlens.config import RunConfig
from viewlens.operators.filters import for_tenant, in_day_window, is_in
from viewlens.plans.events import FIRST_EVENT_ORDER, SUMMARY_MARKERS, T, parsed_columns, summary_aggregates

DAY = "event_date"
FIRST = "first_event"


def _check(cfg: RunConfig) -> None:
    if cfg.feature_window:
        raise ValueError("states are kept by day: a feature window in timestamps cannot be merged from them")


def daily_states(events: DataFrame, cfg: RunConfig, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The states of the events of the days ``first`` to ``last`` (default: all days of the log)."""
    _check(cfg)
    day = F.col(DAY)
    rolled = for_tenant("company_id", cfg.tenant) & is_in("script_version_id", cfg.versions)
    featured = is_in("event_id", cfg.feature_event_codes) & is_in("script_version_id", cfg.versions)
    if cfg.feature_tenant:
        featured = featured & for_tenant("company_id", cfg.tenant)
    days = day.isNotNull()
    if first is not None:
        days = days & (day >= F.lit(first))
    if last is not None:
        days = days & (day <= F.lit(last))
    marked = events.where(days & (rolled | featured)).withColumn("_r", rolled).withColumn("_f", featured)
    # a struct compares field by field, and false sorts before true: NULLs come last
    order = F.struct(*[x.alias(f"o{k}") for k, x in enumerate(
        [y for c in FIRST_EVENT_ORDER for y in (F.col(c).isNull(), F.col(c))])])
    return marked.groupBy(T, DAY).agg(*summary_aggregates(cfg), F.min(F.when(F.col("_f"), order)).alias(FIRST))


def store_days(events: DataFrame, cfg: RunConfig, path: str, first: dt.date | None = None,
               last: dt.date | None = None) -> DataFrame:
    """Adds the states of some days to those stored under ``path``, a folder for each day, and reads all back.

    Only the events of these days are read, and a window over the result reads the
    folders of its days only.  States of a day that is there already are added to it:
    give the late events alone, not the day's events again.
    """
    states = daily_states(events, cfg, first, last)
    states.write.mode("append").partitionBy(DAY).parquet(path)
    # the partition column comes last in a stored dataset
    kept = [f for f in states.schema.fields if f.name != DAY]
    return states.sparkSession.read.schema(T_.StructType([*kept, states.schema[DAY]])).parquet(path)


def _merged(c: str) -> Column:
    """A state column over several states."""
    if c.startswith("event_") and c.endswith("s") and c[6:-1].isdigit():
        return F.sum(c).alias(c)
    greatest = c.endswith(("_check", "_time")) or c in ("end_events", *SUMMARY_MARKERS)
    return (F.max(c) if greatest else F.min(c)).alias(c)


def merge_days(states: DataFrame) -> DataFrame:
    """States of the same transaction and day as one, e.g. after late events."""
    return states.groupBy(T, DAY).agg(*[_merged(c) for c in states.columns if c not in (T, DAY)])


def summary_of_states(states: DataFrame, cfg: RunConfig) -> DataFrame:
    """``event_summary`` of the configured window, from stored states of its days."""
    _check(cfg)
    inside = states.where(in_day_window(DAY, cfg.event_start, cfg.event_end, cfg.slack_days))
    merged = inside.groupBy(T).agg(*[_merged(c) for c in states.columns if c not in (T, DAY)])
    last = len(FIRST_EVENT_ORDER) * 2 - 1  # the event's text is the last part of its order
    text = merged.withColumn("event_detail_desc", F.col(FIRST)[f"o{last}"])
    return text.select("*", *parsed_columns(cfg.check_feature_length)).drop("event_detail_desc", FIRST)
