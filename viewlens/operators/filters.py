"""Row filters and predicates (all native, all pushable to the scan where the
column comes straight from it)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.functions.scalars import DAY_US, any_of, col, lit_date, lit_ts, readable_time, time_us


def in_window(ts: str | Column, start: dt.datetime, end: dt.datetime,
              date_col: str | Column | None = None) -> Column:
    """``start <= ts <= end``, both ends included.

    ``date_col`` is the day that the timestamp was made of (``day_of_ts``); it
    adds a bound that a date-partitioned source can prune on, which the
    timestamp test alone cannot.  One day of slack before the first leaves room
    for the time of day ``24:00:00``, which belongs to the next day.
    """
    p = col(ts).between(lit_ts(start), lit_ts(end))
    if date_col is not None:
        p = col(date_col).between(lit_date(start.date() - dt.timedelta(days=1)), lit_date(end.date())) & p
    return p


def _us_of(t: dt.datetime) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def in_day_time_window(day: str | Column, time: str | Column, start: dt.datetime, end: dt.datetime) -> Column:
    """``start <= day + time <= end`` on a day and a time-of-day text, without making the timestamp.

    The days are bounded, which reaches a scan and prunes partitions.  Rows of the
    days inside need only a readable time; the time is compared on the two days at
    the window's edges alone.  ``24:00:00`` belongs to the next day, so it is also
    looked for on the day before a window that begins at midnight.
    """
    if start > end:
        return F.lit(False)
    lo, hi, from_us, to_us = start.date(), end.date(), _us_of(start), _us_of(end)
    d, us, one = col(day), time_us(time), dt.timedelta(days=1)
    # rows of the first and of the last day that are in
    after, before = us >= F.lit(from_us), us <= F.lit(to_us)
    edges = [(d == lit_date(lo)) & after & before] if lo == hi else [
        (d == lit_date(lo)) & after, (d == lit_date(hi)) & before]
    if (hi - lo).days > 1:
        edges.insert(0, (d > lit_date(lo)) & (d < lit_date(hi)))
    first = lo
    if from_us == 0:
        first = lo - one
        edges.append((d == lit_date(first)) & (us == F.lit(DAY_US)))
    return d.between(lit_date(first), lit_date(hi)) & readable_time(time) & any_of(edges)


DAY_OF, TIME_OF = "day_of", "time_of"


def day_column(day: str, ts: str) -> Column:
    """The column ``day``, marked as the day that the timestamp ``ts`` was made of."""
    return F.col(day).cast("date").alias(day, metadata={DAY_OF: ts})


def time_column(time: str, ts: str) -> Column:
    """The column ``time``, marked as the time of day that the timestamp ``ts`` was made of."""
    return F.col(time).cast("string").alias(time, metadata={TIME_OF: ts})


def _marked(df: DataFrame, mark: str, ts: str) -> str | None:
    return next((f.name for f in df.schema.fields if f.metadata.get(mark) == ts), None)


def day_of_ts(df: DataFrame, day: str, ts: str) -> str | None:
    """``day`` if it is marked as the day of ``ts`` in this frame, else None.

    Only then does a bound on the day follow from a window on the timestamp: a
    day column of any other origin may differ from the timestamp's day.
    """
    return day if _marked(df, DAY_OF, ts) == day else None


def in_log_window(df: DataFrame, ts: str, start: dt.datetime, end: dt.datetime) -> Column:
    """``start <= ts <= end`` on a log: by the day and time columns that ``ts`` was made of, where it has them."""
    day, time = _marked(df, DAY_OF, ts), _marked(df, TIME_OF, ts)
    if day and time:
        return in_day_time_window(day, time, start, end)
    return in_window(ts, start, end, date_col=day)


def in_day_window(d: str | Column, start: dt.date, end: dt.date, slack_days: int = 1) -> Column:
    """``start - slack <= d <= end + slack`` on a date column."""
    lo = start - dt.timedelta(days=slack_days)
    hi = end + dt.timedelta(days=slack_days)
    return col(d).between(lit_date(lo), lit_date(hi))


def for_tenant(c: str | Column, tenant: int | None) -> Column:
    """Tenant equality; ``None`` keeps every tenant."""
    return F.lit(True) if tenant is None else (col(c) == F.lit(tenant))


def is_in(c: str | Column, values: Iterable) -> Column:
    return col(c).isin(list(values))


def not_in(c: str | Column, values: Iterable) -> Column:
    """SQL ``NOT IN``: rows whose value is NULL are dropped too."""
    vals = list(values)
    if not vals:
        return col(c).isNotNull() | col(c).isNull()
    return ~col(c).isin(vals)


def multi_row(df: DataFrame, nrows: str = "nrows") -> DataFrame:
    """Groups that held more than one row."""
    return df.where(F.col(nrows) > 1)


def differs(a: str | Column, b: str | Column) -> Column:
    """``a <> b`` in three-valued logic: NULL on either side is not a difference."""
    return col(a) != col(b)


def min_volume(df: DataFrame, c: str, n: float) -> DataFrame:
    return df.where(F.col(c) >= n)


def min_days(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.where(F.col(c) >= n)


def drill(df: DataFrame, **eq) -> DataFrame:
    """Rows equal to every given key value, e.g. ``drill(df, publisher_id=1)``."""
    preds = [F.col(k) == F.lit(v) for k, v in eq.items()]
    p = preds[0]
    for q in preds[1:]:
        p = p & q
    return df.where(p)
