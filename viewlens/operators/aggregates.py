"""Aggregate expressions and grouped summaries.

Every helper returns aggregate ``Column`` expressions, so Spark plans them with
partial (map-side) aggregation before the shuffle: a key holding a large share
of the rows is reduced on each mapper first and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.functions.scalars import col, readable_time


def min_max_check(pairs: Mapping[str, tuple[str, str]]) -> list[Column]:
    """For ``{source: (min_name, max_name)}``: the minimum as the value and the
    maximum as its check; the attribute is constant in the group iff equal."""
    out = []
    for src, (lo, hi) in pairs.items():
        out += [F.expr(f"min(`{src}`) AS `{lo}`"), F.expr(f"max(`{src}`) AS `{hi}`")]
    return out


def span(ts: str, start: str = "start_events", end: str = "end_events") -> list[Column]:
    return [F.min(ts).alias(start), F.max(ts).alias(end)]


# The per-code aggregates are written as SQL expression text: one call to the
# JVM per column instead of one per sub-expression (there are 20 per roll-up).
# ``only`` names a boolean column; rows where it is false count as not there.
def _per_code(fn: str, code: int, value: str, event: str, only: str | None, name: str) -> Column:
    inner = f"CASE WHEN `{event}` = {code} THEN {value} ELSE 0 END"
    return F.expr(f"{fn}(CASE WHEN {only} THEN {inner} END) AS {name}" if only else f"{fn}({inner}) AS {name}")


def event_counts(codes: Iterable[int], event: str = "event_id", only: str | None = None) -> list[Column]:
    """Rows per event code: ``event_<code>s`` (0 when absent)."""
    return [_per_code("sum", int(c), "1", event, only, f"event_{int(c)}s") for c in codes]


def event_times(codes: Iterable[int], ms: str = "elapsed_time_ms_meas", event: str = "event_id",
                only: str | None = None) -> list[Column]:
    """Largest elapsed time per event code, floored at 0: ``event_<code>_time``."""
    return [_per_code("max", int(c), f"`{ms}`", event, only, f"event_{int(c)}_time") for c in codes]


def event_detail(code: int = 90, detail: str = "event_detail_desc", event: str = "event_id",
                 only: str | None = None) -> list[Column]:
    """Min and max of the detail string over one event code (NULL if none)."""
    name, mine = f"event_{code}_detail", f"`{event}` = {code}" + (f" AND {only}" if only else "")
    return [F.expr(f"{fn}(CASE WHEN {mine} THEN `{detail}` END) AS {out}")
            for fn, out in (("min", name), ("max", f"{name}_check"))]


def n_unique(*cols: str | Column) -> Column:
    """Distinct values (or value combinations), counting NULL as a value."""
    return F.count_distinct(F.struct(*[col(c) for c in cols]))


def count_at_least(c: str | Column, n: float) -> Column:
    return F.count_if(col(c) >= n)


def mean_sd(c: str | Column, name: str) -> list[Column]:
    """Mean and sample standard deviation (NULL for a single row)."""
    return [F.avg(col(c)).alias(f"mean_{name}"), F.stddev_samp(col(c)).alias(f"sd_{name}")]


def unreadable_times(time_c: str | Column) -> Column:
    """Rows whose text is there but is no time of day: a log's windows drop them."""
    return F.count_if(col(time_c).isNotNull() & ~readable_time(time_c))


def global_count(df: DataFrame, name: str = "n") -> DataFrame:
    """Row count as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def multiplicity(df: DataFrame, by: str = "nrows", name: str = "trans") -> DataFrame:
    """Histogram of a count column: how many groups had each row count."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
