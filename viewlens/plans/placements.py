"""The daily publisher/placement viewability analysis.

Input: the placement file as text (``sources.read_placement_csv``).  Every
summary is one ``groupBy`` with partial aggregation; the per-placement
statistics that the original attaches to each row are a grouped aggregate
joined back, never a window holding one placement's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.functions.scalars import (label, parse_date, parse_number, ratio,
                                        round_half_even, strip_chars, zero_if_missing)
from viewlens.operators.aggregates import count_at_least, mean_sd
from viewlens.operators.bitmaps import with_distinct_numbers
from viewlens.operators.filters import drill, min_days, min_volume
from viewlens.operators.windows import order_by, with_group_stats

PUB, PLC, DAY = "publisher_id", "placement_id", "date"
TOT, MEAS, VIEW, INV = "total_impressions", "measured_impressions", "viewed_impressions", "in_view"


def placement_clean(raw: DataFrame, date_format: str = "M-d-yyyy") -> DataFrame:
    """Typed rows: ids as read, date parsed (bad -> NULL), ``%`` and thousands separators
    stripped, missing numbers -> 0, plus viewed = round-half-even(in_view x
    measured / 100)."""
    num = lambda c, chars: zero_if_missing(parse_number(strip_chars(c, chars)))
    df = raw.select(
        parse_date(DAY, date_format).alias(DAY),
        F.col(PUB), F.col(PLC),
        num(INV, "%").alias(INV),
        num(MEAS, ",").alias(MEAS),
        num(TOT, ",").alias(TOT),
    )
    return df.withColumn(VIEW, round_half_even(F.col(INV) * F.col(MEAS) / 100))


def _volume_aggs() -> list:
    return [
        count_at_least(TOT, 100).alias("more_100_imps"),
        count_at_least(MEAS, 100).alias("more_100_meas"),
        count_at_least(TOT, 1000).alias("more_1000_imps"),
        count_at_least(MEAS, 1000).alias("more_1000_meas"),
    ]


def _rates(df: DataFrame, on_zero: str) -> DataFrame:
    return (df.withColumn("measured_rate", ratio(MEAS, TOT, on_zero))
              .withColumn("viewed_rate", ratio(VIEW, MEAS, on_zero)))


THRESHOLDS = ("more_100_imps", "more_100_meas", "more_1000_imps", "more_1000_meas")


def _sums(*counts: str) -> list:
    return [F.sum(c).alias(c) for c in (*counts, TOT, MEAS, VIEW)]


def _days_and_publishers(clean: DataFrame) -> DataFrame:
    """Grouped by (day, publisher, placement), then by (day, publisher): the
    groups of each level are the distinct values the next one counts, NULL
    included, so no distinct count expands the rows."""
    level = clean.groupBy(DAY, PUB, PLC).agg(F.sum(TOT).alias(TOT), F.sum(MEAS).alias(MEAS),
                                             F.sum(VIEW).alias(VIEW), *_volume_aggs())
    return level.groupBy(DAY, PUB).agg(F.count(F.lit(1)).alias("pub_placements"), *_sums(*THRESHOLDS))


def _in_key_order(df: DataFrame, ordered: bool, *keys: str) -> DataFrame:
    """Grouped rows in the order of their keys, NULL last, on wish."""
    return order_by(df, list(keys)) if ordered else df


def daily_summary(clean: DataFrame, on_zero: str = "ieee", ordered: bool = False) -> DataFrame:
    """Per day: publishers, publisher-placements, volumes, rates, threshold counts."""
    g = _days_and_publishers(clean).groupBy(DAY).agg(
        F.count(F.lit(1)).alias("publishers"), *_sums("pub_placements", *THRESHOLDS))
    g = _in_key_order(_rates(g, on_zero), ordered, DAY)
    return g.select(DAY, "publishers", "pub_placements", TOT, MEAS, VIEW,
                    "measured_rate", "viewed_rate", "more_100_imps", "more_100_meas",
                    "more_1000_imps", "more_1000_meas")


def publisher_day(clean: DataFrame, on_zero: str = "ieee", ordered: bool = False) -> DataFrame:
    """Per publisher and day: placement rows, volumes, rates, threshold counts."""
    g = clean.groupBy(PUB, DAY).agg(
        F.count(F.lit(1)).alias("placements"),
        F.sum(MEAS).alias(MEAS), F.sum(TOT).alias(TOT), F.sum(VIEW).alias(VIEW),
        *_volume_aggs())
    g = _in_key_order(_rates(g, on_zero), ordered, PUB, DAY)
    return g.select(PUB, DAY, "placements", MEAS, TOT, VIEW, "measured_rate", "viewed_rate",
                    "more_100_imps", "more_100_meas", "more_1000_imps", "more_1000_meas")


def publisher_summary(pub_day: DataFrame, ordered: bool = False) -> DataFrame:
    """Per publisher over its days: day count, placement spread, mean and sd of
    volumes and of the daily rates (unweighted means of daily rates)."""
    g = pub_day.groupBy(PUB).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("placements").alias("mean_placements"),
        F.min("placements").alias("min_placements"),
        F.max("placements").alias("max_placements"),
        *mean_sd(MEAS, "measured"), *mean_sd(TOT, "total"), *mean_sd(VIEW, "viewed"),
        *mean_sd("measured_rate", "measured_rate"), *mean_sd("viewed_rate", "viewed_rate"))
    return _in_key_order(g, ordered, PUB)


GROUP_STATS = {"mean_imps": "mean", "sd_imps": "sd", "max_imps": "max",
               "min_imps": "min", "days": "count"}


def stable_placements(clean: DataFrame, min_total: float = 1000, min_days_: int = 20,
                      ordered: bool = True) -> DataFrame:
    """Day rows with at least ``min_total`` impressions, of placements with at
    least ``min_days_`` such rows; each row carries its placement's volume
    statistics and its measure rate.  Ordered by mean volume, largest first."""
    big = min_volume(clean, TOT, min_total)
    df = with_group_stats(big, [PUB, PLC], TOT, GROUP_STATS)
    df = min_days(df, "days", min_days_).withColumn("measure_rate", ratio(MEAS, TOT))
    return order_by(df, "mean_imps", desc=True, ties=[PUB, PLC, DAY]) if ordered else df


def placement_summary(clean: DataFrame, min_total: float = 1000, min_days_: int = 20,
                      ordered: bool = True) -> DataFrame:
    """Per stable placement: volume statistics, measure-rate and in-view
    statistics.  One grouped aggregate with a row-count condition; the
    per-row statistics of ``stable_placements`` are constant per group, so
    their max/min are the statistics themselves.  Ordered by in-view
    volatility, largest first."""
    big = min_volume(clean, TOT, min_total).withColumn("measure_rate", ratio(MEAS, TOT))
    g = big.groupBy(PUB, PLC).agg(
        F.avg(TOT).alias("mean_imps"), F.max(TOT).alias("max_imps"),
        F.stddev_samp(TOT).alias("sd_imps"), F.min(TOT).alias("min_imps"),
        F.count(F.lit(1)).alias("days"),
        F.avg("measure_rate").alias("mean_measure_rate"),
        F.stddev_samp("measure_rate").alias("sd_measure_rate"),
        F.max("measure_rate").alias("max_measure_rate"),
        F.min("measure_rate").alias("min_measure_rate"),
        F.avg(INV).alias("mean_in_view"), F.stddev_samp(INV).alias("sd_in_view"),
        F.max(INV).alias("max_in_view"), F.min(INV).alias("min_in_view"))
    g = min_days(g, "days", min_days_)
    return order_by(g, "sd_in_view", desc=True, ties=[PUB, PLC]) if ordered else g


def placement_series(clean: DataFrame, publisher_id: str, placement_id: str,
                     min_total: float = 1000, min_days_: int = 20) -> DataFrame:
    """One placement's stable daily rows (drill-down), by date.

    The drill comes first: it reaches the scan, and only this placement's
    statistics are computed."""
    one = drill(clean, **{PUB: str(publisher_id), PLC: str(placement_id)})
    return order_by(stable_placements(one, min_total, min_days_, ordered=False), DAY)


def placement_totals(clean: DataFrame, ordered: bool = False) -> DataFrame:
    """Per publisher-placement: distinct days and volume sums."""
    # two dates are a number of days apart, so a day is a bit
    g = with_distinct_numbers(clean, [PUB, PLC], F.unix_date(DAY), "days", (TOT, MEAS, VIEW))
    return _in_key_order(g, ordered, PUB, PLC).select(PUB, PLC, "days", MEAS, TOT, VIEW)


def publishers_per_placement(totals: DataFrame, ordered: bool = False) -> DataFrame:
    """How many publishers carry each placement id."""
    return _in_key_order(totals.groupBy(PLC).agg(F.count(F.lit(1)).alias("publishers")), ordered, PLC)


def daily_rates(clean: DataFrame, on_zero: str = "ieee", ordered: bool = False) -> DataFrame:
    """Short daily recap: volumes, viewed and measured rates, publishers."""
    by_publisher = clean.groupBy(DAY, PUB).agg(*_sums())
    g = by_publisher.groupBy(DAY).agg(F.count(F.lit(1)).alias("publishers"), *_sums())
    return _in_key_order(g, ordered, DAY).select(DAY, TOT, MEAS, ratio(VIEW, MEAS, on_zero).alias("viewed_rate"),
                    ratio(MEAS, TOT, on_zero).alias("measured_rate"), "publishers")


DAILY_SERIES = ("publishers", "pub_placements", TOT, MEAS, VIEW, "measured_rate", "viewed_rate")


# The scatter plots of the placement summary, as (x, y).
SCATTER_PAIRS = (
    ("mean_in_view", "sd_in_view"), ("mean_imps", "sd_in_view"), ("min_imps", "sd_in_view"), ("days", "sd_in_view"),
    ("mean_measure_rate", "sd_measure_rate"), ("mean_measure_rate", "mean_in_view"),
    ("sd_measure_rate", "sd_in_view"))


def chart_series(daily: DataFrame, stable: DataFrame, summary: DataFrame,
                 series: DataFrame | None = None) -> DataFrame:
    """Tidy (chart, series, day, x, y) rows behind the plots.

    ``daily``: every measure of ``daily_summary`` by day.  ``stable_in_view``:
    each stable placement's in-view share by day.  ``scatter``: a row per stable
    placement for each of the seven pairs of ``placement_summary`` columns.  With
    a ``placement_series``: ``drill_in_view`` by day and ``drill_scatter`` of
    measured impressions against the in-view share.  Line charts have ``day``
    and no ``x``, scatter plots the reverse.  Published inputs are read, not
    computed again.
    """
    by_day = lambda chart, name, df, y: df.select(
        F.lit(chart).alias("chart"), name.alias("series"), F.col(DAY).alias("day"),
        F.lit(None).cast("double").alias("x"), y.cast("double").alias("y"))
    points = lambda chart, name, df, x, y: df.select(
        F.lit(chart).alias("chart"), name.alias("series"), F.lit(None).cast("date").alias("day"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    measures = daily.select(DAY, *[F.col(c).cast("double").alias(c) for c in DAILY_SERIES]) \
        .unpivot([DAY], list(DAILY_SERIES), "series", "y")
    out = by_day("daily", F.col("series"), measures, F.col("y"))
    out = out.unionByName(by_day("stable_in_view", label(PUB, PLC), stable, F.col(INV)))
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{y} by {x}").alias("series"), F.col(x).cast("double").alias("x"),
                                         F.col(y).cast("double").alias("y")) for x, y in SCATTER_PAIRS]))
    out = out.unionByName(summary.select(pairs.alias("p")).select(
        F.lit("scatter").alias("chart"), "p.series", F.lit(None).cast("date").alias("day"), "p.x", "p.y"))
    if series is not None:
        out = out.unionByName(by_day("drill_in_view", label(PUB, PLC), series, F.col(INV)))
        out = out.unionByName(points("drill_scatter", label(PUB, PLC), series, MEAS, INV))
    return out
