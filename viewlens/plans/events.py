"""Browser-event side: one summary of the event log per transaction.

``event_summary`` reads the event log once and groups it once by transaction,
with partial aggregation, so a transaction with a huge share of the events is
reduced on every mapper before the shuffle.  The roll-up, the parsed features
and the checked roll-up are projections of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.config import RunConfig
from viewlens.functions.features import FEATURE_COLUMNS, parse_feature_string
from viewlens.functions.scalars import day_of, duration_us
from viewlens.operators.aggregates import event_counts, event_detail, event_times
from viewlens.operators.filters import for_tenant, in_day_window, in_log_window, is_in
from viewlens.operators.windows import first_per_key

T = "transaction_nbr"

FIRST_EVENT_COLUMNS = (T, "event_detail_desc", "browser_desc", "browser_major_version_attr",
                       "browser_minor_version_attr", "operating_system_desc", "device_desc",
                       "device_type_attr", "device_manufacturer_attr")


FEATURE_MIN_LENGTH = 35
LENGTH_CHECK = "feature_string_ok"


def feature_condition(events: DataFrame, cfg: RunConfig) -> Column:
    """Events that carry the feature string, in the feature window."""
    if cfg.feature_window:
        w = in_log_window(events, "event_ts", *cfg.feature_window)
    else:
        w = in_day_window("event_date", cfg.event_start, cfg.event_end, cfg.slack_days)
    p = w & is_in("event_id", cfg.feature_event_codes) & is_in("script_version_id", cfg.versions)
    return p & for_tenant("company_id", cfg.tenant) if cfg.feature_tenant else p


def rollup_condition(cfg: RunConfig) -> Column:
    """Events of the widened date window, tenant and audited versions."""
    return (in_day_window("event_date", cfg.event_start, cfg.event_end, cfg.slack_days)
            & for_tenant("company_id", cfg.tenant) & is_in("script_version_id", cfg.versions))


# The first feature event: by log key, events without one last, then by text.
FIRST_EVENT_ORDER = ("logrec_sk", "event_detail_desc")


def first_feature_event(events: DataFrame, cfg: RunConfig) -> DataFrame:
    """Earliest feature-carrying event (by ``logrec_sk``) of each transaction."""
    fe = events.where(feature_condition(events, cfg)).select(*FIRST_EVENT_COLUMNS, "logrec_sk")
    first = first_per_key(fe, T, list(FIRST_EVENT_ORDER), rank_col="r_n")
    return first.select(*FIRST_EVENT_COLUMNS, "r_n")


def parsed_columns(check_length: bool) -> list[Column]:
    """The feature string's columns; ``check_length`` adds ``feature_string_ok``:
    1 when it reaches the last fixed flag offset (35), 0 when the flags are
    partly blank, NULL without a string."""
    cols = parse_feature_string("event_detail_desc")
    if check_length:
        cols.append(F.when(F.length("event_detail_desc") >= FEATURE_MIN_LENGTH, 1)
                    .when(F.col("event_detail_desc").isNotNull(), 0).alias(LENGTH_CHECK))
    return cols


def feature_columns(cfg: RunConfig) -> list[str]:
    return [*FEATURE_COLUMNS, *([LENGTH_CHECK] if cfg.check_feature_length else [])]


def features(first: DataFrame, check_length: bool = False) -> DataFrame:
    """The packed capability string split into 51 columns."""
    return first.select(T, *parsed_columns(check_length))


# Columns of the roll-up that the impression detail carries (its lighter form).
DETAIL_ROLLUP_COLUMNS = (
    "script_version_id", "script_version_id_check", "dtm_id", "dtm_id_check", "cookie_dtm_id",
    "start_events", "end_events", "server_id", "publisher_id", "message_campaign_id",
    "message_campaign_id_check", "template_id", "browser_desc", "browser_desc_check",
    "browser_major_version_attr", "browser_major_version_attr_check", "browser_minor_version_attr",
    "operating_system_desc", "operating_system_desc_check", "device_desc", "device_desc_check",
    "device_type_attr", "device_manufacturer_attr")


def detail_rollup_columns(cfg: RunConfig) -> list[str]:
    codes = []
    for c in cfg.event_codes:
        codes += [f"event_{c}s", f"event_{c}_time"]
    return [T, *DETAIL_ROLLUP_COLUMNS, *codes, "event_90_detail", "event_90_detail_check"]


# Attributes with their check (maximum) in the roll-up, in its order.
CHECKED_IDS = ("script_version_id", "dtm_id", "cookie_dtm_id")
CHECKED_ATTRIBUTES = ("server_id", "publisher_id", "message_campaign_id", "template_id", "browser_desc",
                      "browser_major_version_attr", "browser_minor_version_attr", "operating_system_desc",
                      "device_desc", "device_type_attr", "device_manufacturer_attr")
SUMMARY_MARKERS = ("has_rollup", "has_features")


def summary_aggregates(cfg: RunConfig) -> list[Column]:
    """The roll-up's aggregates over rows marked ``_r``, and the markers of ``_r`` and ``_f``."""
    # SQL text: one call to the JVM per column instead of one per sub-expression
    def both(c: str) -> list[Column]:
        return [F.expr(f"min(CASE WHEN _r THEN `{c}` END) AS `{c}`"),
                F.expr(f"max(CASE WHEN _r THEN `{c}` END) AS `{c}_check`")]
    aggs = [x for c in CHECKED_IDS for x in both(c)]
    aggs += [F.expr(f"{fn}(CASE WHEN _r THEN {c} END) AS {name}") for fn, c, name in (
        ("min", "company_id", "company_id"), ("min", "event_ts", "start_events"), ("max", "event_ts", "end_events"))]
    aggs += [x for c in CHECKED_ATTRIBUTES for x in both(c)]
    for c in cfg.event_codes:
        aggs += event_counts([c], only="_r") + event_times([c], only="_r")
    aggs += event_detail(90, only="_r")
    return aggs + [F.max(F.when(F.col(m), 1)).alias(name) for m, name in zip(("_r", "_f"), SUMMARY_MARKERS)]


def event_summary(events: DataFrame, cfg: RunConfig) -> DataFrame:
    """The roll-up and the parsed first feature event of every transaction
    from ONE scan and ONE shuffle of the event log.

    Rows passing either filter are grouped once by transaction.  Each roll-up
    aggregate only sees rows passing the roll-up filter, so a transaction with
    no such row gets NULL in every roll-up column; ``has_rollup`` marks the
    others.  The feature string is that of the first feature event in the order
    of ``first_feature_event``; only the string and its order go through the
    shuffle.
    """
    marked = events.where(rollup_condition(cfg) | feature_condition(events, cfg)) \
        .withColumn("_r", rollup_condition(cfg)).withColumn("_f", feature_condition(events, cfg))

    # a struct compares field by field, and false sorts before true: NULLs come last
    order = F.struct(*[x for c in FIRST_EVENT_ORDER for x in (F.col(c).isNull(), F.col(c))])
    first = F.min_by("event_detail_desc", F.when(F.col("_f"), order)).alias("event_detail_desc")
    summary = marked.groupBy(T).agg(*summary_aggregates(cfg), first)
    return summary.select("*", *parsed_columns(cfg.check_feature_length)).drop("event_detail_desc")


def event_rollup(events: DataFrame, cfg: RunConfig) -> DataFrame:
    """Per transaction: version, ids, dimension values with their checks,
    time span, per-code counts and longest times, the code-90 detail."""
    return rollup_from_summary(event_summary(events, cfg), cfg)


def rollup_from_summary(summary: DataFrame, cfg: RunConfig) -> DataFrame:
    """The roll-up's rows and columns of ``event_summary``."""
    other = {*feature_columns(cfg), *SUMMARY_MARKERS}
    return summary.where("has_rollup = 1").select(*[c for c in summary.columns if c not in other])


def features_from_summary(summary: DataFrame) -> DataFrame:
    """``features`` rows out of ``event_summary``."""
    return summary.where("has_features = 1").select(
        T, *[c for c in summary.columns if c in FEATURE_COLUMNS or c == LENGTH_CHECK])


def event_rollup_checked(summary: DataFrame, cfg: RunConfig) -> DataFrame:
    """The full roll-up with the parsed features, kept when its first event's
    day is in the widened window and its version is audited, plus the
    duration between first and last event in microseconds.

    A filter and projection of ``event_summary``.  The features belong to the
    transaction by its number, so rows without one have none."""
    kept = summary.where("has_rollup = 1").where(
        in_day_window(day_of("start_events"), cfg.event_start, cfg.event_end, cfg.slack_days)
        & is_in("script_version_id", cfg.versions))
    parsed = feature_columns(cfg)
    rollup = [c for c in summary.columns if c not in {*parsed, *SUMMARY_MARKERS}]
    return kept.select(*rollup, *[F.when(F.col(T).isNotNull(), F.col(c)).alias(c) for c in parsed],
                       duration_us("start_events", "end_events").alias("events_duration_us"))
