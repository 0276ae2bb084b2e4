"""Impression detail and its audit: issue cross-tab, issue rows, clean rows.

The detail joins the transactions with the event summary, both grouped by
``transaction_nbr``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.config import RunConfig
from viewlens.functions.scalars import duration_us
from viewlens.operators.joins import without, without_few
from viewlens.operators.windows import order_by, share_of_total
from viewlens.plans.events import detail_rollup_columns, feature_columns

T = "transaction_nbr"

# Transactions columns carried into the detail, with their detail names.
TX_COLUMNS = {
    T: T, "content_url": "content_url", "company_id": "company_id", "dmm_date": "dmm_date",
    "status_id": "status_id", "media_size_id": "media_size_id", "dmm_browser": "dmm_browser",
    "dmm_browser_major_version": "dmm_browser_major_version", "dmm_os": "dmm_os",
    "dmm_device_desc": "dmm_device_desc", "dmm_device_type_attr": "dmm_device_type_attr",
    "publisher_id": "dmm_publisher_id", "message_campaign_id": "dmm_message_campaign_id",
    "view_notify": "view_notify", "user_ip": "user_ip", "server_id": "dmm_server_id",
}


def impression_detail(tx: DataFrame, summary: DataFrame, cfg: RunConfig) -> DataFrame:
    """Each impression row with its event roll-up and parsed features, plus the
    event duration.  Roll-up and features of a transaction are one row of
    ``event_summary``, so this is a single left join on the key both sides are
    partitioned by; rows without events, or with only one of the two, keep
    NULLs."""
    b = tx.select(*[F.col(s).alias(d) for s, d in TX_COLUMNS.items()])
    a = summary.select(*detail_rollup_columns(cfg), *feature_columns(cfg))
    return b.join(a, T, "left").withColumn("events_duration_us", duration_us("start_events", "end_events"))


# The eight issue kinds of the cross-tab, as SQL predicates.
ISSUE_FLAGS = {
    "multiple_10s": "event_10s > 1",
    "multiple_90s": "event_90s > 1",
    "both_10_and_90": "event_10s > 0 AND event_90s > 0",
    "multiple_versions": "script_version_id <> script_version_id_check",
    "multiple_cookies": "dtm_id <> dtm_id_check",
    "multiple_browser": "browser_desc <> browser_desc_check",
    "multiple_browser_versions": "browser_major_version_attr <> browser_major_version_attr_check",
    "multiple_os": "operating_system_desc <> operating_system_desc_check",
}

# Ad-serve vs event attribute pairs that must agree.
AD_EVENT_PAIRS = (
    ("dmm_browser", "browser_desc"), ("dmm_browser", "browser_desc_check"),
    ("dmm_browser_major_version", "browser_major_version_attr"),
    ("dmm_browser_major_version", "browser_major_version_attr_check"),
    ("dmm_os", "operating_system_desc"), ("dmm_os", "operating_system_desc_check"),
    ("dmm_device_desc", "device_desc"),
)

# Predicates are SQL text: ``<>`` and ``>`` keep three-valued logic (a NULL
# side is no evidence, and a NULL test makes a 0 flag), and each flag or the
# whole test is one expression for the JVM to parse.


def _flag(pred: str, name: str) -> Column:
    return F.expr(f"CASE WHEN {pred} THEN 1 ELSE 0 END AS `{name}`")


def pair_flag_name(a: str, b: str) -> str:
    return f"{a}_vs_{b}"


def _issue_flags(detail: DataFrame) -> dict[str, str]:
    """The issue kinds that the detail's columns allow: without the counts of an
    event code there is no test of them."""
    have = set(detail.columns)
    return {n: p for n, p in ISSUE_FLAGS.items() if set(re.findall(r"event_\d+s", p)) <= have}


def issue_crosstab(detail: DataFrame, extra_flags: bool = False) -> DataFrame:
    """Impressions per combination of the issue flags, with the percent
    of all impressions.  At most 256 groups, so the percent's window over the
    whole result is small.

    ``extra_flags`` adds one flag per ad-serve vs event pair that the issue
    rows also test (the original cross-tab leaves them out), at most 2^15
    groups.
    """
    tests = _issue_flags(detail)
    if extra_flags:
        tests |= {pair_flag_name(a, b): f"{a} <> {b}" for a, b in AD_EVENT_PAIRS}
    g = detail.groupBy(*[_flag(p, n) for n, p in tests.items()]).agg(F.count(F.lit(1)).alias("n"))
    return order_by(share_of_total(g, "n", "pct", scale=100), "pct", ties=list(tests))


def issue_sql(detail: DataFrame) -> str:
    """The tests OR-ed: the issue kinds and the seven ad/event pairs."""
    tests = list(_issue_flags(detail).values()) + [f"{a} <> {b}" for a, b in AD_EVENT_PAIRS]
    return " OR ".join(f"({t})" for t in tests)


def issue_rows(detail: DataFrame) -> DataFrame:
    """Impression rows with any inconsistency (NULL is no evidence)."""
    return detail.where(F.expr(issue_sql(detail)))


def clean_columns(cfg: RunConfig) -> list[str]:
    """The published columns of clean rows, for the event codes of the run."""
    codes = [c for k in cfg.event_codes for c in (f"event_{int(k)}s", f"event_{int(k)}_time")]
    return [*CLEAN_AD_COLUMNS, *codes, *feature_columns(cfg), "events_duration_us"]


# The published columns of clean rows before those of the event codes.
CLEAN_AD_COLUMNS = (
    T, "content_url", "company_id", "dmm_date", "status_id", "media_size_id", "dmm_browser",
    "dmm_browser_major_version", "browser_minor_version_attr", "dmm_os", "dmm_device_desc",
    "dmm_device_type_attr", "dmm_publisher_id", "dmm_message_campaign_id", "view_notify",
    "script_version_id", "dtm_id", "start_events", "end_events", "template_id")


def clean_impressions(detail: DataFrame, cfg: RunConfig, issues: DataFrame | None = None,
                      few_issues: bool = False) -> DataFrame:
    """Detail rows of transactions with no issue row at all (an issue on one
    row removes the whole transaction), narrowed to the published columns.

    The transactions are removed by an anti join with the issue rows' distinct
    keys, taken from ``issues`` if it is published, else from the detail.  Rows
    of a hot transaction are never gathered: the keys are reduced on the map
    side, and a skewed join partition is split.  Rows without a transaction key
    match nothing and are kept.

    ``few_issues``: for a stored detail that is not laid out by transaction and in
    which issues are rare.  Rows that are surely of no issue transaction are then not
    shuffled (``without_few``).
    """
    if issues is None:
        issues = issue_rows(detail)
    if few_issues:
        return without_few(detail.select(*clean_columns(cfg)), issues, T)
    return without(detail, issues.select(T).distinct(), T).select(*clean_columns(cfg))
