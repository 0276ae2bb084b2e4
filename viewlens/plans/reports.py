"""Published summaries of the clean impressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.config import RunConfig
from viewlens.sources.sinks import publish

SUMMARY_KEYS = ("company_id", "dmm_browser", "dmm_browser_major_version", "dmm_os")


# The event codes that the summary counts, in its order.
SUMMARY_CODES = (10, 90, 30, 80)


def browser_summary(clean: DataFrame, cfg: RunConfig) -> DataFrame:
    """Per company, browser, major version and OS: impressions, by script
    version (and none), by version with each event code seen, each code seen,
    and notified impressions by version.  Versions and event codes are those
    of the run."""
    versions, codes = cfg.versions, [c for c in SUMMARY_CODES if c in cfg.event_codes]
    v = F.col("script_version_id")
    vnull = v.isNull()
    seen = lambda c: F.col(f"event_{c}s") > 0
    notified = F.col("view_notify") > 0
    aggs = [F.count(F.lit(1)).alias("impressions")]
    aggs += [F.count_if(v == x).alias(f"v{x}") for x in versions]
    aggs += [F.count_if(vnull).alias("v_null")]
    for c in codes:
        aggs += [F.count_if((v == x) & seen(c)).alias(f"v{x}_event{c}") for x in versions]
    aggs += [F.count_if(seen(c)).alias(f"total{c}") for c in codes]
    aggs += [F.count_if((v == x) & notified).alias(f"v{x}_view_notify") for x in versions]
    aggs += [F.count_if(vnull & notified).alias("v_null_view_notify")]
    return clean.groupBy(*SUMMARY_KEYS).agg(*aggs)


def detail_snapshot(detail: DataFrame, name: str = "impression_detail", **kw) -> DataFrame:
    """Durable copy of the impression detail, laid out by transaction."""
    return publish(detail, name, cluster_by="transaction_nbr", **kw)
