"""Impression side: bids, view notifications, and one row per served ad.

All frames are keyed by ``transaction_nbr``.  ``transactions`` pre-aggregates
both the ad and the bid log to one row per (transaction, URL) *before* the
join, so a transaction with many bids never fans out raw rows: the original
``count(*)`` over the ad x bid product is the product of the two group counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.config import RunConfig
from viewlens.functions.scalars import domain_name
from viewlens.operators.aggregates import global_count, multiplicity
from viewlens.operators.filters import for_tenant, in_log_window, is_in, multi_row, not_in
from viewlens.operators.joins import attach_notify
from viewlens.operators.skew import SHARE, hot_keys, salted_left_join
from viewlens.operators.windows import share_of_total

T = "transaction_nbr"


def bid_domains(bids: DataFrame, cfg: RunConfig) -> DataFrame:
    """In-window bids of the tenant with a kept operation, URL reduced to its
    domain.  Not deduplicated."""
    b = bids.where(in_log_window(bids, "bid_ts", cfg.ad_start, cfg.ad_end)
                   & for_tenant("company_id", cfg.tenant)
                   & is_in("operation_id", cfg.operations))
    return b.select("company_id", T, domain_name("content_url").alias("content_url"))


def view_notify(notify: DataFrame, cfg: RunConfig) -> DataFrame:
    """One row per notified transaction: marker 1 and the notification count."""
    n = notify.where(in_log_window(notify, "dmm_ts", cfg.ad_start, cfg.ad_end)
                     & for_tenant("company_id", cfg.tenant)
                     & not_in("media_size_id", cfg.excluded_media_sizes))
    g = n.groupBy(T).agg(F.count(F.lit(1)).alias("view_notify_nrows"))
    return g.select(T, F.lit(1).alias("view_notify"), "view_notify_nrows")


def served_ads(ads: DataFrame, cfg: RunConfig) -> DataFrame:
    """Ad-serve rows of the window, tenant, kept statuses, minus excluded media
    sizes and campaigns (``NOT IN`` also drops NULLs)."""
    return ads.where(in_log_window(ads, "dmm_ts", cfg.ad_start, cfg.ad_end)
                     & for_tenant("company_id", cfg.tenant)
                     & is_in("status_id", cfg.statuses)
                     & not_in("media_size_id", cfg.excluded_media_sizes)
                     & not_in("message_campaign_id", cfg.excluded_campaigns))


# The published columns in their order.
TRANSACTION_COLUMNS = (
    T, "dmm_url", "bid_url", "content_url", "company_id", "dmm_date", "dmm_date_check",
    "company_id_dmm", "company_id_check", "status_id", "status_id_check", "media_size_id",
    "media_size_id_check", "dmm_browser", "browser_check", "dmm_browser_major_version",
    "dmm_browser_minor_version", "dmm_os", "dmm_device_desc", "dmm_device_type_attr",
    "publisher_id", "message_campaign_id", "user_ip", "nrows", "view_notify", "server_id")


# Fixed values: (function, ad-log column, output): "value" (min) and "check" (max) pairs and
# single representatives of each (transaction, ad URL, company) group.
AD_GROUP_AGGS = (
    ("min", "dmm_date", "dmm_date"), ("max", "dmm_date", "dmm_date_check"),
    ("min", "company_id", "company_id_dmm"), ("max", "company_id", "company_id_check"),
    ("min", "status_id", "status_id"), ("max", "status_id", "status_id_check"),
    ("min", "media_size_id", "media_size_id"), ("max", "media_size_id", "media_size_id_check"),
    ("min", "browser_desc", "dmm_browser"), ("max", "browser_desc", "browser_check"),
    ("min", "browser_major_version_attr", "dmm_browser_major_version"),
    ("min", "browser_minor_version_attr", "dmm_browser_minor_version"),
    ("min", "operating_system_desc", "dmm_os"),
    ("min", "device_desc", "dmm_device_desc"),
    ("min", "device_type_attr", "dmm_device_type_attr"),
    ("min", "publisher_id", "publisher_id"),
    ("min", "message_campaign_id", "message_campaign_id"),
    ("min", "CAST(user_ip AS STRING)", "user_ip"),
    ("max", "server_id", "server_id"),
)


def hot_bid_transactions(bids: DataFrame, share: float = SHARE) -> DataFrame:
    """Transactions that hold at least ``share`` of the rows of ``bid_domains`` output."""
    return hot_keys(bids, T, share)


def transactions(ads: DataFrame, bids: DataFrame, notify: DataFrame, cfg: RunConfig,
                 hot_bids: DataFrame | None = None) -> DataFrame:
    """One row per transaction x ad URL x bid URL x company.

    ``bids`` is ``bid_domains`` output and ``notify`` is ``view_notify``
    output.  Every value column is a min or max over the group ("value" and
    "check" pairs), ``nrows`` the number of joined ad x bid rows.
    ``hot_bids`` (``hot_bid_transactions``): transactions with so many bids that
    their bids have to be joined in several tasks.
    """
    a = served_ads(ads, cfg)
    ad_groups = a.groupBy(T, F.col("content_url").alias("dmm_url"), "company_id").agg(
        *[F.expr(f"{fn}({src}) AS {out}") for fn, src, out in AD_GROUP_AGGS],
        F.count(F.lit(1)).alias("ad_rows"))
    # With one tenant on both sides the company key is constant, so join on the
    # transaction alone: the bid join, notify join and the later roll-up joins
    # then share one hash partitioning on transaction_nbr.
    keys = [T] if cfg.tenant is not None else [T, "company_id"]
    bid_groups = bids.groupBy(*keys, F.col("content_url").alias("bid_url")) \
                     .agg(F.count(F.lit(1)).alias("bid_rows"))
    if hot_bids is None:
        j = ad_groups.join(bid_groups, keys, "left")
    else:
        j = salted_left_join(ad_groups, bid_groups, keys, hot_bids, T, spread="bid_url")
    j = attach_notify(j, notify.select(T, "view_notify"))
    j = j.withColumn("content_url", F.coalesce(F.col("bid_url"), domain_name("dmm_url"))) \
         .withColumn("nrows", F.col("ad_rows") * F.coalesce(
             F.lit(1) if cfg.dedupe_bids else F.col("bid_rows"), F.lit(1)))
    return j.select(*TRANSACTION_COLUMNS)


def transactions_multiplicity(tx: DataFrame) -> DataFrame:
    """How many transaction groups had each row count, with the share of all
    groups and its complement, by row count.  The share is a window over the
    whole histogram, which has one row per distinct ``nrows``."""
    h = share_of_total(multiplicity(tx, "nrows", "trans"), "trans", "prop_trans")
    return h.withColumn("prop_rest", 1 - F.col("prop_trans")).orderBy("nrows")


def multi_row_transactions(tx: DataFrame) -> DataFrame:
    return multi_row(tx, "nrows")


def multi_row_count(tx: DataFrame) -> DataFrame:
    return global_count(multi_row(tx, "nrows"), "n")
