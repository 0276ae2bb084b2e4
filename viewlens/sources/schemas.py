"""Declared schemas of every source (no schema inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampNTZType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# The daily placement file, by position; everything is text as read.
PLACEMENT_COLUMNS = ("date", "publisher_id", "placement_id", "in_view",
                     "measured_impressions", "total_impressions")
PLACEMENT_RAW = _st(*[(c, S) for c in PLACEMENT_COLUMNS])

BID_LOG = _st(("transaction_nbr", L), ("company_id", I), ("bid_date", D), ("bid_ts", TS),
              ("operation_id", I), ("content_url", S))

NOTIFY_LOG = _st(("transaction_nbr", L), ("company_id", I), ("dmm_date", D), ("dmm_ts", TS),
                 ("media_size_id", L))

AD_LOG = _st(("transaction_nbr", L), ("company_id", I), ("dmm_date", D), ("dmm_ts", TS),
             ("content_url", S), ("status_id", I), ("media_size_id", L), ("publisher_id", L),
             ("message_campaign_id", L), ("browser_desc", S), ("browser_major_version_attr", L),
             ("browser_minor_version_attr", L), ("operating_system_desc", S), ("device_desc", S),
             ("device_type_attr", L), ("user_ip", S), ("server_id", I))

EVENT_LOG = _st(("transaction_nbr", L), ("logrec_sk", L), ("event_ts", TS), ("event_date", D),
                ("company_id", I), ("event_id", I), ("script_version_id", I), ("dtm_id", L),
                ("cookie_dtm_id", L), ("server_id", L), ("publisher_id", L),
                ("message_campaign_id", L), ("template_id", L), ("browser_desc", S),
                ("browser_major_version_attr", L), ("browser_minor_version_attr", L),
                ("operating_system_desc", S), ("device_desc", S), ("device_type_attr", L),
                ("device_manufacturer_attr", S), ("elapsed_time_ms_meas", L),
                ("event_detail_desc", S))

# How each log tells the time: calendar day, time of day, and the timestamp made of both.
LOG_TIMES = {"bid": ("bid_date", "bid_time", "bid_ts"), "notify": ("dmm_date", "dmm_time", "dmm_ts"),
             "ad": ("dmm_date", "dmm_time", "dmm_ts"), "event": ("event_date", "event_time", "event_ts")}

LOG_SCHEMAS = {"bid": BID_LOG, "notify": NOTIFY_LOG, "ad": AD_LOG, "event": EVENT_LOG}
