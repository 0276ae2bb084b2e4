"""Oracle SQL for what is written and read back."""

from __future__ import annotations

from oracle.impressions import STEPS
from oracle.sql import with_ctes

RAW = with_ctes(["placement_raw"])
AUDIT = with_ctes(["bid_log", "notify_log", "ad_log", "event_log"], [STEPS])
ADS = with_ctes(["ad_log"])

# Columns of the ad log, all of which have statistics.
AD_COLUMNS = ("transaction_nbr", "company_id", "dmm_date", "dmm_ts", "content_url", "status_id", "media_size_id",
              "publisher_id", "message_campaign_id", "browser_desc", "browser_major_version_attr",
              "browser_minor_version_attr", "operating_system_desc", "device_desc", "device_type_attr", "user_ip",
              "server_id")


def queries() -> dict[str, str]:
    q = {}
    q["csv_scan"] = RAW + """
SELECT "date", publisher_id, placement_id, nullif(in_view, '') AS in_view,
       nullif(measured_impressions, '') AS measured_impressions, total_impressions
FROM placement_raw"""
    q["csv_quarantine"] = RAW + """,
lines AS (
  SELECT *, length(concat_ws(',', "date", publisher_id, placement_id, in_view, '"' || measured_impressions || '"',
                             '"' || total_impressions || '"')) AS line_chars
  FROM placement_raw),
kinds AS (
  SELECT *, (CAST(publisher_id AS BIGINT) * 7 + CAST(placement_id AS BIGINT) * 3 + line_chars) % 50 IN (1, 2, 3) AS bad
  FROM lines)
SELECT 'good' AS part, count(*) AS lines,
       CAST(sum(length("date") + length(publisher_id) + length(placement_id) + length(in_view)
                + length(measured_impressions) + length(total_impressions)) AS BIGINT) AS chars
FROM kinds WHERE NOT bad
UNION ALL SELECT 'bad', count(*), 0 FROM kinds WHERE bad
UNION ALL SELECT 'all', count(*), 0 FROM kinds"""
    q["stage"] = ADS + """
SELECT browser_desc, count(*) AS n, max(dmm_ts) AS last_ts FROM ad_log GROUP BY browser_desc"""
    for name in ("publish_replaces", "publish_random_layout", "publish_codec"):
        q[name] = AUDIT + "SELECT * FROM vn"
    q["publish_version"] = AUDIT + "SELECT transaction_nbr, view_notify, view_notify_nrows * 2 AS view_notify_nrows FROM vn"
    q["tenant_view"] = AUDIT + "SELECT * FROM bid_aux WHERE company_id = 1 AND content_url IS NOT NULL"
    q["publish_statistics"] = ADS + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
       CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest,
       CAST(max(strlen(CAST({c} AS VARCHAR))) AS INTEGER) AS longest FROM ad_log""" for c in AD_COLUMNS)
    return q
