"""Oracle SQL for the single-operator queries."""

from __future__ import annotations

from oracle.impressions import AD_WINDOW, CODES, MEDIA_OUT, STEPS, dom, feature_columns
from oracle.placements import _pub_day
from oracle.sql import n_unique_sql, with_ctes

LOGS = with_ctes(["bid_log", "notify_log", "ad_log", "event_log"])
CLEAN = with_ctes(["placement_clean"])
RAW = with_ctes(["placement_raw"])
AUDIT = with_ctes(["bid_log", "notify_log", "ad_log", "event_log"], [STEPS])


def queries() -> dict[str, str]:
    q = {}
    q["in_window"] = LOGS + f"SELECT transaction_nbr, bid_ts, operation_id FROM bid_log WHERE bid_ts {AD_WINDOW}"
    q["not_in"] = LOGS + f"SELECT transaction_nbr, media_size_id FROM notify_log WHERE media_size_id NOT IN {MEDIA_OUT}"
    q["anti_join"] = LOGS + """
SELECT transaction_nbr, server_id, content_url
FROM ad_log LEFT JOIN (SELECT transaction_nbr, 1 AS hit FROM notify_log) n USING (transaction_nbr)
WHERE hit IS NULL"""
    q["min_max_check"] = LOGS + """
SELECT transaction_nbr, min(browser_desc) AS browser_desc, max(browser_desc) AS browser_desc_check,
       min(operating_system_desc) AS operating_system_desc, max(operating_system_desc) AS operating_system_desc_check,
       min(device_desc) AS device_desc, max(device_desc) AS device_desc_check
FROM event_log GROUP BY transaction_nbr"""
    q["event_counts"] = LOGS + "SELECT transaction_nbr, " + ", ".join(
        f"CAST(sum(CASE WHEN event_id = {c} THEN 1 ELSE 0 END) AS BIGINT) AS event_{c}s" for c in CODES) + \
        " FROM event_log GROUP BY transaction_nbr"
    q["event_times"] = LOGS + "SELECT transaction_nbr, " + ", ".join(
        f"max(CASE WHEN event_id = {c} THEN elapsed_time_ms_meas ELSE 0 END) AS event_{c}_time" for c in CODES) + \
        " FROM event_log GROUP BY transaction_nbr"
    q["first_per_key"] = LOGS + """
SELECT publisher_id, logrec_sk, event_ts FROM (
  SELECT publisher_id, logrec_sk, event_ts,
         row_number() OVER (PARTITION BY publisher_id ORDER BY event_ts, logrec_sk) AS rn
  FROM event_log) a WHERE rn = 1"""
    q["share_of_total"] = LOGS + """
SELECT event_id, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM event_log GROUP BY event_id"""
    q["group_stats"] = CLEAN + """
SELECT *, avg(total_impressions) OVER g AS mean_total, stddev_samp(total_impressions) OVER g AS sd_total,
       max(total_impressions) OVER g AS max_total, min(total_impressions) OVER g AS min_total,
       count(*) OVER g AS n
FROM placement_clean WINDOW g AS (PARTITION BY publisher_id)"""
    q["n_unique_nulls"] = AUDIT + f"""
SELECT company_id, {n_unique_sql('bid_url')} AS urls_with_null, count(DISTINCT bid_url) AS urls
FROM tx GROUP BY company_id"""
    q["count_at_least"] = CLEAN + """
SELECT publisher_id,
       CAST(count(*) FILTER (WHERE total_impressions >= 1000) AS BIGINT) AS more_1000_imps,
       CAST(count(*) FILTER (WHERE measured_impressions >= 100) AS BIGINT) AS more_100_meas
FROM placement_clean GROUP BY publisher_id"""
    q["mean_sd"] = CLEAN + """
SELECT placement_id, avg(in_view) AS mean_in_view, stddev_samp(in_view) AS sd_in_view
FROM placement_clean GROUP BY placement_id"""
    q["ratio_zero"] = CLEAN + "," + _pub_day() + f"""
SELECT publisher_id, "date",
       CASE WHEN viewed_rate IS NULL THEN 'null' WHEN isnan(viewed_rate) THEN 'nan'
            WHEN viewed_rate = CAST('Infinity' AS DOUBLE) THEN 'inf'
            WHEN viewed_rate = CAST('-Infinity' AS DOUBLE) THEN '-inf' ELSE 'finite' END AS viewed_rate_kind,
       CASE WHEN measured_impressions <> 0 THEN viewed_impressions / measured_impressions END AS viewed_rate_or_null
FROM pub_day"""
    q["domain_name"] = f"SELECT page_id, url, {dom('url')} AS domain FROM pages"
    q["feature_split"] = LOGS + f"SELECT transaction_nbr, logrec_sk, {feature_columns()} FROM event_log"
    q["round_half_even"] = CLEAN + """
SELECT "date", publisher_id, placement_id, in_view * measured_impressions / 100 AS raw_viewed,
       round_even(in_view * measured_impressions / 100, 0) AS viewed_half_even,
       round(in_view * measured_impressions / 100) AS viewed_half_up
FROM placement_clean"""
    q["parse_numbers"] = RAW + """
SELECT in_view, measured_impressions,
       TRY_CAST(replace(in_view, '%', '') AS DOUBLE) AS in_view_value,
       TRY_CAST(replace(measured_impressions, ',', '') AS DOUBLE) AS measured_value
FROM placement_raw"""
    q["parse_date"] = RAW + """
SELECT "date" AS date_text, CAST(try_strptime(regexp_extract("date", '^\\s*(\\d{1,2}-\\d{1,2}-\\d{4})', 1), '%m-%d-%Y') AS DATE) AS date_value FROM placement_raw"""
    q["nan_last_order"] = CLEAN + "," + _pub_day() + """
SELECT publisher_id, "date", viewed_rate,
       row_number() OVER (ORDER BY CASE WHEN isnan(viewed_rate) THEN NULL ELSE viewed_rate END
                          DESC NULLS LAST, publisher_id, "date" NULLS LAST) AS pos
FROM pub_day"""
    q["split_log_ts"] = """
SELECT event_id AS transaction_nbr, CAST(ts AS DATE) AS dmm_date,
       CASE WHEN event_id % 13 = 0 THEN NULL
            WHEN event_id % 17 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
            ELSE CAST(ts AS TIMESTAMP) END AS dmm_ts
FROM events"""
    q["log_window"] = LOGS + """
SELECT logrec_sk, event_ts FROM event_log
WHERE event_ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-20 18:15:30'"""
    q["unreadable_times"] = """
WITH t AS (
  SELECT event_type, CAST(ts AS DATE) AS day, event_id % 19 AS k, CAST(ts AS TIME) AS clock FROM events),
u AS (
  SELECT event_type, day, k, CASE WHEN k IN (3, 4, 5, 6, 7) THEN NULL
         WHEN k = 8 THEN 86400 WHEN k = 9 THEN 7 * 3600 + 5 * 60 + 9
         ELSE hour(clock) * 3600 + minute(clock) * 60 + floor(second(clock)) END AS seconds
  FROM t)
SELECT event_type, count(*) FILTER (WHERE k IN (3, 4, 5, 7)) AS unreadable, count(*) FILTER (WHERE k <> 6) AS with_time,
       max(CAST(day AS TIMESTAMP) + to_seconds(CAST(seconds AS BIGINT))) AS last_ts,
       CAST(sum(seconds * 1000000) AS BIGINT) AS us
FROM u GROUP BY event_type"""
    q["detail_snapshot"] = AUDIT + "SELECT * FROM detail"
    q["date_time_join"] = LOGS + "SELECT logrec_sk, event_ts FROM event_log"
    q["event_span"] = LOGS + """
SELECT transaction_nbr, min(event_ts) AS start_events, max(event_ts) AS end_events,
       date_diff('microsecond', min(event_ts), max(event_ts)) AS events_duration_us
FROM event_log GROUP BY transaction_nbr"""
    q["day_window"] = LOGS + """
SELECT logrec_sk, event_date,
       CASE WHEN event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 1 ELSE 0 END AS in_core
FROM event_log
WHERE event_date >= DATE '2024-01-10' - INTERVAL 1 DAY AND event_date <= DATE '2024-01-20' + INTERVAL 1 DAY"""
    return q


