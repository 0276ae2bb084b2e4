"""Oracle SQL for the placement analysis (one statement per dataset)."""

from __future__ import annotations

from oracle.sql import n_unique_sql, ratio_sql, with_ctes

W = with_ctes(["placement_clean"])

VOLUME = """
  CAST(count(*) FILTER (WHERE total_impressions >= 100) AS BIGINT) AS more_100_imps,
  CAST(count(*) FILTER (WHERE measured_impressions >= 100) AS BIGINT) AS more_100_meas,
  CAST(count(*) FILTER (WHERE total_impressions >= 1000) AS BIGINT) AS more_1000_imps,
  CAST(count(*) FILTER (WHERE measured_impressions >= 1000) AS BIGINT) AS more_1000_meas"""


def _pub_day() -> str:
    return f"""
pub_day0 AS (
  SELECT publisher_id, "date", count(*) AS placements,
         sum(measured_impressions) AS measured_impressions, sum(total_impressions) AS total_impressions,
         sum(viewed_impressions) AS viewed_impressions, {VOLUME}
  FROM placement_clean GROUP BY publisher_id, "date"),
pub_day AS (
  SELECT publisher_id, "date", placements, measured_impressions, total_impressions, viewed_impressions,
         {ratio_sql('measured_impressions', 'total_impressions')} AS measured_rate,
         {ratio_sql('viewed_impressions', 'measured_impressions')} AS viewed_rate,
         more_100_imps, more_100_meas, more_1000_imps, more_1000_meas
  FROM pub_day0)"""


def _stable() -> str:
    return """
big AS (SELECT * FROM placement_clean WHERE total_impressions >= 1000),
stable AS (
  SELECT * FROM (
    SELECT *,
           avg(total_impressions) OVER g AS mean_imps,
           stddev_samp(total_impressions) OVER g AS sd_imps,
           max(total_impressions) OVER g AS max_imps,
           min(total_impressions) OVER g AS min_imps,
           count(*) OVER g AS days,
           measured_impressions / total_impressions AS measure_rate
    FROM big
    WINDOW g AS (PARTITION BY publisher_id, placement_id)) s
  WHERE days >= 20)"""


SUMMARY = """
summary AS (
  SELECT publisher_id, placement_id,
         max(mean_imps) AS mean_imps, max(max_imps) AS max_imps, max(sd_imps) AS sd_imps,
         min(min_imps) AS min_imps, max(days) AS days,
         avg(measure_rate) AS mean_measure_rate, stddev_samp(measure_rate) AS sd_measure_rate,
         max(measure_rate) AS max_measure_rate, min(measure_rate) AS min_measure_rate,
         avg(in_view) AS mean_in_view, stddev_samp(in_view) AS sd_in_view,
         max(in_view) AS max_in_view, min(in_view) AS min_in_view
  FROM stable GROUP BY publisher_id, placement_id)
"""

# The scatter plots, as (x, y) columns of the summary.
SCATTERS = (("mean_in_view", "sd_in_view"), ("mean_imps", "sd_in_view"), ("min_imps", "sd_in_view"),
            ("days", "sd_in_view"), ("mean_measure_rate", "sd_measure_rate"),
            ("mean_measure_rate", "mean_in_view"), ("sd_measure_rate", "sd_in_view"))


def queries() -> dict[str, str]:
    q = {}
    q["placement_clean"] = W + "SELECT * FROM placement_clean"
    q["daily_summary"] = W + f""", d AS (
  SELECT "date", {n_unique_sql('publisher_id')} AS publishers,
         {n_unique_sql('publisher_id', 'placement_id')} AS pub_placements,
         sum(total_impressions) AS total_impressions, sum(measured_impressions) AS measured_impressions,
         sum(viewed_impressions) AS viewed_impressions, {VOLUME}
  FROM placement_clean GROUP BY "date")
SELECT "date", publishers, pub_placements, total_impressions, measured_impressions, viewed_impressions,
       {ratio_sql('measured_impressions', 'total_impressions')} AS measured_rate,
       {ratio_sql('viewed_impressions', 'measured_impressions')} AS viewed_rate,
       more_100_imps, more_100_meas, more_1000_imps, more_1000_meas
FROM d"""
    q["publisher_day"] = W + "," + _pub_day() + "\nSELECT * FROM pub_day"
    q["publisher_summary"] = W + "," + _pub_day() + """
SELECT publisher_id, count(*) AS days,
       avg(placements) AS mean_placements, min(placements) AS min_placements, max(placements) AS max_placements,
       avg(measured_impressions) AS mean_measured, stddev_samp(measured_impressions) AS sd_measured,
       avg(total_impressions) AS mean_total, stddev_samp(total_impressions) AS sd_total,
       avg(viewed_impressions) AS mean_viewed, stddev_samp(viewed_impressions) AS sd_viewed,
       avg(measured_rate) AS mean_measured_rate, stddev_samp(measured_rate) AS sd_measured_rate,
       avg(viewed_rate) AS mean_viewed_rate, stddev_samp(viewed_rate) AS sd_viewed_rate
FROM pub_day GROUP BY publisher_id"""
    q["stable_placements"] = W + "," + _stable() + "\nSELECT * FROM stable"
    q["placement_summary"] = W + "," + _stable() + "," + SUMMARY + "SELECT * FROM summary"
    q["stable_placements_order"] = W + "," + _stable() + """
SELECT publisher_id, placement_id, "date", mean_imps,
       row_number() OVER (ORDER BY mean_imps DESC NULLS LAST, publisher_id NULLS LAST, placement_id NULLS LAST,
                          "date" NULLS LAST) AS pos
FROM stable"""
    q["placement_summary_order"] = W + "," + _stable() + "," + SUMMARY + """
SELECT publisher_id, placement_id, sd_in_view,
       row_number() OVER (ORDER BY sd_in_view DESC NULLS LAST, publisher_id NULLS LAST, placement_id NULLS LAST) AS pos
FROM summary"""
    q["key_order"] = W + f"""
SELECT publisher_id, placement_id, {n_unique_sql('"date"')} AS days,
       row_number() OVER (ORDER BY publisher_id NULLS LAST, placement_id NULLS LAST) AS pos
FROM placement_clean GROUP BY publisher_id, placement_id"""
    q["placement_series"] = W + "," + _stable() + """
SELECT * FROM stable WHERE publisher_id = '1' AND placement_id = '1'"""
    q["placement_totals"] = W + f"""
SELECT publisher_id, placement_id, {n_unique_sql('"date"')} AS days,
       sum(measured_impressions) AS measured_impressions, sum(total_impressions) AS total_impressions,
       sum(viewed_impressions) AS viewed_impressions
FROM placement_clean GROUP BY publisher_id, placement_id"""
    q["publishers_per_placement"] = W + """
SELECT placement_id, count(*) AS publishers
FROM (SELECT DISTINCT publisher_id, placement_id FROM placement_clean) t GROUP BY placement_id"""
    q["daily_rates"] = W + f""", d AS (
  SELECT "date", sum(total_impressions) AS total_impressions, sum(measured_impressions) AS measured_impressions,
         sum(viewed_impressions) AS viewed_impressions, {n_unique_sql('publisher_id')} AS publishers
  FROM placement_clean GROUP BY "date")
SELECT "date", total_impressions, measured_impressions,
       {ratio_sql('viewed_impressions', 'measured_impressions')} AS viewed_rate,
       {ratio_sql('measured_impressions', 'total_impressions')} AS measured_rate, publishers
FROM d"""
    q["chart_series"] = W + f""", d AS (
  SELECT "date", {n_unique_sql('publisher_id')} AS publishers,
         {n_unique_sql('publisher_id', 'placement_id')} AS pub_placements,
         sum(total_impressions) AS total_impressions, sum(measured_impressions) AS measured_impressions,
         sum(viewed_impressions) AS viewed_impressions
  FROM placement_clean GROUP BY "date"),
dd AS (
  SELECT "date", CAST(publishers AS DOUBLE) AS publishers, CAST(pub_placements AS DOUBLE) AS pub_placements,
         total_impressions, measured_impressions, viewed_impressions,
         {ratio_sql('measured_impressions', 'total_impressions')} AS measured_rate,
         {ratio_sql('viewed_impressions', 'measured_impressions')} AS viewed_rate
  FROM d),""" + _stable() + "," + SUMMARY + f""",
named AS (SELECT *, coalesce(publisher_id, 'NA') || ' - ' || coalesce(placement_id, 'NA') AS series FROM stable),
drilled AS (SELECT * FROM named WHERE publisher_id = '1' AND placement_id = '1')
SELECT 'daily' AS chart, series, "date" AS day, CAST(NULL AS DOUBLE) AS x, y
FROM dd UNPIVOT INCLUDE NULLS (y FOR series IN (publishers, pub_placements, total_impressions,
      measured_impressions, viewed_impressions, measured_rate, viewed_rate)) u
UNION ALL SELECT 'stable_in_view', series, "date", NULL, in_view FROM named
{" ".join(f"UNION ALL SELECT 'scatter', '{y} by {x}', NULL, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE) FROM summary"
          for x, y in SCATTERS)}
UNION ALL SELECT 'drill_in_view', series, "date", NULL, in_view FROM drilled
UNION ALL SELECT 'drill_scatter', series, NULL, measured_impressions, in_view FROM drilled"""
    return q
