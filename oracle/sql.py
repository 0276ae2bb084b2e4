"""DuckDB SQL oracle.

The driver registers the parquet tables as views (lineitem, orders, events,
pages, ...).  The log shapes are rebuilt here from those views with the same
fixed rules as ``viewlens.sources.fixtures`` but written independently, in
SQL.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixture logs
CTE = {}

CTE["placement_raw"] = """
placement_raw AS (
  SELECT strftime(l_shipdate, '%m-%d-%Y') AS "date",
         CAST(l_suppkey AS VARCHAR) AS publisher_id,
         CAST(l_partkey % 10 AS VARCHAR) AS placement_id,
         CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(CAST(trunc(l_quantity * 2) AS BIGINT) AS VARCHAR) || '%' END AS in_view,
         CASE WHEN l_tax = 0 THEN '' ELSE format('{:,}', CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)) END AS measured_impressions,
         format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS total_impressions
  FROM lineitem)"""

CTE["placement_clean"] = """
placement_clean0 AS (
  SELECT CAST(try_strptime(regexp_extract("date", '^\\s*(\\d{1,2}-\\d{1,2}-\\d{4})', 1), '%m-%d-%Y') AS DATE) AS "date",
         publisher_id, placement_id,
         coalesce(TRY_CAST(replace(in_view, '%', '') AS DOUBLE), 0) AS in_view,
         coalesce(TRY_CAST(replace(measured_impressions, ',', '') AS DOUBLE), 0) AS measured_impressions,
         coalesce(TRY_CAST(replace(total_impressions, ',', '') AS DOUBLE), 0) AS total_impressions
  FROM placement_raw),
placement_clean AS (
  SELECT *, round_even(in_view * measured_impressions / 100, 0) AS viewed_impressions
  FROM placement_clean0)"""

CTE["pages_n"] = """
pages_n AS (SELECT count(*) AS n FROM pages)"""

CTE["bid_log"] = """
bid_log AS (
  SELECT l.l_orderkey AS transaction_nbr,
         CASE WHEN l.l_orderkey % 10 < 9 THEN 1 ELSE 2 END AS company_id,
         CAST(l.l_shipdate AS DATE) AS bid_date, CAST(l.l_shipdate AS TIMESTAMP) AS bid_ts,
         CAST(l.l_linenumber * 3 AS INTEGER) AS operation_id,
         p.url AS content_url
  FROM lineitem l
  JOIN pages p ON p.page_id = l.l_partkey % (SELECT n FROM pages_n))"""

CTE["notify_log"] = """
notify_log AS (
  SELECT l_orderkey AS transaction_nbr,
         CASE WHEN l_orderkey % 10 < 9 THEN 1 ELSE 2 END AS company_id,
         CAST(l_shipdate AS DATE) AS dmm_date, CAST(l_shipdate AS TIMESTAMP) AS dmm_ts,
         l_partkey % 60 AS media_size_id
  FROM lineitem WHERE l_returnflag = 'R')"""

CTE["ad_log"] = """
orders_x AS (
  SELECT *, 0 AS dup FROM orders
  UNION ALL
  SELECT *, 1 AS dup FROM orders WHERE o_orderkey % 17 = 0),
ad_log AS (
  SELECT o.o_orderkey AS transaction_nbr,
         CASE WHEN o.o_orderkey % 10 < 9 THEN 1 ELSE 2 END AS company_id,
         CAST(o.o_orderdate + to_seconds(o.o_custkey) AS DATE) AS dmm_date,
         CAST(o.o_orderdate AS TIMESTAMP) + to_seconds(o.o_custkey) AS dmm_ts,
         p.url AS content_url,
         CASE o.o_orderstatus WHEN 'P' THEN 3 WHEN 'F' THEN 12 ELSE 99 END AS status_id,
         o.o_orderkey % 60 AS media_size_id,
         o.o_custkey % 50 AS publisher_id,
         o.o_custkey % 400 AS message_campaign_id,
         ['chrome', 'firefox', 'msie', 'safari', 'opera'][o.o_orderkey % 5 + 1] AS browser_desc,
         20 + o.o_orderkey % 7 AS browser_major_version_attr,
         o.o_orderkey % 2 AS browser_minor_version_attr,
         ['win', 'mac', 'linux'][o.o_orderkey % 3 + 1] AS operating_system_desc,
         ['pc', 'phone', 'tablet', 'tv'][o.o_orderkey % 4 + 1] AS device_desc,
         o.o_orderkey % 4 AS device_type_attr,
         '10.0.' || CAST(o.o_orderkey % 256 AS VARCHAR) || '.1' AS user_ip,
         CAST(o.dup AS INTEGER) AS server_id
  FROM orders_x o
  JOIN pages p ON p.page_id = o.o_orderkey % (SELECT n FROM pages_n))"""

CTE["event_log"] = """
events_t AS (SELECT *, event_id // 4 AS t FROM events),
event_log AS (
  SELECT t AS transaction_nbr, event_id AS logrec_sk,
         CAST(ts AS TIMESTAMP) AS event_ts, CAST(ts AS DATE) AS event_date,
         CASE WHEN t % 10 < 9 THEN 1 ELSE 2 END AS company_id,
         [10, 11, 20, 30, 40, 50, 60, 70, 80, 90][(event_id * 7 + user_id) % 10 + 1] AS event_id,
         CASE WHEN user_id % 40 = 0 THEN 6 ELSE [6, 7, 7, 6, 5][t % 5 + 1] END AS script_version_id,
         t * 10 + CASE WHEN user_id % 50 = 0 THEN 1 ELSE 0 END AS dtm_id,
         t * 100 AS cookie_dtm_id,
         t % 3 AS server_id, t % 50 AS publisher_id, t % 400 AS message_campaign_id, t % 8 AS template_id,
         CASE WHEN user_id % 45 = 0 THEN 'other'
              ELSE ['chrome', 'firefox', 'msie', 'safari', 'opera'][t % 5 + 1] END AS browser_desc,
         20 + t % 7 + CASE WHEN user_id % 55 = 0 THEN 1 ELSE 0 END AS browser_major_version_attr,
         t % 2 AS browser_minor_version_attr,
         CASE WHEN user_id % 60 = 0 THEN 'unknown' ELSE ['win', 'mac', 'linux'][t % 3 + 1] END AS operating_system_desc,
         CASE WHEN user_id % 70 = 0 THEN 'other' ELSE ['pc', 'phone', 'tablet', 'tv'][t % 4 + 1] END AS device_desc,
         t % 4 AS device_type_attr,
         'acme' AS device_manufacturer_attr,
         CAST(floor("value" * 10) AS BIGINT) AS elapsed_time_ms_meas,
         CASE WHEN event_id % 11 = 0 THEN '6;0101'
              ELSE '6;' || translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', '0101010101010101')
                   || '1;' || CAST(event_id % 5 AS VARCHAR) || ';' || CAST(event_id % 3 AS VARCHAR)
                   || ';1;100;1.5;1024x768;1024x740;800x600;11.' || CAST(event_id % 9 AS VARCHAR)
                   || ';;;1;;' || CAST(20 + t % 7 AS VARCHAR) || ';' || ['win', 'mac', 'linux'][t % 3 + 1]
                   || ';webkit;acme' END AS event_detail_desc
  FROM events_t)"""

# Dependencies between the CTEs above (emitted in this order).
_ORDER = ["placement_raw", "placement_clean", "pages_n", "bid_log", "notify_log", "ad_log", "event_log"]
_DEPS = {"placement_clean": ["placement_raw"], "bid_log": ["pages_n"], "ad_log": ["pages_n"]}


def with_ctes(needed: list[str], extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named base CTEs (and their inputs) then ``extra``."""
    want = set()

    def add(n):
        if n in want:
            return
        for d in _DEPS.get(n, []):
            add(d)
        want.add(n)

    for n in needed:
        add(n)
    parts = [CTE[n].strip() for n in _ORDER if n in want] + [e.strip() for e in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"


def ratio_sql(n: str, d: str) -> str:
    """R's division: 0/0 = NaN, x/0 = +-Inf."""
    return (f"CASE WHEN CAST({d} AS DOUBLE) <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) "
            f"WHEN {d} IS NULL OR {n} IS NULL THEN NULL "
            f"WHEN isnan(CAST({n} AS DOUBLE)) OR {n} = 0 THEN CAST('NaN' AS DOUBLE) "
            f"WHEN {n} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END")


def n_unique_sql(*cols: str) -> str:
    """Distinct values counting NULL as a value (as R's unique)."""
    return f"count(DISTINCT struct_pack({', '.join(f'k{i} := {c}' for i, c in enumerate(cols))}))"
