"""Log-shaped frames derived from the driver's tables.

The reference ships no data, so the logs it reads are made from the driver's
``lineitem``, ``orders``, ``events`` and ``pages`` by fixed rules (FIXTURES.md).
Each frame is a plain projection/join of those tables, so it grows with them
and every Spark optimisation (pruning, pushdown) applies.  The same rules are
written as DuckDB SQL in ``oracle/sql.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.sources.readers import normalise_log
from viewlens.sources.schemas import LOG_TIMES

# Fixed values of the mapping.
BROWSERS = ("chrome", "firefox", "msie", "safari", "opera")
SYSTEMS = ("win", "mac", "linux")
DEVICES = ("pc", "phone", "tablet", "tv")
EVENT_CODE_CYCLE = (10, 11, 20, 30, 40, 50, 60, 70, 80, 90)
VERSION_CYCLE = (6, 7, 7, 6, 5)
DETAIL_MIDDLE = ";1;100;1.5;1024x768;1024x740;800x600;11."


# Declared schemas of the driver tables the fixtures read (no inference job).
DRIVER_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in DRIVER_SCHEMAS:
        return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def pick(idx: Column, values: tuple) -> Column:
    """Zero-based choice from a fixed list."""
    return F.array(*[F.lit(v) for v in values])[idx.cast("int")]


def company(key: Column) -> Column:
    return F.when(key % 10 < 9, F.lit(1)).otherwise(F.lit(2))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """The pages (id, url) and their count as a literal.

    The count is one scalar from the Parquet footers (no data scan); as a
    literal it folds into the join key.  A scalar subquery inside a join key
    is not reliably planned by Spark 4.1 under AQE.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages, F.lit(pages.count())


def _as_log(df: DataFrame, kind: str, ts: Column, *columns: Column) -> DataFrame:
    """A log with a day and a time-of-day column, read the way the reader reads one."""
    day, time, _ = LOG_TIMES[kind]
    ts = ts.cast("timestamp_ntz")
    # the text of a timestamp has the time of day from its twelfth character on
    return normalise_log(df.select(F.to_date(ts).alias(day), F.substring(ts.cast("string"), 12, 15).alias(time),
                                   *columns), kind)


def placement_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily placement file as read (all text), from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.date_format("l_shipdate", "MM-dd-yyyy").alias("date"),
        F.col("l_suppkey").cast("string").alias("publisher_id"),
        (F.col("l_partkey") % 10).cast("string").alias("placement_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(""))
         .otherwise(F.concat((F.col("l_quantity") * 2).cast("bigint").cast("string"), F.lit("%")))
         .alias("in_view"),
        F.when(F.col("l_tax") == 0, F.lit(""))
         .otherwise(F.format_number(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0))
         .alias("measured_impressions"),
        F.format_number(F.floor("l_extendedprice"), 0).alias("total_impressions"),
    )


def bid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, n = _pages(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    j = li.join(pages, F.col("page_id") == F.col("l_partkey") % n)
    k = F.col("l_orderkey")
    return _as_log(
        j, "bid", F.col("l_shipdate"),
        k.alias("transaction_nbr"), company(k).alias("company_id"),
        (F.col("l_linenumber") * 3).cast("int").alias("operation_id"),
        F.col("url").alias("content_url"))


def notify_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    k = F.col("l_orderkey")
    return _as_log(
        li, "notify", F.col("l_shipdate"),
        k.alias("transaction_nbr"), company(k).alias("company_id"),
        (F.col("l_partkey") % 60).alias("media_size_id"))


def ad_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, and a second copy (``server_id`` 1) of every order
    whose key is a multiple of 17 -- made with one scan and a generator."""
    pages, n = _pages(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    o = o.withColumn("dup", F.explode(F.when(k % 17 == 0, F.array(F.lit(0), F.lit(1)))
                                       .otherwise(F.array(F.lit(0)))))
    j = o.join(pages, F.col("page_id") == k % n)
    return _as_log(
        j, "ad", F.timestamp_add("SECOND", F.col("o_custkey"), F.col("o_orderdate")),
        k.alias("transaction_nbr"), company(k).alias("company_id"),
        F.col("url").alias("content_url"),
        F.when(F.col("o_orderstatus") == "P", F.lit(3))
         .when(F.col("o_orderstatus") == "F", F.lit(12)).otherwise(F.lit(99)).alias("status_id"),
        (k % 60).alias("media_size_id"),
        (F.col("o_custkey") % 50).alias("publisher_id"),
        (F.col("o_custkey") % 400).alias("message_campaign_id"),
        pick(k % 5, BROWSERS).alias("browser_desc"),
        (20 + k % 7).alias("browser_major_version_attr"),
        (k % 2).alias("browser_minor_version_attr"),
        pick(k % 3, SYSTEMS).alias("operating_system_desc"),
        pick(k % 4, DEVICES).alias("device_desc"),
        (k % 4).alias("device_type_attr"),
        F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".1")).alias("user_ip"),
        F.col("dup").cast("int").alias("server_id"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About four browser events per transaction (``event_id div 4``)."""
    ev = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    t = F.expr("event_id div 4")
    one_if = lambda p: F.when(p, F.lit(1)).otherwise(F.lit(0))
    detail = F.when(eid % 11 == 0, F.lit("6;0101")).otherwise(F.concat(
        F.lit("6;"), F.translate(F.md5(eid.cast("string")), "0123456789abcdef", "0101010101010101"),
        F.lit("1;"), (eid % 5).cast("string"), F.lit(";"), (eid % 3).cast("string"),
        F.lit(DETAIL_MIDDLE), (eid % 9).cast("string"), F.lit(";;;1;;"),
        (20 + t % 7).cast("string"), F.lit(";"), pick(t % 3, SYSTEMS), F.lit(";webkit;acme")))
    return _as_log(
        ev, "event", F.col("ts"),
        t.alias("transaction_nbr"), eid.alias("logrec_sk"),
        company(t).alias("company_id"),
        pick((eid * 7 + uid) % 10, EVENT_CODE_CYCLE).alias("event_id"),
        F.when(uid % 40 == 0, F.lit(6)).otherwise(pick(t % 5, VERSION_CYCLE)).alias("script_version_id"),
        (t * 10 + one_if(uid % 50 == 0)).alias("dtm_id"),
        (t * 100).alias("cookie_dtm_id"),
        (t % 3).alias("server_id"), (t % 50).alias("publisher_id"),
        (t % 400).alias("message_campaign_id"), (t % 8).alias("template_id"),
        F.when(uid % 45 == 0, F.lit("other")).otherwise(pick(t % 5, BROWSERS)).alias("browser_desc"),
        (20 + t % 7 + one_if(uid % 55 == 0)).alias("browser_major_version_attr"),
        (t % 2).alias("browser_minor_version_attr"),
        F.when(uid % 60 == 0, F.lit("unknown")).otherwise(pick(t % 3, SYSTEMS)).alias("operating_system_desc"),
        F.when(uid % 70 == 0, F.lit("other")).otherwise(pick(t % 4, DEVICES)).alias("device_desc"),
        (t % 4).alias("device_type_attr"),
        F.lit("acme").alias("device_manufacturer_attr"),
        F.floor(F.col("value") * 10).cast("bigint").alias("elapsed_time_ms_meas"),
        detail.alias("event_detail_desc"))


class FixtureLogs:
    """The four logs and the placement file for one scale-factor folder.

    Each frame is built once per instance (a lazy plan, not data), so the
    datasets of one run share it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def bids(self) -> DataFrame:
        return bid_log(self.spark, self.sf_dir)

    @cached_property
    def notify(self) -> DataFrame:
        return notify_log(self.spark, self.sf_dir)

    @cached_property
    def ads(self) -> DataFrame:
        return ad_log(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return event_log(self.spark, self.sf_dir)

    @cached_property
    def placements(self) -> DataFrame:
        return placement_raw(self.spark, self.sf_dir)
