"""Every registered dataset and operator check as ``(spark, sf_dir) -> DataFrame``.

Each one reads the driver's tables (through ``sources.fixtures``) in full, so
its work grows with them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.config import EVENT_CODES, EXCLUDED_MEDIA_SIZES, fixture_config
from viewlens.functions import scalars as S
from viewlens.functions.features import parse_feature_string
from viewlens.operators import aggregates as A
from viewlens.operators import filters as FL
from viewlens.operators import joins as J
from viewlens.operators import windows as WN
from viewlens.plans import detail as D
from viewlens.plans import events as EV
from viewlens.plans import impressions as IM
from viewlens.plans import placements as P
from viewlens.plans import reports as RP
from viewlens.plans import states as ST
from viewlens.sources.fixtures import FixtureLogs, table
from viewlens.session import table_path
from viewlens.sources.readers import normalise_log, read_placement_csv, read_placement_csv_checked
from viewlens.sources.sinks import publish, publish_durable_view, stage
from viewlens.sources.statistics import read as read_statistics
from viewlens.sources.versions import drop_old_versions, read_version

Query = Callable[[SparkSession, str], DataFrame]

# Drill-down target used by the registered series (present at every scale).
SERIES_PUBLISHER, SERIES_PLACEMENT = "1", "1"


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return P.placement_clean(FixtureLogs(spark, sf).placements)


def _series(clean: DataFrame) -> DataFrame:
    return P.placement_series(clean, SERIES_PUBLISHER, SERIES_PLACEMENT)


def _charts(clean: DataFrame) -> DataFrame:
    return P.chart_series(P.daily_summary(clean), P.stable_placements(clean, ordered=False),
                          P.placement_summary(clean, ordered=False), _series(clean))


def placement_queries() -> dict[str, Query]:
    return {
        "placement_clean": lambda s, d: _clean(s, d),
        "daily_summary": lambda s, d: P.daily_summary(_clean(s, d)),
        "publisher_day": lambda s, d: P.publisher_day(_clean(s, d)),
        "publisher_summary": lambda s, d: P.publisher_summary(P.publisher_day(_clean(s, d))),
        "stable_placements": lambda s, d: P.stable_placements(_clean(s, d)),
        "placement_summary": lambda s, d: P.placement_summary(_clean(s, d)),
        "placement_series": lambda s, d: _series(_clean(s, d)),
        "placement_totals": lambda s, d: P.placement_totals(_clean(s, d)),
        "publishers_per_placement": lambda s, d: P.publishers_per_placement(P.placement_totals(_clean(s, d))),
        "daily_rates": lambda s, d: P.daily_rates(_clean(s, d)),
        "chart_series": lambda s, d: _charts(_clean(s, d)),
    }


# ----------------------------------------------------------------- impressions
class ImpressionRun:
    """The impression audit over one scale-factor folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg=None):
        self.cfg = cfg or fixture_config()
        self.logs = FixtureLogs(spark, sf_dir)

    def bids(self):
        return IM.bid_domains(self.logs.bids, self.cfg)

    def notify(self):
        return IM.view_notify(self.logs.notify, self.cfg)

    def tx(self):
        return IM.transactions(self.logs.ads, self.bids(), self.notify(), self.cfg)

    def first(self):
        return EV.first_feature_event(self.logs.events, self.cfg)

    def feats(self):
        return EV.features(self.first(), self.cfg.check_feature_length)

    def summary(self):
        return EV.event_summary(self.logs.events, self.cfg)

    def rollup(self):
        return EV.event_rollup(self.logs.events, self.cfg)

    def merged_summary(self):
        """The summary from two runs' states, the days up to the middle of the window and the later ones."""
        middle = self.cfg.event_start + (self.cfg.event_end - self.cfg.event_start) / 2
        ev = self.logs.events
        states = ST.daily_states(ev, self.cfg, last=middle).unionByName(
            ST.daily_states(ev, self.cfg, first=middle + dt.timedelta(days=1)))
        return ST.summary_of_states(states, self.cfg)

    def checked(self):
        return EV.event_rollup_checked(self.summary(), self.cfg)

    def detail(self):
        return D.impression_detail(self.tx(), self.summary(), self.cfg)

    def clean(self):
        return D.clean_impressions(self.detail(), self.cfg)


def impression_queries() -> dict[str, Query]:
    R = ImpressionRun
    return {
        "bid_domains": lambda s, d: R(s, d).bids(),
        "view_notify": lambda s, d: R(s, d).notify(),
        "transactions": lambda s, d: R(s, d).tx(),
        "transactions_multiplicity": lambda s, d: IM.transactions_multiplicity(R(s, d).tx()),
        "multi_row_transactions": lambda s, d: IM.multi_row_transactions(R(s, d).tx()),
        "multi_row_count": lambda s, d: IM.multi_row_count(R(s, d).tx()),
        "first_feature_event": lambda s, d: R(s, d).first(),
        "features": lambda s, d: R(s, d).feats(),
        "event_rollup_checked": lambda s, d: R(s, d).checked(),
        "event_rollup_of_states": lambda s, d: EV.event_rollup_checked(R(s, d).merged_summary(), R(s, d).cfg),
        "impression_detail": lambda s, d: R(s, d).detail(),
        "issue_crosstab": lambda s, d: D.issue_crosstab(R(s, d).detail()),
        "issue_rows": lambda s, d: D.issue_rows(R(s, d).detail()),
        "clean_impressions": lambda s, d: R(s, d).clean(),
        "browser_summary": lambda s, d: RP.browser_summary(R(s, d).clean(), R(s, d).cfg),
    }


# --------------------------------------------------- single-operator queries
# Day window of the slack-window check (inside the fixture's event dates).
DAY_WINDOW = (dt.date(2024, 1, 10), dt.date(2024, 1, 20))


def _ratio_kind(c):
    return (F.when(c.isNull(), "null").when(F.isnan(c), "nan")
             .when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise("finite"))


# Time window of the split-log check: inside two days of the events, to the microsecond.
LOG_WINDOW = (dt.datetime(2024, 1, 10, 6, 30), dt.datetime(2024, 1, 20, 18, 15, 30))


def _odd_times(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a time-of-day text, some of them none that a clock shows."""
    ev, k = table(spark, sf, "events"), F.col("event_id") % 19
    time = F.when(k == 3, "99:99:99").when(k == 4, "-1:00:00").when(k == 5, "noon").when(k == 6, F.lit(None)) \
        .when(k == 7, "24:00:01").when(k == 8, "24:00:00").when(k == 9, "7:5:9").otherwise(F.date_format("ts", "HH:mm:ss"))
    return ev.select("event_id", "event_type", F.to_date("ts").alias("day"), time.alias("time"))


def _split_log(spark: SparkSession, sf: str) -> DataFrame:
    """A notify log with day and time apart, some times missing or 24:00:00, as the reader gives it."""
    ev = table(spark, sf, "events")
    time = F.when(F.col("event_id") % 13 == 0, F.lit(None)).when(F.col("event_id") % 17 == 0, F.lit("24:00:00")) \
        .otherwise(F.date_format("ts", "HH:mm:ss.SSSSSS"))
    log = ev.select(F.col("event_id").alias("transaction_nbr"), F.lit(1).alias("company_id"),
                    F.to_date("ts").alias("dmm_date"), time.alias("dmm_time"), F.col("user_id").alias("media_size_id"))
    return normalise_log(log, "notify").select("transaction_nbr", "dmm_date", "dmm_ts")


# ------------------------------------------------------ sources and sinks, written and read back
def _csv_folder(spark: SparkSession, sf: str, name: str, lines: DataFrame) -> str:
    path = table_path(spark, f"queries/{name}")
    lines.write.mode("overwrite").option("compression", "none").text(path)
    return path


def _csv_lines(spark: SparkSession, sf: str, odd: bool) -> DataFrame:
    """The placement file as text, quoted numbers and all; ``odd``: with short, long and unclosed lines."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    head, tail = ["date", "publisher_id", "placement_id", "in_view"], quoted("total_impressions")
    line = F.concat_ws(",", *head, quoted("measured_impressions"), tail)
    rows = FixtureLogs(spark, sf).placements
    if odd:
        k = (F.col("publisher_id").cast("int") * 7 + F.col("placement_id").cast("int") * 3 + F.length(line)) % 50
        line = (F.when(k == 1, F.concat_ws(",", *head)).when(k == 2, F.concat(line, F.lit(",more")))
                .when(k == 3, F.concat_ws(",", *head, F.lit('"12'), F.lit("34"))).otherwise(line))
    return rows.select(line.alias("value"))


def _csv_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the odd file by what became of them: their number and characters add up to the file's."""
    path = _csv_folder(spark, sf, "odd_csv", _csv_lines(spark, sf, odd=True))
    good, bad = read_placement_csv_checked(spark, path, header="false")
    sizes = lambda df, part, n: df.agg(
        F.count(F.lit(1)).alias("lines"), F.sum(n).alias("chars")).withColumn("part", F.lit(part))
    plain = sum((F.coalesce(F.length(c), F.lit(0)) for c in good.columns), F.lit(0))
    return sizes(good, "good", plain).unionByName(sizes(bad, "bad", F.lit(0))).unionByName(
        sizes(spark.read.text(path), "all", F.lit(0)))


def _published(spark: SparkSession, sf: str, name: str, **how) -> DataFrame:
    """The notifications published twice under one name; the second version is what is read."""
    df = IM.view_notify(FixtureLogs(spark, sf).notify, fixture_config())
    path = table_path(spark, f"queries/{name}")
    publish(df.limit(3), name, path=path, **how)
    return publish(df, name, path=path, **how)


def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    path = table_path(spark, "queries/statistics")
    publish(FixtureLogs(spark, sf).ads, "statistics", path=path, statistics=True)
    return read_statistics(spark, path).where("column != 'dmm_time'").select("column", "rows", "nulls", "least", "greatest", "longest")


def _rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """A versioned dataset rebuilt from itself: each transaction's notifications counted double."""
    path = table_path(spark, "queries/rebuilt")
    df = publish(IM.view_notify(FixtureLogs(spark, sf).notify, fixture_config()), "rebuilt", path=path, versioned=True)
    publish(df.withColumn("view_notify_nrows", F.col("view_notify_nrows") * 2), "rebuilt", path=path, versioned=True)
    drop_old_versions(spark, path, keep=1)
    return read_version(spark, path)


def _tenant_view(spark: SparkSession, sf: str) -> DataFrame:
    path = table_path(spark, "queries/tenant_bids")
    publish(IM.bid_domains(FixtureLogs(spark, sf).bids, fixture_config()), "tenant_bids", path=path)
    return publish_durable_view(spark, "tenant_bids_view", path, "company_id = 1 AND content_url IS NOT NULL", is_path=True)


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    stage(FixtureLogs(spark, sf).ads, "staged_ads")
    return spark.sql("SELECT browser_desc, count(*) AS n, max(dmm_ts) AS last_ts FROM staged_ads GROUP BY browser_desc")


def source_and_sink_queries() -> dict[str, Query]:
    return {
        "csv_scan": lambda s, d: read_placement_csv(s, _csv_folder(s, d, "csv", _csv_lines(s, d, odd=False)), header="false"),
        "csv_quarantine": _csv_checked,
        "stage": _staged,
        "publish_replaces": lambda s, d: _published(s, d, "replaced"),
        "publish_random_layout": lambda s, d: _published(s, d, "random_layout", cluster_by=None),
        "publish_codec": lambda s, d: _published(s, d, "codec", compression="gzip"),
        "publish_statistics": _statistics,
        "publish_version": _rebuilt,
        "tenant_view": _tenant_view,
    }


def operator_queries() -> dict[str, Query]:
    cfg = fixture_config()
    L = FixtureLogs
    return {
        "in_window": lambda s, d: L(s, d).bids.where(FL.in_window("bid_ts", cfg.ad_start, cfg.ad_end))
            .select("transaction_nbr", "bid_ts", "operation_id"),
        "not_in": lambda s, d: L(s, d).notify.where(FL.not_in("media_size_id", EXCLUDED_MEDIA_SIZES))
            .select("transaction_nbr", "media_size_id"),
        "anti_join": lambda s, d: J.without(L(s, d).ads, L(s, d).notify, "transaction_nbr")
            .select("transaction_nbr", "server_id", "content_url"),
        "min_max_check": lambda s, d: L(s, d).events.groupBy("transaction_nbr").agg(*A.min_max_check({
            "browser_desc": ("browser_desc", "browser_desc_check"),
            "operating_system_desc": ("operating_system_desc", "operating_system_desc_check"),
            "device_desc": ("device_desc", "device_desc_check")})),
        "event_counts": lambda s, d: L(s, d).events.groupBy("transaction_nbr").agg(*A.event_counts(EVENT_CODES)),
        "event_times": lambda s, d: L(s, d).events.groupBy("transaction_nbr").agg(*A.event_times(EVENT_CODES)),
        "first_per_key": lambda s, d: WN.first_per_key(L(s, d).events, "publisher_id", ["event_ts", "logrec_sk"])
            .select("publisher_id", "logrec_sk", "event_ts"),
        "share_of_total": lambda s, d: WN.share_of_total(
            L(s, d).events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")), "n", "share"),
        "group_stats": lambda s, d: WN.with_group_stats(
            _clean(s, d), ["publisher_id"], "total_impressions",
            {"mean_total": "mean", "sd_total": "sd", "max_total": "max", "min_total": "min", "n": "count"}),
        "n_unique_nulls": lambda s, d: ImpressionRun(s, d).tx().groupBy("company_id").agg(
            A.n_unique("bid_url").alias("urls_with_null"), F.count_distinct("bid_url").alias("urls")),
        "count_at_least": lambda s, d: _clean(s, d).groupBy("publisher_id").agg(
            A.count_at_least("total_impressions", 1000).alias("more_1000_imps"),
            A.count_at_least("measured_impressions", 100).alias("more_100_meas")),
        "mean_sd": lambda s, d: _clean(s, d).groupBy("placement_id").agg(*A.mean_sd("in_view", "in_view")),
        "ratio_zero": lambda s, d: P.publisher_day(_clean(s, d)).select(
            "publisher_id", "date", _ratio_kind(F.col("viewed_rate")).alias("viewed_rate_kind"),
            S.ratio("viewed_impressions", "measured_impressions", on_zero="null").alias("viewed_rate_or_null")),
        "domain_name": lambda s, d: table(s, d, "pages")
            .select("page_id", "url", S.domain_name("url").alias("domain")),
        "feature_split": lambda s, d: L(s, d).events.select(
            "transaction_nbr", "logrec_sk", *parse_feature_string("event_detail_desc")),
        "round_half_even": lambda s, d: _clean(s, d).select(
            "date", "publisher_id", "placement_id",
            (F.col("in_view") * F.col("measured_impressions") / 100).alias("raw_viewed"),
            S.round_half_even(F.col("in_view") * F.col("measured_impressions") / 100).alias("viewed_half_even"),
            F.round(F.col("in_view") * F.col("measured_impressions") / 100).alias("viewed_half_up")),
        "parse_numbers": lambda s, d: L(s, d).placements.select(
            "in_view", "measured_impressions",
            S.parse_number(S.strip_chars("in_view", "%")).alias("in_view_value"),
            S.parse_number(S.strip_chars("measured_impressions", ",")).alias("measured_value")),
        "parse_date": lambda s, d: L(s, d).placements.select(
            F.col("date").alias("date_text"), S.parse_date("date").alias("date_value")),
        # orders, shown by each row's position
        "nan_last_order": lambda s, d: WN.with_position(WN.order_by(
            P.publisher_day(_clean(s, d)).select("publisher_id", "date", "viewed_rate"), "viewed_rate", desc=True,
            ties=["publisher_id", "date"]), "pos"),
        "transactions_multiplicity_order": lambda s, d: WN.with_position(
            IM.transactions_multiplicity(ImpressionRun(s, d).tx()), "pos"),
        "issue_crosstab_order": lambda s, d: WN.with_position(D.issue_crosstab(ImpressionRun(s, d).detail()), "pos"),
        "stable_placements_order": lambda s, d: WN.with_position(
            P.stable_placements(_clean(s, d)).select("publisher_id", "placement_id", "date", "mean_imps"), "pos"),
        "placement_summary_order": lambda s, d: WN.with_position(
            P.placement_summary(_clean(s, d)).select("publisher_id", "placement_id", "sd_in_view"), "pos"),
        "key_order": lambda s, d: WN.with_position(
            P.placement_totals(_clean(s, d), ordered=True).select("publisher_id", "placement_id", "days"), "pos"),
        "detail_snapshot": lambda s, d: RP.detail_snapshot(ImpressionRun(s, d).detail(), "detail_snapshot"),
        "date_time_join": lambda s, d: L(s, d).events.select(
            "logrec_sk", S.to_ts("event_date", F.date_format("event_ts", "HH:mm:ss.SSSSSS")).alias("event_ts")),
        "split_log_ts": lambda s, d: _split_log(s, d),
        "log_window": lambda s, d: L(s, d).events.where(FL.in_log_window(L(s, d).events, "event_ts", *LOG_WINDOW))
            .select("logrec_sk", "event_ts"),
        "unreadable_times": lambda s, d: _odd_times(s, d).groupBy("event_type").agg(
            A.unreadable_times("time").alias("unreadable"), F.count("time").alias("with_time"),
            F.max(S.to_ts("day", "time")).alias("last_ts"), F.sum(S.time_us("time")).alias("us")),
        "event_span": lambda s, d: L(s, d).events.groupBy("transaction_nbr").agg(*A.span("event_ts"))
            .withColumn("events_duration_us", S.duration_us("start_events", "end_events")),
        "day_window": lambda s, d: L(s, d).events.where(
            FL.in_day_window("event_date", DAY_WINDOW[0], DAY_WINDOW[1], slack_days=1))
            .select("logrec_sk", "event_date",
                    S.flag(FL.in_day_window("event_date", DAY_WINDOW[0], DAY_WINDOW[1], slack_days=0)).alias("in_core")),
    }


def all_queries() -> dict[str, Query]:
    q = {}
    q.update(placement_queries())
    q.update(impression_queries())
    q.update(operator_queries())
    q.update(source_and_sink_queries())
    return q
