"""End-to-end jobs: build every dataset of an analysis and publish it.

Intermediates read by several datasets are written to the shared work folder
(``spark.checkpoint.dir``) and read back, which cuts their lineage: a lost
executor then costs one stage of recomputation, not the whole chain.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from viewlens.config import RunConfig
from viewlens.plans import detail as D
from viewlens.plans import events as EV
from viewlens.plans import impressions as IM
from viewlens.plans import placements as P
from viewlens.plans import reports as RP
from viewlens.session import table_path
from viewlens.sources.sinks import publish, publish_view


def warn_of_skew_settings(spark) -> None:
    """Sessions that are made elsewhere may lack the setting that lets a skewed join inside a chain be split."""
    setting = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    if spark.conf.get(setting, "false") != "true":
        warnings.warn(f"{setting} is not set: a hot transaction may stay in one task", stacklevel=3)


def impression_job(ads: DataFrame, bids: DataFrame, notify: DataFrame, events: DataFrame,
                   cfg: RunConfig, prefix: str = "", buckets: int | None = None,
                   out_dir: str | None = None, versioned: bool = False, statistics: bool = False,
                   split_hot_bids: bool = False) -> dict[str, DataFrame]:
    """The whole impression audit; every dataset is published and returned by name.

    ``buckets``: publish transactions, the event summary (roll-up and
    features), detail and issue rows as catalog tables bucketed (and sorted)
    by ``transaction_nbr`` into that many buckets, analyzed, stored in the
    shared work folder.  The detail then joins its inputs, and the clean rows
    drop the issue transactions, with no shuffle at all.  Pick it so one bucket
    is ~200 MB of transactions.
    ``out_dir``: folder for the published tables (default: the shared work
    folder).  ``versioned``: each dataset that is no table gets a new version that
    takes the old one's place in one step.  ``statistics``: column statistics are
    taken while datasets are written.  ``split_hot_bids``: transactions that hold a
    large share of the bids are found first, by one more scan of the bid log, and
    their bids are joined in several tasks.

    Every frame here comes out of a grouping or join on ``transaction_nbr`` or
    is read from a table laid out by it, so it is written as it is; only
    bucketing shuffles once more.
    """
    name = lambda n: f"{prefix}{n}"
    where = lambda n: f"{out_dir.rstrip('/')}/{name(n)}" if out_dir else None
    out: dict[str, DataFrame] = {}
    warn_of_skew_settings(ads.sparkSession)

    def put(n: str, df: DataFrame, keyed: bool = False) -> DataFrame:
        if keyed and buckets:
            out[n] = publish(df, name(n), as_table=True, buckets=buckets, analyze=True,
                             path=where(n) or table_path(df.sparkSession, name(n)))
        else:
            out[n] = publish(df, name(n), laid_out=True, path=where(n), versioned=versioned, statistics=statistics)
        return out[n]

    b = IM.bid_domains(bids, cfg)
    n = IM.view_notify(notify, cfg)
    hot = IM.hot_bid_transactions(b) if split_hot_bids else None
    hot = None if hot is None or hot.isEmpty() else hot
    tx = put("transactions", IM.transactions(ads, b, n, cfg, hot), keyed=True)
    put("transactions_multiplicity", IM.transactions_multiplicity(tx))
    put("multi_row_transactions", IM.multi_row_transactions(tx))
    put("multi_row_count", IM.multi_row_count(tx))
    # roll-up and first feature event from one scan and one shuffle of the events
    summary = put("event_summary", EV.event_summary(events, cfg), keyed=True)
    put("features", EV.features_from_summary(summary))
    put("event_rollup_checked", EV.event_rollup_checked(summary, cfg))
    detail = D.impression_detail(tx, summary, cfg)
    if buckets:
        detail = put("impression_detail", detail, keyed=True)
    else:
        detail = out["impression_detail"] = RP.detail_snapshot(
            detail, name("impression_detail"), path=where("impression_detail"), laid_out=True, versioned=versioned,
            statistics=statistics)
    put("issue_crosstab", D.issue_crosstab(detail))
    issues = put("issue_rows", D.issue_rows(detail), keyed=True)
    clean = put("clean_impressions", D.clean_impressions(detail, cfg, issues, few_issues=not buckets))
    if cfg.tenant is not None:
        publish_view(clean, name("clean_impressions_of_tenant"), f"company_id = {int(cfg.tenant)}")
    put("browser_summary", RP.browser_summary(clean, cfg))
    return out


def placement_job(raw: DataFrame, prefix: str = "", min_total: float = 1000, min_days: int = 20,
                  out_dir: str | None = None, drill: tuple[str, str] | None = None, versioned: bool = False,
                  statistics: bool = False) -> dict[str, DataFrame]:
    """The whole placement analysis from the file as read; every dataset is published.

    ``drill``: a publisher id and placement id whose daily series is published too."""
    out: dict[str, DataFrame] = {}

    def put(n: str, df: DataFrame) -> DataFrame:
        path = f"{out_dir.rstrip('/')}/{prefix}{n}" if out_dir else None
        out[n] = publish(df, f"{prefix}{n}", cluster_by=None, path=path, versioned=versioned,
                         statistics=statistics)
        return out[n]

    clean = put("placement_clean", P.placement_clean(raw))
    daily = put("daily_summary", P.daily_summary(clean, ordered=True))
    pub_day = put("publisher_day", P.publisher_day(clean))
    put("publisher_summary", P.publisher_summary(pub_day))
    stable = put("stable_placements", P.stable_placements(clean, min_total, min_days))
    summary = put("placement_summary", P.placement_summary(clean, min_total, min_days))
    totals = put("placement_totals", P.placement_totals(clean))
    put("publishers_per_placement", P.publishers_per_placement(totals))
    put("daily_rates", P.daily_rates(clean, ordered=True))
    series = None
    if drill:
        series = put("placement_series", P.placement_series(clean, *drill, min_total, min_days))
    put("chart_series", P.chart_series(daily, stable, summary, series))
    return out
