"""Command line / spark-submit entry point.

    python -m viewlens impression --ads A --bids B --notify N --events E \\
        --ad-start "2024-03-01 19:00:00" --ad-end "2024-03-14 00:00:00" \\
        --event-start 2024-03-01 --event-end 2024-03-14 --tenant 42 --out OUT
    python -m viewlens placements --csv "in/*.csv" --out OUT

Every dataset is published under ``--out``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from viewlens.config import RunConfig


def _ints(s: str | None) -> tuple[int, ...] | None:
    return tuple(int(x) for x in s.split(",") if x.strip()) if s else None


def parse_args(argv: list[str]) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="viewlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    im = sub.add_parser("impression", help="the impression audit")
    for k in ("ads", "bids", "notify", "events"):
        im.add_argument(f"--{k}", required=True, help=f"{k} log: a path, or a table with --format table")
    im.add_argument("--format", default="parquet", help="parquet, orc, table, ...")
    im.add_argument("--ad-start", required=True)
    im.add_argument("--ad-end", required=True)
    im.add_argument("--event-start", required=True)
    im.add_argument("--event-end", required=True)
    im.add_argument("--tenant", type=int)
    im.add_argument("--slack-days", type=int, default=1)
    im.add_argument("--statuses")
    im.add_argument("--operations")
    im.add_argument("--versions")
    im.add_argument("--event-codes")
    im.add_argument("--check-feature-length", action="store_true")
    im.add_argument("--exclude-media-sizes")
    im.add_argument("--exclude-campaigns")
    im.add_argument("--feature-start")
    im.add_argument("--feature-end")
    im.add_argument("--buckets", type=int)
    im.add_argument("--split-hot-bids", action="store_true", help="join the bids of hot transactions in several tasks")
    im.add_argument("--out", required=True)
    pl = sub.add_parser("placements", help="the placement analysis")
    pl.add_argument("--csv", required=True)
    pl.add_argument("--bad-lines", help="keep malformed lines in this folder instead of filling them up")
    pl.add_argument("--min-total", type=float, default=1000)
    pl.add_argument("--min-days", type=int, default=20)
    pl.add_argument("--publisher", help="with --placement: also publish this placement's daily series")
    pl.add_argument("--placement")
    pl.add_argument("--out", required=True)
    for p in (im, pl):
        p.add_argument("--versioned", action="store_true", help="replace datasets in one step, version by version")
        p.add_argument("--statistics", action="store_true", help="keep column statistics beside each dataset")
    return ap.parse_args(argv)


def config_from(a: argparse.Namespace) -> RunConfig:
    kw = {}
    for arg, field in (("statuses", "statuses"), ("operations", "operations"), ("versions", "versions"),
                       ("event_codes", "event_codes"),
                       ("exclude_media_sizes", "excluded_media_sizes"),
                       ("exclude_campaigns", "excluded_campaigns")):
        v = _ints(getattr(a, arg))
        if v is not None:
            kw[field] = v
    if a.feature_start and a.feature_end:
        kw["feature_window"] = (dt.datetime.fromisoformat(a.feature_start), dt.datetime.fromisoformat(a.feature_end))
    kw["check_feature_length"] = a.check_feature_length
    return RunConfig(ad_start=dt.datetime.fromisoformat(a.ad_start), ad_end=dt.datetime.fromisoformat(a.ad_end),
                     event_start=dt.date.fromisoformat(a.event_start), event_end=dt.date.fromisoformat(a.event_end),
                     tenant=a.tenant, slack_days=a.slack_days, **kw)


def main(argv: list[str] | None = None) -> dict:
    a = parse_args(sys.argv[1:] if argv is None else argv)
    from viewlens.session import get_session
    spark = get_session()
    if a.cmd == "impression":
        from viewlens.plans.jobs import impression_job
        from viewlens.sources.readers import read_log
        logs = {k: read_log(spark, kind, getattr(a, k), a.format)
                for k, kind in (("ads", "ad"), ("bids", "bid"), ("notify", "notify"), ("events", "event"))}
        return impression_job(logs["ads"], logs["bids"], logs["notify"], logs["events"], config_from(a),
                              buckets=a.buckets, out_dir=a.out, versioned=a.versioned, statistics=a.statistics,
                              split_hot_bids=a.split_hot_bids)
    from viewlens.plans.jobs import placement_job
    from viewlens.sources.readers import quarantine_placement_csv, read_placement_csv
    if a.bad_lines:
        raw, report = quarantine_placement_csv(spark, a.csv, a.bad_lines)
        print("lines: {good} good, {bad} bad".format(**report.first().asDict()))
    else:
        raw = read_placement_csv(spark, a.csv)
    return placement_job(raw, min_total=a.min_total, min_days=a.min_days, out_dir=a.out,
                         versioned=a.versioned, statistics=a.statistics, drill=(a.publisher, a.placement) if a.publisher and a.placement else None)


if __name__ == "__main__":
    main()
