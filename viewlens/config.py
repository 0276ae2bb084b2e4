"""Run parameters for the impression audit.

Every value that shapes the result is an argument; nothing tenant-specific is
hard-coded as a default except the published code lists of the audit itself.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Fixed values of the audit: its code lists.
KEPT_STATUSES = (3, 12, 61)
KEPT_OPERATIONS = (3, 12, 61)
AUDITED_VERSIONS = (6, 7)
EXCLUDED_MEDIA_SIZES = (-10, 35, 37, 38, 40, 41, 42, 50, 51, 52, 53, 54)
EVENT_CODES = (10, 11, 20, 30, 40, 50, 60, 70, 80, 90)
FEATURE_EVENT_CODES = (10, 90)


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one audit run.

    ``ad_start``/``ad_end`` bound the ad, bid and notify logs (both ends
    included).  ``event_start``/``event_end`` are the event *dates*, widened by
    ``slack_days`` on each side.  ``feature_window`` bounds the events whose
    feature string is parsed; ``None`` means the widened event-date window.
    ``tenant=None`` disables the tenant filter.  ``feature_tenant`` also
    applies it to the feature events (the original does not).
    ``dedupe_bids`` counts each distinct bid URL once in ``nrows`` (the
    original counts every bid row).  ``check_feature_length`` adds a column
    telling whether the packed feature string is long enough (35 characters)
    for its fixed flag offsets.
    """

    ad_start: dt.datetime
    ad_end: dt.datetime
    event_start: dt.date
    event_end: dt.date
    tenant: int | None = None
    slack_days: int = 1
    statuses: tuple[int, ...] = KEPT_STATUSES
    operations: tuple[int, ...] = KEPT_OPERATIONS
    versions: tuple[int, ...] = AUDITED_VERSIONS
    excluded_media_sizes: tuple[int, ...] = EXCLUDED_MEDIA_SIZES
    excluded_campaigns: tuple[int, ...] = ()
    event_codes: tuple[int, ...] = EVENT_CODES
    feature_event_codes: tuple[int, ...] = FEATURE_EVENT_CODES
    feature_window: tuple[dt.datetime, dt.datetime] | None = None
    feature_tenant: bool = False
    dedupe_bids: bool = False
    check_feature_length: bool = False

    @property
    def event_first_day(self) -> dt.date:
        return self.event_start - dt.timedelta(days=self.slack_days)

    @property
    def event_last_day(self) -> dt.date:
        return self.event_end + dt.timedelta(days=self.slack_days)


def fixture_config() -> RunConfig:
    """The run settings that fit the driver-derived fixture logs."""
    return RunConfig(
        ad_start=dt.datetime(1996, 1, 1, 0, 0, 0),
        ad_end=dt.datetime(2000, 1, 1, 0, 0, 0),
        event_start=dt.date(2024, 1, 1),
        event_end=dt.date(2024, 1, 30),
        tenant=1,
        excluded_campaigns=(43, 44, 45),
    )
