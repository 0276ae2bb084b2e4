"""viewlens: ad-viewability analytics as PySpark DataFrame transforms.

Two families of work, both plain DataFrame plans that Catalyst optimises:

* the impression audit: bid, ad-serve, view-notify and browser-event logs are
  reduced to one row per impression, audited for inconsistent records, cleaned
  and summarised (``viewlens.plans.impressions``, ``events``, ``detail``,
  ``reports``);
* the placement analysis: a daily publisher/placement viewability file is
  cleaned and summarised by day, publisher and placement
  (``viewlens.plans.placements``).
"""

from viewlens.config import RunConfig

__all__ = ["RunConfig"]
__version__ = "0.1.0"
