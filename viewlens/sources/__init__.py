"""Readers, writers and the fixture mapping from the driver's tables."""

from viewlens.sources.readers import normalise_log, read_log, read_placement_csv  # noqa: F401
from viewlens.sources.sinks import publish, stage  # noqa: F401
