"""Incremental ingestion of the daily placement files.

The analyses themselves are batch (no watermark, window or state in the
original work).  What arrives over time is the daily placement file; this
module cleans each new file as it lands and appends it to the published
``placement_clean`` table with Structured Streaming, so the batch summaries
always read every day received so far.
"""

from viewlens.streaming.placements import ingest_placement_files, placement_stream  # noqa: F401
