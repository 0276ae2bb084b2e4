"""Structured Streaming source and sink for the daily placement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from viewlens.plans.placements import placement_clean
from viewlens.session import table_path
from viewlens.sources.schemas import PLACEMENT_RAW


def placement_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New CSV files of ``folder`` as a stream of cleaned placement rows.

    Cleaning is row-wise (parse, strip, round), so the stream needs no state.
    """
    r = (spark.readStream.schema(PLACEMENT_RAW)
         .option("header", "true").option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return placement_clean(r.csv(folder))


def ingest_placement_files(spark: SparkSession, folder: str, out_path: str | None = None,
                           checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Append every not-yet-seen file of ``folder`` to the cleaned table.

    The checkpoint (under the shared work folder unless given) records which
    files were taken, so a restarted or repeated run appends each file
    exactly once.  ``once=True`` processes what is there and stops
    (``availableNow``); ``False`` keeps watching the folder.
    """
    out_path = out_path or table_path(spark, "placement_clean_stream")
    checkpoint = checkpoint or table_path(spark, "_checkpoints/placement_clean_stream")
    w = (placement_stream(spark, folder).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
