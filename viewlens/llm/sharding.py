"""Contiguous shards of equal byte size from global prefix sums (DataFrame functions only).

Documents are put in the order (id, size, text checksum) by a range
partitioning.  Each partition's total size and row count give, by a running sum
over the partitions, where the partition starts in the whole order.  Adding the
running sum inside the partition gives each row's global byte prefix, and the
row goes to the shard in which the middle of its bytes lies when the whole is
cut at equal targets.  Shards are runs of that order, and their sizes differ
from the target by less than the largest document.

What meets in one place is one row per partition and one per shard.  The last
key of the range partitioning is a row number, so that a run of rows that are
equal in all else is still split over partitions.

Defined results: null text has no bytes (size 1, checksum of the empty text);
null ids come first; repeated rows are rows of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewlens.llm.common import written

LAW = "bytes"


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_no")), "sizes")
    order = ["doc_id", "size", "text_crc32", "row_no"]
    placed = written(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")

    # one row per partition; the running sums over them fit one task
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = written(totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes")), "starts")

    inside = Window.partitionBy("part").orderBy(*order)
    bytes_to = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    at = placed.select("part", *order, F.coalesce(bytes_to, F.lit(0)).alias("inside_bytes"),
                       (F.row_number().over(inside) - 1).alias("inside_rows"))
    at = at.join(F.broadcast(starts), "part")
    # middle of the row's bytes * n_shards / all bytes; doubled to stay whole, decimal to stay exact
    middle = (2 * (F.col("bytes_before") + F.col("inside_bytes")) + F.col("size")).cast("decimal(20,0)")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * F.col("all_bytes"))).cast("int"))
    at = written(at.select("doc_id", "size", "text_crc32", shard.alias("shard"),
                           (F.col("rows_before") + F.col("inside_rows")).alias("place")), "places")
    firsts = at.groupBy("shard").agg(F.min("place").alias("first_place"))  # one row per shard
    return at.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
