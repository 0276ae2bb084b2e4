"""Exact distinct counts by mergeable bitmaps: a distinct value is a bit, and partial results are OR-ed.

For values that are numbers of a small range already, such as days.  A bitmap is a few
64-bit columns for neighbouring numbers, so a group needs one for each such range that
it meets.  Columns of fixed width are OR-ed in place in a hash aggregate, whose memory
grows with the groups and ranges of a task.  So the rows of a group are first brought
together: a read split may hold a few rows of nearly every group, and its hash map then
grew to an entry for almost each of its rows.  A hot group's partition is split by AQE,
as the bitmaps of one group may come from any number of tasks.  Spark's own bitmaps are
4 KB of binary each, for which it sorts whole rows (figures in the README).  Values that
would have to be numbered first (publishers, placements) are counted by nested grouping
instead: numbering them costs a pass and a join of its own, and measured slower (README,
"Performance").
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 64-bit columns of a bitmap (a power of two): days of about 17 months.
WORDS = 8
# Rows are gathered in at most 200 partitions, up to which Spark writes a shuffle without holding rows in memory
# (``spark.shuffle.sort.bypassMergeThreshold``); AQE joins small ones and splits large ones.
GATHERED = 200
BUCKETS = 1 << 12


def with_distinct_numbers(df: DataFrame, keys: list[str], number: Column, name: str, sums: Iterable[str]) -> DataFrame:
    """Per group of ``keys``: the distinct values of an integer column as ``name``, NULL counting as one, and sums."""
    sums = list(sums)
    no, words = F.col("_no"), [f"_bits{i}" for i in range(WORDS)]
    bit, word = F.expr("shiftleft(1L, CAST(_no & 63 AS INT))"), F.shiftright(no, 6).bitwiseAND(F.lit(WORDS - 1))
    # by a number that follows from the keys, not by the keys: then no group has to stay in one partition
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    parts = (df.select(*keys, *sums, number.cast("bigint").alias("_no"), bucket.alias("_bucket"))
             .hint("rebalance", GATHERED, "_bucket")
             .groupBy(*keys, F.shiftright(no, (64 * WORDS).bit_length() - 1).alias("_range"))
             .agg(*[F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(w)
                    for i, w in enumerate(words)], *[F.sum(c).alias(c) for c in sums]))
    # the missing numbers of a group are a range of their own
    found = F.when(F.col("_range").isNull(), 1).otherwise(sum((F.bit_count(w) for w in words), F.lit(0)))
    return parts.groupBy(*keys).agg(F.sum(found).alias(name), *[F.sum(c).alias(c) for c in sums])
