"""Window-style operators, written so no key's rows gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlens.functions.scalars import col


def first_per_key(df: DataFrame, key: str | list[str], order: str | list[str],
                  rank_col: str | None = None) -> DataFrame:
    """The first row of each key by ``order`` (``row_number() = 1``).

    Spark plans this as a partial ``WindowGroupLimit`` before the shuffle and a
    final one after, so a hot key sends at most one row per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in orders])
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1)
    return out if rank_col else out.drop(rn)


def share_of_total(df: DataFrame, count_col: str, name: str, scale: float = 1.0) -> DataFrame:
    """``count / sum(count)`` over the whole frame, times ``scale``.

    Only for an already grouped frame whose row count is bounded by the
    number of groups (a histogram, a flag cross-tab): the total is a window
    over the whole frame, i.e. one partition of those few rows.
    """
    total = F.sum(count_col).over(Window.partitionBy())
    return df.withColumn(name, F.col(count_col).cast("double") / total.cast("double") * F.lit(scale))


def with_position(sorted_df: DataFrame, name: str = "pos") -> DataFrame:
    """1-based position of each row of a sorted frame, computed distributed.

    The sorted frame is checkpointed to the shared work folder (its range
    partitions then stay fixed), each row gets its index inside its partition,
    and the partition offsets -- one row per partition, a bounded broadcast --
    are a running sum.  No row ever moves to a single task.
    """
    from viewlens.session import work_dir
    work_dir(sorted_df.sparkSession)
    df = sorted_df.checkpoint(eager=True)
    df = df.withColumn("_pid", F.spark_partition_id())
    df = df.withColumn("_idx", F.monotonically_increasing_id() - F.col("_pid").cast("long") * F.lit(1 << 33))
    counts = df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = df.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_idx") + 1).drop("_pid", "_idx", "_off")


def with_group_stats(df: DataFrame, keys: list[str], c: str,
                     stats: dict[str, str] | None = None) -> DataFrame:
    """Add per-group statistics of ``c`` to every row of the group.

    Computed as a grouped aggregate (partial aggregation, skew-safe) joined
    back on the keys; AQE splits a skewed key's partition in the join.
    ``stats`` maps output name to one of mean, sd, max, min, count.
    """
    stats = stats or {"mean": "mean", "sd": "sd", "max": "max", "min": "min", "count": "count"}
    fn = {"mean": F.avg, "sd": F.stddev_samp, "max": F.max, "min": F.min,
          "count": lambda x: F.count(F.lit(1))}
    agg = df.groupBy(*keys).agg(*[fn[s](F.col(c)).alias(n) for n, s in stats.items()])
    # NULL keys form a group of their own, so join null-safely.
    a = agg.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                   *[F.col(n) for n in stats])
    cond = [df[k].eqNullSafe(a[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(a, on=cond, how="inner").drop(*[f"_k{i}" for i in range(len(keys))])


def nan_last(c: str | Column) -> Column:
    """Sort key that puts NaN with NULL (last), as R orders NA and NaN."""
    x = col(c)
    return F.when(~F.isnan(x), x)


def order_by(df: DataFrame, cols: str | list[str], desc: bool = False,
             ties: list[str] | None = None) -> DataFrame:
    """Total order: NA/NaN last either way, then ``ties`` ascending."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    keys = []
    for c in cols:
        k = nan_last(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        keys.append(k.desc_nulls_last() if desc else k.asc_nulls_last())
    keys += [F.col(t).asc_nulls_last() for t in (ties or [])]
    return df.orderBy(*keys)
