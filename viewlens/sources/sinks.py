"""Sinks: session stages and durable published tables."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from viewlens.session import table_path
from viewlens.sources.statistics import Statistics, store
from viewlens.sources.versions import point_at


def stage(df: DataFrame, name: str, persist: bool = False) -> DataFrame:
    """Register ``df`` under ``name`` for the session (a temp table).

    ``persist=True`` only for stages read more than once in one job.
    """
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(name)
    return df


def publish(df: DataFrame, name: str, cluster_by: str | None = "transaction_nbr",
            path: str | None = None, as_table: bool = False, buckets: int | None = None,
            analyze: bool = False, compression: str = "zstd", laid_out: bool = False,
            statistics: bool = False, versioned: bool = False) -> DataFrame:
    """Write ``df`` durably (replacing any previous version) and return the
    written data read back, which also cuts the lineage.

    ``cluster_by`` lays rows out by that key (ignored when the frame has no
    such column): a ``rebalance`` hint, so AQE splits a skewed key over
    several files instead of one huge task.  ``laid_out`` says that the frame
    is already partitioned by the key (it comes out of a join or grouping on
    it, or is read from such a table); it is then written as it is, without
    another shuffle.  With ``as_table`` and ``buckets`` the table is bucketed by
    the key, so later joins on it need no shuffle; one task writes each bucket.
    ``analyze`` computes column statistics of a table, by a scan of its own.
    ``statistics`` takes them while the data is written and keeps them beside it
    (``sources.statistics``), for paths too.
    ``versioned`` writes a new version beside the old and switches to it in one
    step (``sources.versions``); read it with ``read_version``.  Without it the old
    data goes before the new is complete, and a frame cannot replace its own source.
    ``path`` defaults to a folder under the shared work folder.
    """
    if versioned and as_table or statistics and as_table and not path:
        raise ValueError("versions are kept for paths, statistics for paths and for tables with one")
    spark = df.sparkSession
    schema = df.schema
    if cluster_by and cluster_by not in df.columns:
        cluster_by = None          # frames without the key keep Spark's layout
    if cluster_by and buckets:
        df = df.repartition(buckets, cluster_by)
    elif cluster_by and not laid_out:
        df = df.hint("rebalance", cluster_by)
    measured = Statistics(df) if statistics else None
    df = measured.observed if measured else df
    w = df.write.mode("overwrite").option("compression", compression).format("parquet")
    if as_table:
        if buckets and cluster_by:
            w = w.bucketBy(buckets, cluster_by).sortBy(cluster_by)
        if path:
            w = w.option("path", path)
        w.saveAsTable(name)
        if measured:
            store(measured.frame(), path)
        if analyze:
            spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
        return spark.table(name)
    base = path or table_path(spark, name)
    version = f"version-{uuid.uuid4().hex}"
    out = f"{base.rstrip('/')}/{version}" if versioned else base
    w.save(out)
    if measured:
        store(measured.frame(), out)
    if versioned:
        point_at(spark, base, version)
    return spark.read.schema(schema).parquet(out)


def publish_view(df: DataFrame, name: str, where: str) -> DataFrame:
    """A filtered view over a published frame (e.g. one tenant), for this session."""
    return stage(df.where(where), name)


def publish_durable_view(spark: SparkSession, name: str, source: str, where: str, is_path: bool = False) -> DataFrame:
    """A filtered view in the catalog over a published table, or over the dataset at a path.

    Every session of the catalog finds it, and it always shows what is published now.
    """
    relation = f"parquet.`{source}`" if is_path else source
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {relation} WHERE {where}")
    return spark.table(name)
