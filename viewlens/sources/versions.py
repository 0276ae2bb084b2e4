"""Published datasets in versions: a new one is written beside the old and takes its place in one step.

A dataset's folder holds a folder for each version and a pointer file with the name of
the current one.  The pointer is written under another name and renamed over the old
one, which file systems do in one step, so readers see the old version or the new one,
whole, whatever happens to the job in between.  A version that a failed job left
behind is never pointed at and goes with the next clean-up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER = "_current"


def _paths(spark: SparkSession, path: str):
    """Hadoop's file context and path class: the file system that Spark itself writes to."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration()) \
        if hadoop.Path(path).toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    return hadoop, context


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version, or None if there is none yet."""
    hadoop, context = _paths(spark, path)
    pointer = hadoop.Path(path, POINTER)
    if not context.util().exists(pointer):
        return None
    stream = context.open(pointer)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def point_at(spark: SparkSession, path: str, name: str) -> None:
    """Makes the version ``name`` the current one, in one step."""
    hadoop, context = _paths(spark, path)
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    made = hadoop.Path(path, f"{POINTER}-{uuid.uuid4().hex}")
    no_options = spark._sc._gateway.new_array(hadoop.Options.CreateOpts, 0)
    stream = context.create(made, flags, no_options)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    overwrite = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(made, hadoop.Path(path, POINTER), overwrite)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of all versions under ``path``, current or not."""
    hadoop, context = _paths(spark, path)
    if not context.util().exists(hadoop.Path(path)):
        return []
    return sorted(f.getPath().getName() for f in context.util().listStatus(hadoop.Path(path))
                  if f.isDirectory() and f.getPath().getName().startswith("version-"))


def read_version(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The current version of a published dataset."""
    found = current_version(spark, path)
    if found is None:
        raise FileNotFoundError(f"no version of {path} has been published")
    return (spark.read.schema(schema) if schema else spark.read).parquet(found)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all versions but the current one and the ``keep - 1`` newest others; returns their names.

    A reader that opened an older version keeps its file list and fails when the
    files go, so keep more than one while readers may be running.
    """
    hadoop, context = _paths(spark, path)
    now = (current_version(spark, path) or "").rsplit("/", 1)[-1]
    times = {f.getPath().getName(): f.getModificationTime() for f in context.util().listStatus(hadoop.Path(path))}
    others = sorted((n for n in versions(spark, path) if n != now), key=lambda n: (times[n], n), reverse=True)
    gone = others[max(0, keep - 1):]
    for name in gone:
        context.delete(hadoop.Path(path, name), True)
    return gone
