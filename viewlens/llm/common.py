"""What several operators share: written intermediates, names, word memos."""

from __future__ import annotations

import gc
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import viewlens
from viewlens.session import work_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Bytes of a batch that is handed to Python at a time; a single longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def importable(spark: SparkSession) -> SparkSession:
    """Makes a session ready for the operators' Python parts.

    Python workers on the driver's machine can import the package from where the
    driver did; on a cluster it is installed or comes with ``--py-files``, and
    this only spares a local session that step.  Batches are bounded by bytes
    rather than rows, since texts can be long; a smaller bound is kept.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(bound).lower()).groups()
    if not 0 < int(set_) << 10 * " kmg".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(viewlens.__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back.

    Cuts the lineage the way a checkpoint does, so a lost executor costs a
    reread and not a recomputation, but stays columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


_TABLES: dict[tuple, object] = {}


def worker_tables(make, *args):
    """``make(*args)``, kept for the next task in this Python worker.

    A worker serves one operator after another; it keeps the tables of the last
    one only, so that a pipeline needs the memory of its largest stage and not
    of all of them.
    """
    key = (make, *args)
    if key not in _TABLES:
        drop_tables()
        _TABLES[key] = make(*args)
    return _TABLES[key]


def drop_tables() -> None:
    """Gives back what this Python worker keeps of the last operator; for operators that need no tables."""
    if _TABLES:
        _TABLES.clear()
        gc.collect()  # a memo and its tables refer to each other
        pa.default_memory_pool().release_unused()


def hash_sample(df: DataFrame, key: str, size: int, total: int | None = None) -> DataFrame:
    """At most ``size`` rows, those with the least hashes of ``key`` among about four times as many.

    The share taken follows from the row count (``total`` where it is known), so
    each task hands on few rows however many tasks there are.  The same rows
    come out at every run.
    """
    h = F.xxhash64(key)
    total = df.count() if total is None else total
    share = df.where(F.pmod(h, F.lit(max(1, total))) < 4 * size)
    return share.orderBy(h, key).limit(size)


# Longer words are computed at every occurrence and never stored.
LONGEST = 1000
# About the bytes that an entry takes besides the word's and the value's own.
ENTRY = 200


class WordMemo(dict):
    """Computes a value for each distinct word once, in bounded memory.

    Holds at most two generations of ``limit`` words and about ``room`` bytes: when
    the young one is full it becomes the old one, and words that are asked for again
    move back.  Frequent words therefore stay, and rare ones are computed again
    later, so the bounds never change a result.
    """

    def __init__(self, compute, limit: int = 300_000, room: int = 32 << 20):
        super().__init__()
        self.compute, self.limit, self.room, self.used, self.old = compute, limit, room, 0, {}

    def __missing__(self, word):
        if len(word) > LONGEST:
            return self.compute(word)
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.limit or self.used > self.room:
            self.old, self.used = self.copy(), 0
            self.clear()
        self.used += ENTRY + len(word) + (len(value) if isinstance(value, bytes) else 0)
        self[word] = value
        return value
