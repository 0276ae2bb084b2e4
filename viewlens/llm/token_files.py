"""Token-id files in patched frame-of-reference blocks, in ascending document order.

Writing: documents are range-partitioned and sorted by id, and each task turns its
part into segments of about ``SEGMENT_IDS`` ids: a header, then the document ids,
the documents' lengths and the token ids as three packed streams (see
``frame_of_reference``).  A segment names its part, its place in it and how many ids
of the part come before it.  Spark's text writer stores the segments' bytes, one
file for at most ``FILE_SEGMENTS`` of them, so files are committed with the job, a
lost task leaves none behind, and any file system that Spark reaches will do.

Reading: whole files through Spark's ``binaryFile`` source; every segment's checksum
is tested.  A document's start in the corpus is its start in the part plus the
totals of the parts before, of which there is one row for each part.

Defined results: null text is empty, and an empty document is its end id alone;
null document ids come first; rows that repeat are documents of their own, in the
order of their texts' hashes; an empty table gives no documents.  Document ids have
to be integers.  A document stays in one segment, however long it is.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from viewlens.llm.byte_level import byte_level
from viewlens.llm.chunks import groups, whole
from viewlens.llm.common import importable, written
from viewlens.llm.frame_of_reference import Stream, pack
from viewlens.session import work_dir

END_ID = 2
# Ids of a segment (a longer document makes a longer one), and segments of a file.
SEGMENT_IDS = 1 << 20
FILE_SEGMENTS = 16
MAGIC = b"PFR1"
# magic, part, ids of the part before, documents, of these with null ids, bytes of the streams, their crc32
HEAD = struct.Struct("<4sqqqqqI")


def segment(part: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one segment; null document ids have to come first."""
    nulls = sum(i is None for i in doc_ids)
    body = (pack(np.array(doc_ids[nulls:], np.int64)) + pack(np.array(lengths, np.int64)) + pack(ids.astype(np.int64)))
    return HEAD.pack(MAGIC, part, before, len(doc_ids), nulls, len(body), zlib.crc32(body)) + body


class Segment:
    """A segment in the bytes of a file, from ``at`` to ``end``."""

    def __init__(self, data: memoryview, at: int):
        magic, self.part, self.before, self.docs, nulls, size, crc = HEAD.unpack_from(data, at)
        start = at + HEAD.size
        self.end = start + size
        if magic != MAGIC or self.end > len(data) or zlib.crc32(data[start:self.end]) != crc:
            raise ValueError("a token file is damaged")
        ids = Stream(data, start)
        lengths = Stream(data, ids.end)
        self.tokens = Stream(data, lengths.end)
        self.doc_ids = [None] * nulls + ids.get().tolist()
        self.lengths = lengths.get()
        self.starts = np.cumsum(self.lengths) - self.lengths

    def document(self, k: int) -> np.ndarray:
        """The ids of the segment's document ``k`` alone, from the blocks that it lies in."""
        return self.tokens.get(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


def segments(data: bytes | memoryview) -> Iterator[Segment]:
    """The segments of a file; the writer ends each with a line feed."""
    data, at = memoryview(data), 0
    while at < len(data):
        found = Segment(data, at)
        at = found.end + 1
        yield found


def write(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id",
          text_col: str = "text", end_id: int = END_ID) -> str:
    """Writes the ids of all documents, each followed by ``end_id``; returns the folder."""
    spark = importable(docs.sparkSession)
    path = path or f"{work_dir(spark).rstrip('/')}/llm/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"document ids have to be integers, not {docs.schema[id_col].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_level(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        before, names, lengths, held = 0, [], [], []

        def out() -> pa.RecordBatch:
            nonlocal before, names, lengths, held
            payload = segment(part, before, names, lengths, np.concatenate(held))
            before += sum(lengths)
            names, lengths, held = [], [], []
            return pa.record_batch({"segment": pa.array([payload], pa.binary())})

        size = 0
        for t in groups(batches):
            for doc, ids in zip(t.column("doc_id").to_pylist(), encoder.encode(whole(t.column("text")))):
                names.append(doc)
                held += [np.frombuffer(ids, "<u4"), end]
                lengths.append(len(ids) // 4 + 1)
                size += lengths[-1]
                if size >= SEGMENT_IDS:
                    yield out()
                    size = 0
        if names:
            yield out()

    # the last two keys split a run of rows with one id; rows that are equal in them too have equal ids and texts
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*keys, F.col("row")).sortWithinPartitions(*keys).select("doc_id", "text")
    (ordered.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path))
    return path


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and on wish ``ids``, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for s in segments(content.as_buffer()):
                    ids = s.tokens.get().astype("<u4")
                    data, ends = memoryview(ids.tobytes()), ((s.starts + s.lengths) * 4).tolist()
                    crc = [zlib.crc32(data[i:j]) for i, j in zip((s.starts * 4).tolist(), ends)]
                    columns = {"doc_id": pa.array(s.doc_ids, pa.int64()), "part": pa.array([s.part] * s.docs, pa.int64()),
                               "inside": pa.array(s.before + s.starts), "n_tokens": pa.array(s.lengths),
                               "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        offsets = np.append(s.starts, s.tokens.n).astype(np.int32)
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                    yield pa.record_batch(columns)

    schema = "doc_id long, part long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = importable(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = written(files.mapInArrow(run, schema), "token-documents")
    # one row for each part: the running sum over them fits one task
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("ids_of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids_of_part").over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return found.join(F.broadcast(starts), "part").select(*columns, *["ids"] * with_ids)
