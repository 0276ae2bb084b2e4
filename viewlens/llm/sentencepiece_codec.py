"""SentencePiece encoding and decoding through distinct-chunk tables.

If no piece of the model has a white-space marker after another character, no
merge crosses from a word into the marker of the next, so a text can be cut
before a space that a word follows and its ids are those of the chunks (marked
words, see ``chunks``) one after another.  Each task numbers the distinct chunks of
a group of texts; a chunk is segmented (and decoded) once and every occurrence takes
its ids by position.  The table is per group of texts rather than one shuffled table
for the corpus, because a row per word occurrence is several times the input; a
group is bounded in bytes, so words of unlimited number or length only cost time.

The property of the model is checked, and a model without it (or one that
changes white space or other characters in normalising) is applied to whole
texts instead, with the same results.

Defined results: null text is empty; an empty text has no ids, and its decoded
text is empty.  Rows that repeat are encoded as rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.chunks import Chunks, binary, groups, whole
from viewlens.llm.common import importable, worker_tables

MARK = "▁"
PROBE = "a  b\tc\n d\r 　é ①ﬁ "


class Codec:
    """Whole texts to ids and back, for one model in one Python worker."""

    def __init__(self, model: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.by_chunk = (not any(MARK in p.lstrip(MARK) for p in pieces)
                         and self.sp.piece_to_id(MARK) != self.sp.unk_id()
                         and self.sp.decode(self.sp.encode(PROBE)) == PROBE
                         and self.sp.encode("a", out_type=str)[0].startswith(MARK))
        self.decimal = pa.array([f"{i}," for i in range(self.sp.get_piece_size())], pa.large_string())

    def cut(self, texts: pa.Array) -> Chunks:
        """Chunks with the space that the library puts in front of a text; an empty text has none."""
        found = Chunks(texts, " ") if self.by_chunk else Chunks.uncut(texts, " ")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        found.end[empty] = found.begin[empty]
        return found

    def lists(self, chunks: pa.Array) -> list[list[int]]:
        """Ids of each chunk; the library puts the space in front itself."""
        return self.sp.encode(pc.utf8_slice_codeunits(chunks, 1).to_pylist(), num_threads=1)

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each has."""
        return joined([flat(self.lists(c)) for c in slices(chunks)])

    def both_ways(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids as ``ids`` gives them, and each chunk's decoded text after a space: decoding takes the marker
        off the first chunk of a text only."""
        found, texts = [], []
        for c in slices(chunks):
            lists = self.lists(c)
            found.append(flat(lists))
            texts.append(pa.array([" " + t for t in self.sp.decode(lists, num_threads=1)], pa.large_string()))
        return *joined(found), pa.concat_arrays([*texts, pa.array([], pa.large_string())]).cast(pa.large_binary())


# Bytes of chunks whose ids are Python lists at a time.
SLICE_BYTES = 1 << 20


def slices(chunks: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of chunks of about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(chunks):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield chunks.slice(start, stop - start)
        start = stop


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *[p[k] for p in parts]]) for k in (0, 1))


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def id_bytes(ids: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """The ids of each chunk as bytes of numbers of ``kind``."""
    data = ids.astype(kind)
    return binary(data, np.concatenate([[0], np.cumsum(counts)]) * data.itemsize)


def codec(model: str) -> Codec:
    return worker_tables(Codec, model)


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    """``make`` gives the further columns from the codec and the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for t in groups(batches):
            yield pa.record_batch({"doc_id": t.column("doc_id").combine_chunks(), **make(c, whole(t.column("text")))})

    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and ``decoded`` of every document."""
    def make(c: Codec, texts: pa.Array) -> dict[str, pa.Array]:
        cut = c.cut(texts)
        ids, counts, decoded = c.both_ways(cut.vocabulary)
        ids = cut.of_texts(id_bytes(ids, counts, "<i4"))
        return {"ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
                "decoded": pa.array([str(x[1:], "utf-8") for x in cut.of_texts(decoded)], pa.string())}
    return _mapped(docs, model, id_col, text_col, "ids array<int>, decoded string", make)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the decimal ids and of the decoded text."""
    def make(c: Codec, texts: pa.Array) -> dict[str, pa.Array]:
        cut = c.cut(texts)
        ids, counts, decoded = c.both_ways(cut.vocabulary)
        written = c.decimal.take(pa.array(ids))
        offsets = np.frombuffer(written.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        ends = offsets[np.concatenate([[0], np.cumsum(counts)])]
        decimal = binary(written.buffers()[2] if len(ids) else b"", ends)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return {"n_tokens": pa.array(cut.sums(counts)),
                "ids_sha256": pa.array([sha(x[:-1]) for x in cut.of_texts(decimal)]),
                "decoded_sha256": pa.array([sha(x[1:]) for x in cut.of_texts(decoded)])}
    return _mapped(docs, model, id_col, text_col,
                   "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
