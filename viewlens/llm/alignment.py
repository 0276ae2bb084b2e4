"""Alignment of two tokenizers' tokens by the bytes that they share, and counts of linked ids.

Both tokenizers see a space and the text.  Their tokens are rows of two incidence
matrices over the text's bytes, built in compressed rows; the product A @ B^T, row by
row, has an entry for every two tokens whose byte ranges overlap (a link), whose value
is the number of bytes they share.  Byte offsets where tokens of both end cut the
tokens into groups; the product of the two group incidences has an entry for every two
tokens of one group.

No token of either tokenizer crosses from what stands before a space into the space
of a following word, so the matrices of a text consist of the blocks of its chunks
(see ``chunks``): the distinct chunks of a group of texts are aligned once, side by
side in one matrix, and texts take the results of their chunks.  If the second
tokenizer's model lets pieces cross, whole texts are aligned instead.

Counts of id pairs over the corpus: each block of texts counts its links inside the
task that aligned them, the corpus counts are the sums over blocks, and each block
gets the counts of its own pairs by a join and meets them by a cogroup.  Only the
highest count of each id of the second vocabulary is sent to every task: one row for
each id at most.

Defined results: null and empty texts, and texts whose tokens do not spell a space and
the text byte by byte, have no tokens: all numbers are zero and the groups are the
empty string, not hashed.  Rows that repeat are documents of their own and count
again; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.byte_level import ByteLevel
from viewlens.llm.chunks import Chunks, binary, groups, whole
from viewlens.llm.common import importable, worker_tables, written
from viewlens.llm.csr import Csr
from viewlens.llm.sentencepiece_codec import MARK, Codec

# Bytes of text that are aligned side by side: the matrices and groups of a block take about fifty times that.
BLOCK_BYTES = 2 << 20
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def ids_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks one after another, and how many each chunk has, from their 32-bit bytes."""
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset:lists.offset + len(lists) + 1]
    data = lists.buffers()[2] if len(lists) else None
    flat = np.frombuffer(data, "<u4") if data else np.empty(0, "<u4")
    first, last = (int(offsets[0]), int(offsets[-1])) if len(lists) else (0, 0)
    return flat[first // 4:last // 4].astype(np.int64), np.diff(offsets) // 4


class Aligned:
    """Chunks with their tokens of both sides; a chunk whose tokens do not spell it has none."""

    def __init__(self, chunks: pa.Array, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
                 aligner: Aligner):
        self.n, self.strings = len(chunks), aligner.strings
        self.spelt = spells(chunks, *a, aligner.a_bytes) & spells(chunks, *b, aligner.b_bytes)
        self.a, self.a_chunk = self._kept(*a)
        self.b, self.b_chunk = self._kept(*b)
        self.a_end, self.b_end = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        n_bytes = int(self.a_end[-1]) if len(self.a) else 0
        bytes_of_a = Csr(np.concatenate([[0], self.a_end]), np.arange(n_bytes), n_bytes)
        bytes_of_b = Csr(np.concatenate([[0], self.b_end]), np.arange(n_bytes), n_bytes)
        self.overlap = bytes_of_a.product(bytes_of_b.transpose())
        group_end = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(group_end, self.a_end), np.searchsorted(group_end, self.b_end)
        self.group_chunk = self.a_chunk[np.searchsorted(self.a_end, group_end)]
        self.link_chunk = self.a_chunk[self.overlap.row_of_entries()]
        self.n_a, self.n_b = self._per_chunk(self.a_chunk), self._per_chunk(self.b_chunk)
        self.n_groups, self.n_links = self._per_chunk(self.group_chunk), self._per_chunk(self.link_chunk)
        self.n_group_links = np.zeros(self.n, np.int64)
        for row, _, _ in self.in_groups():
            self.n_group_links += self._per_chunk(self.a_chunk[row])

    def _kept(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunk = np.repeat(np.arange(self.n), counts)
        keep = self.spelt[chunk]
        return ids[keep], chunk[keep]

    def _per_chunk(self, chunk: np.ndarray) -> np.ndarray:
        return np.bincount(chunk, minlength=self.n)

    def in_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links (A token, B token, 1) of tokens in one group, some rows at a time."""
        n = len(self.group_chunk)
        a = Csr(np.arange(len(self.a) + 1), self.a_group, n)
        return a.products(Csr(np.arange(len(self.b) + 1), self.b_group, n).transpose())

    def pairs(self) -> np.ndarray:
        """A id * 2**32 + B id of every link, in the order of the chunks."""
        return self.a[self.overlap.row_of_entries()] << 32 | self.b[self.overlap.indices]

    def groups(self) -> pa.Array:
        """Each chunk's groups as ``a1,a2|b1;a3|b2,b3;``."""
        n = np.arange(len(self.group_chunk))
        last_a, last_b = np.searchsorted(self.a_group, n, "right"), np.searchsorted(self.b_group, n, "right")
        before_b = np.searchsorted(self.b_group, n)
        text = np.empty(len(self.a) + len(self.b), np.int64)
        at = np.arange(len(self.a))
        text[at + before_b[self.a_group]] = self.strings.number(self.a, 0, at + 1 == last_a[self.a_group])
        at = np.arange(len(self.b))
        text[at + last_a[self.b_group]] = self.strings.number(self.b, 1, at + 1 == last_b[self.b_group])
        found = self.strings.array.take(pa.array(text))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]
        data = found.buffers()[2] if len(found) else b""
        ends = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return binary(data, offsets[ends] if len(offsets) else np.zeros(self.n + 1, np.int64))


def spells(chunks: pa.Array, ids: np.ndarray, counts: np.ndarray, pieces: pa.Array) -> np.ndarray:
    """For each chunk, whether the bytes of its tokens are the chunk's."""
    length = pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.repeat(np.arange(len(chunks)), counts)
    right = np.bincount(chunk, size[ids], len(chunks)).astype(np.int64) == length
    mine = chunks.filter(pa.array(right)).cast(pa.large_binary())
    spelt = pieces.take(pa.array(ids[right[chunk]]))
    wanted, found = _data(mine), _data(spelt)
    ends = np.cumsum(length[right])
    wrong = np.searchsorted(ends, np.flatnonzero(wanted != found), "right")
    right[np.flatnonzero(right)[wrong]] = False
    return right


def _data(values: pa.Array) -> np.ndarray:
    """All bytes of a large binary array."""
    if not len(values) or values.buffers()[2] is None:
        return np.empty(0, np.uint8)
    offsets = np.frombuffer(values.buffers()[1], np.int64)
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[values.offset]:offsets[values.offset + len(values)]]


class Strings:
    """Ids in decimal, followed by what stands after them in a group."""

    def __init__(self, n_a: int, n_b: int):
        self.size = (n_a, n_b)
        self.array = pa.array([f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)],
                              pa.large_string())

    def number(self, ids: np.ndarray, side: int, last: np.ndarray) -> np.ndarray:
        return side * 2 * self.size[0] + last * self.size[side] + ids


class Aligner:
    """Both tokenizers and their tokens' bytes, in one Python worker."""

    def __init__(self, a: str, b: str):
        self.byte_level, self.codec = ByteLevel(a, special=False), Codec(b)
        sp = self.codec.sp
        n_a = 1 + max(self.byte_level.bytes)
        self.a_bytes = pa.array([self.byte_level.bytes.get(i, b"") for i in range(n_a)], pa.large_binary())
        self.b_bytes = pa.array([bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                                 else sp.id_to_piece(i).replace(MARK, " ").encode()
                                 for i in range(sp.get_piece_size())], pa.large_binary())
        self.a_size, self.b_size = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
                                    for x in (self.a_bytes, self.b_bytes))
        self.strings = Strings(n_a, sp.get_piece_size())

    def cut(self, texts: pa.Array) -> Chunks:
        return self.codec.cut(texts)

    def align(self, chunks: pa.Array) -> Aligned:
        """All chunks begin with a space; the second tokenizer puts it there itself."""
        return Aligned(chunks, ids_of(self.byte_level.of_chunks(chunks)), self.codec.ids(chunks), self)


def aligner(a: str, b: str) -> Aligner:
    return worker_tables(Aligner, a, b)


def alignments(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, the ids and byte ends of its tokens of both sides, ``links`` (places of the
    two tokens and the bytes that they share) and ``groups`` as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(a, b)
        for t in groups(batches, size_of_group=BLOCK_BYTES):
            cut = tools.cut(whole(t.column("text")))
            found = tools.align(cut.vocabulary)
            links = {}
            for c, x, y, n in zip(found.link_chunk.tolist(), found.overlap.row_of_entries().tolist(),
                                  found.overlap.indices.tolist(), found.overlap.values.tolist()):
                links.setdefault(c, []).append((x, y, n))
            starts = [np.concatenate([[0], np.cumsum(n)]) for n in (found.n_a, found.n_b)]
            text = cut.of_texts(found.groups())
            out = []
            for k, doc in enumerate(t.column("doc_id").to_pylist()):
                codes = cut.codes[cut.begin[k]:cut.end[k]]
                row = {"doc_id": doc, "a_ids": [], "a_ends": [], "b_ids": [], "b_ends": [], "links": [], "groups": ""}
                if found.spelt[codes].all():
                    for c in codes.tolist():
                        base = len(row["a_ids"]), len(row["b_ids"]), (row["a_ends"] or [0])[-1]
                        for side, ids, ends, of in (("a", found.a, found.a_end, starts[0]),
                                                    ("b", found.b, found.b_end, starts[1])):
                            i, j = of[c], of[c + 1]
                            before = found.a_end[starts[0][c] - 1] if starts[0][c] else 0
                            row[f"{side}_ids"] += ids[i:j].tolist()
                            row[f"{side}_ends"] += (ends[i:j] - before + base[2]).tolist()
                        row["links"] += [{"a": x - int(starts[0][c]) + base[0], "b": y - int(starts[1][c]) + base[1],
                                          "bytes": n} for x, y, n in links.get(c, [])]
                    row["groups"] = str(text[k][:-1], "ascii")
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", t.schema.field("doc_id").type), *kinds]))

    places = pa.list_(pa.int64())
    kinds = [("a_ids", places), ("a_ends", places), ("b_ids", places), ("b_ends", places),
             ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())]))),
             ("groups", pa.string())]
    rows = importable_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind_of_id(rows)}, a_ids array<long>, a_ends array<long>, b_ids array<long>, "
                                "b_ends array<long>, links array<struct<a: long, b: long, bytes: long>>, groups string")


def importable_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def kind_of_id(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def aligned_blocks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The documents' numbers and chunk codes, and for each block of documents one row with its table:
    ``pairs`` (distinct, ascending) with their ``counts`` of links, the links of each chunk as places in
    ``pairs``, and how many links each chunk has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block = aligner(a, b), TaskContext.get().partitionId() << 32
        for t in groups(batches, size_of_group=BLOCK_BYTES):
            cut = tools.cut(whole(t.column("text")))
            found = tools.align(cut.vocabulary)
            good = (cut.sums((~found.spelt).astype(np.int64)) == 0) & (cut.end > cut.begin)
            shas = [hashlib.sha256(x[:-1]).hexdigest() if g else ""
                    for g, x in zip(good.tolist(), cut.of_texts(found.groups()))]
            codes = cut.codes.astype("<i4")
            mine = [codes[i:j].tobytes() if g else b""
                    for g, i, j in zip(good.tolist(), cut.begin.tolist(), cut.end.tolist())]
            pairs, at = np.unique(found.pairs(), return_inverse=True)
            times = np.repeat(cut.occurrences(good), found.n_links)  # of each link among the block's documents
            counts = np.bincount(at, times, len(pairs)).astype(np.int64)
            numbers = {n: pa.array(np.where(good, cut.sums(getattr(found, n)), 0)) for n in NUMBERS}
            n = len(t)
            yield pa.record_batch({
                "block": pa.array(np.full(n, block)), "doc_id": t.column("doc_id").combine_chunks(), **numbers,
                "groups_sha256": pa.array(shas), "codes": pa.array(mine, pa.binary()),
                "pairs": pa.nulls(n, pa.list_(pa.int64())), "counts": pa.nulls(n, pa.list_(pa.int64())),
                "links": pa.nulls(n, pa.binary()), "n_of_chunk": pa.nulls(n, pa.binary())}, schema=schema(t))
            none = {k: pa.nulls(1, schema(t).field(k).type) for k in ("doc_id", *NUMBERS, "groups_sha256", "codes")}
            yield pa.record_batch({
                "block": pa.array([block]), **none, "pairs": pa.array([pairs], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
                "links": pa.array([at.astype("<i4").tobytes()], pa.binary()),
                "n_of_chunk": pa.array([found.n_links.astype("<i4").tobytes()], pa.binary())}, schema=schema(t))
            block += 1
            del cut, found, shas, codes, mine, pairs, at, times, counts, numbers
            pa.default_memory_pool().release_unused()  # a worker keeps no block's memory beyond it

    def schema(t: pa.Table) -> pa.Schema:
        long, longs, data = pa.int64(), pa.list_(pa.int64()), pa.binary()
        return pa.schema([("block", long), ("doc_id", t.schema.field("doc_id").type), *[(n, long) for n in NUMBERS],
                          ("groups_sha256", pa.string()), ("codes", data), ("pairs", longs), ("counts", longs),
                          ("links", data), ("n_of_chunk", data)])

    return rows.mapInArrow(run, f"block long, doc_id {kind_of_id(rows)}, {', '.join(f'{n} long' for n in NUMBERS)}, "
                                "groups_sha256 string, codes binary, pairs array<long>, counts array<long>, "
                                "links binary, n_of_chunk binary")


def linked_counts(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, the numbers of its tokens, groups and links, ``n_best`` (links whose id pair is
    the most frequent of its second id in the corpus), ``count_sum`` (corpus counts of all its links' id pairs)
    and ``groups_sha256``."""
    rows = importable_rows(docs, id_col, text_col)
    blocks = written(aligned_blocks(rows, a, b), "aligned")
    tables = blocks.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    tables = tables.select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    corpus = written(tables.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # one row for each id of the second vocabulary at most
    most = F.broadcast(corpus.groupBy(second.alias("b")).agg(F.max("n").alias("most")))
    corpus = corpus.join(most, second == F.col("b")).select(
        "pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).cast("long").alias("best"))
    # the pairs of all blocks grow with the corpus: the same sort-merge plan at every size
    needed = tables.where("n > 0").select(F.col("block").alias("of_block"), "pair").join(corpus.hint("merge"), "pair")

    def counted(block: pa.Table, known: pa.Table) -> pa.Table:
        is_table = block.column("pairs").is_valid()
        row, of_docs = block.filter(is_table), block.filter(pc.invert(is_table))
        pairs = np.asarray(row.column("pairs")[0].values)
        place = np.searchsorted(pairs, known.column("pair").to_numpy())
        links = np.frombuffer(row.column("links")[0].as_buffer(), "<i4")
        ends = np.cumsum(np.frombuffer(row.column("n_of_chunk")[0].as_buffer(), "<i4"))
        codes = of_docs.column("codes").combine_chunks().cast(pa.large_binary())
        words = np.frombuffer(_data(codes), "<i4") if len(codes) else np.empty(0, "<i4")
        cuts = np.concatenate([[0], np.cumsum(pc.binary_length(codes).to_numpy(zero_copy_only=False))]) // 4
        out = {"doc_id": of_docs.column("doc_id"), **{n: of_docs.column(n) for n in NUMBERS}}
        for name, source in (("n_best", "best"), ("count_sum", "count")):
            of_pair = np.zeros(len(pairs), np.int64)  # pairs of documents without tokens alone stay at 0
            of_pair[place] = known.column(source).to_numpy()
            of_links = np.concatenate([[0], np.cumsum(of_pair[links])])
            of_chunk = np.diff(of_links[np.concatenate([[0], ends])])
            total = np.concatenate([[0], np.cumsum(of_chunk[words])])
            out[name] = pa.array(total[cuts[1:].astype(np.int64)] - total[cuts[:-1].astype(np.int64)])
        return pa.table({**out, "groups_sha256": of_docs.column("groups_sha256")})

    numbers = ", ".join(f"{n} long" for n in (*NUMBERS, "n_best", "count_sum"))
    return blocks.groupBy("block").cogroup(needed.groupBy("of_block")).applyInArrow(
        counted, f"doc_id {kind_of_id(rows)}, {numbers}, groups_sha256 string")
