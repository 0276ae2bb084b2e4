"""Best-fit-decreasing packing of tokenised documents into sequences.

Tokenising: the ids of a text are those of its white-space separated words, one
after another, because the tokenizer drops white space and never merges across
it.  Each task numbers the distinct words of a group of texts and computes each once
(a bounded memo keeps frequent ones from group to group); letters followed by
punctuation are further split, as the tokenizer's own pattern does.

Packing: documents longer than a sequence are cut into full pieces; those fill a
sequence each.  All other pieces are dealt at random over groups of bounded
size, and each group is packed by best fit decreasing: pieces from long to
short, each into the open sequence with the least room that still holds it.  A
segment tree over the remaining capacities finds that sequence in logarithmic
time.  A second round takes the sequences that the groups left emptiest (at
most ``LOOSE`` of each group) and packs them again together.  Where most pieces
exceed half a sequence, a group can leave more half-empty sequences than that;
those stay as they are, and groups cost some sequences (figures in the README).

Defined results: null text is empty, and an empty document is its end id alone;
every row is a document of its own, also if rows repeat; null ids are kept.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.chunks import Words, binary, groups, whole
from viewlens.llm.common import WordMemo, importable, worker_tables, written

SEQUENCE = 2048
END_ID = 0
# Pieces per packing group, and how many of its sequences a group hands on.
GROUP_ROWS = 50_000
LOOSE = 16
# Bytes of text that are cut into words together; a longer text is a group of its own.
TEXT_BYTES = 4 << 20
# Sequence numbers are (group << 32) + number in the group; groups of the second round start here.
SECOND_ROUND = 1 << 30

# Letters, then punctuation other than the apostrophe (which starts contractions).
SIMPLE_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
PROBE = "It's A\tTEST, of\n ÉCOLE!! x1y  Straße #%"


class Tokens:
    """Ids (little-endian unsigned 32-bit bytes) of whole texts in one Python worker.

    If the tokenizer drops white space and lower-cases simple words, which is tried on
    a probe, a text's ids are those of its words; else whole texts are encoded.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.words, self.parts = WordMemo(self._word), WordMemo(self._part)
        self.by_word = b"".join(map(self._word, PROBE.split())) == self._encode(PROBE)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        # one pre-token in lower case and composed form: the model alone decides
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(part) if not part.isascii() else [(part, None)]
        return array("I", [t.id for p, _ in pieces for t in self.tok.model.tokenize(p)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = SIMPLE_WORD.fullmatch(word)
        if not found:
            return self._encode(word)
        letters, marks = found.groups()
        return self.parts[letters.lower()] + (self.parts[marks] if marks else b"")

    def encode_all(self, texts: pa.Array) -> list[memoryview]:
        if not self.by_word:
            return [memoryview(self._encode(t)) for t in texts.to_pylist()]
        words = Words(texts)
        found = [self.words[w] for w in words.vocabulary.to_pylist()]
        return words.of_texts(binary(b"".join(found), np.cumsum([0, *map(len, found)])))

    def encode(self, text: str) -> bytes:
        return bytes(self.encode_all(pa.array([text], pa.string()))[0])


def tokens(path: str) -> Tokens:
    return worker_tables(Tokens, path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``sequence`` ids: place in its document, checksum, on wish the ids."""
    importable(docs.sparkSession)
    end, width = array("I", [END_ID]).tobytes(), 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(tokenizer)
        for t in groups(batches, size_of_group=TEXT_BYTES):
            out = []
            for doc, found in zip(t.column("doc_id").to_pylist(), encoder.encode_all(whole(t.column("text")))):
                ids = bytes(found) + end
                for k in range(0, len(ids), width):
                    part = ids[k:k + width]
                    out.append((doc, k // width, k // 4, len(part) // 4, zlib.crc32(part),
                                *([np.frombuffer(part, np.int32)] if with_ids else [])))
            kinds = [t.schema.field("doc_id").type, pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            del t, out, found, ids, part
            pa.default_memory_pool().release_unused()  # a worker keeps no group's memory beyond it

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, "
              "ids_crc32 long" + ", ids array<int>" * with_ids)
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)


class Capacities:
    """Open bins by remaining capacity, with a segment tree that tells which capacities occur."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        i, tree = room + self.size, self.tree
        while i and not tree[i]:
            tree[i] = 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need that an open bin has, or -1."""
        tree, i = self.tree, need + self.size
        if tree[i]:
            return need
        while i > 1:  # up to the first right neighbour that holds a bin, then down its left edge
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        which = self.bins[room].pop()
        if not self.bins[room]:
            i, tree = room + self.size, self.tree
            tree[i] = 0
            while i > 1 and not tree[i] and not tree[i ^ 1]:
                i >>= 1
                tree[i] = 0
        return which


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin."""
    which = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_bins = Capacities(capacity)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        room = open_bins.tightest(n)
        if room < 0:
            b, room = len(fill), capacity
            fill.append(0)
        else:
            b = open_bins.take(room)
        which[k], offset[k] = b, fill[b]
        fill[b] += n
        if room > n:
            open_bins.add(room - n, b)
    return which, offset, np.array(fill, np.int64)


def packed(cut: DataFrame, sequence: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` rows with ``sequence_id`` and ``offset``; sequences are gapless and never too long."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        which, at, fill = best_fit_decreasing(group["length"].to_numpy(), sequence)
        loose = np.zeros(len(fill), bool)
        loose[np.argsort(fill, kind="stable")[:LOOSE]] = True
        return pd.DataFrame({"row_no": group["row_no"], "bin": which + (int(group["grp"].iloc[0]) << 32),
                             "at": at, "fill": fill[which], "loose": loose[which]})

    def pack_again(group: pd.DataFrame) -> pd.DataFrame:
        which, at, _ = best_fit_decreasing(group["fill"].to_numpy(), sequence)
        return pd.DataFrame({"bin": group["bin"], "new_bin": which + (SECOND_ROUND + int(group["grp"].iloc[0]) << 32),
                             "shift": at})

    def dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
        return rows.withColumn("grp", F.pmod(F.xxhash64(key), F.lit(groups)))

    cut = written(cut.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == sequence
    n = cut.where(~full).count()
    groups = max(1, -(-n // group_rows))
    placed = written(dealt(cut.where(~full).select("row_no", "length"), "row_no", groups).groupBy("grp")
                     .applyInPandas(pack, "row_no long, bin long, at long, fill long, loose boolean"), "packed")
    if groups > 1:
        loose = dealt(placed.where("loose").select("bin", "fill").distinct(), "bin",
                      -(-groups * LOOSE // group_rows))
        moved = loose.groupBy("grp").applyInPandas(pack_again, "bin long, new_bin long, shift long")
        placed = placed.join(moved, "bin", "left").select(
            "row_no", F.coalesce("new_bin", "bin").alias("bin"),
            (F.col("at") + F.coalesce(F.col("shift"), F.lit(0))).alias("at"))
    columns = [c for c in cut.columns if c != "row_no"]
    # full pieces have negative sequence numbers, the groups' sequences others
    whole = cut.where(full).select(*columns, (-1 - F.col("row_no")).alias("sequence_id"),
                                   F.lit(0).cast("long").alias("offset"))
    rest = cut.where(~full).join(placed, "row_no").select(
        *columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return whole.unionAll(rest)
