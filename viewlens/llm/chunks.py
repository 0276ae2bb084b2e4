"""Texts as sequences of chunks that a tokenizer treats one by one, by distinct chunk.

A chunk is a word with the space before it.  Tokenizers whose pieces cannot cross
from what stands before a space into that space give a text the ids of its chunks
one after another, so each distinct chunk of a group of texts is computed once and
the results are put back by position.  Splitting, numbering and putting back are
Arrow kernels; no Python object is made for a word, except in texts where a space
is followed by more white space, which are cut by a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are cut into chunks together; a longer text is a group of its own.
GROUP_BYTES = 16 << 20
# Characters of a long text that are cut at a time.
SECTION = 1 << 20
# A space between words; Python's \S excludes all that any tokenizer takes for white space, and U+2581 is a
# space to some.
CUT = re.compile(r"(?<![ ▁]) (?=[^\s▁])")
# The same in RE2's terms: a part of a text split at spaces that is no word, or that U+2581 begins or ends.
NO_WORD = r"^(?:\z|[\s\x0b\x1c-\x1f\x{85}\pZ▁])|▁\z"


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", size_of_group: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """The batches in tables of about ``size_of_group`` bytes of text, whole rows, null texts empty."""
    held: list[pa.RecordBatch] = []
    size = 0

    def table() -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        at = t.schema.get_field_index(text)
        return t.set_column(at, text, pc.fill_null(t.column(at), ""))

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(b.schema.get_field_index(text)).nbytes
        if size >= size_of_group:
            yield table()
            held, size = [], 0
    if held:
        yield table()


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


class Coded:
    """Texts as numbers of the entries of ``vocabulary``: text k is codes[begin[k]:end[k]]."""

    vocabulary: pa.Array
    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def of_texts(self, values: pa.Array) -> list[memoryview]:
        """The values (large binary, one for each chunk of the vocabulary) of each text's chunks in order."""
        if not len(self.codes):
            return [memoryview(b"")] * len(self.begin)
        found = values.take(pa.array(self.codes))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]
        data = memoryview(found.buffers()[2] or b"")
        return [data[i:j] for i, j in zip(offsets[self.begin].tolist(), offsets[self.end].tolist())]

    def occurrences(self, of: np.ndarray) -> np.ndarray:
        """How often each chunk of the vocabulary occurs in the texts that ``of`` marks."""
        change = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(change, self.begin[of], 1)
        np.add.at(change, self.end[of], -1)
        inside = np.cumsum(change)[:-1] > 0
        return np.bincount(self.codes[inside], minlength=len(self.vocabulary))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum over its chunks of a number of each chunk."""
        total = np.concatenate([[0], np.cumsum(values[self.codes])])
        return total[self.end] - total[self.begin]


class Words(Coded):
    """The words between ASCII white space."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        starts = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.flatten().dictionary_encode()
        codes = numbered.indices.to_numpy()
        empty = pc.index(numbered.dictionary, "").as_py()  # before the first and after the last white space
        before = np.concatenate([[0], np.cumsum(codes != empty)])
        self.vocabulary, self.codes = numbered.dictionary, codes[codes != empty]
        starts = before[starts - starts[0]]
        self.begin, self.end = starts[:-1], starts[1:]


class Chunks(Coded):
    """``vocabulary``: the distinct chunks as they stand in the texts, the space before included;
    ``codes``: their numbers, in order within a text; text k has codes[begin[k]:end[k]].

    ``lead`` is put in front of every text: a space, or nothing.
    """

    def __init__(self, texts: pa.Array, lead: str = ""):
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.flatten().dictionary_encode()
        words, codes = numbered.dictionary, numbered.indices.to_numpy().copy()
        starts -= starts[0]
        self.begin, self.end = starts[:-1].copy(), starts[1:].copy()
        odd_word = pc.match_substring_regex(words, NO_WORD).to_numpy(zero_copy_only=False)
        odd_here = odd_word[codes] if odd_word.any() else np.zeros(len(codes), bool)
        vocabulary = [pc.binary_join_element_wise(" ", words, "")]
        first = self.begin
        if not lead:  # a text's first word has no space in front
            numbered = pa.array(lists.flatten().take(pa.array(first))).dictionary_encode()
            odd_here[first] = False
            codes[first] = numbered.indices.to_numpy() + len(words)
            vocabulary.append(numbered.dictionary)
        long = pc.greater(pc.binary_length(texts), 4 * SECTION).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(long | self._any(odd_here, starts))
        self.codes = codes
        if len(odd):
            self._cut_again(texts, lead, odd, sum(map(len, vocabulary)), vocabulary)
        self.vocabulary = pa.concat_arrays(vocabulary) if len(vocabulary) > 1 else vocabulary[0]

    @classmethod
    def uncut(cls, texts: pa.Array, lead: str = "") -> Chunks:
        """Every text is one chunk."""
        self = cls.__new__(cls)
        numbered = pc.binary_join_element_wise(lead, texts, "").dictionary_encode()
        self.vocabulary, self.codes = numbered.dictionary, numbered.indices.to_numpy()
        self.begin = np.arange(len(texts))
        self.end = self.begin + 1
        return self

    @staticmethod
    def _any(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[starts[1:]] > total[starts[:-1]]

    def _cut_again(self, texts: pa.Array, lead: str, odd: np.ndarray, known: int, vocabulary: list[pa.Array]) -> None:
        """Cuts the odd and the long texts by the pattern; their codes follow those of the others."""
        number: dict[str, int] = {}
        more, at = [], len(self.codes)
        for k in odd.tolist():
            mine = [self._numbers(section, number) for section in sections(lead + texts[k].as_py())]
            mine = np.concatenate(mine).astype(self.codes.dtype) + known
            more.append(mine)
            self.begin[k], self.end[k] = at, at + len(mine)
            at += len(mine)
        self.codes = np.concatenate([self.codes, *more])
        vocabulary.append(pa.array(list(number), pa.string()))

    @staticmethod
    def _numbers(section: str, number: dict[str, int]) -> np.ndarray:
        parts = CUT.split(section)
        found = [parts[0]] if parts[0] else []
        found += [" " + p for p in parts[1:]]
        return np.array([number.setdefault(c, len(number)) for c in found], np.int64)


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, all but the first beginning with a space and a word."""
    start = 0
    while len(text) - start > size:
        found = CUT.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def binary(data: bytes | memoryview | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over ``data`` cut at ``offsets``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
