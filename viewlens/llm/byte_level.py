"""Byte-level BPE ids of whole texts, by distinct chunk.

The tokenizer's pattern never crosses from what stands before a space into that
space if a word follows it, so the ids of a text are those of its chunks (see
``chunks``) one after another.  The distinct chunks of ASCII characters and Latin-1
letters go through ``tiktoken`` as one joined text, with the ranks of the
tokenizer's own vocabulary; all others go through the ``tokenizers`` library itself,
because the two may differ in which rare characters they take for letters.  On the
rest the two agree: the vocabulary is checked to be in the order of its merges (if
it is not, all chunks go through the library), and tests compare whole texts.

Texts that hold a special token's string are encoded whole by the library, unless
these strings are to be plain text (``special=False``).
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from viewlens.llm.chunks import Chunks, binary
from viewlens.llm.common import worker_tables

# Fixed value: the pattern by which byte-level BPE tokenizers cut a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space and a word of ASCII characters and Latin-1 letters, in RE2's terms.
PLAIN = r"^ [!-~À-ÖØ-öø-ÿ][\x00-\x7fÀ-ÖØ-öø-ÿ]*\z"


def byte_of_letter() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """Texts to ids for one byte-level tokenizer in one Python worker."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()] if special else []
        letters = byte_of_letter()
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = {i: bytes(letters[c] for c in piece) for piece, i in vocabulary.items()}
        self.size = np.zeros(1 + max(self.bytes), np.int64)  # bytes of each id
        for i, b in self.bytes.items():
            self.size[i] = len(b)
        # merges in the order of the ids that they make: then ranks and merges choose the same pairs
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.ranked = made == list(range(256, 256 + len(made))) and len(self.bytes) == 256 + len(made)
        if self.ranked:
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, special_tokens={},
                                          mergeable_ranks={b: i for i, b in self.bytes.items()})

        self.last = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _by_library(self, texts: list[str]) -> pa.Array:
        found = [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]
        return binary(np.concatenate([*found, np.empty(0, "<u4")]), np.cumsum([0, *map(len, found)]) * 4)

    def _joined(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks that each begin with a space and a word, encoded as one text."""
        ends = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64))
        data = memoryview(chunks.buffers()[2]) if len(chunks) else memoryview(b"")
        start = int(np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset]) if len(chunks) else 0
        text = str(data[start:start + int(ends[-1]) if len(ends) else 0], "utf-8")
        ids = np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        cut = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        return binary(ids, np.concatenate([[0], cut]) * 4)

    def of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each distinct chunk.

        Those that the last group of texts had too are taken from there.
        """
        last, ids = self.last
        at = pc.index_in(chunks, value_set=last)
        unknown = at.is_null()
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
        unknown_at = np.flatnonzero(unknown.to_numpy(zero_copy_only=False))
        at[unknown_at] = len(last) + np.arange(len(unknown_at))
        found = pa.concat_arrays([ids, self._compute(chunks.filter(unknown))]).take(pa.array(at))
        self.last = chunks, found
        return found

    def _compute(self, chunks: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(chunks, PLAIN) if self.ranked else pa.array(np.zeros(len(chunks), bool))
        rest = pc.invert(plain)
        found = pa.concat_arrays([self._joined(chunks.filter(plain)),
                                  self._by_library(chunks.filter(rest).to_pylist())])
        order = np.concatenate([np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (plain, rest)])
        return found.take(pa.array(np.argsort(order)))

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        rest = texts.filter(pa.array(~whole)) if whole.any() else texts
        cut = Chunks(rest)
        found = iter(cut.of_texts(self.of_chunks(cut.vocabulary)))
        special = iter(self._by_library(texts.filter(pa.array(whole)).to_pylist()).to_pylist() if whole.any() else [])
        return [memoryview(next(special)) if w else next(found) for w in whole.tolist()]


def byte_level(path: str, special: bool = True) -> ByteLevel:
    return worker_tables(ByteLevel, path, special)
