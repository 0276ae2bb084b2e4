"""Token counts of a unigram segmentation, by dynamic programming shared over a trie.

A text's pre-tokens are its white-space separated words, each with the
vocabulary's word marker in front.  The unigram model gives every piece a log
probability; a pre-token's segmentation is the one of the highest total, of
equal totals the one with fewer tokens.  The best score of a prefix (the forward
score) depends on that prefix alone, so each task inserts its distinct
pre-tokens in a trie and computes a node's score and token count once, however
many pre-tokens share the prefix.  The node where a pre-token ends holds its
count; a document's count is the sum over its pre-tokens.

The probabilities follow from the vocabulary alone: Zipf's law over the pieces'
ranks (p proportional to 1 / (rank + ``ZIPF_SHIFT``)).  Characters that no piece
covers cost one token per UTF-8 byte, each at ``BYTE_LOG_P``.

Defined results: null and empty texts have no pre-tokens and no tokens; rows
that repeat are counted as rows of their own.  Memory: the trie starts anew
beyond ``NODES`` nodes, and pre-tokens over ``LONG`` characters are computed by
the same recurrence along a plain array, never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.chunks import Words, groups, whole
from viewlens.llm.common import WordMemo, importable, worker_tables

MARK = "▁"
ZIPF_SHIFT = 2.7
BYTE_LOG_P = -16.0
NODES = 400_000
LONG = 200


def unigram_log_p(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces in the order of their ranks."""
    total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(pieces))))
    log_p: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        log_p.setdefault(piece, -math.log(r + ZIPF_SHIFT) - total)
    return log_p


class UnigramTrie:
    """Forward scores and token counts of all prefixes of the inserted pre-tokens."""

    def __init__(self, log_p: dict[str, float], nodes: int = NODES):
        self.log_p, self.limit = log_p, nodes
        self.longest = max(map(len, log_p), default=0)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def _step(self, word: str, end: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Score and count of word[:end] from those of the shorter prefixes."""
        char_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best, n = score[end - 1] + BYTE_LOG_P * char_bytes, count[end - 1] + char_bytes
        log_p = self.log_p
        for start in range(max(0, end - self.longest), end):
            p = log_p.get(word[start:end])
            if p is not None:
                s = score[start] + p
                if s > best or s == best and count[start] + 1 < n:
                    best, n = s, count[start] + 1
        return best, n

    def insert(self, word: str) -> tuple[int, float]:
        """Token count and score stored at the pre-token's terminal node."""
        score, count = [0.0], [0]
        if len(word) > LONG:
            for end in range(1, len(word) + 1):
                s, n = self._step(word, end, score, count)
                score.append(s)
                count.append(n)
            return count[-1], score[-1]
        if len(self.score) > self.limit:
            self.clear()
        node, child = 0, self.child
        for end in range(1, len(word) + 1):
            key = (node, word[end - 1])
            node = child.get(key, -1)
            if node < 0:
                s, n = self._step(word, end, score, count)
                child[key] = node = len(self.score)
                self.score.append(s)
                self.count.append(n)
            score.append(self.score[node])
            count.append(self.count[node])
        return count[-1], score[-1]


def tables(model: str) -> tuple[WordMemo, UnigramTrie]:
    """The memo of terminals and the trie, kept in the worker."""
    return worker_tables(_tables, model)


def _tables(model: str) -> tuple[WordMemo, UnigramTrie]:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    normal = [i for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranked = sorted(normal, key=lambda i: (-sp.get_score(i), i))
    trie = UnigramTrie(unigram_log_p([sp.id_to_piece(i) for i in ranked]))
    return WordMemo(lambda word: trie.insert(MARK + word)), trie


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_pretokens``, ``n_tokens`` and the segmentation's ``log_p`` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminal, _ = tables(model)
        for t in groups(batches):
            words = Words(whole(t.column("text")))
            found = [terminal[w] for w in words.vocabulary.to_pylist()]
            count = np.fromiter((f[0] for f in found), np.int64, len(found))
            score = np.fromiter((f[1] for f in found), np.float64, len(found))[words.codes]
            yield pa.record_batch({
                "doc_id": t.column("doc_id").combine_chunks(), "n_pretokens": pa.array(words.end - words.begin),
                "n_tokens": pa.array(words.sums(count)),
                "log_p": pa.array([float(score[i:j].sum()) for i, j in zip(words.begin.tolist(), words.end.tolist())])})

    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, log_p double")
