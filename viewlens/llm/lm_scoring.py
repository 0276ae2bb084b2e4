"""Cross-entropy difference between matched target and background n-gram models.

Moore and Lewis, "Intelligent Selection of Language Model Training Data" (2010).
Both models are bigram models of the same form: one vocabulary (the pieces of a
public tokenizer and the start of a document), the same smoothing toward their own
unigrams, and the same documents' tokens to score.  The background counts come from
all documents, the target counts from those marked as target.  A document's score
is the mean over its tokens of the loss under the target model minus the loss under
the background model: the lower, the more it reads like the target.

A document is scored without its own counts (they are taken off both models while
it is scored), so documents that the models were counted on get no bonus.

How it is distributed: tokens are written once, in blocks of ``BLOCK_TOKENS``.
Each block's distinct bigrams are counted inside tasks, and the corpus counts are
the sums over blocks.  The counts grow with the corpus and are never broadcast:
each block gets the counts of its own bigrams by a join and meets them by a
cogroup.  Only unigrams are sent to every task; they are bounded by the vocabulary.

Defined results: null and empty texts have no tokens, and null losses and score;
rows that repeat an id are scored as rows of their own; without any target document
all documents are scored against the smoothed uniform target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.chunks import groups, whole
from viewlens.llm.common import free_name, importable, written
from viewlens.llm.sentencepiece_codec import codec, id_bytes

BLOCK_TOKENS = 4_000_000
# Weight of the unigram model in a bigram's context, and of the uniform in the unigram model.
BIGRAM_PRIOR = 50.0
UNIGRAM_PRIOR = 1000.0


def _bigrams(ids: np.ndarray, start: int) -> np.ndarray:
    """One number per token: context * (start + 1) + token; the first token's context is ``start``."""
    context = np.empty(len(ids), np.int64)
    context[:1] = start
    context[1:] = ids[:-1]
    return context * (start + 1) + ids


def token_blocks(marked: DataFrame, model: str) -> DataFrame:
    """``marked`` (doc_id, text, target) as tokens, with the number of the block that each row is in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = codec(model), 0
        part = TaskContext.get().partitionId() << 32
        for t in groups(batches):
            cut = c.cut(whole(t.column("text")))
            ids, counts = c.ids(cut.vocabulary)
            ends = seen + np.cumsum(cut.sums(counts))
            seen = int(ends[-1])
            small = [bytes(x) for x in cut.of_texts(id_bytes(ids, counts, f"<u{wide}"))]
            yield pa.record_batch({"block": pa.array(part + ends // BLOCK_TOKENS),
                                   "doc_id": t.column("doc_id").combine_chunks(),
                                   "target": t.column("target").combine_chunks(), "ids": pa.array(small, pa.binary())})

    wide = token_width(model)
    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"block long, doc_id {kind}, target boolean, ids binary")


def token_width(model: str) -> int:
    return 2 if codec(model).sp.get_piece_size() < 65536 else 4


def block_counts(tokens: DataFrame, start: int, wide: int) -> DataFrame:
    """``block``, ``bigram``, ``n`` and ``t``: how often among all and among target documents."""
    kind = np.uint16 if wide == 2 else np.uint32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, rows in b.groupby("block", sort=False):
                keys = [_bigrams(np.frombuffer(x, kind).astype(np.int64), start) for x in rows["ids"]]
                marks = np.repeat(rows["target"].to_numpy(bool), [len(k) for k in keys])
                bigram, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
                yield pd.DataFrame({"block": block, "bigram": bigram, "n": n,
                                    "t": np.bincount(at, marks, len(bigram)).astype(np.int64)})

    parts = tokens.mapInPandas(run, "block long, bigram long, n long, t long")
    return parts.groupBy("block", "bigram").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _own(pieces: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each place, how often its piece occurs in all places."""
    _, at = np.unique(pieces, return_inverse=True)
    return np.bincount(at, times)[at]


class Model:
    """Smoothed bigram losses of documents, from corpus counts without the document's own."""

    def __init__(self, unigrams: np.ndarray, contexts: np.ndarray):
        self.unigrams, self.contexts, self.total = unigrams, contexts, unigrams.sum()

    def losses(self, bigram: np.ndarray, corpus: np.ndarray, own: np.ndarray, mine: int) -> np.ndarray:
        """Loss of each distinct bigram of a document, whose own counts are ``own`` (times ``mine``)."""
        size = len(self.unigrams)
        context, token = bigram // size, bigram % size
        unigram = ((self.unigrams[token] - _own(token, own) * mine + UNIGRAM_PRIOR / size)
                   / (self.total - own.sum() * mine + UNIGRAM_PRIOR))
        seen = self.contexts[context] - _own(context, own) * mine
        return -np.log((corpus - own * mine + BIGRAM_PRIOR * unigram) / (seen + BIGRAM_PRIOR))


def scores(docs: DataFrame, target_ids: DataFrame, model: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` of every document.

    ``target_ids`` has the ids of the target documents in its one column.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = free_name(rows, "target_id")
    ids = target_ids.toDF(name).distinct().withColumn("target", F.lit(True))
    # the targets grow with the corpus: the same sort-merge plan at every size, no broadcast of few
    marked = rows.join(ids.hint("merge"), F.col("doc_id") == F.col(name), "left").select(
        "doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    start, wide = codec(model).sp.get_piece_size(), token_width(model)
    tokens = written(token_blocks(marked, model), "tokens")
    counts = written(block_counts(tokens, start, wide), "block-bigrams")
    corpus = written(counts.groupBy("bigram").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "bigrams")

    def by(column) -> np.ndarray:
        """Counts per piece (n and t): at most one row for each piece of the vocabulary."""
        got = np.zeros((2, start + 1))
        for r in corpus.groupBy(column.alias("piece")).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
            got[:, r["piece"]] = r["n"], r["t"]
        return got

    unigrams, contexts = by(F.col("bigram") % (start + 1)), by(F.floor(F.col("bigram") / (start + 1)).cast("int"))
    bounded = docs.sparkSession.sparkContext.broadcast((unigrams, contexts))
    needed = counts.select("block", "bigram").join(corpus, "bigram")
    kind = np.uint16 if wide == 2 else np.uint32

    def score(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        (n1, t1), (n2, t2) = bounded.value
        background, target = Model(n1, n2), Model(t1, t2)
        known = known.sort_values("bigram")
        bigrams, n, t = (known[c].to_numpy() for c in ("bigram", "n", "t"))
        out = []
        for doc, mine, ids in zip(block["doc_id"], block["target"], block["ids"]):
            size = len(ids) // wide
            if not size:
                out.append((doc, 0, None, None, None))
                continue
            own, times = np.unique(_bigrams(np.frombuffer(ids, kind).astype(np.int64), start), return_counts=True)
            at = np.searchsorted(bigrams, own)
            t_loss = float((target.losses(own, t[at], times, int(mine)) * times).sum()) / size
            n_loss = float((background.losses(own, n[at], times, 1) * times).sum()) / size
            out.append((doc, size, t_loss, n_loss, t_loss - n_loss))
        return pd.DataFrame(out, columns=["doc_id", "n_tokens", "target_loss", "background_loss", "score"], dtype=object)

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return tokens.groupBy("block").cogroup(needed.groupBy("block")).applyInPandas(
        score, f"doc_id {id_kind}, n_tokens long, target_loss double, background_loss double, score double")
