"""MinHash near-dedup: banding, signature and exact verification, connected components.

1. Each task turns texts into sets of word shingles and takes ``BANDS * ROWS``
   universal-hash minima.  Per document only the set's size and digest, a one-byte
   fingerprint of each minimum and the band hashes are written.
2. Equal sets are one class from here on; the smallest id stands for it.
3. Classes that share a band's hash form a bucket.  A bucket is compared inside a
   task by fingerprints, and only a spanning forest of the pairs whose estimated
   similarity could still reach the threshold leaves it: never all pairs.  The
   forests' components contain every pair that can be a link.
4. Per such component the full shingle sets are gathered and all their
   intersections counted exactly through postings lists; a spanning forest of the
   confirmed links leaves the task.
5. Alternating large-star and small-star steps over the confirmed links give the
   components of documents.

A bucket or component beyond the size of one task is split into blocks, and every
two blocks meet in a task of their own, so groups of any size stay exact and each
task's memory is bounded: it holds two blocks, or many small groups that together
are about one.  With 6 rows and 24 bands, a pair at the threshold 0.85 is
missed with probability (1 - 0.85**6)**24 = 1e-5 by the bands, and a link is
discarded on fingerprints only if the estimate lies 4.5 standard deviations low.

Defined results: null text is empty; an empty set (no words) links with nothing.
Rows with equal ids are one document for linking; a row with a null id links only
through an equal set whose id is known, else its ``component_id`` is null and it is
kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import free_name, importable, worker_tables, written
from viewlens.llm.components import components
from viewlens.llm.shingles import Shingler

SHINGLE = 5
THRESHOLD = 85  # per cent
BANDS, ROWS = 24, 6
SEED = 20240229
# Rows of a bucket, and shingles of a candidate component, per block of one task.
BUCKET_ROWS = 2000
BLOCK_SHINGLES = 2_000_000


class MinHash:
    """Minima of the universal hashes ``a * x + b`` (mod 2**64, high half) over a set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(SEED)
        n = bands * rows
        self.a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, np.uint64)
        self.bands, self.rows = bands, rows

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for k in range(0, len(shingles), 512):  # blocks that stay in the cache
            x = shingles[k:k + 512]
            h = np.multiply.outer(self.a, x)
            h += self.b[:, None]
            h >>= np.uint64(32)
            np.minimum(least, h.min(axis=1).astype(np.uint32), out=least)
        return least

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(self.bands, self.rows)
        return np.array([xxhash.xxh64_intdigest(p.tobytes(), seed=i) for i, p in enumerate(parts)],
                        np.uint64).view(np.int64)


def _tools() -> tuple[Shingler, MinHash]:
    return Shingler(SHINGLE), MinHash()


def tools() -> tuple[Shingler, MinHash]:
    return worker_tables(_tools)


def least_agreement(n: int, threshold: int) -> int:
    """Fingerprints of ``n`` that a link has in common but for 4.5 standard deviations."""
    t = threshold / 100
    return max(1, math.floor(n * t - 4.5 * math.sqrt(n * t * (1 - t))))


class Forest:
    """Trees over 0..n-1 and the edges that joined them."""

    def __init__(self, n: int):
        self.tree = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, x: int, others: np.ndarray) -> None:
        """Joins x's tree with those of all ``others``, by one edge each."""
        trees, first = np.unique(self.tree[others], return_index=True)
        for t, k in zip(trees.tolist(), first.tolist()):
            if t != self.tree[x]:
                self.edges.append((x, int(others[k])))
                self.tree[self.tree == t] = self.tree[x]

    def named(self, ids: np.ndarray) -> tuple[list, list]:
        return [ids[e[0]] for e in self.edges], [ids[e[1]] for e in self.edges]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: ``doc_id``, ``n`` (set size), ``digest``, ``prints`` and ``bands``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, minhash = tools()
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                s = shingler.set_of(text)
                if len(s):
                    m = minhash.minima(s)
                    out.append((doc, len(s), xxhash.xxh128_digest(s.tobytes()),
                                m.astype(np.uint8).tobytes(), minhash.band_hashes(m)))
                else:
                    out.append((doc, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "digest", "prints", "bands"], dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n long, digest binary, prints binary, bands array<long>")


def _block_pairs(rows: DataFrame, key: list[str], spread: str, bundles: int) -> DataFrame:
    """Deals the rows of each key over ``blocks`` blocks and copies them so that all blocks meet.

    A group with one block is one task's work.  With more, block i goes to the
    tasks (0, i) .. (i, i) .. (i, last), so any two rows are together in one task.
    ``task`` names the place of the comparison.  Tasks of one-block groups share
    ``bundles`` bundles; any other task, as large as two blocks, is a bundle of its own.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (rows.withColumn("mine", F.pmod(F.xxhash64(spread), F.col("blocks"))).withColumn("other", other)
            .withColumn("task", F.xxhash64(*key, F.least("mine", "other"), F.greatest("mine", "other")))
            .withColumn("bundle", F.when(F.col("blocks") > 1, F.col("task"))
                        .otherwise(F.pmod(F.col("task"), F.lit(bundles))))
            .drop("mine", "other", "blocks", *key))


def _in_bundles(rows: DataFrame, kind: str, edges_of) -> DataFrame:
    """The edges that ``edges_of`` finds among the rows of each task, a bundle of tasks at a time."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        group = group.sort_values("task", kind="stable")
        ends = np.flatnonzero(np.diff(group["task"].to_numpy(), append=0, prepend=0)[1:]) + 1
        start = 0
        for end in [*ends.tolist(), len(group)]:
            if end - start > 1:
                x, y = edges_of(group.iloc[start:end])
                a += x
                b += y
            start = end
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return rows.groupBy("bundle").applyInPandas(run, f"a {kind}, b {kind}").distinct()


def alike_rows(prints: np.ndarray, ids: np.ndarray, least: int) -> tuple[list, list]:
    """A spanning forest of the pairs with at least ``least`` fingerprints in common."""
    forest = Forest(len(ids))
    for i in range(len(ids) - 1):
        same = (prints[i + 1:] == prints[i]).sum(axis=1, dtype=np.int32)
        forest.link(i, np.flatnonzero(same >= least) + i + 1)
    return forest.named(ids)


def candidate_edges(classes: DataFrame, threshold: int) -> DataFrame:
    """Edges ``(a, b)`` between class ids whose components hold every possible link."""
    entries = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    sizes = (entries.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
             .select("band", "hash", F.ceil(F.col("m") / BUCKET_ROWS).alias("blocks")))
    members = written(entries.join(sizes, ["band", "hash"]), "buckets")
    bundles = 1 + members.where("blocks = 1").count() // BUCKET_ROWS
    # classes that share no bucket are out by now; only the others' fingerprints are sent
    rows = _block_pairs(members, ["band", "hash"], "rep", bundles).join(classes.select("rep", "prints"), "rep")

    def edges_of(group: pd.DataFrame) -> tuple[list, list]:
        prints = np.frombuffer(b"".join(group["prints"]), np.uint8).reshape(len(group), -1)
        return alike_rows(prints, group["rep"].to_numpy(), least_agreement(prints.shape[1], threshold))

    return _in_bundles(rows, classes.schema["rep"].dataType.simpleString(), edges_of)


def linked_sets(sets: list[np.ndarray], ids: np.ndarray, threshold: int) -> tuple[list, list]:
    """A spanning forest of the pairs with 100 * intersection >= threshold * union, counted exactly."""
    size = np.array([len(s) for s in sets])
    # postings: for each distinct shingle the rows that have it, one list after another
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.repeat(np.arange(len(ids)), size)[np.argsort(shingle, kind="stable")]
    length = np.bincount(shingle)
    start = np.cumsum(length) - length
    at = np.cumsum(size) - size
    forest = Forest(len(ids))
    for i in range(len(ids) - 1):
        mine = shingle[at[i]:at[i] + size[i]]
        n = length[mine]
        where = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(postings[where], minlength=len(ids))
        links = np.flatnonzero(100 * common >= threshold * (size[i] + size - common))
        forest.link(i, links[links > i])
    return forest.named(ids)


def confirmed_edges(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame, threshold: int) -> DataFrame:
    """A spanning forest of the exact links within each group of ``(rep, digest, n, grp)``."""
    total = groups.groupBy("grp").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("m"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("m") / BUCKET_ROWS))
    named = written(groups.join(total.select("grp", blocks.alias("blocks")), "grp"), "blocks")
    bundles = 1 + (named.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES
    # the members grow with the corpus: the same sort-merge plan at every size, no broadcast of small ones
    texts = (docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
             .join(named.select("rep", "digest", "grp", "blocks").hint("merge"), "rep"))
    kind = groups.schema["rep"].dataType.simpleString()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, _ = tools()
        for b in batches:
            found = [shingler.set_of(t).tobytes() for t in b["text"]]
            same = [xxhash.xxh128_digest(s) == d for s, d in zip(found, b["digest"])]
            yield b.drop(columns="text").assign(shingles=found)[same]

    full = texts.mapInPandas(sets, f"rep {kind}, digest binary, grp {kind}, blocks long, shingles binary")
    # rows that repeat an id and its text are one from here on
    full = full.groupBy("rep", "digest").agg(*[F.first(c).alias(c) for c in ("grp", "blocks", "shingles")])

    def edges_of(group: pd.DataFrame) -> tuple[list, list]:
        return linked_sets([np.frombuffer(s, np.uint64) for s in group["shingles"]], group["rep"].to_numpy(), threshold)

    return _in_bundles(_block_pairs(full, ["grp"], "digest", bundles), kind, edges_of)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    importable(docs.sparkSession)
    signed = written(signatures(docs, id_col, text_col), "signatures")
    full = signed.where("n > 0")
    classes = written(full.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prints").alias("prints"),
        F.first("bands").alias("bands")).where("rep IS NOT NULL"), "classes")
    # equal ids with different texts are one document: a node is an id
    loose = written(components(candidate_edges(classes.dropDuplicates(["digest"]), threshold)), "loose")
    groups = written(classes.select("rep", "digest", "n").join(
        loose.select(F.col("node").alias("rep"), F.col("root").alias("grp")), "rep"), "groups")
    links = written(confirmed_edges(docs, id_col, text_col, groups, threshold), "links")
    roots = components(links)
    of_class = classes.select("digest", "rep").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "digest", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate component, same columns."""
    dropped = near_groups(docs, id_col, text_col, threshold).where(~F.col("kept")).select("doc_id").distinct()
    other = free_name(docs, "dropped_id")
    dropped = written(dropped.withColumnRenamed("doc_id", other), "dropped")
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col(other), "left_anti")
