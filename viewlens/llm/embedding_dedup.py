"""Embedding near-dedup by collision counting over many sorted projections.

Every unit vector gets one entry in each of many tables.  A table has one fine
random projection, by which its entries are sorted, and a few coarse ones, whose
quantised values (the cell) must agree; the coarse ones keep the number of unrelated
vectors within a window about constant as the input grows.  Two vectors collide in
a table if they share the cell and lie within a window centred on either of them.
Collisions are counted per pair over all tables, pairs that reach a count are
verified exactly, and alternating star steps join the verified links.

The count is calibrated for recall: pairs at exactly the wanted similarity are made
from a bounded sample of the vectors, and the highest count that still finds
``RECALL`` of them is taken.  The number of coarse projections grows with the
logarithm of the number of vectors, the number of tables so that the expected
collisions of such a pair stay the same: work grows as the input to the power 1.3,
not 2.

Equal vectors are one class, so copies cost nothing; windows stream through sorted
partitions, so no group is held in memory.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, not even with their copies; vectors of different
lengths never link; rows are vectors of their own also if ids repeat (their links
count each other, their component is that of the id); a null id never names a
component: ``component_id`` is the least known id, else null, and such a row is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import hash_sample, importable, written
from viewlens.llm.components import components

SIMILARITY = 0.9
RECALL = 0.97
# Vectors from which the calibration pairs are made.
SAMPLE = 256
SEED = 7
# Width of a coarse cell.  Unit vectors' projections have a spread of 1.
CELL = 2.0
# Share of unrelated pairs that agree in one coarse projection, at this width.
UNRELATED = 0.49
# Unrelated vectors that a cell may hold on average.
CROWD = 16
# Mean collisions of a pair at the wanted similarity.
COLLISIONS = 5.5


def shape(n: int, similarity: float) -> tuple[int, int, float]:
    """Tables, coarse projections per table and half window for ``n`` vectors."""
    distance = math.sqrt(2 - 2 * similarity)
    agree = 1 - distance * math.sqrt(2 / math.pi) / CELL  # for the pair, in one coarse projection
    coarse = max(1, math.ceil(math.log(max(n, 2) / CROWD) / math.log(1 / UNRELATED)))
    in_window = math.erf(1 / math.sqrt(2))
    return math.ceil(COLLISIONS / (agree ** coarse * in_window)), coarse, distance


@lru_cache(maxsize=4)
def projections(size: int, tables: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, coarse + 1, size) and the coarse cells' offsets."""
    rng = np.random.default_rng([SEED, size, tables, coarse])
    return rng.standard_normal((tables, coarse + 1, size)), rng.random((tables, coarse)) * CELL


def entries_of(units: np.ndarray, tables: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell hash and fine projection (each: vectors x tables) of unit vectors of one length."""
    directions, offsets = projections(units.shape[1], tables, coarse)
    at = np.einsum("nd,tkd->ntk", units, directions, optimize=True)
    cells = np.floor((at[:, :, :coarse] + offsets) / CELL).astype(np.int64)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64), cells.shape[:2]) + np.uint64(units.shape[1] << 32)
    for k in range(coarse):  # a polynomial hash of the cell's coordinates
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cells[:, :, k].astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return key.view(np.int64), at[:, :, coarse]


def least_count(units: np.ndarray, tables: int, coarse: int, window: float, similarity: float) -> int:
    """The highest count that finds ``RECALL`` of pairs at ``similarity`` to the sample's vectors."""
    rng = np.random.default_rng(SEED)
    noise = rng.standard_normal(units.shape)
    noise -= (noise * units).sum(axis=1, keepdims=True) * units
    noise /= np.linalg.norm(noise, axis=1, keepdims=True) + 1e-300
    partner = similarity * units + math.sqrt(1 - similarity ** 2) * noise
    (cell, at), (cell2, at2) = (entries_of(u, tables, coarse) for u in (units, partner))
    counts = np.sort(((cell == cell2) & (np.abs(at - at2) <= window)).sum(axis=1))
    return max(1, int(counts[int((1 - RECALL) * len(counts))]))


def unit(values) -> np.ndarray | None:
    """The vector in double precision at length 1, or None if it can link with nothing."""
    if values is None:
        return None
    v = np.asarray(values, np.float64)
    most = np.abs(v).max(initial=0.0)
    if not np.isfinite(v).all() or most == 0:
        return None
    v = v / most
    return v / math.sqrt(float((v * v).sum()))


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = [unit(v) for v in b["v"]]
            yield pd.DataFrame({
                "vec_id": b["vec_id"],
                "digest": [None if u is None else xxhash.xxh128_digest(np.asarray(v, np.float64).tobytes())
                           for u, v in zip(units, b["v"])],
                "unit": [None if u is None else u.tobytes() for u in units]}, dtype=object)

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"vec_id {kind}, digest binary, unit binary")


def collisions(classes: DataFrame, tables: int, coarse: int, window: float) -> DataFrame:
    """``(a, b)`` once for every table in which the two classes collide, a < b."""
    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["unit"].str.len().to_numpy()
            for s in np.unique(size):
                for part in np.array_split(np.flatnonzero(size == s), 1 + (size == s).sum() // 1000):
                    if len(part):
                        units = np.frombuffer(b"".join(b["unit"].iloc[part]), np.float64).reshape(len(part), -1)
                        cell, at = entries_of(units, tables, coarse)
                        yield pd.DataFrame({"node": np.repeat(b["node"].to_numpy()[part], tables),
                                            "cell": cell.ravel(), "at": at.ravel()})

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, cell, at = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in batches:
            old = len(node)
            node = np.concatenate([node, b["node"].to_numpy()])
            cell = np.concatenate([cell, b["cell"].to_numpy()])
            at = np.concatenate([at, b["at"].to_numpy()])
            # one ascending number for (cell, projection); projections of unit vectors are far below 500
            line = np.cumsum(np.diff(cell, prepend=cell[:1]) != 0) * 1000.0 + at
            first = np.searchsorted(line, line - window, "left")
            n = np.arange(len(line)) - first
            n[:old] = 0
            ends = np.cumsum(n)
            for start in range(0, int(ends[-1]) if len(ends) else 0, 500_000):  # pairs, a bounded number at a time
                k = np.arange(start, min(start + 500_000, int(ends[-1])))
                right = np.searchsorted(ends, k, "right")
                left = first[right] + k - (ends[right] - n[right])
                x, y = node[left], node[right]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
            keep = first[-1] if len(first) else 0
            node, cell, at = node[keep:], cell[keep:], at[keep:]

    entered = classes.select("node", "unit").mapInPandas(enter, "node long, cell long, at double")
    return entered.repartition("cell").sortWithinPartitions("cell", "at").mapInPandas(sweep, "a long, b long")


def links(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs ``(a, b)`` of the classes ``(node, unit)``."""
    n = classes.count()
    tables, coarse, window = shape(n, similarity)
    sample = hash_sample(classes, "node", SAMPLE).toPandas()["unit"]
    units = [np.frombuffer(u, np.float64) for u in sample]
    longest = [u for u in units if len(u) == max(map(len, units))]
    count = least_count(np.stack(longest), tables, coarse, window, similarity) if longest else 1
    pairs = (collisions(classes, tables, coarse, window).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= count).select("a", "b"))
    one = classes.select(F.col("node").alias("a"), F.col("unit").alias("unit_a"))
    two = classes.select(F.col("node").alias("b"), F.col("unit").alias("unit_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cosine = [float(np.dot(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)))
                      for x, y in zip(b["unit_a"], b["unit_b"])]
            yield b.loc[np.array(cosine, float) >= similarity, ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").mapInPandas(verify, "a long, b long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 similarity: float = SIMILARITY) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    importable(vectors.sparkSession)
    rows = written(_classes(vectors, id_col, vector_col), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = written(links(classes, similarity), "links")
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(
        F.sum("copies").alias("others"))
    # ids name the components; classes that share an id are joined through it
    ids = classes.where("rep IS NOT NULL").select("node", "rep")
    shared = ids.groupBy("rep").agg(F.min("node").alias("b")).join(ids, "rep").select(F.col("node").alias("a"), "b")
    roots = components(found.unionAll(shared.where("a != b")))
    named = written(classes.select("digest", "node", "rep", "copies").join(roots, "node", "left").select(
        "digest", "node", "rep", "copies", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = (named.join(least, "root").join(others, F.col("node") == F.col("a"), "left")
                .select("digest", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
