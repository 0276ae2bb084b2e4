"""Filter interaction audit: what every filter removes in every order, by wide packed counters.

A document's mask tells which filters it fails.  The mask alone decides what happens
to the document at each step of each order of the filters, so every mask is mapped to
big integers of 64-bit fields, one field for each step of each order: 1 where the
document is removed, where it is kept, where it is redundant (fails the filter but was
removed earlier); two more have a field for each filter (fails it alone; removed by
it, over all orders).  Adding up the integers of a part's documents adds up all steps
at once, and the fields of the sum are the counts.  No field can overflow into the
next: it is at most the part's documents times the number of orders, which is tested
against 64 bits before unpacking.

Rows of the same part, mask and flags are counted before the shuffle (there are at
most ``2 ** (filters + flags)`` such rows for each part and task), so a part with most
of the documents is no burden; each such row adds its integer times its count.

A filter for copies (``copies``) fails documents whose text some smaller id has.  The
least id of each text is found by a grouped minimum, and looked up by text and id
together, so a text with very many copies never meets in one task.

Defined results: a null condition is no failure; null text is empty; a null part is
the part ''; a document with a null id is no copy and makes none; rows that repeat
both id and text fail alike; flags of an id count as set if any label sets them;
labels that are null or name no document count for nothing; an empty table gives no
rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import importable, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
FIELD_BYTES = 8
COUNTS = ("removed", "kept", "redundant")


class Outcomes:
    """The big integers of all masks of up to 7 filters, named by letters in the order of the mask's bits."""

    def __init__(self, letters: str):
        if not 0 < len(letters) <= 7 or len(set(letters)) < len(letters):
            raise ValueError("from one to seven filters, each with a letter of its own")
        self.letters = letters
        self.orders = ["".join(p) for p in permutations(letters)]
        self.steps = len(self.orders) * len(letters)
        self.filter_of_step = np.array([letters.index(c) for o in self.orders for c in o])
        self.of_mask = [self._integers(m) for m in range(1 << len(letters))]

    def _integers(self, mask: int) -> dict[str, int]:
        k = len(self.letters)
        fails = (mask >> self.filter_of_step & 1).astype(bool).reshape(-1, k)
        before = np.cumsum(fails, axis=1) - fails  # filters failed at earlier steps
        removed, kept = fails & (before == 0), ~fails & (before == 0)
        redundant = fails & (before > 0)
        by_filter = np.bincount(self.filter_of_step, removed.ravel(), k)
        alone = [mask == 1 << f for f in range(k)]
        return {"removed": packed(removed), "kept": packed(kept), "redundant": packed(redundant),
                "unique_fails": packed(alone), "shapley": packed(by_filter)}

    def unpack(self, total: int, fields: int) -> np.ndarray:
        return np.frombuffer(total.to_bytes(fields * FIELD_BYTES, "little"), "<u8").astype(np.int64)

    def rows(self, part: str, classes: pd.DataFrame, flags: list[str]) -> pd.DataFrame:
        """All steps of all orders, from the part's counts ``n`` by ``mask`` and flags."""
        if int(classes["n"].sum()) * len(self.orders) >= 1 << 63:
            raise OverflowError(f"part {part!r} has too many documents for {8 * FIELD_BYTES}-bit fields")
        names = [*COUNTS, "unique_fails", "shapley"]
        total = dict.fromkeys([*names, *flags], 0)
        for row in classes.to_dict("records"):
            mine, n = self.of_mask[row["mask"]], int(row["n"])
            for name in names:
                total[name] += n * mine[name]
            for f in flags:
                if row[f]:
                    total[f] += n * mine["removed"]
        k = len(self.letters)
        out = {"part": part, "filter_order": np.repeat(self.orders, k),
               "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(self.orders))}
        for name in COUNTS:
            out[name] = self.unpack(total[name], self.steps)
        for name in ("unique_fails", "shapley"):
            out[name] = self.unpack(total[name], k)[self.filter_of_step]
        for f in flags:
            out[f"{f}_lost"] = self.unpack(total[f], self.steps)
        return pd.DataFrame(out)


def packed(fields) -> int:
    """A big integer of one field for each number, the first in the lowest bits."""
    return int.from_bytes(np.asarray(fields).ravel().astype("<u8").tobytes(), "little")


def audit(classes: DataFrame, letters: str, flags: list[str]) -> DataFrame:
    """One row per part, order and step, from ``part``, ``mask``, flags (0 or 1) and their count ``n``."""
    outcomes = Outcomes(letters)
    lost = "".join(f", {f}_lost long" for f in flags)
    schema = ("part string, filter_order string, step int, removed long, kept long, redundant long, "
              f"unique_fails long, shapley long{lost}")
    # at most 2 ** (filters + flags) rows for each part
    return classes.groupBy("part").applyInPandas(lambda g: outcomes.rows(g["part"].iloc[0], g, flags), schema)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D: few words, few distinct words, many capitals, marks of markup or code.

    ``text`` must not be null.
    """
    words = F.array_remove(F.split(text, WHITE_SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals > 3 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def classes(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], filters=text_filters, copies: str | None = "E",
            id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, str]:
    """Counts ``n`` by ``part``, ``mask`` and flags, and the letters of the mask's bits.

    ``filters`` makes named failure conditions of a text column, ``copies`` names the
    filter of copies (null: none), ``flags`` are named conditions on rows of ``labels``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tests = filters(F.col("text"))
    bits = [F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests.values())]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    # the texts are read once; what is left of each is its mask and digest
    rows = written(rows.select("id", "part", sum(bits, F.lit(0)).alias("mask"),
                               F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(*[F.max(F.when(c, 1).otherwise(0)).alias(f) for f, c in flags.items()]))
    # rows that repeat in all are one from here on; the tables grow alike: the same join plan at every size
    found = rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(marks.hint("merge"), "id", "left")
    letters = "".join(tests)
    if copies:
        least = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("least", F.lit(1))
        found = found.join(least.hint("merge"), ["digest", "id"], "left")
        bit = 1 << len(letters)
        letters += copies
        found = found.withColumn("mask", F.col("mask") + F.when(F.col("id").isNotNull() & F.col("least").isNull(), bit)
                                 .otherwise(0))
    by = ["part", "mask", *flags]
    found = found.select("part", "mask", "n", *[F.coalesce(f, F.lit(0)).alias(f) for f in flags])
    return found.groupBy(*by).agg(F.sum("n").alias("n")), letters


def interactions(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], **of_docs) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of each step (see ``classes`` for the parameters)."""
    importable(docs.sparkSession)
    found, letters = classes(docs, labels, flags, **of_docs)
    return audit(found, letters, list(flags))
