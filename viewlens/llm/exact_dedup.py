"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. Every row gets the SHA-256 of its normalised text and a row number; both are
   written once, so that later passes see the same numbers after lost executors.
2. A Misra-Gries summary (Spark's ``approx_top_k``: mergeable frequent-items
   counters, one bounded summary per task) names the candidates for frequent
   digests.
3. The candidates are counted exactly.  Those with at least ``support`` of all
   rows are the verified frequent digests; there can be no more than
   ``1 / support`` of them.  Their groups' winners are broadcast, and rows of
   frequent digests are decided on the map side, without a shuffle.
4. All other digests, each of which holds less than ``support`` of the rows (or
   was missed by the summary, which costs time but never a result), take the
   ordinary shuffle by digest.

Defined results: null text counts as empty; of equal texts the smallest id
stays, null ids come last; rows that repeat id and text are copies too, one of
them stays; ``keep_id`` is null only if all ids of the group are null.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewlens.llm.common import free_name, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"

# A digest is frequent if it holds at least this share of all rows.
SUPPORT = 1 / 4096
# Counters of the summary; its count error is below 4 / COUNTERS of all rows.
COUNTERS = 65536


def text_digest(text: str | Column) -> Column:
    """Lowercase hex SHA-256 of the text, runs of white space as one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "), 256)


def frequent_groups(rows: DataFrame, digest: str, id_col: str, row_col: str,
                    support: float = SUPPORT) -> DataFrame:
    """Exact size and winner of every verified frequent digest (at most 1/support rows)."""
    n, found = rows.agg(F.count(F.lit(1)), F.expr(
        f"approx_top_k(`{digest}`, {int(1 / support)}, {COUNTERS})")).first()
    least = max(2, int(n * support))
    # at most 1/support strings
    candidates = [r["item"] for r in found or [] if r["count"] >= least]
    spark = rows.sparkSession
    named = spark.createDataFrame([(c,) for c in candidates], f"`{digest}` string")
    # the smallest id, null ids last, then the first row
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                           F.col(row_col).alias("row")))
    return (rows.join(F.broadcast(named), digest, "left_semi").groupBy(digest)
            .agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
            .where(F.col("n") >= least)
            .select(digest, F.col("n").alias("__n"), F.col("first.id").alias("__id"),
                    F.col("first.row").alias("__row")))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple[str, ...] | None = None, support: float = SUPPORT) -> DataFrame:
    """The columns ``carry`` (default: all) of every row, and what is known of its copies.

    Adds ``keep_id``, ``group_size`` (long), ``kept`` and ``text_sha256``; where
    ``docs`` already has such a column, the added one gets a leading underscore.
    """
    carried = list(docs.columns if carry is None else carry)
    base = docs.select(*carried) if carried else docs.select()
    names = {w: free_name(base, w) for w in ("keep_id", "group_size", "kept", "text_sha256")}
    d, row, key = names["text_sha256"], free_name(base, "__row_no"), free_name(base, "__key")
    rows = written(docs.select(*[F.col(f"`{c}`") for c in carried], F.col(id_col).alias(key),
                               text_digest(F.col(text_col)).alias(d),
                               F.monotonically_increasing_id().alias(row)), "digests")
    frequent = written(frequent_groups(rows, d, key, row, support), "frequent")
    split = rows.join(F.broadcast(frequent), d, "left")
    out = [F.col(f"`{c}`") for c in carried]
    hot = split.where(F.col("__n").isNotNull()).select(
        *out, F.col("__id").alias(names["keep_id"]), F.col("__n").alias(names["group_size"]),
        (F.col(row) == F.col("__row")).alias(names["kept"]), d)
    whole = Window.partitionBy(d)
    by_id = whole.orderBy(F.col(key).asc_nulls_last(), F.col(row))
    cold = split.where(F.col("__n").isNull()).select(
        *out, F.min(key).over(whole).alias(names["keep_id"]),
        F.count(F.lit(1)).over(whole).alias(names["group_size"]),
        (F.row_number().over(by_id) == 1).alias(names["kept"]), d)
    return hot.unionAll(cold)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """``docs`` without all but one of equal texts, same columns.

    Only ids and digests are written; texts are read again and sent at most once.
    Of a frequent digest only rows with the winner's id pass the map side, and
    the rest is reduced there to one row for each digest and task.
    """
    d, row, key = (free_name(docs, n) for n in ("text_sha256", "__row_no", "__key"))
    digest = text_digest(F.col(text_col)).alias(d)
    rows = written(docs.select(F.col(id_col).alias(key), digest, F.monotonically_increasing_id().alias(row)), "digests")
    frequent = written(frequent_groups(rows, d, key, row, support), "frequent")
    split = docs.select(*[F.col(f"`{c}`") for c in docs.columns], digest).join(
        F.broadcast(frequent), d, "left")
    own_id = F.col(f"`{id_col}`")
    left = split.where(F.col("__n").isNull() | own_id.eqNullSafe(F.col("__id")))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(own_id.isNull(), own_id))
    return left.groupBy(d).agg(first.alias("first")).select(
        *[F.col("first").getField(c).alias(c) for c in docs.columns])
