"""Keys that hold a large share of one side's rows, and a left join that splits them.

Spark's adaptive execution can split a skewed partition of a left join on its left side
only; a key with very many rows on the right keeps all of them in one task.  Here such
keys are named first, and their right rows are dealt over several salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds at least this share of the rows.
SHARE = 1 / 1024
# Counters of the frequent-items summary; its count error is below 4 / COUNTERS of the rows.
COUNTERS = 16384
# Tasks that a hot key's right rows are dealt over.
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """The keys that hold at least ``share`` of the rows (at most ``1 / share``), with their ``n``.

    A mergeable frequent-items summary, one bounded state for each task, names
    candidates; their rows are then counted exactly, so no key is here by mistake.
    A key that the summary misses only stays unsplit.  NULL is no key.
    """
    rows = df.select(key).where(F.col(key).isNotNull())
    n, found = rows.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(`{key}`, {int(1 / share)}, {COUNTERS})")).first()
    least = max(2, int(n * share))
    candidates = [(r["item"],) for r in found or [] if r["count"] >= least]
    named = df.sparkSession.createDataFrame(candidates, rows.schema)
    return (rows.join(F.broadcast(named), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least))


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, hot_key: str,
                     spread: str, salts: int = SALTS) -> DataFrame:
    """``left.join(right, keys, "left")`` with the right rows of hot keys dealt over ``salts`` tasks by ``spread``.

    ``hot`` has the values of ``hot_key`` (one of ``keys``) that are split, as
    ``hot_keys`` gives them: at most ``1 / share`` rows, which are sent to every task.
    Rows of other keys, and of NULL, take the ordinary join.  A left row of a hot key
    is repeated ``salts`` times where the right has its keys at all, and each copy
    meets its salt's right rows only.
    """
    named = F.broadcast(hot.select(hot_key).distinct())
    rest = left.join(named, hot_key, "left_anti").join(right.join(named, hot_key, "left_anti"), keys, "left")
    split = (right.join(named, hot_key, "left_semi")
             .withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")))
    mine = left.join(named, hot_key, "left_semi")
    there = split.select(*keys).distinct()
    copies = mine.join(there, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = copies.join(split, [*keys, "_salt"]).drop("_salt")
    alone = mine.join(there, keys, "left_anti").select(*[
        F.col(c) if c in mine.columns else F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rest.columns])
    return rest.unionByName(met).unionByName(alone)
