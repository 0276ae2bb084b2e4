"""Joins of the impression audit (all equi-joins on named keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a key filter: 64 to a row, so 262,144 rows at most are sent to every task.
FILTER_BITS = 1 << 24


def attach_notify(df: DataFrame, notify: DataFrame, key: str = "transaction_nbr") -> DataFrame:
    return df.join(notify, key, "left")


def without(df: DataFrame, blacklist: DataFrame, key: str = "transaction_nbr") -> DataFrame:
    """Rows of ``df`` whose key is not in ``blacklist`` (an anti join).

    NULL keys in ``df`` are kept, as with the left-join-and-``is null`` form.
    """
    keys = blacklist.select(key).where(F.col(key).isNotNull())
    return df.join(keys, key, "left_anti")


def _word_and_bits(key: Column, bits: int) -> tuple[Column, Column]:
    """The filter's row for a key, and the two of its 64 bits that the key sets."""
    words = F.lit(bits // 64).cast("bigint")
    h = F.xxhash64(key)
    bit = lambda shift: F.shiftrightunsigned(F.xxhash64(key, F.lit(shift)), 58).cast("int")
    one = F.lit(1).cast("bigint")
    mask = F.call_function("shiftleft", one, bit(1)).bitwiseOR(F.call_function("shiftleft", one, bit(2)))
    return F.pmod(h, words), mask


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of ``key`` as rows ``_word``, ``_bits``: no more than ``bits / 64`` of them.

    Built by one grouped aggregate, combined on the map side.
    """
    word, mask = _word_and_bits(F.col(key), bits)
    return (keys.where(F.col(key).isNotNull()).select(word.alias("_word"), mask.alias("_mask"))
            .groupBy("_word").agg(F.bit_or("_mask").alias("_bits")))


def without_few(df: DataFrame, blacklist: DataFrame, key: str = "transaction_nbr",
                bits: int = FILTER_BITS) -> DataFrame:
    """``without`` for a blacklist that few rows are on: the others are not shuffled.

    A Bloom filter of the blacklist is sent to every task (its size is fixed by
    ``bits``).  Rows whose key is surely not in it, and rows without a key, are kept
    where they are; only the rest, rows of the blacklist and a few false positives,
    goes through the exact anti join.  With many more than ``bits / 8`` keys the filter
    lets most rows through to that join, and results are the same.
    ``df`` is read twice: give a stored frame.
    """
    taken = {c.lower() for c in df.columns}
    mine = next(n for n in (f"_word{k or ''}" for k in range(len(taken) + 1)) if n not in taken)
    held = next(n for n in (f"_bits{k or ''}" for k in range(len(taken) + 1)) if n not in taken)
    word, mask = _word_and_bits(F.col(key), bits)
    sent = F.broadcast(key_filter(blacklist, key, bits).toDF(mine, held))
    probed = df.withColumn(mine, word).join(sent, mine, "left")
    # a key that is there has set both its bits
    found = F.coalesce(F.col(held).bitwiseAND(mask) == mask, F.lit(False))
    pick = lambda rows: rows.select(*[F.col(f"`{c}`") for c in df.columns])
    return pick(probed.where(~found)).unionByName(without(pick(probed.where(found)), blacklist.select(key).distinct(), key))
