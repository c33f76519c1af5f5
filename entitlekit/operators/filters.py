"""Small fixed-size summaries of a table, used inside other tables' rows as scalar subqueries.

Each is one row of ``WORDS`` longs whatever the size of the table, so it travels to every task; Spark
computes it in the job that uses it, with no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 15  # longs of a summary: 256 kB


def key_filter(index: DataFrame, key: str) -> DataFrame:
    """One row, one column: ``WORDS`` longs whose bits are set at the keys (hashes) of ``index``.

    The fuller it is, the more keys pass that aren't in the index; it never stops one that is.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    return _row(index.select(_word(F.shiftright(key, 6)).alias("word"), bit.alias("value")), F.bit_or)


def count_sketch(rows: DataFrame, key: str) -> DataFrame:
    """One row, one column: how often keys (hashes) occur, added up over keys that share a place."""
    return _row(rows.select(_word(F.col(key)).alias("word"), F.lit(1).cast("long").alias("value")), F.sum)


def count_in(sketch: Column, key: Column) -> Column:
    """An upper bound of how often ``key`` occurred."""
    return F.get(sketch, _word(key).cast("int"))


def _word(key: Column) -> Column:
    return F.pmod(key, F.lit(WORDS))


def _row(used: DataFrame, fold) -> DataFrame:
    empty = used.sparkSession.range(WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
    filled = used.unionByName(empty).groupBy("word").agg(fold("value").alias("value"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("word", "value")))["value"].alias("values"))


def in_filter(bits: Column, key: Column) -> Column:
    word = F.get(bits, _word(F.shiftright(key, 6)).cast("int"))
    return F.getbit(word, key.bitwiseAND(F.lit(63)).cast("int")) == 1
