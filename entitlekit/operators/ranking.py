"""Top-k, keep-first and newest-first helpers.

``row_number() <= k`` is cut to k rows per key on the map side before the shuffle, so a key that
holds a large share of all rows still sends only k rows per task to its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """T4: the first ``k`` rows of each group, with their ``rank``."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """A3: the first row of each key."""
    return top_k(df, key, order, 1).drop("rank")


def last_write_wins(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; ``order`` must be total within a key."""
    return keep_first(changes, key, [F.col(c).desc() for c in order])


def first_match(pairs: DataFrame, group: str, pos: str) -> DataFrame:
    """Earliest catalog row per group, combined before the shuffle."""
    return pairs.groupBy(group).agg(F.min(pos).alias(pos))


def bounded_lists(
    df: DataFrame, group: list[str], order: list[Column | str], item: Column, k: int, name: str
) -> DataFrame:
    """The first ``k`` items of each group as an ordered array (cut before it is collected)."""
    ranked = top_k(df, group, order, k).select(*group, "rank", item.alias("__item"))
    lists = ranked.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("rank", "__item"))).alias("__list")
    )
    return lists.select(*group, F.transform("__list", lambda s: s["__item"]).alias(name))
