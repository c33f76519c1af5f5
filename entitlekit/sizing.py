"""Join strategy helpers: measured broadcasts, salted shuffles, shared checkpoint folder."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 128 * 1024 * 1024
SALTS, MAX_SALTS = 16, 256
SALT = "__salt"
AUTO, BROADCAST, SHUFFLE = "auto", "broadcast", "shuffle"


def measure(df: DataFrame) -> int:
    """Bytes of all values of ``df``: one distributed sum, one number back.

    The number is kept on the DataFrame object, whose plan cannot change.
    """
    known = getattr(df, "_measured_bytes", None)
    if known is None:
        known = df.agg(_bytes()).first()["bytes"]
        df._measured_bytes = known
    return known


def strategy_for(strategy: str, *catalogs: DataFrame, growth: int = 1) -> str:
    """Resolve ``auto``: broadcast if the measured catalogs, times ``growth``, are within bounds.

    ``growth`` bounds how much larger the tables derived from the catalogs are.
    """
    if strategy != AUTO:
        return strategy
    unknown = [c for c in catalogs if getattr(c, "_measured_bytes", None) is None]
    if len(unknown) > 1:  # one job for all of them
        sums = [c.agg(F.lit(i).alias("i"), _bytes()) for i, c in enumerate(unknown)]
        for i, size in reduce(DataFrame.unionAll, sums).collect():
            unknown[i]._measured_bytes = size
    size = sum(measure(c) for c in catalogs)
    return BROADCAST if size * growth <= BROADCAST_BYTES else SHUFFLE


def _bytes() -> Column:
    row_bytes = F.octet_length(F.to_json(F.struct("*")))
    return F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")


def salts_for(df: DataFrame) -> int:
    """Sub-keys per key: a quarter of the shuffle partitions, between 16 and 256."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(SALTS, min(MAX_SALTS, partitions // 4))


def with_salt(df: DataFrame, spread: list[str], salts: int | None = None) -> DataFrame:
    """Spread rows of one join key over sub-keys, by a repeatable hash of ``spread``."""
    salts = salts or salts_for(df)
    return df.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)))


def for_every_salt(df: DataFrame, salts: int | None = None) -> DataFrame:
    """Replicate the small side once per sub-key."""
    last = (salts or salts_for(df)) - 1
    return df.withColumn(SALT, F.explode(F.expr(f"sequence(0L, {last}L)")))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    strategy: str = AUTO,
    salts: int | None = None,
) -> DataFrame:
    """Equi-join many ``rows`` to a smaller ``table``.

    A table within the measured bound is broadcast, so ``rows`` never move. A larger one is
    shuffled, with ``rows`` salted on ``spread`` so that a hot key is split over tasks;
    ``salts=1`` when the keys of ``rows`` are known to be distinct.
    """
    if strategy_for(strategy, table) == BROADCAST:
        return rows.join(F.broadcast(table), on, how)
    if salts == 1:
        return rows.join(table, on, how)
    salted = with_salt(rows, spread or rows.columns, salts)
    return salted.join(for_every_salt(table, salts), [*on, SALT], how).drop(SALT)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only where none is set and Spark runs inside one machine is a folder made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and master.startswith("local") and "cluster" not in master:
        folder = tempfile.mkdtemp(prefix="entitlekit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder: computed once, lineage cut, executors may be lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
