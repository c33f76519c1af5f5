"""Profile upserts from a change stream.

Each micro-batch is reduced to the newest change per user and written as its own ``batch_id``
folder of a change log. Rewriting a batch replaces its folder, so a replay changes nothing, and no
batch rewrites the base table. ``current_profiles`` merges base and log; ``compact_profiles``
writes that merge as a new base. ``stream_current`` keeps the newest change of each user as keyed state
and logs only what is newer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.maintenance import replace_profile
from ..operators.ranking import last_write_wins
from ..sizing import shared_dir


def upsert_batch(log_path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = last_write_wins(batch, [key], order)
        newest.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    return write


def stream_upsert_profiles(
    change_stream: DataFrame,
    log_path: str,
    name: str,
    key: str = "user_id",
    order: tuple[str, ...] = ("ts",),
    checkpoint: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the upsert query. The checkpoint defaults to the cluster's shared folder."""
    spark = change_stream.sparkSession
    location = checkpoint or f"{shared_dir(spark)}/streams/{name}"
    return (
        change_stream.writeStream.queryName(name)
        .option("checkpointLocation", location)
        .foreachBatch(upsert_batch(log_path, key, list(order)))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_log(spark: SparkSession, log_path: str, schema: T.StructType | None = None) -> DataFrame:
    """The change log. With the ``schema`` of the changes, a log that no batch has written yet is empty."""
    if schema is None:
        return spark.read.parquet(log_path)
    logged = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
    try:
        return spark.read.schema(logged).parquet(log_path)
    except AnalysisException:
        return spark.createDataFrame([], logged)


# ---- keyed state ---------------------------------------------------------------------------------


ORDER, TIE = "__order_{}", "__tie"


class NewestRow(StatefulProcessor):
    """Keeps the rank of the newest row of each key, and passes a row on whenever it is newer.

    Rows carry their rank as numbers or texts (``ORDER``, then ``TIE``). With ``idle_ms`` a key that gets
    no newer row for that long is forgotten (processing-time timer).
    """

    def __init__(self, rank: T.StructType, names: list[str], idle_ms: int | None):
        self.rank, self.names, self.idle_ms = rank, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.rank)

    def handleInputRows(self, key, rows, timerValues):
        ranks = [f.name for f in self.rank.fields]
        order = lambda rank: tuple((v is not None, v) for v in rank)
        best = max(rows, key=lambda r: order(r[c] for c in ranks))
        rank = tuple(best[c] for c in ranks)
        if self.newest.exists() and order(self.newest.get()) >= order(rank):
            return
        self.newest.update(rank)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield Row(**{n: best[n] for n in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_newest(
    change_stream: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts",), idle_ms: int | None = None
) -> DataFrame:
    """Z2 with state: a stream of each key's newest row, whenever it changes (update mode).

    Late and repeated rows change nothing; ties beyond ``order`` are settled by the rows' content, not by
    when they come. The state of a key is the rank of its newest row, so a key of many rows is one
    small row of state. Needs the RocksDB state store, which this sets for the session.
    """
    spark = change_stream.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    types = dict(change_stream.dtypes)
    # moments are compared as numbers: a time zone must not decide
    number = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")), "date": F.unix_date}
    ranked = change_stream.withColumns({
        **{ORDER.format(i): number.get(types[c], lambda x: x)(F.col(c)) for i, c in enumerate(order)},
        TIE: F.xxhash64(*change_stream.columns),
    })
    rank = T.StructType(ranked.schema.fields[len(change_stream.columns) :])
    processor = NewestRow(rank, change_stream.columns, idle_ms)
    return ranked.groupBy(key).transformWithState(
        processor, change_stream.schema, "Update", "ProcessingTime" if idle_ms is not None else "None"
    )


def stream_current(
    change_stream: DataFrame, log_path: str, name: str, key: str = "user_id", order: tuple[str, ...] = ("ts",),
    checkpoint: str | None = None, idle_ms: int | None = None, **trigger,
) -> StreamingQuery:
    """Write ``stream_newest`` to a change log, a folder for each batch, for ``current_profiles``."""
    newest = stream_newest(change_stream, key, order, idle_ms)
    location = checkpoint or f"{shared_dir(change_stream.sparkSession)}/streams/{name}"
    return (
        newest.writeStream.queryName(name).outputMode("update")
        .option("checkpointLocation", location)
        .foreachBatch(upsert_batch(log_path, key, list(order)))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_profiles(
    base: DataFrame, log: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """Base users with the newest logged profile each."""
    newest = last_write_wins(log, [key], [*order, "batch_id"]).drop("batch_id", *order)
    return replace_profile(base, newest, key)


def compact_profiles(base: DataFrame, log: DataFrame, new_base: str, **options) -> None:
    """Write the merged users as a new base table; then the log can be retired."""
    current_profiles(base, log, **options).write.mode("overwrite").parquet(new_base)


__all__ = [
    "NewestRow", "compact_profiles", "current_profiles", "read_log", "stream_current", "stream_newest",
    "stream_upsert_profiles", "upsert_batch",
]
