"""Helpers of the text operators: Arrow text buffers, word names, chunks, dealing by bucket, checkpoints.

Text reaches the Python workers as Arrow buffers: the UTF-8 bytes of a whole batch and the offsets
of its rows. All work on them is vectorised; no Python string is made per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WHITE_BYTES = np.array([9, 10, 11, 12, 13, 32])
CHUNK = 1 << 20
SLICE_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where none is configured and Spark runs inside one machine is a folder made here.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and context.master.startswith("local") and "cluster" not in context.master:
        folder = tempfile.mkdtemp(prefix="entitlekit-")
        context.setCheckpointDir(folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder: lineage is cut, executors may be lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches for Python workers end at ``SLICE_BYTES``, as the slices that are worked on do.

    Spark's own bound is 64 MB, and the JVM and the worker hold one or two batches each for every task. A bound
    that the session was given stays. Only the choice of cuts in packing depends on where batches end.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- Arrow text ---------------------------------------------------------------------------------


def text_buffer(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null row is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``most`` bytes or are one row."""
    _, offsets = text_buffer(batch, name)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def binaries(parts: list) -> pa.Array:
    return pa.array(parts, pa.binary())


def pieces(offsets: np.ndarray, step: int, overlap: int) -> Iterator[tuple]:
    """Cut rows of units into chunks of about ``step`` units.

    Yields (first unit, end unit, piece starts, piece ends, piece rows, piece places). A row over
    ``step`` is cut at multiples of ``step`` from its own start, with ``overlap`` units of the next
    piece, so that where a row is cut never depends on its neighbours.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        start, size = int(offsets[i]), int(offsets[i + 1] - offsets[i])
        if size > step:
            for place in range(0, size, step):
                lo, hi = start + place, min(start + size, start + place + step + overlap)
                yield lo, hi, np.array([lo]), np.array([hi]), np.array([i]), np.array([place])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, start + step, "right")) - 1)
        yield start, int(offsets[j]), offsets[i:j], offsets[i + 1 : j + 1], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


# ---- hashing ------------------------------------------------------------------------------------


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; equal input and salt give equal names everywhere."""
    with np.errstate(over="ignore"):
        x = x ^ U64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            pair = tuple(
                np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64), dtype=U64)])
                for b in (BASE, BASE_INVERSE)
            )
        if size > 1 << 22:
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each span of ``units``; equal spans get equal names, wherever they stand."""
    up, down = powers(len(units) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(units) + 1, U64)
        np.cumsum((units.astype(U64) + U64(1)) * up[: len(units)], dtype=U64, out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def rolling(units: np.ndarray, width: int) -> np.ndarray:
    """A name for each run of ``width`` consecutive units (fewer units: none)."""
    n = len(units) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    starts = np.arange(n)
    return span_hashes(units, starts, starts + width)


def find_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """(word starts, word ends, word offsets of rows): maximal runs of bytes for which ``in_word``."""
    inside = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts - 1] & inside[cuts]]
    at = np.flatnonzero(edge)
    starts_at = at[at < len(data)]
    starts_at = starts_at[inside[starts_at]]
    ends_at = at[at > 0]
    ends_at = ends_at[inside[ends_at - 1]]
    if len(both):  # a row ends in a word and the next one begins with one
        both = np.unique(both)
        starts_at = np.sort(np.concatenate([starts_at, both]))
        ends_at = np.sort(np.concatenate([ends_at, both]))
    return starts_at, ends_at, np.searchsorted(starts_at, offsets)


def name_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word, by its bytes."""
    names = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + CHUNK)))
        hi = int(ends[j - 1])
        names[i:j] = span_hashes(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return names


def white_words(data: np.ndarray, offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row."""
    in_word = np.ones(256, bool)
    in_word[WHITE_BYTES] = False
    return find_words(data, offsets, in_word)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of [start, start + count), one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(total)


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs, ascending."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(lo) - 1]])
    return lo[fresh], hi[last]


def keyed(docs: DataFrame, *, whole: bool = False) -> DataFrame:
    """(doc_id long, tag long, text): ``tag`` tells rows with one id and different texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.crc32(text.cast("binary")).alias("tag"),
        *([F.xxhash64(text).alias("whole")] if whole else []),
        text.alias("text"),
    )

