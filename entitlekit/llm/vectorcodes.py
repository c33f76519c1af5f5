"""Operator 11: vectors as codes of a product quantiser, exactly in integers.

Each component becomes ``floor(scale * x)``; a vector is cut into equal consecutive parts, and each
part gets the index of the nearest entry of its position's codebook. The nearest entry is found in the
Walsh-Hadamard domain: parts and entries are padded with zeros to a power of two ``m`` and transformed
by integer butterflies, which multiplies every squared distance by exactly ``m``. Squared differences
are added up in sequency order (slow changes first); a partial sum is a lower bound, so an entry whose
partial sum is over the best full distance is dropped before the rest of it is looked at. No step uses
floating point; batches whose numbers could leave 64 bits are computed with unbounded integers.

A round of training is one pass over the vectors. A task returns at most one sum for each component of
each entry, as 32-bit digits, so that sums of any size are added up exactly by Spark; the driver holds
the codebooks (``entries`` vectors), never vectors of the table beyond the first ``entries``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STEP = 4  # coefficients between two eliminations
ROWS = 1024  # vectors worked on at once
LIMB = 32  # bits of a digit of the sums
LONG_MAX = 2**63 - 1
LABELS_BROADCAST = 1 << 16  # rows of (label, error sum) that are broadcast


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` is an integer array (entries, width); ``size`` the components of a vector."""

    entries: tuple[np.ndarray, ...]
    size: int

    @property
    def width(self) -> int:
        return self.size // len(self.entries)

    def digest(self) -> str:
        """SHA-256 of all components as decimal integers, by part, entry and position."""
        text = ",".join(str(int(x)) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(text.encode()).hexdigest()


# ---- transform and search -----------------------------------------------------------------------


def sequency_order(m: int) -> np.ndarray:
    """The natural index of the Walsh function with 0, 1, 2, ... sign changes (``m``: a power of two)."""
    bits = m.bit_length() - 1
    gray = np.arange(m) ^ (np.arange(m) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(m, np.int64))


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of rows padded with zeros, in sequency order."""
    n, width = x.shape
    m = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, m), x.dtype)
    out[:, :width] = x
    half = 1
    while half < m:
        pairs = out.reshape(n, m // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, m)
        half *= 2
    return out[:, sequency_order(m)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, scaled squared distance) of each transformed row's nearest transformed entry.

    Of entries at one distance the lowest index wins.
    """
    m = x.shape[1]
    head = min(STEP, m)
    part = sum(((x[:, j, None] - book[None, :, j]) ** 2 for j in range(head)), np.zeros((len(x), len(book)), x.dtype))
    first = part.argmin(axis=1)
    bound = ((x - book[first]) ** 2).sum(axis=1)
    rows, entries = np.nonzero(part <= bound[:, None])  # by row, then entry; each row keeps ``first`` at least
    part = part[rows, entries]
    for lo in range(head, m, STEP):
        hi = min(m, lo + STEP)
        part = part + ((x[rows, lo:hi] - book[entries, lo:hi]) ** 2).sum(axis=1)
        keep = part <= bound[rows]
        rows, entries, part = rows[keep], entries[keep], part[keep]
    starts = np.searchsorted(rows, np.arange(len(x)))
    best = np.minimum.reduceat(part, starts)
    hits = np.flatnonzero(part == best[rows])
    return entries[hits[np.searchsorted(rows[hits], np.arange(len(x)))]], best


def fits_long(x: np.ndarray, book: np.ndarray) -> bool:
    """Whether all of ``nearest`` stays within 64 bits."""
    if x.dtype == object or book.dtype == object:
        return False
    width = max(1, x.shape[1])
    most = max(abs(int(v)) for a in (x, book) if a.size for v in (a.min(), a.max())) if x.size or book.size else 0
    m = 1 << (width - 1).bit_length()
    return m * (2 * m * most) ** 2 <= LONG_MAX


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part (rows of integers)."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    kind = np.int64 if fits_long(x, book) else object
    a, b = walsh(x.astype(kind)), walsh(book.astype(kind))
    index, far = nearest(a, b)
    return index, far // a.shape[1]


# ---- vectors ------------------------------------------------------------------------------------


def floors(flat: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles; numbers beyond 62 bits as unbounded integers."""
    if not len(flat) or np.abs(flat).max() < 2.0**62 / scale:
        return np.floor(flat * scale).astype(np.int64)  # scale is a power of two: the product is exact
    ratios = (float(v).as_integer_ratio() for v in flat)
    return np.array([n * scale // d for n, d in ratios], object)


def whole(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has neither null nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def matrices(batch: pa.RecordBatch, size: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer rows of ``size`` components) of the batch's first column; short vectors end in zeros."""
    column = batch.column(0)
    for first in range(0, batch.num_rows, ROWS):
        part = column.slice(first, ROWS)
        lengths = part.value_lengths().to_numpy(zero_copy_only=False)
        values = floors(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
        out = np.zeros((len(part), size), values.dtype)
        out[np.arange(size)[None, :] < lengths[:, None]] = values
        yield first, out


def parts_of(x: np.ndarray, books: Codebooks) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(len(books.entries)):
        yield k, x[:, k * books.width : (k + 1) * books.width]


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int) -> Iterator[pa.RecordBatch]:
    """The sums and counts of all parts of this task by part and entry, as digits; the place -1 has the count."""
    n, width = len(books.entries[0]), books.width
    sums = np.zeros((len(books.entries), n, width + 1), np.int64)
    for batch in batches:
        for _, x in matrices(batch, books.size, scale):
            for k, part in parts_of(x, books):
                index, _ = assign(part, books.entries[k])
                if sums.dtype != object and (part.dtype == object or part.size and max(-int(part.min()), int(part.max())) > 2**40 or np.abs(sums).max(initial=0) > 2**62):
                    sums = sums.astype(object)
                np.add.at(sums[k], index, np.concatenate([part, np.ones((len(part), 1), part.dtype)], 1).astype(sums.dtype))
    used = np.argwhere(np.repeat(sums[:, :, -1:] > 0, width + 1, 2))
    values = sums[tuple(used.T)]
    place = np.where(used[:, 2] == width, -1, used[:, 2])
    limb = 0
    while len(values):
        sign = np.where(values < 0, -1, 1)
        rest = values * sign
        digit = (rest & ((1 << LIMB) - 1)) * sign
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(place, pa.int32()),
             pa.array(np.full(len(values), limb), pa.int32()), pa.array(digit.astype(np.int64), pa.int64())],
            names=["part", "entry", "place", "limb", "digit"],
        )
        values = (rest >> LIMB) * sign
        more = values != 0
        used, place, values, limb = used[more], place[more], values[more], limb + 1


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each row's other columns, its code (a byte for each part) and its squared distance to the code's entries."""
    for batch in batches:
        for first, x in matrices(batch, books.size, scale):
            code, error = np.zeros((len(x), len(books.entries)), np.uint8), np.zeros(len(x), object)
            for k, part in parts_of(x, books):
                code[:, k], far = assign(part, books.entries[k])
                error = error + far.astype(object)
            rest = batch.slice(first, len(x)).columns[1:]
            error = [min(int(e), LONG_MAX) for e in error]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())], names=schema)


# ---- operator -----------------------------------------------------------------------------------


def train_codebooks(
    vectors: DataFrame, id: str = "vec_id", column: str = "embedding",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds, from the vectors of the smallest ids; None without a vector.

    A round assigns every part to its nearest entry and moves each entry to its parts' componentwise
    floor of the mean; unused entries stay. Vectors with null or non-finite components (or null)
    take no part; vectors shorter than the longest, or than a multiple of ``parts``, end in zeros;
    empty vectors are all zero. Rows of one id start in the order of their vectors, rows without an id
    come last; repeated rows count as often as they stand. Needs ``scale`` to be a power of two.
    """
    if entries > 256 or scale & (scale - 1):
        raise ValueError("a code byte names 256 entries, and the scale must be a power of two")
    rows = whole(vectors.select(F.col(id).alias("id"), F.col(column).cast("array<double>").alias("v")), "v")
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return None
    size = -(-longest // parts) * parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    start = [x for batch in first.select(["v"]).to_batches() for _, x in matrices(batch, size, scale)]
    start = np.concatenate(start)
    books = Codebooks(tuple(np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)), size)
    for _ in range(rounds):
        books = _moved(rows.select("v"), books, scale)
    return books


def _moved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    found = rows.mapInArrow(partial(_sums, books=books, scale=scale), "part int, entry int, place int, limb int, digit long")
    found = found.groupBy("part", "entry", "place", "limb").agg(F.sum("digit").alias("digit")).toArrow()
    sums: dict[tuple, int] = {}
    for part, entry, place, limb, digit in zip(*(found[c].to_pylist() for c in ("part", "entry", "place", "limb", "digit"))):
        sums[part, entry, place] = sums.get((part, entry, place), 0) + (digit << (LIMB * limb))
    moved = []
    for k, book in enumerate(books.entries):
        new = book.astype(object)
        for e in range(len(book)):
            if count := sums.get((k, e, -1), 0):
                new[e] = [sums.get((k, e, j), 0) // count for j in range(books.width)]
        small = not new.size or max(abs(int(v)) for v in (new.min(), new.max())) < 2**62
        moved.append(new.astype(np.int64) if small else new)
    return Codebooks(tuple(moved), books.size)


def encode_vectors(vectors: DataFrame, books: Codebooks | None, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with a whole vector: all columns but the vector, ``code`` (binary, one byte for each part) and ``error``.

    ``error`` is the squared distance between the integer vector and its code's entries, at most
    2^63 - 1. Columns of the input named ``code`` or ``error`` are left out. No vectors: no rows.
    """
    rest = [c for c in vectors.columns if c not in (column, "code", "error")]
    rows = whole(vectors.select(F.col(column).cast("array<double>").alias(column), *rest), column)
    schema = rows.drop(column).withColumns({"code": F.lit(b"").cast("binary"), "error": F.lit(0).cast("long")}).schema
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(partial(_codes, books=books, scale=scale, schema=schema.names), schema)


def decode_vectors(coded: DataFrame, books: Codebooks, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``coded`` with the vector that each code stands for: the entries of its parts over ``scale``."""
    table = json.dumps([[[int(x) / scale for x in entry] for entry in book] for book in books.entries])
    table = F.from_json(F.lit(table), "array<array<array<double>>>")
    byte = lambda k: F.conv(F.hex(F.substring("code", k + 1, 1)), 16, 10).cast("int")
    return coded.withColumn(column, F.concat(*(F.get(F.get(table, F.lit(k)), byte(k)) for k in range(len(books.entries)))))


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over rows of one label; null is a label.

    The sums are made before they are shuffled. A table of at most ``LABELS_BROADCAST`` labels is
    broadcast; beyond that Spark joins it with the rows and splits hot labels (skew join).
    """
    sums = coded.groupBy(F.col(label).alias("its_label")).agg(F.sum(F.col(error).cast("decimal(38,0)")).alias("label_error"))
    sums = sums.withColumn("label_error", F.least("label_error", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long"))
    few = len(sums.limit(LABELS_BROADCAST + 1).select("its_label").toArrow()) <= LABELS_BROADCAST
    coded = coded.drop("label_error")
    return coded.join(F.broadcast(sums) if few else sums, coded[label].eqNullSafe(sums["its_label"]), "left").drop(sums["its_label"])
