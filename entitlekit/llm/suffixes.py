"""Operator 6: repeated byte strings, by radix sorting of suffixes only through the threshold depth.

A suffix is a place of a text, read for ``DEPTH`` bytes. The first digit of the sort is taken at the
synchronising place of the suffix, the least 16-byte name of its ``DEPTH`` bytes; suffixes whose
first digit stands in one place only leave the sort. The others are sorted on by passes of 8 bytes,
most significant first, and leave it as soon as they are alone. Groups that are left at the full
depth are exactly the repeated strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entitlekit.llm.common import U64, mix, ranges, span_hashes, text_buffer
from entitlekit.llm.repeats import Scheme, repeated_spans, spans_of

DEPTH, GRAM, DIGIT = 50, 16, 8
STEP = 1 << 18
KEPT_SCHEMA = "doc_id long, n_bytes long, kept binary, spans array<struct<start: int, end: int>>"


def byte_units(batch: pa.RecordBatch):
    return text_buffer(batch, "text")


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number; missing bytes count as zero."""
    x = np.concatenate([data, np.zeros(7, np.uint8)]).astype(U64)
    x = (x[:-1] << U64(8)) | x[1:]
    x = (x[:-2] << U64(16)) | x[2:]
    return (x[:-4] << U64(32)) | x[4:]


def byte_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Runs of windows with one synchronising place; windows never cross a piece."""
    n = len(data) - DEPTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    words = words_at(data)
    with np.errstate(over="ignore"):
        names = mix(mix(words[: len(data) - GRAM + 1]) + words[8 : len(data) - GRAM + 9])
    least = (names & U64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=U64)
    width, reach = DEPTH - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    windows = np.flatnonzero(np.arange(n) + DEPTH <= np.repeat(ends, ends - begins)[:n])
    place = (least[windows] & U64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    return windows[first], np.diff(np.append(first, len(windows))), names[place[first]]


def byte_payload(data: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    """The bytes that the windows of each run cover."""
    sizes = byte_sizes(counts)
    return data[ranges(starts, sizes)], sizes


def byte_sizes(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.int64) + DEPTH - 1


def radix_groups(digits: np.ndarray, starts: np.ndarray, group: np.ndarray):
    """Sort suffixes by most-significant-digit passes to ``DEPTH``.

    Returns (suffix, group) of those that have an equal one; ``group`` tells apart what the first
    digit tells apart already.
    """
    live = np.arange(len(starts))
    for at in range(0, DEPTH, DIGIT):
        digit = digits[starts[live] + at]
        if at + DIGIT > DEPTH:
            digit = digit >> U64(8 * (at + DIGIT - DEPTH))
        order = np.lexsort((digit, group))
        digit, group, live = digit[order], group[order], live[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        alone = fresh & np.append(fresh[1:], True)
        group = np.cumsum(fresh)[~alone]
        live = live[~alone]
    return live, group


def byte_group(keys, counts, payload, docs, packed) -> np.ndarray:
    """For each window, whether an equal one stands in a text of a smaller id.

    Runs that are equal as a whole are sorted once, under their smallest id.
    """
    counts = counts.astype(np.int64)
    sizes = byte_sizes(counts)
    offsets = np.cumsum(sizes) - sizes
    whole = span_hashes(payload, offsets, offsets + sizes)
    order = np.lexsort((docs, whole, keys))
    same = (whole[order][1:] == whole[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    leader = np.empty(len(keys), np.int64)
    leader[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    heads = order[begins]  # the smallest id of each kind of run
    _, key_number = np.unique(keys[heads], return_inverse=True)
    suffixes = ranges(offsets[heads], counts[heads])
    owner = np.repeat(np.arange(len(heads)), counts[heads])
    first = docs[heads][owner]
    live, group = radix_groups(words_at(payload), suffixes, key_number[owner])
    if len(live):
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(first[live], begins)
        first[live] = np.repeat(least, np.diff(np.append(begins, len(live))))
    head_windows = np.cumsum(counts[heads]) - counts[heads]
    windows = ranges(head_windows[leader], counts)
    return np.repeat(docs, counts) > first[windows]


SCHEME = Scheme(DEPTH, STEP, byte_units, byte_runs, byte_payload, byte_sizes, byte_group)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        data, offsets = text_buffer(batch, "text")
        kept, spans = [], []
        for i, found in enumerate(batch.column("found").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            lo, hi = spans_of(found)
            if len(lo):
                keep = np.ones(len(text), bool)
                for a, b in zip(lo, hi):
                    keep[a:b] = False
                text = text[keep]
            kept.append(text.tobytes())
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(spans, kind)],
            names=["doc_id", "n_bytes", "kept", "spans"],
        )


def cut_repeated_strings(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document of a smaller id.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns a row per input row:
    doc_id, n_bytes, kept (the bytes that stay) and spans (the removed runs). A null text is empty;
    texts under 50 bytes keep everything; rows without an id, and rows that share an id, don't count
    as earlier ones of each other. An empty table gives an empty table.
    """
    return repeated_spans(docs, SCHEME).mapInArrow(_cut, KEPT_SCHEMA)
