"""Windows that occur elsewhere in the corpus: the two-pass search shared by operators 4 and 6.

A *scheme* reads the windows of a text as runs: consecutive windows that share one synchronising
key, which depends on the content of the window alone. Equal windows therefore carry equal keys.

1. Every task names the runs of its texts and deals one row per (bucket of keys) with packed arrays.
   Keys repeated inside a task are settled there, so a key sends one entry per task at most, however
   hot it is. The bucket's task reports the runs whose key stands in two places.
2. Only those runs send their windows, again settled inside the task first, to the bucket of their
   key, where equal windows are grouped; every one but the first is a repeat.

Texts that equal a whole text of a smaller id are found by their own key in pass 1, and send no
windows in pass 2. The texts are shuffled by id once: both joins read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import U64, binaries, buckets_of, keyed, longs, merge_spans, mix, pieces, ranges, slices

RUN_SCHEMA = "part int, kind int, keys binary, docs binary, places binary"
WINDOW_SCHEMA = "part int, kind int, keys binary, docs binary, places binary, counts binary, payload binary"
RESULT_SCHEMA = "part int, docs binary, places binary, sizes binary"
FOUND_SCHEMA = "doc_id long, tag long, found binary"
FLUSH_RUNS, FLUSH_BYTES, SLICE = 600_000, 3 << 20, 50_000
WHOLE = -1  # the place of the key of a whole text
RUN, SURE, WHOLE_TEXT = 0, 1, 2  # kinds of rows: to be compared, settled, whole texts to be compared


@dataclass(frozen=True)
class Scheme:
    """``units(batch)`` gives (units, offsets); ``runs(units, piece starts, piece ends)`` gives
    (first window, number of windows, key) per run; ``payload(units, starts, counts)`` gives the
    packed windows of runs and their sizes, which ``sizes(counts)`` knows too; ``group(keys, counts, payload, docs, places)`` tells for
    each window whether an equal one comes earlier."""

    depth: int
    step: int
    units: Callable
    runs: Callable
    payload: Callable
    sizes: Callable
    group: Callable


def _runs_of(scheme: Scheme, units, offsets) -> Iterator[tuple]:
    """(first unit of the chunk, chunk units, rows, places, starts, counts, keys) for each chunk."""
    for lo, hi, begins, ends, rows, places in pieces(offsets, scheme.step, scheme.depth - 1):
        chunk = units[lo:hi]
        starts, counts, keys = scheme.runs(chunk, begins - lo, ends - lo)
        if len(starts):
            piece = np.searchsorted(begins - lo, starts, "right") - 1
            # pieces of no unit share their start with the next one; the last of them holds the unit
            yield chunk, rows[piece], places[piece] + starts - (begins - lo)[piece], starts, counts, keys


def _pack(places: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return ((places + 1) << 32) | tags


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (packed >> 32) - 1, packed & 0xFFFFFFFF


def _squeeze(values: np.ndarray) -> bytes:
    """Longs in a rising order, by their differences."""
    return zstandard.compress(np.diff(values, prepend=0).astype(np.int64).tobytes(), 1)


def _expand(packed: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), np.int64))


def _short(keys: np.ndarray) -> bytes:
    """The upper 6 bytes of keys. Texts are compared behind them, so two keys may share them."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(packed: pa.Buffer) -> np.ndarray:
    upper = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(upper, ((0, 0), (2, 0)))).view(U64).ravel()


def _groups(keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _settle(keys, docs, packed):
    """(repeated entries, first entries): indices; the first text of equal whole texts isn't repeated."""
    order = np.lexsort((packed, docs, keys))
    begins = _groups(keys[order])
    sizes = np.diff(np.append(begins, len(order)))
    first_doc = np.repeat(docs[order][begins], sizes)
    repeated = np.repeat(sizes > 1, sizes)
    whole = (packed[order] >> 32) == 0
    repeated &= ~whole | (docs[order] > first_doc)
    return order[repeated], order[begins]


def _batch(**columns) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "kind": pa.int32()}
    arrays = [pa.array(v, kinds[k]) if k in kinds else binaries(v) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _run_rows(keys, docs, packed, n: int) -> Iterator[pa.RecordBatch]:
    repeated, first = _settle(keys, docs, packed)
    out = {k: [] for k in ("part", "kind", "keys", "docs", "places")}
    part = keys % U64(n)
    for kind in (RUN, WHOLE_TEXT):
        own = first[((packed[first] >> 32) == 0) == (kind == WHOLE_TEXT)]
        own = own[np.lexsort((packed[own], docs[own], part[own]))]
        for own in np.split(own, _groups(part[own])[1:]) if len(own) else []:
            names = keys[own].tobytes() if kind == WHOLE_TEXT else _short(keys[own])
            _add(out, int(part[own[0]]), kind, names, _squeeze(docs[own]), _squeeze(packed[own]))
    repeated = repeated[np.lexsort((packed[repeated], docs[repeated]))]
    for at in range(0, len(repeated), SLICE):
        own = repeated[at : at + SLICE]
        part = int(mix(docs[own[:1]].astype(U64))[0] % U64(n))
        _add(out, part, SURE, b"", _squeeze(docs[own]), _squeeze(packed[own]))
    if out["part"]:
        yield _batch(**out)


def _add(out: dict, *values) -> None:
    for column, value in zip(out.values(), values, strict=True):
        column.append(value)


def send_runs(batches: Iterator[pa.RecordBatch], scheme: Scheme, n: int) -> Iterator[pa.RecordBatch]:
    """Pass 1, texts to entries of buckets."""
    kept, size = [], 0
    for batch in (part for batch in batches for part in slices(batch, "text")):
        units, offsets = scheme.units(batch)
        docs, tags = longs(batch, "doc_id"), longs(batch, "tag")
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        full = np.flatnonzero(known & (np.diff(offsets) >= scheme.depth))
        whole = mix(longs(batch, "whole")[full].astype(U64) + tags[full].astype(U64), 7)
        kept.append((whole, docs[full], _pack(np.full(len(full), WHOLE), tags[full])))
        for _, rows, places, _, _, keys in _runs_of(scheme, units, offsets):
            use = known[rows]
            kept.append((keys[use], docs[rows][use], _pack(places, tags[rows])[use]))
            size += len(keys)
        if size >= FLUSH_RUNS:
            yield from _run_rows(*map(np.concatenate, zip(*kept)), n)
            kept, size = [], 0
    if kept:
        yield from _run_rows(*map(np.concatenate, zip(*kept)), n)


READERS = {
    "keys": _long, "docs": _expand, "places": _expand,
    "whole": lambda b: np.frombuffer(b, U64), "counts": lambda b: np.frombuffer(b, np.int32),
    "payload": lambda b: np.frombuffer(zstandard.decompress(b), np.uint8),
}


def _read(batch: pa.RecordBatch, kind: int, names: tuple) -> list[tuple]:
    kinds = batch.column("kind").to_numpy(zero_copy_only=False)
    columns = [("keys" if name == "whole" else name, READERS[name]) for name in names]
    return [
        tuple(reader(batch.column(name)[int(i)].as_buffer()) for name, reader in columns)
        for i in np.flatnonzero(kinds == kind)
    ]


def _by_text(docs, tags, lo, hi, n: int) -> Iterator[pa.RecordBatch]:
    """Results as one row per bucket of ids, with packed arrays."""
    packed, part = _pack(lo, tags), mix(docs.astype(U64), 83) % U64(n)
    order = np.lexsort((packed, docs, part))
    out = {k: [] for k in ("part", "docs", "places", "sizes")}
    for own in np.split(order, _groups(part[order])[1:]) if len(order) else []:
        sizes = zstandard.compress((hi - lo)[own].astype(np.int32).tobytes(), 1)
        _add(out, int(part[own[0]]), _squeeze(docs[own]), _squeeze(packed[own]), sizes)
    if out["part"]:
        yield _batch(**out)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a bucket of ids to one row per text: its (start, end) as packed 32-bit numbers."""
    parts = []
    for batch in batches:
        for i in range(batch.num_rows):
            docs, packed = (_expand(batch.column(name)[i].as_buffer()) for name in ("docs", "places"))
            sizes = np.frombuffer(zstandard.decompress(batch.column("sizes")[i].as_buffer()), np.int32)
            parts.append((docs, packed, sizes))
    if not parts:
        return
    docs, packed, sizes = map(np.concatenate, zip(*parts))
    lo, tags = _unpack(packed)
    order = np.lexsort((lo, tags, docs))
    docs, tags, lo, sizes = docs[order], tags[order], lo[order], sizes[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])
    begins = np.flatnonzero(fresh)
    values = np.stack([lo, lo + sizes], 1).astype(np.int32)
    bounds = (8 * np.append(begins, len(docs))).astype(np.int64)
    packed = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(docs[begins]), pa.array(tags[begins]), packed.cast(pa.binary())], names=["doc_id", "tag", "found"])


def find_runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Pass 1, entries of a bucket to the places of repeated keys."""
    entries, texts, sure = [], [], []
    for batch in batches:
        entries += _read(batch, RUN, ("keys", "docs", "places"))
        texts += _read(batch, WHOLE_TEXT, ("whole", "docs", "places"))
        sure += _read(batch, SURE, ("docs", "places"))
    for kind in (entries, texts):
        if kind:
            keys, docs, packed = map(np.concatenate, zip(*kind))
            repeated, _ = _settle(keys, docs, packed)
            sure.append((docs[repeated], packed[repeated]))
    if sure:
        docs, packed = map(np.concatenate, zip(*sure))
        places, tags = _unpack(packed)
        yield from _by_text(docs, tags, places, places, n)


def _windows(found: pa.RecordBatch, scheme: Scheme):
    """The marked runs of the texts of a batch: (keys, docs, packed, counts, payload) per chunk."""
    units, offsets = scheme.units(found)
    docs, tags = longs(found, "doc_id"), longs(found, "tag")
    marks = [np.unique(np.frombuffer(row, np.int32)) for row in found.column("found").to_pylist()]
    copies = np.array([len(m) > 0 and m[0] == WHOLE for m in marks], bool)
    wanted = np.concatenate([m.astype(np.int64) + (np.int64(i) << 32) for i, m in enumerate(marks)])
    for chunk, rows, places, starts, counts, keys in _runs_of(scheme, units, offsets):
        at = places + (rows.astype(np.int64) << 32)
        hit = np.searchsorted(wanted, at)
        use = (wanted[np.minimum(hit, len(wanted) - 1)] == at) & ~copies[rows]
        if use.any():
            rows = rows[use]
            payload, sizes = scheme.payload(chunk, starts[use], counts[use])
            yield keys[use], docs[rows], _pack(places[use], tags[rows]), counts[use].astype(np.int32), payload, sizes
    whole = np.flatnonzero(copies)
    return docs[whole], tags[whole], np.diff(offsets)[whole]


def _repeat_spans(later, counts, docs, packed, depth):
    """(docs, tags, lo, hi) of the runs of repeated windows."""
    record = np.repeat(np.arange(len(counts)), counts)[later]
    places, tags = _unpack(packed)
    window = ranges(places, counts.astype(np.int64))[later]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (record[1:] != record[:-1]) | (window[1:] != window[:-1] + 1)
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(window)) - 1 if len(begins) else begins
    record = record[begins]
    return docs[record], tags[record], window[begins], window[ends] + depth


def _window_rows(kept: list, scheme: Scheme, n: int) -> Iterator[pa.RecordBatch]:
    keys, docs, packed, counts, payload, sizes = (np.concatenate(x) for x in zip(*kept))
    later = scheme.group(keys, counts, payload, docs, packed)
    yield from _span_rows(*_repeat_spans(later, counts, docs, packed, scheme.depth), n)
    ends = np.cumsum(counts)
    settled = np.add.reduceat(later.astype(np.int64), ends - counts) == counts
    part = (keys % U64(n)).astype(np.int64)
    order = np.flatnonzero(~settled)
    order = order[np.lexsort((packed[order], docs[order], part[order]))]
    at, offsets = 0, np.cumsum(sizes) - sizes
    out = {k: [] for k in ("part", "kind", "keys", "docs", "places", "counts", "payload")}
    tally = np.bincount(part[order], minlength=n)
    for p in np.flatnonzero(tally):
        own = order[at : at + tally[p]]
        at += tally[p]
        _add(out, int(p), RUN, _short(keys[own]), _squeeze(docs[own]), _squeeze(packed[own]), counts[own].tobytes(), zstandard.compress(payload[ranges(offsets[own], sizes[own])].tobytes(), 1))
    if out["part"]:
        yield _batch(**out)


def _span_rows(docs, tags, lo, hi, n: int) -> Iterator[pa.RecordBatch]:
    out = {k: [] for k in ("part", "kind", "keys", "docs", "places", "counts", "payload")}
    packed = _pack(lo, tags)
    order = np.lexsort((packed, docs))
    for at in range(0, len(docs), SLICE):
        own = order[at : at + SLICE]
        part = int(mix(docs[own[:1]].astype(U64))[0] % U64(n))
        _add(out, part, SURE, b"", _squeeze(docs[own]), _squeeze(packed[own]), (hi - lo)[own].astype(np.int32).tobytes(), b"")
    if out["part"]:
        yield _batch(**out)


def send_windows(batches: Iterator[pa.RecordBatch], scheme: Scheme, n: int) -> Iterator[pa.RecordBatch]:
    """Pass 2, texts with repeated keys to windows of buckets; whole copies are settled at once."""
    kept, size = [], 0
    for batch in batches:
        marked = batch.filter(batch.column("found").is_valid())
        for found in slices(marked, "text"):
            steps = _windows(found, scheme)
            while True:
                try:
                    rows = next(steps)
                except StopIteration as end:
                    docs, tags, lengths = end.value
                    yield from _span_rows(docs, tags, np.zeros(len(docs), np.int64), lengths, n)
                    break
                kept.append(rows)
                size += len(rows[4])
                if size >= FLUSH_BYTES:
                    yield from _window_rows(kept, scheme, n)
                    kept, size = [], 0
    if kept:
        yield from _window_rows(kept, scheme, n)


def _grouped(entries: list, scheme: Scheme) -> Iterator[tuple]:
    """The spans of repeated windows, by parts of the keys with about FLUSH_BYTES of windows each."""
    keys, docs, packed, counts, payload = (np.concatenate(x) for x in zip(*entries))
    sizes = scheme.sizes(counts)
    offsets = np.cumsum(sizes) - sizes
    parts = 1 + len(payload) // FLUSH_BYTES
    part = mix(keys, 89) % U64(parts)
    for k in range(parts):
        own = np.flatnonzero(part == k)
        if len(own):
            windows = payload[ranges(offsets[own], sizes[own])] if parts > 1 else payload
            later = scheme.group(keys[own], counts[own], windows, docs[own], packed[own])
            yield _repeat_spans(later, counts[own], docs[own], packed[own], scheme.depth)


def find_windows(batches: Iterator[pa.RecordBatch], scheme: Scheme, n: int) -> Iterator[pa.RecordBatch]:
    """Pass 2, windows of a bucket to the spans of repeated ones."""
    entries, spans = [], []
    for batch in batches:
        entries += _read(batch, RUN, ("keys", "docs", "places", "counts", "payload"))
        spans += _read(batch, SURE, ("docs", "places", "counts"))
    out = []
    for docs, packed, lengths in spans:
        lo, tags = _unpack(packed)
        out.append((docs, tags, lo, lo + lengths))
    if entries:
        out += _grouped(entries, scheme)
    if out:
        docs, tags, lo, hi = map(np.concatenate, zip(*out))
        yield from _by_text(docs, tags, lo, hi, n)


def repeated_spans(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, tag, text, found): every text with the packed spans of its repeated windows, or null.

    Rows without a doc_id are compared with nothing and keep all their text.
    """
    n = buckets_of(docs.sparkSession)
    runs = (
        keyed(docs, whole=True)
        .mapInArrow(lambda batches: send_runs(batches, scheme, n), RUN_SCHEMA)
        .repartitionById(n, F.col("part"))
        .mapInArrow(lambda batches: find_runs(batches, n), RESULT_SCHEMA)
        .repartitionById(n, F.col("part"))
        .mapInArrow(gather, FOUND_SCHEMA)
    )
    texts = keyed(docs)
    spans = (
        texts.join(runs, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "found")
        .mapInArrow(lambda batches: send_windows(batches, scheme, n), WINDOW_SCHEMA)
        .repartitionById(n, F.col("part"))
        .mapInArrow(lambda batches: find_windows(batches, scheme, n), RESULT_SCHEMA)
        .repartitionById(n, F.col("part"))
        .mapInArrow(gather, FOUND_SCHEMA)
    )
    return texts.join(spans, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "found")


def spans_of(found: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The merged spans of one text."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.frombuffer(found, np.int32).reshape(-1, 2).astype(np.int64)
    return merge_spans(pairs[:, 0], pairs[:, 1])
