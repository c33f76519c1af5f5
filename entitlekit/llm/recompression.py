"""Operator 4: repeated word windows, found by recompression.

Words are named by their content. Each round names maximal runs of one symbol, then pairs of a left
and a right symbol, where a symbol's side is a bit of its name. A name is a function of what it
stands for, so all tasks name alike without asking each other, and equal texts get equal symbols
except near their ends. For every symbol the *closure* is kept: the words that decide that the symbol
stands here. A window that holds the closure shares the symbol with every equal window; the symbol of
the highest level in it (of these, the least name) is the key of the window. Windows whose key stands
in two places are verified by their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entitlekit.llm.common import U64, mix, name_words, ranges, rolling, span_hashes, text_buffer, white_words
from entitlekit.llm.repeats import Scheme, repeated_spans, spans_of

DEPTH, ROUNDS = 20, 4
STEP = 1 << 17
FAR = 1 << 40
KEPT_SCHEMA = "doc_id long, n_words long, kept string, spans array<struct<start: int, end: int>>"


def word_units(batch: pa.RecordBatch):
    data, offsets = text_buffer(batch, "text")
    starts, ends, rows = white_words(data, offsets)
    return name_words(data, starts, ends), rows


def _neighbours(piece: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """The closures of the symbols before and after, or out of reach where the piece ends."""
    before, after = np.full(len(lo), -FAR), np.full(len(hi), FAR)
    same = piece[1:] == piece[:-1]
    before[1:] = np.where(same, lo[:-1], -FAR)
    after[:-1] = np.where(same, hi[1:], FAR)
    return before, after


def compress_runs(names, piece, lo, hi):
    """Name maximal runs of one symbol; that a run ends here is decided by its neighbours."""
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(names)) - 1
    sizes = last - first + 1
    before, after = _neighbours(piece, lo, hi)
    with np.errstate(over="ignore"):
        runs = np.where(sizes > 1, mix(names[first] + sizes.astype(U64), 11), names[first])
    return runs, piece[first], np.minimum(lo[first], before[first]), np.maximum(hi[last], after[last])


def compress_pairs(names, piece, lo, hi, salt: int):
    """Name each left symbol followed by a right one."""
    right = (mix(names, salt) & U64(1)).astype(bool)
    joined = np.zeros(len(names), bool)
    joined[:-1] = ~right[:-1] & right[1:] & (piece[1:] == piece[:-1])
    second = np.zeros(len(names), bool)
    second[1:] = joined[:-1]
    before, after = _neighbours(piece, lo, hi)
    new_lo = np.where(right & ~second, np.minimum(lo, before), lo)
    new_hi = np.where(~right & ~joined, np.maximum(hi, after), hi)
    at = np.flatnonzero(joined)
    new_lo[at] = np.minimum(lo[at], lo[at + 1])
    new_hi[at] = np.maximum(hi[at], hi[at + 1])
    with np.errstate(over="ignore"):
        new = names.copy()
        new[at] = mix(mix(names[at], 13) + names[at + 1], 17)
    stay = ~second
    return new[stay], piece[stay], new_lo[stay], new_hi[stay]


def _least(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least value of each range [first, first + count), count at least 1."""
    out = np.empty(len(first), U64)
    table, reach = values, 1
    while True:
        use = (counts >= reach) & (counts < 2 * reach)
        if use.any():
            a = first[use]
            out[use] = np.minimum(table[a], table[a + counts[use] - reach])
        if reach * 2 > DEPTH or len(table) <= reach:
            return out
        table = np.minimum(table[:-reach], table[reach:])
        reach *= 2


def window_keys(words: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """(windows, keys, symbols): the first word of every window in a piece, its key, and which
    symbol the key is of: within a periodic text, one key stands for several symbols."""
    n = len(words)
    windows = np.flatnonzero(np.arange(n) + DEPTH <= np.repeat(ends, ends - begins))
    keys, symbols = np.empty(len(windows), U64), np.empty(len(windows), np.int64)
    levels = [(words, np.repeat(np.arange(len(begins)), ends - begins), np.arange(n), np.arange(n) + 1)]
    for level in range(ROUNDS):
        levels.append(compress_pairs(*compress_runs(*levels[-1]), 101 + level))
    open_ = np.arange(len(windows))
    for level in range(ROUNDS, -1, -1):
        names, _, lo, hi = levels[level]
        use = (lo >= 0) & (hi < FAR) & (hi - lo <= DEPTH)
        names, lo, hi = names[use], lo[use], hi[use]
        if not len(names) or not len(open_):
            continue
        start = windows[open_]
        first, last = np.searchsorted(lo, start), np.searchsorted(hi, start + DEPTH, "right")
        hit = last > first
        best = _least((mix(names, 29) & U64(0xFFFFFFFFFF000000)) | np.arange(len(names), dtype=U64), first[hit], (last - first)[hit])
        symbol = (best & U64(0xFFFFFF)).astype(np.int64)
        with np.errstate(over="ignore"):
            whole = mix(names + span_hashes(words, lo, hi), 31 + level)
        keys[open_[hit]] = whole[symbol]
        symbols[open_[hit]] = symbol * (ROUNDS + 1) + level
        open_ = open_[~hit]
    return windows, keys, symbols


def word_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    if len(words) < DEPTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    windows, keys, symbols = window_keys(words, begins, ends)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (symbols[1:] != symbols[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    return windows[first], np.diff(np.append(first, len(windows))), keys[first]


def word_payload(words: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    """The names of the windows of each run."""
    names = rolling(words, DEPTH)[ranges(starts, counts)]
    return names.view(np.uint8), word_sizes(counts)


def word_sizes(counts: np.ndarray) -> np.ndarray:
    return 8 * counts.astype(np.int64)


def word_group(keys, counts, payload, docs, packed) -> np.ndarray:
    """For each window, whether an equal one starts earlier: by smaller id, then by place."""
    counts = counts.astype(np.int64)
    with np.errstate(over="ignore"):
        names = mix(np.frombuffer(payload.tobytes(), U64) + mix(np.repeat(keys, counts), 37))
    own = np.repeat(docs, counts)
    place = ranges(packed >> 32, counts)
    order = np.argsort(names, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
    sizes = np.diff(np.append(begins, len(order)))
    doc = own[order]
    first = np.repeat(np.minimum.reduceat(doc, begins), sizes)
    at = np.where(doc == first, place[order], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(at, begins), sizes)
    later = np.empty(len(order), bool)
    later[order] = (doc > first) | (at > least)
    return later


SCHEME = Scheme(DEPTH, STEP, word_units, word_runs, word_payload, word_sizes, word_group)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        data, offsets = text_buffer(batch, "text")
        counts, kept, spans = [], [], []
        for i, found in enumerate(batch.column("found").to_pylist()):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            lo, hi = spans_of(found)
            counts.append(len(words))
            for a, b in zip(lo[::-1], hi[::-1]):
                del words[a:b]
            kept.append(b" ".join(words))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)],
            names=["doc_id", "n_words", "kept", "spans"],
        )


def cut_repeated_windows(docs: DataFrame) -> DataFrame:
    """Remove every word covered by a 20-word window that also starts earlier in the corpus.

    Words are ``[^\\x20\\x09-\\x0D]+``; earlier means a smaller doc_id, or an earlier start in the same
    document. Returns a row per input row: doc_id, n_words, kept (the words that stay, joined by one
    space) and spans (the removed runs of words). A null text has no words; texts under 20 words keep
    everything; rows without an id are compared with nothing; rows that share id and text count as
    one. An empty table gives an empty table; other columns are ignored.
    """
    return repeated_spans(docs, SCHEME).mapInArrow(_cut, KEPT_SCHEMA)
