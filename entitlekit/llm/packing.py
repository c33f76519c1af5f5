"""Operator 1: pack documents into training sequences, in order, with little padding.

The tokens of a lane (the documents of one input split, in their order) form one stream. It may be cut
at document ends for nothing, at sentence ends for a small penalty and elsewhere for a larger one, and
each window between two cuts costs what it is padded by. Dynamic programming over the possible cuts
finds the cheapest windows: the best start for a cut is the least value among the cuts within the
capacity before it, which a monotone queue keeps at its head, so a lane takes one step per cut.

Lanes are independent, no row is shuffled, and a lane holds a segment of some windows at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import U64, name_words, ranges, text_buffer

CAPACITY, END_ID = 4096, 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SENTENCE_PENALTY, SPLIT_PENALTY = 4, 24  # in tokens of padding
HARD_GAP = 64  # stretches without a sentence end get a possible cut this often
SEGMENT = 64  # windows that are decided at a time
SLICE_BYTES, CACHE_WORDS = 4 << 20, 1_500_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # not those of contractions and of special tokens
KIND = np.ones(256, np.uint8)
KIND[list(MARKS)] = 2
KIND[[9, 10, 11, 12, 13, 32]] = 0
SIMPLE = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]+|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+")


def find_units(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, offsets of rows) of what is encoded alone: words, parted from marks beside them.

    The vocabulary's own first step parts text at white space, and between letters or digits and
    marks. Only places where ASCII and Latin-1 bytes make that certain are used; elsewhere a word
    stays whole.
    """
    n = len(data)
    kind = KIND[data]
    high = (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[:-1] == 0xC3)
    ends_letter, starts_letter = ALNUM[data], ALNUM[data]
    ends_letter[1:] |= high
    starts_letter[:-1] |= high
    edge = np.zeros(n + 1, bool)
    left, right = kind[:-1], kind[1:]
    edge[1:-1] = (left != right) & ((left == 0) | (right == 0) | np.where(left == 1, ends_letter[:-1], starts_letter[1:]))
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    solid = kind[at[:-1]] > 0
    starts, ends = at[:-1][solid], at[1:][solid]
    return starts, ends, np.searchsorted(starts, offsets)


class WordTokenizer:
    """Token ids of texts, a unit at a time: no token of this vocabulary spans two.

    Each different unit is encoded once and kept, until ``CACHE_WORDS`` are known.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        closing = re.compile(r"[^\w\s]*[.!?…][\"')\]»”’]*</w>")
        self.sentence_ends = [i for t, i in vocabulary.items() if closing.fullmatch(t)]
        self.clear()

    def clear(self) -> None:
        self.names = np.zeros(0, U64)
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number per word). Simple words can be told apart in one text by their last token."""
        ids, sizes = [], []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            if all(map(SIMPLE.fullmatch, part)):
                found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
                stops = np.flatnonzero(self.is_end[found]) + 1
                if len(stops) == len(part) and stops[-1] == len(found):
                    ids.append(found)
                    sizes.append(np.diff(stops, prepend=0))
                    continue
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, names: np.ndarray, words: list[str]) -> None:
        simple = np.array([SIMPLE.fullmatch(w) is not None for w in words])
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        found, sizes = self._encode([words[i] for i in order])
        while self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(found)] = found
        first = self.used + np.cumsum(sizes) - sizes
        self.used += len(found)
        names = np.concatenate([self.names, names[order]])
        order = np.argsort(names)
        self.names = names[order]
        self.first = np.concatenate([self.first, first])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows) of texts in a buffer."""
        if not len(data):
            return self.ids[:0], np.zeros(len(offsets), np.int64)
        if b"<|" not in data.tobytes():  # else letters stay as they are, as special tokens heed their case
            data = LOWER[data]
        starts, ends, rows = find_units(data, offsets)
        if not len(starts):
            return self.ids[:0], np.zeros(len(offsets), np.int64)
        names, at, number = np.unique(name_words(data, starts, ends), return_index=True, return_inverse=True)
        seat = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        new = np.flatnonzero(self.names[seat] != names) if len(self.names) else np.arange(len(names))
        if len(self.names) + len(new) > CACHE_WORDS:
            self.clear()
            new = np.arange(len(names))
        if len(new):
            raw = data.tobytes()
            self._learn(names[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in at[new]])
            seat = np.searchsorted(self.names, names)
        sizes, first = self.sizes[seat][number], self.first[seat][number]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[ranges(first, sizes)], total[rows]


def best_cuts(places: list[int], penalties: list[int], capacity: int, rest) -> list[int]:
    """The cheapest cuts from the first place on: indices of ``places``, ascending.

    A window of n tokens costs ``capacity - n`` and the penalty of its end; the tokens after the last
    cut, fewer than a window or as many, cost ``rest(n)``. With g = cost + place, the best start of a
    window is the least g within reach, whatever the end is: the queue holds the reachable starts in
    ascending order of both place and g.
    """
    n = len(places)
    g, back = [0] * n, [0] * n
    g[0] = places[0]
    queue, head = [], 0
    for j in range(1, n):
        value = g[j - 1]
        while len(queue) > head and g[queue[-1]] >= value:
            queue.pop()
        queue.append(j - 1)
        floor = places[j] - capacity
        while places[queue[head]] < floor:
            head += 1
        i = queue[head]
        g[j], back[j] = g[i] + capacity + penalties[j], i
    open_ = [i for i in range(n) if places[-1] - places[i] <= capacity]
    j = min(open_, key=lambda i: g[i] - places[i] + rest(places[-1] - places[i]))
    cuts = []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, capacity: int):
    """(places, penalties) where a stream may be cut, its start and end included."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    step = min(HARD_GAP, capacity)
    wide = np.flatnonzero(gaps > step)
    more = (gaps[wide] - 1) // step
    extra = np.repeat(at[wide], more) + step * (1 + ranges(np.zeros(len(wide), np.int64), more))
    penalty[extra] = SPLIT_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at.tolist(), penalty[at].tolist()


def tail_windows(size: int, capacity: int) -> list[int]:
    """Sizes for the last tokens of a lane: one padded sequence, or powers of two, which need no padding."""
    parts = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    return [size] if size and capacity - size <= SPLIT_PENALTY * (len(parts) - 1) else parts


def tail_cost(size: int, capacity: int) -> int:
    return min(capacity - size, SPLIT_PENALTY * max(0, size.bit_count() - 1)) if size else 0


class Lane:
    """The stream of one lane: takes documents, gives out pieces of decided windows."""

    def __init__(self, capacity: int, sentence_end: np.ndarray):
        self.capacity, self.sentence_end = capacity, sentence_end
        self.ids = np.zeros(0, np.int32)
        self.docs, self.starts, self.sizes = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sequence = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0

    def add(self, docs: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        """``starts`` are where documents begin in the stream, below 0 for those given out in part."""
        self.starts = np.concatenate([self.starts, len(self.ids) + offsets[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(offsets)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs += docs

    def decide(self, last: bool = False) -> pa.RecordBatch | None:
        """Pieces of the windows that are settled; the tokens after them may take more."""
        if not len(self.ids):
            return None
        ends = self.starts + self.sizes
        places, penalties = possible_cuts(self.ids, ends, self.sentence_end, self.capacity)
        rest = (lambda n: tail_cost(n, self.capacity)) if last else (lambda n: 0)
        cuts = [places[c] for c in best_cuts(places, penalties, self.capacity, rest)]
        if last:
            before = cuts[-1] if cuts else 0
            cuts += (before + np.cumsum(tail_windows(len(self.ids) - before, self.capacity))).tolist()
        if not cuts:
            return None
        cuts = np.array([0, *cuts])
        done = cuts[-1]
        begins = np.union1d(cuts[:-1], self.starts[(self.starts >= 0) & (self.starts < done)])
        lengths = np.diff(np.append(begins, done))
        doc = np.searchsorted(self.starts, begins, "right") - 1
        window = np.searchsorted(cuts, begins, "right") - 1
        raw = pa.py_buffer(self.ids[:done].astype("<u4").tobytes())
        bounds = pa.py_buffer((4 * np.append(begins, done)).astype(np.int64).tobytes())
        packed = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, bounds, raw]).cast(pa.binary())
        pieces = pa.RecordBatch.from_arrays(
            [pa.array([self.docs[i] for i in doc], pa.int64()), pa.array(begins - self.starts[doc]), pa.array(lengths), packed, pa.array(self.sizes[doc]), pa.array(self.sequence + window), pa.array(begins - cuts[window])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts) - 1
        self.ids = self.ids[done:]
        keep = int(np.searchsorted(ends, done, "right"))
        self.docs, self.starts, self.sizes = self.docs[keep:], self.starts[keep:] - done, self.sizes[keep:]
        return pieces


def pack_lane(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokenizer = WordTokenizer(path)
    flags = np.zeros(max(tokenizer.tokenizer.get_vocab_size(), end_id + 1), bool)
    flags[tokenizer.sentence_ends] = True
    lane = Lane(capacity, flags)
    for batch in batches:
        data, offsets = text_buffer(batch, "text")
        docs = batch.column("doc_id").to_pylist()
        i = 0
        while i < len(docs):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            ids, bounds = tokenizer.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = np.insert(ids, bounds[1:], end_id)
            lane.add(docs[i:j], ids, bounds + np.arange(len(bounds)))
            if len(lane.ids) >= SEGMENT * capacity and (pieces := lane.decide()) is not None:
                yield pieces
            i = j
    if (pieces := lane.decide(last=True)) is not None:
        yield pieces


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Cut the token ids of all documents into sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id and text; other columns are ignored. ``tokenizer`` is the path of a tokenizers
    file whose tokens span no white space. Every document is its ids and ``end_id``. Returns a row per
    piece: doc_id, start (of the piece in its document), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset (of the piece in its sequence). A null or empty text is its
    ``end_id`` alone; repeated rows are packed each; an empty table gives no piece. A sequence that
    ends below the capacity is to be padded, unless its length is a power of two.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lambda b: pack_lane(b, tokenizer, capacity, end_id), SCHEMA)
