"""Operator 10: benchmark passages in training texts, through a distributed positional inverted index.

The index is partitioned by document, as search clusters do it: each task names the words of its own
documents and stores the postings (term, place) of the benchmark's terms. A phrase is looked up from
its rarest term, by counts over all documents: each posting, less the term's offset in the item, is an
alignment of item and document, and the places next to it are intersected outwards until a window of
``WINDOW`` words stands or the alignment fails. For proximity, the postings of the next rarest terms
near the rarest one are intersected within a distance instead of at an offset.

The benchmark is read in blocks of a checked size, each held by every task while it reads all
documents; with one block no row is shuffled but the term counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import find_words, keyed, merge_spans, name_words, ranges, slices, small_batches, text_buffer

WINDOW, SLOP, NEAR_TERMS = 13, 10, 3
BLOCK_BYTES = 2 << 20
CANDIDATES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

HITS = "array<struct<start: int, end: int>>"
SCHEMA = f"doc_id long, tag long, n_words long, hits {HITS}, items array<string>, near_items array<string>"


def words_of(batch: pa.RecordBatch):
    """(names of the lower-case words, word offsets of the rows)."""
    data, offsets = text_buffer(batch, "text")
    data = LOWER[data]
    starts, ends, rows = find_words(data, offsets, IN_WORD)
    return name_words(data, starts, ends), rows


@dataclass(frozen=True)
class Block:
    """The items of a block: ``terms`` sorted, ``words`` as indices of terms, offsets of the items."""

    ids: list
    terms: np.ndarray
    words: np.ndarray
    offsets: np.ndarray

    def number(self, names: np.ndarray) -> np.ndarray:
        """Index of each name among the terms, or -1."""
        at = np.searchsorted(self.terms, names)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == names, at, -1).astype(np.int32)


def block_of(rows: list) -> Block:
    batch = pa.RecordBatch.from_arrays([pa.array([r["text"] for r in rows], pa.string())], names=["text"])
    names, offsets = words_of(batch)
    terms, words = np.unique(names, return_inverse=True)
    return Block([r["item_id"] for r in rows], terms, words.astype(np.int32), offsets)


@dataclass(frozen=True)
class Plan:
    """Where to look from: item places such that each window holds one, its rarest."""

    pivots: np.ndarray  # places in Block.words
    items: np.ndarray  # item of each pivot
    near: np.ndarray  # the next rarest terms around it, -1 for none


def plan_of(block: Block, counts: np.ndarray) -> Plan:
    pivots, items, near = [], [], []
    for i in range(len(block.ids)):
        lo, hi = int(block.offsets[i]), int(block.offsets[i + 1])
        if lo == hi:
            continue
        rarity = counts[block.words[lo:hi]]
        width = min(WINDOW, hi - lo)
        views = np.lib.stride_tricks.sliding_window_view(rarity, width)
        for place in np.unique(np.arange(len(views)) + views.argmin(1)):
            around = block.words[max(lo, lo + place - WINDOW + 1) : min(hi, lo + place + WINDOW)]
            others = np.unique(around[around != block.words[lo + place]])
            others = others[np.argsort(counts[others], kind="stable")][: NEAR_TERMS - 1]
            pivots.append(lo + place)
            items.append(i)
            near.append(np.pad(others, (0, NEAR_TERMS - 1 - len(others)), constant_values=-1))
    shape = (len(pivots), NEAR_TERMS - 1)
    return Plan(np.array(pivots, np.int64), np.array(items, np.int64), np.array(near, np.int64).reshape(shape))


def count_terms(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(block.terms), np.int64)
    for batch in (part for batch in batches for part in slices(batch, "text")):
        term = block.number(words_of(batch)[0])
        total += np.bincount(term[term >= 0], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "uses"])


def _extend(terms, words, d, q, room, step: int) -> np.ndarray:
    """How many places from (d, q), going by ``step``, hold the same term, at most ``room``."""
    length = np.zeros(len(d), np.int64)
    live = np.arange(len(d))
    for k in range(1, WINDOW):
        live = live[room[live] >= k]
        live = live[terms[d[live] + step * k] == words[q[live] + step * k]]
        if not len(live):
            break
        length[live] = k
    return length


def _phrases(terms, rows, block: Block, plan: Plan):
    """Yields (row, item, start, end) of matched windows, and (row, item) of near ones.

    ``terms`` holds the index entry of every place; its postings are sorted by (term, place).
    """
    wanted = np.zeros(len(block.terms) + 1, bool)
    wanted[block.words[plan.pivots]] = True
    wanted[plan.near.ravel()] = True
    wanted[-1] = False
    places = np.flatnonzero(wanted[terms])
    places = places[np.argsort(terms[places], kind="stable")]
    listed = terms[places]
    width = len(terms) + 1
    index = listed.astype(np.int64) * width + places
    pivot_term = block.words[plan.pivots]
    begin, end = np.searchsorted(listed, pivot_term), np.searchsorted(listed, pivot_term, "right")
    sizes = end - begin
    batch_of = np.cumsum(sizes) // CANDIDATES
    for b in np.unique(batch_of[sizes > 0]):
        use = np.flatnonzero((batch_of == b) & (sizes > 0))
        pivot = np.repeat(use, sizes[use])
        d, q, item = places[ranges(begin[use], sizes[use])], plan.pivots[pivot], plan.items[pivot]
        row = np.searchsorted(rows, d, "right") - 1
        item_lo, item_hi = block.offsets[item], block.offsets[item + 1]
        left = _extend(terms, block.words, d, q, np.minimum(d - rows[row], q - item_lo), -1)
        right = _extend(terms, block.words, d, q, np.minimum(rows[row + 1] - 1 - d, item_hi - 1 - q), 1)
        hit = left + right + 1 >= np.minimum(WINDOW, item_hi - item_lo)
        close = np.ones(len(d), bool)
        for other in plan.near[pivot].T:
            at = np.searchsorted(index, other * width + np.maximum(d - WINDOW - SLOP, rows[row]))
            found = index[np.minimum(at, len(index) - 1)]
            close &= (other < 0) | ((found >= other * width + np.maximum(d - WINDOW - SLOP, rows[row])) & (found <= other * width + np.minimum(d + WINDOW + SLOP, rows[row + 1] - 1)))
        yield row[hit], item[hit], (d - left)[hit] - rows[row[hit]], (d + right + 1)[hit] - rows[row[hit]], row[close], item[close]


def match(batches: Iterator[pa.RecordBatch], block: Block, plan: Plan) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in (part for batch in batches for part in slices(batch, "text")):
        names, rows = words_of(batch)
        found = list(_phrases(block.number(names), rows, block, plan)) if len(plan.pivots) else []
        hits = [[] for _ in range(batch.num_rows)]
        items, near = [[] for _ in hits], [[] for _ in hits]
        if found:
            row, item, lo, hi, near_row, near_item = map(np.concatenate, zip(*found))
            order = np.argsort(row, kind="stable")
            row, item, lo, hi = row[order], item[order], lo[order], hi[order]
            for own in np.split(np.arange(len(row)), np.flatnonzero(row[1:] != row[:-1]) + 1) if len(row) else []:
                spans = merge_spans(lo[own], hi[own])
                hits[row[own[0]]] = [{"start": int(a), "end": int(b)} for a, b in zip(*spans)]
                items[row[own[0]]] = sorted({block.ids[i] for i in item[own] if block.ids[i] is not None})
            for pair in np.unique(near_row * len(block.ids) + near_item):
                name = block.ids[pair % len(block.ids)]
                if name is not None:
                    near[pair // len(block.ids)].append(name)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(np.diff(rows)), pa.array(hits, span), pa.array(items, pa.list_(pa.string())), pa.array([sorted(set(x)) for x in near], pa.list_(pa.string()))],
            names=["doc_id", "tag", "n_words", "hits", "items", "near_items"],
        )


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` of text, by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    if count == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def find_passages(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact and near occurrences of benchmark items in documents.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Returns a
    row per document: doc_id, n_words, hits (merged spans of words inside an occurring window of 13
    item words; an item of fewer words is one window), items (ids with occurring windows, as sorted
    strings) and near_items (ids whose rarest word has the next two rarest words of its surroundings
    within 23 words; every exact hit that has such words is near too). Null texts have no words, null
    item ids mark words but are not listed, repeated items count once, and with an empty benchmark
    nothing is hit.
    """
    return _find(docs, benchmark, block_bytes).drop("tag")


def _plans(texts: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[Block, Plan]]:
    """The blocks of the benchmark, each with the plan that the frequencies of its terms in ``texts`` ask for."""
    small_batches(texts.sparkSession)
    for part in blocks_of(benchmark, block_bytes):
        block = block_of(part.collect())  # of a checked size
        counts = np.zeros(len(block.terms), np.int64)
        if len(counts):
            uses = texts.mapInArrow(lambda b, block=block: count_terms(b, block), "term long, uses long")
            for row in uses.groupBy("term").agg(F.sum("uses").alias("uses")).collect():
                counts[row["term"]] = row["uses"]
        yield block, plan_of(block, counts)


def _find(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    texts = keyed(docs)
    return _found(texts, list(_plans(texts, benchmark, block_bytes)))


def _found(texts: DataFrame, plans: list[tuple[Block, Plan]]) -> DataFrame:
    parts = [texts.mapInArrow(lambda b, block=block, plan=plan: match(b, block, plan), SCHEMA) for block, plan in plans]
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # one row per block and document; rows that share id and text are one document repeated
    merged = every.groupBy("doc_id", "tag").agg(
        F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / len(parts)).cast("long").alias("copies"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    return merged.select(
        "doc_id", "tag", "n_words", _union("hits").alias("hits"), "items", "near_items",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def _union(spans: str):
    """Sorted spans as maximal runs."""
    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))).cast(HITS)
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), joined)).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.expr(f"cast(array() as {HITS})"), add)


def contamination(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated: a twentieth or more of the words are hit."""
    n_hit = F.aggregate("hits", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_batches(batches: Iterator[pa.RecordBatch], block: Block, plan: Plan) -> Iterator[pa.RecordBatch]:
    """The rows whose texts one block of the benchmark doesn't contaminate, with all their columns."""
    for part in (part for batch in batches for part in slices(batch, "text")):
        ids = pa.nulls(part.num_rows, pa.int64())  # not asked for here
        texts = pa.RecordBatch.from_arrays([ids, ids, part.column(part.schema.get_field_index("text"))], names=["doc_id", "tag", "text"])
        keep = []
        for found in match(iter([texts]), block, plan):
            hits = found.column("hits")
            spans = pc.list_flatten(hits)
            sizes = pc.subtract(spans.field("end"), spans.field("start")).to_numpy(zero_copy_only=False)
            n_hit = np.bincount(pc.list_parent_indices(hits).to_numpy(), sizes, minlength=found.num_rows)
            keep.append((n_hit == 0) | (20 * n_hit < found.column("n_words").to_numpy()))
        yield part.filter(pa.array(np.concatenate(keep)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Rows are judged by their texts alone: a row
    without an id, or one of an id with several texts, too. A text without words is never contaminated, and
    rows that repeat are kept or dropped together. With an empty benchmark all stay.

    A benchmark of one block is looked for where the rows are read, so no text moves; of several blocks
    the hits of a text are joined first, as only all of them together tell its share.
    """
    texts = keyed(docs)
    plans = list(_plans(texts, benchmark, block_bytes))
    if len(plans) == 1:
        block, plan = plans[0]
        return docs.mapInArrow(lambda b: clean_batches(b, block, plan), docs.schema)
    bad = contamination(_found(texts, plans)).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()
    tag = F.crc32(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (tag == bad["bad_tag"]), "left_anti")
