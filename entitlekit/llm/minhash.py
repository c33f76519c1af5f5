"""Operator 7: near-duplicates of weighted shingle sets by DartMinHash and banding.

Each element of weight w owns the region [0, w) x [0, infinity) of (weight, rank). Darts hit it as a
Poisson process of rate 1 whose places are functions of the element's name, so all texts that hold
the element see the same darts. A text of total weight W looks at the darts of rank up to t / W, about
t of them however large it is; each falls on one of K coordinates, which keeps the dart of least rank.
Two texts agree on a coordinate with a probability equal to their weighted Jaccard similarity.

Bands of ROWS coordinates are the buckets. Texts with one shingle set are one node. A bucket of two or
more nodes is checked by its exact sets, each pair until the two are known to be linked; buckets
with the same members are checked once. Components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import U64, checkpoint, keyed, longs, mix, name_words, ranges, rolling, slices, span_hashes, text_buffer, white_words
from entitlekit.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
K, ROWS = 128, 4  # 32 bands of 4: a pair at 0.8 meets in none of them once in 20 million pairs
DARTS = K * (np.log(K) + 1)
FIRST = -6  # the first rank cell is [0, 2**FIRST)
BLOCK = 1024  # nodes of a bucket that one task compares with as many others
TEXTS = 512  # texts whose darts are thrown together

SIGNED = "doc_id long, fp1 long, fp2 long, bands array<long>"
MEMBER = "bucket long, low int, high int, node long, names binary"


def shingle_sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, counts) of the distinct shingles of each row: 5 words, or all words of a shorter text."""
    data, offsets = text_buffer(batch, column)
    starts, ends, rows = white_words(data, offsets)
    words = name_words(data, starts, ends)
    grams = rolling(words, SHINGLE)
    for lo, hi in zip(rows[:-1], rows[1:]):
        if hi - lo >= SHINGLE:
            yield np.unique(grams[lo : hi - SHINGLE + 1], return_counts=True)
        elif hi > lo:
            yield span_hashes(words[lo:hi], np.zeros(1, np.int64), np.array([hi - lo])), np.ones(1, np.int64)
        else:
            yield np.zeros(0, U64), np.zeros(0, np.int64)


def _poisson_table(mean: float) -> np.ndarray:
    """Thresholds on a 64-bit draw: the number of darts is the number of thresholds at or below it."""
    total, term, out = 0.0, float(np.exp(-mean)), []
    for k in range(24):
        total += term
        out.append(min(total, 1 - 2.0**-53))
        term *= mean / (k + 1)
    return np.array(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """K names per (elements, weights); weights are above 0, and every set holds an element.

    Ranks are cut into cells [0, 2^FIRST), [2^FIRST, 2^(FIRST+1)), ... up to 1 and cells of length 1
    from there on; weights into layers of height 1. The darts of a cell and layer are drawn from the
    hash of (element, layer, cell), so every set that reaches the cell finds the same ones.
    """
    total = np.array([w.sum() for _, w in sets])
    best = np.full(len(sets) * K, ~U64(0))
    names = np.concatenate([n for n, _ in sets])
    weights = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(n) for n, _ in sets])
    layers = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(names)), layers)
    layer = ranges(np.zeros(len(names), np.int64), layers)
    with np.errstate(over="ignore"):
        source = mix(names[at] + layer.astype(U64) * U64(0x9E3779B97F4A7C15), 41)
    owner, room = owner[at], weights[at] - layer
    reach = np.maximum(FIRST, np.ceil(np.log2(DARTS / total))).astype(np.int64)
    level, open_ = FIRST, np.ones(len(sets), bool)
    while open_.any():
        live = np.flatnonzero(open_[owner])
        cells = 1 if level <= 0 else 1 << (level - 1)
        low = 0.0 if level == FIRST else 2.0 ** (level - 1)
        width = 2.0**level if level == FIRST else low / cells
        table = _poisson_table(width)
        for first in range(0, cells, 64):
            step = np.arange(first, min(cells, first + 64))
            with np.errstate(over="ignore"):
                cell = mix(np.repeat(source[live], len(step)) + np.tile(step.astype(U64), len(live)), 1000 + level)
            darts = np.searchsorted(table, _unit(cell), "right")
            hit = np.flatnonzero(darts)
            if not len(hit):
                continue
            dart = np.repeat(hit, darts[hit])
            number = ranges(np.zeros(len(hit), np.int64), darts[hit])
            with np.errstate(over="ignore"):
                draw = mix(cell[dart] + number.astype(U64), 43)
            element = live[dart // len(step)]
            rank = low + width * (step[dart % len(step)] + _unit(draw))
            inside = _unit(mix(draw, 53)) < room[element]
            coordinate = owner[element] * K + (mix(draw, 47) % U64(K)).astype(np.int64)
            value = (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (draw >> U64(32))
            np.minimum.at(best, coordinate[inside], value[inside])
        empty = (best.reshape(-1, K) == ~U64(0)).any(1)
        open_ = (reach > level) | empty
        level += 1
    return best.reshape(-1, K)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """A key per band of ROWS coordinates; the dart's rank and name are the coordinate's value."""
    bands = K // ROWS
    key = np.tile(np.arange(bands, dtype=U64), (len(signature), 1))
    for row in range(ROWS):
        with np.errstate(over="ignore"):
            key = mix(key + signature[:, row::ROWS][:, :bands], 59 + row)
    return key


def sign(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            sets = [(n, c if weighted else np.ones(len(n))) for n, c in shingle_sets(part)]
            full = [i for i, (n, _) in enumerate(sets) if len(n)]
            if not full:
                continue
            sets = [sets[i] for i in full]
            keys = _band_keys(signatures(sets))
            with np.errstate(over="ignore"):
                prints = [
                    [int(np.sum(mix(n + c.astype(U64) * U64(977), salt), dtype=U64).view(np.int64)) for n, c in sets]
                    for salt in (61, 67)
                ]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(longs(part, "doc_id")[full]), pa.array(prints[0]), pa.array(prints[1]), bands], names=["doc_id", "fp1", "fp2", "bands"])


def send_members(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    """The shingle names (and counts, if they matter) of each node, once for each pair of blocks of its buckets."""
    for batch in (part for batch in batches for part in slices(batch, "text")):
        nodes, out = longs(batch, "doc_id"), {k: [] for k in ("bucket", "low", "high", "node", "names")}
        wanted = batch.column("buckets").to_pylist()
        for node, buckets, (names, counts) in zip(nodes, wanted, shingle_sets(batch)):
            packed = np.stack([names, counts.astype(U64)], 1).tobytes() if weighted else names.tobytes()
            for b in buckets:
                blocks = -(-b["size"] // BLOCK)
                own = int(mix(np.array([node]).astype(U64), 71)[0] % U64(blocks))
                for other in range(blocks):
                    for k, v in zip(out, (b["bucket"], min(own, other), max(own, other), node, packed)):
                        out[k].append(v)
            if len(out["node"]) >= 2048:
                yield _members(out)
                out = {k: [] for k in out}
        if out["node"]:
            yield _members(out)


def _members(out: dict) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def link_group(nodes: np.ndarray, packed: list[bytes], weighted: bool, threshold: float) -> list[tuple[int, int]]:
    """Links that join all nodes which pairs at ``threshold`` or more connect, and no others.

    Shingles of one node alone meet nothing, so the others are kept as bits. Nodes are compared with all
    others until those left are in one component: a pair is in it, or one of the two was compared.
    """
    order = np.argsort(nodes, kind="stable")
    tables = [np.frombuffer(packed[i], U64) for i in order]
    nodes = nodes[order]
    if weighted:  # one element for each occurrence
        tables = [t.reshape(-1, 2) for t in tables]
        names = [mix(np.repeat(t[:, 0], t[:, 1].astype(np.int64)) + ranges(np.zeros(len(t), np.int64), t[:, 1].astype(np.int64)).astype(U64), 73) for t in tables]
    else:
        names = tables
    sizes = np.array([len(n) for n in names])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    values, number, uses = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    column = np.cumsum(uses > 1) - 1
    shared = uses[number] > 1
    width = int((uses > 1).sum())
    bits = np.zeros((len(nodes), width), bool)
    bits[owner[shared], column[number[shared]]] = True
    bits = np.packbits(bits, axis=1)
    pad = -bits.shape[1] % 8
    bits = np.pad(bits, ((0, 0), (0, pad))).view(U64)
    root = np.arange(len(nodes))
    links = []
    degree = np.bincount(owner[shared], minlength=len(nodes)) / np.maximum(sizes, 1)
    left = np.argsort(-degree, kind="stable")
    while len(left):
        inside = np.bincount(root[left])
        biggest = inside.argmax()
        if inside[biggest] == len(left):
            break
        at = 0 if inside[biggest] == 1 else int((root[left] != biggest).argmax())
        i, left = left[at], np.delete(left, at)
        common = np.bitwise_count(bits & bits[i]).sum(1, dtype=np.int64)
        near = (common >= threshold * (sizes + sizes[i] - common) - 1e-9) & (root != root[i])
        for j in np.flatnonzero(near):
            if root[j] != root[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return links


def link_buckets(batches: Iterator[pa.RecordBatch], weighted: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and blocks to links."""
    key, nodes, packed, links = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "low", "high", "node", "names")]
        for bucket, low, high, node, names in zip(*columns):
            if (bucket, low, high) != key:
                if len(nodes) > 1:
                    links += link_group(np.array(nodes), packed, weighted, threshold)
                key, nodes, packed = (bucket, low, high), [], []
            nodes.append(node)
            packed.append(names)
        if len(links) >= 10_000:
            yield _links(links)
            links = []
    if len(nodes) > 1:
        links += link_group(np.array(nodes), packed, weighted, threshold)
    if links:
        yield _links(links)


def _links(links: list) -> pa.RecordBatch:
    a, b = np.array(links, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_classes(docs: DataFrame, *, weighted: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every document: classes of texts linked by near-duplicate pairs.

    Two texts are linked when the Jaccard similarity of their 5-word shingles is ``threshold`` or more;
    ``weighted`` counts repeated shingles as often as they occur (then the minimum of the counts over
    the maximum). class_id is the least doc_id of the class. Words are ``[^\\x20\\x09-\\x0D]+``; a text
    of 1 to 4 words is one shingle; a text without words is alone in its class. Rows without an id are
    left out, rows that repeat an id give one row each. An empty table gives an empty table.
    """
    texts = keyed(docs).select("doc_id", "text")
    signed = checkpoint(texts.mapInArrow(lambda b: sign(b, weighted), SIGNED))
    nodes = checkpoint(signed.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
    ).where("size > 1")
    once = buckets.groupBy("members", "size").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    wanted = entries.join(once, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "size")).alias("buckets"))
    members = (
        texts.join(wanted, texts["doc_id"] == wanted["node"]).select("doc_id", "text", "buckets")
        .mapInArrow(lambda b: send_members(b, weighted), MEMBER)
    )
    links = (
        members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(lambda b: link_buckets(b, weighted, threshold), "a long, b long")
    )
    roots = components(links)
    classes = nodes.select("fp1", "fp2", "node").join(roots, "node", "left").select(
        "fp1", "fp2", F.coalesce("root", "node").alias("class_id")
    )
    known = signed.select("doc_id", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("doc_id", "class_id")
    empty = docs.where(F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    alone = empty.select(F.col("doc_id").cast("long").alias("doc_id"))
    return known.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id")))
