"""Operator 13: how the sources of a language differ in their words, with strings joined late.

Terms are counted and shuffled as 64-bit digests only: rows (language, source, digest) of fixed width.
Only digests that enough documents hold are kept. A second pass over the texts then takes the least and the
greatest string of each kept digest; where they differ, several terms share the digest, and these few
digests are counted anew by string. Texts of terms are joined back only for rows of the result.

Languages and sources travel as 64-bit numbers too; their table is checked in the same way, and another
seed is taken should two of them share a number.

All arithmetic is on integers. A term's share of a group is ``1 + floor(10^9 (count + 2) / (N + 2 V))``;
two shares p, q differ by ``floor((p - q)^2 / (p + q))``. For pairs of sources the terms that neither
has add the same value each, so only the others are visited: blocks of sources by blocks of terms, each a task's
small dense matrix, whose sums are exact in 64 bits. No pair of sources is ever a row for a single term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitlekit.llm.common import checkpoint, find_words, longs, name_words, ranges, slices, text_buffer

LEAST_DOCS, TOP = 10, 10
SHARE = 10**9
BLOCK, TERMS = 256, 1024  # sources and terms of a dense matrix
FILTER_BITS = (20, 27)  # of the filter of kept digests, as powers of two: 16 bits a digest between these
TERM_BYTES = np.zeros(256, bool)  # of [^\x00-\x40\x5B-\x60\x7B-\x7F]
TERM_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ---- terms of texts -----------------------------------------------------------------------------


def _lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)


def _terms(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[tuple]:
    """(slice, bytes, starts, ends, word offsets of rows, digests) of each slice of a batch."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_buffer(part, "text")
            data = _lower(data)
            starts, ends, rows = find_words(data, offsets, TERM_BYTES)
            digests = name_words(data, starts, ends) & np.uint64((1 << digest_bits) - 1)
            yield part, data, starts, ends, rows, digests.view(np.int64)


def _count(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, count, docs) of each slice."""
    for part, _, starts, _, rows, digests in _terms(batches, digest_bits):
        if not len(starts):
            continue
        groups = np.stack([longs(part, "lang"), longs(part, "source")], 1)
        groups, group = np.unique(groups, axis=0, return_inverse=True)
        known, code = np.unique(digests, return_inverse=True)
        doc = np.repeat(np.arange(part.num_rows), np.diff(rows))
        pairs, count = np.unique(doc * len(known) + code, return_counts=True)
        key = group.reshape(-1)[pairs // len(known)] * len(known) + pairs % len(known)
        keys, place, docs = np.unique(key, return_inverse=True, return_counts=True)
        total = np.bincount(place, weights=count, minlength=len(keys)).astype(np.int64)  # below 2^53: exact
        held = groups[keys // len(known)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (held[:, 0], held[:, 1], known[keys % len(known)], total, docs.astype(np.int64))],
            names=["lang", "source", "digest", "count", "docs"],
        )


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    body = data[ranges(starts, sizes)]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])


def _spell(batches: Iterator[pa.RecordBatch], digest_bits: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(digest, least, greatest) of the terms of each slice whose digest is in the filter."""
    for _, data, starts, ends, _, digests in _terms(batches, digest_bits):
        kept = np.flatnonzero(_in_filter(bits, digests))
        terms = pa.table([pa.array(digests[kept]), _strings(data, starts[kept], ends[kept])], names=["digest", "term"])
        spelt = terms.group_by("digest").aggregate([("term", "min"), ("term", "max")])
        yield from spelt.rename_columns(["digest", "least", "greatest"]).combine_chunks().to_batches()


def _recount(batches: Iterator[pa.RecordBatch], digest_bits: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, term, count, docs) of terms whose digest is in the filter, by string."""
    for part, data, starts, ends, rows, digests in _terms(batches, digest_bits):
        kept = np.flatnonzero(_in_filter(bits, digests))
        doc = np.repeat(np.arange(part.num_rows), np.diff(rows))[kept]
        terms = pa.table(
            [pa.array(doc), pa.array(longs(part, "lang")[doc]), pa.array(longs(part, "source")[doc]), pa.array(digests[kept]), _strings(data, starts[kept], ends[kept])],
            names=["doc", "lang", "source", "digest", "term"],
        )
        in_doc = terms.group_by(["doc", "lang", "source", "digest", "term"]).aggregate([([], "count_all")])
        counted = in_doc.group_by(["lang", "source", "digest", "term"]).aggregate([("count_all", "sum"), ([], "count_all")])
        yield from counted.select(["lang", "source", "digest", "term", "count_all_sum", "count_all"]).rename_columns(["lang", "source", "digest", "term", "count", "docs"]).combine_chunks().to_batches()


# ---- a filter of digests ------------------------------------------------------------------------


def digest_filter(digests: DataFrame) -> np.ndarray:
    """A bitmap that holds the low bits of every ``digest``: at most 16 MB, built by Spark.

    It lets pass all digests of the table and, the fuller it is, some others.
    """
    n = digests.count()
    power = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * n).bit_length()))
    place = F.col("digest").bitwiseAND(F.lit((1 << power) - 1)) + 1
    maps = digests.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
    bits = np.zeros(1 << (power - 3), np.uint8)
    for bucket, chunk in maps.collect():  # at most 4,096 maps of 4 kB
        start = (bucket - 1) * len(chunk)
        bits[start : start + len(chunk)] = np.frombuffer(bytes(chunk), np.uint8)[: len(bits) - start]
    return bits


def _in_filter(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    place = digests & (len(bits) * 8 - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


# ---- groups -------------------------------------------------------------------------------------


def number_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with ``lang`` and ``source`` as numbers, the table of their names).

    The table has (lang, source, lang_name, source_name), a row for each pair of names.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(name("lang").alias("lang_name"), name("source").alias("source_name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = checkpoint(named.select("lang_name", "source_name").distinct())
    for seed in range(64):
        number = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023, E731
        table = names.select(number("lang_name").alias("lang"), number("source_name").alias("source"), "lang_name", "source_name")
        shared = [table.groupBy(c).agg((F.min(f"{c}_name") != F.max(f"{c}_name")).alias("shared")).where("shared") for c in ("lang", "source")]
        if all(s.isEmpty() for s in shared):
            return named.select(number("lang_name").alias("lang"), number("source_name").alias("source"), "text"), table
    raise ValueError("no seed tells all names apart")


# ---- counts of kept terms -----------------------------------------------------------------------

COUNTS = "lang long, source long, digest long, count long, docs long"


def kept_counts(numbered: DataFrame, least_docs: int = LEAST_DOCS, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(counts, spellings) of the terms that enough documents of their language hold.

    Counts: (lang, source, digest, split, count). ``split`` is null, but for a digest that several
    terms share it is the term. Spellings: (digest, term) of the digests that are not shared.
    """
    counted = numbered.mapInArrow(partial(_count, digest_bits=digest_bits), COUNTS)
    counted = counted.groupBy("lang", "source", "digest").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = checkpoint(_often(counted.withColumn("split", F.lit(None).cast("string")), least_docs))
    digests = kept.select("digest").distinct()
    bits = digest_filter(digests)
    spelt = numbered.select("text").mapInArrow(partial(_spell, digest_bits=digest_bits, bits=bits), "digest long, least string, greatest string")
    spelt = spelt.groupBy("digest").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    spelt = checkpoint(spelt.join(digests, "digest", "left_semi"))
    shared = checkpoint(spelt.where("least <> greatest").select("digest"))
    spellings = spelt.where("least = greatest").select("digest", F.col("least").alias("term"))
    if shared.isEmpty():
        return kept, spellings
    again = numbered.mapInArrow(
        partial(_recount, digest_bits=digest_bits, bits=digest_filter(shared)),
        "lang long, source long, digest long, split string, count long, docs long",
    )
    again = again.join(shared, "digest", "left_semi").groupBy("lang", "source", "digest", "split").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    parted = kept.join(shared, "digest", "left_anti").unionByName(_often(again, least_docs))
    return checkpoint(parted), spellings


def _often(counted: DataFrame, least_docs: int) -> DataFrame:
    """The rows of terms that ``least_docs`` documents of their language hold; a term has a row for each source at most."""
    held = F.sum("docs").over(Window.partitionBy("lang", "digest", "split"))
    return counted.withColumn("held", held).where(F.col("held") >= least_docs).select("lang", "source", "digest", "split", "count")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact."""
    wide = lambda c: c.cast("decimal(26,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(SHARE).cast("decimal(10,0)"), wide(total) + 2 * wide(terms))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, below 2^62."""
    return F.call_function("div", (p - q) * (p - q), p + q)


# ---- pairs of sources ---------------------------------------------------------------------------


def _block_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """How far the sources of two blocks are apart in the terms of one block.

    Rows: a source's share ``p`` of the term (``digest``, ``split``) that it has, and for each source
    a row of ``kind`` 0 with its share of any term that it lacks. In a language's first block of terms,
    all of its terms count for those that neither source has.
    """
    lang, first, second, chunk = (k.as_py() for k in key)
    place, p = table["place"].to_numpy(), table["p"].to_numpy()
    base = table["kind"].to_numpy() == 0
    places, at = np.unique(place[base], return_index=True)
    zero = p[base][at]
    all_terms = int(table["terms"][0].as_py()) if chunk == 0 else 0
    names = pa.table([table["digest"].combine_chunks(), table["split"].combine_chunks()], names=["digest", "split"]).filter(pa.array(~base))
    code: dict[tuple, int] = {}
    column = np.fromiter((code.setdefault(name, len(code)) for name in zip(names["digest"].to_pylist(), names["split"].to_pylist())), np.int64, names.num_rows)
    shares = np.repeat(zero[:, None], len(code), 1)
    shares[np.searchsorted(places, place[~base]), column] = p[~base]
    block = places // BLOCK
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    a, b, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        others = right[places[right] > places[i]]
        d = shares[others] - shares[i]
        here = (d * d // (shares[others] + shares[i])).sum(axis=1)
        d = zero[others] - zero[i]
        nowhere = d * d // (zero[others] + zero[i])
        a.append(np.full(len(others), places[i]))
        b.append(places[others])
        value.append(here + nowhere * (all_terms - len(code)))
    a, b, value = (np.concatenate(x) for x in (a, b, value))
    return pa.table([np.full(len(a), lang, np.int64), a, b, value], names=["lang", "a", "b", "value"])


def pair_gaps(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two places a < b of sources of a language.

    ``groups``: (lang, place, zero, terms, last), ``shares``: (lang, place, digest, split, p, terms, last);
    ``last`` is the greatest place of the language.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    pair = lambda o: F.struct(F.least(o, block("place")).alias("first"), F.greatest(o, block("place")).alias("second"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), block("last")), pair)).alias("pair")
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / TERMS))
    held = shares.select("lang", pairs, F.pmod(F.xxhash64("digest", "split"), chunks).alias("chunk"), "place", F.lit(1).alias("kind"), "digest", "split", "p", "terms")
    lacking = groups.select("lang", pairs, "place", "zero", "terms").select(
        "lang", "pair", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "place", F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("digest"), F.lit(None).cast("string").alias("split"), F.col("zero").alias("p"), "terms",
    )
    blocks = held.unionByName(lacking).select("lang", "pair.first", "pair.second", "chunk", "place", "kind", "digest", "split", "p", "terms")
    sums = blocks.groupBy("lang", "first", "second", "chunk").applyInArrow(_block_sums, "lang long, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


# ---- operator -----------------------------------------------------------------------------------


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) for each language's sources.

    Part ``pair``: how far a source is from each other source of its language. Part ``term``: the
    ``top`` terms that a source uses more than its language does. Ranks start at 1, by value
    descending, then item. Null texts, languages and sources are empty; repeated rows are documents of their own;
    a language with one source has no pairs, one without kept terms only pairs of value 0; no rows
    give no rows. Other columns are ignored. ``digest_bits`` below 64 makes digests collide (for tests).
    """
    numbered, table = number_groups(docs)
    table = table.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    table = table.withColumn("last", F.max("place").over(Window.partitionBy("lang")))
    counts, spellings = kept_counts(numbered, least_docs, digest_bits)
    whole = counts.groupBy("lang", "digest", "split").agg(F.sum("count").alias("lang_count"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    none = F.lit(0).cast("long")
    groups = table.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    groups = checkpoint(groups.withColumn("zero", F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).otherwise(none + 1)))
    slim = groups.select("lang", "source", "place", "last", "terms", "total", "lang_total")
    shares = counts.join(slim, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("terms")))
    shares = checkpoint(shares.select("lang", "source", "place", "digest", "split", "count", "p", "terms", "last", "lang_total"))

    far = pair_gaps(shares, groups)
    named = groups.select("lang", "place", "lang_name", "source_name")
    other = named.select("lang", F.col("place").alias("b"), F.col("source_name").alias("item"))
    far = far.unionByName(far.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    far = far.withColumnRenamed("a", "place").join(named, ["lang", "place"]).join(other, ["lang", "b"])
    pairs = far.select(F.col("lang_name").alias("lang"), F.col("source_name").alias("source"), F.lit("pair").alias("part"), "item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    theirs = whole.select(*(F.col(c).alias(f"its_{c}") for c in ("lang", "digest", "split")), "lang_count")
    same = (F.col("lang") == F.col("its_lang")) & (F.col("digest") == F.col("its_digest")) & F.col("split").eqNullSafe(F.col("its_split"))
    q = share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    above = shares.join(theirs, same).withColumn("q", q).where("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    first = above.withColumn("tied", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("tied") <= top)
    spelt = first.select("lang", "place", "digest", "split", "value").join(spellings, "digest", "left").withColumn("item", F.coalesce("split", "term"))
    terms = spelt.join(named, ["lang", "place"]).select(F.col("lang_name").alias("lang"), F.col("source_name").alias("source"), F.lit("term").alias("part"), "item", "value")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
