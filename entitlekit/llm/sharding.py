"""Operator 12: shards of near equal bytes by histogram sort, in DataFrame functions alone.

Rows are ordered by a key of fixed-width digits: the hash of the text (so that copies are neighbours and
the order is an even one), the id, and the row's place in the stored table, which tells repeated rows
apart. Splitters cut this order into shards. A round counts the exact bytes and rows below candidate
boundaries, for all splitters at once: the candidates are the next ``DIGITS`` hexadecimal digits after the prefix
known so far, so each round only reads the rows that share a prefix with an open splitter. A splitter
is settled at the first (shortest) boundary within the tolerance of its target, or where one row is
left to either side. Then rows are exchanged once, into ranges that are parts of shards: the counts below
each range are known by then, so a row's slot in its shard is the rows below its range plus its place in it.

The driver sees at most 16 ** DIGITS counts for each open splitter; the number of ranges has a bound.
A key prefix that holds a third of all rows is refined further, by id and by place, so no group of
copies has to fit into one shard or task.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import checkpoint

SHARDS = 40
TOLERANCE = 0.001  # of a shard's bytes, for its splitters
RANGE_TOLERANCE = 0.25  # of a range's bytes, for the cuts inside a shard
RANGE_BYTES = 128 << 20  # of a range, by the counted sizes ...
LEAST_RANGES, MOST_RANGES = 4, 64  # ... between so many ranges a shard
ROW_BYTES = 16  # what a row counts beside its text
DIGITS = 2  # hexadecimal digits that a round adds
KEY_DIGITS = 48


def _hex(number: Column) -> Column:
    """16 digits whose order is that of the signed number."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def with_key(rows: DataFrame, group: str, id: str) -> DataFrame:
    """``rows`` stored in the shared folder, with ``sort_key``: group, id and place as ``KEY_DIGITS`` digits.

    A stored row keeps its place however often its partition is computed, so keys never change.
    """
    stored = checkpoint(rows)
    order = F.concat(_hex(F.col(group)), _hex(F.coalesce(F.col(id).cast("long"), F.lit(-(2**63)))), _hex(F.monotonically_increasing_id()))
    return stored.withColumn("sort_key", order)


def _below(keyed: DataFrame, weight: str, prefixes: list[str], depth: int) -> dict[str, list[tuple[str, int, int]]]:
    """For each prefix its longer prefixes by ``DIGITS`` digits: (prefix, bytes, rows), ascending."""
    rows = keyed if depth == 0 else keyed.where(F.substring("sort_key", 1, depth).isin(prefixes))
    counts = rows.groupBy(F.substring("sort_key", 1, depth + DIGITS).alias("prefix")).agg(F.sum(weight).alias("bytes"), F.count("*").alias("rows"))
    found: dict[str, list] = {}
    for prefix, size, n in sorted(map(tuple, counts.collect())):
        found.setdefault(prefix[:depth], []).append((prefix, size, n))
    return found


def find_splitters(keyed: DataFrame, weight: str, targets: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(boundary, bytes below, rows below) near each (target bytes, tolerance); targets ascend.

    A boundary is a key prefix; keys that sort before it are below.
    """
    settled: dict[int, tuple[str, int, int]] = {}
    open_at = {i: ("", 0, 0) for i in range(len(targets))}  # the prefix that holds the target, and what is below it
    for depth in range(0, KEY_DIGITS, DIGITS):
        if not open_at:
            break
        found = _below(keyed, weight, sorted({p for p, _, _ in open_at.values()}), depth)
        for i, (prefix, size, n) in list(open_at.items()):
            target, tolerance = targets[i]
            bins = found[prefix]
            sizes = list(accumulate((b[1] for b in bins), initial=size))
            rows = list(accumulate((b[2] for b in bins), initial=n))
            at = max(0, min(bisect_right(sizes, target) - 1, len(bins) - 1))  # the bin that holds the target
            edges = [(abs(sizes[k] - target), k) for k in (at, at + 1)]
            gap, edge = min(edges)
            if gap <= tolerance or bins[at][2] == 1 or depth + DIGITS >= KEY_DIGITS:
                boundary = bins[edge][0] if edge < len(bins) else bins[-1][0] + "g"  # after all keys of the last bin
                settled[i] = (boundary, sizes[edge], rows[edge])
                del open_at[i]
            else:
                open_at[i] = (bins[at][0], sizes[at], rows[at])
    ordered, last = [], ("", 0, 0)
    for i in range(len(targets)):  # boundaries of close targets may coincide, never cross
        last = max(last, settled[i], key=lambda s: s[0])
        ordered.append(last)
    return ordered


def _interval(boundaries: list[str], lo: int = 0) -> Column:
    """The number of boundaries at or below the key, by a balanced tree of comparisons."""
    if not boundaries:
        return F.lit(lo)
    middle = len(boundaries) // 2
    above = _interval(boundaries[middle + 1 :], lo + middle + 1)
    return F.when(F.col("sort_key") < boundaries[middle], _interval(boundaries[:middle], lo)).otherwise(above)


def shard_by_bytes(
    rows: DataFrame, weight: str = "size", group: str = "text_hash", id: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """All ``rows`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    The bytes of each shard differ from the mean by at most ``tolerance`` of it on either side, unless one row is
    larger than that. Rows of one ``group`` (a long) are neighbours and are parted only where the
    tolerance asks for it; null ids come before all others; repeated rows are told apart by their
    place. Fewer rows than shards leave some empty; no rows give no rows. Columns of the input named
    ``shard``, ``slot``, ``range`` or ``sort_key`` are left out.
    """
    keyed = with_key(rows.drop("shard", "slot", "range", "sort_key"), group, id)
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    parts = max(LEAST_RANGES, min(MOST_RANGES, -(-total // (shards * RANGE_BYTES))))
    fine, coarse = int(total * tolerance / shards / 2), int(total * RANGE_TOLERANCE / shards / parts)
    ends = [(total * i // (shards * parts), coarse if i % parts else fine) for i in range(1, shards * parts)] if total else []
    splitters = find_splitters(keyed, weight, ends)
    below = [0, *(s[2] for s in splitters)]
    # the rows below each range that lie in its shard
    inside = [below[i] - below[i - i % parts] for i in range(len(below))]
    ranged = keyed.withColumn("range", _interval([s[0] for s in splitters]))
    dealt = ranged.repartitionById(shards * parts, F.col("range"))
    place = F.row_number().over(_by_range())
    start = F.get(F.array(*(F.lit(n).cast("long") for n in inside)), F.col("range"))
    return dealt.withColumns({
        "shard": (F.col("range") / parts).cast("int"), "slot": start + place - 1,
    }).drop("range", "sort_key")


def _by_range():
    from pyspark.sql import Window

    return Window.partitionBy("range").orderBy("sort_key")


def document_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, the columns to ``keep``) of every document; null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *keep,
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """The documents as Parquet in ``folder``, a subfolder for each shard, in the order of their slots; returns them as stored.

    Texts are stored once before they are exchanged, as their places are part of the order.
    """
    dealt = shard_by_bytes(document_sizes(docs, "text"), shards=shards)
    dealt.write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
