"""Large JSON objects read by many tasks: the text is cut at its quotes, and prefix sums tell what each cut is.

Spark's text reader cuts a file into byte ranges and each range into the pieces between quotes, on any
file system that Spark reads. Only a quote behind an odd number of backslashes belongs to a string, as
valid JSON has no backslash outside of strings. So the number of other quotes before a piece says
whether it stands in a string; the number of brackets opened and closed before it says how
deep. Both are prefix sums over the pieces: summed up in each byte range, then over the ranges.

No task sees more than a byte range. Files in which the pieces don't fit together give no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sizing import AUTO, lookup_join

SPLIT = ["path", "block"]


def quoted_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, block, place, piece): the texts between quotes, in the order of (block, place); no such path: None."""
    try:
        files = spark.read.option("lineSep", '"').text(path)
    except AnalysisException:
        return None
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"),
    )


def running_sums(rows: DataFrame, order: str, sums: dict[str, Column], strategy: str = AUTO) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over all earlier rows of the file.

    A byte range is summed up in its own task; the totals of the ranges, a row each, are then added.
    """
    rows = rows.withColumns({f"__{n}": c.cast("long") for n, c in sums.items()})
    totals = rows.groupBy(*SPLIT).agg(*(F.sum(f"__{n}").alias(f"__of_{n}") for n in sums))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*SPLIT, *(F.coalesce(F.sum(f"__of_{n}").over(earlier), F.lit(0)).alias(f"__to_{n}") for n in sums))
    inside = Window.partitionBy(*SPLIT).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in sums})
    joined = lookup_join(rows, starts, SPLIT, strategy=strategy, salts=1)
    joined = joined.withColumns({n: F.col(n) + F.col(f"__to_{n}") for n in sums})
    return joined.drop(*(f"__{n}" for n in sums), *(f"__to_{n}" for n in sums))


def json_strings(spark: SparkSession, path: str, strategy: str = AUTO) -> DataFrame | None:
    """(path, block, at, text, after): each JSON string of a file, raw, with its number and what follows up to the next one.

    The number -1 has no text, but what stands before the first string.
    """
    pieces = quoted_pieces(spark, path)
    if pieces is None:
        return None
    closes = ~F.col("piece").rlike(r"(?<!\\)(?:\\\\)*\\$")  # the quote behind it is a string's first or last
    counted = running_sums(pieces, "place", {"quotes": closes.cast("int")}, strategy)
    # quotes 2n + 1 before: in string n; 2n + 2: behind it, before the next one
    at = F.floor((F.col("quotes") - 1) / 2)
    side = F.struct("block", "place", "piece")
    inside = F.col("quotes") % 2 == 1
    grouped = counted.withColumns({"at": at, "inside": inside}).groupBy("path", "at").agg(
        F.min("block").alias("block"),
        F.sort_array(F.collect_list(F.when(F.col("inside"), side)))["piece"].alias("texts"),
        F.sort_array(F.collect_list(F.when(~F.col("inside"), side)))["piece"].alias("gaps"),
    )
    return grouped.select("path", "block", "at", F.array_join("texts", '"').alias("text"), F.array_join("gaps", '"').alias("after"))


def unescaped(raw: Column) -> Column:
    """The text that a raw JSON string stands for; null if it isn't one."""
    return F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>", {"mode": "PERMISSIVE", "allowUnescapedControlChars": "true"})[0]


def _fits(strings: DataFrame, right: Column) -> DataFrame:
    """The files of which every string is ``right``."""
    return strings.groupBy("path").agg(F.min(F.coalesce(right, F.lit(False))).alias("fits")).where("fits").select("path")


def string_map(spark: SparkSession, path: str, strategy: str = AUTO) -> DataFrame | None:
    """(path, ord, key, value) of files ``{"key": "value", ..}``, in the order of the file."""
    strings = json_strings(spark, path, strategy)
    if strings is None:
        return None
    at, after = F.col("at"), F.col("after")
    open_ = after.rlike(r"^\s*\{\s*\}?\s*$")
    key, value = (at % 2 == 0) & after.rlike(r"^\s*:\s*$"), (at % 2 == 1) & after.rlike(r"^\s*[,}]\s*$")
    text = unescaped(F.col("text"))
    strings = strings.withColumn("text", F.when(at >= 0, text))
    closed = after.contains("}")
    good = F.when(at == -1, open_).otherwise((key | value) & F.col("text").isNotNull())
    ends = strings.groupBy("path").agg(F.max_by(closed, "at").alias("closed"), F.sum(closed.cast("int")).alias("n")).where("closed and n = 1").select("path")
    pairs = strings.where("at >= 0").groupBy("path", F.floor(at / 2).alias("ord")).agg(
        F.max(F.when(at % 2 == 0, F.col("text"))).alias("key"), F.max(F.when(at % 2 == 1, F.col("text"))).alias("value")
    )
    return pairs.join(_fits(strings, good), "path", "left_semi").join(ends, "path", "left_semi")


def object_lists(spark: SparkSession, path: str, fields: list[str], strategy: str = AUTO) -> DataFrame | None:
    """(path, name, pos, fields) of files ``{"name": [{"field": "text" or null, ..}, ..], ..}``.

    Fields that an object lacks, or whose value is no string, are null; others are left out. An object
    without any field has its place, but no row; objects or lists inside one make the file unreadable.
    """
    strings = json_strings(spark, path, strategy)
    if strings is None:
        return None
    at, after, depth = F.col("at"), F.col("after"), F.col("depth")
    count = lambda pattern: F.regexp_count(after, F.lit(pattern))
    placed = running_sums(strings, "at", {
        "depth": count(r"[\[{]") - count(r"[\]}]"), "objects": count(r"\{"), "lists": count(r"\["),
    }, strategy)
    is_key = after.rlike(r"^\s*:")
    texts = placed.withColumns({"text": F.when(at >= 0, unescaped(F.col("text"))), "is_key": is_key})
    rest = r"\s*(?:[^\[\]{}:,\s]+\s*)?"  # a value that isn't a string
    shape = F.when(at == -1, after.rlike(r"^\s*\{\s*\}?\s*$")).when(
        depth == 1, F.col("is_key") & after.rlike(r"^\s*:\s*\[\s*(?:\{\s*(?:\}\s*,\s*\{\s*)*(?:\}\s*\]\s*[,}]\s*)?|\]\s*[,}]\s*)$")
    ).when(depth == 3, after.rlike(r"^\s*:\s*$|^(?:\s*:" + rest + r")?\s*(?:,|\}\s*(?:,\s*\{|\]\s*[,}]))?\s*$")).otherwise(F.lit(False))
    good = _fits(texts, shape & ((at == -1) | F.col("text").isNotNull()))
    names = texts.where((depth == 1) & (at >= 0)).select(
        "path", (F.col("lists") + 1).alias("lists"), F.col("text").alias("name"), F.col("objects").alias("before")
    )
    own = texts.where(depth == 3).join(good, "path", "left_semi")
    # a key and the string behind it, if its value is one
    pairs = own.select("path", F.when(F.col("is_key"), at).otherwise(at - 1).alias("field"), "is_key", "text", "objects", "lists")
    pairs = pairs.groupBy("path", "field", "objects", "lists").agg(
        F.max(F.when(F.col("is_key"), F.col("text"))).alias("key"), F.max(F.when(~F.col("is_key"), F.col("text"))).alias("value")
    )
    entries = pairs.groupBy("path", "lists", "objects").agg(*(F.max(F.when(F.col("key") == f, F.col("value"))).alias(f) for f in fields))
    named = lookup_join(entries, names, ["path", "lists"], strategy=strategy)
    return named.select("path", "name", (F.col("objects") - F.col("before") - 1).alias("pos"), *fields)
