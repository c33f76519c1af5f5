"""Read and write the reference tables: schemes, FAQs, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.localization import keepable
from ..schemas import DICTIONARY, FAQ, FAQ_ENTRY, SCHEME
from .json_objects import object_lists, string_map
from .versions import read_versioned, write_versioned


VERSIONED = "versioned"


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = VERSIONED) -> DataFrame:
    """A table in one of Spark's formats, or (``VERSIONED``) as ``reload`` and ``append`` keep it."""
    if fmt == VERSIONED:
        return read_versioned(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def read_schemes(spark: SparkSession, path: str, fmt: str = VERSIONED) -> DataFrame:
    """The whole catalog, ids as strings."""
    return read_table(spark, path, SCHEME, fmt)


def read_faqs(spark: SparkSession, path: str, fmt: str = VERSIONED) -> DataFrame:
    """FAQs; storage ids are not in the schema and so are never read."""
    return read_table(spark, path, FAQ, fmt)


def read_faq_map(spark: SparkSession, path: str) -> DataFrame:
    """S3: files of ``{lang: [faq, ..]}`` to rows (lang, pos, question, answer, category, scheme).

    A file of any size is read by as many tasks as it has byte ranges. A missing path or a file that
    isn't such an object gives no rows.
    """
    fields = [f.name for f in FAQ_ENTRY.fields]
    rows = object_lists(spark, path, fields)
    if rows is None:
        empty = T.StructType([T.StructField("lang", T.StringType()), T.StructField("pos", T.LongType()), *FAQ_ENTRY.fields])
        return spark.createDataFrame([], empty)
    return rows.select(F.col("name").alias("lang"), F.col("pos").cast("bigint").alias("pos"), *fields)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``{"lang:text": target}`` and ``{"to_en:text": target}`` files as dictionary rows.

    A file of any size is read by as many tasks as it has byte ranges. A missing path or a file that
    isn't an object of texts gives no rows.
    """
    rows = string_map(spark, path)
    if rows is None:
        return spark.createDataFrame([], DICTIONARY)
    head = F.substring_index("key", ":", 1)
    reverse = head == "to_en"
    return rows.where(F.col("key").contains(":")).select(
        F.when(reverse, "to_en").otherwise("from_en").alias("direction"),
        F.when(~reverse, head).alias("lang"),
        F.expr("substr(key, instr(key, ':') + 1)").alias("source"),
        F.col("value").alias("target"),
        F.col("ord").cast("bigint").alias("ord"),
    )


def get_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row per requested key, with ``found`` false for keys the table lacks."""
    marked = table.withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(marked, key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def reload(rows: DataFrame, path: str, fmt: str = VERSIONED, run: str | None = None) -> None:
    """Replace the table. As a versioned table it changes in one step, a repeated ``run`` changes
    nothing, and ``rows`` may read the table; in another format it is overwritten."""
    if fmt == VERSIONED:
        write_versioned(rows, path, append=False, run=run)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def append(rows: DataFrame, path: str, fmt: str = VERSIONED, run: str | None = None) -> None:
    """Add rows, in one step and once for each ``run`` if the table is versioned."""
    if fmt == VERSIONED:
        write_versioned(rows, path, append=True, run=run)
    else:
        rows.write.mode("append").format(fmt).save(path)


def storable(dictionary: DataFrame) -> DataFrame:
    """S9's filter: no empty and no error targets."""
    return dictionary.where(keepable("target"))


def write_dictionary(dictionary: DataFrame, path: str, fmt: str = VERSIONED, run: str | None = None) -> None:
    """Replace the stored dictionary with the storable rows."""
    reload(storable(dictionary), path, fmt, run)
