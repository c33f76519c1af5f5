"""A training corpus from ``documents``: five stages, each stored as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, documents contaminated by the
benchmark go, secrets are masked, and what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitlekit.llm import decontamination, minhash, packing, secrets, toxicity
from entitlekit.llm.common import read, small_batches, work_folder

#: No SQL: the classifier of the first stage is fitted.
ORACLE_SQL = None

#: So many numbers of rows, 8 bytes each, are sent to every task.
MOST_SENT = 1_000_000


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic. It learns from the stored documents.

    Each row is judged by its whole text alone, so rows without an id and repeated rows are judged like
    others. A null or empty text scores what a text without known words does. A score of exactly 0.5
    goes. Columns of any name are kept as they are, and an empty table gives an empty table.
    """
    small_batches(spark)
    labels = read(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.train(read(spark, sf_dir, "documents"), labels)
    score = _free(docs, "toxic_score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the least id, rows without an id last.

    Rows are told apart by a number of their own, so unlike texts of one id, or without an id, are judged
    each by its text, and rows that repeat are copies of each other. Among equal ids the hash of the text
    decides, then the number. Null texts and others without words are nobody's copies: all of them stay.
    Columns of any name are kept as they are, and an empty table gives an empty table.

    The rows are stored with their numbers. If at most ``MOST_SENT`` rows go, their numbers are sent to
    all tasks and no text is moved; otherwise rows are joined by their number, which is no row's but its own.
    """
    small_batches(spark)
    folder, key = f"{work_folder(spark)}/rows-{uuid.uuid4().hex}", _free(docs, "row_key")
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    classes = minhash.near_classes(rows.select(F.col(key).alias("doc_id"), "text"))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.col(key).alias("d"))
    places = rows.select(F.col(key).alias("member"), place.alias("place"))
    classes = classes.select(F.col("doc_id").alias("member"), "class_id")
    kept = classes.join(places, "member").groupBy("class_id").agg(F.min("place").alias("first"))
    gone = classes.join(kept.select("class_id", F.col("first.d").alias("kept")), "class_id").where("member <> kept")
    gone.select("member").write.parquet(f"{folder}/gone")
    gone = spark.read.parquet(f"{folder}/gone")
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    return rows.join(gone, rows[key] == gone["member"], "left_anti").drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark passages.

    Each row is judged by its whole text, so rows without an id and repeated rows are judged like others.
    A null or empty text has no words and stays; exactly a twentieth goes. Columns of any name are kept as
    they are, and an empty table gives an empty table.
    """
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where there were any.

    Rows without an id and repeated rows are masked like others. A null or empty text stays as it is.
    Columns of other names are kept as they are, and an empty table gives an empty table.
    """
    small_batches(spark)
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: every row of ``docs`` is cut into pieces that hold each of its ids once.

    A null or empty text is one piece of the closing id alone. Rows that repeat, or have no id, are packed
    each. Other columns are left out, and an empty table gives no pieces.
    """
    small_batches(spark)
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    folder = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
