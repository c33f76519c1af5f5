"""Tables whose content changes in one step: immutable folders, and a manifest that names the current ones.

A write makes a folder of its own and then a new manifest, which appears under its number by one
rename that fails if the number is taken. A reader opens the newest manifest, so it sees all of
a write or nothing of it, and a write that fails midway leaves the table as it was. Writes carry a run
name; a run that is already in the manifest changes nothing, so a job may be repeated.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIGITS = 12


class _Folder:
    """A table's folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifests(self) -> list[int]:
        found = self._fs.globStatus(self._at("manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[len("manifest-") : -len(".json")]) for f in found)

    def manifest(self, number: int) -> list[dict]:
        rows = self.spark.read.text(f"{self.path}/manifest-{number:0{DIGITS}d}.json", wholetext=True).collect()
        return json.loads(rows[0]["value"])["runs"]

    def commit(self, number: int, runs: list[dict]) -> bool:
        """Whether the manifest appeared under its number; False if another writer was first."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"runs": runs}).encode()))
        out.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        try:
            context.rename(draft, self._at(f"manifest-{number:0{DIGITS}d}.json"), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False


def current_runs(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """(number of the newest manifest, its runs); (0, []) before the first write."""
    folder = _Folder(spark, path)
    numbers = folder.manifests()
    return (numbers[-1], folder.manifest(numbers[-1])) if numbers else (0, [])


def read_versioned(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The table as its newest manifest (or that of ``version``) names it; no rows before the first write."""
    runs = current_runs(spark, path)[1] if version is None else _Folder(spark, path).manifest(version)
    folders = [f"{path.rstrip('/')}/{r['folder']}" for r in runs]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_versioned(rows: DataFrame, path: str, *, append: bool, run: str | None = None) -> int:
    """Replace the table or add to it; returns the manifest's number.

    ``rows`` may read the table itself: its folders are never changed. Writers that meet are put
    one after another. A replacing run counts as done while it is the table's only one.
    """
    spark, run = rows.sparkSession, run or uuid.uuid4().hex
    folder = _Folder(spark, path)
    number, runs = current_runs(spark, path)
    if any(r["run"] == run for r in runs):
        return number
    part = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.path}/{part}")
    while True:
        kept = runs if append else []
        if folder.commit(number + 1, [*kept, {"run": run, "folder": part}]):
            return number + 1
        number, runs = current_runs(spark, path)
        if any(r["run"] == run for r in runs):
            return number
