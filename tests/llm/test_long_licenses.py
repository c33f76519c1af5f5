"""Operator 9: licences in very long texts, against its SQL on planted cases, and rows without an id."""

import time

import duckdb
import numpy as np

from entitlekit.llm import licenses
from entitlekit.llm.oracle import ORACLE_SQL


def _prose(seed, lines, per=9):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join(f"w{k}" for k in rng.integers(0, 4000, per)) for _ in range(lines))


def _rows():
    mit, header = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-header"]
    return [
        (1, _prose(1, 700) + "\n" + mit + "\n" + _prose(2, 700)), (2, (header + "\n") * 30), (3, _prose(3, 200) + ". " + " ".join(mit.split()) + " " + _prose(4, 90)),
        (4, _prose(5, 100) + "\n" + mit[: len(mit) // 2] + "\n" + _prose(6, 100)), (5, None), (6, ""), (7, "word"), (8, "\n".join(mit.split())),
        (None, _prose(7, 50) + "\n" + header), (1, _prose(8, 30)), (9, _prose(9, 41, 1) + "\n" + header + "\n" + mit),
    ]


def test_stretches_agree_with_sql(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    got = licenses.licenses_of(docs, licenses.templates_table(spark)).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", _rows())
    wanted = con.execute(ORACLE_SQL["op9_license_scan"]).fetchall()
    rows = sorted(map(repr, ((d, n, names, best, round(x, 9) if best else None) for d, n, names, best, x in wanted)))
    mine = ((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_licenses, r.licenses, r.best_license, round(r.best_dice, 9) if r.best_license else None) for r in got.itertuples())
    assert sorted(map(repr, mine)) == rows
    by_id = {r.doc_id: r.licenses.split(",") for r in got.itertuples() if r.doc_id not in (1,)}
    assert "mit" in by_id[3] and "mit" in by_id[8] and "apache-2.0-header" in by_id[2] and {"mit", "apache-2.0-header"} <= set(by_id[9])
    assert by_id[4] == [""] and "apache-2.0-header" in got[got.doc_id.isna()].licenses.iloc[0].split(",")


def test_a_text_of_a_million_words(spark):
    text = _prose(11, 55_000) + "\n" + licenses.TEMPLATES["mit"] + "\n" + _prose(12, 55_000)
    docs = spark.createDataFrame([(1, "warm " * 30), (2, text)], "doc_id long, text string").repartition(2)
    started = time.monotonic()
    got = {r["doc_id"]: r["licenses"] for r in licenses.licenses_of(docs, licenses.templates_table(spark)).collect()}
    assert got == {1: "", 2: "mit"}
    assert time.monotonic() - started < 60


def test_only_texts_that_hold_a_licence_are_cut(spark, tmp_path):
    mit, notice = licenses.TEMPLATES["mit"], licenses.TEMPLATES["mit-notice"]
    rows = [(k, _prose(k, 20)) for k in range(40)] + [(50, "x. " + notice + " y"), (51, _prose(51, 9) + "\n" + mit), (52, mit[: len(mit) // 2]), (53, None), (None, notice)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    scanned = licenses.licenses_of(docs, licenses.templates_table(spark))
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2  # the texts are read once, the ids once more
    assert not any("Filter" in line and "xxhash64" in line for line in plan.split("\n"))  # no bigrams made twice to filter by them
    assert {r["doc_id"]: r["licenses"] for r in scanned.collect() if r["licenses"]} == {50: "mit-notice", 51: "mit", None: "mit-notice"}
