import pytest
from pyspark.sql import functions as F

from entitlekit.operators import localization as l
from entitlekit.schemas import DICTIONARY, PROPER_NOUNS, SCHEME
from test_eligibility import make_scheme

LONG = "w" * 101


@pytest.fixture(scope="module")
def tables(spark):
    dictionary = spark.createDataFrame(
        [("from_en", "hi", "Visit office", "HI-VISIT", 1), ("from_en", "hi", "visit OFFICE", "HI-OTHER", 2),
         ("from_en", "hi", "apply", "HI-APPLY", 3), ("from_en", "ta", "apply", "TA-APPLY", 4),
         ("from_en", "hi", "Goa", "WRONG", 5), ("from_en", "hi", f"{LONG}. whole", "HI-WHOLE", 6)], DICTIONARY)
    nouns = spark.createDataFrame([("Goa", "hi", "HI-GOA")], PROPER_NOUNS)
    return dictionary, nouns


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_localize(spark, tables, strategy):
    cases = [
        (1, "hi", " Visit office ", "HI-VISIT"), (2, "hi", "VISIT OFFICE", "HI-VISIT"), (3, "hi", "APPLY", "HI-APPLY"),
        (4, "ta", "apply", "TA-APPLY"), (5, "en", "apply", "apply"), (6, "hi", "Goa", "HI-GOA"),
        (7, "hi", f"{LONG}. apply. Goa", f"{LONG}. HI-APPLY. HI-GOA"), (8, "hi", f"{LONG}\n apply \n\nGoa. x", f"{LONG}\nHI-APPLY\nGoa. x"),
        (9, "hi", " kept ", " kept "), (10, "hi", "", ""), (11, "hi", None, None),
    ]
    # one fragment holds a third of all rows
    cases += [(100 + i, "hi", "apply", "HI-APPLY") for i in range(6)]
    rows = spark.createDataFrame([c[:3] for c in cases], "text_id long, lang string, text string")
    got = l.localize(rows, ["text_id"], *tables, strategy=strategy)
    assert {r.text_id: r.localized for r in got.collect()} == {c[0]: c[3] for c in cases}


def test_empty_dictionary_keeps_texts(spark):
    rows = spark.createDataFrame([(1, "hi", " a "), (2, "hi", f"{LONG}.  b . c")], "text_id long, lang string, text string")
    empty = spark.createDataFrame([], DICTIONARY)
    got = {r.text_id: r.localized for r in l.localize(rows, ["text_id"], empty).collect()}
    assert got == {1: " a ", 2: f"{LONG}. b. c"}


def test_localize_one(spark, tables):
    cases = [(1, "hi", f"{LONG}. whole", "HI-WHOLE"), (2, "hi", f"{LONG}. apply", f"{LONG}. HI-APPLY"),
             (3, "hi", "APPLY", "APPLY"), (4, "hi", "Goa", "WRONG"), (5, "en", "apply", "apply")]
    rows = spark.createDataFrame([c[:3] for c in cases], "text_id long, lang string, text string")
    got = l.localize_one(rows, ["text_id"], *tables)
    assert {r.text_id: r.localized for r in got.collect()} == {c[0]: c[3] for c in cases}


def test_localize_catalog(spark, tables):
    dictionary, nouns = tables
    more = dictionary.unionByName(spark.createDataFrame(
        [("from_en", "hi", "All Categories", "HI-ALL", 7), ("from_en", "hi", "Female", "HI-F", 8)], DICTIONARY))
    scheme = {**make_scheme(1, "Goa", allowed_categories=["all"], gender=["female", "male"]), "name": "Apply"}
    row = l.localize_catalog(spark.createDataFrame([scheme], SCHEME), "hi", more, nouns).first()
    assert (row.name, row.state, row.rules.allowed_categories, row.rules.gender, row.rules.special_category) == (
        "HI-APPLY", "HI-GOA", ["HI-ALL"], ["HI-F", "Male"], None,
    )


def test_worklist_and_merge(spark, tables):
    fragments = spark.createDataFrame(
        [("hi", f"new text {i}") for i in range(45)] + [("hi", "apply"), ("hi", " new text 1 ")], "lang string, fragment string")
    missing = l.untranslated(fragments, *tables)
    assert missing.count() == 45
    groups = l.worklist(missing)
    rows = sorted(groups.collect(), key=lambda r: r.batch)
    assert [len(r.fragments) for r in rows] == [10, 10, 10, 10, 5]  # only the last group holds fewer
    assert [f for r in rows for f in r.fragments] == sorted(r.fragment for r in missing.collect())
    assert all(r.request.startswith("Title: ") for r in groups.collect())
    replies = groups.withColumn("reply", F.array_join(F.transform("fragments", lambda f: F.concat(F.lit('title: "'), F.upper(f), F.lit('"'))), "\n\n"))
    merged = {r.source: r.target for r in l.merge_translations(replies).collect()}
    assert len(merged) == 45 and merged["new text 7"] == "NEW TEXT 7"
    bad = groups.withColumn("reply", F.lit("only one"))
    assert l.merge_translations(bad.where(F.size("fragments") > 1)).count() == 0
    assert l.merge_translations(groups.withColumn("reply", F.col("request"))).count() == 0
