import json

from pyspark.sql import functions as F

from entitlekit.operators import maintenance as m
from entitlekit.operators.ranking import last_write_wins
from entitlekit.plans import standins
from entitlekit.schemas import DICTIONARY, FAQ, SCHEME
from entitlekit.sources import catalog
from entitlekit.streaming.eligibility import stream_eligibility
from entitlekit.streaming.upserts import compact_profiles, current_profiles, read_log, upsert_batch
from conftest import SF_DIR
from test_eligibility import make_scheme


def test_patches_fold_and_repeat(spark):
    changes = spark.createDataFrame(
        [(1, 1, "a", None), (1, 2, None, "r2"), (1, 3, "c", None), (9, 1, "z", None)], "id long, ts long, name string, role string")
    base = spark.createDataFrame([(1, "n", "r"), (2, "m", "s")], "id long, name string, role string")
    patches = m.fold_patches(changes, "id", ["ts"], ["name", "role"])
    once, missing = m.update_fields(base, patches, "id", ["name", "role"])
    twice, _ = m.update_fields(once, patches, "id", ["name", "role"])
    assert sorted(map(tuple, once.collect())) == [(1, "c", "r2"), (2, "m", "s")]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert [r.id for r in missing.collect()] == [9]


def test_insert_if_absent(spark):
    base = spark.createDataFrame([("a", 0)], "email string, n long")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("", 4), (None, 5)], "email string, n long")
    merged, rejects = m.insert_if_absent(base, new, "email", ["n"])
    assert sorted(map(tuple, merged.collect())) == [("a", 0), ("b", 2)]
    assert sorted((r.n, r.reason) for r in rejects.collect()) == [
        (1, "already exists"), (3, "already exists"), (4, "key required"), (5, "key required"),
    ]


def test_hot_key_keeps_the_newest(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("ts"))
    assert sorted(map(tuple, last_write_wins(rows, ["k"], ["ts"]).collect())) == [(0, 2999), (1, 2997)]


def test_nested_values(spark):
    users = standins.users(spark, SF_DIR).where("user_id < 3")
    doc = users.select(F.lit(1).cast("bigint").alias("user_id"), F.lit("income").alias("doc_key"),
                       F.col("documents")["aadhaar"].alias("document")).limit(1)
    got = {r.user_id: r.documents for r in m.update_nested(users, doc).collect()}
    assert got[1]["income"].extracted_data.dob == "1990-01-01" and set(got[1]) == {"aadhaar", "income", "caste"}
    assert got[2]["income"].extracted_data.dob is None
    replayed = doc.withColumn("ts", F.lit(1)).unionByName(
        doc.select("user_id", "doc_key", F.lit(None).cast(doc.schema["document"].dataType).alias("document"), F.lit(2).alias("ts")))
    newest = {r.user_id: r.documents for r in m.update_nested(users, replayed, order=["ts"]).collect()}
    assert newest[1]["income"] is None
    renamed = users.withColumn("profile", m.set_nested(F.col("profile"), "name", F.lit("x")))
    assert {r.profile.name for r in renamed.collect()} == {"x"}
    keys = spark.createDataFrame([(0,), (77,)], "user_id long")
    unset, missing = m.unset_fields(users, keys)
    row = unset.where("user_id = 0").first()
    assert row.documents is None and row.profile.address is None and row.profile.age is not None
    assert [r.user_id for r in missing.collect()] == [77]
    row = m.clear_fields(users, keys).where("user_id = 0").first()
    assert row.documents == {} and row.profile.name == "" and row.profile.address == "1 Road"


def test_sources_round_trip(spark, tmp_path):
    schemes = spark.createDataFrame([make_scheme(1, "Goa", min_age=3)], SCHEME)
    path = str(tmp_path / "schemes")
    catalog.reload(schemes, path)
    catalog.append(spark.createDataFrame([make_scheme(2)], SCHEME), path)
    assert catalog.read_schemes(spark, path).count() == 2
    catalog.reload(schemes, path)
    assert catalog.read_schemes(spark, path).first().rules.min_age == 3
    catalog.reload(schemes, str(tmp_path / "json"), "json")
    assert catalog.read_schemes(spark, str(tmp_path / "json"), "json").first().rules.min_age == 3
    faqs = spark.createDataFrame([(1, "q", "a", "c", "s", None)], FAQ)
    catalog.reload(faqs, str(tmp_path / "faqs"))
    assert catalog.read_faqs(spark, str(tmp_path / "faqs")).first().question == "q"
    found = catalog.get_by_key(schemes, spark.createDataFrame([("1",), ("9",)], "scheme_id string"), "scheme_id")
    assert {r.scheme_id: r.found for r in found.collect()} == {"1": True, "9": False}


def test_language_files(spark, tmp_path):
    faq_file = tmp_path / "map.json"
    faq_file.write_text(json.dumps({"en": [{"question": "q1", "answer": "a"}, {"question": "q2"}], "hi": [{"question": "h"}]}))
    rows = catalog.read_faq_map(spark, str(faq_file)).collect()
    assert sorted((r.lang, r.pos, r.question) for r in rows) == [("en", 0, "q1"), ("en", 1, "q2"), ("hi", 0, "h")]
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps({"hi:a: b": "x", "to_en:क:ख": "k", "hi:e": "Error 500", "hi:z": ""}))
    dictionary = catalog.read_dictionary(spark, str(cache))
    kept = {(r.direction, r.lang, r.source): r.target for r in catalog.storable(dictionary).collect()}
    assert kept == {("from_en", "hi", "a: b"): "x", ("to_en", None, "क:ख"): "k"}
    catalog.write_dictionary(dictionary, str(tmp_path / "stored"))
    assert catalog.read_table(spark, str(tmp_path / "stored"), DICTIONARY).count() == 2
    (tmp_path / "bad.json").write_text("{not json")
    assert catalog.read_dictionary(spark, str(tmp_path / "bad.json")).count() == 0
    assert catalog.read_dictionary(spark, str(tmp_path / "none.json")).count() == 0


def test_replayed_batches_change_nothing(spark, tmp_path):
    users = standins.users(spark, SF_DIR)
    events = standins.profile_changes_of(standins.table(spark, SF_DIR, "events"))
    write = upsert_batch(f"{tmp_path}/log", "user_id", ["ts"])
    parts = [events.where("ts < '2024-01-10'"), events.where("ts >= '2024-01-10'")]
    for batch_id, part in enumerate(parts):
        write(part, batch_id)
    once = sorted(map(str, current_profiles(users, read_log(spark, f"{tmp_path}/log")).collect()))
    write(parts[1], 1)
    assert sorted(map(str, current_profiles(users, read_log(spark, f"{tmp_path}/log")).collect())) == once
    compact_profiles(users, read_log(spark, f"{tmp_path}/log"), f"{tmp_path}/base")
    assert spark.read.parquet(f"{tmp_path}/base").count() == users.count()


def test_stream_needs_no_state(spark):
    stream = spark.readStream.format("rate").load().selectExpr(
        "value as profile_id", "value as age", "value as income", "'goa' as state", "'' as category",
        "'' as gender", "'' as special_category")
    matched = stream_eligibility(stream, spark.createDataFrame([make_scheme(1)], SCHEME), display=True)
    assert matched.isStreaming and "match_score" in matched.columns


def test_tied_and_repeated_new_rows_are_accepted_or_rejected(spark):
    base = spark.createDataFrame([("old", "x", 0)], "email string, name string, at int")
    rows = [("a", "p", 1), ("a", "q", 1), ("a", "q", 1), ("b", "r", 2), ("b", "r", 2), (None, "s", 3), ("old", "t", 4)]
    merged, rejects = m.insert_if_absent(base, spark.createDataFrame(rows, base.schema), "email", ["at"])
    assert sorted(r["email"] for r in merged.collect()) == ["a", "b", "old"]
    assert sorted(str(r["email"]) for r in rejects.collect()) == ["None", "a", "a", "b", "old"]


def test_repeated_changes_of_a_key_never_multiply_its_row(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "id long, name string, role string")
    rows = [(1, "m", None, 1), (1, "k", "r", 2), (1, None, "q", 3), (1, "m", None, 1), (None, "n", "n", 1), (9, "o", None, 1)]
    changes = spark.createDataFrame(rows, "id long, name string, role string, at int")
    greatest, missing = m.update_fields(base, changes, "id", ["name", "role"])
    assert sorted(map(tuple, greatest.where("id is not null").collect())) == [(1, "m", "r"), (2, "b", "y")]
    newest, _ = m.update_fields(base, changes, "id", ["name", "role"], order=["at"])
    assert sorted(map(tuple, newest.where("id is not null").collect())) == [(1, "k", "q"), (2, "b", "y")]
    assert newest.count() == 3


def test_repeated_document_changes_without_an_order(spark):
    users = standins.users(spark, SF_DIR).where("user_id = 1")
    entry = users.select("user_id", F.lit("income").alias("doc_key"), F.col("documents")["income"].alias("document"))
    changes = entry.withColumn("document", F.col("document").withField("confidence", F.lit(7))).unionByName(entry)
    once = m.update_nested(users, changes.union(changes)).first()
    assert set(once.documents) == {"aadhaar", "income", "caste"} and once.documents["income"].confidence in (1, 7)
