"""Global positions, split JSON objects, versioned tables, keyed streaming state, one-pass routes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from entitlekit.operators import containment, routing
from entitlekit.operators.filters import count_in, count_sketch, in_filter, key_filter
from entitlekit.operators.positions import with_positions
from entitlekit.plans import standins
from entitlekit.schemas import SCHEME
from entitlekit.sources import catalog, json_objects, versions
from entitlekit.streaming.upserts import read_log, stream_current
from test_eligibility import make_scheme


# ---- positions -----------------------------------------------------------------------------------


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_positions_are_gapless_in_each_group(spark, strategy):
    groups = [None, "", "a", "b"]
    rows = [(groups[min(3, i % 7)], (i * 37) % 101, i) for i in range(500)]  # "b" holds most
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = with_positions(df, ["x", "i"], ["g"], strategy=strategy).collect()
    for g in groups:
        mine = sorted((r["x"], r["i"]) for r in got if r["g"] == g)
        assert {(r["x"], r["i"]): r["position"] for r in got if r["g"] == g} == {k: n for n, k in enumerate(mine)}


def test_positions_without_groups_and_of_nothing(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    got = with_positions(df, ["x", F.desc("id")]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == sorted(range(1000), key=lambda i: (i % 10, -i))
    assert with_positions(df.where("id < 0"), ["x"]).collect() == []
    ties = with_positions(spark.createDataFrame([(1,)] * 20, "x int"), ["x"]).collect()
    assert sorted(r["position"] for r in ties) == list(range(20))


# ---- JSON objects --------------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _odd_text(rng, n):
    return "".join(rng.choice(['a', '"', "\\", "é", "\n", ":", "{", "}", ",", '\\"', " ", "[", "]", "日"]) for _ in range(rng.randint(0, n)))


STYLES = [{"indent": 2}, {}, {"ensure_ascii": False}, {"separators": (",", ":")}]


@pytest.mark.parametrize("style", STYLES)
@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_large_map_is_read_in_splits(spark, small_splits, tmp_path, style, strategy):
    rng = random.Random(3)
    entries = {f"k{i}{_odd_text(rng, 5)}": _odd_text(rng, 25) for i in range(800)}
    path = tmp_path / "map.json"
    path.write_text(json.dumps(entries, **style), encoding="utf-8")
    assert json_objects.quoted_pieces(spark, str(path)).rdd.getNumPartitions() > 2
    rows = json_objects.string_map(spark, str(path), strategy).orderBy("ord").collect()
    assert [(r["key"], r["value"]) for r in rows] == list(entries.items())


@pytest.mark.parametrize("style", STYLES)
def test_large_faq_map_is_read_in_splits(spark, small_splits, tmp_path, style):
    rng = random.Random(4)
    names = ["question", "answer", "category", "scheme", "other"]

    def entry():
        return {n: None if rng.random() < 0.1 else _odd_text(rng, 12) for n in rng.sample(names, rng.randint(1, 5))}

    faqs = {"en": [entry() for _ in range(200)], "hi": [], 't"a': [entry() for _ in range(90)], "te": [entry()]}
    path = tmp_path / "faqs.json"
    path.write_text(json.dumps(faqs, **style), encoding="utf-8")
    got = {(r["lang"], r["pos"]): (r["question"], r["answer"], r["category"], r["scheme"]) for r in catalog.read_faq_map(spark, str(path)).collect()}
    assert got == {(lang, i): tuple(e.get(n) for n in names[:4]) for lang, es in faqs.items() for i, e in enumerate(es)}


@pytest.mark.parametrize("text", ["", "{", "{}", '{"a": 1}', '{"a":"b"', '{"a":"b"}}', "no", '{"a":"b",}', '{"a" "b"}', '["a"]', '{"a":"b"} x', '{"a":"\\x"}'])
def test_bad_files_give_no_rows(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text('{"hi:a": "b"}')
    assert json_objects.string_map(spark, str(tmp_path / "bad.json")).collect() == []
    assert json_objects.object_lists(spark, str(tmp_path / "bad.json"), ["q"]).collect() == []
    assert [r["source"] for r in catalog.read_dictionary(spark, str(tmp_path)).collect()] == ["a"]  # the other file still counts


# ---- versioned tables ----------------------------------------------------------------------------


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert catalog.read_schemes(spark, path).count() == 0
    catalog.reload(spark.createDataFrame([make_scheme(1)], SCHEME), path)
    broken = spark.createDataFrame([make_scheme(2)], SCHEME).withColumn("pos", F.raise_error(F.lit("midway")).cast("long"))
    with pytest.raises(Exception, match="midway"):
        catalog.reload(broken, path)
    with pytest.raises(Exception, match="midway"):
        catalog.append(broken, path)
    assert [r["pos"] for r in catalog.read_schemes(spark, path).collect()] == [1]


def test_runs_count_once_and_may_read_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    for _ in range(3):
        catalog.append(spark.createDataFrame([make_scheme(1)], SCHEME), path, run="first")
    twice = catalog.read_schemes(spark, path).withColumn("pos", F.col("pos") + 10)
    catalog.append(twice, path)
    assert sorted(r["pos"] for r in catalog.read_schemes(spark, path).collect()) == [1, 11]
    catalog.reload(catalog.read_schemes(spark, path).where("pos > 1"), path)
    assert [r["pos"] for r in catalog.read_schemes(spark, path).collect()] == [11]
    assert versions.read_versioned(spark, path, SCHEME, version=1).count() == 1


def test_writers_that_meet_are_put_in_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    catalog.append(spark.createDataFrame([make_scheme(1)], SCHEME), path)
    real, calls = versions._Folder.commit, []

    def late(self, number, runs):
        if not calls:  # another writer commits between this one's reading and its rename
            calls.append(number)
            real(self, number, [*versions.current_runs(spark, path)[1], {"run": "other", "folder": "data-other"}])
            spark.createDataFrame([make_scheme(2)], SCHEME).write.parquet(f"{path}/data-other")
        return real(self, number, runs)

    monkeypatch.setattr(versions._Folder, "commit", late)
    catalog.append(spark.createDataFrame([make_scheme(3)], SCHEME), path)
    assert sorted(r["pos"] for r in catalog.read_schemes(spark, path).collect()) == [1, 2, 3]


# ---- streaming state -----------------------------------------------------------------------------


def test_keyed_state_over_batches_equals_one_batch(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, name string"
    rows = [(i % 5, i // 7, i, f"n{i}") for i in range(60)] + [(1, 3, 2, "tie"), (1, 3, 2, "tie"), (None, 1, 1, "x"), (2, None, 9, "late")]
    frame = lambda part: spark.createDataFrame(part, "user_id long, t long, event_id long, name string").select(
        "user_id", F.timestamp_seconds("t").alias("ts"), "event_id", "name"
    )
    random.Random(1).shuffle(rows)
    source, log = tmp_path / "in", str(tmp_path / "log")
    assert read_log(spark, log, frame(rows).schema).count() == 0
    for k in range(3):  # a stream that is stopped and started again, with late and tied rows in each batch
        frame(rows[k::3]).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        stream_current(stream, log, f"current{k}", order=("ts", "event_id"), checkpoint=str(tmp_path / "state")).awaitTermination()
    logged = read_log(spark, log, frame(rows).schema).collect()
    got = {}
    for r in sorted(logged, key=lambda r: r["batch_id"]):
        got[r["user_id"]] = (r["ts"], r["event_id"])
    want = {}
    for r in frame(rows).collect():
        key = (r["ts"] is not None, r["ts"] or 0, r["event_id"])
        if r["user_id"] not in want or key > want[r["user_id"]][0]:
            want[r["user_id"]] = (key, (r["ts"], r["event_id"]))
    assert got == {u: v[1] for u, v in want.items()}


# ---- one-pass routes -----------------------------------------------------------------------------


def test_summaries_never_miss(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    checked = keys.union(spark.range(5000, 8000).select(F.xxhash64("id"))).withColumns(
        {"bits": key_filter(keys, "k").scalar(), "uses": count_sketch(keys.union(keys), "k").scalar()}
    ).select("k", in_filter(F.col("bits"), F.col("k")).alias("held"), count_in(F.col("uses"), F.col("k")).alias("uses"))
    rows = checked.collect()
    assert all(r["held"] and r["uses"] >= 2 for r in rows[:3000])
    assert sum(r["held"] for r in rows[3000:]) < 60


def _catalogs(spark):
    return standins.named_schemes(spark, SF_DIR), standins.faqs(spark, SF_DIR), standins.keywords(spark, SF_DIR)


def test_both_strategies_route_alike_and_every_stage_is_met(spark):
    queries = standins.stage_queries(spark, SF_DIR)
    found = [sorted(map(str, routing.route_queries(queries, *_catalogs(spark), strategy=s).collect())) for s in ("broadcast", "shuffle")]
    assert found[0] == found[1]
    stages = {f"R{i}" for i in range(1, 14)}
    assert {s for s in stages if any(f"stage='{s}'" in r for r in found[0])} >= stages - {"R9"}


def test_queries_are_scanned_once(spark):
    turns = standins.turns(spark, SF_DIR)
    plan = routing.route_queries(turns, *_catalogs(spark), strategy="broadcast")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("conversations.parquet") == 1 and "NestedLoop" not in plan


def test_filtered_pieces_find_the_same_phrases(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a bc phrase here", "no", "", None, "of x", "phrases", "BC"])], "id long, t string")
    phrases = spark.createDataFrame([(p,) for p in ["phrase", "bc", "x", "here", " ", "zzzz"]], "p string").withColumn("q", F.col("p"))
    found = [
        {tuple(r) for r in containment.texts_holding(texts, "id", "t", phrases, "p", "q", strategy=s).select("id", "p").collect()}
        for s in ("broadcast", "shuffle")
    ]
    assert found[0] == found[1] == {(0, "phrase"), (0, "bc"), (0, "here"), (4, "x"), (5, "phrase")}
