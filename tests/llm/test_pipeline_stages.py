"""The stages of the pipeline on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entitlekit.llm import common, decontamination, toxicity

SF_DIR = "/root/testdata/sf0.001"
CLASHES = ("toxic_score", "Toxic_Score_", "kept_id", "bad_id", "bad_tag", "row_key", "member", "place", "tag", "node", "class_id", "score")
SECRET = "password=abcdef123456"


def _text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, 500, n))


def _rows() -> list[tuple]:
    one, two = _text(1, 120), _text(2, 120)
    return [
        (5, one), (3, one + " end"), (3, two), (3, two), (7, _text(3, 90)), (None, one), (None, two + " end"), (None, _text(4, 60)),
        (8, None), (8, None), (9, ""), (10, " \n "), (11, "few words"), (None, "few words"), (12, _text(5, 200_000)),
        (13, _text(6, 50) + f" {SECRET} " + _text(7, 50)), (14, one), (-2, _text(8, 60) + " " + SECRET),
    ]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), **{c: F.lit("clash") for c in CLASHES}})


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, _rows()).repartition(3)


def _pairs(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def _one_of_each(rows: list[tuple]) -> Counter:
    """Classes by comparing all texts; of each the row of the least id, rows without an id last."""
    sets = []
    for _, text in rows:
        words = (text or "").split()
        sets.append({tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for row, r in zip(rows, root):
        best[r] = min(best.get(r, row), row, key=lambda x: (x[0] is None, x[0] or 0))
    return Counter(best.values())


def test_one_row_of_each_class(spark, docs, monkeypatch):
    expected = _one_of_each(_rows())
    assert expected[(8, None)] == 2 and expected[(3, _text(2, 120))] == 1 and expected[(3, _text(1, 120) + " end")] == 1
    for most in (corpus_pipeline.MOST_SENT, 0):
        monkeypatch.setattr(corpus_pipeline, "MOST_SENT", most)
        got = corpus_pipeline.keep_one_of_each(spark, docs, SF_DIR)
        assert got.columns == docs.columns and _pairs(got) == expected


def test_toxic_rows_go(spark, docs):
    read = lambda name: common.read(spark, SF_DIR, name)
    model = toxicity.train(read("documents"), read("labels").where(~toxicity.held_out()))
    every = docs.unionByName(_frame(spark, [(r["doc_id"], r["text"]) for r in read("documents").collect()]))
    scored = toxicity.score_toxicity(every, model).where("predicted = 0")
    expected = Counter((r["doc_id"], r["text"]) for r in scored.collect())
    got = corpus_pipeline.drop_toxic(spark, every, SF_DIR)
    assert got.columns == every.columns
    assert Counter((i, t or "") for (i, t), n in _pairs(got).items() for _ in range(n)) == expected
    assert sum(expected.values()) < every.count()


@pytest.mark.parametrize("block_bytes", [1 << 21, 2_000])
def test_contaminated_rows_go(spark, docs, block_bytes):
    items = common.read(spark, SF_DIR, "benchmark")
    item = items.where("text is not null").orderBy(F.length("text").desc()).first()["text"]
    share = item.split()[:13]
    planted = [(20, item), (None, item), (21, "a b c"), (21, item), (22, item + " " + _text(9, 50_000)), (21, "a b c"),
               (23, " ".join(share) + " " + _text(10, 247)), (24, " ".join(share) + " " + _text(10, 248))]
    every = docs.unionByName(_frame(spark, planted))
    found = decontamination.contamination(decontamination.find_passages(every, items)).where("contaminated")
    assert {r["doc_id"] for r in found.collect()} == {20, 21, 23, None}
    got = decontamination.drop_contaminated(every, items, block_bytes)
    assert got.columns == every.columns
    expected = Counter(_rows()) + Counter([(21, "a b c"), (21, "a b c"), planted[4], planted[7]])
    assert _pairs(got) == expected


def test_secrets_are_masked(spark, docs):
    got = corpus_pipeline.mask_secrets(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    rows = got.select("doc_id", "text", "n_chars").collect()
    assert all(SECRET not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in rows)
    plain = lambda pairs: Counter(p for p in pairs if SECRET not in (p[1] or "") and p[0] not in (13, -2))
    assert plain((r["doc_id"], r["text"]) for r in rows) == plain(_rows()) and len(rows) == len(_rows())


def test_pieces_hold_every_id_once(spark, docs):
    pieces = corpus_pipeline.pack(spark, docs, SF_DIR).collect()
    lengths, places = Counter(), {}
    for r in pieces:
        lengths[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert lengths[8] == 2 and lengths[9] == 1 and {r["doc_tokens"] for r in pieces if r["doc_id"] == 8} == {1}
    whole = Counter()
    for r in pieces:
        whole[r["doc_id"]] += r["doc_tokens"] if r["start"] == 0 else 0
    assert whole == lengths
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096


def test_empty_tables_stay_empty(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_swaps_take_every_other_name():
    pairs = list(toxicity.counterfactuals("Old men met. Some muslim met MEN here! None there."))
    first = {b for a, b in pairs if a == "Old men met"}
    second = {b for a, b in pairs if a.strip().startswith("Some")}
    assert {b.split()[0] for b in first} == {"young", "elderly", "disabled", "blind", "deaf"}
    assert {b.split()[1] for b in first} == {"women", "girls", "boys"} and len(first) == 5
    assert {b.split()[1] for b in second} == {"christian", "jewish", "hindu", "buddhist", "atheist"}
    assert len(pairs) == 10


def test_equal_changes_weigh_as_often_as_they_occur():
    names = np.arange(4).astype(np.uint64)
    rows = [{"toxic": i % 2, "active": [i % 2, 2] if i % 3 else [3]} for i in range(40)]
    swaps = [{"change": [-1, 2], "uses": 3}, {"change": [3], "uses": 1}]
    apart = [{"change": s["change"], "uses": 1} for s in swaps for _ in range(s["uses"])]
    assert np.allclose(toxicity.fit(rows, names, swaps).weights, toxicity.fit(rows, names, apart).weights)
    bound = toxicity.fit(rows, names, [{"change": [-1, 2], "uses": 1}]).weights
    free = toxicity.fit(rows, names, []).weights
    assert abs(bound[1] - bound[0]) < abs(free[1] - free[0])
