"""Expectation-maximisation of rule accuracies: known rates are found, noise gets no weight, numpy agrees."""

import math

import numpy as np
import pytest

from entitlekit.llm import quality
from entitlekit.llm.common import read

SF_DIR = "/root/testdata/sf0.001"
RULES = quality.RULES


def _votes(spark, rows):
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{r} int" for r in RULES)).repartition(4)


def _synthetic(n=20000, share=0.8, seed=1):
    """Votes by known rates: rules that always vote, one of them at random."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    votes, rates = np.zeros((n, len(RULES)), int), {}
    for k in range(len(RULES)):
        on_good, on_bad = (0.5, 0.5) if k == 7 else (0.75 + 0.03 * k, 0.1 + 0.04 * k)
        votes[:, k] = np.where(rng.random(n) < np.where(good, on_good, on_bad), 1, -1)
        rates[k] = (on_good, on_bad, 1 - on_good, 1 - on_bad)
    return votes, rates, good


def test_known_accuracies_are_recovered(spark):
    votes, rates, _ = _synthetic()
    got = quality.estimate(_votes(spark, votes))
    for k, expected in rates.items():
        assert got[RULES[k]] == pytest.approx(expected, abs=0.05)


def test_a_random_rule_ends_without_weight_and_one_bad_vote_may_pass(spark):
    votes, _, _ = _synthetic()
    rates = quality.estimate(_votes(spark, votes))
    right_good, right_bad, wrong_good, wrong_bad = rates[RULES[7]]
    assert abs(math.log(right_good / right_bad)) < 0.1 and abs(math.log(wrong_good / wrong_bad)) < 0.1
    single, double = [1] * len(RULES), [0] * len(RULES)
    single[7] = -1  # only the random rule finds a fault
    double[0] = double[5] = -1
    p = [r[0] for r in _votes(spark, [single, double]).coalesce(1).select(quality.posterior(rates)).collect()]
    assert max(p) > 0.99 and min(p) < 0.2


def _numpy_estimate(votes):
    rates = {rule: (0.5, 0.45, 0.05, 0.45) for rule in RULES}
    for _ in range(quality.MAX_STEPS):
        good = _numpy_posterior(votes, rates)
        new = {}
        for k, rule in enumerate(RULES):
            masses = [(w, w.sum() + 2) for w in (good, 1 - good)]
            new[rule] = tuple((w[votes[:, k] == vote].sum() + 1) / mass for vote in (1, -1) for w, mass in masses)
        moved = max(abs(a - b) for rule in RULES for a, b in zip(new[rule], rates[rule]))
        rates = new
        if moved < quality.SETTLED:
            break
    return rates


def _numpy_posterior(votes, rates):
    odds = np.full(len(votes), math.log(quality.PRIOR / (1 - quality.PRIOR)))
    for k, rule in enumerate(RULES):
        gg, gb, bg, bb = rates[rule]
        odds += np.where(votes[:, k] == 1, max(math.log(gg / gb), 0), np.where(votes[:, k] == -1, min(math.log(bg / bb), 0), 0))
    return 1 / (1 + np.exp(-odds))


def test_verdicts_equal_numpy(spark):
    judged = quality.judge_quality(read(spark, SF_DIR, "documents")).toPandas()
    votes = judged[list(RULES)].to_numpy()
    expected = _numpy_posterior(votes, _numpy_estimate(votes))
    assert np.allclose(judged["quality"], expected, atol=1e-6)
    assert (judged["kept"] == (~judged["base_failed"] & (expected >= quality.KEEP_FROM))).all()


def test_caseless_scripts_and_their_full_stops(spark):
    hindi = " ".join(["यह एक साधारण वाक्य है जिसमें कुछ शब्द हैं।"] * 30)
    arabic = " ".join(["هذا نص عادي فيه بعض الكلمات المفيدة؟"] * 30)
    docs = spark.createDataFrame([(1, hindi), (2, arabic), (3, "ALL LOUD WORDS HERE. " * 30)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert [rows[i]["case"] for i in (1, 2, 3)] == [0, 0, -1]
    assert rows[1]["sentences"] == rows[2]["sentences"] == 1 and rows[1]["letters"] == 0
