import random

import pytest
from pyspark.sql import functions as F

from entitlekit.operators import eligibility as e
from entitlekit.operators import directory as d
from entitlekit.schemas import SCHEME


def make_scheme(i, home="All India", **rules):
    full = {k: None for k in ("min_age", "max_age", "max_income", "allowed_categories", "gender",
                              "special_category", "occupation", "state")}
    texts = {k: None for k in ("description", "official_website", "target_beneficiaries",
                               "application_process", "benefits", "steps")}
    return {"scheme_id": str(i), "pos": i, "name": f"S{i}", "state": home, "rules": {**full, **rules}, **texts}


def random_schemes(rng, n):
    def some(values):
        return rng.choice([None, [], ["all"], ["all", values[0]], rng.sample(values, 2)])

    def bound(top):
        return rng.choice([None, rng.randrange(top)])

    return [
        make_scheme(
            i, rng.choice([None, "All India", "all india", "Goa", "KERALA", "*"]),
            min_age=bound(60), max_age=bound(140), max_income=bound(1000),
            allowed_categories=some(["sc", "st", "general"]), gender=some(["male", "female", "*"]),
            special_category=some(["farmer", "none", "student"]),
        )
        for i in range(n)
    ]


def random_profiles(rng, n):
    return [
        {
            "profile_id": i, "age": rng.randrange(-5, 200), "income": rng.randrange(1000),
            # a third of all profiles share every value
            **({"state": "goa", "category": "sc", "gender": "male", "special_category": "none"} if i % 3 == 0 else {
                "state": rng.choice(["goa", "kerala", "", "all india", "*"]),
                "category": rng.choice(["sc", "st", "", "all"]),
                "gender": rng.choice(["male", "female", "*"]),
                "special_category": rng.choice(["farmer", "none", ""]),
            }),
        }
        for i in range(n)
    ]


def qualifies(p, s):
    r = s["rules"]

    def member(rule, value):
        return r[rule] is None or value in r[rule] or "all" in r[rule]

    return (
        (s["state"] is None or s["state"] == "All India" or s["state"].lower() == p["state"])
        and (r["min_age"] is None or p["age"] >= r["min_age"])
        and (r["max_age"] is None or p["age"] <= r["max_age"])
        and (r["max_income"] is None or p["income"] <= r["max_income"])
        and member("allowed_categories", p["category"])
        and member("gender", p["gender"])
        and member("special_category", p["special_category"])
    )


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    schemes, profiles = random_schemes(rng, 150), random_profiles(rng, 60)
    schema = "profile_id bigint, age bigint, income bigint, state string, category string, gender string, special_category string"
    expected = sorted(
        (p["profile_id"], s["scheme_id"]) for p in profiles for s in schemes if qualifies(p, s)
    )
    return spark.createDataFrame(profiles, schema), spark.createDataFrame(schemes, SCHEME), expected


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle"])
def test_pairs_equal_brute_force(data, strategy):
    profiles, schemes, expected = data
    pairs = e.eligible_pairs(profiles, schemes, strategy)
    assert sorted(map(tuple, pairs.collect())) == expected


def test_single_predicates_agree(data):
    profiles, schemes, expected = data
    rules = F.col("rules")
    both = profiles.crossJoin(schemes.withColumnRenamed("state", "scheme_state"))
    kept = both.where(
        e.state_matches(F.col("scheme_state"), F.col("state"))
        & e.age_matches(rules, F.col("age"))
        & e.income_matches(rules, F.col("income"))
        & e.set_matches(rules["allowed_categories"], F.col("category"))
        & e.set_matches(rules["gender"], F.col("gender"))
        & e.set_matches(rules["special_category"], F.col("special_category"))
    )
    assert sorted(map(tuple, kept.select("profile_id", "scheme_id").collect())) == expected


def test_counts_include_zero(data):
    profiles, schemes, expected = data
    counts = dict(map(tuple, e.eligible_counts(profiles, e.eligible_pairs(profiles, schemes)).collect()))
    assert len(counts) == 60
    assert all(n == sum(1 for p, _ in expected if p == k) for k, n in counts.items())


def test_scheme_without_rules_matches_its_state(spark):
    bare = {**make_scheme(1, "Goa"), "rules": None}
    schemes = spark.createDataFrame([bare], SCHEME)
    profiles = spark.createDataFrame(
        [(1, 0, 0, "goa", "", "", ""), (2, 0, 0, "", "", "", "")],
        "profile_id bigint, age bigint, income bigint, state string, category string, gender string, special_category string",
    )
    assert [r["profile_id"] for r in e.match_eligible(profiles, schemes).collect()] == [1]


def test_normalization_and_rejects(spark):
    forms = spark.createDataFrame(
        [("a", " 30 ", "", "SC", "Male", None), ("b", None, "12", None, "", "Goa"),
         ("c", "x", "5", "", "", ""), ("d", "1", "2.5", "", "", "")],
        "profile_id string, age string, income string, category string, gender string, state string",
    )
    good, rejects = e.normalize_profiles(forms)
    assert sorted((r.profile_id, r.age, r.income, r.category, r.state) for r in good.collect()) == [
        ("a", 30, 0, "sc", ""), ("b", 0, 12, "", "goa"),
    ]
    assert sorted((r.profile_id, r.reject_reason) for r in rejects.collect()) == [
        ("c", "bad age"), ("d", "bad income"),
    ]


def test_opt_in_age_and_occupation(value):
    assert value(e.age_from_dob(F.lit("1990-05-15"), F.lit("2020-05-14").cast("date"))) == 29
    rules = F.struct(F.array(F.lit("weaver")).alias("occupation"))
    assert value(e.occupation_matches(rules, F.lit("weaver")))
    assert not value(e.occupation_matches(rules, F.lit("clerk")))


def test_directory(spark):
    rows = [
        {**make_scheme(1, "Goa"), "name": "Boat loan"},
        {**make_scheme(2, "All India"), "name": "Seeds", "description": "for a Farmer"},
        {**make_scheme(3, ""), "name": "Loan B", "target_beneficiaries": "farmers"},
        {**make_scheme(4, "Goa", state=["Kerala"]), "name": "Net"},
        {**make_scheme(5, "x", state=["ALL"]), "name": None},
    ]
    schemes = spark.createDataFrame(rows, SCHEME)

    def ids(**choice):
        return [r["pos"] for r in d.browse(schemes, **choice).collect()]

    assert ids() == [1, 2, 3, 4, 5]
    assert ids(search="LOAN") == [1, 3]
    assert ids(audience="Farmer") == [2, 3]
    assert ids(state="All India") == [2, 3, 5]
    assert ids(state="kerala") == [4, 2, 3, 5]
    badges = {r["pos"]: r["badge"] for r in d.browse(schemes).collect()}
    assert badges == {1: "Goa", 2: "Central", 3: "Central", 4: "Kerala", 5: "Central"}
    assert d.find_by_name(schemes, "loan").first()["pos"] == 1
