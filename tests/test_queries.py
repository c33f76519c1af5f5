"""Every registered query against DuckDB, and the shape of the headline plans."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bench import TABLES
from conftest import SF_DIR
from entitlekit.operators import eligibility, faq, matching
from entitlekit.plans import registry, standins

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def ordered(rows):
    return sorted(
        (tuple(canonical(v) for v in r) for r in rows),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )


def test_every_query_has_sql():
    assert set(registry.QUERIES) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_duckdb(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in relation.fetchall()]
    assert ordered(result.select(*columns).collect()) == ordered(expected)


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_no_nested_loops(spark, strategy):
    profiles, _ = eligibility.normalize_profiles(standins.profile_forms(spark, SF_DIR))
    schemes, faqs = standins.named_schemes(spark, SF_DIR), standins.faqs(spark, SF_DIR)
    turns = standins.turns(spark, SF_DIR)
    texts = matching.topic_texts(turns)
    vocabulary = faq.vocabulary(standins.keywords(spark, SF_DIR))
    plans = [
        plan_of(eligibility.match_eligible(profiles, schemes, strategy)),
        plan_of(faq.best_faq(turns, faqs, vocabulary, strategy)),
        plan_of(matching.contained_scheme(texts, schemes, strategy)),
        plan_of(matching.partial_scheme(texts, schemes, strategy)),
        plan_of(matching.token_scheme(texts, schemes, strategy)),
    ]
    for plan in plans:
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["eligibility_pairs"](spark, SF_DIR))
    assert "c_name" not in plan.split("ReadSchema")[1].split(">")[0]
