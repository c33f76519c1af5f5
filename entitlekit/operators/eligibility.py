"""Match person profiles against scheme rules.

A rule list is either a wildcard or a set of values, so a (profile, scheme) pair agrees on state,
category, gender and special category exactly when the two sides share one composite key: the
scheme contributes its wildcards and values, the profile contributes its value and the wildcard
on each of the four dimensions. With the age range cut into buckets that turns the rule test into
a hash equi-join in which every qualifying pair meets on exactly one key; ages and incomes are
then compared exactly. No pair outside a shared key is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ALL, MATCH_SCORE, NATIONAL
from ..functions.text import or_empty
from ..sizing import AUTO, SHUFFLE, lookup_join

WILDCARD = "*"
AGE_STEP = 10
AGE_BUCKETS = 12
RULE_KEYS = ["state_key", "category_key", "gender_key", "special_key", "age_bucket"]
FORM_NUMBERS = ["age", "income"]
FORM_TEXTS = ["category", "gender", "occupation", "special_category", "state"]


# ---- P1 profile normalization ------------------------------------------------


def age_from_dob(dob: Column, as_of: Column) -> Column:
    """Opt-in: whole years between a ``YYYY-MM-DD`` birth date and ``as_of``."""
    born = F.try_to_date(dob, "yyyy-MM-dd")
    return F.floor(F.months_between(as_of, born) / 12)


def normalize_profiles(form: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Form strings to typed profiles; rows with a bad number go to the second DataFrame."""
    names = form.columns
    parsed = form
    for name in FORM_NUMBERS:
        raw = F.col(name).cast("string") if name in names else F.lit(None).cast("string")
        number = F.when(or_empty(raw) == "", F.lit(0).cast("bigint")).otherwise(
            raw.try_cast("bigint")
        )
        parsed = parsed.withColumn(f"__{name}", number)
    for name in FORM_TEXTS:
        parsed = parsed.withColumn(
            name, F.lower(or_empty(F.col(name))) if name in names else F.lit("")
        )
    bad = F.lit(False)
    for name in FORM_NUMBERS:
        bad = bad | F.col(f"__{name}").isNull()
    good = parsed.where(~bad)
    for name in FORM_NUMBERS:
        good = good.withColumn(name, F.col(f"__{name}"))
    hidden = [f"__{name}" for name in FORM_NUMBERS]
    reasons = F.concat_ws(
        ",", *[F.when(F.col(f"__{name}").isNull(), F.lit(f"bad {name}")) for name in FORM_NUMBERS]
    )
    rejects = parsed.where(bad).withColumn("reject_reason", reasons).drop(*hidden)
    return good.drop(*hidden), rejects


# ---- P2-P7 predicates, usable on any row that holds both sides ----------------


def state_matches(scheme_state: Column, state: Column) -> Column:
    return scheme_state.isNull() | (scheme_state == NATIONAL) | (
        F.lower(scheme_state) == F.lower(state)
    )


def age_matches(rules: Column, age: Column) -> Column:
    return F.coalesce(age >= rules["min_age"], F.lit(True)) & F.coalesce(
        age <= rules["max_age"], F.lit(True)
    )


def income_matches(rules: Column, income: Column) -> Column:
    return F.coalesce(income <= rules["max_income"], F.lit(True))


def set_matches(allowed: Column, value: Column) -> Column:
    """Member of the list, or the list holds ``all``; a missing list passes."""
    member = F.coalesce(F.array_contains(allowed, value), F.lit(False))
    wildcard = F.coalesce(F.array_contains(allowed, ALL), F.lit(False))
    return allowed.isNull() | member | wildcard


def occupation_matches(rules: Column, occupation: Column) -> Column:
    """Opt-in: not part of eligibility by default."""
    return set_matches(rules["occupation"], occupation)


# ---- J1, J2 ------------------------------------------------------------------


def _age_bucket(age: Column) -> Column:
    step = F.floor(age / AGE_STEP)
    return F.greatest(F.lit(0), F.least(F.lit(AGE_BUCKETS), step)).cast("int")


def _value_key(value: Column) -> Column:
    return F.concat(F.lit("="), value)


def _list_keys(allowed: Column) -> Column:
    wildcard = allowed.isNull() | F.coalesce(F.array_contains(allowed, ALL), F.lit(False))
    values = F.array_distinct(F.transform(F.array_compact(allowed), _value_key))
    return F.when(wildcard, F.array(F.lit(WILDCARD))).otherwise(values)


def scheme_keys(schemes: DataFrame) -> DataFrame:
    """One row per composite key of each scheme, with the bounds that stay range tests."""
    rules = F.col("rules")
    state = F.col("state")
    national = state.isNull() | (state == NATIONAL)
    low = F.when(rules["min_age"].isNull(), 0).otherwise(_age_bucket(rules["min_age"]))
    high = F.when(rules["max_age"].isNull(), AGE_BUCKETS).otherwise(_age_bucket(rules["max_age"]))
    return (
        schemes.where(F.coalesce(rules["min_age"] <= rules["max_age"], F.lit(True)))
        .select(
            "scheme_id",
            rules["min_age"].alias("min_age"),
            rules["max_age"].alias("max_age"),
            rules["max_income"].alias("max_income"),
            F.when(national, F.lit(WILDCARD))
            .otherwise(_value_key(F.lower(state)))
            .alias("state_key"),
            _list_keys(rules["allowed_categories"]).alias("categories"),
            _list_keys(rules["gender"]).alias("genders"),
            _list_keys(rules["special_category"]).alias("specials"),
            F.sequence(low, high).alias("ages"),
        )
        .withColumn("category_key", F.explode("categories"))
        .withColumn("gender_key", F.explode("genders"))
        .withColumn("special_key", F.explode("specials"))
        .withColumn("age_bucket", F.explode("ages"))
        .drop("categories", "genders", "specials", "ages")
    )


def profile_keys(profiles: DataFrame) -> DataFrame:
    """Sixteen probe keys per profile: value or wildcard on each of four dimensions."""
    dimensions = [
        ("state_key", "state"),
        ("category_key", "category"),
        ("gender_key", "gender"),
        ("special_key", "special_category"),
    ]
    probes = profiles.select(
        "profile_id", "age", "income", *[name for _, name in dimensions]
    ).withColumn("__probe", F.explode(F.array(*[F.lit(i) for i in range(2 ** len(dimensions))])))
    keys = [
        F.when(F.col("__probe").bitwiseAND(2**bit) == 0, F.lit(WILDCARD))
        .otherwise(_value_key(F.col(name)))
        .alias(key)
        for bit, (key, name) in enumerate(dimensions)
    ]
    return probes.select(
        "profile_id", "age", "income", *keys, _age_bucket(F.col("age")).alias("age_bucket")
    )


def eligible_pairs(
    profiles: DataFrame, schemes: DataFrame, strategy: str = AUTO
) -> DataFrame:
    """(profile_id, scheme_id) for every profile and every scheme it qualifies for.

    ``strategy``: ``auto`` broadcasts the scheme keys when they measure within the bound and
    otherwise shuffles on the composite key with profiles salted.
    """
    keys = scheme_keys(schemes)
    joined = lookup_join(
        profile_keys(profiles),
        keys,
        RULE_KEYS,
        spread=["profile_id"],
        strategy=strategy,
    )
    in_range = (
        F.coalesce(F.col("age") >= F.col("min_age"), F.lit(True))
        & F.coalesce(F.col("age") <= F.col("max_age"), F.lit(True))
        & F.coalesce(F.col("income") <= F.col("max_income"), F.lit(True))
    )
    return joined.where(in_range).select("profile_id", "scheme_id")


def eligible_pairs_by_state(profiles: DataFrame, schemes: DataFrame) -> DataFrame:
    """The large-catalog form. Nothing is broadcast; state leads the shuffle key."""
    return eligible_pairs(profiles, schemes, strategy=SHUFFLE)


def display_schemes(schemes: DataFrame) -> DataFrame:
    """The columns shown with a match."""
    return schemes.select(
        "scheme_id", "name", "description", "official_website", "target_beneficiaries",
        "application_process", "benefits", "steps",
        F.coalesce("state", F.lit(NATIONAL)).alias("state"),
        "rules",
        F.lit(MATCH_SCORE).alias("match_score"),
    )


def match_eligible(
    profiles: DataFrame, schemes: DataFrame, strategy: str = AUTO
) -> DataFrame:
    """Every qualifying pair with the scheme's display columns."""
    pairs = eligible_pairs(profiles, schemes, strategy)
    return lookup_join(
        pairs, display_schemes(schemes), ["scheme_id"], spread=["profile_id"], strategy=strategy
    ).select("profile_id", *display_schemes(schemes).columns)


def eligible_counts(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """A1: matches per profile, zero included. One shuffle, combined before it."""
    tagged = profiles.select("profile_id", F.lit(0).alias("one")).unionByName(
        pairs.select("profile_id", F.lit(1).alias("one"))
    )
    return tagged.groupBy("profile_id").agg(F.sum("one").alias("eligible_count"))
