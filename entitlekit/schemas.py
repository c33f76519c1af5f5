"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_STR = T.StringType()
_STRS = T.ArrayType(_STR)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, _STR) for name in names]


RULES = T.StructType(
    [
        T.StructField("min_age", T.LongType()),
        T.StructField("max_age", T.LongType()),
        T.StructField("max_income", T.LongType()),
        T.StructField("allowed_categories", _STRS),
        T.StructField("gender", _STRS),
        T.StructField("special_category", _STRS),
        T.StructField("occupation", _STRS),
        T.StructField("state", _STRS),
    ]
)

SCHEME_TEXTS = [
    "name", "description", "official_website", "target_beneficiaries", "application_process",
    "benefits", "steps", "state",
]
SCHEME = T.StructType(
    [T.StructField("scheme_id", _STR), T.StructField("pos", T.LongType())]
    + _strings(*SCHEME_TEXTS)
    + [T.StructField("rules", RULES)]
)

FAQ_ENTRY = T.StructType(_strings("question", "answer", "category", "scheme"))
FAQ = T.StructType(
    [T.StructField("pos", T.LongType()), *FAQ_ENTRY.fields, T.StructField("en", FAQ_ENTRY)]
)

PROFILE_FORM = T.StructType(
    _strings(
        "profile_id", "name", "dob", "gender", "state", "district", "income", "occupation",
        "category", "special_category", "age",
    )
)

PROFILE = T.StructType(
    _strings("name")
    + [T.StructField("age", T.LongType())]
    + _strings("gender", "state", "district")
    + [T.StructField("income", T.LongType())]
    + _strings("occupation", "category", "special_category", "dob", "address")
)

EXTRACTED = T.StructType(_strings("name", "dob", "income", "category", "gender", "address"))
DOCUMENT = T.StructType(
    [
        T.StructField("status", _STR),
        T.StructField("extracted_data", EXTRACTED),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("verified_at", T.LongType()),
    ]
)
DOCUMENTS = T.MapType(_STR, DOCUMENT)

USER = T.StructType(
    _strings("user_id", "name", "email", "role")
    + [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("aadhaar_verified", T.BooleanType()),
        T.StructField("profile", PROFILE),
        T.StructField("documents", DOCUMENTS),
    ]
)

DICTIONARY = T.StructType(
    _strings("direction", "lang", "source", "target") + [T.StructField("ord", T.LongType())]
)
PROPER_NOUNS = T.StructType(_strings("phrase", "lang", "target"))
KEYWORDS = T.StructType(_strings("word", "label"))
MESSAGES = T.StructType(_strings("lang", "key", "text"))
