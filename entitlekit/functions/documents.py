"""Document field parsing as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    ADDRESS_PARTS,
    ADDRESS_WORDS,
    CASTE_MARKS,
    CATEGORY_ORDER,
    DOC_CASTE,
    DOC_IDENTITY,
    DOC_INCOME,
    DOC_UNKNOWN,
    FULL_DATE,
    IDENTITY_MARKS,
    INCOME_MARKS,
    INCOME_PATTERN,
    PAYLOAD_ROOT,
    PLAIN_DOB,
    PLAIN_GENDER,
    PLAIN_NAME,
)
from .text import col, contains_any, first_of, or_empty, present, strip


def normalize_date(value: Column | str) -> Column:
    """``YYYY-MM-DD`` from day-first dates; else the first four digits; else the text itself."""
    text = strip(or_empty(value))

    def piece(index: int, width: int) -> Column:
        return F.lpad(F.regexp_extract(text, FULL_DATE, index), width, "0")

    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
        .when(text.rlike(FULL_DATE), F.concat_ws("-", piece(3, 4), piece(2, 2), piece(1, 2)))
        .when(text.rlike(r"\d{4}"), F.regexp_extract(text, r"(\d{4})", 1))
        .otherwise(text)
    )


def is_valid_name(value: Column | str) -> Column:
    """False for texts that cannot be a person's name; never NULL.

    The cheap tests come first: most lines of a document fail one of them.
    """
    name = or_empty(value)
    compact = F.translate(name, " .,", "")
    letters = F.length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    shouted_acronym = (
        (F.length(compact) < 5) & ~compact.rlike("[AEIOU]") & (F.upper(name) == name)
    )
    return ~(
        (F.length(strip(name)) < 2)
        | compact.rlike(r"(?s)(.).*\1.*\1.*\1")
        | shouted_acronym
        | contains_any(F.upper(name), ADDRESS_WORDS)
        | (2 * letters < F.length(compact))
        | ((F.length(compact) > 5) & ~F.upper(compact).rlike("[AEIOU]"))
    )


def detect_doc_type(text: Column | str) -> Column:
    upper = F.upper(or_empty(text))
    return (
        F.when(contains_any(upper, IDENTITY_MARKS), F.lit(DOC_IDENTITY))
        .when(contains_any(upper, INCOME_MARKS), F.lit(DOC_INCOME))
        .when(contains_any(upper, CASTE_MARKS), F.lit(DOC_CASTE))
        .otherwise(F.lit(DOC_UNKNOWN))
    )


def document_key(doc_type: Column | str) -> Column:
    """Storage key of a document type: its first word in lower case."""
    return F.lower(F.substring_index(col(doc_type), " ", 1))


def text_lines(text: Column | str) -> Column:
    """Trimmed non-empty lines."""
    lines = F.transform(F.split(or_empty(text), "\n"), strip)
    return F.filter(lines, lambda line: F.length(line) > 0)


def extract_birth_date(text: Column | str) -> Column:
    text = or_empty(text)
    full = F.regexp_extract(text, r"(\d{2}[/-]\d{2}[/-]\d{4})", 1)
    return F.when(full != "", normalize_date(full)).otherwise(
        F.regexp_extract(text, r"(\d{4})", 1)
    )


def extract_income(text: Column | str) -> Column:
    """First amount of five digits or more that follows a money word, without commas."""
    amounts = F.transform(
        F.regexp_extract_all(or_empty(text), F.lit(INCOME_PATTERN), F.lit(1)),
        lambda a: F.replace(a, F.lit(","), F.lit("")),
    )
    return or_empty(first_of(F.filter(amounts, lambda a: F.length(a) >= 5)))


def extract_category(text: Column | str) -> Column:
    upper = F.upper(or_empty(text))
    found = F.when(F.lit(False), F.lit(""))
    for category in CATEGORY_ORDER:
        found = found.when(upper.contains(category), F.lit(category))
    return found.otherwise(F.lit(""))


# ---- identity payloads -------------------------------------------------------

PAYLOAD_FIELDS = ["name", "dob", "gender", *ADDRESS_PARTS]
PAYLOAD_SCHEMA = ", ".join(
    [f"`{f}` string" for f in PAYLOAD_FIELDS] + [f"`_{f}` string" for f in PAYLOAD_FIELDS]
)
CAPITAL_SCHEMA = "`_Name` string, `_DOB` string"
PAYLOAD_OPTIONS = {
    "mode": "PERMISSIVE", "attributePrefix": "_", "ignoreSurroundingSpaces": "false",
    "ignoreNamespace": "true",
}


def payload_struct(payload: Column | str, schema: str = PAYLOAD_SCHEMA) -> Column:
    """Child tags and ``_``-prefixed attributes of an XML payload; NULLs when malformed."""
    return F.from_xml(col(payload), schema, PAYLOAD_OPTIONS)


def full_gender(value: Column) -> Column:
    return F.when(value == "M", "Male").when(value == "F", "Female").otherwise(value)


def long_enough(value: Column) -> Column:
    """The value if it has more than three characters, else NULL."""
    return F.when(F.length(value) > 3, value)


def xml_identity(xml: Column, payload: Column | str) -> Column:
    """Identity fields of a parsed payload with the barcode root (child tag, then attribute)."""

    def child(field: str) -> Column:
        return F.when(present(xml[field]), strip(xml[field]))

    def child_or_attribute(field: str) -> Column:
        return F.coalesce(child(field), xml[f"_{field}"], F.lit(""))

    tag_name, attribute_name = long_enough(child("name")), long_enough(xml["_name"])
    parts = F.array(
        *[F.coalesce(child(p), F.nullif(xml[f"_{p}"], F.lit(""))) for p in ADDRESS_PARTS]
    )
    identity = F.struct(
        F.coalesce(tag_name, attribute_name, F.lit("")).alias("name"),
        normalize_date(child_or_attribute("dob")).alias("dob"),
        full_gender(child_or_attribute("gender")).alias("gender"),
        F.array_join(F.array_compact(parts), ", ").alias("address"),
        F.when(tag_name.isNotNull(), "XML_tag_name")
        .when(attribute_name.isNotNull(), "XML_attr_name")
        .otherwise("")
        .alias("debug_source"),
    )
    blank = F.struct(
        *[F.lit("").alias(f) for f in ("name", "dob", "gender", "address", "debug_source")]
    )
    return F.when(or_empty(payload).contains(PAYLOAD_ROOT), identity).otherwise(blank)


def _match(payload: Column, pattern: str) -> Column:
    """Trimmed first group of the first match, or NULL when there is none."""
    return F.when(payload.rlike(pattern), strip(F.regexp_extract(payload, pattern, 1)))


def pattern_identity(payload: Column | str, known: Column) -> Column:
    """Identity fields by pattern, over what the XML gave (``known``): tag, attribute, plain text."""
    payload = or_empty(payload)
    tag = {f: _match(payload, rf"(?iu)<{f}[^>]*>([^<]+)</{f}>") for f in ("name", "dob", "gender")}
    attribute = {f: _match(payload, rf'(?iu){f}="([^"]+)"') for f in ("name", "dob")}
    plain_name = _match(payload, PLAIN_NAME)
    plain_dob = _match(payload, PLAIN_DOB)
    plain_gender = _match(payload, PLAIN_GENDER)

    names = [
        (long_enough(tag["name"]), "regex_tag_name"),
        (long_enough(attribute["name"]), "regex_attr_name"),
        (long_enough(plain_name), "regex_plaintext"),
    ]
    source = F.when(F.lit(False), F.lit(""))
    for name, label in names:
        source = source.when(name.isNotNull(), F.lit(label))
    dob = F.coalesce(
        F.when(tag["dob"].isNotNull(), normalize_date(tag["dob"])),
        F.nullif(known["dob"], F.lit("")),
        F.when(attribute["dob"].isNotNull(), normalize_date(attribute["dob"])),
        F.when(plain_dob.isNotNull(), normalize_date(plain_dob)),
        F.lit(""),
    )
    gender = F.coalesce(
        F.nullif(tag["gender"], F.lit("")),
        F.nullif(known["gender"], F.lit("")),
        F.when(F.upper(plain_gender).isin("M", "MALE"), F.lit("Male")).when(
            F.upper(plain_gender).isin("F", "FEMALE"), F.lit("Female")
        ),
        F.lit(""),
    )
    return F.struct(
        F.coalesce(*[name for name, _ in names], F.lit("")).alias("name"),
        dob.alias("dob"),
        gender.alias("gender"),
        known["address"].alias("address"),
        source.otherwise(F.lit("")).alias("debug_source"),
    )
