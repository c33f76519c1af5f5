"""Extract fields from document text and payloads, and score them against claimed values.

All per-document work is row-local: lines of a text stay an array inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ADDRESS_LINE_WORDS,
    CORRUPT_NAME_MARKS,
    DOC_CASTE,
    DOC_IDENTITY,
    DOC_INCOME,
    HEADER_WORDS,
    NOISE_WORDS,
    SCAN_DATE,
)
from ..functions.documents import (
    CAPITAL_SCHEMA,
    detect_doc_type,
    document_key,
    extract_birth_date,
    extract_category,
    extract_income,
    is_valid_name,
    normalize_date,
    pattern_identity,
    payload_struct,
    text_lines,
    xml_identity,
)
from ..functions.text import (
    clean_val,
    clean_val_no_space,
    col,
    contains_any,
    first_of,
    let,
    present,
    strip,
    title_case,
    words,
)

VERIFIED, PARTIAL, PROCESSING, REJECTED = (
    "Verified", "Partially Verified", "Processing", "Rejected",
)
MISMATCH, NOT_SCANNED, PARSE_ERROR = "Mismatch", "Not Scanned", "Error Parsing"


# ---- D1-D6 document text ------------------------------------------------------------


def targeted_name(lines: Column, claimed: Column | str) -> Column:
    """First of 20 lines that holds a long claimed-name word and is a valid name."""
    wanted = F.filter(words(F.upper(clean_val(claimed))), lambda w: F.length(w) > 3)

    def holds_claim(line: Column) -> Column:
        cleaned = F.upper(clean_val(line))
        return let(cleaned, lambda c: F.exists(wanted, lambda w: c.contains(w)))

    hits = F.filter(F.slice(lines, 1, 20), lambda line: holds_claim(line) & is_valid_name(line))
    return first_of(hits)


def _long_words(line: Column) -> Column:
    return F.filter(words(line), lambda w: F.length(w) > 2)


def fallback_name(lines: Column) -> Column:
    """First of 15 lines that reads like a name, without its short words."""

    def looks_like_name(line: Column) -> Column:
        upper = F.upper(line)
        digits = F.length(F.regexp_replace(line, r"\P{Nd}", ""))
        count = F.size(_long_words(line))
        return (
            ~contains_any(upper, HEADER_WORDS)
            & ~contains_any(upper, ADDRESS_LINE_WORDS)
            & (digits <= 4)
            & (count >= 2)
            & (count <= 5)
            & line.rlike(r"^\p{Lu}")
        )

    candidates = F.transform(
        F.filter(F.slice(lines, 1, 15), looks_like_name),
        lambda line: F.array_join(_long_words(line), " "),
    )
    return first_of(F.filter(candidates, is_valid_name))


def deep_scan_name(text: Column | str, claimed: Column | str) -> Column:
    """The claimed name if its cleaned form occurs in the cleaned text."""
    found = F.upper(clean_val(text)).contains(F.upper(clean_val(claimed)))
    return F.when(present(claimed) & found, col(claimed))


def extract_fields(documents: DataFrame) -> DataFrame:
    """D1-D5 on ``documents(doc_id, text, claimed_name, ..)``: adds doc_type, name, dob, income,
    category; a field the document does not give is ``''``."""
    kind = F.col("doc_type")
    lines = F.col("__lines")
    name = F.coalesce(targeted_name(lines, "claimed_name"), fallback_name(lines), F.lit(""))
    blank = F.lit("")
    typed = documents.withColumn("doc_type", detect_doc_type("text")).withColumn(
        "__lines", F.when(F.col("doc_type") == DOC_IDENTITY, text_lines("text"))
    )
    return typed.select(
        *documents.columns,
        "doc_type",
        F.when(kind == DOC_IDENTITY, name).otherwise(blank).alias("name"),
        F.when(kind == DOC_IDENTITY, extract_birth_date("text")).otherwise(blank).alias("dob"),
        F.when(kind == DOC_INCOME, extract_income("text")).otherwise(blank).alias("income"),
        F.when(kind == DOC_CASTE, extract_category("text")).otherwise(blank).alias("category"),
    )


# ---- D7 payload override ------------------------------------------------------------------


def _payload_match(payload: Column, field: str) -> Column:
    pattern = rf"(?iu)<{field}[^>]*>([^<]+)</{field}>"
    return F.when(payload.rlike(pattern), strip(F.regexp_extract(payload, pattern, 1)))


def override_from_payload(extracted: DataFrame, payload: str = "payload") -> DataFrame:
    """An identity document's code beats its text: child tags replace, attributes fill."""
    rows = extracted.withColumn("__xml", payload_struct(payload)).withColumn(
        "__capital", payload_struct(payload, CAPITAL_SCHEMA)
    )
    xml, capital = F.col("__xml"), F.col("__capital")
    parsed = F.coalesce(
        *[xml[f] for f in ("name", "dob", "_name", "_dob")], capital["_Name"], capital["_DOB"]
    )
    tag_name = F.when(parsed.isNull(), _payload_match(F.col(payload), "name")).otherwise(
        strip(xml["name"])
    )
    tag_dob = F.when(parsed.isNull(), _payload_match(F.col(payload), "dob")).otherwise(
        strip(F.nullif(xml["dob"], F.lit("")))
    )
    attribute_name = F.coalesce(F.nullif(xml["_name"], F.lit("")), capital["_Name"])
    attribute_dob = F.coalesce(F.nullif(xml["_dob"], F.lit("")), F.nullif(capital["_DOB"], F.lit("")))
    name = F.coalesce(
        F.when(is_valid_name(tag_name), tag_name),
        F.nullif("name", F.lit("")),
        F.when(is_valid_name(attribute_name), attribute_name),
        F.lit(""),
    )
    dob = F.coalesce(
        F.when(tag_dob.isNotNull(), normalize_date(tag_dob)),
        F.nullif("dob", F.lit("")),
        F.when(attribute_dob.isNotNull(), normalize_date(attribute_dob)),
        F.lit(""),
    )
    applies = (F.col("doc_type") == DOC_IDENTITY) & present(payload)
    return rows.withColumn("__name", F.when(applies, name).otherwise(F.col("name"))).withColumn(
        "dob", F.when(applies, dob).otherwise(F.col("dob"))
    ).withColumn("name", F.col("__name")).drop("__name", "__xml", "__capital")


# ---- F18, F19, D8, D9 identity scan ---------------------------------------------------------


def _name_text(line: Column) -> Column:
    """Latin letters, blanks and dots of a line."""
    return strip(F.regexp_replace(line, r"[^A-Za-z\s.]", ""))


def _readable(line: Column) -> Column:
    return ~contains_any(F.upper(line), NOISE_WORDS)


def positional_name(lines: Column) -> Column:
    """(dob, name, source) around the first date line of the first 20."""
    head = F.slice(lines, 1, 20)
    at = F.array_position(F.transform(head, lambda x: x.rlike(SCAN_DATE)), True).cast("int")
    line = F.get(head, at - 1)
    date = F.regexp_extract(line, SCAN_DATE, 1)
    start = F.instr(line, date) - 1
    leading = _name_text(strip(F.left(line, start.cast("int"))))
    same_line = F.when((start > 3) & is_valid_name(leading), title_case(leading))
    earlier = F.reverse(F.slice(head, F.lit(1), F.greatest(at - 1, F.lit(0))))
    cleaned = F.transform(
        F.filter(earlier, _readable),
        lambda x: F.regexp_replace(_name_text(x), r"\s+", " "),
    )
    before = title_case(first_of(F.filter(cleaned, is_valid_name)))
    found = at > 0
    return F.struct(
        F.when(found, normalize_date(date)).alias("dob"),
        F.when(found, F.coalesce(same_line, before)).alias("name"),
        F.when(found & same_line.isNull() & before.isNotNull(), F.lit("ocr_predate")).alias("source"),
    )


def global_name(lines: Column) -> Column:
    """First readable line of the first 20 that is a valid name of two words or more."""
    kept = F.filter(F.slice(lines, 1, 20), lambda x: (F.length(x) >= 3) & _readable(x))
    cleaned = F.transform(kept, lambda x: F.regexp_replace(_name_text(x), r"\s+", " "))
    return title_case(
        first_of(F.filter(cleaned, lambda x: is_valid_name(x) & (F.size(words(x)) >= 2)))
    )


def line_gender(lines: Column) -> Column:
    """Gender on the last line (of 20, without a year) that names one."""
    upper = F.transform(
        F.filter(F.slice(lines, 1, 20), lambda x: ~x.rlike(r"\d{4}")), lambda x: F.upper(x)
    )
    named = F.filter(upper, lambda x: x.contains("MALE"))
    last = F.get(F.reverse(named), F.lit(0))
    return F.when(last.contains("FEMALE"), F.lit("Female")).when(last.isNotNull(), F.lit("Male"))


def parse_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """adds name, dob, gender, address, is_verified, debug_source."""
    rows = payloads.withColumn("__parsed", payload_struct(payload))
    rows = rows.withColumn("__xml", xml_identity(F.col("__parsed"), payload))
    known = F.col("__xml")
    rows = rows.withColumn(
        "__id", F.when(known["name"] != "", known).otherwise(pattern_identity(payload, known))
    )
    return rows.select(
        *payloads.columns,
        "__id.name", "__id.dob", "__id.gender", "__id.address",
        (F.col("__id.name") != "").alias("is_verified"),
        "__id.debug_source",
    )


def scan_identity(scans: DataFrame, payload: str = "payload", text: str = "text") -> DataFrame:
    """Payload first, document text (D8, D9) for what it leaves unverified; adds ``status``."""
    rows = parse_payloads(scans, payload)
    open_ = ~F.col("is_verified")
    rows = rows.withColumn("__lines", F.when(open_, text_lines(text)))
    lines = F.col("__lines")
    at_date = F.when(F.col("dob") == "", positional_name(lines))
    rows = rows.withColumn("__at", at_date).withColumn(
        "__global", F.when(open_ & F.col("__at.name").isNull(), global_name(lines))
    )
    name = F.coalesce("__at.name", "__global", F.lit(""))
    source = F.coalesce(
        "__at.source", F.when(F.col("__global").isNotNull(), F.lit("ocr_global")), F.lit("")
    )

    def unless_verified(value: Column, column: str) -> Column:
        return F.when(open_, value).otherwise(F.col(column)).alias(column)

    resolved = rows.select(
        *scans.columns,
        unless_verified(name, "name"),
        unless_verified(F.coalesce("__at.dob", "dob"), "dob"),
        unless_verified(F.coalesce(line_gender(lines), "gender"), "gender"),
        "address",
        unless_verified(source, "debug_source"),
    )
    verified = F.col("name") != ""
    return resolved.withColumn("is_verified", verified).withColumn(
        "status", F.when(verified, F.lit("Success")).otherwise(F.lit("Failed"))
    )


# ---- D10 upload score -----------------------------------------------------------------------


def names_agree(left: Column, right: Column) -> Column:
    """Equal, or one holds the other and has more than three characters; on cleaned names."""
    return (
        (left == right)
        | ((F.length(left) > 3) & right.contains(left))
        | ((F.length(right) > 3) & left.contains(right))
    )


def status_of(score: Column, verified_at: int, processing_at: int | None = None) -> Column:
    status = F.when(score >= verified_at, VERIFIED).when(score >= 50, PARTIAL)
    if processing_at is not None:
        status = status.when(score >= processing_at, PROCESSING)
    return status.otherwise(REJECTED)


def compact_messages(*messages: Column) -> Column:
    """The reasons that apply, in order."""
    return F.array_compact(F.array(*messages))


def _quoted(value: Column | str) -> Column:
    return F.concat(F.lit("'"), F.coalesce(col(value), F.lit("None")), F.lit("'"))


def score_upload(rows: DataFrame) -> DataFrame:
    """D10 on rows with name, dob, income, category, doc_type, claimed_name, claimed_dob."""
    claimed, found = clean_val_no_space("claimed_name"), clean_val_no_space("name")
    name_ok = (
        present("claimed_name") & present("name") & (claimed != "") & (found != "")
        & names_agree(claimed, found)
    )
    claimed_date, found_date = normalize_date("claimed_dob"), normalize_date("dob")
    claimed_key, found_key = clean_val_no_space(claimed_date), clean_val_no_space(found_date)
    dob_ok = (
        present("claimed_dob") & present("dob") & (claimed_key != "") & (claimed_key == found_key)
    )
    score = F.when(name_ok, 50).otherwise(0) + F.when(dob_ok, 50).otherwise(0)
    name_note = F.when(
        present("claimed_name") & ~name_ok,
        F.when(
            present("name"),
            F.concat(
                F.lit("Name mismatch: "), _quoted("name"), F.lit(" (Card) vs "),
                _quoted("claimed_name"), F.lit(" (Entered)"),
            ),
        ).otherwise(F.lit("Name not found in document")),
    )
    dob_note = F.when(
        present("claimed_dob") & ~dob_ok,
        F.when(
            present("dob"),
            F.concat(
                F.lit("DOB mismatch: "), _quoted(found_date), F.lit(" (Card) vs "),
                _quoted(claimed_date), F.lit(" (Entered)"),
            ),
        ).otherwise(F.lit("DOB not found in document")),
    )
    identity = F.when(F.col("score") >= 40, VERIFIED).otherwise(MISMATCH)
    return (
        rows.withColumn("score", score)
        .withColumn("status", status_of(F.col("score"), 90, 40))
        .withColumn("stored_status", F.when(F.col("score") >= 50, VERIFIED).otherwise("Processed"))
        .withColumn("document_key", document_key("doc_type"))
        .withColumn("name_result", identity)
        .withColumn("dob_result", identity)
        .withColumn("income_result", F.lit(NOT_SCANNED))
        .withColumn("category_result", F.lit(NOT_SCANNED))
        .withColumn("mismatches", compact_messages(name_note, dob_note))
    )


def upload_documents(documents: DataFrame, payload: str | None = None) -> DataFrame:
    """D1-D7, D10 in one pass over ``documents``: one scored row per document."""
    rows = extract_fields(documents)
    if payload:
        rows = override_from_payload(rows, payload)
    deep = deep_scan_name("text", "claimed_name")
    rows = rows.withColumn(
        "name", F.coalesce(F.nullif("name", F.lit("")), deep, F.lit(""))
    )
    return score_upload(rows)


def upload_summary() -> list[Column]:
    """D12 for uploads: ``N/A`` and ``0`` for empty fields."""
    return [
        F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("0" if c == "income" else "N/A")).alias(f"summary_{c}")
        for c in ("name", "dob", "income", "category")
    ]


# ---- J13, D11 profile verification -----------------------------------------------------------


def with_documents(claims: DataFrame, users: DataFrame) -> DataFrame:
    """Claims with the user's stored documents; ``user_found`` tells an unknown user."""
    stored = users.select("user_id", "documents", F.lit(True).alias("user_found"))
    return claims.join(stored, "user_id", "left").withColumn(
        "user_found", F.coalesce("user_found", F.lit(False))
    )


def verify_profile(claims: DataFrame, users: DataFrame) -> DataFrame:
    """D11 on ``claims(user_id, name, dob, income, category, identity)``.

    ``identity`` (struct name, dob) is identity data supplied with the claim and beats the stored
    one if it has a name. Unknown users keep their row, with status ``User not found``.
    """
    rows = with_documents(claims, users)
    documents = F.col("documents")

    def stored(key: str) -> Column:
        return F.try_element_at(documents, F.lit(key))["extracted_data"]

    supplied = F.col("identity")
    use_supplied = present(supplied["name"])
    rows = rows.select(
        *claims.columns, "user_found",
        F.when(use_supplied, supplied["name"]).otherwise(stored("aadhaar")["name"]).alias("card_name"),
        F.when(use_supplied, supplied["dob"]).otherwise(stored("aadhaar")["dob"]).alias("card_dob"),
        stored("income")["income"].alias("card_income"),
        stored("caste")["category"].alias("card_category"),
    )
    return score_claims(rows)


def score_claims(rows: DataFrame) -> DataFrame:
    """D11 scoring on rows with claimed name, dob, income, category and the card_* columns."""
    found, claimed = clean_val_no_space("card_name"), clean_val_no_space("name")
    name_ok = present("card_name") & present("name") & names_agree(claimed, found)
    found_date = clean_val_no_space(normalize_date("card_dob"))
    claimed_date = clean_val_no_space(normalize_date("dob"))
    dob_ok = present("card_dob") & present("dob") & (found_date != "") & (found_date == claimed_date)

    card_income = strip("card_income").try_cast("bigint")
    raw = F.coalesce(F.nullif(F.col("income").cast("string"), F.lit("")), F.lit("0"))
    plain = F.substring_index(F.replace(raw, F.lit(","), F.lit("")), ".", 1)
    claimed_income = strip(plain).try_cast("bigint")
    readable = card_income.isNotNull() & claimed_income.isNotNull()
    income_ok = (
        readable
        & (claimed_income > 0)
        & (F.abs(card_income - claimed_income) < claimed_income * F.lit(0.15))
    )
    income_result = (
        F.when(F.col("card_income").isNull(), NOT_SCANNED)
        .when(~readable, PARSE_ERROR)
        .when(income_ok, VERIFIED)
        .otherwise(MISMATCH)
    )
    category_ok = clean_val_no_space("card_category") == clean_val_no_space("category")
    category_result = (
        F.when(~present("card_category"), NOT_SCANNED)
        .when(category_ok, VERIFIED)
        .otherwise(MISMATCH)
    )
    points = (
        F.when(name_ok & dob_ok, 50).otherwise(0)
        + F.when(F.col("income_result") == VERIFIED, 25).otherwise(0)
        + F.when(F.col("category_result") == VERIFIED, 25).otherwise(0)
    )
    notes = compact_messages(
        F.when(~name_ok, F.concat(
            F.lit("Name mismatch: Card says "), _quoted("card_name"),
            F.lit(" vs Input "), _quoted("name"))),
        F.when(~dob_ok, F.concat(
            F.lit("DOB mismatch: Card says "), _quoted("card_dob"),
            F.lit(" vs Input "), _quoted("dob"))),
        F.when(F.col("income_result") == MISMATCH, F.concat(
            F.lit("Income mismatch: Extracted "), card_income.cast("string"),
            F.lit(", Input "), claimed_income.cast("string"))),
        F.when(F.col("category_result") == MISMATCH, F.concat(
            F.lit("Category mismatch: "), _quoted("card_category"),
            F.lit(" vs "), _quoted("category"))),
    )
    scored = (
        rows.withColumn("name_result", F.when(name_ok, VERIFIED).otherwise(MISMATCH))
        .withColumn("dob_result", F.when(dob_ok, VERIFIED).otherwise(MISMATCH))
        .withColumn("income_result", income_result)
        .withColumn("category_result", category_result)
        .withColumn("score", points)
        .withColumn("status", status_of(F.col("score"), 80))
        .withColumn("mismatches", notes)
    )
    if "user_found" in rows.columns:
        scored = scored.withColumn(
            "status", F.when(F.col("user_found"), F.col("status")).otherwise("User not found")
        )
    for name in ("name", "dob", "category"):
        scored = scored.withColumn(f"summary_{name}", F.coalesce(f"card_{name}", F.lit("N/A")))
    return scored.withColumn("summary_income", F.coalesce("card_income", F.lit("0")))


# ---- A7, D13 audit ----------------------------------------------------------------------------


def looks_corrupt(name: Column) -> Column:
    initial = F.substring(name, 1, 1)
    repeats = F.length(name) - F.length(F.replace(name, initial, F.lit("")))
    return present(name) & (contains_any(F.upper(name), CORRUPT_NAME_MARKS) | (repeats >= 3))


def invalid_documents(users: DataFrame) -> DataFrame:
    """(user_id, invalid_types): sorted keys of stored documents whose name is corrupt."""
    bad = F.map_filter("documents", lambda _, d: looks_corrupt(d["extracted_data"]["name"]))
    return users.select("user_id", F.sort_array(F.map_keys(bad)).alias("invalid_types"))


def audit_stored(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users with corrupt documents unset, report of what was found)."""
    report = invalid_documents(users).select(
        "user_id",
        F.coalesce("invalid_types", F.array().cast("array<string>")).alias("invalid_types"),
    ).withColumn(
        "status", F.when(F.size("invalid_types") > 0, F.lit("Cleaned")).otherwise(F.lit("Valid"))
    )
    bad = F.map_filter("documents", lambda _, d: looks_corrupt(d["extracted_data"]["name"]))
    holds_bad = F.coalesce(F.size(F.map_keys(bad)) > 0, F.lit(False))
    cleaned = users.withColumn("documents", F.when(~holds_bad, F.col("documents")))
    return cleaned, report


