from pyspark.sql import functions as F

from entitlekit.operators import verification as v
from entitlekit.schemas import DOCUMENTS

ROOT = "PrintLetterBarcodeData"


def scan(spark, payload, text=""):
    rows = spark.createDataFrame([(1, payload, text)], "doc_id int, payload string, text string")
    return v.scan_identity(rows).first()


def test_payload_forms(spark):
    attr = scan(spark, f'<{ROOT} name="Asha Rao" dob="01/02/1990" gender="F" vtc="Pune" state="Maharashtra"/>')
    assert (attr.name, attr.dob, attr.gender, attr.address, attr.is_verified, attr.debug_source) == (
        "Asha Rao", "1990-02-01", "Female", "Pune, Maharashtra", True, "XML_attr_name",
    )
    tags = scan(spark, f"<{ROOT}><name> Asha Rao </name><dob>1990-02-01</dob><gender>M</gender></{ROOT}>")
    assert (tags.name, tags.gender, tags.debug_source) == ("Asha Rao", "Male", "XML_tag_name")
    short = scan(spark, f'<{ROOT} name="Rt" dob="01/02/1990" gender="F"/>')
    assert (short.name, short.dob, short.is_verified, short.status) == ("", "1990-02-01", False, "Failed")
    broken = scan(spark, f"<{ROOT}><name>Asha Rao</name><gender>F</gender><dob>")
    assert (broken.name, broken.gender, broken.debug_source) == ("Asha Rao", "F", "regex_tag_name")
    plain = scan(spark, "Name: Asha Rao\nDOB: 01/02/1990\nGender: Female")
    assert (plain.name, plain.dob, plain.gender, plain.debug_source) == (
        "Asha Rao", "1990-02-01", "Female", "regex_plaintext",
    )
    other = scan(spark, 'x name="Asha Rao" dob="01/02/1990"')
    assert (other.name, other.dob, other.debug_source) == ("Asha Rao", "1990-02-01", "regex_attr_name")


def test_text_scan(spark):
    same = scan(spark, "", "GOVT\nrakesh ranjan 2004-03-27\nMALE\nFEMALE 12")
    assert (same.name, same.dob, same.gender, same.debug_source) == ("Rakesh Ranjan", "2004-03-27", "Female", "")
    before = scan(spark, "", "old line\nrakesh   ranjan!\nMera Zoom\nyr 27/03/2004")
    assert (before.name, before.dob, before.debug_source) == ("Rakesh Ranjan", "2004-03-27", "ocr_predate")
    anywhere = scan(spark, "", "single\nab\nGOVERNMENT X\nmohan lal das")
    assert (anywhere.name, anywhere.dob, anywhere.debug_source) == ("Mohan Lal Das", "", "ocr_global")
    assert scan(spark, "", "").status == "Failed"


def upload(spark, text, name, dob):
    rows = spark.createDataFrame(
        [(1, text, name, dob)], "doc_id int, text string, claimed_name string, claimed_dob string"
    )
    return v.upload_documents(rows).first()


def test_upload_names(spark):
    card = "GOVERNMENT OF INDIA\nVillage Road 7\nMr Asha Rao Kumar\n01/02/1990"
    row = upload(spark, card, "Asha Rao", "1990-02-01")
    # no claimed word has more than three letters but "Asha"; the line that holds it is the name
    assert (row.name, row.dob, row.score, row.status, row.mismatches) == (
        "Mr Asha Rao Kumar", "1990-02-01", 100, "Verified", [],
    )
    fallback = upload(spark, card, "Zed", "1991-01-01")
    assert fallback.name == "Asha Rao Kumar"
    assert (fallback.score, fallback.status, fallback.stored_status) == (0, "Rejected", "Processed")
    assert len(fallback.mismatches) == 2
    deep = upload(spark, "some text of asha-rao here", "Asha Rao", None)
    assert (deep.name, deep.score, deep.name_result) == ("", 0, "Mismatch")
    deep = upload(spark, "some text of asha rao here", "Asha Rao", None)
    assert (deep.name, deep.score, deep.status, deep.document_key) == (
        "Asha Rao", 50, "Partially Verified", "unknown",
    )


def test_upload_scores(spark):
    rows = spark.createDataFrame(
        [(1, "Asha Rao", "1990-01-01", "Asha Rao Kumar", "01/01/1990"),
         (2, "Asha Rao", "1990-01-02", "Asha Rao Kumar", "01/01/1990"),
         (3, "Mohan", "1990-01-02", "Asha Rao Kumar", "01/01/1990"),
         (4, "Asha", None, "", "")],
        "i int, claimed_name string, claimed_dob string, name string, dob string",
    ).withColumn("doc_type", F.lit("Aadhaar Card"))
    got = {r.i: (r.score, r.status, r.mismatches) for r in v.score_upload(rows).collect()}
    assert got[1] == (100, "Verified", [])
    assert got[2][:2] == (50, "Partially Verified")
    assert got[3][:2] == (0, "Rejected")
    assert got[4] == (0, "Rejected", ["Name not found in document"])


CLAIM = "user_id int, name string, dob string, income string, category string, card_name string, card_dob string, card_income string, card_category string"


def test_claim_scores(spark):
    rows = spark.createDataFrame(
        [(1, "Asha Rao", "1990-01-01", "1,10,000.50", "SC", "asha rao", "01/01/1990", "100000", "sc"),
         (2, "Asha Rao", "1990-01-01", "100000", "sc", "Asha", "1991-01-01", "100000", "SC"),
         (3, "Asha", "", "100000", "sc", None, None, "115000", None),
         (4, "Asha", "", "100000", "sc", None, None, "", None),
         (5, "Asha", "", "100000", "sc", None, None, None, ""),
         (6, "आशा", "", "0", "sc", "उषा", None, "0", "st")],
        CLAIM,
    )
    got = {r.user_id: r for r in v.score_claims(rows).collect()}
    assert (got[1].score, got[1].status) == (100, "Verified")
    assert (got[2].score, got[2].status, got[2].name_result, got[2].dob_result) == (
        50, "Partially Verified", "Verified", "Mismatch",
    )
    assert got[3].income_result == "Mismatch"
    assert got[4].income_result == "Error Parsing"
    assert got[5].income_result == "Not Scanned" and got[5].category_result == "Not Scanned"
    assert got[5].summary_name == "N/A" and got[5].summary_income == "0"
    assert got[6].name_result == "Verified" and got[6].income_result == "Mismatch"
    assert got[6].mismatches[-1] == "Category mismatch: 'st' vs 'sc'"


def test_audit(spark):
    rows = [(1, {"aadhaar": ("Asha Rao",), "caste": ("",)}), (2, {"aadhaar": ("GOVERNMENT",), "income": ("Anna na A",)}),
            (3, {"aadhaar": ("banana bob b",)}), (4, None)]
    users = spark.createDataFrame(
        [(i, None if d is None else {k: {"extracted_data": {"name": n[0]}} for k, n in d.items()}) for i, d in rows],
        "user_id int, documents map<string, struct<extracted_data: struct<name: string>>>",
    )
    cleaned, report = v.audit_stored(users)
    assert {r.user_id: r.invalid_types for r in report.collect()} == {
        1: [], 2: ["aadhaar"], 3: ["aadhaar"], 4: [],
    }
    assert {r.user_id for r in cleaned.where("documents is null").collect()} == {2, 3, 4}


def test_stored_documents_schema():
    assert DOCUMENTS.valueType["extracted_data"].dataType.fieldNames()[:4] == ["name", "dob", "income", "category"]
