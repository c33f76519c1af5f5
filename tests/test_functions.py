from pyspark.sql import functions as F

from entitlekit.functions import documents as docs
from entitlekit.functions import language, text


def test_cleaning(each):
    assert each(text.clean_query, ["  What, is? IT!.  ", "..."]) == ["what is it", ""]
    assert each(text.clean_question, ["A, b? "]) == ["a, b "]
    assert each(text.clean_val, ["  Asha-Rao, K.  ", None]) == ["asharao k", ""]
    assert each(text.clean_val_no_space, ["  Asha-Rao, K.  ", None]) == ["asharaok", ""]
    assert each(text.words, ["  a b\t\nc ", " "]) == [["a", "b", "c"], []]
    assert each(text.word_set, ["a b a"]) == [["a", "b"]]
    assert each(text.strip, ["　\xa0x\n"]) == ["x"]


def test_title_case_after_any_non_letter(each):
    got = each(text.title_case, ["tamil nadu", "a.b-c d'e", "ANNA"])
    assert got == ["Tamil Nadu", "A.B-C D'E", "Anna"]


def test_upper_case_is_that_of_sql_for_letters_that_would_grow(each):
    import duckdb

    texts = ["", "x\nßéñ ßß", "Straße ẞ ŉ ﬁ ᾳ", *text.GROWING]
    sql = [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
    assert each(text.upper_letters, texts) == sql
    assert sql[1] == "X\nẞÉÑ ẞẞ"


def test_steps_mask_and_labels(each, value):
    assert each(text.split_steps, ["1. Visit A. 2. Apply.", "a\n\n3.\nb"]) == [
        ["Visit A.", "Apply."], ["a", "b"],
    ]
    masked = each(text.mask, ["1234567890", "abc", "", None, "abcdefgh", "abcdef"])
    assert masked == ["1234xx7890", "abc", "N/A", "N/A", "abcdefgh", "xxxxxx"]
    assert each(text.topic_title, ["state_tamil_nadu"]) == ["Tamil Nadu"]
    assert each(text.truncate_desc, ["x" * 101]) == ["x" * 100 + "..."]
    lists = {
        text.display_categories: (["sc", "general"], ["SC", "General"]),
        text.display_gender: (["female"], ["Female"]),
        text.display_special: (["senior_citizen"], ["Senior Citizen"]),
        text.display_states: (["all", "x"], ["All India"]),
    }
    for label, (items, shown) in lists.items():
        assert value(label(F.lit(items))) == shown


def test_dates(each):
    given = ["1990-05-15", "5/3/1990", "DOB: 01-02-1990", "Year 1990", "abc", "99/99/1990", None]
    assert each(docs.normalize_date, given) == [
        "1990-05-15", "1990-03-05", "1990-02-01", "1990", "abc", "1990-99-99", "",
    ]


def test_name_validity(each):
    good = ["Asha Rao", "Asha Rao Kumar"]
    bad = [
        "A", "BCD", "Ramesh Pinto", "Clement", "Anantharaman", "ASHA RAO KUMAR", "12345 A",
        "Bhrrgt Sm", "", None,
    ]
    assert each(docs.is_valid_name, good + bad) == [True] * len(good) + [False] * len(bad)


def test_document_type_income_and_category(each):
    assert each(docs.detect_doc_type, ["AADHAAR income certificate", "annual income", "Scheduled", "hello"]) == [
        "Aadhaar Card", "Income Certificate", "Caste Certificate", "Unknown",
    ]
    assert each(docs.document_key, ["Aadhaar Card", "Unknown"]) == ["aadhaar", "unknown"]
    assert each(docs.extract_income, ["Annual Income: 2,50,000", "Rs. 500", "Total 99999 Income 100000"]) == [
        "250000", "", "99999",
    ]
    assert each(docs.extract_category, ["CASTE CERTIFICATE GENERAL", "SCHEDULED TRIBE", "OBC", "x"]) == [
        "ST", "SC", "OBC", "",
    ]
    assert each(docs.extract_birth_date, ["on 01/02/1990 or 03/04/1991", "in 1988", "none"]) == [
        "1990-02-01", "1988", "",
    ]


def test_languages(each, value):
    got = each(language.detect_language, ["नमस्ते", "வணக்கம்", "hello నమస్కారం", "தமிழ் नमस्ते", "x", "plain", None])
    assert got == ["hi", "ta", "te", "hi", "en", "en", "en"]
    assert value(language.target_language(F.lit("auto"), F.lit("வணக்கம்"))) == "ta"
    assert value(language.target_language(F.lit(""), F.lit("hello"))) == "en"
    assert value(language.target_language(F.lit("kn"), F.lit("hello"))) == "kn"


def test_compound_texts(each):
    long_ = "word " * 20
    lines = f"{long_}. a\n b \n\nc"
    assert each(language.split_compound, [lines, f"{long_}. b. c", "a. b", long_]) == [
        [f"{long_}. a", "b", "c"], [long_.strip(), "b", "c"], ["a. b"], [long_],
    ]


def test_title_prefix(each):
    assert each(language.strip_title_prefix, ['Title: "A b"', "शीर्षक : x", "Note: y", "plain"]) == [
        "A b", "x", "Note: y", "plain",
    ]
