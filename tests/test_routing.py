import pytest

from entitlekit.operators import routing as r
from entitlekit.schemas import DICTIONARY, FAQ, MESSAGES, SCHEME
from test_eligibility import make_scheme


@pytest.fixture(scope="module")
def catalog(spark):
    names = ["Pradhan Mantri Kisan Samman Nidhi", "Ayushman Bharat", "Stand Up India", "Rural Housing Plan"]
    schemes = spark.createDataFrame(
        [{**make_scheme(i + 1, min_age=18, max_income=1000), "name": n, "description": f"About {n}",
          "benefits": "Money", "target_beneficiaries": "business"} for i, n in enumerate(names)], SCHEME)
    faqs = spark.createDataFrame(
        [(1, "How to get a loan?", "Ask a bank.", "business", "", None),
         (2, "What is Ayushman Bharat card limit?", "Five lakh.", "health", "Ayushman Bharat", None),
         (3, "Which zebra grant exists?", "None.", "general", "", None),
         (4, "Where do farmers register?", "Online.", "agriculture", "", None),
         (5, "old text", "old answer", "general", "",
          {"question": "Quokka permit rules?", "answer": "See office.", "category": None, "scheme": None})], FAQ)
    words = [
        ("farmers", "agriculture"), ("kisan", "agriculture"), ("hospital", "health"), ("ayushman", "health"),
        ("loan", "business"), ("mudra", "business"), ("maharashtra", "state_maharashtra"),
    ]
    return schemes, faqs, spark.createDataFrame(words, "word string, label string")


CASES = [
    ("", "R1"), ("   ", "R1"), ("main menu please", "R2"), ("hi", "R3"), ("Hello Bot!", "R3"),
    ("who are you", "R3"), ("thanks a lot", "R4"), ("what is your name", "R5"), ("Ayushman Bharat", "R6"),
    (" ayushman bharat? ", "R6"), ("show schemes", "R7"), ("my state", "R8"), ("State?", "R8"),
    ("ayushman hospital", "R9"), ("loan for farmers", "R10"), ("pm kisan", "R10"),
    ("zebra grant", "R11"), ("quokka permit", "R11"), ("tell me of ayushman bharat and mantri", "R9"),
    ("mantri of the samman", "R12"), ("stand", "R12"), ("xyzzy", "R13"), ("???", "R12"),
    ("maharashtra", "R13"),
]


def test_stages_are_total_and_ordered(spark, catalog):
    queries = spark.createDataFrame(
        [(i, q, "en") for i, (q, _) in enumerate(CASES)], "query_id long, query string, lang string"
    )
    routes = {x.query_id: x for x in r.route_queries(queries, *catalog, assistant="Bot").collect()}
    assert {CASES[i][0]: x.stage for i, x in routes.items()} == dict(CASES)
    by_text = {CASES[i][0]: x for i, x in routes.items()}
    assert by_text["loan for farmers"].topic == "business"
    assert by_text["pm kisan"].topic == "agriculture"
    assert by_text["zebra grant"].faq_pos == 3
    assert by_text["mantri of the samman"].scheme_pos == 1
    assert by_text["???"].scheme_pos == 1
    assert by_text["ayushman hospital"].scheme_pos == 2


def test_localized_routes_and_answers(spark, catalog):
    schemes, faqs, keywords = catalog
    dictionary = spark.createDataFrame(
        [("from_en", "hi", "Ayushman Bharat", "आयुष्मान भारत", 1), ("from_en", "hi", "Main Menu", "मुख्य मेनू", 2),
         ("from_en", "hi", "List All Schemes", "सभी दिखाएं", 3), ("to_en", None, "ज़ेबरा", "zebra grant", 4),
         ("from_en", "hi", "None.", "कोई नहीं।", 5)], DICTIONARY)
    messages = r.default_messages(spark, "Bot").unionByName(
        spark.createDataFrame([("hi", "greeting", "नमस्ते!")], MESSAGES))
    queries = spark.createDataFrame(
        [(1, "आयुष्मान भारत", "hi"), (2, "मुख्य मेनू", "auto"), (3, "सभी दिखाएं", None), (4, "ज़ेबरा", "hi"),
         (5, "loan", "en"), (6, "xyzzy", "en"), (7, "show schemes", "en"), (8, "my state", "en")],
        "query_id long, query string, lang string")
    routes = r.route_queries(queries, schemes, faqs, keywords, dictionary)
    answers = r.answer_queries(routes, schemes, faqs, messages, dictionary)
    got = {x.query_id: x for x in answers.collect()}
    assert [got[i].stage for i in range(1, 9)] == ["R6", "R2", "R7", "R11", "R10", "R13", "R7", "R8"]
    assert got[2].response == "नमस्ते!" and got[2].suggestions[:2] == ["मुख्य मेनू", "सभी दिखाएं"]
    assert got[4].response == "कोई नहीं।"
    assert got[5].suggestions == ["Main Menu", "List All Schemes", "How to get a loan?"]
    assert got[7].response.startswith("4 schemes ") and got[7].suggestions == ["Main Menu"]
    assert got[8].suggestions[:2] == ["Main Menu", "Maharashtra"]
    assert got[6].response.startswith("That question") and len(got[6].suggestions) == 7
    assert got[1].response.startswith("आयुष्मान भारत About Ayushman Bharat ") and got[1].lang == "hi"


def test_card_layout(spark, catalog):
    card = {x.scheme_pos: x.card for x in r.scheme_cards(catalog[0]).collect()}[2]
    assert card == (
        "AYUSHMAN BHARAT About Ayushman Bharat \n\nELIGIBILITY CRITERIA:\n• Age: 18-Unlimited years\n"
        "• Max Annual Income: Up to ₹1000\n\n\nREQUIRED DOCUMENTS:\n• Aadhaar Card\n• Identity Proof\n"
        "• Income Certificate\n• Bank Details\n\n\nHOW TO APPLY:\nApply via official portal. \n\nBENEFITS:\nMoney "
    )


def test_card_heading_keeps_a_sharp_s_one_letter(spark):
    schemes = spark.createDataFrame([{**make_scheme(1), "name": "Große Hilfe", "description": "Große Hilfe"}], SCHEME)
    assert r.scheme_cards(schemes).first()["card"].startswith("GROẞE HILFE Große Hilfe")


def test_unverified_hits_go_before_rows_are_grouped(spark, catalog):
    schemes, faqs, keywords = catalog
    queries = spark.createDataFrame([(1, "xyzzy"), (2, "ayushman hospital")], "query_id long, query string")
    for strategy in ("broadcast", "shuffle"):
        routes = r.route_queries(queries, schemes, faqs, keywords, strategy=strategy)
        plan = routes._jdf.queryExecution().analyzed().toString()
        assert any("Filter " in line and "coalesce(proved#" in line for line in plan.splitlines())
        assert {x["query_id"]: x["stage"] for x in routes.collect()} == {1: "R13", 2: "R9"}
