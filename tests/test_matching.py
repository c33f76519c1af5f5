import random

import pytest

from entitlekit.fixed_values import EXTRA_BOOSTERS, STOP_WORDS
from entitlekit.operators import containment as c
from entitlekit.operators import faq, matching

SYLLABLES = ["ka", "ri", "to", "me", "s", "e", "la", "ng", "é"]


def make_word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 1, 2, 3, 4])))


def make_text(rng, n):
    return " ".join(make_word(rng) for _ in range(n))


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_texts_holding_equals_brute_force(spark, strategy):
    rng = random.Random(1)
    texts = [(i, make_text(rng, rng.randrange(0, 25))) for i in range(80)]
    phrases = [(i, make_text(rng, rng.choice([1, 1, 2, 3]))) for i in range(60)]
    phrases += [(100, "karito mela"), (101, "e"), (102, " to ")]
    texts += [(100, "xx karito mela yy"), (101, "karito  mela")]
    got = c.texts_holding(
        spark.createDataFrame(texts, "t long, text string"), "t", "text",
        spark.createDataFrame(phrases, "p long, phrase string"), "p", "phrase", strategy=strategy,
    )
    assert sorted(map(tuple, got.collect())) == sorted(
        (t, p) for t, text in texts for p, phrase in phrases if phrase in text
    )


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_phrases_inside_equals_brute_force(spark, strategy):
    rng = random.Random(2)
    texts = [(i, make_text(rng, 15)) for i in range(30)]
    phrases = [(i, make_text(rng, rng.choice([1, 2]))) for i in range(80)]
    phrases += [(200, "e"), (201, texts[3][1])]
    got = c.phrases_inside(
        spark.createDataFrame(phrases, "p long, phrase string"), "p", "phrase",
        spark.createDataFrame(texts, "t long, text string"), "t", "text", strategy=strategy,
    )
    assert sorted(map(tuple, got.collect())) == sorted(
        (p, t) for t, text in texts for p, phrase in phrases if phrase in text
    )


def score_by_hand(query, faqs, boosters):
    cleaned = query.lower().strip()
    for ch in "?.!,":
        cleaned = cleaned.replace(ch, "")
    cleaned = cleaned.strip()
    keys = set(cleaned.split()) - set(STOP_WORDS)
    exact = [pos for pos, q in faqs if plain(q) and plain(q).strip() == cleaned]
    if exact:
        return (min(exact), None)
    best = (None, 0.0)
    for pos, question in faqs:
        q = plain(question)
        known = set(q.split()) - set(STOP_WORDS)
        if not q or not keys or not known:
            continue
        common = keys & known
        score = len(common) / len(keys)
        if common & boosters:
            score += 0.3 * len(common & boosters)
        if cleaned in q or q in cleaned:
            score += 0.4
        if score > best[1]:
            best = (pos, score)
    return best if best[1] >= 0.3 else None


def plain(question):
    return question.lower().replace("?", "").replace(".", "").replace("!", "")


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_best_faq_equals_brute_force(spark, strategy):
    rng = random.Random(3)
    filler = ["what", "is", "the", "how"]
    faqs = [(i, " ".join([*rng.sample(filler, 2), make_text(rng, rng.choice([1, 2, 6, 12]))]) + "?") for i in range(40)]
    faqs += [(50, "Jyoti help"), (51, ""), (52, "what is"), (53, faqs[0][1]), (54, "e")]
    queries = [(i, make_text(rng, rng.choice([1, 2, 3, 8, 20, 40]))) for i in range(120)]
    # a third of all queries are one question, and one asks in other words
    queries += [(1000 + i, faqs[7][1].upper()) for i in range(60)]
    queries += [(2000, "jyoti " + make_text(rng, 9)), (2001, "What is!"), (2002, "???"), (2003, "the"),
                (2004, "x " + plain(faqs[5][1]) + " y z w v u"), (2005, faqs[3][1][2:9])]
    keywords = spark.createDataFrame([("karito", "t")], "word string, label string")
    table = spark.createDataFrame(
        [(p, q, "a", "c", "") for p, q in faqs],
        "pos long, question string, answer string, category string, scheme string",
    )
    got = faq.best_faq(
        spark.createDataFrame(queries, "query_id long, query string"), table,
        faq.vocabulary(keywords), strategy,
    )
    found = {r.query_id: (r.faq_pos, r.score) for r in got.collect()}
    boosters = {"karito", *EXTRA_BOOSTERS}
    expected = {i: score_by_hand(q, faqs, boosters) for i, q in queries}
    assert found == {i: e for i, e in expected.items() if e}


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_scheme_search_equals_brute_force(spark, strategy):
    rng = random.Random(4)
    names = [(i, make_text(rng, rng.choice([1, 2, 3, 4]))) for i in range(60)]
    names += [(70, "karito karito"), (71, "same name"), (72, "Same Name")]
    texts = [(i, make_text(rng, rng.choice([0, 1, 5, 12]))) for i in range(90)]
    texts += [(200, "a same name b"), (201, "xkaritox")]
    schemes = spark.createDataFrame([(str(p), p, n) for p, n in names], "scheme_id string, pos long, name string")
    table = spark.createDataFrame(texts, "query_id long, topic_text string")

    def first(test):
        hits = {i: [p for p, n in names if test(t, n.lower())] for i, t in texts}
        return {i: min(h) for i, h in hits.items() if h}

    def collect(df):
        return {r.query_id: r.pos for r in df.collect()}

    assert collect(matching.contained_scheme(table, schemes, strategy)) == first(lambda t, n: n in t)
    assert collect(matching.partial_scheme(table, schemes, strategy)) == first(
        lambda t, n: sum(w in t for w in n.split() if len(w) > 3) >= 2
    )
    assert collect(matching.token_scheme(table, schemes, strategy)) == first(
        lambda t, n: (t.split() or [""])[0] in n
    )


def test_scheme_question_lists(spark):
    schemes = spark.createDataFrame(
        [("1", 1, "Solar Pump Yojana"), ("2", 2, "Other")], "scheme_id string, pos long, name string"
    )
    faqs = spark.createDataFrame(
        [(1, "About yojana", "a", "c", ""), (2, "Tagged", "a", "c", "solar pump yojana"),
         (3, "About yojana", "b", "c", ""), (4, "pumps", "a", "c", ""), (5, "none", "a", "d", "x")],
        "pos long, question string, answer string, category string, scheme string",
    )
    lists = {r.scheme_id: r.questions for r in faq.scheme_questions(schemes, faqs).collect()}
    assert lists == {"1": ["Tagged", "About yojana", "pumps"]}
    assert sorted(map(tuple, faq.worded_faqs(schemes, faqs).collect())) == [("1", 1), ("1", 3), ("1", 4)]


def test_related_faqs_of_a_large_group(spark):
    rows = [(i, f"q{i}", "a", "big", "s" if i < 12 else "") for i in range(40)]
    rows += [(100, "lone", "a", "solo", "")]
    faqs = spark.createDataFrame(
        rows, "pos long, question string, answer string, category string, scheme string"
    )
    related = {r.pos: r.related for r in faq.related_faqs(faqs).collect()}
    assert related[0] == [f"q{i}" for i in range(1, 9)] + ["q9", "q10"]
    assert related[3] == ["q0", "q1", "q2", "q4", "q5", "q6", "q7", "q8", "q9", "q10"]
    assert related[30] == [f"q{i}" for i in range(10)]
    assert related[100] == []


def test_stratified_sample_is_seeded_and_full(spark):
    rows = [(i, f"q{i}", "a", f"c{i % 3}", "") for i in range(30)]
    faqs = spark.createDataFrame(
        rows, "pos long, question string, answer string, category string, scheme string"
    )
    first = faq.stratified_sample(faqs, seed=5).collect()
    assert first == faq.stratified_sample(faqs, seed=5).collect()
    assert len(first) == 5 and {r.category for r in first} == {"c0", "c1", "c2"}

def test_phrases_of_several_words_are_filed_by_words_and_others_by_pieces(spark):
    texts = spark.createDataFrame([
        (1, "xof theyy go"), (2, "a\x1cb  c d"), (3, "pre big house-boat"), (4, "say ñandú"), (5, " "), (6, "of  the go"), (7, "the big\nhouse is"),
    ], "id long, t string")
    phrases = ["of the", "f the", "big hou", "b  c", "e big house", "ñ", "andú", "big house", "y g", "the big\nhouse i", " ", "the go ", "theyy"]
    catalog = spark.createDataFrame([(p, p) for p in phrases], "p string, needle string")
    expected = {(r["id"], p) for r in texts.collect() for p in phrases if p.strip() and p in r["t"]}
    many = catalog.unionByName(spark.range(c.LISTED_MOST + 1).selectExpr("concat('zz', id) p", "concat('zz', id) needle"))
    for strategy in ("broadcast", "shuffle"):
        for listed in (catalog, many):  # few phrases of one word, and too many to search for one by one
            rows = c.texts_holding(texts, "id", "t", listed, "p", "needle", strategy=strategy).collect()
            assert sorted((r["id"], r["p"]) for r in rows) == sorted(expected)
    pieces = c.word_anchors(catalog, "needle", "p")
    assert {r["p"] for r in pieces.collect()} == {p for p in phrases if len(p.split()) > 1}


def test_texts_are_cut_by_word_if_all_phrases_have_several(spark):
    texts = spark.createDataFrame([(1, "one two three")], "id long, t string")
    catalog = spark.createDataFrame([("two thr", "two thr")], "p string, needle string")
    held = c.texts_holding(texts, "id", "t", catalog, "p", "needle", strategy="broadcast")
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # that cuts words
    assert held.count() == 1


def test_queries_are_read_once_and_hold_faqs_of_one_word_and_of_several(spark):
    long_query = " ".join(f"w{i}" for i in range(60)) + " xquokkay red  panda den"
    queries = spark.createDataFrame([(1, long_query), (2, "xquokkay"), (3, "red pandas")], "query_id long, query string")
    faqs = spark.createDataFrame(
        [(1, "quokka", "a", "c", ""), (2, "red  panda", "a", "c", ""), (3, "ok", "a", "c", "")],
        "pos long, question string, answer string, category string, scheme string")
    boosters = spark.createDataFrame([("panda",)], "word string")
    for strategy in ("broadcast", "shuffle"):
        best = faq.best_faq(queries, faqs, boosters, strategy)
        found = {r["query_id"]: (r["faq_pos"], round(r["score"], 3)) for r in best.collect()}
        assert found == {1: (2, round(2 / 64 + 0.7, 3)), 2: (1, 0.4), 3: (2, 0.5)}
    plan = faq.best_faq(queries, faqs, boosters, "broadcast")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [query_id#") == 1
