"""The registered queries: one per operator or group of operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as docs
from ..functions import language, text
from ..operators import (
    directory,
    eligibility,
    faq,
    localization,
    maintenance,
    matching,
    ranking,
    routing,
    verification,
)
from ..schemas import DICTIONARY, FAQ
from ..sizing import shared_dir
from ..sources import catalog
from ..streaming.eligibility import stream_eligibility
from ..streaming.upserts import current_profiles, read_log, stream_current, stream_upsert_profiles
from . import standins as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCRIPT_SAMPLES = [0x0905, 0x0985, 0x0B85, 0x0C05, 0x0C85, 0x0D05, 0x0A85]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(items: Column | str, glue: str = "|") -> Column:
    return F.array_join(items, glue)


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return eligibility.normalize_profiles(s.profile_forms(spark, sf))[0]


# ---- A: eligibility --------------------------------------------------------------------


@query
def eligibility_pairs(spark, sf):
    return eligibility.eligible_pairs(_profiles(spark, sf), s.schemes(spark, sf))


@query
def eligibility_pairs_by_state(spark, sf):
    return eligibility.eligible_pairs_by_state(_profiles(spark, sf), s.schemes(spark, sf))


@query
def eligibility_display(spark, sf):
    shown = eligibility.match_eligible(_profiles(spark, sf), s.schemes(spark, sf))
    return shown.select(
        "profile_id", "scheme_id", "name", "description", "official_website",
        "target_beneficiaries", "application_process", "benefits", "steps", "state",
        F.col("rules.min_age").alias("min_age"), F.col("rules.max_income").alias("max_income"),
        F.col("match_score").cast("bigint").alias("match_score"),
    )


@query
def eligibility_counts(spark, sf):
    profiles = _profiles(spark, sf)
    pairs = eligibility.eligible_pairs(profiles, s.schemes(spark, sf))
    return eligibility.eligible_counts(profiles, pairs)


@query
def profile_normalization(spark, sf):
    return _profiles(spark, sf).select(
        "profile_id", "age", "income", "category", "gender", "special_category", "state",
        "occupation",
    )


@query
def profile_rejects(spark, sf):
    key = F.col("profile_id")
    forms = s.profile_forms(spark, sf)
    forms = forms.withColumn("age", F.when(key % 97 == 0, "n/a").when(key % 89 != 0, F.col("age")))
    forms = forms.withColumn("income", F.when(key % 83 == 0, "12.5").otherwise(F.col("income")))
    good, rejects = eligibility.normalize_profiles(forms)
    return good.select("profile_id", "age", F.lit("").alias("reason")).unionByName(
        rejects.select(
            "profile_id", F.lit(None).cast("bigint").alias("age"),
            F.col("reject_reason").alias("reason"),
        )
    )


# ---- B: directory ------------------------------------------------------------------------


def _browse(spark, sf, **choice):
    rows = directory.browse(s.directory(spark, sf), **choice)
    return rows.select("scheme_id", "pos", "badge", F.col("state_rank").cast("bigint").alias("state_rank"))


@query
def directory_search(spark, sf):
    return _browse(spark, sf, search="RING")


@query
def directory_audience(spark, sf):
    return _browse(spark, sf, audience="Economy")


@query
def directory_state(spark, sf):
    return _browse(spark, sf, search="brand", state="nation_3")


@query
def directory_national(spark, sf):
    return _browse(spark, sf, state="All India")


@query
def directory_order(spark, sf):
    """Every scheme's position, the schemes of one state first."""
    rows = directory.browse_order(s.directory(spark, sf), state="nation_3")
    return rows.select("scheme_id", "badge", "position")


@query
def directory_badges(spark, sf):
    rows = s.directory(spark, sf)
    return rows.select(
        "scheme_id", directory.effective_state().alias("effective_state"),
        directory.state_badge().alias("badge"),
    )


@query
def directory_name_lookup(spark, sf):
    return directory.find_by_name(s.directory(spark, sf), "BO[L]T").select("scheme_id", "pos", "name")


@query
def directory_names_like(spark, sf):
    rows = s.directory(spark, sf)
    return rows.where(directory.name_like("name", "(gizmo|gear)$")).select("scheme_id", "name")


@query
def scheme_totals(spark, sf):
    return matching.scheme_total(s.directory(spark, sf))


@query
def scheme_name_list(spark, sf):
    return matching.scheme_names(s.directory(spark, sf))


@query
def scheme_steps(spark, sf):
    steps = F.posexplode(text.split_steps("steps")).alias("at", "step")
    return s.directory(spark, sf).select("scheme_id", steps).select(
        "scheme_id", (F.col("at") + 1).cast("bigint").alias("step_no"), "step"
    )


@query
def scheme_labels(spark, sf):
    return s.directory(spark, sf).select(
        "scheme_id",
        joined(text.display_categories("rules.allowed_categories")).alias("categories"),
        joined(text.display_gender("rules.gender")).alias("genders"),
        joined(text.display_special("rules.special_category")).alias("specials"),
        joined(text.display_states("rules.state")).alias("states"),
        text.truncate_desc("description", 40).alias("short_description"),
        text.topic_title(F.concat(F.lit("state_"), F.replace("name", F.lit(" "), F.lit("_")))).alias("topic"),
    )


@query
def point_lookup(spark, sf):
    keys = s.table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).cast("string").alias("scheme_id"))
    found = catalog.get_by_key(s.directory(spark, sf).select("scheme_id", "name"), keys, "scheme_id")
    return found.select("scheme_id", "name", "found")


# ---- text functions --------------------------------------------------------------------------


@query
def cleaned_texts(spark, sf):
    return s.spread_table(spark, sf, "documents", "doc_id").select(
        "doc_id",
        F.md5(text.clean_query("text")).alias("query_text"),
        F.md5(text.clean_question("text")).alias("question_text"),
        F.md5(text.clean_val("text")).alias("spaced"),
        F.md5(text.clean_val_no_space("text")).alias("compact"),
    )


@query
def keyword_sets(spark, sf):
    cleaned = s.spread_table(spark, sf, "documents", "doc_id").select("doc_id", text.clean_query("text").alias("t"))
    return cleaned.select(
        "doc_id",
        F.size(text.word_set("t")).cast("bigint").alias("words"),
        F.md5(joined(F.array_sort(faq.keywords_of(F.col("t"))), " ")).alias("keywords"),
    )


@query
def normalized_dates(spark, sf):
    day = F.col("o_orderdate")
    form = s.pick(
        F.col("o_orderkey"), 6,
        {
            0: F.date_format(day, "yyyy-MM-dd"), 1: F.date_format(day, "d/M/yyyy"),
            2: F.concat(F.lit("DOB: "), F.date_format(day, "dd-MM-yyyy")),
            3: F.concat(F.lit("Year "), F.date_format(day, "yyyy")), 4: F.col("o_orderstatus"),
        },
        F.date_format(day, "d/M/yy"),
    )
    return s.table(spark, sf, "orders").select("o_orderkey", docs.normalize_date(form).alias("normalized"))


@query
def name_validity(spark, sf):
    lines = s.spread_table(spark, sf, "documents", "doc_id").select(
        "doc_id", F.posexplode(docs.text_lines("text")).alias("at", "line")
    )
    return lines.select("doc_id", F.col("at").cast("bigint").alias("idx"), docs.is_valid_name("line").alias("valid"))


@query
def person_name_validity(spark, sf):
    rows = s.certificates(spark, sf).select("doc_id", "claimed_name")
    return rows.select("doc_id", docs.is_valid_name("claimed_name").alias("valid"))


@query
def masked_names(spark, sf):
    key = F.col("c_custkey")
    name = F.left("c_name", (key % 19).cast("int"))
    return s.table(spark, sf, "customer").select("c_custkey", text.mask(name).alias("masked"))


@query
def text_languages(spark, sf):
    key = F.col("doc_id")
    mark = s.pick(key, 9, {i: F.lit(chr(c)) for i, c in enumerate(SCRIPT_SAMPLES)}, F.lit(""))
    rows = s.spread_table(spark, sf, "documents", "doc_id").select("doc_id", F.concat("text", mark).alias("text"), "lang")
    asked = F.when(key % 4 == 0, F.lit("auto")).when(key % 4 == 1, F.lit("")).when(key % 4 == 2, F.col("lang"))
    return rows.select(
        "doc_id", language.detect_language("text").alias("detected"),
        language.target_language(asked, "text").alias("target"),
    )


@query
def compound_fragments(spark, sf):
    rows = localization.text_fragments(s.texts(spark, sf), ["text_id"])
    return rows.select("text_id", "lang", F.col("part").cast("bigint").alias("part"), "fragment")


@query
def fragment_counts(spark, sf):
    found = localization.distinct_fragments(s.texts(spark, sf), ["text_id"])
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("fragments"))


@query
def title_prefixes(spark, sf):
    rows = s.named_schemes(spark, sf)
    head = s.pick(F.col("pos"), 3, {0: F.lit('Title : "'), 1: F.lit("Note: ")}, F.lit('"'))
    marked = F.concat(head, F.col("name"), F.lit('"'))
    return rows.select("pos", language.strip_title_prefix(marked).alias("plain"))


# ---- C: questions --------------------------------------------------------------------------------


def _best(spark, sf, queries):
    found = faq.best_faq(queries, s.faqs(spark, sf), faq.vocabulary(s.keywords(spark, sf)))
    return found.select("query_id", "faq_pos", F.round("score", 9).alias("score"))


@query
def booster_vocabulary(spark, sf):
    return faq.vocabulary(s.keywords(spark, sf))


@query
def faq_best_match(spark, sf):
    return _best(spark, sf, s.turns(spark, sf))


@query
def faq_best_match_documents(spark, sf):
    return _best(spark, sf, s.long_queries(spark, sf))


@query
def faq_exact_questions(spark, sf):
    """FAQ texts asked back: whole, in lower case, and by their sentences."""
    whole = s.faqs(spark, sf).select(
        (-1 - F.col("pos")).alias("query_id"),
        F.concat(F.lower("question"), F.lit("!")).alias("query"),
    )
    return _best(spark, sf, whole.unionByName(s.name_queries(spark, sf).select("query_id", "query")))


@query
def scheme_exact(spark, sf):
    return matching.exact_scheme(
        s.name_queries(spark, sf), s.named_schemes(spark, sf), s.dictionary(spark, sf)
    )


@query
def scheme_contained(spark, sf):
    texts = matching.topic_texts(s.turns(spark, sf))
    return matching.contained_scheme(texts, s.named_schemes(spark, sf))


@query
def scheme_contained_documents(spark, sf):
    texts = matching.topic_texts(s.long_queries(spark, sf))
    return matching.contained_scheme(texts, s.named_schemes(spark, sf))


@query
def scheme_partial(spark, sf):
    texts = matching.topic_texts(s.turns(spark, sf))
    return matching.partial_scheme(texts, s.named_schemes(spark, sf))


@query
def scheme_first_token(spark, sf):
    texts = matching.topic_texts(s.turns(spark, sf))
    return matching.token_scheme(texts, s.named_schemes(spark, sf))


@query
def keyword_topics(spark, sf):
    texts = matching.topic_texts(s.long_queries(spark, sf))
    return matching.keyword_topic(texts, s.keywords(spark, sf), s.faqs(spark, sf))


@query
def scheme_faqs_tagged(spark, sf):
    return faq.tagged_faqs(s.tag_schemes(spark, sf), s.faqs(spark, sf))


@query
def scheme_faqs_worded(spark, sf):
    return faq.worded_faqs(s.named_schemes(spark, sf), s.faqs(spark, sf))


@query
def scheme_question_lists(spark, sf):
    tagged = s.tag_schemes(spark, sf).withColumn("name", F.concat(F.lower("name"), F.lit(" ")))
    named = s.named_schemes(spark, sf).select("scheme_id", "pos", "name")
    both = named.unionByName(tagged.select("scheme_id", "pos", F.trim("name").alias("name")))
    lists = faq.scheme_questions(both, s.faqs(spark, sf))
    return lists.select("scheme_id", F.md5(joined("questions")).alias("questions"))


@query
def topic_faq_rows(spark, sf):
    topics = s.keywords(spark, sf).select(F.col("label").alias("topic"))
    return faq.topic_faqs(s.faqs(spark, sf), topics).select("topic", "pos")


@query
def topic_question_lists(spark, sf):
    lists = faq.topic_questions(s.faqs(spark, sf), 10)
    shown = routing.with_navigation("questions", routing.TOPIC_SUGGESTIONS)
    return lists.select("category", F.md5(joined(shown)).alias("suggestions"))


@query
def faq_related(spark, sf):
    lists = faq.related_faqs(s.faqs(spark, sf))
    return lists.select("pos", F.md5(joined("related")).alias("related"))


@query
def faq_related_messy(spark, sf):
    """Related FAQs where heads are blank, repeated, or labels."""
    lists = faq.related_faqs(s.messy_faqs(spark, sf))
    return lists.select("pos", F.md5(joined("related")).alias("related"))


@query
def topic_question_lists_messy(spark, sf):
    lists = faq.topic_questions(s.messy_faqs(spark, sf), 10, without=routing.NAV)
    shown = routing.with_navigation("questions", routing.TOPIC_SUGGESTIONS)
    return lists.select("category", F.md5(joined(shown)).alias("suggestions"))


@query
def scheme_suggestions_messy(spark, sf):
    """Suggestions behind a scheme's card, from its own questions or its topic's first FAQs."""
    lists = routing.related_questions(s.named_schemes(spark, sf), s.messy_faqs(spark, sf))
    return lists.select("scheme_pos", F.md5(joined("suggestions")).alias("suggestions"))


@query
def faq_pools(spark, sf):
    """Whole pools: each FAQ at its place in its category's seeded order."""
    return faq.faq_pool_rows(s.messy_faqs(spark, sf))


@query
def faq_sample(spark, sf):
    return faq.stratified_sample(s.faqs(spark, sf)).select("pos", "category")


@query
def scheme_cards(spark, sf):
    return routing.scheme_cards(s.directory(spark, sf)).select("scheme_pos", F.md5("card").alias("card"))


def _routes(spark, sf, queries):
    return routing.route_queries(
        queries, s.named_schemes(spark, sf), s.faqs(spark, sf), s.keywords(spark, sf)
    )


@query
def query_routes(spark, sf):
    return _routes(spark, sf, s.turns(spark, sf))


@query
def stage_routes(spark, sf):
    """Questions that together reach every stage."""
    return _routes(spark, sf, s.stage_queries(spark, sf))


@query
def all_scheme_names(spark, sf):
    """The names behind "list all", in each language that asked for them."""
    key = F.col("s_suppkey")
    asked = s.table(spark, sf, "supplier").select(
        key.alias("query_id"), s.pick(key, 3, {0: F.lit("hi"), 1: F.lit("ta")}, F.lit("en")).alias("lang"),
        s.pick(key, 2, {0: F.lit("Show schemes.")}, F.lit("hello")).alias("query"),
    )
    named = s.named_schemes(spark, sf)
    routes = routing.prepare_queries(asked).select(
        "lang", F.when(F.col("cheap_stage").isNull() & F.col("asks_list"), "R7").otherwise("other").alias("stage")
    )
    names = routing.all_names(routes, named, s.dictionary(spark, sf))
    return names.select("lang", "pos", F.md5("name").alias("name"))


@query
def command_routes(spark, sf):
    """Every order asks a fixed command or names a state: the cheap stages."""
    phrases = [
        "", "Main Menu please", "Hello!", "thanks a lot", "What is your name?", "show schemes now",
        "my state", "state", "who are you", "GM.", "zzz",
    ]
    key = F.col("o_orderkey")
    command = s.pick(key, len(phrases), {i: F.lit(p) for i, p in enumerate(phrases)}, F.lit(""))
    queries = s.table(spark, sf, "orders").select(
        key.alias("query_id"), command.alias("query"), F.lit("en").alias("lang")
    )
    return _routes(spark, sf, queries).select("query_id", "lang", "stage")


@query
def query_answers(spark, sf):
    """Routes of all user turns with the response and suggestions they get."""
    schemes, faqs = s.named_schemes(spark, sf), s.faqs(spark, sf)
    messages = routing.default_messages(spark, "Assistant")
    answers = routing.answer_queries(
        _routes(spark, sf, s.turns(spark, sf)), schemes, faqs, messages
    )
    return answers.select(
        "query_id", "lang", "stage", F.md5("response").alias("response"),
        F.md5(joined("suggestions")).alias("suggestions"),
    )


# ---- D: verification --------------------------------------------------------------------------


@query
def document_types(spark, sf):
    rows = s.certificates(spark, sf).select("doc_id", "text")
    long_texts = s.table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    return rows.unionByName(long_texts).select("doc_id", docs.detect_doc_type("text").alias("doc_type"))


@query
def document_fields(spark, sf):
    rows = verification.extract_fields(s.certificates(spark, sf))
    return rows.select("doc_id", "doc_type", "name", "dob", "income", "category")


@query
def upload_scores(spark, sf):
    rows = verification.upload_documents(s.certificates(spark, sf))
    return rows.select(
        "doc_id", "doc_type", "document_key", "name", "dob", "income", "category",
        F.col("score").cast("bigint").alias("score"), "status", "stored_status", "name_result",
        joined("mismatches").alias("mismatches"), *verification.upload_summary(),
    )


@query
def profile_verification(spark, sf):
    rows = verification.score_claims(s.claims(spark, sf))
    return rows.select(
        "user_id", F.col("score").cast("bigint").alias("score"), "status", "name_result",
        "dob_result", "income_result", "category_result", joined("mismatches").alias("mismatches"),
        "summary_name", "summary_dob", "summary_income", "summary_category",
    )


@query
def stored_verification(spark, sf):
    """Claims of customers and of unknown users against stored documents."""
    identity = F.struct(
        F.when(F.col("user_id") % 5 == 0, F.col("name")).alias("name"), F.col("dob").alias("dob")
    )
    claims = s.claims(spark, sf).select(
        "user_id", "name", "dob", "income", "category", identity.alias("identity")
    )
    unknown = claims.withColumn("user_id", -1 - F.col("user_id"))
    rows = verification.verify_profile(claims.unionByName(unknown), s.users(spark, sf))
    return rows.select(
        "user_id", "user_found", F.col("score").cast("bigint").alias("score"), "status",
        "name_result", "dob_result", "income_result", "category_result",
    )


@query
def payload_identities(spark, sf):
    rows = verification.parse_payloads(s.payloads(spark, sf))
    return rows.select("doc_id", "name", "dob", "gender", "address", "is_verified", "debug_source")


@query
def payload_override(spark, sf):
    rows = s.certificates(spark, sf).join(s.payloads(spark, sf), "doc_id")
    fields = verification.override_from_payload(verification.extract_fields(rows))
    return fields.select("doc_id", "doc_type", "name", "dob")


@query
def identity_scans(spark, sf):
    rows = verification.scan_identity(s.scans(spark, sf))
    return rows.select("doc_id", "name", "dob", "gender", "debug_source", "status")


@query
def stored_audit(spark, sf):
    _, report = verification.audit_stored(s.users(spark, sf))
    return report.select("user_id", joined("invalid_types", ",").alias("invalid_types"), "status")


# ---- E: localization -----------------------------------------------------------------------------


@query
def localized_documents(spark, sf):
    rows = localization.localize(s.texts(spark, sf), ["text_id"], s.dictionary(spark, sf))
    return rows.select("text_id", "lang", F.md5("localized").alias("localized"))


@query
def localized_whole_texts(spark, sf):
    named = s.named_schemes(spark, sf).select(
        F.col("pos").alias("text_id"), F.lit("hi").alias("lang"), F.col("name").alias("text")
    )
    faqs = s.faqs(spark, sf).select(
        (-1 - F.col("pos")).alias("text_id"), F.lit("ta").alias("lang"), F.col("question").alias("text")
    )
    rows = localization.localize_one(named.unionByName(faqs), ["text_id"], s.dictionary(spark, sf))
    return rows.select("text_id", F.md5("localized").alias("localized"))


@query
def localized_catalog(spark, sf):
    schemes = s.schemes(spark, sf).withColumn("name", F.substring_index("name", " ", 1))
    rows = localization.localize_catalog(
        schemes, "hi", s.dictionary(spark, sf), s.proper_nouns(spark, sf)
    )
    return rows.select(
        "scheme_id", "name", "description", "state",
        joined("rules.allowed_categories").alias("categories"),
        joined("rules.special_category").alias("specials"),
    )


@query
def localized_directory(spark, sf):
    rows = localization.localize_catalog(
        s.directory(spark, sf), "hi", s.dictionary(spark, sf), s.proper_nouns(spark, sf)
    )
    return rows.select(
        "scheme_id", "name", "steps", joined("rules.gender").alias("genders"),
        joined("rules.state").alias("states"),
    )


@query
def english_queries(spark, sf):
    entries = s.named_schemes(spark, sf).select(
        F.lit("to_en").alias("direction"), F.lit(None).cast("string").alias("lang"),
        F.lower("name").alias("source"), F.concat(F.lit("EN "), F.col("name")).alias("target"),
        F.col("pos").alias("ord"),
    )
    queries = s.name_queries(spark, sf).withColumn(
        "lang", s.pick(F.col("query_id"), 2, {0: F.lit("en")}, F.lit("hi"))
    )
    return localization.to_english(queries, entries).select("query_id", "lang", "english")


@query
def untranslated_fragments(spark, sf):
    found = localization.distinct_fragments(s.texts(spark, sf), ["text_id"])
    return localization.untranslated(found, s.dictionary(spark, sf))


@query
def translation_worklist(spark, sf):
    missing = untranslated_fragments(spark, sf)
    return localization.worklist(missing).select(
        "lang", "batch", F.size("fragments").cast("bigint").alias("fragments"),
        F.md5("request").alias("request"),
    )


@query
def merged_translations(spark, sf):
    """Replies to the worklist: marked and with a heading; some lose a part or fail."""
    groups = localization.worklist(untranslated_fragments(spark, sf))
    number = F.col("batch")
    answered = F.transform("fragments", lambda f: F.concat(F.lit("Title : ~"), f))
    kept = F.slice(answered, 2, 10)
    reply = (
        F.when(number % 5 == 0, F.array_join(kept, "\n\n"))
        .when(number % 5 == 1, F.concat(F.lit(" "), F.col("request")))
        .when(number % 5 == 2, F.array_join(F.transform("fragments", lambda f: F.lit("Error 500")), "\n\n"))
        .otherwise(F.array_join(answered, " \n\n "))
    )
    merged = localization.merge_translations(groups.withColumn("reply", reply))
    return merged.select("lang", F.md5("source").alias("source"), F.md5("target").alias("target"))


@query
def storable_translations(spark, sf):
    rows = s.dictionary(spark, sf)
    bad = s.pick(F.col("ord"), 4, {0: F.lit(""), 1: F.concat(F.lit("Server Error: "), F.col("target"))},
                 F.col("target"))
    kept = catalog.storable(rows.withColumn("target", bad))
    return kept.select("lang", "ord", "target")


@query
def locale_messages(spark, sf):
    bundles = s.bundles(spark, sf)
    key = F.col("doc_id")
    lang = s.pick(key, 3, {0: F.lit("de"), 1: F.lit("xx")}, F.lit("fr"))
    source = F.when(key % 7 == 0, F.lit("none")).otherwise(F.col("source"))
    requests = s.table(spark, sf, "documents").select("doc_id", lang.alias("lang"), source.alias("key"))
    found = localization.bundle_lookup(requests, bundles)
    return found.select("doc_id", "lang", "key", F.md5("text").alias("text"))


# ---- U: record maintenance -------------------------------------------------------------------------


def _user_view(users: DataFrame, *more: Column | str) -> DataFrame:
    return users.select("user_id", "aadhaar_verified", *more)


@query
def newest_changes(spark, sf):
    return ranking.last_write_wins(s.change_feed(spark, sf), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value"
    )


@query
def inserted_users(spark, sf):
    base = s.users(spark, sf).select("email", "name")
    suppliers = s.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    new = suppliers.select(
        s.pick(key, 5, {
            0: F.lit(""),
            1: F.concat(F.lit("customer@"), F.lpad(key.cast("string"), 9, "0")),
            2: F.lit("same@example"),
        }, F.lower("s_name")).alias("email"),
        F.col("s_name").alias("name"), key.alias("seq"),
    )
    merged, rejects = maintenance.insert_if_absent(base, new, "email", ["seq"])
    return merged.select("email", "name", F.lit("").alias("reason")).unionByName(
        rejects.select("email", "name", "reason")
    )


@query
def updated_users(spark, sf):
    key, event = F.col("user_id"), F.col("event_type")
    changes = s.change_feed(spark, sf).select(
        (key * 3).alias("user_id"), "ts", "event_id",
        F.when(event == "signup", F.concat(F.lit("new "), F.col("event_id").cast("string"))).alias("name"),
        F.when(event == "purchase", F.lit("buyer")).when(event == "error", F.lit("admin")).alias("role"),
    )
    patches = maintenance.fold_patches(changes, "user_id", ["ts", "event_id"], ["name", "role"])
    updated, missing = maintenance.update_fields(s.users(spark, sf), patches, "user_id", ["name", "role"])
    return updated.select("user_id", "name", "role").unionByName(
        missing.select("user_id", F.lit("not found").alias("name"), F.lit(None).cast("string").alias("role"))
    )


@query
def stored_documents(spark, sf):
    """Scores of uploads written into the users' document maps."""
    rows = verification.upload_documents(s.certificates(spark, sf))
    users = s.users(spark, sf)
    extracted = F.struct(
        "name", "dob", "income", "category", F.lit("").alias("gender"), F.lit("").alias("address")
    )
    document = F.struct(
        F.col("stored_status").alias("status"), extracted.alias("extracted_data"),
        F.col("score").alias("confidence"), F.lit(None).cast("bigint").alias("verified_at"),
    ).cast(users.schema["documents"].dataType.valueType)
    changes = rows.select(
        F.col("doc_id").alias("user_id"), F.col("document_key").alias("doc_key"), document.alias("document")
    )
    updated = maintenance.update_nested(users, changes)

    def entry(key: str, field: str) -> Column:
        return F.try_element_at(F.col("documents"), F.lit(key))[field]

    return updated.select(
        "user_id", joined(F.array_sort(F.map_keys("documents")), ",").alias("types"),
        entry("aadhaar", "status").alias("aadhaar_status"),
        entry("aadhaar", "confidence").cast("bigint").alias("aadhaar_confidence"),
        entry("income", "extracted_data")["income"].alias("income"),
        entry("unknown", "status").alias("unknown_status"),
    )


PROFILE_VIEW = ["name", "age", "gender", "state", "income", "category", "dob", "address"]


def _profile_view() -> list[Column]:
    return [F.col(f"profile.{f}").alias(f"profile_{f}") for f in PROFILE_VIEW]


@query
def replaced_profiles(spark, sf):
    newest = ranking.last_write_wins(s.profile_changes_of(s.table(spark, sf, "events")), ["user_id"], ["ts"]).drop("ts")
    return _user_view(maintenance.replace_profile(s.users(spark, sf), newest), *_profile_view())


def _error_users(spark, sf):
    return s.change_feed(spark, sf).where(F.col("event_type") == "error").select(
        (F.col("user_id") * 3).alias("user_id")
    )


def _document_types() -> Column:
    return F.when(F.col("documents").isNotNull(), joined(F.array_sort(F.map_keys("documents")), ",")).alias("types")


@query
def unset_users(spark, sf):
    kept, missing = maintenance.unset_fields(s.users(spark, sf), _error_users(spark, sf))
    view = _user_view(kept, _document_types(), *_profile_view())
    return view.unionByName(missing, allowMissingColumns=True)


@query
def cleared_users(spark, sf):
    kept = maintenance.clear_fields(s.users(spark, sf), _error_users(spark, sf))
    return _user_view(kept, _document_types(), *_profile_view())


@query
def deleted_users(spark, sf):
    kept, missing = maintenance.delete_by_key(s.users(spark, sf), _error_users(spark, sf), "user_id")
    return kept.select("user_id", F.lit("kept").alias("outcome")).unionByName(
        missing.select("user_id", F.lit("not found").alias("outcome"))
    )


@query
def confirmed_users(spark, sf):
    key = F.col("user_id")
    data = F.struct(
        F.col("event_id").cast("string").alias("name"), F.lit("1999-09-09").alias("dob"),
        F.col("event_type").alias("gender"), F.lit("2 Lane").alias("address"),
    )
    confirmed = s.change_feed(spark, sf).select(
        F.when(F.col("event_id") % 10 != 0, key).alias("user_id"),
        F.when(F.col("event_type") == "signup", data).alias("data"), "ts",
    )
    done = maintenance.confirm_identity(s.users(spark, sf), confirmed)
    card = F.try_element_at(F.col("documents"), F.lit("aadhaar"))
    return _user_view(
        done, *_profile_view(), card["status"].alias("card_status"),
        card["confidence"].cast("bigint").alias("confidence"), card["verified_at"].alias("verified_at"),
        card["extracted_data"]["name"].alias("card_name"),
    )


# ---- Z: streaming ---------------------------------------------------------------------------------


def _work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one."""
    return f"{shared_dir(spark)}/entitlekit/{uuid.uuid4()}"


@query
def streamed_eligibility(spark, sf):
    """Customers as a file stream, matched and written by a file sink."""
    work = _work_dir(spark)
    customer = s.table(spark, sf, "customer")
    stream = spark.readStream.schema(customer.schema).parquet(f"{sf}/customer.parque[t]")
    forms = s.forms_of(stream, s.table(spark, sf, "nation"))
    profiles, _ = eligibility.normalize_profiles(forms)
    matched = stream_eligibility(profiles, s.schemes(spark, sf))
    run = (
        matched.writeStream.format("parquet").option("path", f"{work}/pairs")
        .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("profile_id bigint, scheme_id string").parquet(f"{work}/pairs")


@query
def streamed_upserts(spark, sf):
    """Events as a file stream of profile changes, folded into the users."""
    work = _work_dir(spark)
    events = s.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    changes = s.profile_changes_of(stream).withColumn("event_id", F.col("name").cast("bigint"))
    order = ("ts", "event_id")
    run = stream_upsert_profiles(
        changes, f"{work}/log", "upserts", order=order, checkpoint=f"{work}/state"
    )
    run.awaitTermination()
    users = current_profiles(s.users(spark, sf), read_log(spark, f"{work}/log", changes.schema), order=order)
    return _user_view(users, *_profile_view())


@query
def streamed_current(spark, sf):
    """The same changes through keyed state: the newest of each user by (ts, event_id)."""
    work = _work_dir(spark)
    events = s.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    changes = s.profile_changes_of(stream).withColumn("event_id", F.col("name").cast("bigint"))
    order = ("ts", "event_id")
    stream_current(changes, f"{work}/log", "current", order=order, checkpoint=f"{work}/state").awaitTermination()
    log = ranking.last_write_wins(read_log(spark, f"{work}/log", changes.schema), ["user_id"], [*order, "batch_id"])
    return log.select("user_id", "ts", "event_id", "age", "gender", "income")


# ---- S: sources -----------------------------------------------------------------------------------


@query
def stored_schemes(spark, sf):
    """The catalog written twice, the second time by the same run, and read back."""
    path = f"{_work_dir(spark)}/schemes"
    rows = s.directory(spark, sf)
    catalog.reload(rows.where("pos % 2 = 0"), path)
    for _ in range(2):
        catalog.reload(rows, path, run="all")
    return catalog.read_schemes(spark, path).select("scheme_id", "pos", "name", "state", F.col("rules.min_age").alias("min_age"))


@query
def stored_faqs(spark, sf):
    """FAQs added in two runs, one of them repeated, and read back."""
    path = f"{_work_dir(spark)}/faqs"
    rows = s.faqs(spark, sf).withColumn("en", F.lit(None).cast(FAQ["en"].dataType))
    for run in ("0", "1", "0"):
        catalog.append(rows.where(F.col("pos") % 2 == int(run)), path, run=run)
    return catalog.read_faqs(spark, path).select("pos", F.md5("question").alias("question"), "answer", "category", "scheme")


@query
def stored_dictionary(spark, sf):
    """The storable rows of a dictionary, some of them empty or errors, written and read back."""
    path = f"{_work_dir(spark)}/dictionary"
    rows = s.dictionary(spark, sf)
    target = s.pick(F.col("ord"), 4, {0: F.lit(""), 1: F.concat(F.lit("Error 500 "), F.col("target"))}, F.col("target"))
    catalog.write_dictionary(rows.withColumn("target", target), path)
    stored = catalog.read_table(spark, path, DICTIONARY)
    return stored.select("lang", "ord", F.md5("target").alias("target"))


def _written(rows: DataFrame, path: str) -> str:
    """Each row's ``value`` as a text file of its own."""
    rows.write.partitionBy("bucket").text(path)
    return path


@query
def faq_map_rows(spark, sf):
    """S3: files of up to 50 FAQs of a category, written as JSON objects and read back."""
    rows = s.faqs(spark, sf).withColumn("bucket", F.concat_ws("-", "category", F.floor(F.col("pos") / 50).cast("string")))
    entry = F.struct("pos", F.struct("question", "answer", "category", "scheme").alias("faq"))
    lists = rows.groupBy("bucket", "category").agg(F.sort_array(F.collect_list(entry))["faq"].alias("faqs"))
    files = lists.select("bucket", F.to_json(F.create_map("category", "faqs")).alias("value"))
    path = _written(files, f"{_work_dir(spark)}/maps")
    return catalog.read_faq_map(spark, path).select("lang", "pos", F.md5("question").alias("question"), "answer", "scheme")


@query
def dictionary_rows(spark, sf):
    """Files of up to 100 entries, written as JSON objects and read back."""
    rows = s.dictionary(spark, sf).groupBy(F.concat_ws(":", "lang", "source").alias("key")).agg(F.min("ord").alias("ord"), F.min("target").alias("target"))
    quoted = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    entry = F.struct("ord", F.concat(quoted("key"), F.lit(": "), quoted("target")).alias("entry"))
    lists = rows.withColumn("bucket", F.floor(F.col("ord") / 100)).groupBy("bucket").agg(F.sort_array(F.collect_list(entry))["entry"].alias("entries"))
    files = lists.select("bucket", F.concat(F.lit("{"), F.array_join("entries", ",\n "), F.lit("}")).alias("value"))
    path = _written(files, f"{_work_dir(spark)}/dictionaries")
    return catalog.read_dictionary(spark, path).select("direction", "lang", F.md5("source").alias("source"), F.md5("target").alias("target"))
