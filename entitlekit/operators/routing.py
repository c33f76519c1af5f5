"""Route free-text questions to one of thirteen ordered stages, and answer them.

The cheap stages are tested inside the row. All other stages probe one index of the catalogs
(``probes``) in the same scan; one aggregation by query folds what was found and picks the first
stage that holds. Query texts are never shuffled by a broadcast-size catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    CARD_HEADINGS,
    DEFAULT_STEPS,
    GREETING_PHRASES,
    GREETING_PREFIXES,
    GREETINGS,
    LIST_ALL_PHRASES,
    LIST_LABEL,
    MENU_LABEL,
    REQUIRED_DOCUMENTS,
    SMALL_TALK,
    STATE_OPTIONS,
    STATE_PHRASES,
    THANKS,
)
from ..functions.language import target_language
from ..functions.text import (
    clean_command,
    clean_topic_text,
    contains_any,
    or_empty,
    present,
    strip,
    text_list,
    title_case,
    topic_title,
    upper_letters,
)
from ..sizing import AUTO, lookup_join, strategy_for
from .faq import (
    english_faqs,
    related_faqs,
    scheme_questions,
    seeded,
    stratified_sample,
    topic_heads,
    topic_questions,
)
from .localization import localize, to_english
from .matching import scheme_total
from .probes import catalog_index, fold, probe

STAGES = {
    "R1": "empty", "R2": "menu", "R3": "greeting", "R4": "thanks", "R5": "small_talk",
    "R6": "exact_scheme", "R7": "list_all", "R8": "state_menu", "R9": "topic_scheme",
    "R10": "topic", "R11": "faq", "R12": "scheme_search", "R13": "fallback",
}
NAV = [MENU_LABEL, LIST_LABEL]
TOPIC_SUGGESTIONS = 12
SCHEME_SUGGESTIONS = 10
FAQ_SUGGESTIONS = 10
GENERAL_SUGGESTIONS = 7


# ---- routing -----------------------------------------------------------------


def navigation_labels(dictionary: DataFrame) -> DataFrame:
    """(lang, menu_label, list_label): one row per language that localizes either label."""
    rows = dictionary.where(
        (F.col("direction") == "from_en") & F.col("source").isin(MENU_LABEL, LIST_LABEL)
    )

    def label(source: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.lower("target")))

    return rows.groupBy("lang").agg(
        label(MENU_LABEL).alias("menu_label"), label(LIST_LABEL).alias("list_label")
    )


def cheap_stage(assistant: str | None = None) -> Column:
    """R1-R5 from the query text and the localized menu label alone."""
    query = F.col("query")
    command = clean_command(query)
    greetings = GREETINGS + ([f"{p} {assistant.lower()}" for p in GREETING_PREFIXES] if assistant else [])
    return (
        F.when(query == "", F.lit("R1"))
        .when((strip(F.lower(query)) == F.col("menu_label")) | command.contains("menu"), F.lit("R2"))
        .when(command.isin(greetings) | contains_any(command, GREETING_PHRASES), F.lit("R3"))
        .when(contains_any(command, THANKS), F.lit("R4"))
        .when(contains_any(command, SMALL_TALK), F.lit("R5"))
    )


def prepare_queries(
    queries: DataFrame, dictionary: DataFrame | None = None, assistant: str | None = None
) -> DataFrame:
    """Language, English text and in-row stage tests of every query."""
    lang = F.col("lang") if "lang" in queries.columns else F.lit(None).cast("string")
    query = strip(or_empty("query"))
    base = queries.select("query_id", query.alias("query"), lang.alias("asked_lang"))
    base = base.withColumn("lang", target_language("asked_lang", "query")).drop("asked_lang")
    defaults = {"menu_label": MENU_LABEL.lower(), "list_label": LIST_LABEL.lower()}
    if dictionary is None:
        for name, text in defaults.items():
            base = base.withColumn(name, F.lit(text))
        base = base.withColumn("english", F.col("query"))
    else:
        labels = navigation_labels(dictionary)
        base = lookup_join(
            base, labels, ["lang"], "left", ["query_id"], strategy_for(AUTO, dictionary)
        )
        for name, text in defaults.items():
            base = base.withColumn(name, F.coalesce(name, F.lit(text)))
        base = to_english(base, dictionary)
    topic_text = clean_topic_text(F.col("english"))
    asks_list = (
        contains_any(topic_text, LIST_ALL_PHRASES)
        | topic_text.contains(F.col("list_label"))
        | (strip(F.lower("query")) == F.col("list_label"))
    )
    return base.select(
        "query_id", "query", "lang", "english",
        cheap_stage(assistant).alias("cheap_stage"),
        asks_list.alias("asks_list"),
        ((topic_text == "state") | contains_any(topic_text, STATE_PHRASES)).alias("asks_state"),
        topic_text.alias("topic_text"),
    )


def route_queries(
    queries: DataFrame,
    schemes: DataFrame,
    faqs: DataFrame,
    keywords: DataFrame,
    dictionary: DataFrame | None = None,
    assistant: str | None = None,
    strategy: str = AUTO,
) -> DataFrame:
    """(query_id, lang, stage, scheme_pos, topic, faq_pos), one row per query.

    The queries are read once: their keys meet one index of all catalogs, and one aggregation by
    query folds what was found.
    """
    rows = prepare_queries(queries, dictionary, assistant)
    index, texts = catalog_index(schemes, faqs, keywords, dictionary, strategy)
    hits = probe(rows, index, texts, strategy_for(strategy, index, texts))
    folded = fold(hits, "query_id", "lang", "cheap_stage", "asks_list", "asks_state")
    folded = folded.select(
        "*", F.col("listed.ref").alias("keyword_pos"), (-F.col("faq.back")).alias("faq_pos"),
        F.coalesce("topic.has_faqs", F.lit(False)).alias("topic_has_faqs"),
    ).withColumn("topic", F.col("topic.label"))
    by_topic = F.coalesce("name_pos", "keyword_pos")
    by_search = F.coalesce("name_pos", "partial_pos", "token_pos")
    stage = (
        F.when(F.col("cheap_stage").isNotNull(), F.col("cheap_stage"))
        .when(F.col("exact_pos").isNotNull(), "R6")
        .when(F.col("asks_list"), "R7")
        .when(F.col("asks_state"), "R8")
        .when(F.col("topic").isNotNull() & by_topic.isNotNull(), "R9")
        .when(F.col("topic").isNotNull() & F.col("topic_has_faqs"), "R10")
        .when(F.col("faq_pos").isNotNull(), "R11")
        .when(by_search.isNotNull(), "R12")
        .otherwise("R13")
    )
    scheme_pos = (
        F.when(F.col("stage") == "R6", F.col("exact_pos"))
        .when(F.col("stage") == "R9", by_topic)
        .when(F.col("stage") == "R12", by_search)
    )
    return folded.withColumn("stage", stage).select(
        "query_id", "lang", "stage",
        scheme_pos.alias("scheme_pos"),
        F.when(F.col("stage") == "R10", F.col("topic")).alias("topic"),
        F.when(F.col("stage") == "R11", F.col("faq_pos")).alias("faq_pos"),
    )


# ---- answers -------------------------------------------------------------------


def card_parts(schemes: DataFrame) -> DataFrame:
    """(scheme_pos, parts): the ordered parts of a scheme's card; absent parts are skipped."""
    rules = F.col("rules")

    def listed(items: Column, label) -> Column:
        open_to_all = F.coalesce(F.array_contains(items, "all"), F.lit(False))
        some = items.isNotNull() & (F.size(items) > 0) & ~open_to_all
        return F.when(some, F.array_join(F.transform(items, label), ", "))

    age = F.when(
        rules["min_age"].isNotNull(),
        F.concat(
            F.lit("• Age: "), rules["min_age"].cast("string"), F.lit("-"),
            F.coalesce(rules["max_age"].cast("string"), F.lit("Unlimited")), F.lit(" years"),
        ),
    )
    income = F.when(
        rules["max_income"] != 0,
        F.concat(F.lit("• Max Annual Income: Up to ₹"), rules["max_income"].cast("string")),
    )
    categories = F.concat(F.lit("• Categories: "), listed(rules["allowed_categories"], F.upper))
    gender = F.concat(F.lit("• Gender: "), listed(rules["gender"], title_case))
    criteria = F.array_compact(F.array(age, income, categories, gender))
    none = F.array().cast("array<string>")
    criteria_head, documents_head, apply_head, benefits_head, site_head = map(F.lit, CARD_HEADINGS)

    def section(heading: Column, name: str) -> Column:
        return F.when(present(name), F.array(heading, F.col(name))).otherwise(none)

    parts = F.concat(
        F.array(upper_letters(or_empty("name")), or_empty("description")),
        F.when(F.size(criteria) > 0, F.concat(F.array(criteria_head), criteria)).otherwise(none),
        F.array(documents_head, *[F.lit(f"• {d}") for d in REQUIRED_DOCUMENTS]),
        F.array(apply_head, F.coalesce("application_process", F.lit(DEFAULT_STEPS))),
        section(benefits_head, "benefits"),
        section(site_head, "official_website"),
    )
    return schemes.select(F.col("pos").alias("scheme_pos"), parts.alias("parts"))


def format_card(parts: Column, shown: Column) -> Column:
    """Lay out card parts: ``parts`` decide the layout, ``shown`` (same order) is printed."""
    laid_out = F.zip_with(
        parts,
        shown,
        lambda p, s: F.when(p.isin(CARD_HEADINGS), F.concat(F.lit("\n\n"), s, F.lit(":\n")))
        .when(p.startswith("• "), F.concat(s, F.lit("\n")))
        .otherwise(F.concat(s, F.lit(" "))),
    )
    return F.array_join(laid_out, "")


def scheme_cards(schemes: DataFrame) -> DataFrame:
    """R15 in English: (scheme_pos, card)."""
    return card_parts(schemes).select(
        "scheme_pos", format_card(F.col("parts"), F.col("parts")).alias("card")
    )


def with_navigation(questions: Column | str, size: int, distinct: bool = True) -> Column:
    """The two menu labels, then the questions that aren't labels (each once), cut to ``size``."""
    questions = F.col(questions) if isinstance(questions, str) else questions
    none = F.array().cast("array<string>")
    others = F.filter(F.coalesce(questions, none), lambda q: ~q.isin(NAV))
    return F.slice(F.concat(text_list(NAV), F.array_distinct(others) if distinct else others), 1, size)


def related_questions(schemes: DataFrame, faqs: DataFrame) -> DataFrame:
    """(scheme_pos, suggestions): own questions, else those of the first 5 FAQs of its topic."""
    own = scheme_questions(schemes, faqs, without=NAV)
    by_topic = topic_heads(faqs, 5).select(
        F.col("category").alias("topic"), F.col("questions").alias("topic_questions")
    )
    rows = schemes.select(
        "scheme_id", F.col("pos").alias("scheme_pos"),
        F.lower(or_empty("target_beneficiaries")).alias("topic"),
    )
    rows = rows.join(own, "scheme_id", "left")
    strategy = strategy_for(AUTO, faqs)
    rows = lookup_join(rows, by_topic, ["topic"], "left", ["scheme_pos"], strategy)
    questions = F.coalesce("questions", "topic_questions")
    return rows.select(
        "scheme_pos", with_navigation(questions, SCHEME_SUGGESTIONS, distinct=False).alias("suggestions")
    )


def all_names(
    routes: DataFrame, schemes: DataFrame, dictionary: DataFrame | None = None,
    proper_nouns: DataFrame | None = None,
) -> DataFrame:
    """(lang, pos, name): every scheme's name in each language that asked to list all, in catalog order.

    Answers to "list all" carry the count; these are the suggestions behind the menu label.
    """
    langs = routes.where(F.col("stage") == "R7").agg(F.collect_set("lang").alias("langs"))
    rows = schemes.select("pos", or_empty("name").alias("text")).withColumn("langs", langs.scalar())
    rows = rows.select("pos", F.explode("langs").alias("lang"), "text")
    if dictionary is None:
        return rows.withColumnRenamed("text", "name")
    done = localize(rows.withColumn("lang_key", F.col("lang")), ["lang_key", "pos"], dictionary, proper_nouns)
    return done.select(F.col("lang_key").alias("lang"), "pos", F.col("localized").alias("name"))


def general_suggestions(faqs: DataFrame, fixed: list[str], seed: int = 0) -> DataFrame:
    """One row; a stratified sample behind the two labels, or ``fixed`` if at most 3 FAQs.

    The sample holds five rows, so the one-row list is bounded.
    """
    sample = stratified_sample(faqs, seed).withColumn("draw", seeded("pos", seed))
    listed = sample.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("draw", "question"))), lambda s: s["question"]
        ).alias("questions")
    )
    static = text_list(list(dict.fromkeys([*reversed(NAV), *fixed]))[:GENERAL_SUGGESTIONS])
    sampled = with_navigation("questions", GENERAL_SUGGESTIONS)
    return listed.select(
        F.when(F.size("questions") <= 3, static).otherwise(sampled).alias("suggestions")
    )


def default_messages(spark, assistant: str) -> DataFrame:
    """English texts for the fixed answers, as a ``messages(lang, key, text)`` table; ours, to be replaced by your own."""
    texts = {
        "greeting": f"Welcome, this is {assistant}. What would you like to know?",
        "thanks": "Glad that helped. Ask on if there is more.",
        "small_talk": f"All well here. {assistant} answers questions about schemes.",
        "list_all": "{count} schemes are on file. Choose a name to read more.",
        "state_prompt": "For which state? Choose one or type its name.",
        "topic_intro": "Schemes on {topic}:",
        "state_intro": "Schemes in {topic}:",
        "fallback": "That question wasn't clear to us.",
    }
    return spark.createDataFrame(
        [("en", key, text) for key, text in texts.items()], "lang string, key string, text string"
    )


def route_target(stage: Column | str) -> Column:
    """(kind, ref) of the catalog row that answers a route."""
    stage = F.col(stage) if isinstance(stage, str) else stage
    message = (
        F.when(stage.isin("R1", "R2", "R3"), "greeting")
        .when(stage == "R4", "thanks")
        .when(stage == "R5", "small_talk")
        .when(stage == "R7", "list_all")
        .when(stage == "R8", "state_prompt")
        .when(stage == "R13", "fallback")
    )
    kind = (
        F.when(stage.isin("R6", "R9", "R12"), "scheme")
        .when(stage == "R10", "topic")
        .when(stage == "R11", "faq")
        .otherwise("message")
    )
    ref = F.coalesce(
        message, F.col("scheme_pos").cast("string"), F.col("topic"), F.col("faq_pos").cast("string")
    )
    return F.struct(kind.alias("kind"), ref.alias("ref"))


def answer_catalog(
    schemes: DataFrame,
    faqs: DataFrame,
    messages: DataFrame,
    fixed: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """English answers, one row per thing a route can point at: kind, ref, parts, suggestions.

    The answer to "list all" carries the catalog size; the names themselves are a table
    (``scheme_names``), not one unbounded list.
    """
    english = messages.where(F.col("lang") == "en")
    menu = F.array(F.lit(MENU_LABEL))
    states = text_list([MENU_LABEL, *STATE_OPTIONS])
    # One row each, given the keys of the messages they belong to.
    general = general_suggestions(faqs, fixed or [], seed).select(
        F.explode(text_list(["greeting", "thanks", "small_talk", "fallback"])).alias("key"),
        F.col("suggestions").alias("general"),
    )
    total = scheme_total(schemes).select(
        F.explode(text_list(["list_all"])).alias("key"),
        F.col("scheme_total").cast("string").alias("count"),
    )
    intros = F.col("key").isin("topic_intro", "state_intro")
    said = english.where(~intros)
    said = said.join(F.broadcast(general), "key", "left")
    said = said.join(F.broadcast(total), "key", "left")
    shown = F.replace(F.col("text"), F.lit("{count}"), F.coalesce("count", F.lit("")))
    answers = said.select(
        F.lit("message").alias("kind"),
        F.col("key").alias("ref"),
        F.array(shown).alias("parts"),
        F.when(F.col("key") == "state_prompt", states)
        .when(F.col("key") == "list_all", menu)
        .otherwise(F.col("general"))
        .alias("suggestions"),
    )
    intro = english.where(intros).select("key", F.col("text").alias("intro"))
    topics = topic_questions(faqs, TOPIC_SUGGESTIONS - len(NAV), without=NAV).withColumn(
        "key", F.when(F.col("category").contains("state_"), "state_intro").otherwise("topic_intro")
    )
    topics = lookup_join(topics, intro, ["key"], "inner", ["category"], strategy_for(AUTO, messages))
    topic_answers = topics.select(
        F.lit("topic").alias("kind"),
        F.col("category").alias("ref"),
        F.array(F.replace(F.col("intro"), F.lit("{topic}"), topic_title("category"))).alias("parts"),
        with_navigation("questions", TOPIC_SUGGESTIONS).alias("suggestions"),
    )
    faq_answers = (
        english_faqs(faqs)
        .select("pos", "answer")
        .join(related_faqs(faqs), "pos", "left")
        .select(
            F.lit("faq").alias("kind"),
            F.col("pos").cast("string").alias("ref"),
            F.array(or_empty("answer")).alias("parts"),
            with_navigation("related", FAQ_SUGGESTIONS).alias("suggestions"),
        )
    )
    scheme_answers = (
        card_parts(schemes)
        .join(related_questions(schemes, faqs), "scheme_pos")
        .select(
            F.lit("scheme").alias("kind"),
            F.col("scheme_pos").cast("string").alias("ref"),
            "parts",
            "suggestions",
        )
    )
    return answers.unionByName(topic_answers).unionByName(faq_answers).unionByName(scheme_answers)


def localize_answers(
    wanted: DataFrame,
    catalog: DataFrame,
    messages: DataFrame,
    dictionary: DataFrame | None = None,
    proper_nouns: DataFrame | None = None,
    strategy: str = AUTO,
) -> DataFrame:
    """(kind, ref, lang, response, suggestions) for the distinct answers a batch needs."""
    rows = lookup_join(wanted, catalog, ["kind", "ref"], strategy=strategy)
    own = messages.where(F.col("lang") != "en").select(
        F.lit("message").alias("kind"), F.col("key").alias("ref"), "lang", F.col("text").alias("own")
    )
    rows = lookup_join(
        rows, own, ["kind", "ref", "lang"], "left", strategy=strategy_for(AUTO, messages)
    )
    if dictionary is None:
        shown = rows.select(
            "kind", "ref", "lang", "own", "parts", F.col("parts").alias("shown"), "suggestions"
        )
    else:
        pieces = rows.select(
            "kind", "ref", "lang",
            F.explode(
                F.concat(
                    F.transform(
                        "parts",
                        lambda t, i: F.struct(F.lit("p").alias("side"), i.alias("i"), t.alias("text")),
                    ),
                    F.transform(
                        "suggestions",
                        lambda t, i: F.struct(F.lit("s").alias("side"), i.alias("i"), t.alias("text")),
                    ),
                )
            ).alias("e"),
        ).select("kind", "ref", "lang", "e.*")
        key = ["kind", "ref", "lang_key", "side", "i"]
        done = localize(pieces.withColumn("lang_key", F.col("lang")), key, dictionary, proper_nouns)

        def side(name: str) -> Column:
            listed = F.sort_array(
                F.collect_list(F.when(F.col("side") == name, F.struct("i", "localized")))
            )
            return F.transform(listed, lambda s: s["localized"])

        folded = done.groupBy("kind", "ref", "lang").agg(
            side("p").alias("shown"), side("s").alias("localized")
        )
        shown = rows.join(folded, ["kind", "ref", "lang"]).select(
            "kind", "ref", "lang", "own", "parts", "shown",
            F.array_distinct("localized").alias("suggestions"),
        )
    plain = F.coalesce("own", F.get("shown", F.lit(0)))
    response = F.when(
        F.col("kind") == "scheme", format_card(F.col("parts"), F.col("shown"))
    ).otherwise(plain)
    return shown.select("kind", "ref", "lang", response.alias("response"), "suggestions")


def answer_queries(
    routes: DataFrame,
    schemes: DataFrame,
    faqs: DataFrame,
    messages: DataFrame,
    dictionary: DataFrame | None = None,
    proper_nouns: DataFrame | None = None,
    fixed: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """(query_id, lang, stage, response, suggestions): each distinct answer is built once."""
    aimed = routes.withColumn("target", route_target("stage")).select(
        "query_id", "lang", "stage", "target.kind", "target.ref"
    )
    wanted = aimed.select("kind", "ref", "lang").distinct()
    catalog = answer_catalog(schemes, faqs, messages, fixed, seed)
    # An answer holds its own texts, up to ten questions and the labels, once per language.
    strategy = strategy_for(AUTO, schemes, faqs, messages, growth=32)
    answers = localize_answers(wanted, catalog, messages, dictionary, proper_nouns, strategy)
    return lookup_join(
        aimed, answers, ["kind", "ref", "lang"], "left", ["query_id"], strategy
    ).select(
        "query_id", "lang", "stage", "response", "suggestions"
    )
