"""Localize texts, catalogs and answers through dictionary tables.

Texts are split into fragments, fragments are looked up, and only the fragments that were found
travel back to their texts. A dictionary within the broadcast bound is probed in place. A larger
one is met by the distinct fragments only, which are then far fewer than the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values import ERROR_MARKS, GROUP_SIZE, SHORT_WORDS
from ..functions.language import is_compound, separator, split_compound, strip_title_prefix
from ..functions.text import (
    contains_any,
    display_categories,
    display_gender,
    display_special,
    display_states,
    or_empty,
    present,
    strip,
    words,
)
from ..sizing import AUTO, BROADCAST, SHUFFLE, lookup_join, strategy_for
from .positions import with_positions
from .ranking import keep_first

ENGLISH = "en"
FROM_ENGLISH = "from_en"
TO_ENGLISH = "to_en"
TITLE_MARK = "Title: "


# ---- lookup tables ---------------------------------------------------------------


def exact_lookup(dictionary: DataFrame, proper_nouns: DataFrame | None = None) -> DataFrame:
    """J15, J14 first half: (lang, exact_key, exact_target); proper nouns come first."""
    entries = dictionary.where(F.col("direction") == FROM_ENGLISH).select(
        "lang", F.col("source").alias("exact_key"), F.lit(1).alias("tier"),
        (-F.col("ord")).alias("age"), "target",
    )
    if proper_nouns is not None:
        nouns = proper_nouns.select(
            "lang", F.col("phrase").alias("exact_key"), F.lit(0).alias("tier"),
            F.lit(0).cast("bigint").alias("age"), "target",
        )
        entries = entries.unionByName(nouns)
    return keep_first(entries, ["lang", "exact_key"], ["tier", "age", "target"]).select(
        "lang", "exact_key", F.col("target").alias("exact_target")
    )


def lower_lookup(dictionary: DataFrame) -> DataFrame:
    """J14 second half: (lang, lower_key, lower_target): the earliest entry ignoring case."""
    entries = dictionary.where(F.col("direction") == FROM_ENGLISH).select(
        "lang", F.lower("source").alias("lower_key"), "ord", "target"
    )
    return keep_first(entries, ["lang", "lower_key"], ["ord", "target"]).select(
        "lang", "lower_key", F.col("target").alias("lower_target")
    )


def translate_fragments(
    fragments: DataFrame,
    dictionary: DataFrame,
    proper_nouns: DataFrame | None = None,
    spread: list[str] | None = None,
    strategy: str = AUTO,
    salts: int | None = None,
) -> DataFrame:
    """``fragments(lang, fragment, ..)`` with their target; untranslated ones have NULL.

    Distinct fragments have no hot key and need no salt (``salts=1``).
    """
    tables = [dictionary] if proper_nouns is None else [dictionary, proper_nouns]
    strategy = strategy_for(strategy, *tables, growth=2)
    keyed = fragments.withColumn("exact_key", strip("fragment")).withColumn(
        "lower_key", F.lower("exact_key")
    )
    exact = exact_lookup(dictionary, proper_nouns)
    lower = lower_lookup(dictionary)
    found = lookup_join(keyed, exact, ["lang", "exact_key"], "left", spread, strategy, salts)
    found = lookup_join(found, lower, ["lang", "lower_key"], "left", spread, strategy, salts)
    target = F.coalesce(F.nullif("exact_target", F.lit("")), F.nullif("lower_target", F.lit("")))
    return found.select(*fragments.columns, target.alias("target"))


# ---- L1, L2, L4 -------------------------------------------------------------------


def text_fragments(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key.., lang, part, fragment) of every non-English, non-empty text."""
    wanted = rows.where((F.col("lang") != ENGLISH) & present(text))
    return wanted.select(*key, "lang", F.posexplode(split_compound(text)).alias("part", "fragment"))


def distinct_fragments(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A4: distinct (lang, fragment)."""
    return text_fragments(rows, key, text).select("lang", "fragment").distinct()


def localize(
    rows: DataFrame,
    key: list[str],
    dictionary: DataFrame,
    proper_nouns: DataFrame | None = None,
    text: str = "text",
    out: str = "localized",
    strategy: str = AUTO,
) -> DataFrame:
    """L1: ``rows(key.., lang, text, ..)`` with the localized text; ``key`` must be unique."""
    fragments = text_fragments(rows, key, text)
    unique_key = [k for k in key if k != "lang"]
    fragments = fragments.select(*unique_key, "lang", "part", "fragment")
    tables = [dictionary] if proper_nouns is None else [dictionary, proper_nouns]
    if strategy_for(strategy, *tables, growth=2) == BROADCAST:
        placed = translate_fragments(
            fragments, dictionary, proper_nouns, unique_key, BROADCAST
        )
    else:
        targets = translate_fragments(
            fragments.select("lang", "fragment").distinct(), dictionary, proper_nouns,
            ["lang", "fragment"], SHUFFLE, salts=1,
        ).where(F.col("target").isNotNull())
        placed = lookup_join(
            fragments, targets, ["lang", "fragment"], "inner", unique_key, strategy
        )
    placed = placed.where(F.col("target").isNotNull())
    by_text = placed.groupBy(*unique_key).agg(
        F.map_from_entries(F.collect_list(F.struct("part", "target"))).alias("__targets")
    )
    joined = rows.join(by_text, unique_key, "left")
    parts = F.transform(
        split_compound(text),
        lambda p, i: F.coalesce(F.try_element_at(F.col("__targets"), i), p),
    )
    rebuilt = _join_parts(parts, text)
    untouched = (F.col("lang") == ENGLISH) | ~present(text)
    return joined.withColumn(out, F.when(untouched, F.col(text)).otherwise(rebuilt)).drop(
        "__targets"
    )


def _join_parts(parts: Column, text: str) -> Column:
    return F.when(separator(text) == "\n", F.array_join(parts, "\n")).otherwise(
        F.array_join(parts, ". ")
    )


def localize_one(
    rows: DataFrame,
    key: list[str],
    dictionary: DataFrame,
    proper_nouns: DataFrame | None = None,
    text: str = "text",
    out: str = "localized",
    strategy: str = AUTO,
) -> DataFrame:
    """L2: the whole text as a key first, then its parts; an unsplit text has no second chance."""
    whole = exact_lookup(dictionary).select(
        "lang", F.col("exact_key").alias(text), F.col("exact_target").alias("__whole")
    )
    strategy = strategy_for(strategy, dictionary, growth=2)
    keyed = lookup_join(rows, whole, ["lang", text], "left", key, strategy)
    by_parts = localize(keyed, key, dictionary, proper_nouns, text, "__parts", strategy)
    untouched = (F.col("lang") == ENGLISH) | ~present(text)
    result = (
        F.when(untouched, F.col(text))
        .when(F.col("__whole").isNotNull(), F.col("__whole"))
        .when(is_compound(text), F.col("__parts"))
        .otherwise(F.col(text))
    )
    return by_parts.withColumn(out, result).drop("__whole", "__parts")


def to_english(queries: DataFrame, dictionary: DataFrame, strategy: str = AUTO) -> DataFrame:
    """L4: ``english`` from the dictionary's reverse entries, else the query itself."""
    entries = dictionary.where(F.col("direction") == TO_ENGLISH).select(
        F.col("source").alias("query"), "ord", "target"
    )
    table = keep_first(entries, ["query"], [F.col("ord").desc(), "target"]).select(
        "query", F.nullif("target", F.lit("")).alias("__english")
    )
    strategy = strategy_for(strategy, dictionary)
    found = lookup_join(queries, table, ["query"], "left", ["query_id"], strategy)
    english = F.when(F.col("lang") == ENGLISH, F.col("query")).otherwise(
        F.coalesce("__english", "query")
    )
    return found.withColumn("english", english).drop("__english")


def bundle_lookup(requests: DataFrame, bundles: DataFrame, fallback: str = ENGLISH) -> DataFrame:
    """``requests(lang, key, ..)`` with the text in their language, else the fallback's."""
    own = bundles.select("lang", "key", F.col("text").alias("__own"))
    default = bundles.where(F.col("lang") == fallback).select(
        "key", F.col("text").alias("__default")
    )
    strategy = strategy_for(AUTO, bundles)
    found = lookup_join(requests, own, ["lang", "key"], "left", strategy=strategy)
    found = lookup_join(found, default, ["key"], "left", strategy=strategy)
    return found.withColumn("text", F.coalesce("__own", "__default")).drop("__own", "__default")


# ---- L3 ------------------------------------------------------------------------------

CATALOG_TEXTS = [
    "name", "description", "target_beneficiaries", "application_process", "benefits", "steps",
    "state",
]
CATALOG_LISTS = {
    "allowed_categories": display_categories,
    "gender": display_gender,
    "special_category": display_special,
    "state": display_states,
}


def _entry(field: str):
    def build(text: Column, at: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), at.alias("at"), text.alias("text"))

    return build


def catalog_texts(schemes: DataFrame) -> DataFrame:
    """Unpivot: (scheme_id, field, at, text) of all texts and rule labels of a catalog."""
    texts = [
        F.struct(F.lit(f).alias("field"), F.lit(0).alias("at"), F.col(f).alias("text"))
        for f in CATALOG_TEXTS
    ]
    entries = F.array(*texts)
    for name, label in CATALOG_LISTS.items():
        listed = F.transform(label(F.col(f"rules.{name}")), _entry(f"rules.{name}"))
        none = F.array().cast("array<struct<field:string,at:int,text:string>>")
        entries = F.concat(entries, F.coalesce(listed, none))
    rows = schemes.select("scheme_id", F.explode(entries).alias("e")).select("scheme_id", "e.*")
    return rows.where(present("text"))


def localize_catalog(
    schemes: DataFrame,
    lang: str,
    dictionary: DataFrame,
    proper_nouns: DataFrame | None = None,
    strategy: str = AUTO,
) -> DataFrame:
    """L3: the catalog with seven texts and four rule lists localized, in one pass over all."""
    if not lang or lang == ENGLISH:
        return schemes
    rows = catalog_texts(schemes).withColumn("lang", F.lit(lang))
    done = localize(
        rows, ["scheme_id", "field", "at"], dictionary, proper_nouns, strategy=strategy
    )
    folded = done.groupBy("scheme_id").agg(
        *[
            F.max(F.when(F.col("field") == f, F.col("localized"))).alias(f"__{f}")
            for f in CATALOG_TEXTS
        ],
        *[
            F.sort_array(
                F.collect_list(
                    F.when(F.col("field") == f"rules.{f}", F.struct("at", "localized"))
                )
            ).alias(f"__rules_{f}")
            for f in CATALOG_LISTS
        ],
    )
    joined = schemes.join(folded, "scheme_id", "left")
    rules = F.col("rules")
    for f in CATALOG_LISTS:
        labels = F.transform(F.col(f"__rules_{f}"), lambda s: s["localized"])
        rules = rules.withField(f, F.when(F.col(f"rules.{f}").isNotNull(), labels))
    out = {f: F.coalesce(f"__{f}", F.col(f)) for f in CATALOG_TEXTS}
    out["rules"] = F.when(F.col("rules").isNotNull(), rules)
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in schemes.columns])


# ---- J17, L5, L6, S9 ---------------------------------------------------------------


def untranslated(fragments: DataFrame, dictionary: DataFrame,
                 proper_nouns: DataFrame | None = None, strategy: str = AUTO) -> DataFrame:
    """The trimmed ones of distinct ``fragments(lang, fragment)`` that have no target."""
    missing = translate_fragments(
        fragments, dictionary, proper_nouns, ["lang", "fragment"], strategy, salts=1
    ).where(F.col("target").isNull())
    return missing.select("lang", strip("fragment").alias("fragment")).where(
        F.col("fragment") != ""
    ).distinct()


def worklist(missing: DataFrame, size: int = GROUP_SIZE) -> DataFrame:
    """Untranslated fragments in groups of ``size``; only the last group of a language holds fewer.

    Fragments are numbered by ranges of their order, so no task orders a whole language. Short
    fragments are marked as titles.
    """
    numbered = with_positions(missing, ["fragment"], ["lang"], "at")
    wrapped = F.when(
        F.size(words("fragment")) <= SHORT_WORDS, F.concat(F.lit(TITLE_MARK), F.col("fragment"))
    ).otherwise(F.col("fragment"))
    grouped = numbered.withColumn("batch", F.floor(F.col("at") / size)).groupBy("lang", "batch").agg(
        F.sort_array(F.collect_list(F.struct("at", "fragment", wrapped.alias("request")))).alias("g")
    )
    return grouped.select(
        "lang", "batch",
        F.transform("g", lambda s: s["fragment"]).alias("fragments"),
        F.array_join(F.transform("g", lambda s: s["request"]), " \n\n ").alias("request"),
    )


def keepable(target: Column | str) -> Column:
    """A target worth storing: not empty and no error text."""
    return present(target) & ~contains_any(or_empty(target), ERROR_MARKS)


def merge_translations(replies: DataFrame) -> DataFrame:
    """``replies(lang, fragments, request, reply)`` to (lang, source, target) rows.

    A reply counts only if it differs from its request and has one part per fragment.
    """
    parts = F.filter(
        F.transform(F.split(or_empty("reply"), "\n\n"), strip), lambda p: F.length(p) > 0
    )
    cleaned = F.transform(parts, strip_title_prefix)
    answered = replies.withColumn("parts", cleaned).where(
        present("reply")
        & (strip("reply") != strip("request"))
        & (F.size("parts") == F.size("fragments"))
    )
    pairs = answered.select("lang", F.explode(F.arrays_zip("fragments", "parts")).alias("p"))
    return pairs.select(
        "lang", F.col("p.fragments").alias("source"), F.col("p.parts").alias("target")
    ).where(keepable("target"))
