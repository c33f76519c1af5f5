"""Find the scheme or topic a query names. Each operator gives the earliest catalog row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SPECIFIC_KEYWORDS
from ..functions.text import clean_topic_text, first_of, or_empty, strip, words
from ..sizing import AUTO, lookup_join, strategy_for
from .containment import ROW_GROWTH, STEM, phrases_inside, texts_holding
from .faq import name_words
from .filters import count_in, count_sketch
from .ranking import first_match

ANY_LANGUAGE = "*"


def scheme_names(schemes: DataFrame) -> DataFrame:
    """Names in catalog order, as rows."""
    return schemes.select("pos", "name")


def scheme_total(schemes: DataFrame) -> DataFrame:
    """Catalog size."""
    return schemes.agg(F.count(F.lit(1)).alias("scheme_total"))


def distinct_names(schemes: DataFrame) -> DataFrame:
    """(name_text, pos): lower-cased names, earliest row each."""
    named = schemes.select(F.lower(or_empty("name")).alias("name_text"), "pos")
    return named.groupBy("name_text").agg(F.min("pos").alias("pos"))


def topic_texts(queries: DataFrame) -> DataFrame:
    """(query_id, topic_text) from an English query column."""
    return queries.select("query_id", clean_topic_text(or_empty("query")).alias("topic_text"))


def exact_scheme(
    queries: DataFrame, schemes: DataFrame, dictionary: DataFrame | None = None
) -> DataFrame:
    """The query is a scheme's name, in English or as localized for the query's language."""
    asked = F.replace(strip(F.lower(or_empty("query"))), F.lit("?"), F.lit(""))
    probes = queries.select(
        "query_id",
        asked.alias("name_key"),
        F.explode(F.array(F.lit(ANY_LANGUAGE), F.col("lang"))).alias("key_lang"),
    )
    strategy = strategy_for(AUTO, schemes, growth=2)
    index = name_keys(schemes, dictionary, strategy)
    pairs = lookup_join(
        probes, index, ["key_lang", "name_key"], spread=["query_id"], strategy=strategy
    )
    return first_match(pairs, "query_id", "pos")


def name_keys(schemes: DataFrame, dictionary: DataFrame | None, strategy: str) -> DataFrame:
    """(key_lang, name_key, pos): names as they are asked for, in English (any language) and as localized."""
    plain = F.lower(or_empty("name"))
    keys = schemes.select(
        "pos",
        F.lit(ANY_LANGUAGE).alias("key_lang"),
        F.explode(F.array_distinct(F.array(plain, strip(plain)))).alias("name_key"),
    )
    if dictionary is not None:
        local = dictionary.where(F.col("direction") == "from_en").select(
            F.col("source").alias("name"),
            F.col("lang").alias("key_lang"),
            strip(F.lower("target")).alias("name_key"),
        )
        keys = keys.unionByName(
            lookup_join(
                local, schemes.select("name", "pos"), ["name"], strategy=strategy
            ).select(*keys.columns)
        )
    return keys.groupBy("key_lang", "name_key").agg(F.min("pos").alias("pos"))


def rare_name_words(schemes: DataFrame) -> DataFrame:
    """(phrase, pos, name_words): each name's long words but its most widely used one.

    Two hits among a name's words means a hit outside its most widely used word, so that word
    need not be indexed. Usage is taken from a sketch of all names' words; names are not moved.
    """
    listed = schemes.select("pos", name_words("name").alias("name_words")).where(
        F.size("name_words") >= 2
    )
    uses = count_sketch(listed.select(F.explode("name_words").alias("word")).select(F.xxhash64("word").alias("key")), "key")
    ranked = F.array_sort(F.transform("name_words", lambda w, i: F.struct(
        count_in(F.col("uses"), F.xxhash64(w)).alias("uses"), w.alias("word"), i.alias("at")
    )))
    rare = F.array_distinct(F.slice(F.col("ranked"), F.lit(1), F.size("ranked") - 1)["word"])
    return listed.withColumn("uses", uses.scalar()).select("pos", "name_words", ranked.alias("ranked")).select(
        F.explode(rare).alias("phrase"), "pos", "name_words"
    )


def search_schemes(
    texts: DataFrame, schemes: DataFrame, strategy: str = AUTO, names: bool = True, partial: bool = True
) -> DataFrame:
    """J5 and J6 in one scan of the texts: (query_id, name_pos, partial_pos)."""
    strategy = strategy_for(strategy, schemes, growth=ROW_GROWTH)
    owners = []
    if names:
        owners.append(
            distinct_names(schemes).select(
                F.col("name_text").alias("phrase"), "pos",
                F.lit(None).cast("array<string>").alias("name_words"),
            )
        )
    if partial:
        owners.append(rare_name_words(schemes))
    index = owners[0] if len(owners) == 1 else owners[0].unionByName(owners[1])
    needles = index.select("phrase").distinct().withColumn("needle", F.col("phrase"))
    keyed = texts.withColumn("whole_text", F.col("topic_text"))
    held = texts_holding(
        keyed, "query_id", "topic_text", needles, "phrase", "needle", ("whole_text",), strategy
    )
    pairs = lookup_join(held, index, ["phrase"], spread=["query_id"], strategy=strategy)
    hits = F.size(F.filter("name_words", lambda w: F.col("whole_text").contains(w)))
    by_name = F.when(F.col("name_words").isNull(), F.col("pos"))
    by_words = F.when(F.col("name_words").isNotNull() & (hits >= 2), F.col("pos"))
    return pairs.groupBy("query_id").agg(
        F.min(by_name).alias("name_pos"), F.min(by_words).alias("partial_pos")
    )


def contained_scheme(texts: DataFrame, schemes: DataFrame, strategy: str = AUTO) -> DataFrame:
    """A scheme's whole name occurs in the query. Blank names name nothing."""
    found = search_schemes(texts, schemes, strategy, partial=False)
    return found.where(F.col("name_pos").isNotNull()).select("query_id", F.col("name_pos").alias("pos"))


def partial_scheme(texts: DataFrame, schemes: DataFrame, strategy: str = AUTO) -> DataFrame:
    """At least two long words of a scheme's name occur in the query."""
    found = search_schemes(texts, schemes, strategy, names=False)
    return found.where(F.col("partial_pos").isNotNull()).select(
        "query_id", F.col("partial_pos").alias("pos")
    )


def token_scheme(texts: DataFrame, schemes: DataFrame, strategy: str = AUTO) -> DataFrame:
    """The query's first word occurs in a scheme's name; a query without words takes the
    first scheme. The word is taken literally, not as a pattern."""
    asked = texts.select("query_id", or_empty(first_of(words("topic_text"))).alias("token"))
    tokens = asked.select("token").where(F.col("token") != "").distinct()
    tokens = tokens.withColumn("needle", F.col("token"))
    strategy = strategy_for(strategy, schemes, growth=ROW_GROWTH * STEM)
    names = distinct_names(schemes)
    inside = phrases_inside(tokens, "token", "needle", names, "pos", "name_text", strategy=strategy)
    found = first_match(inside, "token", "pos")
    first = names.agg(F.min("pos").alias("pos")).where(F.col("pos").isNotNull())
    index = found.unionByName(first.select(F.lit("").alias("token"), "pos"))
    return lookup_join(asked, index, ["token"], spread=["query_id"], strategy=strategy).select(
        "query_id", "pos"
    )


def topic_words(keywords: DataFrame, faqs: DataFrame | None, strategy: str) -> DataFrame:
    """(word, label[, has_faqs]): each topic word once."""
    table = keywords.groupBy("word").agg(F.max("label").alias("label"))
    if faqs is None:
        return table
    used = faqs.select(F.col("category").alias("label")).distinct()
    return lookup_join(table, used.withColumn("has_faqs", F.lit(True)), ["label"], "left", ["word"], strategy)


def keyword_topic(texts: DataFrame, keywords: DataFrame, faqs: DataFrame | None = None) -> DataFrame:
    """(query_id, topic[, topic_has_faqs]) from the first query word in the keyword table."""
    strategy = strategy_for(AUTO, keywords)
    table = topic_words(keywords, faqs, strategy)
    fields = ["at", "label"] if faqs is None else ["at", "label", "has_faqs"]
    probes = texts.select("query_id", F.posexplode(words("topic_text")).alias("at", "word"))
    hits = lookup_join(probes, table, ["word"], spread=["query_id"], strategy=strategy)
    first = hits.groupBy("query_id").agg(F.min(F.struct(*fields)).alias("hit"))
    out = first.select("query_id", F.col("hit.label").alias("topic"), "hit")
    if faqs is None:
        return out.drop("hit")
    return out.select(
        "query_id", "topic", F.coalesce("hit.has_faqs", F.lit(False)).alias("topic_has_faqs")
    )


def specific_scheme(texts: DataFrame, schemes: DataFrame) -> DataFrame:
    """R9's second chance: the first listed keyword found in the query and in some name."""
    listed = F.array(
        *[F.struct(F.lit(i).alias("at"), F.lit(k).alias("kw")) for i, k in enumerate(SPECIFIC_KEYWORDS)]
    )

    def held_by(text: str):
        return F.explode(F.filter(listed, lambda k: F.col(text).contains(k["kw"]))).alias("k")

    names = distinct_names(schemes)
    index = names.select("pos", held_by("name_text")).groupBy("k.kw").agg(F.min("pos").alias("pos"))
    probes = texts.select("query_id", held_by("topic_text")).select("query_id", "k.at", "k.kw")
    # At most one index row per listed keyword.
    hits = probes.join(F.broadcast(index), "kw")
    first = hits.groupBy("query_id").agg(F.min(F.struct("at", "pos"))["pos"].alias("pos"))
    return first
