"""One tagged index over every catalog a question is matched with, probed in one scan.

A row of the index says: whoever has this key may match that catalog row, in this way (``kind``).
Keys are hashes of a tag and a text: a whole name, a piece of a word, a topic word, a FAQ keyword.
A question lists all its keys in its own row; a filter of the index' keys (a bitmap that Spark builds
as a subquery of the same job) drops those that nothing is filed under, before they become rows.
What is left meets the index in one join, and each hit is verified from the texts, so that neither
the filter nor a hash collision can change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FAQ_THRESHOLD, SPECIFIC_KEYWORDS
from ..functions.text import first_of, or_empty, strip, words
from ..sizing import BROADCAST, lookup_join, stored, strategy_for
from .containment import GRAM, STEM, rare_anchors, text_pieces
from .faq import ANCHOR, SHORT, faq_index, faq_keys, hit_result, keyed_query, query_probes, tagged_key, vocabulary
from .filters import in_filter, key_filter
from .matching import distinct_names, name_keys, rare_name_words, topic_words

EXACT, NAME, PART, TOKEN, STEMMED, TOPIC, LISTED, FAQ = "exact", "name", "part", "token", "stem", "topic", "listed", "faq"


def _filed(rows: DataFrame, kind: str, key: Column, **fields: Column | str) -> DataFrame:
    """Index rows of one kind; what a kind doesn't use is null."""
    given = {name: F.col(f) if isinstance(f, str) else f for name, f in fields.items()}
    none = {"ref": "long", "text": "string", "parts": "array<string>", "label": "string", "has_faqs": "boolean", "short": "boolean"}
    columns = [given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in none.items()]
    return rows.select(key.alias("key"), F.lit(kind).alias("kind"), *columns)


def scheme_index(schemes: DataFrame, dictionary: DataFrame | None, strategy: str) -> DataFrame:
    """J4-J7 and the listed keywords: every key a scheme can be found by."""
    names = stored(distinct_names(schemes))
    exact = name_keys(schemes, dictionary, strategy)
    anchored = rare_anchors(names, "name_text", "name_text", "pos")
    worded = rare_anchors(rare_name_words(names.withColumnRenamed("name_text", "name")), "phrase", "phrase", "pos", "name_words")
    pieces = names.select("pos", F.explode(text_pieces("name_text", 1, STEM)).alias("piece"))
    pieces = pieces.groupBy("piece").agg(F.min("pos").alias("pos"))
    first = names.agg(F.min("pos").alias("pos")).where(F.col("pos").isNotNull())
    stems = names.select("pos", "name_text", F.explode(text_pieces("name_text", STEM, STEM)).alias("piece"))
    listed = names.select("pos", F.explode(F.filter(_listed(), lambda k: F.col("name_text").contains(k["kw"]))["kw"]).alias("kw"))
    parts = [
        _filed(exact, EXACT, tagged_key(EXACT, "name_key", "key_lang"), ref="pos", text="name_key", label="key_lang"),
        _filed(anchored, NAME, tagged_key(ANCHOR, "anchor"), ref="pos", text="name_text", short="short"),
        _filed(worded, PART, tagged_key(ANCHOR, "anchor"), ref="pos", text="phrase", parts="name_words", short="short"),
        _filed(pieces, TOKEN, tagged_key(TOKEN, "piece"), ref="pos", text="piece"),
        _filed(first, TOKEN, tagged_key(TOKEN, F.lit("")), ref="pos", text=F.lit("")),
        _filed(stems, STEMMED, tagged_key(STEMMED, "piece"), ref="pos", text="name_text"),
        _filed(listed.groupBy("kw").agg(F.min("pos").alias("pos")), LISTED, tagged_key(LISTED, "kw"), ref="pos", text="kw"),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _listed() -> Column:
    """The listed keywords with their place."""
    return F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("kw")) for i, k in enumerate(SPECIFIC_KEYWORDS)))


def catalog_index(
    schemes: DataFrame, faqs: DataFrame, keywords: DataFrame, dictionary: DataFrame | None, strategy: str
) -> tuple[DataFrame, DataFrame]:
    """(index, FAQ texts): all keys, and what a FAQ hit is scored with.

    Both are stored in the shared folder once and then read by the filter and the join; they serve any
    number of batches of questions, and are broadcast if what is stored is small enough.
    """
    strategy = strategy_for(strategy, schemes, faqs, keywords)
    texts = stored(faq_keys(faqs, vocabulary(keywords), strategy))
    asked = _filed(faq_index(texts), FAQ, F.col("key"), ref="pos", label="kind", short=F.col("kind") == SHORT)
    topics = topic_words(keywords, faqs, strategy)
    topic = _filed(topics, TOPIC, tagged_key(TOPIC, "word"), text="word", label="label", has_faqs="has_faqs")
    return stored(_union([scheme_index(schemes, dictionary, strategy), asked, topic])), texts


# ---- probes ------------------------------------------------------------------------------------


def with_probes(rows: DataFrame, bits: Column, any_short: Column) -> DataFrame:
    """``rows`` (query, lang, english, topic_text, tests) with what each kind compares, and ``probes``.

    A row whose stage is known without a catalog probes nothing; one that asks for a list or the states
    may still be a scheme's name.
    """
    exact = F.replace(strip(F.lower("query")), F.lit("?"), F.lit(""))
    rows = keyed_query(rows, F.col("english")).withColumns({
        "name_key": exact, "token": or_empty(first_of(words("topic_text"))), "topic_words": words("topic_text"),
    })
    open_ = F.col("cheap_stage").isNull()
    searched = open_ & ~F.col("asks_list") & ~F.col("asks_state")
    none = F.array().cast("array<struct<key:bigint,at:int>>")
    at = lambda key, place=F.lit(-1): F.struct(key.alias("key"), place.cast("int").alias("at"))
    named = F.array(*(at(tagged_key(EXACT, "name_key", lang)) for lang in (F.lit("*"), F.col("lang"))))
    by_token = F.when(F.length("token") <= STEM, tagged_key(TOKEN, "token")).otherwise(tagged_key(STEMMED, F.left("token", F.lit(STEM))))
    topics = F.transform("topic_words", lambda w, i: at(F.xxhash64(F.lit(TOPIC), w), i))
    listed = F.transform(
        F.filter(_listed(), lambda k: F.col("topic_text").contains(k["kw"])), lambda k: at(F.xxhash64(F.lit(LISTED), k["kw"]), k["at"])
    )
    piece = f"struct(xxhash64('{ANCHOR}', {{}}) as key, -1 as at)"
    anchors = text_pieces("topic_text", GRAM, GRAM, piece)
    asked = F.when(F.col("query_text") == F.col("topic_text"), none).otherwise(text_pieces("query_text", GRAM, GRAM, piece))
    short = F.when(F.col("any_short"), F.concat(text_pieces("topic_text", 1, GRAM - 1, piece), text_pieces("query_text", 1, GRAM - 1, piece))).otherwise(none)
    scored = F.transform(query_probes(), lambda k: at(k))
    search = F.concat(F.array(at(by_token)), topics, listed, anchors, asked, short, scored)
    probes = F.concat(F.when(open_, named).otherwise(none), F.when(searched, search).otherwise(none))
    kept = [c for c in rows.columns if c != "bits"]
    return rows.withColumns({"bits": bits, "any_short": any_short}).select(*kept, F.filter(probes, lambda p: in_filter(F.col("bits"), p["key"])).alias("probes"))


def probe(rows: DataFrame, index: DataFrame, texts: DataFrame, strategy: str) -> DataFrame:
    """Each row once by itself (``kind`` null) and with each catalog row that its keys hit, not yet verified.

    A broadcast index meets the rows in place. Otherwise only (query_id, key) is shuffled, and texts are
    joined back to their hits.
    """
    bits = key_filter(index, "key").scalar()
    any_short = index.agg(F.coalesce(F.max("short"), F.lit(False)).alias("short")).scalar()
    keyed = with_probes(rows, bits, any_short)
    index = index.drop("short")
    texts = texts.select(F.col("pos").alias("ref"), F.lit(FAQ).alias("kind"), "faq_text", "faq_keys", "faq_boosters")
    own = F.array(F.lit(None).cast("struct<key:bigint,at:int>"))
    keyed = keyed.withColumn("probes", F.concat(own, "probes"))
    if strategy == BROADCAST:
        slim = keyed.withColumn("probe", F.explode_outer("probes")).drop("probes")
        slim = slim.withColumns({"key": F.col("probe.key"), "at": F.col("probe.at")}).drop("probe")
        return slim.join(F.broadcast(index), "key", "left").join(F.broadcast(texts), ["kind", "ref"], "left")
    slim = keyed.select("query_id", F.explode_outer("probes").alias("probe")).select("query_id", "probe.*")
    hits = lookup_join(slim, index, ["key"], "left", ["query_id"], strategy)
    hits = hits.where(F.col("key").isNull() | F.col("kind").isNotNull())
    hits = lookup_join(hits, texts, ["kind", "ref"], "left", ["query_id"], strategy)
    return keyed.drop("probes").join(hits, "query_id")


def fold(hits: DataFrame, *keep: str) -> DataFrame:
    """One row for each question (``keep``): the earliest verified hit of each kind, and the best FAQ.

    What is not verified goes before the rows are grouped, as texts among the kept values make Spark sort
    them; the row that each question has by itself stays.
    """
    kind, text, topic_text = F.col("kind"), F.col("text"), F.col("topic_text")
    held = F.size(F.filter("parts", lambda w: topic_text.contains(w)))
    word = F.get("topic_words", F.col("at"))
    proved = (
        F.when(kind == EXACT, (text == F.col("name_key")) & F.col("label").isin(F.lit("*"), F.col("lang")))
        .when(kind.isin(NAME, LISTED), topic_text.contains(text))
        .when(kind == PART, held >= 2)
        .when(kind == TOKEN, text == F.col("token"))
        .when(kind == STEMMED, text.contains(F.col("token")))
        .when(kind == TOPIC, text == word)
        .otherwise(F.lit(False))
    )
    result = F.when(kind == FAQ, hit_result(F.col("label")))
    checked = hits.select(*keep, "kind", "ref", "at", "label", "has_faqs", proved.alias("proved"), result.alias("result"))

    reached = F.col("result.exact") | (F.col("result.score") >= FAQ_THRESHOLD)
    checked = checked.where(F.col("kind").isNull() | F.coalesce("proved", F.lit(False)) | F.coalesce(reached, F.lit(False)))

    def least(kinds: list[str], value: Column) -> Column:
        return F.min(F.when(F.col("proved") & kind.isin(kinds), value))

    return checked.groupBy(*keep).agg(
        least([EXACT], F.col("ref")).alias("exact_pos"),
        least([NAME], F.col("ref")).alias("name_pos"),
        least([PART], F.col("ref")).alias("partial_pos"),
        least([TOKEN, STEMMED], F.col("ref")).alias("token_pos"),
        least([LISTED], F.struct("at", "ref")).alias("listed"),
        least([TOPIC], F.struct("at", "label", "has_faqs")).alias("topic"),
        F.max(F.when(reached, F.struct("result.exact", "result.score", (-F.col("ref")).alias("back")))).alias("faq"),
    )
