"""Score free-text queries against a FAQ catalog, and relate FAQs to schemes and each other.

A pair scores only through a shared keyword or through containment, so candidates come from one
equi-join on hashed keys of five kinds: whole text, keyword, booster word, anchor of a FAQ text
inside the query, and head of a query inside a FAQ text. The keyword kind skips words that cannot
decide: to reach the threshold with ``n`` query keywords a pair must share at least
``ceil(0.3 n)`` of them, so it must share one of any ``n - ceil(0.3 n) + 1`` of them, and only the
longest (rarest) that many are probed. Booster words score more and are always probed. Every
candidate is then scored from the two texts, so neither a skipped key nor a hash collision can
change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    BOOSTER_POINTS,
    CONTAINMENT_POINTS,
    EXTRA_BOOSTERS,
    FAQ_THRESHOLD,
    STOP_WORDS,
)
from ..functions.text import (
    clean_query,
    clean_question,
    or_empty,
    present,
    strip,
    text_list,
    word_set,
    words,
)
from ..sizing import AUTO, BROADCAST, lookup_join, strategy_for
from .containment import (
    GRAM,
    ROW_GROWTH,
    STEM,
    any_of,
    exploded,
    head_of,
    is_single,
    rare_anchors,
    text_pieces,
    texts_holding,
    word_anchors,
    word_probes,
)
from .positions import with_positions
from .ranking import bounded_lists, keep_first, top_k

SCHEME_RELATED = 8
ALL_RELATED = 10


def english_faqs(faqs: DataFrame) -> DataFrame:
    """FAQ rows with the nested English text, where there is one, in front of the plain one."""
    texts = ["question", "answer"]
    if "en" in faqs.columns:
        texts_out = [F.coalesce(F.col(f"en.{t}"), F.col(t)).alias(t) for t in texts]
    else:
        texts_out = [F.col(t) for t in texts]
    return faqs.select("pos", *texts_out, "category", "scheme")


def vocabulary(keywords: DataFrame) -> DataFrame:
    """Keyword words and the listed boosters, distinct."""
    extra = F.explode(text_list(EXTRA_BOOSTERS)).alias("word")
    listed = keywords.sparkSession.range(1).select(extra)
    return keywords.select("word").union(listed).distinct()


def keywords_of(cleaned: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(word_set(cleaned), text_list(STOP_WORDS))


def faq_score(query_keys: Column, faq_keys: Column, faq_boosters: Column, contained: Column) -> Column:
    """shared share of the query, booster points, containment points."""
    shared = F.size(F.array_intersect(query_keys, faq_keys))
    boosted = F.size(F.array_intersect(query_keys, faq_boosters))
    base = shared / F.greatest(F.size(query_keys), F.lit(1))
    base = base + F.when(boosted > 0, F.lit(BOOSTER_POINTS) * boosted).otherwise(F.lit(0.0))
    return base + F.when(contained, F.lit(CONTAINMENT_POINTS)).otherwise(F.lit(0.0))


def faq_keys(faqs: DataFrame, boosters: DataFrame, strategy: str = AUTO) -> DataFrame:
    """(pos, faq_text, faq_keys, faq_boosters) of every FAQ that has a question."""
    base = (
        english_faqs(faqs)
        .select("pos", clean_question(or_empty("question")).alias("faq_text"))
        .where(F.col("faq_text") != "")
        .withColumn("faq_keys", keywords_of(F.col("faq_text")))
    )
    boosted = lookup_join(
        base.select("pos", F.explode("faq_keys").alias("word")),
        boosters.select("word").distinct(),
        ["word"],
        spread=["pos"],
        strategy=strategy,
    )
    lists = boosted.groupBy("pos").agg(F.collect_set("word").alias("boosted"))
    none = F.array().cast("array<string>")
    return base.join(lists, "pos", "left").select(
        "pos", "faq_text", "faq_keys", F.coalesce("boosted", none).alias("faq_boosters")
    )


def keyed_query(rows: DataFrame, query: Column) -> DataFrame:
    """``rows`` with (query_text, query_words, query_keys, needed): keywords longest first."""
    longest_first = F.expr(
        "transform(array_sort(transform(query_keys, w -> struct(-length(w) as n, w as w))), s -> s.w)"
    )
    keyed = rows.withColumn("query_text", clean_query(query)).withColumn("query_words", word_set("query_text"))
    keyed = keyed.withColumn("query_keys", F.array_except("query_words", text_list(STOP_WORDS))).withColumn("query_keys", longest_first)
    return keyed.withColumn("needed", F.expr("(3 * size(query_keys) + 9) div 10"))


def query_keys(queries: DataFrame) -> DataFrame:
    """(query_id, query_text, query_words, query_keys, needed)."""
    keyed = keyed_query(queries.select("query_id", or_empty("query").alias("query")), F.col("query"))
    return keyed.drop("query")


WHOLE, WORD, BOOSTER, ANCHOR, SHORT, HEAD = "whole", "word", "booster", "anchor", "short", "head"


def tagged_key(kind: str, *texts: Column | str) -> Column:
    return F.xxhash64(F.lit(kind), *texts)


def _keys(kind: str, texts: str) -> Column:
    return F.expr(f"transform({texts}, t -> xxhash64('{kind}', t))")


def faq_index(catalog: DataFrame, anchors: bool = True) -> DataFrame:
    """(key, kind, pos): every hashed key a FAQ can be found by; those for FAQ texts inside a query only with ``anchors``."""

    def rows(kind: str, keys: Column, source: DataFrame = catalog) -> DataFrame:
        return source.select(F.explode(keys).alias("key"), F.lit(kind).alias("kind"), "pos")

    scored = catalog.where(F.size("faq_keys") > 0)
    heads = text_pieces("faq_text", 1, STEM, f"xxhash64('{HEAD}', {{}})")
    keys = (
        rows(WHOLE, F.array(tagged_key(WHOLE, strip("faq_text"))))
        .unionByName(rows(WORD, _keys(WORD, "faq_keys")))
        .unionByName(rows(BOOSTER, _keys(BOOSTER, "faq_boosters")))
        .unionByName(rows(HEAD, heads, scored))
    )
    return keys.unionByName(_anchored(scored)) if anchors else keys


def _anchored(scored: DataFrame) -> DataFrame:
    """(key, kind, pos): the piece that each FAQ text is found by inside a query."""
    return rare_anchors(scored, "faq_text", "pos").select(
        tagged_key(ANCHOR, "anchor").alias("key"),
        F.when(F.col("short"), SHORT).otherwise(ANCHOR).alias("kind"),
        "pos",
    )


def query_probes(words: Column | None = None) -> Column:
    """Keys a query looks up, apart from those for FAQ texts inside it; its keywords only if ``words`` holds."""
    rare = _keys(WORD, "slice(query_keys, 1, greatest(size(query_keys) - int(needed) + 1, 0))")
    none = F.array().cast("array<bigint>")
    return F.concat(
        F.array(tagged_key(WHOLE, "query_text"), tagged_key(HEAD, or_empty(head_of("query_words")))),
        rare if words is None else F.when(words, rare).otherwise(none),
        _keys(BOOSTER, "query_keys"),
    )


def hit_result(kind: Column) -> Column:
    """(exact, score) of a (query, FAQ, kind) row that carries both sides; null where the hit proves nothing."""
    asked, known = F.col("query_text"), F.col("faq_text")
    contained = (
        F.when(kind.isin(ANCHOR, SHORT), asked.contains(known))
        .when(kind == HEAD, known.contains(asked))
        .otherwise(F.lit(False))
    )
    can_reach = kind.isin(BOOSTER, WHOLE) | contained | (
        (kind == WORD) & (F.size("faq_keys") >= F.col("needed"))
    )
    both = (F.size("query_keys") > 0) & (F.size("faq_keys") > 0)
    score = faq_score(F.col("query_keys"), F.col("faq_keys"), F.col("faq_boosters"), contained)
    exact = (kind == WHOLE) & (strip(known) == asked)
    return F.when(can_reach, F.struct(exact.alias("exact"), F.when(both & ~exact, score).alias("score")))


def _score_hits(hits: DataFrame) -> DataFrame:
    """Verify and score (query, FAQ, kind) rows that carry both sides."""
    scored = hits.select("query_id", "pos", hit_result(F.col("kind")).alias("result")).select("query_id", "pos", "result.*")
    return scored.where(F.col("exact") | (F.col("score") >= FAQ_THRESHOLD))


def faq_candidates(
    queries: DataFrame, faqs: DataFrame, boosters: DataFrame, strategy: str = AUTO
) -> DataFrame:
    """(query_id, pos, exact, score) for every pair that can reach the threshold.

    A pair may appear more than once; its highest score is its score. With a broadcast catalog
    the queries are probed in place. Otherwise only (id, key) rows are shuffled, salted by query.
    Queries are cut inside words only if some FAQ text is one word.
    """
    strategy = strategy_for(strategy, faqs, growth=ROW_GROWTH * STEM)
    keyed, catalog = query_keys(queries), faq_keys(faqs, boosters, strategy)
    scored_texts = catalog.where(F.size("faq_keys") > 0)
    worded = word_anchors(scored_texts, "faq_text", "pos").select(F.col("piece").alias("key"), F.lit(ANCHOR).alias("kind"), "pos", "short")
    single = _anchored(scored_texts.where(is_single("faq_text")))
    index = faq_index(catalog, anchors=False).unionByName(worded.drop("short")).unionByName(single)
    keyed = keyed.withColumns({
        "some_short": any_of(worded, "short"),
        "some_single": any_of(single, F.col("kind") == ANCHOR), "short_single": any_of(single, F.col("kind") == SHORT),
        "most_keys": catalog.agg(F.coalesce(F.max(F.size("faq_keys")), F.lit(0)).alias("most")).scalar(),
    })
    none = F.array().cast("array<bigint>")
    cut = lambda flag, least, most: F.when(F.col(flag), text_pieces("query_text", least, most, f"xxhash64('{ANCHOR}', {{}})")).otherwise(none)
    # a query that needs more shared keywords than any FAQ has reaches nothing by keywords alone
    probes = F.concat(query_probes(F.col("needed") <= F.col("most_keys")), word_probes("query_words", "some_short"), cut("some_single", GRAM, GRAM), cut("short_single", 1, GRAM - 1))
    if strategy == BROADCAST:
        hits = exploded(keyed, probes, "key").join(F.broadcast(index), "key")
        hits = hits.join(F.broadcast(catalog), "pos")
    else:
        slim = exploded(keyed, probes, "key").select("query_id", "key")
        slim = lookup_join(slim, index, ["key"], "inner", ["query_id"], strategy)
        hits = lookup_join(slim, catalog, ["pos"], "inner", ["query_id"], strategy)
        hits = hits.join(keyed, "query_id")
    return _score_hits(hits)


def best_of(candidates: DataFrame) -> DataFrame:
    """Exact first, then the highest score, ties to the earliest FAQ."""
    best = candidates.groupBy("query_id").agg(
        F.max(F.struct("exact", "score", (-F.col("pos")).alias("back"))).alias("best")
    )
    return best.select(
        "query_id", (-F.col("best.back")).alias("faq_pos"), "best.exact", "best.score"
    )


def best_faq(
    queries: DataFrame, faqs: DataFrame, boosters: DataFrame, strategy: str = AUTO
) -> DataFrame:
    """The answering FAQ of each query that has one."""
    return best_of(faq_candidates(queries, faqs, boosters, strategy))


# ---- FAQ, scheme and topic relations -------------------------------------------


def tagged_faqs(schemes: DataFrame, faqs: DataFrame, strategy: str = AUTO) -> DataFrame:
    """(scheme_id, pos) of FAQs tagged with the scheme's name, ignoring case."""
    strategy = strategy_for(strategy, schemes)
    tags = english_faqs(faqs).select("pos", F.lower(or_empty("scheme")).alias("tag"))
    named = schemes.select("scheme_id", F.lower("name").alias("tag"))
    pairs = lookup_join(tags, named, ["tag"], spread=["pos"], strategy=strategy)
    return pairs.select("scheme_id", "pos")


def name_words(name: Column | str) -> Column:
    """Words of a name longer than three characters, repeats kept."""
    return F.filter(words(F.lower(or_empty(name))), lambda w: F.length(w) > 3)


def _faqs_by_word(
    schemes: DataFrame, faqs: DataFrame, strategy: str
) -> tuple[DataFrame, DataFrame]:
    """(scheme_id, word) and (word, pos): FAQs whose question holds a word of some name."""
    owned = schemes.select("scheme_id", F.explode(F.array_distinct(name_words("name"))).alias("word"))
    vocabulary_ = owned.select("word").distinct().withColumn("needle", F.col("word"))
    questions = english_faqs(faqs).select("pos", F.lower(or_empty("question")).alias("asked"))
    held = texts_holding(
        questions, "pos", "asked", vocabulary_, "word", "needle", strategy=strategy
    )
    return owned, held


def worded_faqs(schemes: DataFrame, faqs: DataFrame, strategy: str = AUTO) -> DataFrame:
    """(scheme_id, pos) of FAQs that hold a word of the name and are not tagged with it."""
    strategy = strategy_for(strategy, schemes, growth=ROW_GROWTH)
    owned, held = _faqs_by_word(schemes, faqs, strategy)
    pairs = lookup_join(held, owned, ["word"], spread=["pos"], strategy=strategy)
    pairs = pairs.select("scheme_id", "pos").distinct()
    return pairs.join(tagged_faqs(schemes, faqs, strategy), ["scheme_id", "pos"], "left_anti")


def scheme_questions(
    schemes: DataFrame, faqs: DataFrame, k: int = SCHEME_RELATED, without: list[str] = []
) -> DataFrame:
    """First ``k`` distinct questions per scheme: tagged FAQs, then FAQs by name word.

    Questions in ``without`` don't count; a scheme that has no others gets an empty list.
    Only the first ``2k`` distinct questions of a word can be among the first ``k`` of a scheme
    (at most ``k`` of them repeat tagged ones), so each word is cut to those before it meets the
    schemes that own it.
    """
    strategy = strategy_for(AUTO, schemes, faqs, growth=ROW_GROWTH)
    asked = english_faqs(faqs).select("pos", or_empty("question").alias("question"))
    owned, held = _faqs_by_word(schemes, faqs, strategy)
    worded = lookup_join(held, asked, ["pos"], spread=["word"], strategy=strategy)
    worded = worded.where(F.col("question") != "")
    unwanted = F.col("question").isin(without)
    by_word = keep_first(worded.where(~unwanted), ["word", "question"], ["pos"])
    heads = top_k(by_word, ["word"], ["pos"], 2 * k).drop("rank")
    secondary = owned.join(heads, "word").select(
        "scheme_id", F.lit(1).alias("tier"), "pos", "question"
    )
    tagged = tagged_faqs(schemes, faqs, strategy)
    primary = lookup_join(tagged, asked, ["pos"], spread=["scheme_id"], strategy=strategy).select(
        "scheme_id", F.lit(0).alias("tier"), "pos", "question"
    )
    merged = primary.unionByName(secondary).where(F.col("question") != "")
    unique = keep_first(merged.where(~unwanted), ["scheme_id", "question"], ["tier", "pos"])
    lists = bounded_lists(unique, ["scheme_id"], ["tier", "pos"], F.col("question"), k, "questions")
    if not without:
        return lists
    only = owned.join(worded.where(unwanted).select("word").distinct(), "word").select("scheme_id")
    some = only.unionByName(primary.where(unwanted).select("scheme_id")).distinct()
    none = F.array().cast("array<string>")
    return lists.join(some, "scheme_id", "full").withColumn("questions", F.coalesce("questions", none))


def topic_faqs(faqs: DataFrame, topics: DataFrame) -> DataFrame:
    """Every FAQ of each distinct topic in ``topics(topic)``."""
    rows = english_faqs(faqs)
    wanted = topics.select(F.col("topic").alias("category")).distinct()
    pairs = lookup_join(rows, wanted, ["category"], spread=["pos"])
    return pairs.select(
        F.col("category").alias("topic"), "pos", "question"
    )


def topic_questions(faqs: DataFrame, k: int, without: list[str] = []) -> DataFrame:
    """First ``k`` distinct questions of every topic, in catalog order; those in ``without`` don't count."""
    rows = english_faqs(faqs).where(present("question") & ~F.col("question").isin(without))
    unique = keep_first(rows, ["category", "question"], ["pos"])
    return bounded_lists(unique, ["category"], ["pos"], F.col("question"), k, "questions")


def topic_heads(faqs: DataFrame, k: int) -> DataFrame:
    """The questions among the first ``k`` FAQs of every topic: blank ones are left out, repeats stay."""
    lists = bounded_lists(english_faqs(faqs), ["category"], ["pos"], or_empty("question"), k, "questions")
    return lists.select("category", F.array_remove("questions", "").alias("questions"))


def related_faqs(faqs: DataFrame) -> DataFrame:
    """(pos, related): up to 8 questions of the same scheme, filled to 10 from the category.

    Rows with a blank question or the content of the row itself are no relatives. Repeats of a scheme's
    question count, those of a category's don't. Each group is cut to the heads that can appear in a
    list, whichever row asks, before the FAQs join it: of a scheme twice 8 rows with at most 8 of
    one content, as a row only ignores its own; of a category 19 questions, as 8 may be listed already and
    one is the row's own, each with its first rows of two contents.
    """
    rows = english_faqs(faqs).withColumn("content", F.sha2(F.to_json(F.struct("question", "answer", "category", "scheme")), 256))
    rows = rows.withColumn("topic", or_empty(F.concat(F.lit("="), F.col("category"))))  # no category is one, too
    asked = rows.where(present("question"))
    scheme_rows = top_k(asked.where(present("scheme")), ["scheme", "content"], ["pos"], SCHEME_RELATED).drop("rank")
    by_scheme = bounded_lists(
        scheme_rows, ["scheme"], ["pos"], F.struct("content", "question"), 2 * SCHEME_RELATED, "scheme_heads"
    )
    contents = keep_first(asked, ["topic", "question", "content"], ["pos"])
    pairs = bounded_lists(contents, ["topic", "question"], ["pos"], F.struct("pos", "content"), 2, "rows")
    by_topic = bounded_lists(
        pairs, ["topic"], [F.col("rows")[0]["pos"]], F.struct("question", "rows"), ALL_RELATED + SCHEME_RELATED + 1, "topic_heads"
    )
    strategy = strategy_for(AUTO, faqs, growth=4)
    joined = lookup_join(rows, by_scheme, ["scheme"], "left", ["pos"], strategy)
    joined = lookup_join(joined, by_topic, ["topic"], "left", ["pos"], strategy)
    other = lambda h: h["content"] != F.col("content")
    same_scheme = F.slice(F.transform(F.filter("scheme_heads", other), lambda h: h["question"]), 1, SCHEME_RELATED)
    none = F.array().cast("array<string>")
    lists = joined.select("pos", "content", "topic_heads", F.coalesce(same_scheme, none).alias("same_scheme"))
    first = F.transform("topic_heads", lambda h: F.struct(
        F.get(F.filter(h["rows"], other), F.lit(0))["pos"].alias("at"), h["question"].alias("question")
    ))
    placed = F.array_sort(F.filter(first, lambda h: h["at"].isNotNull()))
    same_topic = F.coalesce(F.transform(placed, lambda h: h["question"]), none)
    return lists.withColumn("same_topic", same_topic).select(
        "pos", F.slice(F.concat("same_scheme", F.array_except("same_topic", "same_scheme")), 1, ALL_RELATED).alias("related")
    )


def seeded(value: Column | str, seed: int) -> Column:
    """A repeatable draw order."""
    return F.md5(F.concat_ws(":", F.lit(seed), value))


def faq_pools(faqs: DataFrame, seed: int = 0, k: int = 5) -> DataFrame:
    """Size of each category's pool and its first ``k`` FAQs in seeded order."""
    rows = english_faqs(faqs).withColumn("draw", seeded("pos", seed))
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("pool_size"))
    heads = bounded_lists(rows, ["category"], ["draw", "pos"], F.col("pos"), k, "drawn")
    return sizes.join(heads, "category")


def faq_pool_rows(faqs: DataFrame, seed: int = 0) -> DataFrame:
    """(category, draw_rank, pos): every FAQ at its place (from 0) in its category's seeded order."""
    rows = english_faqs(faqs).select("category", "pos", seeded("pos", seed).alias("draw"))
    return with_positions(rows, ["draw", "pos"], ["category"], "draw_rank").drop("draw")


def stratified_sample(faqs: DataFrame, seed: int = 0, size: int = 5) -> DataFrame:
    """T5: one FAQ from each of up to ``size`` categories, filled to ``size``, in seeded order.

    Ranking needs only the first ``size`` rows of each category and of the whole catalog, which
    Spark takes as distributed top-k.
    """
    rows = english_faqs(faqs).withColumn("draw", seeded("pos", seed))
    leaders = keep_first(rows, ["category"], ["draw", "pos"]).withColumn(
        "turn", seeded("category", seed)
    )
    first = leaders.orderBy("turn", "category").limit(size).withColumn("tier", F.lit(0))
    fill = (
        rows.orderBy("draw", "pos").limit(2 * size)
        .withColumn("turn", F.col("draw")).withColumn("tier", F.lit(1))
    )
    unique = keep_first(first.unionByName(fill), ["pos"], ["tier"])
    return unique.orderBy("tier", "turn", "pos").limit(size).select("pos", "question", "category")
