"""Exact substring joins by equi-join.

``phrase in text`` implies that any piece of one word of the phrase is a piece of one word of the
text. Each phrase is therefore filed under one such piece (its anchor), the texts are cut into
pieces of the same lengths, and the two meet in a hash join on the piece. Candidates are then
verified with ``contains``, so the result is exact, and no pair without a shared piece is formed.

A phrase of several words needs no cut inside words: its inner words are whole words of the text, and its
last word begins one. Only phrases of one word may start anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS
from ..sizing import AUTO, BROADCAST, SALT, for_every_salt, lookup_join, strategy_for, with_salt
from .filters import count_in, count_sketch, in_filter, key_filter

GRAM = 4
STEM = 6
# Bytes of piece rows per byte of text, at most: one row of about 64 bytes per size and character.
ROW_GROWTH = 64
# Phrases of one word that a text is searched for one by one; more are filed under pieces.
LISTED_MOST = 256
INNER, LAST = "inner", "last"


def _words(text: str) -> str:
    blanks = "".join(f"\\u{ord(c):04x}" for c in BLANKS)
    return f"array_remove(split(btrim({text}, '{blanks}'), '(?U)\\\\s+'), '')"


def _distinct_words(text: str) -> str:
    return f"array_distinct({_words(text)})"


def text_pieces(text: str, smallest: int, largest: int, wrap: str = "{}") -> Column:
    """Distinct pieces of ``smallest`` to ``largest`` characters over the words of a text column.

    ``wrap`` is an SQL expression applied to each distinct piece.
    """
    pieces = f"""
      array_distinct(flatten(flatten(transform(
        filter({_distinct_words(text)}, w -> length(w) >= {smallest}),
        w -> transform(
          sequence({smallest}, least({largest}, length(w))),
          n -> transform(sequence(1, length(w) - n + 1), i -> substr(w, i, n)))))))"""
    return F.expr(pieces if wrap == "{}" else f"transform({pieces}, p -> {wrap.format('p')})")


def phrase_pieces(text: str) -> Column:
    """Pieces a phrase can be filed under: ``GRAM`` characters, or a whole shorter word."""
    return F.expr(f"""
      array_distinct(flatten(transform({_distinct_words(text)}, w ->
        if(length(w) < {GRAM}, array(w),
           transform(sequence(1, length(w) - {GRAM - 1}), i -> substr(w, i, {GRAM}))))))""")


def head_of(words: str) -> Column:
    """The piece a text of these words looks itself up by in a ``STEM`` index: the head of the longest one."""
    return F.substring(F.expr(f"array_max(transform({words}, w -> struct(length(w) as n, w as w))).w"), 1, STEM)


def head_piece(text: str) -> Column:
    return head_of(_distinct_words(text))


def rare_anchors(phrases: DataFrame, phrase: str, *keep: str) -> DataFrame:
    """(keep, anchor, short): the piece of each phrase that fewest phrases share, by a sketch of all pieces.

    Phrases are not moved. Blank phrases have no piece and go.
    """
    pieces = phrases.select(F.explode(phrase_pieces(phrase)).alias("piece"))
    uses = count_sketch(pieces.select(F.xxhash64("piece").alias("key")), "key")
    rank = F.array_min(F.transform("pieces", lambda p: F.struct(
        (F.length(p) < GRAM).alias("short"), count_in(F.col("uses"), F.xxhash64(p)).alias("uses"), (-F.length(p)).alias("n"), p.alias("piece"),
    )))
    cut = phrases.withColumns({"pieces": phrase_pieces(phrase), "uses": uses.scalar()})
    best = cut.where(F.size("pieces") > 0).select(*keep, rank.alias("best"))
    return best.select(*keep, F.col("best.piece").alias("anchor"), "best.short")


def is_single(phrase: str) -> Column:
    """Whether a phrase is one word."""
    return F.expr(f"size({_words(phrase)}) = 1")


def word_anchors(phrases: DataFrame, phrase: str, *keep: str) -> DataFrame:
    """(keep, piece, short): the hashed inner word, or head of the last word, that fewest phrases of several words share.

    ``short``: the piece is a last word of fewer than ``GRAM`` characters. Other phrases go.
    """
    listed = f"""
      get(transform(filter(array({_words(phrase)}), w -> size(w) > 1), w -> concat(
        transform(slice(w, 2, size(w) - 2), x -> struct('{INNER}' as side, x as piece)),
        array(struct('{LAST}' as side, left(element_at(w, -1), {GRAM}) as piece)))), 0)"""
    cut = phrases.withColumn("pieces", F.expr(listed)).where(F.col("pieces").isNotNull())
    key = lambda p: F.xxhash64(p["side"], p["piece"])
    uses = count_sketch(cut.select(F.explode("pieces").alias("p")).select(key(F.col("p")).alias("key")), "key")
    size = lambda p: F.length(p["piece"])
    rank = F.array_min(F.transform("pieces", lambda p: F.struct(
        (size(p) < GRAM).alias("small"), count_in(F.col("uses"), key(p)).alias("uses"), (-size(p)).alias("n"), p["side"].alias("side"), p["piece"].alias("piece"),
    )))
    best = cut.withColumn("uses", uses.scalar()).select(*keep, rank.alias("best"))
    short = (F.col("best.side") == LAST) & F.col("best.small")
    return best.select(*keep, key(F.col("best")).alias("piece"), short.alias("short"))


def word_probes(words: str, short: str) -> Column:
    """The hashed pieces that ``word_anchors`` can file a phrase under that a text of these words holds; short ones if column ``short`` says so."""
    last = ", ".join(f"xxhash64('{LAST}', left(w, {n}))" for n in range(1, GRAM))
    both = f"xxhash64('{INNER}', w), xxhash64('{LAST}', left(w, {GRAM}))"
    return F.expr(f"array_distinct(flatten(transform({words}, w -> if({short}, array({both}, {last}), array({both})))))")


def any_of(rows: DataFrame, flag: Column | str) -> Column:
    """Whether any row has ``flag``, as a subquery of the same job."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return rows.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("any")).scalar()


def exploded(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """A row for each item: an outer explode, as for an inner one Spark would make the items twice, to test for none."""
    return rows.select("*", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def texts_holding(
    texts: DataFrame,
    text_id: str,
    text: str,
    phrases: DataFrame,
    phrase_id: str,
    phrase: str,
    keep: tuple[str, ...] = (),
    strategy: str = AUTO,
) -> DataFrame:
    """(text_id, phrase_id) where ``text`` contains ``phrase``: many texts, a catalog of phrases.

    Every non-blank phrase takes part; ``phrase_id`` must be unique. With a broadcast catalog the
    pieces of a text are looked up as they are cut, and few phrases of one word are searched for one by one.
    Otherwise they first pass a bitmap of the pieces
    that phrases are filed under, in the text's own row; only (id, piece) of what is left is shuffled,
    salted by text, and the text is joined back by id to verify the few candidates. ``keep`` adds
    text-side columns.
    """
    strategy = strategy_for(strategy, phrases, growth=ROW_GROWTH)
    carried, wanted = list(dict.fromkeys([text_id, text, *keep])), list(dict.fromkeys([phrase_id, phrase]))
    phrases = phrases.select(*wanted)
    singles = phrases.where(is_single(phrase))
    filed = word_anchors(phrases, phrase, *wanted)
    flags, pieces = {"some_short": any_of(filed, "short")}, [word_probes(_distinct_words(text), "some_short")]
    listing = strategy == BROADCAST and singles.limit(LISTED_MOST + 1).count() <= LISTED_MOST
    if not listing:
        cut = rare_anchors(singles, phrase, *wanted)
        cut = cut.select(*wanted, F.xxhash64("anchor").alias("piece"), "short")
        filed = filed.unionByName(cut)
        # the pieces of a text's words are cut only if some phrase needs them
        flags |= {"some_single": any_of(cut, ~F.col("short")), "short_single": any_of(cut, "short")}
        none = F.array().cast("array<bigint>")
        for flag, least, most in (("some_single", GRAM, GRAM), ("short_single", 1, GRAM - 1)):
            pieces.append(F.when(F.col(flag), text_pieces(text, least, most, "xxhash64({})")).otherwise(none))
    keys, index = F.array_distinct(F.concat(*pieces)) if len(pieces) > 1 else pieces[0], filed.drop("short")
    if strategy != BROADCAST:
        marked = texts.select(*dict.fromkeys([text_id, text])).withColumns({**flags, "bits": key_filter(index, "piece").scalar()})
        passing = exploded(marked, F.filter(keys, lambda p: in_filter(F.col("bits"), p)), "piece").select(text_id, "piece")
        candidates = with_salt(passing, [text_id]).join(for_every_salt(index), ["piece", SALT])
        hits = candidates.drop("piece", SALT).join(texts.select(*carried), text_id)
    elif listing:
        id_type = phrases.schema[phrase_id].dataType.simpleString()
        item = lambda piece, id_: F.struct(piece.cast("bigint").alias("piece"), id_.cast(id_type).alias("id"))
        none = F.array().cast(f"array<struct<id:{id_type},phrase:string>>")
        listed = singles.agg(F.collect_list(F.struct(F.col(phrase_id).alias("id"), F.col(phrase).alias("phrase"))).alias("listed"))
        searched = texts.select(*carried).withColumns({**flags, "listed": F.coalesce(listed.scalar(), none)})
        held = F.filter("listed", lambda p: F.col(text).contains(p["phrase"]))
        items = F.concat(F.transform(keys, lambda k: item(k, F.lit(None))), F.transform(held, lambda p: item(F.lit(None), p["id"])))
        found = exploded(searched, items, "item").select(*carried, "item.piece", F.col("item.id").alias("found"))
        filed_as = index.select("piece", F.col(phrase).alias("sought"), F.col(phrase_id).alias("filed"))
        hits = found.join(F.broadcast(filed_as), "piece", "left").where(F.col("found").isNotNull() | F.col(text).contains(F.col("sought")))
        return hits.select(text_id, F.coalesce("found", "filed").alias(phrase_id), *keep)
    else:
        hits = exploded(texts.select(*carried).withColumns(flags), keys, "piece").join(F.broadcast(index), "piece")
    return hits.where(F.col(text).contains(F.col(phrase))).select(text_id, phrase_id, *keep)


def phrases_inside(
    phrases: DataFrame,
    phrase_id: str,
    phrase: str,
    texts: DataFrame,
    text_id: str,
    text: str,
    strategy: str = AUTO,
) -> DataFrame:
    """(phrase_id, text_id) where ``text`` contains ``phrase``: many phrases, a catalog of texts.

    The catalog is cut into pieces of up to ``STEM`` characters; each phrase looks up the head of
    its longest word.
    """
    strategy = strategy_for(strategy, texts, growth=ROW_GROWTH * STEM)
    pieces = text_pieces(text, 1, STEM, "xxhash64({})")
    index = texts.select(text_id, F.explode(pieces).alias("piece"))
    probes = phrases.select(phrase_id, phrase, F.xxhash64(head_piece(phrase)).alias("piece"))
    probes = probes.where(F.col(phrase).rlike(r"\S"))
    candidates = lookup_join(probes, index, ["piece"], spread=[phrase_id], strategy=strategy)
    hits = lookup_join(
        candidates, texts.select(text_id, text), [text_id], spread=[phrase_id], strategy=strategy
    )
    return hits.where(F.col(text).contains(F.col(phrase))).select(phrase_id, text_id)
