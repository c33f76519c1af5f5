"""Operator 2: quality by weak supervision, in DataFrame functions alone.

Each rule of ``RULES`` votes good (1) or bad (-1) on a document or abstains (0). How often a rule votes
so on good and on bad documents, and so how accurate its votes are, is estimated by expectation-maximisation, without labels: the posterior of
each document weighs the votes by these rates, and the rates are counted anew by the posteriors.
Documents that got the same votes are alike to it, so it runs on the counts of vote patterns, at most
3 ** len(RULES) rows for any corpus; a step returns a few sums to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import checkpoint

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ENDS = "!.?…。！？।॥؟۔"  # of sentences
PLACE_BITS = 24  # a window's place in its code; longer texts are counted by sorted strings
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_STEPS, SETTLED, KEEP_FROM = 20, 1e-3, 0.5
PRIOR = 0.8  # the share of good documents: what votes alone can't tell, as rare faults leave most documents without any


def repeated_words(words: str, n: str) -> tuple[Column, Column, Column]:
    """(codes, repeated, count): words in 3-word windows that occur twice or more.

    A window's code is 40 bits of its hash and its place, so that equal windows are neighbours in
    sorted order. Neighbours of one hash are compared by their words; should they differ (or the text
    be too long for the places), ``by_strings`` counts instead.
    """
    part = lambda a: F.shiftright(a, PLACE_BITS)
    item = lambda i: F.get(F.col(words), i.cast("int"))
    codes = F.sort_array(F.transform(
        F.slice(F.col(words), F.lit(1), F.greatest(F.col(n) - 2, F.lit(0))),
        lambda w, i: F.shiftleft(part(F.xxhash64(w, item(i + 1), item(i + 2))), PLACE_BITS).bitwiseOR(i.cast("long")),
    ))
    neighbour = lambda c, k: part(F.get(F.col("codes"), k)) == part(c)
    repeated = F.filter("codes", lambda c, k: F.coalesce(neighbour(c, k + 1), F.lit(False)) | F.coalesce(neighbour(c, k - 1), F.lit(False)))
    return codes, repeated, covered("places")


def covered(places: str) -> Column:
    """Words covered by 3-word windows at ascending places."""
    return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")))["n"]


def by_strings(words: str, n: str) -> Column:
    """The same count by sorting the windows themselves."""
    item = lambda i: F.get(F.col(words), i)
    windows = F.sort_array(F.transform(
        F.slice(F.col(words), F.lit(1), F.greatest(F.col(n) - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, item(i + 1), item(i + 2)).alias("w"), i.cast("long").alias("p")),
    ))
    start = F.struct(F.lit("").alias("w"), F.lit(-1).cast("long").alias("p"), F.expr("cast(array() as array<bigint>)").alias("found"))

    def step(s, x):
        equal = (s["p"] >= 0) & (s["w"] == x["w"])
        return F.struct(x["w"].alias("w"), x["p"].alias("p"), F.when(equal, F.concat(s["found"], F.array(s["p"], x["p"]))).otherwise(s["found"]).alias("found"))

    places = F.array_sort(F.array_distinct(F.aggregate(windows, start, step)["found"]))
    return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")))["n"]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and what the rules look at, for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.array_remove(F.split("text", WHITE), "").alias("words"))
    sized = split.withColumns({"n": F.size("words"), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    codes, repeated, count = repeated_words("words", "n")
    coded = sized.withColumn("codes", codes).withColumn("repeated", repeated).drop("codes")
    mask = F.lit((1 << PLACE_BITS) - 1)
    word = lambda c, k: F.get(F.col("words"), (c.bitwiseAND(mask) + k).cast("int"))
    clash = F.exists(F.sequence(F.lit(0), F.greatest(F.size("repeated") - 2, F.lit(0))), lambda k: (
        (F.shiftright(F.get(F.col("repeated"), k), PLACE_BITS) == F.shiftright(F.get(F.col("repeated"), k + 1), PLACE_BITS))
        & reduce(lambda a, b: a | b, [~word(F.get(F.col("repeated"), k), F.lit(i)).eqNullSafe(word(F.get(F.col("repeated"), k + 1), F.lit(i))) for i in range(3)])
    ))
    placed = coded.withColumns({"clash": clash, "places": F.sort_array(F.transform("repeated", lambda c: c.bitwiseAND(mask)))}).drop("repeated")
    removed = lambda c: F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    return placed.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        reduce(lambda a, b: a + b, [removed(c) for c in SYMBOLS]).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("clash") | (F.col("n") >= 1 << PLACE_BITS), by_strings("words", "n")).otherwise(count).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_upper_words"),
        F.size(F.filter("words", lambda w: F.right(w, F.lit(1)).isin(*ENDS))).cast("long").alias("n_ends"),
        removed("!").cast("long").alias("n_shouts"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_unlettered"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote, from the columns of ``features``: 1 good, -1 bad, 0 abstains.

    Rules that look for one fault abstain where they don't find it.
    """
    never = F.lit(False)
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return {
        "length": _vote(c("n_words") >= 100, c("n_words") < MIN_WORDS),
        "repeats": _vote(never, c("n_repeat_words") * 10 > 3 * n),
        "symbols": _vote(never, c("n_symbols") * 10 > n),
        "lines": _vote(never, c("n_dup_lines") * 2 > c("n_lines")),
        "case": _vote(never, c("n_upper_words") * 10 > 3 * n),
        "sentences": _vote((c("n_ends") * 100 >= n) & (c("n_ends") * 5 <= n), (c("n_ends") * 100 < n) & (n >= MIN_WORDS)),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 8 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 12 * n)),
        "shouts": _vote(never, c("n_shouts") * 10 > n),
        "letters": _vote(never, c("n_unlettered") * 10 > n),
    }


RULES = ("length", "repeats", "symbols", "lines", "case", "sentences", "word_length", "shouts", "letters")


def posterior(rates: dict[str, tuple[float, float, float, float]], prior: float = PRIOR) -> Column:
    """Probability of good. ``rates`` has for each rule how often it votes good on good and on bad
    documents, then how often it votes bad on good and on bad ones; an abstention says nothing (were it to
    count, the most frequent fault would become the class of bad documents, and the others none). A
    vote that is found to be the wrong way round says nothing either."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule, (good_good, good_bad, bad_good, bad_bad) in rates.items():
        right, wrong = max(math.log(good_good / good_bad), 0.0), min(math.log(bad_good / bad_bad), 0.0)
        odds = odds + F.when(F.col(rule) == 1, F.lit(right)).when(F.col(rule) == -1, F.lit(wrong)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """The rates by expectation-maximisation over the rule columns of ``votes``.

    The accuracy of a rule's vote follows from its rates and the prior. To begin with, a vote for bad
    is taken to be nine times likelier on a bad document, and a vote for good to say little; all
    rules start alike, so what tells them apart is only how they agree.
    """
    patterns = checkpoint(votes.groupBy(*RULES).agg(F.count(F.lit(1)).cast("double").alias("docs")))
    rates = {rule: (0.5, 0.45, 0.05, 0.45) for rule in RULES}
    for _ in range(MAX_STEPS):
        weighed = patterns.select(*RULES, "docs", (posterior(rates) * F.col("docs")).alias("good"))
        classes = {"good": F.col("good"), "bad": F.col("docs") - F.col("good")}
        sums = [F.sum("docs").alias("docs"), F.sum("good").alias("good")]
        for rule in RULES:
            sums += [F.sum(F.when(F.col(rule) == vote, weight)).alias(f"{rule} {vote} {name}") for vote in (1, -1) for name, weight in classes.items()]
        row = weighed.agg(*sums).first().asDict()
        if not row["docs"]:
            break
        mass = {"good": row["good"] + 2, "bad": row["docs"] - row["good"] + 2}
        new = {
            rule: tuple(((row[f"{rule} {vote} {name}"] or 0.0) + 1) / mass[name] for vote in (1, -1) for name in ("good", "bad"))
            for rule in RULES
        }
        moved = max(abs(a - b) for rule in RULES for a, b in zip(new[rule], rates[rule]))
        rates = new
        if moved < SETTLED:
            break
    return rates


def judge_quality(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, the base counts, each rule's vote, quality (the posterior
    probability of good), base_failed and kept.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text has no words and
    fails the base rule; repeated rows count each; an empty table gives an empty table.
    """
    counted = features(docs)
    votes = checkpoint(counted.select("*", *(vote.alias(name) for name, vote in rules().items())))
    rates = estimate(votes)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return votes.withColumns({"quality": posterior(rates), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
