"""Operator 9: licence texts and notices by the Dice coefficient of word bigrams, in DataFrame functions.

Texts are normalised to lower-case words. Each line, each paragraph of several lines and the whole text
are compared with the templates as sets of word bigrams: Dice = 2 |A and B| / (|A| + |B|). Dice can reach
the threshold t only if t / (2 - t) <= |A| / |B| <= (2 - t) / t, so a template meets only the segments of
a size within these bounds.

A licence may also stand inside other text as several lines, paragraphs or sentences: stretches of consecutive
lines and sentences of a template's length are compared, too. They are cut in pieces of bounded length, and
only where a piece holds enough of the template's bigrams.

A part of a text that reaches t holds t / (2 - t) of a template's bigrams, and so does the text, as its words
follow each other there as they do in the part. So each text is read once as one run of words, and only texts that
hold as many bigrams of a template are cut into segments and stretches, for these templates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
BROADCAST_BYTES = 64 << 20  # templates are broadcast up to this measured size, and joined by a shuffle beyond

# Licence notices and texts, as published.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see <https://www.gnu.org/licenses/>.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def templates_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def _bigrams(words):
    """The names of the distinct pairs of neighbouring words; ``words`` is a column's name."""
    return F.array_distinct(F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1)),
    ))


def _normal(text):
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _segments(normal):
    """Each different line, paragraph of several lines, and whole text; ``normal`` is a column's name."""
    paragraphs = F.filter(F.split(normal, r"\n(?: ?\n)+"), lambda p: F.contains(p, F.lit("\n")))
    return F.array_distinct(F.concat(F.split(normal, "\n"), paragraphs, F.array(normal)))


def _units(text):
    """The words of each line, and of each sentence of a line."""
    marked = F.regexp_replace(text, r"(?<=[.!?:;])[ \t]+", "\n")
    units = F.transform(F.split(_normal(marked), "\n"), lambda u: F.array_remove(F.split(u, " +"), ""))
    return F.filter(units, lambda u: F.size(u) > 0)


def _groups(known: DataFrame, low: float, size: int) -> DataFrame:
    """Rows of (probes, held, group): templates of about 8 MB, bigrams of which a text with a match holds one, and all of theirs."""
    needed = F.ceil(F.size("template") * low - 1e-9).cast("int")
    probes = F.slice("template", F.lit(1), F.size("template") - needed + 1)
    return (
        known.select("license", "template", F.size("words").alias("length"), probes.alias("probes"), needed.alias("needed"))
        .groupBy(F.pmod(F.xxhash64("license", "template"), F.lit(size // (8 << 20) + 1)))
        .agg(
            F.array_distinct(F.flatten(F.collect_list("probes"))).alias("probes"),
            F.array_distinct(F.flatten(F.collect_list("template"))).alias("held"),
            F.collect_list(F.struct("license", "template", "length", "needed")).alias("group"),
        ).select("probes", "held", "group")
    )


def _likely(group, grams, held):
    """The templates of which ``grams`` hold as many bigrams as a match needs; grams that no template has are left out once."""
    one = F.transform(F.array(F.array_intersect(grams, held)), lambda c: F.filter(group, lambda t: F.size(F.array_intersect(t["template"], c)) >= t["needed"]))
    return F.flatten(one)


def likely_texts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, text, likely) of the texts that hold enough bigrams of a template for a match, with these templates.

    The words are those of ``_normal``, and empty ones at the ends; a pair with one of them is in no template.
    """
    words = docs.select("doc_id", _text().alias("text"), F.split(F.lower(_text()), r"[^\p{L}\p{N}]+").alias("run"))
    grams = words.select("doc_id", "text", F.transform("run", lambda w, i: F.xxhash64(w, F.get("run", i + 1))).alias("all"))
    met = grams.crossJoin(groups).where(F.arrays_overlap("all", "probes"))
    return met.select("doc_id", "text", _likely(F.col("group"), F.col("all"), F.col("held")).alias("likely")).where(F.size("likely") > 0)


def candidates(likely: DataFrame, low: float, high: float, longest: int) -> DataFrame:
    """(doc_id, license, template, grams) of the segments and stretches of ``likely_texts`` that may match a template.

    A text is cut at every ``span`` words into pieces of two spans, where no stretch is longer than
    a span: one that starts in the first half of a piece lies in it. So the work grows with the words of a text, not
    with its units times its words.
    """
    span = max(1, math.ceil(longest * high))
    units = likely.select("doc_id", "likely", _normal(F.col("text")).alias("normal"), _units(F.col("text")).alias("units"))
    opens = F.flatten(F.transform("units", lambda u: F.transform(u, lambda w, i: i == 0)))  # whether a word begins a unit
    run = units.select("doc_id", "likely", "normal", F.flatten("units").alias("run"), F.concat(opens, F.array(F.lit(True))).alias("starts"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("run") - 1) / span).cast("int"))
    pieces = F.transform(cuts, lambda c: F.struct(
        F.lit(None).cast("string").alias("segment"),
        F.slice("run", c * span + 1, 2 * span).alias("words"), F.slice("starts", c * span + 1, 2 * span + 1).alias("opens"),
    ))
    alone = F.transform(_segments("normal"), lambda s: F.struct(
        s.alias("segment"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<boolean>").alias("opens"),
    ))
    part = run.select("doc_id", "likely", F.explode(F.concat(alone, pieces)).alias("p"))
    words = F.coalesce("p.words", F.array_remove(F.split("p.segment", r"[ \n]+"), ""))
    cut = part.select("doc_id", "likely", words.alias("words"), "p.opens").where(F.size("words") > 1)
    near = cut.select("doc_id", "likely", "words", "opens", _bigrams("words").alias("near"))
    whole = F.col("opens").isNull()  # a segment is compared as it is

    def fits(t):
        size, of = F.size("near"), F.size(t["template"])
        sized = size.between(F.ceil(of * low - 1e-9), F.floor(of * high + 1e-9))
        return (sized | ~whole) & (F.size(F.array_intersect("near", t["template"])) >= t["needed"])

    pairs = near.select("doc_id", "words", "opens", F.explode(F.filter("likely", fits)).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.least(F.lit(span), F.size("words")) - 1), lambda i: F.get("opens", i))
    starts = pairs.select("doc_id", "t", "words", "opens", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(begins)).alias("at"))
    # lengths in words, of whole units from here on, that fit the template
    least = F.greatest(F.floor(F.col("t.length") * low).cast("int"), F.lit(2))
    most = F.least(F.ceil(F.col("t.length") * high).cast("int"), F.size("words") - F.col("at"))
    ends = F.when(least <= most, F.filter(F.sequence(least, most), lambda n: F.get("opens", F.col("at") + n)))
    lengths = F.when(whole, F.array(F.size("words"))).otherwise(ends)
    ahead = F.when(whole, F.col("words")).otherwise(F.slice("words", F.col("at") + 1, F.greatest(most, F.lit(0))))
    chosen = starts.select("doc_id", "t", ahead.alias("ahead"), F.explode(lengths).alias("n"))
    words = chosen.select("doc_id", "t.license", "t.template", F.slice("ahead", F.lit(1), F.col("n")).alias("words"))
    # exploded, as a filter on the grams would otherwise be pushed below and cut the words anew for every pair
    return words.select("doc_id", "license", "template", F.explode(F.array(_bigrams("words"))).alias("grams"))


def match_licenses(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice) of the licences found in each document, with the best Dice of its segments.

    ``docs`` has doc_id and text, ``templates`` license and text (broadcast if its measured size is
    below ``BROADCAST_BYTES``); other columns are ignored. A null or empty text has no
    segment, a segment or template of fewer than two words has no bigram and matches nothing; rows
    that repeat an id, or have none, count as one document; empty tables give an empty table. A text may have any length.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = (
        templates.select("license", F.array_remove(F.split(_normal(F.coalesce("text", F.lit(""))), r"[ \n]+"), "").alias("words"))
        .where(F.size("words") > 1).select("license", "words", _bigrams("words").alias("template"))
    )
    size, longest = known.agg(F.sum(F.size("template") * F.lit(24) + 64), F.max(F.size("words"))).first()
    size = size or 0
    groups = _groups(known, low, size)
    if size <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    common = F.size(F.array_intersect("grams", "template"))
    scored = (
        candidates(likely_texts(docs, groups), low, high, longest or 1)
        .select("doc_id", "license", (2.0 * common / (F.size("grams") + F.size("template"))).alias("dice"))
        .where(F.col("dice") >= threshold)
    )
    return scored.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"))


def licenses_of(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_licenses, licenses (sorted, comma-joined), best_license, best_dice."""
    best = F.struct(F.col("dice"), F.col("license"))
    found = match_licenses(docs, templates, threshold).groupBy("doc_id").agg(
        F.array_sort(F.collect_list("license")).alias("licenses"),
        F.max("dice").alias("best_dice"), F.collect_list(best).alias("ranked"),
    )
    tied = F.filter("ranked", lambda s: s["dice"] == F.col("best_dice"))
    named = found.select("doc_id", "licenses", "best_dice", F.array_min(F.transform(tied, lambda s: s["license"])).alias("best_license"))
    rows = docs.select("doc_id")
    return rows.join(named.withColumnRenamed("doc_id", "found_id"), rows["doc_id"].eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.coalesce(F.size("licenses"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("licenses", ","), F.lit("")).alias("licenses"), "best_license", "best_dice",
    )
