"""Text helpers as Column builders."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank at either end of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = r"(?U)\s+"
# Letters whose upper case is written with several, and the one capital of those that have one.
GROWING = "".join(c for c in map(chr, range(0xDF, 0xFB18)) if len(c.upper()) > 1)
CAPITALS = "".join("\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in GROWING)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(BLANKS))


def present(text: Column | str) -> Column:
    """True for a non-null, non-empty text; never NULL."""
    return F.coalesce(F.length(col(text)) > 0, F.lit(False))


def or_empty(text: Column | str) -> Column:
    return F.coalesce(col(text), F.lit(""))


def text_list(items: Iterable[str]) -> Column:
    """A constant array of texts (one literal, folded by the optimizer)."""
    return F.split(F.lit("\x01".join(items)), "\x01")


def contains_any(text: Column | str, phrases: Iterable[str]) -> Column:
    """One pattern of literal alternatives, so that the text is evaluated once."""
    return col(text).rlike("|".join(rf"\Q{phrase}\E" for phrase in phrases))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_of(items: Column) -> Column:
    """First array element, or NULL."""
    return F.get(items, F.lit(0))


def clean_query(query: Column | str) -> Column:
    """Lower, drop ``? . ! ,``, trim."""
    return strip(F.translate(strip(F.lower(col(query))), "?.!,", ""))


def clean_question(question: Column | str) -> Column:
    """Lower, drop ``? . !``; commas and outer blanks stay."""
    return F.translate(F.lower(col(question)), "?.!", "")


def clean_command(query: Column | str) -> Column:
    """Lower, trim, drop ``! .``: the form greetings and phrases are tested on."""
    return F.translate(strip(F.lower(col(query))), "!.", "")


def clean_topic_text(query: Column | str) -> Column:
    """Lower, drop ``? . ,``, trim: the form topics and scheme names are tested on."""
    return strip(F.translate(F.lower(col(query)), "?.,", ""))


def words(text: Column | str) -> Column:
    """Words in order; no empty items."""
    return F.array_remove(F.split(strip(text), BLANK_RUN), "")


def word_set(text: Column | str) -> Column:
    return F.array_distinct(words(text))


def clean_val(value: Column | str) -> Column:
    """Lower, keep ``[a-z0-9 ]``, trim, collapse spaces; NULL gives ``''``."""
    kept = F.regexp_replace(F.lower(or_empty(value)), "[^a-z0-9 ]", "")
    return F.regexp_replace(F.trim(kept), " +", " ")


def clean_val_no_space(value: Column | str) -> Column:
    """Lower, keep ``[a-z0-9]``; NULL gives ``''``."""
    return F.regexp_replace(F.lower(or_empty(value)), "[^a-z0-9]", "")


def upper_letters(text: Column | str) -> Column:
    """Upper case letter by letter, as SQL has it: a sharp s is one capital, not ``SS``."""
    runs = F.regexp_extract_all(col(text), F.lit(f"([{GROWING}]+|[^{GROWING}]+)"), F.lit(1))
    capitals = lambda r: F.translate(r, GROWING, CAPITALS)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{GROWING}]"), capitals(r)).otherwise(F.upper(r))), "")


def title_case(text: Column | str) -> Column:
    """Capitalize each run of letters, after any non-letter."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))
        ),
        "",
    )


def split_steps(steps: Column | str) -> Column:
    """Numbered or line-separated steps as an ordered array of texts."""
    parts = F.transform(F.split(col(steps), r"(?:\n|\b\d+\.\s*)"), strip)
    return F.filter(parts, lambda p: (F.length(p) > 0) & ~p.rlike(r"^[\d.]+$"))


def mask(text: Column | str, visible: int = 4) -> Column:
    """Keep the first and last ``visible`` characters, ``x`` between."""
    text = col(text)
    middle = F.repeat(F.lit("x"), F.length(text) - 2 * visible)
    masked = F.concat(F.left(text, F.lit(visible)), middle, F.right(text, F.lit(visible)))
    return (
        F.when(~present(text), F.lit("N/A"))
        .when(F.length(text) <= visible, text)
        .when(F.length(text) < 2 * visible, F.repeat(F.lit("x"), F.length(text)))
        .otherwise(masked)
    )


def truncate_desc(text: Column | str, width: int = 100) -> Column:
    """First ``width`` characters plus ``...``."""
    return F.concat(F.substring(or_empty(text), 1, width), F.lit("..."))


def topic_title(topic: Column | str) -> Column:
    """``state_tamil_nadu`` to ``Tamil Nadu``."""
    return title_case(F.replace(F.replace(col(topic), F.lit("state_"), F.lit("")), F.lit("_"), F.lit(" ")))


def label_items(
    items: Column, everything: str, label: Callable[[Column], Column], any_case: bool = False
) -> Column:
    """Display form of a rule list: one fixed label if it holds ``all``, else each item's label."""
    holds_all = F.array_contains(F.transform(items, F.lower) if any_case else items, "all")
    return F.when(holds_all, F.array(F.lit(everything))).otherwise(F.transform(items, label))


def category_label(item: Column) -> Column:
    return F.when(F.length(item) <= 3, F.upper(item)).otherwise(title_case(item))


def spaced_label(item: Column) -> Column:
    return title_case(F.replace(item, F.lit("_"), F.lit(" ")))


def display_categories(items: Column | str) -> Column:
    return label_items(col(items), "All Categories", category_label)


def display_gender(items: Column | str) -> Column:
    return label_items(col(items), "All", title_case)


def display_special(items: Column | str) -> Column:
    return label_items(col(items), "None", spaced_label)


def display_states(items: Column | str) -> Column:
    return label_items(col(items), "All India", spaced_label, any_case=True)
