"""Language choice and compound-text splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import COMPOUND_LENGTH, SCRIPT_RANGES, TITLE_PREFIXES
from .text import col, present, strip


def detect_language(text: Column | str) -> Column:
    """Language of the first listed script that occurs in the text, else ``en``."""
    text = col(text)
    found = F.when(F.length(strip(text)) < 2, F.lit("en"))
    for lang, script in SCRIPT_RANGES:
        found = found.when(text.rlike(script), F.lit(lang))
    return found.otherwise(F.lit("en"))


def target_language(lang: Column | str, query: Column | str) -> Column:
    """The requested language, or the detected one if none or ``auto`` was requested."""
    lang = col(lang)
    return F.when(present(lang) & (lang != "auto"), lang).otherwise(detect_language(query))


def is_compound(text: Column | str) -> Column:
    text = col(text)
    return F.coalesce(
        (F.length(text) > COMPOUND_LENGTH) & (text.contains("\n") | text.contains(". ")),
        F.lit(False),
    )


def separator(text: Column | str) -> Column:
    text = col(text)
    newline_first = (F.length(text) > COMPOUND_LENGTH) & text.contains("\n")
    return F.when(newline_first, F.lit("\n")).otherwise(F.lit(". "))


def split_compound(text: Column | str) -> Column:
    """Trimmed, non-empty parts of a compound text; any other text as its only part."""
    text = col(text)
    parts = F.when(separator(text) == "\n", F.split(text, "\n")).otherwise(F.split(text, r"\. "))
    trimmed = F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)
    return F.when(is_compound(text), trimmed).otherwise(F.array(text))


def strip_title_prefix(text: Column | str) -> Column:
    """Drop a known heading word before the first ``:``, and outer quotes and spaces."""
    text = col(text)
    head = F.lower(strip(F.substring_index(text, ":", 1)))
    rest = strip(F.substr(text, F.instr(text, ":") + 1))
    body = F.when(text.contains(":") & head.isin(TITLE_PREFIXES), rest).otherwise(text)
    return F.btrim(body, F.lit(" \"'"))
