"""Whitespace, paragraph and counting helpers shared by the text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    # a single blank, which most runs are, is left alone
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    # the end is looked for from the end, not behind every run of white space
    return F.regexp_extract(text, r"(?Us)^\s*+(.*\S)", 1)


def beyond_ascii(text: Column) -> Column:
    """The characters that are not ASCII, in order."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lit("")).otherwise(F.regexp_replace(text, r"[\x00-\x7F]+", ""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, collapsed, unique, in order."""
    blocks = F.transform(F.split(text, r"(?U)\n\s*\n+"), collapse)
    return F.array_distinct(F.filter(blocks, lambda b: b != ""))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(
        F.contains(text, needle),
        (
            (F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))) / F.octet_length(needle)
        ).cast("long"),
    ).otherwise(F.lit(0).cast("long"))


def class_count(text: Column, char_class: str) -> Column:
    """Characters of a regular-expression class, removed run by run."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))
