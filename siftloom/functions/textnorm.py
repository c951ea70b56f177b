"""Unicode normal forms, legacy-font decoding and word repair."""

from __future__ import annotations

import functools
import operator
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftloom import rules
from siftloom.functions.text import beyond_ascii, strip
from siftloom.functions.urls import let

#: Characters that every normal form leaves alone, alone or next to each other:
#: ASCII, precomposed Latin-1 letters, Arabic-script letters and digits, Cyrillic
#: basic letters, zero-width non-joiner and common punctuation.
STABLE = (
    r"^[\x{00}-\x{7F}\x{C0}-\x{FF}\x{400}-\x{45F}\x{621}-\x{63A}\x{641}-\x{64A}\x{660}-\x{669}"
    r"\x{679}-\x{6D3}\x{6D5}\x{60C}\x{61B}\x{61F}\x{200C}\x{2013}\x{2014}\x{2018}\x{2019}"
    r"\x{201C}\x{201D}]*$"
)


def _normal_form(form: str):
    @pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normalise


def unicode_form(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form; only rows that may change are sent to Python."""
    changed = _normal_form(form)(F.when(~beyond_ascii(text).rlike(STABLE), text))
    return F.coalesce(changed, text)


def map_kurdish_letters(text: Column) -> Column:
    def mapped(t: Column) -> Column:
        held = functools.reduce(operator.or_, (t.contains(letter) for letter in rules.ARABIC_FORMS))
        return F.when(held, F.translate(t, rules.ARABIC_FORMS, rules.KURDISH_FORMS)).otherwise(t)

    return let(text, mapped)


def normalize_text(text: Column) -> Column:
    """NFKC, then Kurdish letter forms.  The map keeps NFC, so no second pass is needed."""
    return map_kurdish_letters(unicode_form(F.coalesce(text, F.lit("")), "NFKC"))


def legacy_letter_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, rules.LEGACY_LETTERS, ""))


def decode_legacy_font(text: Column) -> Column:
    return F.translate(text, rules.LEGACY_LETTERS, rules.LEGACY_TARGETS)


def _repair_rules() -> list[tuple[str, str, str]]:
    """(literal that must occur, pattern, replacement), in order."""
    words = [(word, rf"(?U)\b{word}\b", fixed) for word, fixed in rules.WORD_REPAIRS]
    vowels = [
        (letter + "وە", rf"(?U)({letter})وە\b", "$1ەوە") for letter in rules.VOWEL_REPAIR_LETTERS
    ]
    return words + vowels


def repair_words(df: DataFrame, column: str, out: str, count: str) -> DataFrame:
    """Add the repaired text and the number of repairs.

    Rules run in order on the text left by the rule before.  Each is one narrow
    projection, guarded by a plain substring test.
    """
    df = df.withColumns({out: F.col(column), count: F.lit(0)})
    for literal, pattern, replacement in _repair_rules():
        hit = F.col(out).contains(literal)
        df = df.withColumns(
            {
                count: F.col(count)
                + F.when(hit, F.regexp_count(F.col(out), F.lit(pattern))).otherwise(0),
                out: F.when(hit, F.regexp_replace(F.col(out), pattern, replacement)).otherwise(
                    F.col(out)
                ),
            }
        )
    return df


def decode_kurdish(
    df: DataFrame, column: str, out: str = "decoded", threshold: float = 0.05
) -> DataFrame:
    """Add struct ``out``: text, encoding_type, is_legacy_encoded, confidence, repairs."""
    raw = F.coalesce(F.col(column), F.lit(""))
    blank = strip(raw) == ""
    legacy = legacy_letter_count(raw) / F.greatest(F.length(raw), F.lit(1)) > threshold
    df = df.withColumns({"_legacy": legacy, "_blank": blank})
    df = df.withColumn(
        "_base", normalize_text(F.when(F.col("_legacy"), decode_legacy_font(raw)).otherwise(raw))
    )
    df = repair_words(df, "_base", "_fixed", "_repairs")
    repaired = F.col("_repairs") > 0
    verdict = (
        F.when(F.col("_blank"), "empty")
        .when(F.col("_legacy"), "ali_kurdish_legacy")
        .when(repaired, "repaired_vowels")
        .otherwise("clean_unicode")
    )
    return df.withColumn(
        out,
        F.struct(
            F.when(F.col("_blank"), "").otherwise(F.col("_fixed")).alias("text"),
            verdict.alias("encoding_type"),
            (~F.col("_blank") & (F.col("_legacy") | repaired)).alias("is_legacy_encoded"),
            F.lit(1.0).alias("confidence"),
            F.when(F.col("_blank"), 0).otherwise(F.col("_repairs")).alias("repairs"),
        ),
    ).drop("_legacy", "_blank", "_base", "_fixed", "_repairs")
