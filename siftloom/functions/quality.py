"""Quality factors of a file and its text, and the 0-100 score."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions.text import class_count
from siftloom.functions.urls import let

CONTROL_CLASS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
UNPRINTABLE_CLASS = r"[\p{C}\p{Z}&&[^ \n\r\t]]"


def mojibake_ratio(text: Column) -> Column:
    """Share of characters that speak of a wrong encoding, at most 1."""

    def ratio(t: Column) -> Column:
        bad = class_count(t, r"[\x{e0}-\x{ff}\x{fffd}\x00-\x08\x0B\x0C\x0E-\x1F]")
        for pattern in rules.MOJIBAKE_PATTERNS:
            # a pattern is counted only where the text holds its first character
            first = re.sub(r"^\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern)[0]
            bad = bad + F.when(t.contains(first), F.regexp_count(t, F.lit(pattern))).otherwise(0)
        return F.least(F.lit(1.0), bad / F.greatest(F.length(t), F.lit(1)))

    return let(F.coalesce(text, F.lit("")), ratio)


def printable_ratio(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    return F.when(size == 0, 0.0).otherwise(
        (size - class_count(text, UNPRINTABLE_CLASS)) / F.greatest(size, F.lit(1))
    )


def control_free_count(text: Column) -> Column:
    """Characters that are not control codes: the page-level form of the ratio above."""
    return F.length(text) - class_count(text, CONTROL_CLASS)


def text_density(chars: Column, page_count: Column, file_size: Column) -> Column:
    return (
        F.when(page_count > 0, chars / page_count)
        .when(file_size > 0, chars / (file_size / 1024.0))
        .otherwise(chars.cast("double"))
    )


def density_score(density: Column, is_pdf: Column) -> Column:
    def steps(table):
        score = F.when(density.isNull(), rules.DENSITY_FLOOR)
        for limit, value in table:
            score = score.when(density >= limit, value)
        return score.otherwise(rules.DENSITY_FLOOR)

    return F.when(is_pdf, steps(rules.PDF_DENSITY_STEPS)).otherwise(steps(rules.TEXT_DENSITY_STEPS))


def metadata_completeness(*fields: Column) -> Column:
    """Share of the six descriptive fields that are present and not empty."""
    present = sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return present / len(rules.METADATA_FIELDS)


def integrity_score(file_size: Column, is_pdf: Column, header: Column) -> Column:
    """1.0, halved under 100 bytes, times 0.3 for a PDF without its signature."""
    return F.when(F.coalesce(file_size, F.lit(0)) == 0, 0.0).otherwise(
        F.when(file_size < 100, 0.5).otherwise(1.0)
        * F.when(is_pdf & ~F.coalesce(header == "%PDF-", F.lit(False)), 0.3).otherwise(1.0)
    )


def quality_score(
    text: Column,
    file_size: Column,
    is_pdf: Column,
    header: Column,
    completeness: Column,
    page_count: Column | None = None,
) -> Column:
    """struct(score, text_density, printable_ratio, encoding_quality, ...)."""
    pages = F.lit(None).cast("int") if page_count is None else page_count
    density = text_density(F.length(F.coalesce(text, F.lit(""))), pages, file_size)
    facts = F.struct(
        density.alias("density"),
        printable_ratio(text).alias("printable_ratio"),
        (1.0 - mojibake_ratio(text)).alias("encoding_quality"),
        completeness.cast("double").alias("metadata_completeness"),
        integrity_score(file_size, is_pdf, header).cast("double").alias("file_integrity"),
        is_pdf.alias("pdf"),
    )

    def combine(x: Column) -> Column:
        factors = {
            "text_density": density_score(x["density"], x["pdf"]),
            **{k: x[k] for k in rules.QUALITY_WEIGHTS if k != "text_density"},
        }
        total = sum((factors[k] * F.lit(w) for k, w in rules.QUALITY_WEIGHTS.items()), F.lit(0.0))
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total * 100).cast("int")))
        return F.struct(
            score.alias("score"),
            F.bround(x["density"], 3).alias("text_density"),
            F.bround(factors["text_density"], 3).alias("density_score"),
            *[F.bround(x[k], 3).alias(k) for k in rules.QUALITY_WEIGHTS if k != "text_density"],
        )

    return let(facts, combine)
