"""Keyword topics and year tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions.text import occurrences, strip
from siftloom.functions.urls import let, literal_array

Keywords = Mapping[str, tuple[Sequence[str], Sequence[str]]]


def year_tags(text: Column, limit: int = 20) -> Column:
    years = F.regexp_extract_all(text, F.lit(r"(?U)\b(1[3-9][0-9]{2}|20[0-2][0-9])\b"), 1)
    return F.slice(F.array_distinct(years), 1, limit)


def _counted(text: Column, words: Sequence[str], weight: float) -> Column:
    """array<struct<w,n>> of the words that occur, with their weighted occurrences.

    The list is one literal array, so the plan stays small.
    """
    return F.filter(
        F.transform(
            literal_array(words),
            lambda w: F.struct(w.alias("w"), (occurrences(text, w) * weight).alias("n")),
        ),
        lambda x: x["n"] > 0,
    )


def topic_scores(text: Column, keywords: Keywords = rules.TOPIC_KEYWORDS) -> Column:
    """array<struct<category, score, found>> in dictionary order.

    Score is (2 x primary + secondary) hits per 1000 characters, at most 1; the
    divisor is at least 1.  A document meets every keyword inside its own row, so
    documents are neither multiplied nor shuffled.
    """

    def score(clean: Column) -> Column:
        per_thousand = F.greatest(F.lit(1.0), F.length(clean) / 1000)
        scored = []

        def entry(name: str):
            def build(hits: Column) -> Column:
                raw = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["n"]) / per_thousand
                return F.struct(
                    F.lit(name).alias("category"),
                    F.least(F.lit(1.0), raw).alias("score"),
                    F.slice(F.transform(hits, lambda h: h["w"]), 1, 10).alias("found"),
                )

            return build

        for name, (primary, secondary) in keywords.items():
            scored.append(let(F.concat(_counted(clean, primary, 2.0), _counted(clean, secondary, 1.0)), entry(name)))
        return F.array(*scored)

    return let(strip(F.coalesce(text, F.lit(""))), score)


def best_topic(scores: Column, text: Column, min_confidence: float = 0.3) -> Column:
    """struct(category, confidence): highest score, ties by dictionary order."""
    def choose(x: Column) -> Column:
        top = F.array_max(F.transform(x["scores"], lambda s: s["score"]))
        first = let(top, lambda t: F.get(F.filter(x["scores"], lambda s: s["score"] == t), F.lit(0)))
        return let(
            first,
            lambda f: F.struct(
                F.when(x["blank"], "unknown")
                .when(f["score"] < min_confidence, "general")
                .otherwise(f["category"])
                .alias("category"),
                F.when(x["blank"], 0.0).otherwise(f["score"]).alias("confidence"),
            ),
        )

    blank = ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")
    return let(F.struct(scores.alias("scores"), blank.alias("blank")), choose)
