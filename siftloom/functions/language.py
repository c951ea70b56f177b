"""Script ratios and the language rules built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions.text import beyond_ascii, class_count, strip
from siftloom.functions.urls import let

SCRIPTS = {
    "arabic": rules.ARABIC_CLASS,
    "latin": rules.LATIN_CLASS,
    "cyrillic": rules.CYRILLIC_CLASS,
    "devanagari": rules.DEVANAGARI_CLASS,
}


def script_profile(text: Column) -> Column:
    """struct of script ratios and the dominant script of the trimmed text."""

    def ratios(x: Column) -> Column:
        total = F.greatest(F.length(x["clean"]), F.lit(1))
        # Latin alone has letters within ASCII
        part = lambda name: x["clean"] if name == "latin" else x["beyond"]
        return F.struct(
            x["clean"].alias("clean"),
            *[(class_count(part(name), c) / total).alias(name) for name, c in SCRIPTS.items()],
        )

    def parts(clean: Column) -> Column:
        return F.struct(clean.alias("clean"), beyond_ascii(clean).alias("beyond"))

    def dominant(x: Column) -> Column:
        script = F.when(x["clean"] == "", "unknown")
        for name in SCRIPTS:
            script = script.when(x[name] > 0.3, name)
        script = script.when((x["arabic"] > 0.1) & (x["latin"] > 0.1), "mixed").otherwise("unknown")
        return F.struct(*[x[n].alias(f"{n}_ratio") for n in SCRIPTS], script.alias("script"))

    return let(let(let(strip(F.coalesce(text, F.lit(""))), parts), ratios), dominant)


def kurdish_letter_class(strict: bool = False) -> str:
    return f"[{rules.STRICT_KURDISH_LETTERS if strict else rules.KURDISH_LETTERS}]"


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in rules.LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def needs_profile(text: Column, profile: Column, strict: bool = False) -> Column:
    """True where the script alone does not settle the language."""
    arabic = (profile["script"] == "arabic") | (profile["arabic_ratio"] > 0.2)
    return (arabic & ~text.rlike(kurdish_letter_class(strict))) | profile["script"].isin(
        "latin", "cyrillic"
    )


def detect_language(
    text: Column, profile: Column, guess: Column | None = None, strict_alphabet: bool = False
) -> Column:
    """struct(language, confidence, script, is_rtl, language_name).

    ``profile`` is :func:`script_profile` of the same text.  ``guess`` is the code
    proposed by an n-gram profile, or NULL; it refines Arabic, Latin and Cyrillic
    text and is ignored elsewhere.
    """
    guess = F.lit(None).cast("string") if guess is None else guess
    facts = F.struct(
        F.coalesce(text, F.lit("")).alias("text"), profile["script"].alias("script"),
        profile["arabic_ratio"].alias("arabic"), guess.alias("guess"),
    )
    kurdish = kurdish_letter_class(strict_alphabet)
    return let(facts, lambda x: _language(x["text"], x["script"], x["arabic"], x["guess"], kurdish))


def refined_language(profile: Column, guess: Column) -> Column:
    """The verdict of :func:`detect_language` where :func:`needs_profile` holds, without the text.

    Such a text is not blank, and it has no Kurdish letter if it is Arabic.
    """
    facts = F.struct(profile["script"].alias("script"), profile["arabic_ratio"].alias("arabic"), guess.alias("guess"))
    return let(facts, lambda x: _language(F.lit("-"), x["script"], x["arabic"], x["guess"], kurdish_letter_class()))


def _language(text: Column, script: Column, arabic: Column, guess: Column, kurdish: str) -> Column:
    known = guess.isin(list(rules.LANGUAGE_NAMES))

    def verdict(code, confidence, name, rtl) -> Column:
        code = code if isinstance(code, Column) else F.lit(code)
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        name = name if isinstance(name, Column) else F.lit(name)
        return F.struct(
            code.alias("language"),
            confidence.cast("double").alias("confidence"),
            name.alias("script"),
            F.lit(rtl).alias("is_rtl"),
            language_name(code).alias("language_name"),
        )

    arabic_side = (script == "arabic") | (arabic > 0.2)
    boosted = F.when(guess.isin("ar", "ckb", "fa", "ur") & (arabic > 0.3), 0.85).otherwise(0.75)
    return (
        F.when(~text.rlike(r"(?U)\S"), verdict("unknown", 0.0, "unknown", False))
        .when(arabic_side & text.rlike(kurdish), verdict("ckb", 0.85, "arabic", True))
        .when(arabic_side & known, verdict(guess, boosted, "arabic", True))
        .when(arabic_side, verdict("ar", 0.7, "arabic", True))
        .when((script == "latin") & known, verdict(guess, 0.8, "latin", False))
        .when(script == "latin", verdict("en", 0.6, "latin", False))
        .when((script == "cyrillic") & guess.isNotNull(), verdict(guess, 0.75, "cyrillic", False))
        .otherwise(
            verdict("unknown", 0.0, F.when(script == "unknown", "mixed").otherwise(script), False)
        )
    )
