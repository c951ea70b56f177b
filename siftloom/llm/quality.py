"""Quality rules whose cutoffs follow each language and source (DataFrame functions only).

Every document is measured once.  KLL sketches of the measures are aggregated per
(language, source), merged upwards to the language and to the corpus, and turned into
fences ``median + SPREAD * spread + slack``; word length has a lower fence too.  The spread
is the smaller of ``median - q25`` and ``q75 - median``, so junk on one side does not widen
it while it is less than half of a group, and is shrunk towards the spread of the language
and that towards the corpus, with the weight of ``MIN_GROUP`` documents.  A group with fewer
than ``MIN_GROUP`` documents takes the median of its language, and a small language that of
the corpus.  The fences (one row per group) are joined back and filter the measured
documents.  Counts behind a share may exceed the fence by ``ALLOWED``: one or two repeated
lines are no sign of junk, however short the document.

Defined results: a null or blank text has no words and fails the base rule; null
languages and sources form groups of their own; repeated rows are judged one by one;
an empty table gives no rows; extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.columns import apart
from siftloom.llm.registry import query, table
from siftloom.session import cut_lineage

#: Parameters of the fences.
SPREAD = 6.0
MIN_GROUP = 100
#: Measure -> slack added to its fence: a group whose documents all agree has no spread.
SLACK = {"symbols_per_word": 0.1, "dup_line_share": 0.1, "repeat_share": 0.1, "word_length": 2.0}
#: Share -> its count, the count it is a share of, and what the count may be above the fence
#: (two lines; the words of a 15-word line and of its copy).
ALLOWED = {"dup_line_share": ("n_dup_lines", "n_lines", 2), "repeat_share": ("n_repeat_words", "n_words", 30)}
#: Measures of which too little is as odd as too much.
LOWER = ("word_length",)
#: Prefix of the columns added here.
P = "_qr_"

_SPACE = r"' \t\n\u000b\u000c\r'"
_BODY = "coalesce({text}, '')"
_WORDS = rf"filter(split(translate({_BODY}, '\t\n\u000b\u000c\r', '     '), ' '), w -> w != '')"
_LINES = rf"filter(split({_BODY}, '\n'), l -> translate(l, {_SPACE}, '') != '')"

# Each stage is a projection of its own, so nothing is computed twice.  A 3-word window is
# the hash of its words and its position: after sorting, equal windows are neighbours.
_STAGES = (
    {"words": f"transform({_WORDS}, w -> xxhash64(w))", "lines": _LINES},
    {
        "n_words": f"cast(size({P}words) as bigint)",
        "word_chars": f"cast(length(translate({_BODY}, {_SPACE}, '')) as bigint)",
        "n_symbols": f"cast(length({_BODY}) - length(translate({_BODY}, '#*$%&|<>', '')) as bigint)",
        "n_lines": f"cast(size({P}lines) as bigint)",
        "n_dup_lines": f"cast(size({P}lines) - size(array_distinct({P}lines)) as bigint)",
    },
    {
        "windows": f"""sort_array(transform(slice({P}words, 3, greatest(size({P}words), 1)), (w, i) ->
            struct(xxhash64({P}words[i], {P}words[i + 1], w) as h, cast(i as bigint) as i)))""",
    },
    {
        "found": f"""sort_array(transform(filter({P}windows, (x, i) ->
            (i > 0 and x.h = get({P}windows, i - 1).h)
            or (i + 1 < size({P}windows) and x.h = get({P}windows, i + 1).h)), x -> x.i))""",
    },
    {
        "n_repeat_words": f"""aggregate(transform({P}found, (x, j) ->
            if(j = 0, 3L, least(3L, x - get({P}found, j - 1)))), 0L, (a, x) -> a + x)""",
    },
    {
        "base_failed": f"{P}n_words < 50 or 100 * {P}n_repeat_words > 50 * {P}n_words",
        "symbols_per_word": f"{P}n_symbols / greatest({P}n_words, 1L)",
        "dup_line_share": f"{P}n_dup_lines / greatest({P}n_lines, 1L)",
        "repeat_share": f"{P}n_repeat_words / greatest({P}n_words, 1L)",
        "word_length": f"{P}word_chars / greatest({P}n_words, 1L)",
    },
)
_SPENT = ("words", "lines", "windows", "found")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and its measures, in columns of prefix ``P``."""
    for stage in _STAGES:
        docs = docs.withColumns({P + k: F.expr(v.replace("{text}", f"`{text}`")) for k, v in stage.items()})
    return docs.drop(*[P + c for c in _SPENT])


def fences(rows: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """One row per (language, source) with the upper fence of each measure and the lower ones.

    ``rows`` are measured documents.  Only documents that pass the base rule count.
    """
    lang, source = keys
    groups = rows.where(f"not {P}base_failed").groupBy(F.col(lang).alias(P + "lang"), F.col(source).alias(P + "source")).agg(
        F.count("*").alias("n0"), *[F.kll_sketch_agg_double(P + m).alias(f"{m}0") for m in SLACK])

    def merged(keep: list[str], level: int) -> DataFrame:
        return groups.groupBy(*keep).agg(
            F.sum("n0").alias(f"n{level}"), *[F.kll_merge_agg_double(f"{m}0").alias(f"{m}{level}") for m in SLACK])

    by_lang = merged([P + "lang"], 1).withColumnRenamed(P + "lang", "_lang")
    corpus = merged([], 2)  # one row
    levels = groups.join(by_lang, F.col(P + "lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(corpus))
    out = []
    for m, slack in SLACK.items():
        spread, mid = F.lit(0.0), None
        for level in (2, 1, 0):  # from the corpus down
            low, middle, high = (F.kll_sketch_get_quantile_double(F.col(f"{m}{level}"), F.lit(q)) for q in (0.25, 0.5, 0.75))
            own = F.least(middle - low, high - middle)
            n, above = F.col(f"n{level}"), 0 if level == 2 else MIN_GROUP
            spread = (n * own + above * spread) / (n + above)
            mid = middle if mid is None else F.when(n >= MIN_GROUP, middle).otherwise(mid)
        out.append((mid + SPREAD * spread + slack).alias(f"{P}max_{m}"))
        if m in LOWER:
            out.append((mid - SPREAD * spread - slack).alias(f"{P}min_{m}"))
    return levels.select(P + "lang", P + "source", *out)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with measures, ``_qr_base_failed`` and ``_qr_kept``.

    The measured rows are written once, since both the sketches and the filter read them.
    """
    kept_columns = list(docs.columns if keep is None else keep)
    needed = list(dict.fromkeys([*kept_columns, lang, source]))
    rows = measured(docs, text)
    rows = cut_lineage(rows.select(*needed, *[c for c in rows.columns if c.startswith(P)]))
    # written, so the planner knows their size: a small table is broadcast and no text is shuffled
    limits = cut_lineage(fences(rows, (lang, source)))
    within = " and ".join([
        *[f"{P}{m} <= {P}max_{m}" for m in SLACK if m not in ALLOWED],
        *[f"{P}{m} >= {P}min_{m}" for m in LOWER],
        *[f"{P}{count} <= {P}max_{m} * {P}{of} + {more}" for m, (count, of, more) in ALLOWED.items()]])
    on = F.col(lang).eqNullSafe(F.col(P + "lang")) & F.col(source).eqNullSafe(F.col(P + "source"))
    return rows.join(limits, on, "left").withColumn(
        P + "kept", F.expr(f"not {P}base_failed and coalesce({within}, true)"))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns."""
    docs, names, back = apart(docs)
    return back(judged(docs, names[text], names[lang], names[source]).where(P + "kept"))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = judged(docs, keep=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    limits = [*[F.col(f"{P}max_{m}").alias(f"max_{m}") for m in SLACK], *[F.col(f"{P}min_{m}").alias(f"min_{m}") for m in LOWER]]
    return rows.select("doc_id", *[F.col(P + c).alias(c) for c in names], *limits)
