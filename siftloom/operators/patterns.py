"""URLs against a table of regular expressions, by an index of required literals.

A regular expression that matches a text needs certain runs of plain characters in it.  One
gram of up to ``GRAM`` characters of such a run, the one that the fewest URLs hold, stands
for each alternative of a pattern; numbers and names fit it whole, so that many patterns
that differ in them do not all meet the same URLs.  URLs meet patterns by equality on these grams, and only
pairs that meet are matched.  Patterns without a required character (``\\d+``) are matched
against every URL; they come to it as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.session import cut_lineage

#: Characters of a gram at most; runs of fewer than ``SHORT`` serve only where no longer one is there.
GRAM, SHORT = 8, 3


def _closing(pattern: str, at: int) -> int:
    """Index after the group or class that opens at ``at``; -1 if it never closes."""
    depth, in_class = 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif in_class:
            # a bracket right after the opening, or its negation, is a member
            if c == "]" and at > first:
                in_class, depth = False, depth - 1
        elif c == "[":
            in_class, depth = True, depth + 1
            first = at + (2 if pattern[at + 1: at + 2] == "^" else 1)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        at += 1
        if depth == 0:
            return at
    return -1


def required_literals(pattern: str) -> list[list[str]]:
    """Per alternative of a pattern, runs of characters that each of its matches holds.

    Only plain characters outside groups and classes count; what is not understood for sure
    is left out, so an alternative may have no run.
    """
    if "(?" in pattern.replace("(?:", "").replace("(?=", "").replace("(?!", "") or "\\Q" in pattern:
        return [[]]  # flags change what a character means
    branches: list[list[str]] = [[]]
    run, at = "", 0

    def end(keep: str) -> str:
        if keep:
            branches[-1].append(keep)
        return ""

    while at < len(pattern):
        c = pattern[at]
        if c in "([":
            run, at = end(run), _closing(pattern, at)
            if at < 0:
                return [[]]
            continue
        if c == "|":
            run = end(run)
            branches.append([])
        elif c in "*?{":
            # the character before may be absent or repeated
            run = end(run[:-1])
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return [[]]
        elif c == "+":
            run = end(run)
        elif c in ".^$)":
            run = end(run)
        elif c == "\\":
            at += 1
            escaped = pattern[at: at + 1]
            if escaped and not escaped.isalnum():
                run += escaped
            elif escaped in "dDwWsSbBAzZ":
                run = end(run)
            else:  # \\x41, \\p{L}, \\1 and the like
                return [[]]
        else:
            run += c
        at += 1
    end(run)
    return branches


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, branch, gram) for all grams of the runs of each alternative, null where there is none."""
    for batch in batches:
        out = []
        for pattern in batch.column("pattern").to_pylist():
            branches = required_literals(pattern)
            grams = [{run[i: i + GRAM] for run in runs for i in range(max(1, len(run) - GRAM + 1))} for runs in branches]
            grams = [{g for g in some if len(g) >= min(SHORT, max(map(len, some)))} for some in grams]
            if not all(grams):
                out.append((pattern, 0, None))
            else:
                out += [(pattern, branch, g) for branch, some in enumerate(grams) for g in some]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["pattern", "branch", "gram"])


def _grams_of(url: str, n: int) -> Column:
    """All runs of ``n`` characters of a URL."""
    starts = F.sequence(F.lit(1), F.length(url) - n + 1)
    return F.when(F.length(url) >= n, F.transform(starts, lambda i: F.substring(url, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def pattern_matches(rows: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Distinct (url, pattern) of the URLs of ``rows`` and the patterns that match in them.

    URLs are looked up once each, whatever rows share them.
    """
    # short rows, long work: dealt out by number, and by a hash, so that the exchange of distinct() does not do for it
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = patterns.where("pattern is not null").select("pattern").distinct().repartition(parts, F.xxhash64("pattern"))
    grams = cut_lineage(named.mapInArrow(_grams, "pattern string, branch int, gram string"))
    every = cut_lineage(rows.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().repartition(parts, F.xxhash64("url")))
    sizes = [r.n for r in grams.where("gram is not null").select(F.length("gram").alias("n")).distinct().collect()]  # GRAM rows at most
    bare = grams.where("gram is null").agg(F.sort_array(F.collect_set("pattern")).alias("p"))
    found = every.withColumn("_bare", bare.scalar()).select("url", F.explode("_bare").alias("pattern")).where(F.rlike("url", F.col("pattern")))
    if not sizes:
        return found
    held = every.select("url", F.explode(F.array_distinct(F.flatten(F.array(*[_grams_of("url", n) for n in sizes])))).alias("gram"))
    wanted = grams.where("gram is not null").select("gram").distinct()
    held = cut_lineage(held.join(wanted, "gram", "left_semi"))
    # a gram that no URL holds rules its alternative out
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (grams.where("gram is not null").join(counts, "gram", "left").groupBy("pattern", "branch")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("pattern", "r.gram").distinct())
    pairs = held.join(rarest, "gram").select("url", "pattern").distinct()
    return found.unionByName(pairs.where(F.rlike("url", F.col("pattern"))))


def filter_by_patterns(rows: DataFrame, include: DataFrame, exclude: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``included_by`` and ``excluded_by`` (least matching pattern) and ``passes``.

    A row passes if no exclude pattern matches and, unless the include table is empty, an
    include pattern does.
    """
    for table, name in ((include, "included_by"), (exclude, "excluded_by")):
        hit = pattern_matches(rows, table, url).groupBy("url").agg(F.min("pattern").alias(name))
        rows = rows.join(hit.withColumnRenamed("url", "_url"), F.col(url) == F.col("_url"), "left").drop("_url")
    all_pass = include.where("pattern is not null").agg(F.count("*").alias("n")).scalar() == 0
    return rows.withColumn("passes", (F.col("included_by").isNotNull() | all_pass) & F.col("excluded_by").isNull())
