"""Substring dedup over words: super-k-mers dealt to buckets by their minimiser.

Consecutive 50-word windows that share a minimiser travel as one packed string (their
words, joined by blanks) to the minimiser's bucket.  There the windows of the different
strings are sorted, equal neighbours take the least document id, and a word goes if a
window over it also starts in a document with a smaller id.

Defined results: a null or blank text has no words; texts under 50 words have no window;
windows within one document, or in rows with the same id, do not count against each
other; a null id counts as the largest; repeated rows are judged one by one; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.registry import query, table
from siftloom.llm.repeats import WORDS, Units, apply_hits, group_count, merged_runs, repeated


def sort_windows(m: np.ndarray, packed: list[bytes], first: np.ndarray, units: Units) -> Iterator[tuple[int, int, int, int]]:
    """(string, from, to, least id) for the windows of each string; strings come ordered by minimiser."""
    edges = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]])) if len(m) else [0]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        cut = []  # (window, string, number)
        counts = {}
        for i in range(a, z):
            text = packed[i]
            starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1]).tolist()
            counts[i] = len(starts) - units.window + 1
            if z - a > 1:
                ends = [s - 1 for s in starts[1:]] + [len(text)]
                cut += [(text[starts[j]: ends[j + units.window - 1]], i, j) for j in range(counts[i])]
        least = {i: [int(first[i])] * n for i, n in counts.items()}
        cut.sort()
        for _, same in groupby(cut, key=lambda x: x[0]):
            same = list(same)
            if len(same) > 1:
                low = min(int(first[i]) for _, i, _ in same)
                for _, i, j in same:
                    least[i][j] = low
        for i, values in least.items():
            for x, y, value in merged_runs(values):
                yield i, x, y, value


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_removed and kept_sha256."""

    def make(rows, parts):
        words, removed, digests = [], [], []
        for part, gone, _, n in parts:
            for i in range(n):
                a, z = part.first[i], part.first[i + 1]
                flags = gone[a:z]
                words.append(int(z - a))
                removed.append(int(flags.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[True], flags, [True]]).astype(np.int8)))
                kept = [part.data[part.start[a + x]: part.end[a + y - 1]].tobytes() for x, y in zip(edge[::2], edge[1::2], strict=True)]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({key: rows.column(key), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "kept_sha256": pa.array(digests, pa.string())})

    columns = [key, text]
    blobs, hits = repeated(docs.select(*columns), WORDS, sort_windows, key, text, group_count(docs, text), columns)
    kind = docs.schema[key].dataType.simpleString()
    return apply_hits(blobs, hits, WORDS, key, text, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string", make)


@query("op4_substring_dedup")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dedup_digests(docs)
