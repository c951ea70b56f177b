"""Suffix-array dedup over bytes, with the linear grouping construction.

The array is built in two passes.  The first sorts suffixes into groups of equal Lyndon
prefix: groups are processed in descending order, every suffix of a group finds its
previous smaller suffix (the nearest one to the left whose group is lower), and suffixes
that are pointed to leave their group for a new one just above it.  The second emits the
order of all groups at once: in ascending order, each placed suffix lets the chain of
suffixes to its left, along the same pointers, take the next places of their groups.
Nothing is renamed or sorted recursively.

Documents are not joined into one text: runs of windows that can be equal meet in buckets
(see ``overlaps``), and a suffix array is built over those that overlap in part; windows
of neighbouring suffixes with a common prefix of 50 bytes are equal.

Defined results: a null text is empty; texts under 50 bytes have no window; windows
within one document, or in rows with the same id, do not count against each other; a null
id counts as the largest; repeated rows are judged one by one; an empty table gives no
rows; the query reads no other columns, the filter keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import ragged
from siftloom.llm.columns import apart
from siftloom.llm.registry import query, table
from siftloom.llm.overlaps import repeated
from siftloom.llm.repeats import BYTES, Units, group_count, merged_runs
from siftloom.llm.words import gram_hashes

#: Bytes of overlapping strings in one suffix array; strings of one minimiser stay together.
ARRAY_BYTES = 200_000


def _lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, previous smaller suffix of each (-1: none), and the groups in ascending order."""
    n = len(text)
    symbols = sorted(set(text))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [*range(1, len(symbols)), -1]
    below = [*range(-1, len(symbols) - 1)]
    left = list(range(-1, n - 1))  # nearest suffix to the left that may be unprocessed
    done = bytearray(n)
    smaller = [-1] * n
    g = len(symbols) - 1
    while g >= 0:
        inside = [i for i in members[g] if group[i] == g]
        members[g] = inside
        for i in inside:
            done[i] = 1
        seen: dict[int, int] = {}
        for i in inside:
            j = left[i]
            if j >= 0 and done[j]:
                k = left[j]
                while k >= 0 and done[k]:
                    k = left[k]
                while j != k:  # shorten the path
                    left[j], j = k, left[j]
                left[i] = j
            smaller[i] = j
            if j >= 0:
                seen[j] = seen.get(j, 0) + 1
        if seen:
            new: dict[tuple[int, int], int] = {}
            # more repetitions of this group's prefix are larger: they are put up first
            order = seen if len(seen) == len(inside) else sorted(seen, key=seen.__getitem__, reverse=True)
            for j in order:
                old = group[j]
                place = (seen[j], old)
                fresh = new.get(place)
                if fresh is None:
                    fresh = new[place] = len(members)
                    members.append([])
                    up = above[old]
                    above[old] = fresh
                    above.append(up)
                    below.append(old)
                    if up >= 0:
                        below[up] = fresh
                group[j] = fresh
                members[fresh].append(j)
        g = below[g]
    ascending, g = [], 0
    while g >= 0:
        if members[g]:
            ascending.append(g)
        g = above[g]
    return group, smaller, ascending


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffixes of a text of integers in ascending order."""
    if not len(text):
        return []
    group, smaller, ascending = _lyndon_groups(text)
    size: dict[int, int] = dict.fromkeys(ascending, 0)
    for g in group:
        size[g] += 1
    free, at = {}, 0
    for g in ascending:
        free[g] = at
        at += size[g]
    out = [-1] * len(text)
    placed = bytearray(len(text))
    j = len(text) - 1  # the chain of the empty suffix comes first
    at = 0
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
        if at == len(text):
            return out
        j = out[at] - 1
        at += 1


def _equal_windows(packed: list[bytes], window: int) -> Iterator[list[tuple[int, int]]]:
    """Sets of equal windows (string, start) of different strings, from neighbours in the suffix array."""
    body = b"\0".join(packed)
    data = np.frombuffer(body, np.uint8).astype(np.int64) + len(packed)
    starts = np.cumsum([0, *[len(s) + 1 for s in packed]])
    data[starts[1:-1] - 1] = np.arange(len(packed) - 1)  # separators differ, so no match crosses them
    order = np.array(suffix_array(data.tolist()))
    row = np.searchsorted(starts, order, side="right") - 1
    ok = order + window <= starts[row + 1] - 1
    order, row = order[ok].tolist(), row[ok].tolist()
    same, last = [], None
    for p, r in zip(order, row, strict=True):
        here = body[p: p + window]
        if here != last:
            if len(same) > 1:
                yield same
            same, last = [], here
        same.append((r, p - int(starts[r])))
    if len(same) > 1:
        yield same


def _runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags within rows (``first``: start of each row): row, from, to."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[first] = True
    pad = np.concatenate([[False], flags, [False]])
    a = np.flatnonzero(pad[1:-1] & (~pad[:-2] | edge[:-1]))
    z = np.flatnonzero(pad[1:-1] & (~pad[2:] | edge[1:]))
    row = np.searchsorted(first, a, side="right") - 1
    return row, a - first[row], z - first[row]


def group_suffixes(m: np.ndarray, packed: list[bytes], first: np.ndarray, units: Units) -> Iterator[tuple[int, int, int, int]]:
    """(string, from, to, least id) for the windows of each string; strings come ordered by minimiser.

    Windows that no other string has keep their own id.  Runs of the others are cut out;
    equal cuts are one, and what still overlaps in part is settled by a suffix array.
    """
    if not packed:
        return
    w = units.window
    sizes = np.fromiter(map(len, packed), np.int64, len(packed))
    windows = sizes - w + 1
    data = np.frombuffer(b"".join(packed), np.uint8)
    at = ragged(np.cumsum(sizes) - sizes, windows)
    hashes = gram_hashes(data, w)[at]
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    begin = np.cumsum(windows) - windows
    shared = count[inverse] > 1
    row, a, z = _runs(~shared, np.append(begin, len(shared)))
    for i, x, y in zip(row.tolist(), a.tolist(), z.tolist(), strict=True):
        yield i, x, y, int(first[i])
    row, a, z = _runs(shared, np.append(begin, len(shared)))
    cuts: dict[tuple[int, bytes], list] = {}
    for i, x, y in zip(row.tolist(), a.tolist(), z.tolist(), strict=True):
        cuts.setdefault((int(m[i]), packed[i][x: y + w]), []).append((i, x))
    names = list(cuts)
    least = [min(int(first[i]) for i, _ in cuts[k]) for k in names]
    # which cuts still share a window with another cut
    texts = [s for _, s in names]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), w)[ragged(np.cumsum(sizes) - sizes, sizes - w + 1)]
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(texts)), sizes - w + 1)
    partial = np.zeros(len(texts), bool)
    partial[owner[count[inverse] > 1]] = True
    ids = [[v] * int(n - w + 1) for v, n in zip(least, sizes, strict=True)]
    batch, held, last = [], 0, None
    todo = np.flatnonzero(partial).tolist()

    def settle(batch: list[int]) -> None:
        for same in _equal_windows([texts[k] for k in batch], w):
            low = min(least[batch[r]] for r, _ in same)
            for r, j in same:
                ids[batch[r]][j] = low

    for k in todo:
        if held > ARRAY_BYTES and names[k][0] != last:
            settle(batch)
            batch, held = [], 0
        batch.append(k)
        held, last = held + len(texts[k]), names[k][0]
    if batch:
        settle(batch)
    for k, values in zip(names, ids, strict=True):
        for x, y, value in merged_runs(values):
            for i, start in cuts[k]:
                yield i, start + x, start + y, value


def _kept(flags: np.ndarray) -> tuple[np.ndarray, int]:
    """Borders of the kept runs (from, to, from, ...) and the number of removed runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], flags, [True]]).astype(np.int8)))
    gone = int((np.diff(np.concatenate([[False], flags]).astype(np.int8)) == 1).sum())
    return edge, gone


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256."""

    def make(rows, parts):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for part, gone, _, n in parts:
            for i in range(n):
                a, z = part.first[i], part.first[i + 1]
                edge, spans = _kept(gone[a:z])
                kept = b"".join([part.data[a + x: a + y].tobytes() for x, y in zip(edge[::2], edge[1::2], strict=True)])
                for name, value in zip(out, (int(z - a), int(z - a) - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[name].append(value)
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.table({key: rows.column(key)} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    columns = [key, text]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeated(docs.select(*columns), BYTES, group_suffixes, key, text, group_count(docs, text), columns, schema, make)


def dedup_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with the repeated bytes cut out of their text.

    All columns and rows stay; ``length`` (if it is a column) gets the characters left.  A
    character of which only some bytes are covered is cut whole.
    """
    docs, own, back = apart(docs)
    key, text, length = own[key], own[text], own.get(length)
    names = docs.columns
    docs = docs.withColumn(text, F.coalesce(text, F.lit("")))

    def make(rows, parts):
        texts = []
        for part, gone, _, n in parts:
            for i in range(n):
                a, z = part.first[i], part.first[i + 1]
                edge, _ = _kept(gone[a:z])
                texts.append("".join([part.data[a + x: a + y].tobytes().decode(errors="ignore") for x, y in zip(edge[::2], edge[1::2], strict=True)]))
        out = {c: rows.column(c) for c in names} | {text: pa.array(texts, pa.string())}
        if length in names:
            out[length] = pa.array(map(len, texts), rows.schema.field(length).type)
        return pa.table(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return back(repeated(docs, BYTES, group_suffixes, key, text, group_count(docs, text), names, schema, make))


@query("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dedup_digests(docs)
