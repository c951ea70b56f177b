"""Windows of one document that also start in a document with a smaller id, for any unit.

Units are bytes or words.  All steps are shuffles of bounded pieces:

1. Documents are dealt at random to groups of about ``GROUP_BYTES``; a group travels as
   compressed Arrow blobs.
2. Each window of ``window`` units has a minimiser, its least ``gram``-unit hash.
   Consecutive windows with one minimiser form a run.  A group sends the distinct
   minimisers of its runs, sorted and cut by bucket, so even the most frequent one is sent
   once per group.  A bucket answers each group with a bit for each minimiser: seen in
   another group or not.
3. Runs whose minimiser is met in two documents are written out as packed strings: the
   text of all their windows.  No other run can hold a repeated window.
4. Equal strings are aggregated to their least document id.  Strings with one minimiser
   meet in a bucket, where ``resolve`` finds for each window the least document id that
   any string gives it.  A minimiser with more than ``HOT`` different strings is first
   cut into strings of one window, with the window's own hash as minimiser.
5. Each occurrence is joined to its string's windows; those with a smaller id go back to
   the document's group, which removes the covered units.

Filters use 64-bit hashes only to leave out work; equality of strings is equality of bytes.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import ragged, strings, text_buffers
from siftloom.llm.words import Words, blanks, gram_hashes, word_hashes, words_of
from siftloom.session import cut_lineage

#: (bounds the memory of a task; larger groups send fewer, longer messages)
GROUP_BYTES = 6 << 20
#: Bytes of text that one vectorised step works on.
CHUNK = 512 << 10
#: Different strings of one minimiser that a bucket may gather.
HOT = 5000


class Text(NamedTuple):
    """Texts of a step: unit values, first unit of each text, and unit positions in ``data``."""

    values: np.ndarray
    first: np.ndarray
    data: np.ndarray
    start: np.ndarray  # byte of unit i in data; start[i] to end[i]
    end: np.ndarray


class Units(NamedTuple):
    name: str
    window: int
    gram: int
    cut: Callable[[np.ndarray, np.ndarray], Text]


def bytes_of(data: np.ndarray, offsets: np.ndarray) -> Text:
    at = np.arange(len(data))
    return Text(data, offsets, data, at, at + 1)


def joined_words(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in order with a blank after each; start and end of each word there."""
    size = words.end - words.start
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[ragged(start, size)] = data[ragged(words.start, size)]
    return out, start, start + size


def words_joined(data: np.ndarray, offsets: np.ndarray) -> Text:
    words = words_of(data, offsets, blanks())
    values = word_hashes(data, words)
    out, start, end = joined_words(data, words)
    return Text(values, words.first, out, start, end)


BYTES = Units("bytes", 50, 20, bytes_of)
WORDS = Units("words", 50, 10, words_joined)


class Runs(NamedTuple):
    row: np.ndarray  # text of the run
    first: np.ndarray  # its first window, as a unit index of the step
    size: np.ndarray  # windows in it
    key: np.ndarray  # hash of the minimiser


def runs_of(text: Text, units: Units) -> Runs:
    """Runs of windows with one minimiser, in order."""
    width = units.window - units.gram + 1
    windows = np.maximum(np.diff(text.first) - units.window + 1, 0)
    if not windows.sum():
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    grams = gram_hashes(text.values, units.gram)
    # hash above, position below: the least value is the leftmost least hash
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span:])
    valid = ragged(text.first[:-1][windows > 0], windows[windows > 0])
    at = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    return Runs(np.searchsorted(text.first, valid[new], side="right") - 1, valid[new],
                np.diff(np.append(new, len(valid))), grams[at[new]])


def _codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above, 40 bits of the hash below."""
    return ((keys & np.uint64(0xFFFFFF)) % np.uint64(buckets)) << np.uint64(40) | keys >> np.uint64(24)


def packed(docs: DataFrame, groups: int, columns: list[str]) -> DataFrame:
    """Rows (``_g``, ``blob``): the columns of the documents of a group, as compressed Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("_g").to_numpy()
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            body = batch.select(columns)
            numbers, blobs = [], []
            for part in np.split(order, cuts):
                if len(part):
                    sink = io.BytesIO()
                    with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                        out.write_batch(body.take(pa.array(part)))
                    numbers.append(int(group[part[0]]))
                    blobs.append(sink.getvalue())
            yield pa.RecordBatch.from_pydict({"_g": pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    # a row number would differ between two reads, so the whole row decides its group
    spread = F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")
    return docs.select(*columns, spread.alias("_g")).mapInArrow(run, "_g int, blob binary")


def unpacked(group: pa.Table, key: str, text: str) -> pa.Table:
    """Documents of a group in an order that depends only on the rows."""
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in group.column("blob").combine_chunks()] if len(group) else []
    rows = pa.concat_tables(parts)
    order = pa.compute.sort_indices(rows.select([key, text]), sort_keys=[(key, "ascending"), (text, "ascending")])
    return rows.take(order).combine_chunks()


def chunks(rows: pa.Table, text: str, units: Units) -> Iterator[tuple[int, Text]]:
    """(first row, units) of slices of the group's texts."""
    data, offsets = text_buffers(rows.column(text)) if len(rows) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, units.cut(data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at])
        at = end


def _keyed(rows: pa.Table, key: str, text: str, units: Units, buckets: int):
    """Codes of all runs of a group with their document ids, and the pieces they come from."""
    ids = rows.column(key).to_numpy(zero_copy_only=False) if rows.column(key).null_count == 0 else None
    ids = ids if ids is not None else pa.compute.fill_null(rows.column(key), NULL_ID).to_numpy()
    codes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, part in chunks(rows, text, units):
        runs = runs_of(part, units)
        codes.append(_codes(runs.key, buckets))
        docs.append(ids[at + runs.row].astype(np.int64))
    return np.concatenate(codes), np.concatenate(docs), ids


#: A null id counts as larger than any other.
NULL_ID = (1 << 63) - 1


def occurrences(blobs: DataFrame, key: str, text: str, units: Units, buckets: int) -> DataFrame:
    """Packed strings of the runs whose minimiser is met in two documents.

    Columns: m (minimiser), s (string), doc, _g, row (in the group), pos (first window in the document).
    """

    def sent(group: pa.Table) -> pa.Table:
        rows = unpacked(group, key, text)
        codes, _, _ = _keyed(rows, key, text, units, buckets)
        codes = np.unique(codes)
        bucket = (codes >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(codes) else np.zeros(0, np.int64)
        low = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)
        return pa.table({"b": pa.array(bucket[first].astype(np.int32)), "_g": pa.array(np.full(len(first), group.column("_g")[0].as_py(), np.int32)),
                         "keys": strings(low, np.append(first, len(codes)) * 5, pa.binary())})

    def answered(bucket: pa.Table) -> pa.Table:
        keys = bucket.column("keys").combine_chunks()
        raw, offsets = _binary(keys)
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = raw.reshape(-1, 5)
        values = wide.reshape(-1).view("<u8")
        _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        cuts = offsets // 5
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"_g": bucket.column("_g"), "b": bucket.column("b"), "bits": pa.array(bits, pa.binary()),
                         "n": pa.array(np.diff(cuts).astype(np.int32))})

    def found(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return pa.table(_EMPTY)
        rows = unpacked(group, key, text)
        codes, docs, ids = _keyed(rows, key, text, units, buckets)
        distinct, inverse = np.unique(codes, return_inverse=True)
        answers = answers.sort_by("b")
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist(), strict=True)]
        wanted = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
        low, high = np.full(len(distinct), NULL_ID, np.int64), np.full(len(distinct), -NULL_ID, np.int64)
        np.minimum.at(low, inverse, docs)
        np.maximum.at(high, inverse, docs)
        take = (wanted | (low < high))[inverse]
        out, done = [], 0
        number = group.column("_g")[0].as_py()
        for at, part in chunks(rows, text, units):
            runs = runs_of(part, units)
            n = len(runs.key)
            pick = np.flatnonzero(take[done: done + n])
            a, z = part.start[runs.first[pick]], part.end[runs.first[pick] + runs.size[pick] + units.window - 2] if len(pick) else np.zeros(0, np.int64)
            body = part.data[ragged(a, z - a)] if len(pick) else np.zeros(0, np.uint8)
            row = runs.row[pick]
            out.append(pa.table({
                "m": pa.array(codes[done: done + n][pick].view(np.int64)), "s": strings(body, np.concatenate([[0], np.cumsum(z - a)]), pa.binary()),
                "doc": pa.array(ids[at + row].astype(np.int64)), "_g": pa.array(np.full(len(row), number, np.int32)),
                "row": pa.array((at + row).astype(np.int32)), "pos": pa.array(runs.first[pick] - part.first[row])}))
            done += n
        return pa.concat_tables(out)

    keys = blobs.groupBy("_g").applyInArrow(sent, "b int, _g int, keys binary")
    answers = keys.groupBy("b").applyInArrow(answered, "_g int, b int, bits binary, n int")
    return blobs.groupBy("_g").cogroup(answers.groupBy("_g")).applyInArrow(found, _SCHEMA)


_SCHEMA = "m long, s binary, doc long, _g int, row int, pos long"
_EMPTY = {"m": pa.array([], pa.int64()), "s": pa.array([], pa.binary()), "doc": pa.array([], pa.int64()),
          "_g": pa.array([], pa.int32()), "row": pa.array([], pa.int32()), "pos": pa.array([], pa.int64())}


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _single_windows(rows: DataFrame, units: Units) -> DataFrame:
    """Each packed string cut into its windows, each with its own hash as minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                text = units.cut(*_binary(batch.column("s")))
                size = np.diff(text.first) - units.window + 1
                first = ragged(text.first[:-1], size)
                row = np.repeat(np.arange(len(size)), size)
                a, z = text.start[first], text.end[first + units.window - 1]
                own = {k: batch.column(k).take(pa.array(row)) for k in ("doc", "_g", "row")}
                pos = batch.column("pos").to_numpy()[row] + first - text.first[row]
                key = gram_hashes(text.values, units.window)[first].view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "m": pa.array(key), "s": strings(text.data[ragged(a, z - a)], np.concatenate([[0], np.cumsum(z - a)]), pa.binary()),
                    **own, "pos": pa.array(pos)})

    return rows.mapInArrow(run, _SCHEMA)


def merged_runs(least: list[int]) -> Iterator[tuple[int, int, int]]:
    """(from, to, value) of the runs of equal values."""
    at = 0
    for value, run in groupby(least):
        n = sum(1 for _ in run)
        yield at, at + n - 1, value
        at += n


Resolve = Callable[[np.ndarray, list, np.ndarray, Units], Iterator[tuple[int, int, int, int]]]


def repeated(docs: DataFrame, units: Units, resolve: Resolve, key: str, text: str, groups: int, columns: list[str], hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(blobs, hits): the packed groups, and the windows of their rows that a smaller id has too.

    ``hits`` has _g, row, a, z: windows a to z (inclusive, counted in the document).
    ``resolve(m, strings, first, units)`` gets the different strings of a bucket with
    their least ids and yields (string, from, to, id) for runs of windows of a string.
    """
    blobs = packed(docs, groups, columns)
    found = cut_lineage(occurrences(blobs, key, text, units, groups).withColumn("sid", F.xxhash64("s")), "zstd")
    # written, so the planner knows its size: few such minimisers are broadcast and the strings stay where they are
    many = cut_lineage(found.select("m", "sid").distinct().groupBy("m").count().where(F.col("count") > hot).select("m"))
    split = _single_windows(found.join(many, "m", "left_semi").drop("sid"), units).withColumn("sid", F.xxhash64("s"))
    found = found.join(many, "m", "left_anti").unionByName(split)
    different = found.groupBy("m", "sid", "s").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))

    def settle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("m", "ascending"), ("s", "ascending")]).combine_chunks()
        m = bucket.column("m").to_numpy()
        runs = list(resolve(m, bucket.column("s").to_pylist(), bucket.column("first").to_numpy(), units))
        at, a, z, least = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ([], [], [], [])))
        use = least < bucket.column("last").to_numpy()[at]
        at = pa.array(at[use])
        return pa.table({"m": bucket.column("m").take(at), "sid": bucket.column("sid").take(at), "a": pa.array(a[use]),
                         "z": pa.array(z[use]), "least": pa.array(least[use])})

    windows = (different.withColumn("_b", F.pmod(F.xxhash64("m"), F.lit(groups)))
               .groupBy("_b").applyInArrow(settle, "m long, sid long, a long, z long, least long"))
    hits = (found.select("m", "sid", "doc", "_g", "row", "pos").join(windows, ["m", "sid"])
            .where(F.col("least") < F.col("doc"))
            .select("_g", "row", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("z")).alias("z")))
    return blobs, hits


def apply_hits(blobs: DataFrame, hits: DataFrame, units: Units, key: str, text: str, schema: str,
               make: Callable[[pa.Table, Iterator[tuple[Text, np.ndarray, int, int]]], pa.Table]) -> DataFrame:
    """``make(rows, parts)`` for each group; ``parts`` gives (units, removed flags, first row, rows) of slices."""

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        rows = unpacked(group, key, text)
        row, a, z = (found.column(c).to_numpy() for c in ("row", "a", "z"))
        order = np.argsort(row, kind="stable")
        row, a, z = row[order], a[order], z[order]

        def parts():
            for at, part in chunks(rows, text, units):
                n = len(part.first) - 1
                lo, hi = np.searchsorted(row, [at, at + n])
                change = np.zeros(len(part.values) + 1, np.int64)
                base = part.first[row[lo:hi] - at]
                np.add.at(change, base + a[lo:hi], 1)
                np.add.at(change, base + z[lo:hi] + units.window, -1)
                yield part, np.cumsum(change[:-1]) > 0, at, n

        return make(rows, parts())

    return blobs.groupBy("_g").cogroup(hits.groupBy("_g")).applyInArrow(run, schema)


def group_count(docs: DataFrame, text: str, group_bytes: int = GROUP_BYTES) -> int:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    return max(1, -(-total // group_bytes))
