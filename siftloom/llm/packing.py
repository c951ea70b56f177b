"""Packing of tokenised documents into windows by best fit, longest pieces first.

A document is its ids and an end id.  Documents of a window or more are first cut into
full windows, and what remains is one shorter piece.  Remainders are dealt at random to
groups of about ``GROUP_TOKENS`` tokens, and every group is packed by itself, so a task's
work is bounded whatever the corpus; a group leaves at most a few windows half empty.
Within a group a segment tree over remaining capacities finds the tightest open window.

Defined results: a null or empty text is the end id alone; repeated rows and equal ids
are packed one by one; ties in length keep the order of the written rows; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import steps, text_buffers
from siftloom.llm.byte_bpe import byte_table
from siftloom.llm.pretokens import LETTER, NUMBER, OTHER, TOKEN_BYTES, Memo, character_classes, encode_texts
from siftloom.llm.registry import query, table
from siftloom.session import cut_lineage

WINDOW = 4096
END_ID = 2
GROUP_TOKENS = 8_000_000
#: First sequence id of the full windows; packed windows are numbered below it.
FULL = 1 << 61

# up to here no character combines with another, so the normal form changes nothing
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


class WordBpe:
    """Encoder of one tokenizer file with lower-casing, white-space-dropping words.

    Texts that hold the string of an added token, which the library matches before
    anything else, are left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.spell = byte_table()
        self.memo = Memo(self._encode)
        self.table = character_classes().copy()
        cut = self.library.pre_tokenizer.pre_tokenize_str
        for i in np.flatnonzero(self.table).tolist():
            if unicodedata.category(c := chr(i)) == "Cn":  # too new for some libraries' tables: ask this one
                self.table[i] = LETTER if len(cut("a" + c)) == 1 else NUMBER if len(cut(c + c)) == 2 else OTHER

    def _encode(self, words: list[str]) -> list[list[int]]:
        # the words are normalised and cut already, so only the model is left to run
        spell, tokenize = self.spell, self.library.model.tokenize
        return [[t.id for t in tokenize("".join([spell[b] for b in w.encode()]))] for w in words]

    def normal(self, text: str) -> str:
        if text.isascii() or not _BEYOND_LATIN.search(text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the index of each text's first id."""
        whole = [t or "" for t in column.to_pylist()]
        special = [i for i, t in enumerate(whole) if any(a in t.lower() for a in self.added)]
        taken = {i: self.library.encode(whole[i], add_special_tokens=False).ids for i in special}
        texts = pa.array(["" if i in taken else self.normal(t) for i, t in enumerate(whole)], pa.string())
        ids, first = encode_texts(*text_buffers(texts), False, self.memo, self.table)
        if taken:
            sizes = np.diff(first)
            ids = np.insert(ids, np.repeat(first[special], [len(taken[i]) for i in special]), [x for i in special for x in taken[i]])
            sizes[special] = [len(taken[i]) for i in special]
            first = np.concatenate([[0], np.cumsum(sizes)])
        return ids, first


@functools.cache
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
           window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for whole in batches:
            for batch in steps(whole, text, TOKEN_BYTES):
                ids, first = bpe.encode(batch.column(text))
                ids = np.insert(ids.astype("<u4"), first[1:], END_ID)
                first = first + np.arange(len(first))
                sizes = np.diff(first)
                count = -(-sizes // window)
                row = np.repeat(np.arange(len(sizes)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(sizes[row] - start, window)
                at = first[row] + start
                parts = [ids[a: a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                out = {
                    key: batch.column(key).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                    "doc_tokens": pa.array(sizes[row]),
                }
                if with_ids:
                    out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    more = ", ids array<int>" if with_ids else ""
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long{more}")


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.windows[capacity].append(number)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, number) of the window with the least capacity of at least ``need``."""
        count, node = self.count, need + self.leaves
        while not count[node]:
            while node & 1:  # a right child: nothing larger below this parent
                node >>= 1
            if not node:
                return None
            node += 1
            if node == self.leaves * 2 or not node & (node - 1):
                return None
        while node < self.leaves:
            node = 2 * node + (not count[2 * node])
        capacity = node - self.leaves
        number = self.windows[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, number


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece: longest pieces first, each to the tightest window."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, made = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = open_.take(n)
        if found is None:
            found, made = (window, made), made + 1
        capacity, at = found
        number[i], offset[i] = at, window - capacity
        if capacity > n:
            open_.add(capacity - n, at)
    return number, offset


def pack(rows: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, whose ``length`` is at most ``window``."""
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    names = [c for c in rows.columns if c != "_row"]
    total = rows.where(F.col("length") < window).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    groups = -(-total // group_tokens) or 1
    full = rows.where(F.col("length") == window).select(
        *names, (F.lit(FULL) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row").combine_chunks()
        number, offset = best_fit(group.column("length").to_numpy(), window)
        number += group.column("_group")[0].as_py() << 32
        return group.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    rest = rows.where(F.col("length") < window).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_row")
    packed = rest.groupBy("_group").applyInArrow(fill, f"{schema}, sequence_id long, offset long")
    return packed.unionByName(full)


@query("op6_packing")
def op6(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
