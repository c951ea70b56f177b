"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one
window), a window into shingles of ``SHINGLE`` words.  The shingles are ordered by how
often they occur in all documents, rarest first.  A window that stands in a document has
all its shingles there, so its necessary prefix is its rarest shingle alone: documents
give only occurrences of such prefix shingles, each with the few words around it that a
window can reach.  These meet the windows on the shingle's hash; a pair is dropped when the
window would start before the document or end behind it, and counts only when the words of
the window equal those of the document.

Items are the stated side.  Distinct shingles and windows are broadcast in blocks of fixed
size (``SHINGLES``, ``WINDOWS`` rows of at most ``KEY_BYTES`` bytes), and every block is
held against all documents, so larger benchmarks mean more blocks and not larger
broadcasts.  Documents with the same windows share one look-up of the items.

Defined results: a null or wordless text has no words and no hits; a null or wordless item
has no windows; rows that repeat an item id are one item; items with a null id mark words
but are not listed; repeated document rows are judged one by one and keep their (null) ids;
without documents there are no rows, without items no hits; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import ragged, steps, strings, text_buffers
from siftloom.llm.columns import free_name
from siftloom.llm.registry import query, table
from siftloom.llm.words import gram_hashes, lower_ascii, span_hashes, word_hashes, words_of
from siftloom.operators.skew import attach_per_key, with_positions
from siftloom.session import cut_lineage

WINDOW, SHINGLE = 10, 3
#: Words of the comparison, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of one broadcast block, and bytes of a window above which its SHA-256 stands for it.
SHINGLES, WINDOWS, KEY_BYTES = 2_000_000, 500_000, 200
#: Bytes of text in one vectorised step.
CHUNK = 512 << 10


@functools.cache
def separators() -> np.ndarray:
    """Bytes between words, once A-Z are lower-cased."""
    out = np.zeros(256, bool)
    out[:128] = True
    out[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
    return out


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(words: Column) -> Column:
    """Words joined by blanks; of long words the SHA-256, which no word can begin with ``#``."""
    joined = F.array_join(words, " ")
    return F.when(F.octet_length(joined) <= KEY_BYTES, joined).otherwise(F.concat(F.lit("#"), F.sha2(joined, 256)))


class _Text:
    """Words of a batch of texts and their shingles."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        self.data = lower_ascii(data)
        self.words = words_of(self.data, offsets, separators())
        self.count = np.diff(self.words.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = word_hashes(self.data, self.words)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive words of one text, and each one's first word."""
        h = gram_hashes(self.hash, size)
        at = np.flatnonzero(self.row[: len(h)] == self.row[size - 1:][: len(h)]) if len(h) else np.zeros(0, np.int64)
        return h[at], at


def _windows(items: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, words, len) numbered from 1, and the items of each (window, item)."""
    words = F.regexp_extract_all(lowered(F.col(text)), F.lit(WORD), F.lit(0))
    cut = items.select(F.col(key).cast("string").alias("item"), words.alias("all")).where("size(all) > 0").select(
        "item", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - size, F.lit(0)))).alias("start"))
    cut = cut_lineage(cut.select("item", F.slice("all", F.col("start") + 1, F.lit(size)).alias("words")).distinct())
    distinct = cut_lineage(with_positions(cut.select("words").distinct(), [F.col("words")], "window").withColumn("len", F.size("words")))
    return distinct, distinct.join(cut, "words").where("item is not null").select("window", "item")


def _shingled(windows: DataFrame) -> DataFrame:
    """(window, len, hash, size, pos): the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, length = _Text(batch.column("text")), batch.column("window").to_numpy(), batch.column("len").to_numpy()
            short = np.flatnonzero(length < SHINGLE)
            h, at = text.shingles(SHINGLE)
            first = text.words.first
            h = np.concatenate([h, span_hashes(text.hash, first[short], first[short + 1])])
            at = np.concatenate([at, first[short]])
            row = text.row[at]
            yield pa.RecordBatch.from_pydict({
                "window": pa.array(ids[row]), "len": pa.array(length[row]), "hash": pa.array(h.view(np.int64)),
                "size": pa.array(np.minimum(length[row], SHINGLE)), "pos": pa.array((at - first[row]).astype(np.int32))})

    return windows.select("window", "len", F.array_join("words", " ").alias("text")).mapInArrow(
        run, "window long, len int, hash long, size int, pos int")


def _by_size(rows: pa.Table) -> dict[int, dict[str, np.ndarray]]:
    """Columns of the shingles of each size, sorted by hash."""
    columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
    columns["hash"] = columns["hash"].astype(np.int64).view(np.uint64)
    out = {}
    for size in np.unique(columns["size"]).tolist():
        mine = np.flatnonzero(columns["size"] == size)
        mine = mine[np.argsort(columns["hash"][mine], kind="stable")]
        out[size] = {c: v[mine] for c, v in columns.items()}
    return out


def _found(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the hashes ``h`` that are in the sorted ``known``, and where."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    return hit, at[hit]


def occurrences(docs: DataFrame, text: str, shingles: DataFrame) -> DataFrame:
    """(hash, size, n): how often each of ``shingles`` (hash, size) occurs in all documents."""
    spark = docs.sparkSession
    numbered = cut_lineage(with_positions(shingles.distinct(), [F.col("hash"), F.col("size")]))
    out = []
    for first in range(1, numbered.count() + 1, SHINGLES):
        block = numbered.where(F.col("position").between(first, first + SHINGLES - 1)).select("hash", "size")
        sent = spark.sparkContext.broadcast(_by_size(block.toArrow()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            n = {size: np.zeros(len(k["hash"]), np.int64) for size, k in known.items()}
            for whole in batches:
                for batch in steps(whole, text, CHUNK):
                    words = _Text(batch.column(text))
                    for size, k in known.items():
                        _, at = _found(k["hash"], words.shingles(size)[0])
                        n[size] += np.bincount(at, minlength=len(n[size]))
            for size, k in known.items():
                seen = np.flatnonzero(n[size])
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(k["hash"][seen].view(np.int64)), "size": pa.array(np.full(len(seen), size, np.int32)), "n": pa.array(n[size][seen])})

        out.append(docs.select(text).mapInArrow(run, "hash long, size int, n long"))
    if not out:
        return shingles.select("hash", "size", F.lit(0).cast("long").alias("n")).limit(0)
    return functools.reduce(DataFrame.unionByName, out).groupBy("hash", "size").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(window, len, hash, size, pos): the rarest shingle of each window that may occur."""
    cut = cut_lineage(_shingled(windows))
    counts = cut_lineage(occurrences(docs, text, cut.select("hash", "size")))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "pos")
    rarest = cut.join(counts, ["hash", "size"], "left").groupBy("window", "len", "size").agg(F.min(rarity).alias("_r"))
    return rarest.where("_r.n > 0").select("window", "len", "size", "_r.hash", "_r.pos")


def _candidates(docs: DataFrame, key: str, text: str, reach: list) -> DataFrame:
    """Per document: key, n_words and its prefix shingles with the words that windows can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text, CHUNK):
                words = _Text(batch.column(text))
                n, first = words.count, words.words.first
                width = words.words.end - words.words.start + 1
                packed = np.append(words.data, np.uint8(32))[ragged(words.words.start, width)]
                begin = np.concatenate([[0], np.cumsum(width)])
                packed[begin[1:] - 1] = 32
                columns = []
                for block, sent in enumerate(reach):
                    for size, k in sent.value.items():
                        h, at = words.shingles(size)
                        hit, which = _found(k["hash"], h)
                        at = at[hit]
                        row = words.row[at]
                        q = at - first[row]
                        # length and positional bounds: some window of this prefix fits here
                        fits = (q >= k["least"][which]) & (n[row] - q >= k["rest"][which])
                        at, which, row, q = at[fits], which[fits], row[fits], q[fits]
                        a = np.maximum(first[row], at - k["lead"][which])
                        z = np.minimum(first[row + 1], at + k["tail"][which])
                        columns.append((row, np.full(len(row), block), k["hash"][which], np.full(len(row), size), q, a, z))
                row, block, h, size, q, a, z = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else [np.zeros(0, np.int64)] * 7
                order = np.argsort(row, kind="stable")
                row, block, h, size, q, a, z = (x[order] for x in (row, block, h, size, q, a, z))
                length = begin[z] - begin[a] - 1
                near = strings(packed[ragged(begin[a], length)], np.concatenate([[0], np.cumsum(length)]))
                ints = [pa.array(x.astype(np.int32)) for x in (block, size, q, a - first[row])]
                one = pa.StructArray.from_arrays([ints[0], pa.array(h.astype(np.uint64).view(np.int64)), *ints[1:], near], ["block", "hash", "size", "q", "start", "near"])
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key), "n_words": pa.array(n.astype(np.int64)),
                    "found": pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)), one)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_words long, found array<struct<block:int,hash:long,size:int,q:int,start:int,near:string>>")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, spans (word ranges from..to of items' windows) and items (ids as sorted strings)."""
    docs = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    windows, listed = _windows(items, item_key, item_text, size)
    chosen = cut_lineage(prefixes(windows, docs, "_text").join(windows.select("window", _key(F.col("words")).alias("words")), "window"))
    blocks = [(first, first + WINDOWS - 1) for first in range(1, windows.count() + 1, WINDOWS)]
    reach = []
    for low, high in blocks:
        met = chosen.where(F.col("window").between(low, high)).groupBy("hash", "size").agg(
            F.min("pos").alias("least"), F.max("pos").alias("lead"),
            F.min(F.col("len") - F.col("pos")).alias("rest"), F.max(F.col("len") - F.col("pos")).alias("tail"))
        reach.append(docs.sparkSession.sparkContext.broadcast(_by_size(met.toArrow())))
    scanned = cut_lineage(_candidates(docs, "_doc", "_text", reach)).withColumn("_row", F.monotonically_increasing_id())
    near = scanned.select("_row", "n_words", F.explode("found").alias("f")).select("_row", "n_words", "f.*")
    start = F.col("q") - F.col("pos")
    same = _key(F.slice(F.split("near", " "), start - F.col("start") + 1, F.col("len"))) == F.col("words")
    hits = [
        near.where(F.col("block") == number).join(F.broadcast(chosen.where(F.col("window").between(low, high))), ["hash", "size"])
        .where((start >= 0) & (start + F.col("len") <= F.col("n_words"))).where(same)
        .select("_row", start.alias("from"), (start + F.col("len")).alias("to"), "window")
        for number, (low, high) in enumerate(blocks)]
    rows = scanned.select(F.col("_doc").alias(key), "n_words", "_row")
    spans = "array<struct<from:int,to:int>>"
    if not hits:
        return rows.select(key, "n_words", F.lit(None).cast(spans).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    found = functools.reduce(DataFrame.unionByName, hits).groupBy("_row").agg(
        F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"), F.sort_array(F.collect_set("window")).alias("windows"))
    found = cut_lineage(found.withColumn("_set", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256)))
    sets = found.groupBy("_set").agg(F.first("windows").alias("windows"), F.count("*").alias("_n"))
    named = sets.select("_set", "_n", F.explode("windows").alias("window")).join(listed, "window").groupBy("_set", "_n").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    found = attach_per_key(found.select("_row", "spans", "_set"), named, ["_set"], ["_row"], hot_rows=100_000)
    return rows.join(found, "_row", "left").select(key, "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["to"] - F.greatest(s["from"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["to"]).alias("end"))
    return F.coalesce(F.aggregate(spans, start, step)["n"], F.lit(0).cast("long"))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **of_items) -> DataFrame:
    """Rows of ``docs``, all columns, whose id has no row with a hit."""
    name = free_name(docs, "hit_id")
    hit = contamination(docs.select(key, text), items, key, text, **of_items).where("size(spans) > 0").select(F.col(key).alias(name)).distinct()
    return docs.join(hit, F.col(key).eqNullSafe(F.col(name)), "left_anti")


@query("op13_benchmark_decontamination", f"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
cut AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[s + 1 : s + 10] AS win FROM cut),
doc_words AS (SELECT doc_id, row_number() OVER () AS rid,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
doc_cut AS (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS s FROM doc_words, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT d.rid, d.s, d.n, i.item_id FROM (SELECT rid, s, n, w[s + 1 : s + n] AS win FROM doc_cut) d JOIN windows i ON d.win = i.win),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
""")
def op13(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit, items = covered(F.col("spans")), F.coalesce("items", F.array())
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
