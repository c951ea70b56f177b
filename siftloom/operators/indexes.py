"""Kept indexes of catalog columns: digests of key ranges, and posting lists of trigrams.

Both are tables in folders that a later job reads in part: a reconciliation descends the
digests of two sides and reads only ranges that differ, a search reads only the lists of
the grams it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import files as FN

#: Key ranges are the leading bits of a key's hash: ranges of the top level, and leaves below one range.
TOP_BITS, LEAF_BITS = 6, 10
#: Partitions of a posting table.
LIST_PARTS = 64
#: Rows of a unit as bits of their number, units of a block, and bytes of values that one list may come from.
UNIT_BITS, BLOCK_UNITS, PIECE_BYTES = 4, 4096, 32 << 20


# --- reconciliation by digests -------------------------------------------------


def _range(key: Column) -> tuple[Column, Column]:
    """(top range, leaf) of a key."""
    h = F.xxhash64(key)
    leaf = F.shiftrightunsigned(h, 64 - TOP_BITS - LEAF_BITS).cast("int")
    return F.shiftright(leaf, LEAF_BITS), leaf


def write_key_index(rows: DataFrame, key: str, folder: str) -> None:
    """Keys of one side as a table partitioned by range and sorted by leaf, with digests of the leaves.

    A digest is a count and two sums over hashes of the distinct keys: it does not depend on
    their order, so each task digests its rows and only digests are shuffled.
    """
    top, leaf = _range(F.col("key"))
    # a key decides about its range, so keys are counted where the ranges meet: one shuffle
    ranged = rows.where(F.col(key).isNotNull()).select(FN.clean_key(F.col(key)).alias("key")).withColumns({"top": top, "leaf": leaf})
    keys = ranged.repartition("top").groupBy("top", "leaf", "key").agg(F.count("*").alias("rows")).select("key", "rows", "top", "leaf")
    keys.sortWithinPartitions("top", "leaf").write.mode("overwrite").partitionBy("top").parquet(f"{folder}/keys")
    spark = rows.sparkSession
    written = spark.read.schema("key string, rows long, leaf int, top int").parquet(f"{folder}/keys")
    digests = written.groupBy("top", "leaf").agg(F.count("*").alias("n"), *_sums())
    digests.coalesce(1).write.mode("overwrite").parquet(f"{folder}/digests")


def _sums() -> list[Column]:
    return [F.sum(F.shiftright(F.xxhash64("key"), 20)).alias("s"), F.bit_xor(F.xxhash64("key", F.lit("again"))).alias("x")]


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("top int, leaf int, n long, s long, x long").parquet(f"{folder}/digests")


def differing_leaves(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(top, leaf) whose keys are not the same on both sides; a top range that agrees is not descended."""
    differ = lambda x, y: ~(x["n"].eqNullSafe(y["n"]) & x["s"].eqNullSafe(y["s"]) & x["x"].eqNullSafe(y["x"]))
    sides = [_digests(spark, f) for f in (a, b)]
    tops = [d.groupBy("top").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x")) for d in sides]
    x, y = tops[0].alias("p"), tops[1].alias("q")
    wanted = x.join(y, F.col("p.top") == F.col("q.top"), "full_outer").where(
        differ(_side("p"), _side("q"))).select(F.coalesce("p.top", "q.top").alias("top"))
    left, right = (d.join(wanted, "top", "left_semi").alias(n) for d, n in zip(sides, "pq", strict=True))
    on = (F.col("p.top") == F.col("q.top")) & (F.col("p.leaf") == F.col("q.leaf"))
    return left.join(right, on, "full_outer").where(differ(_side("p"), _side("q"))).select(
        F.coalesce("p.top", "q.top").alias("top"), F.coalesce("p.leaf", "q.leaf").alias("leaf"))


def _side(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("n", "s", "x")}


def reconcile_indexes(spark: SparkSession, catalog: str, storage: str) -> DataFrame:
    """(key, state) of the keys that only one side has: ``missing`` objects and ``new`` ones.

    The two folders come from ``write_key_index``.  Rows are read from the partitions and
    row groups of differing leaves only, so the work grows with the differences.
    """
    leaves = differing_leaves(spark, catalog, storage)
    found = leaves.collect()  # at most 2**(TOP_BITS + LEAF_BITS) pairs of numbers
    tops, wanted = sorted({r.top for r in found}), [r.leaf for r in found]

    def rows(folder: str) -> DataFrame:
        table = spark.read.schema("key string, rows long, leaf int, top int").parquet(f"{folder}/keys")
        narrow = F.col("leaf").isin(wanted) if len(wanted) <= 1000 else F.lit(True)
        return table.where(F.col("top").isin(tops) & narrow).join(F.broadcast(leaves), ["top", "leaf"], "left_semi").select("key", F.lit(True).alias("there"))

    a, b = rows(catalog).withColumnRenamed("there", "in_catalog"), rows(storage).withColumnRenamed("there", "in_storage")
    both = a.join(b, "key", "full_outer").where("in_catalog is null or in_storage is null")
    return both.select("key", F.when(F.col("in_storage").isNull(), "missing").otherwise("new").alias("state"))


# --- search by posting lists ------------------------------------------------------


def gram_codes(text: str) -> np.ndarray:
    """Code of each run of three characters: 40 bits, which two runs may share."""
    return _codes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))


def _codes(points: np.ndarray) -> np.ndarray:
    bits = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    return ((bits * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64)


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(LIST_PARTS)).cast("int")


_LISTS = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("units", pa.list_(pa.int16()))])


def _block_lists(block: int, ids: list[np.ndarray], values: list[pa.Array]) -> pa.RecordBatch:
    """Posting lists of rows of one block: the units of each gram, ascending."""
    parts, units = [], []
    for some, lists in zip(ids, values, strict=True):
        owner = np.repeat((some >> UNIT_BITS) & (BLOCK_UNITS - 1), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        texts = [v.decode("utf-8", "replace") for v in lists.flatten().cast(pa.binary()).to_pylist()]
        parts += texts
        units.append(np.repeat(owner, [len(x) for x in texts]) if texts else owner[:0])
    text = "".join(parts)
    inside = np.ones(max(len(text) - 2, 0), bool)
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
    for back in (1, 2):  # runs that begin in one value and end in the next
        cut = ends[(ends >= back) & (ends - back < len(inside))] - back
        inside[cut] = False
    codes, unit = gram_codes(text)[inside] if len(inside) else np.empty(0, np.int64), np.concatenate(units)[: len(inside)][inside]
    pairs = np.sort((codes << 12) | unit)  # 40 bits of gram, 12 of unit
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    gram = pairs >> 12
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
    offsets = pa.array(np.r_[first, len(gram)].astype(np.int32))
    listed = pa.ListArray.from_arrays(offsets, pa.array((pairs & (BLOCK_UNITS - 1)).astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), pa.array(gram[first]), listed], schema=_LISTS)


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, units) of rows (id, values) that come by id; a block in several pieces gives several lists."""
    block, ids, values, held = None, [], [], 0
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        blocks = numbers >> (UNIT_BITS + 12)
        starts = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)] if len(blocks) else np.zeros(1, int)
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if ids and (blocks[start] != block or held > PIECE_BYTES):
                yield _block_lists(block, ids, values)
                ids, values, held = [], [], 0
            some = batch.column(1).slice(start, end - start)
            block, ids, values, held = int(blocks[start]), [*ids, numbers[start:end]], [*values, some], held + some.nbytes
    if ids:
        yield _block_lists(block, ids, values)


def write_postings(rows: DataFrame, pk: str, columns: list[str], folder: str, batch: str = "0") -> None:
    """Add the posting lists of ``rows`` to an index; a batch that is written again is replaced.

    The index keeps the indexed values by row, numbered, so a candidate is verified without
    the catalog, and lists partitioned by gram.  A list names units of 16 neighbouring rows
    within a block of 65,536: a gram that many rows share, as the start of a URL, costs
    little, and only a block's lists are shuffled, never a row per gram.  A later batch may
    hold a row again: its values replace the earlier ones (batches are compared as text).
    """
    spark = rows.sparkSession
    values = F.array_distinct(F.array_compact(F.array(*[F.lower(F.col(c)) for c in columns])))
    kept = rows.select(F.col(pk).alias("pk"), values.alias("values"), F.monotonically_increasing_id().alias("id"))
    block = F.shiftright("id", UNIT_BITS + 12).alias("block")
    kept.select("pk", "values", "id", block).write.mode("overwrite").parquet(f"{folder}/values/batch={batch}")
    # the written numbers are read again, so lists and values agree
    written = spark.read.schema("id long, values array<string>").parquet(f"{folder}/values/batch={batch}")
    lists = written.select("id", "values").mapInArrow(posting_lists, "block long, gram long, units array<short>").withColumn("part", _part(F.col("gram")))
    (lists.repartition("part", F.pmod(F.xxhash64("block"), F.lit(4))).sortWithinPartitions("part", "gram")
     .write.mode("overwrite").partitionBy("part").parquet(f"{folder}/lists/batch={batch}"))


def search_postings(spark: SparkSession, folder: str, search: str) -> DataFrame:
    """Keys of the rows of which an indexed value contains ``search``, whatever the case.

    A unit must stand in the lists of all grams of the search text; the rows of units that do
    are verified on their values.  Searches of less than three characters have no gram and
    read the values.
    """
    text = search.strip().lower()
    values = spark.read.schema("pk string, values array<string>, id long, block long, batch string").parquet(f"{folder}/values")
    wanted = sorted(set(gram_codes(text).tolist())) if len(text) > 2 else []
    rows = values
    if wanted:
        lists = spark.read.schema("block long, gram long, units array<short>, batch string, part int").parquet(f"{folder}/lists")
        parts = [r.p for r in spark.createDataFrame([(g,) for g in wanted], "g long").select(_part(F.col("g")).alias("p")).distinct().collect()]
        named = lists.where(F.col("part").isin(parts) & F.col("gram").isin(wanted))
        # all lists of a block, at most 4,096 units each, meet in one group
        grams = named.groupBy("batch", "block", "gram").agg(F.flatten(F.collect_list("units")).alias("units"))
        blocks = grams.groupBy("batch", "block").agg(F.collect_list("units").alias("all")).where(F.size("all") == len(wanted))
        common = F.reduce(F.slice("all", 2, len(wanted)), F.array_distinct(F.col("all")[0]), F.array_intersect)
        hits = blocks.select("batch", "block", common.alias("units")).where("size(units) > 0")
        # at most a bit for each unit, 2 bytes for each listed one: an eighth of a byte for each row
        unit = F.shiftright("id", UNIT_BITS).bitwiseAND(BLOCK_UNITS - 1).cast("short")
        rows = values.join(F.broadcast(hits), ["batch", "block"]).where(F.array_contains("units", unit))
    found = rows.where(F.exists("values", lambda v: F.contains(v, F.lit(text)))).select("pk", "batch")
    # of a row in several batches the last one counts
    batches = sorted(r.batch for r in values.select("batch").distinct().collect())
    if len(batches) < 2:
        return found.select("pk").distinct()
    later = values.where(F.col("batch") > batches[0]).select("pk", F.col("batch").alias("later"))
    last = found.groupBy("pk").agg(F.max("batch").alias("batch"))
    newest = later.groupBy("pk").agg(F.max("later").alias("later"))
    return last.join(newest, "pk", "left").where("later is null or later = batch").select("pk")


# --- mergeable top-k and distinct counts ---------------------------------------------


def sketch_counts(rows: DataFrame, unit: str, value: Column, items: int = 2048) -> DataFrame:
    """One row per ``unit`` with sketches of a value: approximate counts of its commonest values and of distinct ones.

    Both kinds merge, so sources and the corpus are answered from their runs' rows without
    the files.  Sketches are built map-side, whatever the size of a run.
    """
    named = rows.select(unit, value.alias("value")).where("value is not null")
    return named.groupBy(unit).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(value, {items})").alias("top"), F.theta_sketch_agg("value").alias("distinct"))


def merged_counts(sketches: DataFrame, keys: list[str], k: int, items: int = 2048) -> DataFrame:
    """Per group of sketches: n, the ``k`` commonest values (value, count) and the number of distinct values.

    With up to ``items`` * 0.75 distinct values the counts are exact; beyond, a count is too
    high by at most ``n`` / (0.26 * ``items``).  Distinct counts have a relative error of 1.6 %
    (one standard deviation) beyond 4096 values and are exact up to there.
    """
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(top, {items})").alias("_top"), F.theta_union_agg("distinct").alias("_distinct"))
    return merged.select(*keys, "n", F.expr(f"approx_top_k_estimate(_top, {k})").alias("top"), F.theta_sketch_estimate("_distinct").alias("distinct"))
