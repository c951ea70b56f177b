"""Helpers that keep one hot key from becoming one slow task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import cut_lineage

#: Rows that one task numbers.
TASK_ROWS = 1_000_000
#: Keys that ``without`` broadcasts at most.
FEW_KEYS = 500_000
#: Words of 64 bits that mark keys by their hash, at most; 16 bits for a key up to there.
MARK_WORDS = 1 << 20
#: Hottest keys that are resolved by broadcast instead of by shuffle, and bytes of the
#: values of one such key: together they bound the broadcast.
HOT_KEYS = 1000
HOT_BYTES = 8192


def attach_per_key(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    count: str = "_n",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Left join ``rows`` to a table with one row per key, without hot partitions.

    ``lookup`` holds the number of rows of each key in column ``count``.  The at
    most ``HOT_KEYS`` keys with ``hot_rows`` rows or more are broadcast (so the
    broadcast is bounded whatever the data) and their rows are scattered over the
    shuffle by ``spread``, where they match nothing; any other key holds a small
    share of the rows, or values too large to be broadcast, and meets its partner by an
    ordinary shuffle join, whose skewed partitions adaptive execution splits.
    """
    values = [c for c in lookup.columns if c not in keys and c != count]
    hot = (
        lookup.where((F.col(count) >= hot_rows) & (F.octet_length(F.to_json(F.struct(*values))) <= HOT_BYTES))
        .orderBy(F.desc(count), *keys)
        .limit(HOT_KEYS)
        .select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_hot"))
    )
    on_hot = [rows[k] == F.col(f"_h_{k}") for k in keys]
    marked = rows.join(F.broadcast(hot), on_hot, "left").drop(*[f"_h_{k}" for k in keys])
    scattered = F.when(
        F.col("_hot").isNull() & F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull(),
        F.lit(0).cast("long"),
    ).otherwise(F.xxhash64(*spread).bitwiseOR(F.lit(1).cast("long")))
    # the count, which always fits, keeps both reads of the look-up alike, so it is computed once
    cold = lookup.where(F.coalesce(F.col(count), F.lit(0)) >= 0).select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.lit(0).cast("long").alias("_c_salt"),
        F.struct(*values).alias("_cold"),
    )
    marked = marked.withColumn("_salt", scattered)
    on_cold = [F.col("_salt") == F.col("_c_salt")] + [
        marked[k] == F.col(f"_c_{k}") for k in keys
    ]
    joined = marked.join(cold, on_cold, "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values],
    )


def attach_dimension(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join to a table with one row per key, whatever the share of one key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return attach_per_key(rows, table.join(counts, key), [key], [spread])


def join_present(rows: DataFrame, lookup: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join by a key that many rows lack: those rows match nothing and are scattered by ``spread``."""
    absent = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    salted = F.when(absent, F.concat(F.lit("\0"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key).cast("string"))
    other = lookup.select(F.col(key).cast("string").alias("_present"), *[c for c in lookup.columns if c != key])
    return rows.withColumn("_salted", salted).join(other, F.col("_salted") == F.col("_present"), "left").drop("_salted", "_present")


def without(rows: DataFrame, keys: DataFrame, key: str, few_rows: bool = False) -> DataFrame:
    """Rows whose ``key`` is not one of ``keys``; null keys stay.

    With ``few_rows``, where few rows are expected to go, only rows whose hash is marked as
    that of some key are shuffled and compared; the marks broadcast are bounded.

    Short keys compress so well that adaptive execution, which goes by compressed bytes,
    joins partitions of many millions of rows.  So the exchange has a partition for each
    ``TASK_ROWS`` rows or keys at least, which bounds what a task sorts; few keys are broadcast.
    """
    names = keys.select(key).distinct()
    # counted without their text where the tables are files
    count = keys.count()
    if count <= FEW_KEYS:
        return rows.join(F.broadcast(names), key, "left_anti")
    if few_rows:
        words = min(MARK_WORDS, count // 4 + 1)
        place = F.pmod(F.xxhash64(key), F.lit(words * 64))
        marks = keys.where(F.col(key).isNotNull()).groupBy(F.floor(place / 64).alias("_word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {words * 64}) % 64 as int))")).alias("_bits"))
        met = rows.join(F.broadcast(marks), F.floor(place / 64) == F.col("_word"), "left")
        hit = F.coalesce(F.getbit("_bits", (place % 64).cast("int")) == 1, F.lit(False))
        sure = met.where(~hit).select(*rows.columns)
        return sure.unionByName(without(met.where(hit).select(*rows.columns), keys, key))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(rows.count(), count) // TASK_ROWS))
    # an anti join would be moved below the exchange; an outer one reads its partitions as they are
    marked = rows.repartition(parts, key).join(names.withColumn("_gone", F.lit(True)), key, "left")
    return marked.where("_gone is null").select(*rows.columns)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Column | None = None,
    rank: str | None = None, salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of each group in a total order.

    A single first row is found map-side.  Otherwise groups are first cut within salted
    slices (by ``spread``, else by the order columns), so a hot group is shared by
    ``salts`` tasks and at most ``salts * k`` of its rows meet.
    """
    column = rank or "_rank"
    if k > 1:
        slice_no = F.pmod(F.xxhash64(*([spread] if spread is not None else _bare(df, order))), F.lit(salts))
        narrow = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", slice_no)
            .withColumn(column, F.row_number().over(narrow))
            .where(F.col(column) <= k)
            .drop("_slice", column)
        )
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(column) <= k)
    return kept if rank else kept.drop(column)


def _bare(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """Columns of the frame that an order names; all of them if it names none."""
    text = " ".join(str(c) for c in order)
    named = [F.col(c) for c in df.columns if c in text]
    return named or [F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group.  Rows that cannot win are dropped before the shuffle."""
    return top_per_group(df, keys, order, 1)


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number all rows 1..n in a total order, without a one-task window.

    Rows are range-partitioned and sorted; each partition numbers its own rows and
    adds the rows of the partitions before it.  The sorted rows are written once,
    because partition boundaries are sampled and must not change between the two
    reads.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    ordered = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition, so this window is bounded by the partition count
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(
            name, F.col("_offset") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
        )
        .drop("_part", "_offset", "_at")
    )


def with_positions_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Number the rows of every key 1..n; a hot key is numbered by many tasks."""
    # its rows are written already and numbered by a narrow join, so both reads agree
    numbered = with_positions(df, [*[F.col(k) for k in keys], *order], "_overall")
    starts = numbered.groupBy(*keys).agg(
        F.min("_overall").alias("_start"), F.count("*").alias("_n")
    )
    return (
        attach_per_key(numbered, starts, keys, ["_overall"])
        .withColumn(name, F.col("_overall") - F.col("_start") + 1)
        .drop("_overall", "_start")
    )
