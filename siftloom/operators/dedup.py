"""Exact duplicates and sequential ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import files as FN
from siftloom.operators.conflicts import first_claims
from siftloom.operators.skew import attach_per_key, keep_first, with_positions, with_positions_per_key


def _stored(catalog: DataFrame, *keys: str) -> DataFrame:
    present = catalog.where(F.col("status") == "UPLOADED")
    for key in keys:
        present = present.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return present.select(*keys).distinct()


def known_urls(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Incoming rows whose (source, URL) is already stored."""
    return incoming.join(_stored(catalog, "source_id", "source_url"), ["source_id", "source_url"], "left_semi")


def new_urls(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    return incoming.join(_stored(catalog, "source_id", "source_url"), ["source_id", "source_url"], "left_anti")


def known_content(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Incoming rows whose content hash is stored anywhere; empty hashes never match."""
    return incoming.join(_stored(catalog, "sha256"), "sha256", "left_semi")


def new_content(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    return incoming.join(_stored(catalog, "sha256"), "sha256", "left_anti")


def file_keys(files: DataFrame) -> list[Column]:
    """The two keys that make a file known, as strings that cannot clash: its URL in its source, its content."""
    url = F.nullif("source_url", F.lit(""))
    return [F.concat(F.lit("u"), F.col("source_id"), F.lit("\0"), url), F.concat(F.lit("h"), F.nullif("sha256", F.lit("")))]


def admitted(incoming: DataFrame, catalog: DataFrame, order: str | None = None) -> DataFrame:
    """Incoming rows that are new by URL and by content.

    With ``order``, a column that numbers them, rows also see each other: a row is known
    when an admitted row before it has its URL or its content.
    ``incoming`` is the small side: the catalog is cut to its keys before anything is made
    distinct.
    """
    pair = ["source_id", "source_url"]
    same_url = catalog.join(incoming.select(*pair).distinct(), pair, "left_semi")
    same_hash = catalog.join(incoming.select("sha256").distinct(), "sha256", "left_semi")
    new = new_content(new_urls(incoming, same_url), same_hash)
    if order is None:
        return new
    url, content = file_keys(new)
    first = first_claims(new.select(order, url.alias("_url"), content.alias("_content")), ["_url", "_content"], order)
    return new.join(first, order, "left_semi")


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Files with ``first_pk`` and ``is_duplicate``: later rows of the same hash.

    The first row of each hash is a map-side minimum; it is joined back without
    gathering a hot hash in one task.
    """
    hashed = files.withColumn("_hash", F.nullif(F.trim("sha256"), F.lit("")))
    firsts = (
        hashed.where("_hash IS NOT NULL")
        .groupBy("_hash")
        .agg(F.min(F.struct("created_at", "file_pk")).alias("_first"), F.count("*").alias("_n"))
        .select("_hash", F.col("_first.file_pk").alias("first_pk"), "_n")
    )
    return (
        attach_per_key(hashed, firsts, ["_hash"], ["file_pk"])
        .withColumn("is_duplicate", F.coalesce(F.col("first_pk") != F.col("file_pk"), F.lit(False)))
        .drop("_hash")
    )


def dedup_in_run(records: DataFrame, run: str = "run_pk", order: str = "page_id") -> DataFrame:
    """First record of each fingerprint in a run; records without one all stay."""
    printed = records.where(F.coalesce("content_fingerprint", F.lit("")) != "")
    bare = records.where(F.coalesce("content_fingerprint", F.lit("")) == "")
    return keep_first(printed, [run, "content_fingerprint"], [F.col(order)]).unionByName(bare)


def dedup_across_runs(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose fingerprint no earlier run has stored."""
    seen = stored.where("content_fingerprint IS NOT NULL").select("content_fingerprint").distinct()
    return records.join(seen, "content_fingerprint", "left_anti")


def next_file_number(catalog: DataFrame) -> DataFrame:
    """One row: the first free file number, above the largest id and the row count."""
    number = FN.parse_file_id(F.col("file_id"))
    return catalog.agg(
        (F.greatest(F.coalesce(F.max(number), F.lit(0)), F.count("*")) + 1).alias("first_free")
    )


def allocate_file_ids(new_rows: DataFrame, catalog: DataFrame, order: list[Column]) -> DataFrame:
    """New rows with consecutive file ids after the catalog's last."""
    start = next_file_number(catalog)
    numbered = with_positions(new_rows, order, "_pos")
    return numbered.withColumn(
        "file_id", FN.format_file_id(start.scalar() + F.col("_pos") - 1)
    ).drop("_pos")


def allocate_run_ids(
    new_runs: DataFrame, existing: DataFrame, order: list[Column], day: str = "started_at"
) -> DataFrame:
    """New runs with ``run_id`` continuing each day's sequence."""
    taken = (
        existing.select(
            F.regexp_extract("run_id", r"^(.*)_run_[0-9]+$", 1).alias("_day"),
            F.regexp_extract("run_id", r"_run_([0-9]+)$", 1).try_cast("long").alias("_seq"),
        )
        .where("_day <> ''")
        .groupBy("_day")
        .agg(F.max("_seq").alias("_last"))
    )
    dated = new_runs.withColumn("_day", F.date_format(day, "yyyy-MM-dd"))
    numbered = with_positions_per_key(dated, ["_day"], order, "_pos")
    # one row per calendar day: small by nature, and AQE checks its size before broadcasting
    return (
        numbered.join(taken, "_day", "left")
        .withColumn(
            "run_id",
            F.concat(
                F.col("_day"),
                F.format_string("_run_%06d", F.coalesce("_last", F.lit(0)) + F.col("_pos")),
            ),
        )
        .drop("_day", "_pos", "_last")
    )
