"""Referential integrity, uniqueness and lineage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.conformance import violations
from siftloom.operators.skew import without


def missing_parents(child: DataFrame, key: str, pk: str, parent: DataFrame, relation: str) -> DataFrame:
    """Child rows whose parent does not exist: (relation, child_key, parent_key)."""
    orphans = without(child.select(key, pk).where(F.col(key).isNotNull()), parent, key)
    return orphans.select(
        F.lit(relation).alias("relation"), F.col(pk).alias("child_key"), F.col(key).alias("parent_key")
    )


def referential_violations(
    sources: DataFrame, collectors: DataFrame, runs: DataFrame, files: DataFrame, errors: DataFrame
) -> DataFrame:
    checks = [
        missing_parents(collectors, "source_id", "collector_id", sources, "collector.source"),
        missing_parents(runs, "collector_id", "run_pk", collectors, "run.collector"),
        missing_parents(runs, "source_id", "run_pk", sources, "run.source"),
        missing_parents(files, "run_pk", "file_pk", runs, "file.run"),
        missing_parents(files, "source_id", "file_pk", sources, "file.source"),
        missing_parents(errors, "run_pk", "error_id", runs, "error.run"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def repeated_values(table: DataFrame, column: str, label: str) -> DataFrame:
    """Values of a unique column that occur more than once."""
    return (
        table.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("rows"))
        .where("rows > 1")
        .select(F.lit(label).alias("column_name"), "value", "rows")
    )


def lineage_violations(files: DataFrame) -> DataFrame:
    """Stored scraped files that cannot be traced: what each one lacks."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    stored = files.where("status = 'UPLOADED'")
    if "origin" in files.columns:
        stored = stored.where(F.coalesce("origin", F.lit("SCRAPED")) == "SCRAPED")
    return stored.select(
        "file_pk",
        violations(
            ("source_url", empty(F.col("source_url"))),
            ("storage_key", empty(F.col("storage_key"))),
            ("sha256", empty(F.col("sha256"))),
            ("run", F.col("run_pk").isNull()),
        ).alias("missing"),
    ).where("size(missing) > 0")
