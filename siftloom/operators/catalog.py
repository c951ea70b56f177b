"""Catalog filters, paging, look-ups and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import files as FN
from siftloom.functions import urls
from siftloom.operators.skew import attach_dimension, attach_per_key, top_per_group

# --- filters -----------------------------------------------------------------


def category_predicate(category: str) -> Column | None:
    """Predicate of a named category group over extension, type and key."""
    name = category.lower().strip()
    spec = rules.CATEGORY_FILTERS.get(rules.CATEGORY_FILTER_ALIASES.get(name, name))
    if spec is None:
        return None
    ext, mime, key = F.col("extension"), F.col("mime_type"), F.col("storage_key")
    tests = []
    if "ext" in spec:
        tests.append(
            ext.isin([e for x in spec["ext"] for e in (x, "." + x)] + spec.get("dotted_only", []))
        )
    if "mime" in spec:
        tests.append(mime.isin(spec["mime"]))
    if "mime_has" in spec:
        tests += [F.lower(mime).contains(m) for m in spec["mime_has"]]
    if "mime_prefix" in spec:
        tests.append(mime.startswith(spec["mime_prefix"]))
    if "key_has" in spec:
        tests += [key.contains(k) for k in spec["key_has"]]
    if "key_has_ci" in spec:
        tests += [F.lower(key).contains(k) for k in spec["key_has_ci"]]
    return F.coalesce(urls.any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def search_predicate(term: str) -> Column:
    """Case-insensitive substring over names and URL; no wildcard meaning."""
    needle = term.strip().lower()
    columns = ("file_name", "original_filename", "source_url")
    return urls.any_of([F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns])


@dataclass(frozen=True)
class FileFilter:
    """Optional, ANDed conditions of a file list."""

    run: str | None = None
    source_id: str | None = None
    status: str | None = None
    approval_status: str | None = None
    source_url: str | None = None
    sha256: str | None = None
    extension: str | None = None
    category: str | None = None
    search: str | None = None
    reference_search: bool = False
    """With True a search replaces the category condition instead of adding to it."""


def filter_files(files: DataFrame, f: FileFilter, runs: DataFrame | None = None) -> DataFrame:
    """Files under a filter.  ``run`` may be a key or a display id when ``runs`` is given."""
    out = files
    if f.run is not None:
        if runs is None:
            out = out.where(F.col("run_pk") == f.run)
        else:
            named = runs.where((F.col("run_pk") == f.run) | (F.col("run_id") == f.run)).agg(F.min("run_pk"))
            # an unknown key still selects files that carry it
            out = out.where((F.col("run_pk") == f.run) | (F.col("run_pk") == named.scalar()))
    for column, value in (
        ("source_id", f.source_id), ("status", f.status), ("approval_status", f.approval_status),
        ("source_url", f.source_url), ("sha256", f.sha256),
    ):
        if value:
            out = out.where(F.col(column) == value)
    if f.extension:
        bare = f.extension.lower().strip().removeprefix(".")
        out = out.where(F.col("extension").isin("." + bare, bare))
    searching = bool(f.search and f.search.strip())
    category = category_predicate(f.category) if f.category else None
    if category is not None and not (searching and f.reference_search):
        out = out.where(category)
    if searching:
        out = out.where(search_predicate(f.search))
    return out


def filter_runs(
    runs: DataFrame, collector_id: str | None = None, source_id: str | None = None,
    status: str | None = None, approval_status: str | None = None,
) -> DataFrame:
    for column, value in (
        ("collector_id", collector_id), ("source_id", source_id), ("status", status),
        ("approval_status", approval_status),
    ):
        if value:
            runs = runs.where(F.col(column) == value)
    return runs


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("RUNNING", "PENDING"))


def enabled(table: DataFrame) -> DataFrame:
    return table.where("enabled")


def manual_files(files: DataFrame) -> DataFrame:
    """Files that belong to no run."""
    return files.where(F.col("run_pk").isNull())


def source_tree(files: DataFrame) -> DataFrame:
    """Source, run and category tree with counts; manual files under a NULL run."""
    category = FN.categorize_file(
        F.col("mime_type"), F.col("extension"), "browser", F.col("original_filename"), F.col("storage_key")
    )
    return files.groupBy("source_id", "run_pk", category.alias("category")).agg(
        F.count("*").alias("files"), F.sum("file_size").alias("bytes")
    )


# --- paging ------------------------------------------------------------------


def page_numbers(page: object = None, page_size: object = None) -> tuple[int, int]:
    """Page from 1, size from 1 to 100 (20 when absent or not a number)."""

    def number(value: object, default: int) -> int:
        try:
            return int(float(value)) or default  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return default

    return max(1, number(page, 1)), min(100, max(1, number(page_size, 20)))


def list_page(
    df: DataFrame, page: object = None, page_size: object = None,
    created: str = "created_at", key: str = "file_pk",
) -> DataFrame:
    """One page, newest first.  Offset and limit run as a top-k, not as a full sort.

    For deep pages use :func:`list_after`, which does not hold the rows before the page.
    """
    number, size = page_numbers(page, page_size)
    ordered = df.orderBy(F.desc(created), F.col(key))
    return ordered.offset((number - 1) * size).limit(size)


def list_after(
    df: DataFrame, after: tuple[object, object] | None = None, page_size: object = None,
    created: str = "created_at", key: str = "file_pk",
) -> DataFrame:
    """The page after the row (created, key), newest first.

    A deep page costs as much as the first: rows before it are filtered at the scan, and
    only one page is kept per task.
    """
    _, size = page_numbers(1, page_size)
    rows = df
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        rows = df.where((F.col(created) < at) | ((F.col(created) == at) & (F.col(key) > last)))
    return rows.orderBy(F.desc(created), F.col(key)).limit(size)


def page_envelope(df: DataFrame, page: object = None, page_size: object = None) -> DataFrame:
    """Totals that go with a page."""
    number, size = page_numbers(page, page_size)
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / size).cast("long").alias("total_pages"),
    )


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.col("run_pk")).limit(k)


def latest_errors(errors: DataFrame, k: int = 50) -> DataFrame:
    """Newest ``k`` errors of each run."""
    return top_per_group(errors, ["run_pk"], [F.desc("created_at"), F.desc("error_id")], k)


# --- look-ups ----------------------------------------------------------------


def run_list(runs: DataFrame, collectors: DataFrame, sources: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Runs with the names of their collector, source and people; a collector or source
    with very many runs is met by broadcast."""
    named = collectors.select("collector_id", F.col("name").alias("collector_name"), F.col("type").alias("collector_type"))
    out = attach_dimension(runs, named, "collector_id", "run_pk")
    named = sources.select("source_id", F.col("name").alias("source_name"), F.col("slug").alias("source_slug"))
    out = attach_dimension(out, named, "source_id", "run_pk")
    if users is not None:
        for role in ("created_by", "approved_by"):
            people = users.select(F.col("user_id").alias(role), F.col("name").alias(f"{role}_name"))
            out = out.join(people, role, "left")
    return out


def file_details(files: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Files with their run and source; a run with very many files is met by broadcast."""
    named = attach_dimension(files, runs.select("run_pk", "run_id", F.col("status").alias("run_status")), "run_pk", "file_pk")
    return named.join(
        sources.select("source_id", F.col("name").alias("source_name"), F.col("slug").alias("source_slug")),
        "source_id", "left",
    )


def collector_list(collectors: DataFrame, sources: DataFrame, source_id: str | None = None) -> DataFrame:
    if source_id:
        collectors = collectors.where(F.col("source_id") == source_id)
    return collectors.join(
        sources.select("source_id", F.col("name").alias("source_name"), F.col("slug").alias("source_slug")),
        "source_id",
    )


def report_inputs(sources: DataFrame, collectors: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """Collectors, runs, files and bytes per source; each child is reduced before it joins."""
    n = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    sized = files.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    out = sources.select("source_id", "slug")
    for child in (n(collectors, "collectors"), n(runs, "runs"), sized):
        out = out.join(child, "source_id", "left")
    return out.na.fill(0, ["collectors", "runs", "files", "bytes"])


def key_map(table: DataFrame, pk: str, *names: str) -> DataFrame:
    """(lookup, pk): lower-cased keys under which a row may be addressed."""
    keys = F.array(*[F.lower(F.col(c)) for c in (pk, *names)])
    found = table.select(F.col(pk), F.explode(F.array_distinct(keys)).alias("lookup")).where("lookup IS NOT NULL")
    # a name shared by two rows resolves to the smaller key
    return found.groupBy("lookup").agg(F.min(pk).alias(pk))


def resolve_keys(rows: DataFrame, column: str, table: DataFrame, pk: str, *names: str) -> DataFrame:
    """Rows with ``pk`` found by any of the keys of ``table``, whatever the case.

    A key that very many rows ask for is met by broadcast.
    """
    asked = rows.withColumn("lookup", F.lower(F.trim(column)))
    counts = asked.groupBy("lookup").agg(F.count("*").alias("_n"))
    spread = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    return attach_per_key(asked, key_map(table, pk, *names).join(counts, "lookup"), ["lookup"], spread).drop("lookup")


def with_category(files: DataFrame, policy: str = "worker") -> DataFrame:
    return files.withColumn(
        "category",
        FN.categorize_file(F.col("mime_type"), F.col("extension"), policy, F.col("original_filename"), F.col("storage_key")),
    )


def attach_extension_category(files: DataFrame, table: DataFrame) -> DataFrame:
    """Category by an (extension, category) table, for rule sets kept as data."""
    return files.withColumn("extension", FN.dotted(F.col("extension"))).join(table, "extension", "left")


# --- reconciliation ----------------------------------------------------------


def reconcile(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Presence of every key on both sides: in_catalog, in_storage and a state.

    States: synced, missing (row without object), new (object without row),
    known_content (object under a new key whose hash the catalog has).  Keys are compared
    without leading slashes; an object that is listed twice counts once.

    Rows and objects meet in one shuffle by key.  Only objects without a row are then looked
    up by hash; both branches read the same exchange.
    """
    none = F.lit(None)
    rows = files.where("storage_key IS NOT NULL").select(
        FN.clean_key(F.col("storage_key")).alias("key"), F.lit(1).alias("_rows"), F.lit(False).alias("_stored"),
        none.cast("binary").alias("_hash"), none.cast(objects.schema["size"].dataType).alias("size"))
    listed = objects.select(
        FN.clean_key(F.col("key")).alias("key"), F.lit(0).alias("_rows"), F.lit(True).alias("_stored"),
        FN.packed_hash(F.lower("sha256")).alias("_hash"), "size")
    both = rows.unionByName(listed).repartition("key").groupBy("key").agg(
        F.sum("_rows").alias("catalog_rows"), F.max("_stored").alias("in_storage"), F.max("_hash").alias("_hash"),
        F.max_by("size", F.struct("_stored", "_hash")).alias("size"))

    def stated(df: DataFrame, state: Column) -> DataFrame:
        return df.select(
            "key", (F.col("catalog_rows") > 0).alias("in_catalog"), "in_storage", "catalog_rows",
            FN.unpacked_hash(F.col("_hash")).alias("sha256"), "size", state.alias("state"))

    # conditions that always hold keep the columns of both reads alike, so rows are shuffled once
    placed = both.where((F.col("catalog_rows") > 0) & (F.coalesce(F.length("_hash"), F.lit(0)) >= 0))
    loose = both.where("catalog_rows = 0 and in_storage")
    known = (
        files.where(F.coalesce("sha256", F.lit("")) != "")
        .select(FN.packed_hash(F.lower("sha256")).alias("_known"))
        .distinct()
    )
    met = loose.join(known, F.col("_hash") == F.col("_known"), "left")
    return stated(placed, F.when(F.col("in_storage"), "synced").otherwise("missing")).unionByName(
        stated(met, F.when(F.col("_known").isNotNull(), "known_content").otherwise("new")))


def reconciliation_summary(state: DataFrame, restored_runs: int | Column = 0) -> DataFrame:
    rows = F.col("catalog_rows")
    total = lambda name: F.coalesce(F.sum(F.when(F.col("state") == name, rows)), F.lit(0))
    return state.agg(
        (total("synced") + F.count_if(F.col("state") == "new")).alias("synced"),
        total("missing").alias("missing"),
        F.count_if(F.col("state") == "new").alias("indexed_new"),
        (F.sum("catalog_rows") + F.count_if(F.col("state") == "new")).alias("total_checked"),
    )
