"""Totals, manifests, source reports and run timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import files as FN
from siftloom.functions import urls
from siftloom.operators.skew import attach_per_key, top_per_group, without
from siftloom.session import cut_lineage

# --- totals ------------------------------------------------------------------


def dashboard_totals(sources: DataFrame, collectors: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """One row.  Each table is reduced by itself; the results are scalar subqueries."""
    one = lambda df, cond: df.agg(F.count_if(cond)).scalar()
    return files.agg(
        F.count_if(F.col("status") == "UPLOADED").alias("total_files_collected"),
        F.count_if(F.col("status") == "DUPLICATE").alias("total_duplicates"),
        F.count_if(F.col("status") == "FAILED").alias("total_failed_files"),
    ).select(
        "*",
        one(sources, F.col("enabled")).alias("total_sources"),
        one(collectors, F.col("enabled")).alias("active_collectors"),
        one(runs, F.col("status").isin("RUNNING", "PENDING")).alias("running_runs"),
    )


def storage_totals(sources: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes")
    ).select(
        "*",
        runs.agg(F.count("*")).scalar().alias("total_runs"),
        sources.agg(F.count("*")).scalar().alias("total_sources"),
    )


# --- manifests ---------------------------------------------------------------


def run_counters(events: DataFrame) -> DataFrame:
    """Counters per run from (run_id, kind, bytes).  Works on batches and on streams."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counted = events.groupBy("run_id").agg(
        n("found").alias("_found"),
        n("downloaded").alias("files_downloaded"),
        n("skipped").alias("files_skipped"),
        n("duplicate").alias("files_duplicate"),
        n("failed").alias("files_failed"),
        n("page").alias("pages_crawled"),
        F.coalesce(F.sum(F.when(F.col("kind") == "downloaded", F.col("bytes"))), F.lit(0)).alias("total_bytes"),
    )
    processed = (
        F.col("files_downloaded") + F.col("files_skipped") + F.col("files_duplicate") + F.col("files_failed")
    )
    return counted.select("run_id", F.greatest("_found", processed).alias("files_found"), *counted.columns[2:])


def category_manifest(events: DataFrame) -> DataFrame:
    """Files and bytes per run and category, with the paths of their manifest and metadata."""
    stored = events.where((F.col("kind") == "downloaded") & (F.coalesce("category", F.lit("")) != ""))
    return (
        stored.groupBy("run_id", F.regexp_replace("category", r"^/+|/+$", "").alias("category"))
        .agg(F.count("*").alias("files_count"), F.sum("bytes").alias("total_bytes"))
        .withColumns(
            {
                "manifest_path": F.concat("category", F.lit("/manifest.json")),
                "metadata_path": F.concat("category", F.lit("/metadata.jsonl")),
            }
        )
    )


def category_manifest_parts(events: DataFrame, part_size: int = 5000) -> DataFrame:
    """File lists of the category manifests in parts of about ``part_size`` entries.

    The number of parts follows the size of the category, so the list of a very
    large category is built by many tasks; the parts together are the whole list.
    """
    stored = events.where(
        (F.col("kind") == "downloaded") & (F.coalesce("category", F.lit("")) != "")
    ).withColumn("category", F.regexp_replace("category", r"^/+|/+$", ""))
    sizes = stored.groupBy("run_id", "category").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_parts", F.ceil(F.col("_n") / part_size).cast("long"))
    placed = attach_per_key(stored, sizes, ["run_id", "category"], ["file_name", "event_id"])
    part = F.pmod(F.xxhash64("file_name", "event_id"), F.col("_parts"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("file_name").alias("name"), F.col("bytes").alias("size"))))
    return placed.groupBy("run_id", "category", part.alias("part_no")).agg(entries.alias("files"))


def run_manifest(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Manifest per run: counters and a map of categories.

    The map holds one entry per category, a fixed vocabulary of folders.
    """
    entry = F.struct(
        "category", F.struct("files_count", "total_bytes", "manifest_path", "metadata_path").alias("c")
    )
    categories = category_manifest(events).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("categories")
    )
    out = run_counters(events).join(categories, "run_id", "left")
    if runs is not None:
        out = out.join(runs, "run_id", "left")
    return out


def errors_by_code(errors: DataFrame) -> DataFrame:
    return errors.groupBy("run_pk", "error_code").agg(F.count("*").alias("errors"))


def refresh_error_counts(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Runs with ``error_count``, counted for runs in a terminal state."""
    counted = errors.groupBy("run_pk").agg(F.count("*").alias("_n"))
    done = F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")
    return (
        runs.join(counted, "run_pk", "left")
        .withColumn("error_count", F.when(done, F.coalesce("_n", F.lit(0))))
        .drop("_n")
    )


# --- source reports ----------------------------------------------------------


def _bare_extension() -> Column:
    ext = F.replace(F.lower("extension"), F.lit("."), F.lit(""))
    return F.coalesce(F.nullif(ext, F.lit("")), F.lit("other"))


def _is_pdf() -> Column:
    return (
        (_bare_extension() == "pdf")
        | F.coalesce(F.col("mime_type"), F.lit("")).contains("pdf")
        | F.coalesce(F.col("storage_key"), F.lit("")).contains(".pdf")
    )


def _is_scanned() -> Column:
    flag = lambda p, v: F.coalesce(F.get_json_object("metadata", p) == v, F.lit(False))
    return (
        F.lower(F.coalesce("storage_key", F.lit(""))).contains("/ocr/")
        | flag("$.ocr", "true")
        | flag("$.pdf_type", "ocr")
        | flag("$.is_scanned", "true")
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent rounded half up; NULL without a whole."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5).cast("long"))


def source_report(files: DataFrame) -> DataFrame:
    """Volumes and type counts per source.  PDFs are not counted as other."""
    ext, pdf = _bare_extension(), _is_pdf()
    html, js = ext.isin("html", "htm"), ext.isin("json", "jsonl")
    media = ext.isin("jpg", "jpeg", "png", "webp", "mp4", "mp3", "wav")
    out = files.groupBy("source_id").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        F.count_if(pdf).alias("pdfs"),
        F.count_if(pdf & ~_is_scanned()).alias("digital_pdfs"),
        F.count_if(pdf & _is_scanned()).alias("ocr_pdfs"),
        F.count_if(html).alias("html_files"),
        F.count_if(js).alias("json_files"),
        F.count_if(media).alias("media_files"),
        F.count_if(~html & ~js & ~media & ~pdf).alias("other_files"),
    )
    return out.withColumns(
        {
            "digital_pct": percent(F.col("digital_pdfs"), F.col("pdfs")),
            "ocr_pct": percent(F.col("ocr_pdfs"), F.col("pdfs")),
        }
    )


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("source_id", _bare_extension().alias("name")).agg(F.count("*").alias("files"))


def host_counts(files: DataFrame) -> DataFrame:
    return (
        files.where("source_url IS NOT NULL")
        .groupBy("source_id", urls.host(F.col("source_url")).alias("name"))
        .agg(F.count("*").alias("files"))
        .where("name <> ''")
    )


def section_counts(files: DataFrame) -> DataFrame:
    """Files per first path segment."""
    first = F.regexp_extract(urls.path(F.col("source_url")), r"^/*([^/]+)", 1)
    return (
        files.where("source_url IS NOT NULL")
        .groupBy("source_id", first.alias("_s"))
        .agg(F.count("*").alias("files"))
        .where("_s <> ''")
        .select("source_id", F.concat(F.lit("/"), "_s").alias("name"), "files")
    )


def top_counts(counts: DataFrame, k: int = 8) -> DataFrame:
    """``k`` largest counts of each source, ties by name."""
    return top_per_group(counts, ["source_id"], [F.desc("files"), F.col("name")], k, rank="place")


def grand_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.sum("pdfs").alias("pdfs"),
        F.sum("digital_pdfs").alias("digital_pdfs"),
        F.sum("ocr_pdfs").alias("ocr_pdfs"),
        F.greatest(F.max("files"), F.lit(1)).alias("max_source_files"),
    ).withColumn("digital_pct", percent(F.col("digital_pdfs"), F.col("pdfs")))


def source_shares(report: DataFrame) -> DataFrame:
    """Each source's files as a share of the largest source (bar width, at least 8)."""
    top = report.agg(F.greatest(F.max("files"), F.lit(1))).scalar()
    return report.select(
        "source_id", "files",
        F.greatest(F.floor(100 * F.col("files") / top + 0.5).cast("long"), F.lit(8)).alias("bar_width"),
    )


# --- run detail --------------------------------------------------------------


def approval_counts(files: DataFrame) -> DataFrame:
    status = F.coalesce("approval_status", F.lit("PENDING"))
    return files.groupBy("run_pk").agg(
        F.count_if(status == "APPROVED").alias("approved"),
        F.count_if(status == "REJECTED").alias("rejected"),
        F.count_if(status == "PENDING").alias("pending"),
    )


def type_counters(files: DataFrame) -> DataFrame:
    """Ten counters per run that may overlap."""
    ext = F.lower(F.coalesce("extension", F.lit("")))
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    key = F.lower(F.coalesce("storage_key", F.lit("")))
    ocr = key.contains("pdf/ocr")
    digital = ~ocr & (ext.isin(".pdf", "pdf") | mime.contains("pdf"))
    web = key.contains("data/web_content") | key.contains("web_data")
    tests = {
        "digital_pdf": digital,
        "ocr_pdf": ocr,
        "pdf": digital | ocr,
        "web_data": web,
        "ebook": ext.isin(".epub", ".mobi", ".azw3", ".fb2", ".djvu"),
        "doc": ext.isin(".doc", ".docx", ".odt", ".rtf", ".txt", ".md", ".pages"),
        "audio": mime.startswith("audio/") | ext.isin(".mp3", ".wav", ".flac", ".ogg", ".opus", ".m4a", ".aac"),
        "video": mime.startswith("video/") | ext.isin(".mp4", ".mkv", ".avi", ".mov", ".webm"),
        "image": mime.startswith("image/") | ext.isin(".jpg", ".jpeg", ".png", ".webp", ".svg", ".gif"),
        "data": ext.isin(".parquet", ".jsonl", ".csv", ".tsv", ".json", ".xml", ".arrow") & ~web,
    }
    return files.groupBy("run_pk").agg(*[F.count_if(t).alias(f"{n}_count") for n, t in tests.items()])


def category_groups(files: DataFrame) -> DataFrame:
    """Files and bytes per source and category as the browser view derives it."""
    category = FN.categorize_file(
        F.col("mime_type"), F.col("extension"), "browser", F.col("original_filename"), F.col("storage_key")
    )
    return files.groupBy("source_id", category.alias("category")).agg(
        F.count("*").alias("files"), F.sum("file_size").alias("bytes")
    )


def counted_errors(errors: DataFrame) -> DataFrame:
    return errors.groupBy("run_pk").agg(F.count("*").alias("reported_errors"))


def errors_of_runs(errors: DataFrame, keys: DataFrame) -> DataFrame:
    """Errors whose run is one of ``keys``.

    Only the runs that errors name are looked up, in partitions bounded by rows.  Errors
    stay where they are but for those of runs that do not exist, or are marked like one.
    """
    named = errors.where("run_pk is not null")
    lost = cut_lineage(without(counted_errors(named).select("run_pk"), keys, "run_pk"))
    return without(named, lost, "run_pk", few_rows=True)


def run_timeline(runs: DataFrame, errors: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Text events of each run: derived from its counters, plus one line per error.

    ``runs``: run_pk, run_id, source_name, source_slug, collector_type, status, times
    and counters; ``reported_errors`` is counted if absent.  ``keys`` holds the same runs'
    run_pk and saves computing ``runs`` twice.  ``seq`` orders the lines of a run; lines
    are not gathered.
    """
    n = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    zone = F.when(F.col("collector_type") == "TELEGRAM", "telegram").otherwise("web")
    live = F.col("status").isin("RUNNING", "PENDING", "CANCEL_REQUESTED")
    staged = runs if "reported_errors" in runs.columns else runs.join(counted_errors(errors), "run_pk", "left")
    has_errors = F.coalesce("reported_errors", F.lit(0)) > 0

    def event(seq: int, time: str, level, text: Column, when: Column | None = None) -> Column:
        row = F.struct(
            F.lit(seq).alias("seq"), F.col(time).alias("at"),
            (level if isinstance(level, Column) else F.lit(level)).alias("level"), text.alias("message"),
        )
        return row if when is None else F.when(when, row)

    events = F.array(
        event(1, "started_at", "STATUS", say("[JOB_DISPATCH] Execution run ", F.col("run_id"), " initialized for source '", F.coalesce("source_name", F.lit("Target")), "'")),
        event(2, "started_at", "INFO", say("[STORAGE_TARGET] Raw Zone Path: 00_raw/", zone, "/", F.coalesce("source_slug", F.lit("source")), "/", F.col("run_id"), "/")),
        event(3, "started_at", "INFO", say("[CRAWLER] Scanned ", n("pages_crawled"), " pages / channels"), F.col("pages_crawled") > 0),
        event(4, "started_at", "INFO", say("[DISCOVERY] Located ", n("files_found"), " raw candidate files"), F.col("files_found") > 0),
        event(5, "started_at", "SUCCESS", say("[DOWNLOAD_SUCCESS] Processed & stored ", n("files_downloaded"), " deduplicated artifacts"), F.col("files_downloaded") > 0),
        event(6, "started_at", "WARN", say("[DEDUP_FILTER] Skipped ", n("files_duplicate"), " SHA-256 duplicate artifacts"), F.col("files_duplicate") > 0),
        event(7, "started_at", "ERROR", say("[FAILURE] ", n("files_failed"), " files encountered errors during processing"), (F.col("files_failed") > 0) & ~has_errors),
        event(9, "completed_at", F.when(F.col("status") == "COMPLETED", "SUCCESS").otherwise("STATUS"), say("[JOB_TERMINATED] Run status finalized to ", F.col("status")), ~live),
        event(9, "completed_at", "INFO", say("[LIVE_TAIL] Listening for active worker callbacks"), live),
    )
    # a higher-order filter would have every text built outside compiled code
    derived = staged.select("run_pk", F.explode(events).alias("e")).where("e is not null").select("run_pk", "e.*")
    reported = errors_of_runs(errors, runs if keys is None else keys).select(
        "run_pk", F.lit(8).alias("seq"), F.col("created_at").alias("at"), F.lit("ERROR").alias("level"),
        say("[WORKER_ERROR] ", F.coalesce("error_code", F.lit("Exception")), ": ", F.col("message")).alias("message"),
    )
    return derived.unionByName(reported)
