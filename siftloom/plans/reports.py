"""Totals, manifests, source reports and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.operators import catalog as CT
from siftloom.operators import indexes as IX
from siftloom.operators import reports as RP
from siftloom.plans import tables as t
from siftloom.plans.registry import query
from siftloom.plans.tables import sql_pick, with_tables


@query("A1_dashboard_totals", with_tables("""SELECT (SELECT count(*) FROM sources WHERE enabled) AS total_sources, (SELECT count(*) FROM collectors WHERE enabled) AS active_collectors, (SELECT count(*) FROM runs WHERE status IN ('RUNNING', 'PENDING')) AS running_runs,
  count(*) FILTER (status = 'UPLOADED') AS total_files_collected, count(*) FILTER (status = 'DUPLICATE') AS total_duplicates, count(*) FILTER (status = 'FAILED') AS total_failed_files FROM files""", "sources", "collectors", "runs", "files"))
def a1(spark, d):
    return RP.dashboard_totals(t.sources(spark, d), t.collectors(spark, d), t.runs(spark, d), t.files(spark, d))


_COUNT = """SELECT run_id, greatest(count(*) FILTER (kind = 'found'), count(*) FILTER (kind IN ('downloaded', 'skipped', 'duplicate', 'failed'))) AS files_found, count(*) FILTER (kind = 'downloaded') AS files_downloaded,
  count(*) FILTER (kind = 'skipped') AS files_skipped, count(*) FILTER (kind = 'duplicate') AS files_duplicate, count(*) FILTER (kind = 'failed') AS files_failed, count(*) FILTER (kind = 'page') AS pages_crawled,
  CAST(coalesce(sum(bytes) FILTER (kind = 'downloaded'), 0) AS BIGINT) AS total_bytes FROM run_events GROUP BY run_id"""


@query("A2_T1_run_counters", with_tables(_COUNT, "run_events"))
def a2(spark, d):
    return RP.run_counters(t.run_events(spark, d))


@query("A2_run_manifest", with_tables(f"""WITH c AS ({_COUNT}), k AS (SELECT run_id, category, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b FROM run_events WHERE kind = 'downloaded' GROUP BY ALL),
s AS (SELECT run_id, string_agg(category || '=' || n || '/' || b, ';' ORDER BY category) AS categories FROM k GROUP BY run_id) SELECT c.run_id, files_found, total_bytes, categories FROM c LEFT JOIN s ON c.run_id = s.run_id""", "run_events"))
def a2b(spark, d):
    m = RP.run_manifest(t.run_events(spark, d))
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"]["files_count"], F.lit("/"), e["value"]["total_bytes"])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("categories"), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), entry), ";")
    return m.select("run_id", "files_found", "total_bytes", listed.alias("categories"))


@query("A3_category_manifest", with_tables("SELECT run_id, category, count(*) AS files_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, category || '/manifest.json' AS manifest_path, category || '/metadata.jsonl' AS metadata_path FROM run_events WHERE kind = 'downloaded' GROUP BY run_id, category", "run_events"))
def a3(spark, d):
    return RP.category_manifest(t.run_events(spark, d))


@query("A3_category_file_lists", with_tables("SELECT run_id, category, file_name AS name, bytes AS size FROM run_events WHERE kind = 'downloaded'", "run_events"))
def a3b(spark, d):
    parts = RP.category_manifest_parts(t.run_events(spark, d), part_size=3)
    return parts.select("run_id", "category", F.inline("files"))


@query("A5_errors_by_code", with_tables("SELECT run_pk, error_code, count(*) AS errors FROM errors GROUP BY ALL", "errors"))
def a5(spark, d):
    return RP.errors_by_code(t.errors(spark, d))


@query("A6_storage_totals", with_tables("SELECT count(*) AS total_files, CAST(sum(file_size) AS BIGINT) AS total_bytes, (SELECT count(*) FROM runs) AS total_runs, (SELECT count(*) FROM sources) AS total_sources FROM files", "files", "runs", "sources"))
def a6(spark, d):
    return RP.storage_totals(t.sources(spark, d), t.runs(spark, d), t.files(spark, d))


_REPORT = """SELECT source_id, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (extension = '.pdf') AS pdfs, count(*) FILTER (extension = '.pdf' AND line <> 1) AS digital_pdfs, count(*) FILTER (extension = '.pdf' AND line = 1) AS ocr_pdfs,
  count(*) FILTER (extension = '.html') AS html_files, count(*) FILTER (extension = '.json') AS json_files, count(*) FILTER (extension IN ('.jpg', '.mp4')) AS media_files, count(*) FILTER (extension IN ('.docx', '.epub', '.csv', '.txt', '.zip')) AS other_files FROM files GROUP BY source_id"""


@query("A7_source_report", with_tables(f"WITH r AS ({_REPORT}) SELECT *, CASE WHEN pdfs > 0 THEN CAST(floor(100.0::DOUBLE * digital_pdfs / pdfs + 0.5) AS BIGINT) END AS digital_pct, CASE WHEN pdfs > 0 THEN CAST(floor(100.0::DOUBLE * ocr_pdfs / pdfs + 0.5) AS BIGINT) END AS ocr_pct FROM r", "files"))
def a7(spark, d):
    return RP.source_report(t.files(spark, d))


@query("A7_extension_counts", with_tables("SELECT source_id, substring(extension, 2) AS name, count(*) AS files FROM files GROUP BY ALL", "files"))
def a7b(spark, d):
    return RP.extension_counts(t.files(spark, d))


@query("A8_grand_totals", with_tables(f"WITH r AS ({_REPORT}) SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(pdfs) AS BIGINT) AS pdfs, CAST(sum(digital_pdfs) AS BIGINT) AS digital_pdfs, CAST(sum(ocr_pdfs) AS BIGINT) AS ocr_pdfs, max(files) AS max_source_files, CAST(floor(100.0::DOUBLE * sum(digital_pdfs) / sum(pdfs) + 0.5) AS BIGINT) AS digital_pct FROM r", "files"))
def a8(spark, d):
    return RP.grand_totals(RP.source_report(t.files(spark, d)))


@query("A8_source_shares", with_tables("WITH r AS (SELECT source_id, count(*) AS files FROM files GROUP BY source_id) SELECT source_id, files, greatest(CAST(floor(100.0::DOUBLE * files / (SELECT max(files) FROM r) + 0.5) AS BIGINT), 8) AS bar_width FROM r", "files"))
def a8b(spark, d):
    return RP.source_shares(RP.source_report(t.files(spark, d)))


@query("A11_approval_counts", with_tables("SELECT run_pk, count(*) FILTER (approval_status = 'APPROVED') AS approved, count(*) FILTER (approval_status = 'REJECTED') AS rejected, count(*) FILTER (approval_status IS NULL OR approval_status = 'PENDING') AS pending FROM files GROUP BY run_pk", "files"))
def a11(spark, d):
    return RP.approval_counts(t.files(spark, d))


@query("A12_type_counters", with_tables("""SELECT run_pk, count(*) FILTER (extension = '.pdf') AS digital_pdf_count, 0 AS ocr_pdf_count, count(*) FILTER (extension = '.pdf') AS pdf_count, count(*) FILTER (extension = '.json') AS web_data_count, count(*) FILTER (extension = '.epub') AS ebook_count,
  count(*) FILTER (extension IN ('.docx', '.txt')) AS doc_count, 0 AS audio_count, count(*) FILTER (extension = '.mp4') AS video_count, count(*) FILTER (extension = '.jpg') AS image_count, count(*) FILTER (extension = '.csv') AS data_count FROM files GROUP BY run_pk""", "files"))
def a12(spark, d):
    return RP.type_counters(t.files(spark, d))


@query("A13_category_groups", with_tables(f"SELECT source_id, {sql_pick(t.FOLDERS, 'part % 10')} AS category, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY ALL", "files"))
def a13(spark, d):
    return RP.category_groups(t.files(spark, d))


@query("A17_host_counts", with_tables("SELECT source_id, 'nation-' || substring(source_id, 5) || '.example.com' AS name, count(*) AS files FROM files GROUP BY source_id", "files"))
def a17(spark, d):
    return RP.host_counts(t.files(spark, d))


@query("A17_section_counts", with_tables("SELECT source_id, '/' || split_part(source_url, '/', 4) AS name, count(*) AS files FROM files GROUP BY ALL", "files"))
def a17b(spark, d):
    return RP.section_counts(t.files(spark, d))


@query("L3_top_extensions", with_tables("WITH c AS (SELECT source_id, substring(extension, 2) AS name, count(*) AS files FROM files GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY files DESC, name) AS place FROM c QUALIFY place <= 4", "files"))
def l3(spark, d):
    return RP.top_counts(RP.extension_counts(t.files(spark, d)), 4)


_RUN_VALUES = "v AS (SELECT source_id, extension AS value FROM files WHERE extension IS NOT NULL)"


# few distinct values: the merged sketches are exact
@query("A17_L3_merged_counts", with_tables(f"""WITH {_RUN_VALUES}, c AS (SELECT source_id, value, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS d, list(n ORDER BY n DESC)[1:3] AS top FROM c GROUP BY source_id)
SELECT source_id, n, d AS distinct_values, array_to_string(top, ',') AS top_counts FROM s""", "files"))
def a17c(spark, d):
    by_run = t.files(spark, d).withColumn("unit", F.struct("source_id", "run_pk"))
    sketches = IX.sketch_counts(by_run, "unit", F.col("extension")).select("unit.source_id", "n", "top", "distinct")
    merged = IX.merged_counts(sketches, ["source_id"], 3)
    counts = F.transform("top", lambda x: x["count"].cast("string"))
    return merged.select("source_id", "n", F.col("distinct").alias("distinct_values"), F.array_join(counts, ",").alias("top_counts"))


def _timeline(spark, d):
    counters = RP.run_counters(t.run_events(spark, d)).withColumnRenamed("run_id", "run_pk").drop("pages_crawled")
    keys, errors = t.runs(spark, d), t.errors(spark, d)
    # both joins by run before the names, so on one exchange
    runs = keys.join(counters, "run_pk", "left").join(RP.counted_errors(errors), "run_pk", "left").na.fill(0)
    runs = CT.run_list(runs, t.collectors(spark, d), t.sources(spark, d))
    return RP.run_timeline(runs, errors, keys)


@query("A22_run_timeline", with_tables(f"""WITH k AS ({_COUNT}), e AS (SELECT run_pk, count(*) AS n FROM errors GROUP BY run_pk),
r AS (SELECT runs.*, s.name AS source_name, s.slug AS source_slug, c.type AS ctype, coalesce(k.files_found, 0) AS ff, coalesce(k.files_downloaded, 0) AS fd, coalesce(k.files_duplicate, 0) AS fu, coalesce(k.files_failed, 0) AS fx, coalesce(e.n, 0) AS en
  FROM runs LEFT JOIN k ON runs.run_pk = k.run_id LEFT JOIN e ON runs.run_pk = e.run_pk LEFT JOIN sources s ON runs.source_id = s.source_id LEFT JOIN collectors c ON runs.collector_id = c.collector_id)
SELECT run_pk, 1 AS seq, 'STATUS' AS level, '[JOB_DISPATCH] Execution run ' || run_id || ' initialized for source ''' || source_name || '''' AS message FROM r
UNION ALL SELECT run_pk, 2, 'INFO', '[STORAGE_TARGET] Raw Zone Path: 00_raw/' || CASE WHEN ctype = 'TELEGRAM' THEN 'telegram' ELSE 'web' END || '/' || source_slug || '/' || run_id || '/' FROM r
UNION ALL SELECT run_pk, 3, 'INFO', '[CRAWLER] Scanned ' || pages_crawled || ' pages / channels' FROM r WHERE pages_crawled > 0
UNION ALL SELECT run_pk, 4, 'INFO', '[DISCOVERY] Located ' || format('{{:,}}', ff) || ' raw candidate files' FROM r WHERE ff > 0
UNION ALL SELECT run_pk, 5, 'SUCCESS', '[DOWNLOAD_SUCCESS] Processed & stored ' || format('{{:,}}', fd) || ' deduplicated artifacts' FROM r WHERE fd > 0
UNION ALL SELECT run_pk, 6, 'WARN', '[DEDUP_FILTER] Skipped ' || format('{{:,}}', fu) || ' SHA-256 duplicate artifacts' FROM r WHERE fu > 0
UNION ALL SELECT run_pk, 7, 'ERROR', '[FAILURE] ' || format('{{:,}}', fx) || ' files encountered errors during processing' FROM r WHERE fx > 0 AND en = 0
UNION ALL SELECT run_pk, 8, 'ERROR', '[WORKER_ERROR] ' || error_code || ': ' || message FROM errors WHERE run_pk IN (SELECT run_pk FROM runs)
UNION ALL SELECT run_pk, 9, CASE WHEN status = 'COMPLETED' THEN 'SUCCESS' WHEN status = 'FAILED' THEN 'STATUS' ELSE 'INFO' END, CASE WHEN status = 'RUNNING' THEN '[LIVE_TAIL] Listening for active worker callbacks' ELSE '[JOB_TERMINATED] Run status finalized to ' || status END FROM r""", "runs", "run_events", "errors", "sources", "collectors"))
def a22(spark, d):
    return _timeline(spark, d).select("run_pk", "seq", "level", "message")
