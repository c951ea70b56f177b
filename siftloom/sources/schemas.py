"""Schemas of the catalog tables and of the JSON records."""

from __future__ import annotations

SOURCES = (
    "source_id string, name string, slug string, base_url string, description string, "
    "enabled boolean, robots_policy string, created_at timestamp"
)
COLLECTORS = (
    "collector_id string, source_id string, name string, type string, enabled boolean, "
    "version string, schedule string, configuration string"
)
RUNS = (
    "run_pk string, collector_id string, source_id string, run_id string, status string, "
    "approval_status string, started_at timestamp, completed_at timestamp, files_found int, "
    "files_downloaded int, files_skipped int, files_duplicate int, files_failed int, "
    "pages_crawled int, error_count int, manifest_key string, created_at timestamp"
)
FILES = (
    "file_pk string, file_id string, run_pk string, source_id string, source_url string, "
    "final_url string, file_name string, original_filename string, canonical_filename string, "
    "extension string, mime_type string, file_size bigint, sha256 string, storage_key string, "
    "status string, origin string, approval_status string, approved_by string, "
    "approved_at timestamp, approval_notes string, metadata string, created_at timestamp"
)
ERRORS = (
    "error_id string, run_pk string, file_pk string, error_code string, message string, "
    "url string, retry_count int, created_at timestamp"
)
AUDIT = (
    "audit_id string, user_id string, action string, entity_type string, entity_id string, "
    "created_at timestamp"
)
CATALOG = {
    "sources": SOURCES, "collectors": COLLECTORS, "runs": RUNS, "files": FILES,
    "errors": ERRORS, "audit_logs": AUDIT,
}

MANIFEST = (
    "run_id string, source string, source_name string, source_slug string, target_slug string, "
    "base_url string, start_url string, collector_name string, status string, started_at string, "
    "completed_at string, files_found bigint, files_downloaded bigint, files_duplicate bigint, "
    "files_failed bigint, pages_crawled bigint, total_bytes bigint, "
    "stats struct<pages_crawled:bigint,pages_visited:bigint,files_downloaded:bigint,"
    "total_files:bigint,files_found:bigint,files_duplicate:bigint,files_failed:bigint,"
    "total_bytes:bigint>"
)

METADATA_LINE = (
    "file_id string, source_slug string, run_id string, file_name string, title string, "
    "relative_path string, r2_key string, extension string, mime_type string, file_size bigint, "
    "size bigint, sha256 string, url string, source_url string, final_url string, "
    "original_filename string"
)
