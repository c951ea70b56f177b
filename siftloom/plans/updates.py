"""Catalog change queries: next table versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions import files as FN
from siftloom.operators import changes as CH
from siftloom.operators import reports as RP
from siftloom.plans import tables as t
from siftloom.plans.registry import query
from siftloom.plans.tables import read, sql_pick, with_tables

CANON = "'Report_' || part || '_' || line || '-' || printf('RAW-%09d', part) || extension"
_PLAN = f"""p AS (SELECT *, {CANON} AS new_name, row_number() OVER (PARTITION BY sha256 ORDER BY created_at, file_pk) > 1 AS dup FROM files),
q AS (SELECT *, CASE WHEN original_filename IS NULL AND line = 3 AND part % 2 = 0 THEN new_name ELSE file_name END AS old_name FROM p)"""


def _numbered(spark, d):
    f = t.files(spark, d).withColumn("file_id", FN.format_file_id(F.col("part")))
    canonical = F.concat(F.lit("Report_"), "part", F.lit("_"), "line", F.lit("-"), "file_id", "extension")
    # half of the rows without an original name were renamed before
    return f.withColumn("file_name", F.when((F.col("line") == 3) & (F.col("part") % 2 == 0), canonical).otherwise(F.col("file_name")))


@query("P39_edit_files", with_tables("SELECT file_pk, CASE WHEN line = 1 THEN 'edited ' || part ELSE file_name END AS file_name, CASE WHEN line = 4 THEN '{}' ELSE metadata END AS metadata FROM files", "files"))
def p39(spark, d):
    f = t.files(spark, d)
    edits = f.where("line IN (1, 4)").select(
        "file_pk", F.expr("CASE WHEN line = 1 THEN 'edited ' || part END").alias("file_name"), F.expr("CASE WHEN line = 4 THEN '{}' END").alias("metadata")
    )
    return CH.edit_files(f, edits).select("file_pk", "file_name", "metadata")


@query("M1_process_preview", with_tables(f"WITH {_PLAN} SELECT file_pk, old_name, new_name, dup AS is_duplicate FROM q WHERE old_name <> new_name OR dup ORDER BY created_at, file_pk LIMIT 200", "files"))
def m1(spark, d):
    return CH.preview_processing(_numbered(spark, d)).select("file_pk", "old_name", "new_name", "is_duplicate")


@query("M1_process_apply", with_tables(f"WITH {_PLAN} SELECT file_pk, new_name AS file_name, CASE WHEN dup THEN 'DUPLICATE' ELSE status END AS status, dup AS marked FROM q", "files"))
def m1b(spark, d):
    out = CH.apply_processing(_numbered(spark, d))
    marked = F.get_json_object("metadata", "$.processing.duplicate") == "true"
    return out.select("file_pk", "file_name", "status", marked.alias("marked"))


@query("A19_processing_summary", with_tables(f"WITH {_PLAN} SELECT count(*) AS scanned, count(*) FILTER (old_name <> new_name OR dup) AS changed, count(*) FILTER (old_name <> new_name) AS renamed, count(*) FILTER (dup) AS duplicates FROM q", "files"))
def a19(spark, d):
    return CH.processing_summary(_numbered(spark, d))


@query("L4_processing_batch", with_tables("SELECT file_pk FROM files ORDER BY created_at, file_pk LIMIT 5000", "files"))
def l4(spark, d):
    return CH.oldest_batch(t.files(spark, d), 9999).select("file_pk")


def _upsert_tables(spark, d):
    base = t.text_files(spark, d).withColumns(
        {"status": F.lit("FAILED"), "metadata": F.lit("old"), "file_id": FN.format_file_id(F.col("doc_id")),
         "original_filename": F.col("file_name"), "canonical_filename": F.lit(None).cast("string"), "extension": F.lit(".txt")}
    )
    columns = ["file_pk", "file_id", "run_pk", "source_id", "file_name", "original_filename", "canonical_filename",
               "extension", "sha256", "storage_key", "status", "metadata"]
    catalog = base.where("doc_id % 2 = 0").select(*columns)
    # a third asks for the key of the row before, some share a key or lack a hash, key, run or metadata
    before = F.concat(F.lit("00_raw/web/"), "source_id", F.lit("/run_"), (F.col("doc_id") - 1) % 10, F.lit("/text/"), F.col("doc_id") - 1, F.lit(".txt"))
    key = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("shared/"), (F.col("doc_id") % 13).cast("string"))).when(F.col("doc_id") % 17 == 0, None).when(
        F.col("doc_id") % 3 == 0, before).otherwise(F.col("storage_key"))
    incoming = base.where("doc_id % 2 = 1").select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 5 != 0, F.col("run_pk")).alias("run_pk"), "source_id", "file_name",
        F.when(F.col("doc_id") % 19 != 0, F.col("sha256")).alias("sha256"), "extension", key.alias("storage_key"),
        F.when(F.col("doc_id") % 7 == 0, "DUPLICATE").otherwise("UPLOADED").alias("status"),
        F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("new "), "doc_id")).alias("metadata"),
    )
    return catalog, incoming


# the list of files is carried from one incoming row to the next
@query("M2_record_upsert", with_tables("""SELECT * FROM (WITH RECURSIVE c AS (SELECT * FROM text_files WHERE doc_id % 2 = 0),
i AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS seq, CASE WHEN doc_id % 5 <> 0 THEN run_pk END AS run, CASE WHEN doc_id % 19 <> 0 THEN sha256 END AS sha,
  CASE WHEN doc_id % 11 = 0 THEN 'shared/' || (doc_id % 13) WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '00_raw/web/' || source_id || '/run_' || ((doc_id - 1) % 10) || '/text/' || (doc_id - 1) || '.txt' ELSE storage_key END AS key,
  CASE WHEN doc_id % 7 = 0 THEN 'DUPLICATE' ELSE 'UPLOADED' END AS status, CASE WHEN doc_id % 9 <> 0 THEN 'new ' || doc_id END AS meta FROM text_files WHERE doc_id % 2 = 1),
s AS (SELECT CAST(0 AS BIGINT) AS n, (SELECT list({'id': doc_id, 'seq': CAST(NULL AS BIGINT), 'sha': sha256, 'key': storage_key, 'run': run_pk, 'status': 'FAILED', 'meta': 'old'} ORDER BY file_pk) FROM c) AS files
UNION ALL SELECT n, CASE WHEN hit IS NULL THEN list_append(files, {'id': CAST(NULL AS BIGINT), 'seq': seq, 'sha': sha, 'key': key, 'run': run, 'status': status, 'meta': meta})
  ELSE files[1 : hit - 1] || [{'id': files[hit].id, 'seq': files[hit].seq, 'sha': files[hit].sha, 'key': coalesce(key, files[hit].key), 'run': coalesce(run, files[hit].run), 'status': status, 'meta': coalesce(meta, files[hit].meta)}] || files[hit + 1 :] END
  FROM (SELECT i.*, s.files, CASE WHEN status <> 'DUPLICATE' THEN list_position(list_transform(files, lambda f: coalesce(f.sha = i.sha, false) OR coalesce(f.key = i.key, false)), true) END AS hit FROM s JOIN i ON i.n = s.n + 1)),
e AS (SELECT unnest(files, recursive := true) FROM s WHERE n = (SELECT max(n) FROM i)),
nxt AS (SELECT greatest(max(doc_id), count(*)) AS n FROM c)
SELECT printf('RAW-%09d', CASE WHEN id IS NOT NULL THEN id ELSE nxt.n + row_number() OVER (PARTITION BY id IS NULL ORDER BY seq) END) AS file_id, status, meta AS metadata, key AS storage_key, run AS run_pk FROM e, nxt)""", "text_files"))
def m2(spark, d):
    catalog, incoming = _upsert_tables(spark, d)
    return CH.upsert_files(catalog, incoming).select("file_id", "status", "metadata", "storage_key", "run_pk")


@query("M3_manual_upload", with_tables(f"""WITH u AS (SELECT *, row_number() OVER (ORDER BY file_pk) AS r, row_number() OVER (PARTITION BY sha256 ORDER BY file_pk) > 1 AS again FROM files WHERE line = 6), c AS (SELECT * FROM files WHERE line < 3),
n AS (SELECT greatest(max(part), count(*)) AS n FROM c)
SELECT file_pk, printf('RAW-%09d', r + n) AS file_id, CASE WHEN again OR sha256 IN (SELECT sha256 FROM c) THEN 'DUPLICATE' ELSE 'UPLOADED' END AS status,
  CASE WHEN NOT again AND sha256 NOT IN (SELECT sha256 FROM c) THEN '00_raw/manual/nation_' || substring(source_id, 5) || '/' || {sql_pick(['pdf', 'documents', 'ebooks', 'text', 'data', 'images', 'video', 'text', 'text', 'archives'], 'part % 10')} || '/Report_' || part || '_6-' || printf('RAW-%09d', r + n) || extension END AS storage_key FROM u, n""", "files"))
def m3(spark, d):
    f = t.files(spark, d).withColumn("file_id", FN.format_file_id(F.col("part")))
    uploads = f.where("line = 6").select("file_pk", "source_id", "file_name", "mime_type", "file_size", "sha256")
    out = CH.manual_uploads(uploads, f.where("line < 3"), t.sources(spark, d), [F.col("file_pk")])
    return out.select("file_pk", "file_id", "status", "storage_key")


@query("M4_manual_entry", """WITH n AS (SELECT greatest(max(l_partkey), count(*)) AS n FROM lineitem)
SELECT printf('RAW-%09d', row_number() OVER (ORDER BY p_partkey) + n) AS file_id, p_name AS file_name, 'DISCOVERED' AS status, 'MANUAL_ENTRY' AS origin FROM part, n""")
def m4(spark, d):
    entries = read(spark, d, "part").select(F.col("p_partkey"), F.col("p_name").alias("file_name"))
    f = t.files(spark, d).withColumn("file_id", FN.format_file_id(F.col("part")))
    return CH.manual_entries(entries, f, [F.col("p_partkey")]).select("file_id", "file_name", "status", "origin")


@query("M5_approve_files", with_tables("SELECT file_pk, CASE WHEN part % 4 = 0 THEN 'REJECTED' ELSE approval_status END AS approval_status, CASE WHEN part % 4 = 0 THEN 'u1' END AS approved_by, CASE WHEN part % 4 = 0 THEN 'bad scan' END AS approval_notes FROM files", "files"))
def m5(spark, d):
    f = t.files(spark, d)
    out = CH.approve_rows(f, f.where("part % 4 = 0").select("file_pk"), "file_pk", "REJECTED", "u1", F.lit("2024-01-01"), "bad scan")
    return out.select("file_pk", "approval_status", "approved_by", "approval_notes")


@query("M5_approve_run", with_tables("SELECT 'file' AS what, file_pk AS pk, CASE WHEN run_pk = 'run-77' THEN 'APPROVED' ELSE approval_status END AS approval_status FROM files UNION ALL SELECT 'run', run_pk, CASE WHEN run_pk = 'run-77' THEN 'APPROVED' ELSE approval_status END FROM runs", "files", "runs"))
def m5b(spark, d):
    r, f = CH.approve_run(t.runs(spark, d), t.files(spark, d), "run-77", "APPROVED", "u1", F.lit("2024-01-01"))
    return f.select(F.lit("file").alias("what"), F.col("file_pk").alias("pk"), "approval_status").union(r.select(F.lit("run"), "run_pk", "approval_status"))


_RECOUNT = """SELECT r.run_pk, count(*) FILTER (f.status = 'UPLOADED') AS files_downloaded, count(f.file_pk) AS files_found, count(*) FILTER (f.status = 'DUPLICATE') AS files_duplicate, count(*) FILTER (f.status = 'FAILED') AS files_failed
FROM runs r LEFT JOIN {} f ON r.run_pk = f.run_pk GROUP BY r.run_pk"""
_COUNTERS = ("run_pk", "files_downloaded", "files_found", "files_duplicate", "files_failed")


@query("A4_run_recount", with_tables(_RECOUNT.format("files"), "runs", "files"))
def a4(spark, d):
    return CH.recount_runs(t.runs(spark, d), t.files(spark, d)).select(*_COUNTERS)


@query("M7_delete_files", with_tables("WITH k AS (SELECT * FROM files WHERE part % 6 <> 0) " + _RECOUNT.format("k"), "runs", "files"))
def m7(spark, d):
    f = t.files(spark, d)
    left = CH.delete_files(f, f.where("part % 6 = 0").select("file_pk"))
    return CH.recount_runs(t.runs(spark, d), left).select(*_COUNTERS)


_GONE = "extension = '.zip' OR NOT (extension IN ('.pdf', '.epub') OR extension = '.mp4' OR mime_type LIKE 'video/%') OR extension NOT IN ('.pdf', '.mp4', '.zip')"
_OPTIONS = {"delete_extensions": ["ZIP"], "keep_categories": ["books", "video"], "keep_extensions": ["pdf", ".mp4", "zip"]}


@query("M8_prune_run", with_tables(f"SELECT file_pk FROM files WHERE NOT (source_id IN ('src-1', 'src-2') AND ({_GONE}))", "files"))
def m8(spark, d):
    return CH.prune_files(t.files(spark, d), F.col("source_id").isin("src-1", "src-2"), **_OPTIONS).select("file_pk")


@query("A18_prune_summary", with_tables(f"SELECT run_pk, count(*) FILTER ({_GONE}) AS pruned, count(*) FILTER (NOT ({_GONE})) AS remaining, CAST(coalesce(sum(file_size) FILTER ({_GONE}), 0) AS BIGINT) AS bytes_freed FROM files GROUP BY run_pk", "files"))
def a18(spark, d):
    return CH.prune_summary(t.files(spark, d), **_OPTIONS)


@query("M9_heal_file_ids", with_tables("""WITH f AS (SELECT file_pk, part, created_at, line = 2 AND part % 5 = 0 AS bad FROM files), n AS (SELECT greatest(max(part) FILTER (NOT bad), count(*)) AS n FROM f)
SELECT file_pk, printf('RAW-%09d', part) AS file_id FROM f WHERE NOT bad UNION ALL SELECT file_pk, printf('RAW-%09d', row_number() OVER (ORDER BY created_at, file_pk) + n) FROM f, n WHERE bad""", "files"))
def m9(spark, d):
    bad = (F.col("line") == 2) & (F.col("part") % 5 == 0)
    f = t.files(spark, d).select("file_pk", "created_at", F.when(bad, F.lit("RAW-UNKNOWN")).otherwise(FN.format_file_id(F.col("part"))).alias("file_id"))
    return CH.heal_file_ids(f).select("file_pk", "file_id")


@query("M12_cascade_delete_source", with_tables("""WITH k AS (SELECT source_id FROM sources WHERE source_id IN ('src-2', 'src-5', 'src-9') AND source_id NOT IN (SELECT source_id FROM runs WHERE status = 'RUNNING' AND n % 4 = 0)),
r AS (SELECT * FROM runs WHERE n % 4 <> 0 OR status <> 'RUNNING' OR source_id = 'src-5')
SELECT 'sources' AS what, source_id AS pk FROM sources WHERE source_id NOT IN (SELECT g FROM gone) UNION ALL SELECT 'collectors', collector_id FROM collectors WHERE source_id NOT IN (SELECT g FROM gone)
UNION ALL SELECT 'runs', run_pk FROM rr WHERE source_id NOT IN (SELECT g FROM gone) UNION ALL SELECT 'files', file_pk FROM files WHERE source_id NOT IN (SELECT g FROM gone) AND run_pk NOT IN (SELECT run_pk FROM rr WHERE source_id IN (SELECT g FROM gone))
UNION ALL SELECT 'errors', error_id FROM errors WHERE run_pk NOT IN (SELECT run_pk FROM rr WHERE source_id IN (SELECT g FROM gone))""".replace(
    "WITH k AS", "WITH rr AS (SELECT * FROM runs WHERE status <> 'RUNNING' OR source_id = 'src-5'), gone AS (SELECT unnest(['src-2', 'src-9']) AS g), k AS"), "sources", "collectors", "runs", "files", "errors"))
def m12(spark, d):
    keys = t.sources(spark, d).where(F.col("source_id").isin("src-2", "src-5", "src-9")).select("source_id")
    # only src-5 has runs in progress, so only it is protected
    runs = t.runs(spark, d).where("status <> 'RUNNING' OR source_id = 'src-5'")
    out = CH.cascade_delete_source(keys, t.sources(spark, d), t.collectors(spark, d), runs, t.files(spark, d), t.errors(spark, d))
    keys = {"sources": "source_id", "collectors": "collector_id", "runs": "run_pk", "files": "file_pk", "errors": "error_id"}
    rows = [df.select(F.lit(name).alias("what"), F.col(keys[name]).alias("pk")) for name, df in out.items()]
    total = rows[0]
    for row in rows[1:]:
        total = total.union(row)
    return total


@query("M12_deletion_guard", with_tables("""SELECT s.source_id, (SELECT count(*) FROM collectors c WHERE c.source_id = s.source_id) AS collectors, (SELECT count(*) FROM runs r WHERE r.source_id = s.source_id) AS runs,
  (SELECT count(*) FROM runs r WHERE r.source_id = s.source_id AND r.status = 'RUNNING') AS active_runs, (SELECT count(*) FROM runs r WHERE r.source_id = s.source_id AND r.status = 'RUNNING') = 0 AS deletable FROM sources s""", "sources", "collectors", "runs"))
def m12b(spark, d):
    return CH.deletion_guard(t.sources(spark, d), t.collectors(spark, d), t.runs(spark, d))


@query("M12_cascade_delete_runs", with_tables("""WITH g AS (SELECT run_pk FROM runs WHERE n % 5 = 0 AND status <> 'RUNNING')
SELECT 'runs' AS what, run_pk AS pk FROM runs WHERE run_pk NOT IN (SELECT * FROM g) UNION ALL SELECT 'files', file_pk FROM files WHERE run_pk NOT IN (SELECT * FROM g) UNION ALL SELECT 'errors', error_id FROM errors WHERE run_pk NOT IN (SELECT * FROM g)""", "runs", "files", "errors"))
def m12c(spark, d):
    runs = t.runs(spark, d)
    out = CH.cascade_delete_runs(runs.where("n % 5 = 0").select("run_pk"), runs, t.files(spark, d), t.errors(spark, d))
    n = lambda name, key: out[name].select(F.lit(name).alias("what"), F.col(key).alias("pk"))
    return n("runs", "run_pk").union(n("files", "file_pk")).union(n("errors", "error_id"))


@query("M15_recover_sources", with_tables("""SELECT slug, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_nationkey ELSE 'Proper Name' END AS name FROM (SELECT n_nationkey, lower(n_name) AS slug FROM nation)
UNION ALL SELECT DISTINCT 'src' || (doc_id % 20) || '-com', 'Src' || (doc_id % 20) FROM documents"""))
def m15(spark, d):
    s = t.sources(spark, d)
    number = F.regexp_extract("slug", "([0-9]+)$", 1).cast("int")
    s = s.withColumn("name", F.when(number % 2 == 0, F.upper("name")).otherwise("Proper Name"))
    seen = read(spark, d, "documents").select(
        F.concat(F.lit("src"), F.col("doc_id") % 20, F.lit("-com")).alias("slug"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("base_url")
    )
    # slugs already in the catalog are repaired, not created again
    known = s.select("slug", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("base_url"))
    return CH.recover_sources(s, seen.union(known)).select("slug", "name")


@query("M16_patch_sources", with_tables("""SELECT source_id, CASE WHEN n = 3 THEN 'fresh' WHEN n = 8 THEN slug ELSE slug END AS slug, CASE WHEN n IN (3, 6) THEN false ELSE enabled END AS enabled FROM (SELECT *, CAST(substring(source_id, 5) AS INTEGER) AS n FROM sources)""", "sources"))
def m16(spark, d):
    s = t.sources(spark, d)
    n = F.substring("source_id", 5, 9).cast("int")
    patches = s.where(n.isin(3, 6, 8)).select(
        # 8 asks for a slug that belongs to 1 and is refused
        "source_id", F.when(n == 3, "fresh").when(n == 8, "nation_1").alias("slug"), F.when(n != 8, F.lit(False)).when(n == 8, F.lit(False)).alias("enabled")
    )
    return CH.patch_rows(s, patches, "source_id", unique="slug").select("source_id", "slug", "enabled")


@query("A5_error_counts", with_tables("SELECT r.run_pk, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN (SELECT count(*) FROM errors e WHERE e.run_pk = r.run_pk) END AS error_count FROM runs r", "runs", "errors"))
def a5(spark, d):
    return RP.refresh_error_counts(t.runs(spark, d), t.errors(spark, d)).select("run_pk", "error_count")
