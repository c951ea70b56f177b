"""Storage, manifest, recovery and stream-twin queries over columns built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import files as FN
from siftloom.operators import changes as CH
from siftloom.operators import dedup as DD
from siftloom.operators import links as LK
from siftloom.plans import tables as t
from siftloom.plans.registry import query
from siftloom.plans.tables import read, with_tables
from siftloom.plans.web import QUALITY_SQL
from siftloom.session import scratch_folder
from siftloom.sources import schemas
from siftloom.sources import sinks as SK
from siftloom.sources import storage as ST

LINE = "CASE doc_id % 4 WHEN 0 THEN '{\"digest\":\"' || md5(text) || '\"}' WHEN 1 THEN '  broken {' || md5(text) WHEN 2 THEN '   ' ELSE '[' || doc_id || ']' END"


@query("S2_tolerant_lines", f"""WITH l AS (SELECT doc_id, trim({LINE}) AS v FROM documents)
SELECT doc_id, CASE WHEN v LIKE 'broken%' THEN '{{"raw":"' || v || '"}}' ELSE v END AS line, v NOT LIKE 'broken%' AS is_json FROM l WHERE v <> ''""")
def s2(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.expr(LINE).alias("value"))
    return ST.tolerant_lines(lines).select("doc_id", "line", "is_json")


_RUNS = """r AS (SELECT 'run-' || o_orderkey AS run_pk, 'day_run_' || o_orderkey AS run_id, 'n' || (o_custkey % 25) AS slug, o_orderkey AS n,
  CASE WHEN o_orderkey % 11 = 0 THEN 'kept/' || o_orderkey || '/manifest.json' END AS manifest_key FROM orders)"""


def _manifest_tables(spark, d):
    o = read(spark, d, "orders")
    runs = o.select(
        F.concat(F.lit("run-"), "o_orderkey").alias("run_pk"), F.concat(F.lit("day_run_"), "o_orderkey").alias("run_id"),
        F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("slug"), F.lit("WEB").alias("collector_type"), F.col("o_orderkey").alias("n"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'kept/' || o_orderkey || '/manifest.json' END").alias("manifest_key"))
    body = F.expr("CASE WHEN n % 7 = 0 THEN 'broken ' || n ELSE '{\"run_id\":\"' || run_id || '\",\"files_found\":' || (n % 9) || '}' END")
    places = F.expr("""filter(array(CASE WHEN n % 22 = 0 THEN manifest_key END, CASE WHEN n % 3 = 0 THEN '00_raw/web/' || slug || '/' || run_id || '/manifest.json' END,
      CASE WHEN n % 5 = 0 THEN slug || '/' || run_id || '/manifest.json' END), x -> x is not null)""")
    objects = runs.select(F.explode(places).alias("key"), F.encode(body, "UTF-8").alias("content"))
    return runs, objects


@query("S3_manifest_precedence", f"""WITH {_RUNS} SELECT run_pk, CASE WHEN n % 22 = 0 THEN manifest_key WHEN n % 3 = 0 THEN '00_raw/web/' || slug || '/' || run_id || '/manifest.json' ELSE slug || '/' || run_id || '/manifest.json' END AS manifest_key,
  CASE WHEN n % 7 <> 0 THEN n % 9 END AS files_found, CASE WHEN n % 7 = 0 THEN 'broken ' || n END AS raw FROM r WHERE n % 22 = 0 OR n % 3 = 0 OR n % 5 = 0""")
def s3(spark, d):
    runs, objects = _manifest_tables(spark, d)
    return ST.read_manifests(runs, objects).select("run_pk", "manifest_key", "manifest.files_found", "raw")


@query("S6_plain_text", "SELECT doc_id, md5(text || chr(65533)) AS digest, length(text) + 1 AS chars FROM documents")
def s6(spark, d):
    # a byte that is no text goes, a replacement character of the file stays
    content = F.concat(F.unhex(F.lit("FF")), F.encode(F.concat("text", F.lit("�")), "UTF-8"), F.unhex(F.lit("C3")))
    text = ST.plain_text(content)
    return read(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("chars"))


@query("S9_json_previews", with_tables("""SELECT file_pk, doc_id % 3 <> 1 AS is_json, CASE doc_id % 3 WHEN 0 THEN '{"n":' || doc_id || '}' WHEN 2 THEN
  '{"file_name":"' || file_name || '","file_size":' || file_size || ',"sha256":"' || sha256 || '","storage_key":"' || storage_key || '","source_url":"' || source_url || '"}' END AS data,
  CASE WHEN doc_id % 3 = 1 THEN 'no json ' || doc_id END AS raw FROM text_files""", "text_files"))
def s9(spark, d):
    files = t.text_files(spark, d).withColumn("metadata", F.lit("{}"))
    body = F.expr("CASE doc_id % 3 WHEN 0 THEN '{\"n\":' || doc_id || '}' ELSE 'no json ' || doc_id END")
    objects = files.where("doc_id % 3 < 2").select(F.col("storage_key").alias("key"), F.encode(body, "UTF-8").alias("content"))
    return ST.json_previews(files.drop("text", "lang"), objects)


_SIGNS = [s for s in rules.MAGIC_SIGNATURES if s[1] == 0][:8]


@query("P25_sniffed_types", "SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{s[2]}'" for i, s in enumerate(_SIGNS)) + " WHEN 8 THEN 'text/x-own' ELSE 'application/octet-stream' END AS mime FROM documents")
def p25(spark, d):
    head = F.expr("CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN unhex('{s[0]}')" for i, s in enumerate(_SIGNS)) + " ELSE unhex('') END")
    content = F.concat(head, F.encode(F.concat(F.lit("  "), "text"), "UTF-8"))
    declared = F.expr("CASE WHEN doc_id % 10 = 8 THEN 'Text/X-Own; charset=utf-8' END")
    return read(spark, d, "documents").select("doc_id", FN.resolve_mime(content, declared, F.lit(None).cast("string")).alias("mime"))


@query("M6_approve_lines", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"digest":"' || md5(text) || '","approval_status":"APPROVED","approved_by":"u1","approved_at":"2024-05-01"}'
  WHEN 1 THEN '{"a":' || doc_id || ',"approval_status":"APPROVED","approved_by":"u1","approved_at":"2024-05-01"}' ELSE 'bad ' || doc_id END AS value FROM documents""")
def m6(spark, d):
    value = """CASE doc_id % 3 WHEN 0 THEN '{"digest":"' || md5(text) || '"}' WHEN 1 THEN '{"a":' || doc_id || ',"approval_status":"PENDING","approved_by":"old"}' ELSE 'bad ' || doc_id END"""
    lines = read(spark, d, "documents").select("doc_id", F.expr(value).alias("value"))
    return CH.approve_metadata_lines(lines, "APPROVED", "u1", F.lit("2024-05-01")).select("doc_id", "value")


@query("M10_recovered_runs", f"""WITH {_RUNS} SELECT run_id, slug AS source_slug, CAST(n % 9 AS INTEGER) AS files_found, '00_raw/web/' || slug || '/' || run_id || '/manifest.json' AS manifest_key FROM r WHERE n % 2 = 1""")
def m10(spark, d):
    runs, _ = _manifest_tables(spark, d)
    key = F.expr("'00_raw/web/' || slug || '/' || run_id || '/manifest.json'")
    text = F.expr("'{\"run_id\":\"' || run_id || '\",\"files_found\":' || (n % 9) || '}'")
    manifests = runs.select(key.alias("key"), text.alias("text"))
    return ST.recover_runs(manifests, runs.where("n % 2 = 0")).select("run_id", "source_slug", "files_found", "manifest_key")


@query("M11_recovered_files", with_tables("""WITH c AS (SELECT * FROM text_files WHERE doc_id % 2 = 0), u AS (SELECT sha256, min(storage_key) AS storage_key FROM text_files WHERE doc_id % 2 = 1 GROUP BY sha256)
SELECT sha256, storage_key FROM u WHERE sha256 NOT IN (SELECT sha256 FROM c)""", "text_files"))
def m11(spark, d):
    files = t.text_files(spark, d)
    candidates = files.where("doc_id % 2 = 1").select("sha256", "storage_key", "file_name")
    return ST.recover_files(candidates, files.where("doc_id % 2 = 0")).select("sha256", "storage_key")


@query("M11_attached_orphans", with_tables("SELECT file_pk, CASE WHEN doc_id % 4 = 0 THEN 'pk-' || (doc_id % 10) ELSE 'own' END AS run_pk FROM text_files", "text_files"))
def m11b(spark, d):
    files = t.text_files(spark, d)
    runs = files.select(F.upper("run_pk").alias("run_id"), F.concat(F.lit("pk-"), F.col("doc_id") % 10).alias("run_pk")).distinct()
    orphans = files.withColumn("run_pk", F.expr("CASE WHEN doc_id % 4 <> 0 THEN 'own' END"))
    return ST.attach_orphans(orphans.drop("text"), runs).select("file_pk", "run_pk")


# keys claimed so far are carried from one incoming row to the next
@query("T3_admitted_files", with_tables("""SELECT pk AS file_pk FROM (WITH RECURSIVE f AS (SELECT *, source_id || ' ' || CASE WHEN doc_id % 4 = 1 THEN 'https://shared/' || (doc_id % 37) ELSE source_url END AS url FROM text_files),
c AS (SELECT * FROM f WHERE doc_id % 2 = 0),
i AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, file_pk, url, sha256 FROM f WHERE doc_id % 2 = 1 AND url NOT IN (SELECT url FROM c) AND sha256 NOT IN (SELECT sha256 FROM c)),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS pk
UNION ALL SELECT i.n, CASE WHEN list_has_any(seen, [url, sha256]) THEN seen ELSE seen || [url, sha256] END, CASE WHEN NOT list_has_any(seen, [url, sha256]) THEN file_pk END FROM s JOIN i ON i.n = s.n + 1)
SELECT pk FROM s WHERE pk IS NOT NULL)""", "text_files"))
def t3(spark, d):
    shared = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://shared/"), (F.col("doc_id") % 37).cast("string"))).otherwise(F.col("source_url"))
    files = t.text_files(spark, d).withColumns({"status": F.lit("UPLOADED"), "source_url": shared})
    return DD.admitted(files.where("doc_id % 2 = 1"), files.where("doc_id % 2 = 0"), "doc_id").select("file_pk")


@query("S10_S11_written_lines", with_tables("SELECT run_pk AS run, source_id AS category, count(*) AS lines, sum(file_size) AS bytes FROM text_files GROUP BY ALL", "text_files"))
def s10(spark, d):
    out = scratch_folder(spark)
    files = t.text_files(spark, d).select("run_pk", "file_pk", "file_size", F.col("source_id").alias("category"))
    SK.write_metadata(files, out)
    back = spark.read.schema("run string, category string, file_pk string, file_size long").json(f"{out}/categories")
    return back.groupBy("run", "category").agg(F.count("*").alias("lines"), F.sum("file_size").alias("bytes"))


@query("S1_catalog_read", with_tables("SELECT source_id, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, count(DISTINCT extension) AS kinds FROM files WHERE status = 'FAILED' GROUP BY source_id", "files"))
def s1_read(spark, d):
    root, files = scratch_folder(spark), t.files(spark, d)
    files.select(*[c for c in files.columns if c in schemas.FILES]).write.parquet(f"{root}/files")
    back = ST.read_catalog(spark, root, "files").where("status = 'FAILED'")
    return back.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.countDistinct("extension").alias("kinds"))


@query("S4_storage_tree", """SELECT 'source=' || source || '/part=' || (doc_id % 4) AS folder, 'content' AS kind, CAST(sum(strlen(text) + 1) AS BIGINT) AS size,
  sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source, doc_id % 4""")
def s4(spark, d):
    out = scratch_folder(spark)
    docs = read(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 4).alias("part"), F.col("text").alias("value"))
    docs.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").drop("doc_id").write.partitionBy("source", "part").text(out)
    found = ST.read_storage(spark, f"{out}").where(F.col("key").endswith(".txt"))
    return found.select(F.regexp_extract("key", "(source=[^/]*/part=[^/]*)/", 1).alias("folder"), "kind", "size", "sha256")


@query("S12_written_records", f"WITH {QUALITY_SQL} SELECT regexp_extract(regexp_extract(url, '://([^/?#:]+)', 1), '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS records, CAST(sum(words) AS BIGINT) AS words FROM q GROUP BY ALL")
def s12(spark, d):
    out = scratch_folder(spark)
    records = SK.record_keys(LK.web_page_records(read(spark, d, "pages")), F.lit("00_raw/web/run"))
    SK.write_records(records.select("title", "source_domain", "word_count", "record_sha", "storage_key"), out)
    back = spark.read.schema("title string, word_count long, record_sha string, storage_key string, domain string").json(f"{out}/data/web_content")
    sound = F.col("storage_key").startswith("00_raw/web/run/data/web_content/") & F.contains("storage_key", F.substring("record_sha", 1, 8))
    return back.where(sound).groupBy("domain").agg(F.count("*").alias("records"), F.sum("word_count").alias("words"))


@query("S13_speech_datasets", with_tables("""SELECT medium_id, count(*) AS segments, md5('Source: ' || min(title) || chr(10) || 'URL: ' || min(source_url) || chr(10) || chr(10)
  || string_agg('[' || printf('%.1f', start_s) || 's - ' || printf('%.1f', end_s) || 's] ' || coalesce(speaker, 'Speaker') || ': ' || transcript, chr(10) ORDER BY chunk_index) || chr(10)) AS transcript FROM segments GROUP BY medium_id""", "segments"))
def s13(spark, d):
    out = scratch_folder(spark)
    SK.write_speech_datasets(t.segments(spark, d), out)
    stt = spark.read.schema("chunk_id string, medium_id string").json(f"{out}/stt").groupBy("medium_id").agg(F.count("*").alias("segments"))
    text = spark.read.text(f"{out}/transcript", wholetext=True)
    return stt.join(text.select("medium_id", F.md5("value").alias("transcript")), "medium_id")


@query("T4_ingested_pages", f"WITH {QUALITY_SQL} SELECT page_id, regexp_extract(pages.url, '^([^#]*)', 1) AS canonical_url FROM q JOIN pages USING (page_id) WHERE reason = 'accepted'")
def t4(spark, d):
    return LK.usable_pages(LK.web_page_records(read(spark, d, "pages"))).select("page_id", "canonical_url")
