"""File, record and catalog queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import conformance as C
from siftloom.functions import files as FN
from siftloom.functions import html as H
from siftloom.operators import catalog as CT
from siftloom.operators import dedup as DD
from siftloom.operators import indexes as IX
from siftloom.operators import integrity as IG
from siftloom.plans import tables as t
from siftloom.plans.registry import query
from siftloom.plans.tables import read, sql_pick, with_tables
from siftloom.session import scratch_folder


@query("S1_catalog_scan", with_tables("SELECT source_id, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM files WHERE status = 'UPLOADED' AND created_at >= TIMESTAMP '1998-01-01' GROUP BY source_id", "files"))
def s1(spark, d):
    f = t.files(spark, d).where("status = 'UPLOADED' AND created_at >= TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return f.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


KEY = """CASE l_partkey % 8 WHEN 0 THEN '00_raw/web/src' || l_suppkey || '/run_' || l_orderkey || '/pdf/a.pdf' WHEN 1 THEN 'raw/src' || l_suppkey || '/r' || l_orderkey || '/b.txt'
  WHEN 2 THEN 'telegram/chan' || l_suppkey || '/r' || l_orderkey || '/c.json' WHEN 3 THEN 'src' || l_suppkey || '/r' || l_orderkey || '/d.pdf' WHEN 4 THEN '00_raw/src' || l_suppkey || '/e.pdf'
  WHEN 5 THEN 'src' || l_suppkey || '/20240101_run_000001.json' WHEN 6 THEN '/00_raw/web/src' || l_suppkey || '/folder' ELSE 'src' || l_suppkey END"""


@query("S5_storage_keys", f"""SELECT l_partkey % 8 AS layout, {KEY} AS key, CASE l_partkey % 8 WHEN 2 THEN 'chan' || l_suppkey ELSE 'src' || l_suppkey END AS source_slug,
  CASE l_partkey % 8 WHEN 0 THEN 'run_' || l_orderkey WHEN 1 THEN 'r' || l_orderkey WHEN 2 THEN 'r' || l_orderkey WHEN 3 THEN 'r' || l_orderkey WHEN 5 THEN '20240101_run_000001.json' WHEN 6 THEN 'folder' END AS run_key FROM lineitem""")
def s5(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_partkey") % 8).alias("layout"), F.expr(KEY).alias("key"))
    return li.select("layout", "key", FN.storage_key_parts(F.col("key")).alias("p")).select("layout", "key", "p.*")


# --- conformance -------------------------------------------------------------

CONFIG = """CASE WHEN s_suppkey % 20 = 0 THEN '{bad' WHEN s_suppkey % 4 = 1 THEN '{"channels":["c' || s_suppkey || '"],"messageLimit":' || (s_suppkey * 1500) || ',"includeMediaTypes":["' || CASE WHEN s_suppkey % 3 = 0 THEN 'gif' ELSE 'photo' END || '"]}'
  WHEN s_suppkey % 4 = 2 THEN '{"audioChunkSeconds":' || (s_suppkey % 400) || '}' WHEN s_suppkey % 4 = 3 THEN '{"startUrls":[],"maxDepth":' || (s_suppkey % 30) || '}'
  ELSE '{"startUrls":["https://s' || s_suppkey || '.example.com"],"concurrency":' || (s_suppkey % 50) || ',"maxRetries":' || (s_suppkey % 13) || '}' END"""


@query("P16_collector_config", """SELECT 'col-' || s_suppkey AS collector_id, CASE WHEN s_suppkey % 20 = 0 THEN 'configuration:json' ELSE array_to_string([v for v in CASE s_suppkey % 4
  WHEN 1 THEN [CASE WHEN s_suppkey * 1500 > 100000 THEN 'messageLimit:range' END, CASE WHEN s_suppkey % 3 = 0 THEN 'includeMediaTypes:value' END]
  WHEN 2 THEN [CASE WHEN s_suppkey % 400 NOT BETWEEN 1 AND 300 THEN 'audioChunkSeconds:range' END]
  WHEN 3 THEN ['startUrls:required', CASE WHEN s_suppkey % 30 NOT BETWEEN 1 AND 20 THEN 'maxDepth:range' END]
  ELSE [CASE WHEN s_suppkey % 50 NOT BETWEEN 1 AND 32 THEN 'concurrency:range' END, CASE WHEN s_suppkey % 13 > 10 THEN 'maxRetries:range' END] END if v IS NOT NULL], ',') END AS violations,
  CASE WHEN s_suppkey % 20 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 4 = 2 THEN NULL WHEN s_suppkey % 4 = 3 THEN CAST(s_suppkey % 30 AS VARCHAR) ELSE '5' END AS max_depth FROM supplier""")
def p16(spark, d):
    s = read(spark, d, "supplier")
    kind = t.pick(t.TYPES, F.col("s_suppkey") % 4)
    out = s.select("s_suppkey", C.collector_config(kind, F.expr(CONFIG)).alias("c"))
    broken = F.col("s_suppkey") % 20 == 0
    return out.select(
        F.concat(F.lit("col-"), "s_suppkey").alias("collector_id"), F.array_join("c.violations", ",").alias("violations"),
        F.when(~broken, F.get_json_object("c.config", "$.maxDepth")).alias("max_depth"),
    )


BAD_STATUS = "CASE WHEN part % 50 = 0 THEN 'ODD' ELSE status END"
BAD_SIZE = "CASE WHEN line = 7 THEN 0 - file_size ELSE file_size END"


@query("P17_record_conformance", with_tables(f"""SELECT violations, count(*) AS files FROM (SELECT array_to_string([v for v in [CASE WHEN line = 5 THEN 'fileName:required' END, CASE WHEN {BAD_SIZE} < 0 THEN 'fileSize:negative' END, CASE WHEN {BAD_STATUS} = 'ODD' THEN 'status:value' END] if v IS NOT NULL], ',') AS violations FROM files) GROUP BY violations""", "files"))
def p17(spark, d):
    name = F.expr("CASE WHEN line = 5 THEN '' ELSE file_name END")
    v = F.array_join(C.file_violations(name, F.expr(BAD_SIZE), F.expr(BAD_STATUS)), ",")
    return t.files(spark, d).groupBy(v.alias("violations")).agg(F.count("*").alias("files"))


@query("P17_error_conformance", with_tables("SELECT error_id, CASE WHEN error_code = 'TIMEOUT' THEN 'errorCode:value' ELSE '' END AS violations FROM errors", "errors"))
def p17b(spark, d):
    code = F.expr("CASE WHEN error_code = 'TIMEOUT' THEN 'SLOW' ELSE error_code END")
    return t.errors(spark, d).select("error_id", F.array_join(C.error_violations(code, F.col("message")), ",").alias("violations"))


SLUG = "CASE WHEN n_nationkey % 5 = 0 THEN 'Bad Slug ' || n_nationkey WHEN n_nationkey % 7 = 1 THEN 'dup' ELSE lower(n_name) END"


@query("P18_source_conformance", """SELECT 'src-' || n_nationkey AS source_id, CASE WHEN n_nationkey % 5 = 0 THEN 'slug:format' WHEN n_nationkey % 7 = 1 THEN 'slug:duplicate' ELSE '' END AS violations FROM nation""")
def p18(spark, d):
    n = read(spark, d, "nation").select(
        F.concat(F.lit("src-"), "n_nationkey").alias("source_id"), F.col("n_name").alias("name"), F.expr(SLUG).alias("slug"),
        F.lit("https://a.example.com").alias("base_url"), F.lit("RESPECT").alias("robots_policy"),
    )
    return C.source_conformance(n).select("source_id", F.array_join("violations", ",").alias("violations"))


# --- names and types ---------------------------------------------------------


@query("P19_sanitize_filename", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'My_File_' || p_partkey || '_v_2.pdf' WHEN 1 THEN 'unnamed.txt' ELSE 'ناوی_' || p_partkey END AS name FROM part")
def p19(spark, d):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN '  My  File- ' || p_partkey || ':v*2 .PDF' WHEN 1 THEN ' -_- .TXT' ELSE 'ناوی ' || p_partkey || '__' END")
    return read(spark, d, "part").select("p_partkey", FN.sanitize_filename(raw).alias("name"))


@query("P20_sanitize_catalog_name", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x_' || p_partkey || '_a.b' WHEN 1 THEN 'file' ELSE 'a_b' || repeat('z', 197) END AS name FROM part")
def p20(spark, d):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN '../x  ' || p_partkey || '//a..b' WHEN 1 THEN ' .-_ ' ELSE 'a-_-b' || repeat('z', 300) END")
    return read(spark, d, "part").select("p_partkey", FN.sanitize_catalog_name(raw).alias("name"))


@query("P21_canonical_filename", with_tables("SELECT file_pk, 'Report_' || part || '_' || line || '-' || printf('RAW-%09d', part) || extension AS name FROM files", "files"))
def p21(spark, d):
    return t.files(spark, d).select(
        "file_pk", FN.canonical_filename(F.col("file_name"), FN.format_file_id(F.col("part")), F.col("extension")).alias("name")
    )


TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'Scan ' || p_partkey WHEN 1 THEN 'ab' WHEN 2 THEN '  Untitled' WHEN 3 THEN 'Kurdish history ' || p_partkey END"


@query("P22_generic_title", "SELECT p_partkey, p_partkey % 5 <> 3 AS generic FROM part")
def p22(spark, d):
    return read(spark, d, "part").select("p_partkey", FN.is_generic_title(F.expr(TITLE)).alias("generic"))


@query("P23_display_name", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN 'Kurdish_history_' || p_partkey || '.pdf' WHEN p_partkey % 2 = 0 THEN 'Anchor_' || p_partkey || '.pdf' ELSE 'u' || p_partkey || '.pdf' END AS name FROM part""")
def p23(spark, d):
    preferred = F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'Anchor ' || p_partkey ELSE 'Download' END")
    url_name = F.expr("'u' || p_partkey || '.pdf'")
    return read(spark, d, "part").select("p_partkey", FN.display_name(F.expr(TITLE), preferred, url_name, F.lit(".pdf")).alias("name"))


MIXED_EXT = sql_pick([".pdf", "docx", ".EPUB", ".html?x=1", ".json", ".xyz", "", ".csv", ".txt", ".zip"], "l_partkey % 10")
MIXED_MIME = sql_pick(["application/pdf", "audio/mpeg", "video/mp4", "text/html", "image/png", "application/zip", "application/json", "text/vtt", "application/octet-stream", "application/rtf"], "l_suppkey % 10")
WORKER = "CASE e WHEN '.docx' THEN 'documents' WHEN '.epub' THEN 'ebooks' WHEN '.html' THEN 'code' WHEN '.json' THEN 'data' WHEN '.csv' THEN 'spreadsheets' WHEN '.txt' THEN 'text' WHEN '.zip' THEN 'archives' END"


def _mixed(spark, d):
    li = read(spark, d, "lineitem")
    ext = t.pick([".pdf", "docx", ".EPUB", ".html?x=1", ".json", ".xyz", "", ".csv", ".txt", ".zip"], F.col("l_partkey") % 10)
    mime = t.pick(["application/pdf", "audio/mpeg", "video/mp4", "text/html", "image/png", "application/zip", "application/json", "text/vtt", "application/octet-stream", "application/rtf"], F.col("l_suppkey") % 10)
    return li.select(ext.alias("ext"), mime.alias("mime"))


_MIXED_SQL = f"m AS (SELECT {MIXED_EXT} AS ext, {MIXED_MIME} AS mime FROM lineitem), n AS (SELECT ext, mime, CASE WHEN ext = '' THEN '' ELSE '.' || ltrim(lower(regexp_extract(ext, '^([^?]*)', 1)), '.') END AS e FROM m)"


@query("P24_category_worker", f"""WITH {_MIXED_SQL} SELECT ext, mime, CASE WHEN mime = 'application/pdf' OR e = '.pdf' THEN 'pdf/digital' ELSE coalesce({WORKER}, CASE mime WHEN 'audio/mpeg' THEN 'audio' WHEN 'video/mp4' THEN 'video' WHEN 'text/html' THEN 'text' WHEN 'image/png' THEN 'images'
  WHEN 'application/zip' THEN 'archives' WHEN 'application/json' THEN 'data' WHEN 'text/vtt' THEN 'subtitles' WHEN 'application/rtf' THEN 'documents' ELSE 'files' END) END AS category, count(*) AS files FROM n GROUP BY ALL""")
def p24(spark, d):
    return _mixed(spark, d).groupBy("ext", "mime", FN.categorize_file(F.col("mime"), F.col("ext"), "worker").alias("category")).agg(F.count("*").alias("files"))


@query("P24_category_api", f"""WITH {_MIXED_SQL} SELECT ext, mime, CASE WHEN mime = 'application/pdf' OR e = '.pdf' THEN 'pdf' WHEN mime = 'audio/mpeg' THEN 'audio' WHEN mime = 'video/mp4' THEN 'video' WHEN mime = 'image/png' THEN 'images' WHEN mime LIKE 'text/%' THEN 'text'
  WHEN mime = 'application/zip' THEN 'archives' ELSE coalesce({WORKER}, 'other') END AS category, count(*) AS files FROM n GROUP BY ALL""")
def p24b(spark, d):
    return _mixed(spark, d).groupBy("ext", "mime", FN.categorize_file(F.col("mime"), F.col("ext"), "api").alias("category")).agg(F.count("*").alias("files"))


BROWSE_KEY = "CASE line % 4 WHEN 0 THEN storage_key WHEN 1 THEN 'a/pdf/x.pdf' WHEN 2 THEN '00_raw/web/s/r/pdf/native/decoded/x.pdf' END"


@query("P24_category_browser", with_tables(f"""SELECT file_pk, CASE line % 4 WHEN 0 THEN {sql_pick(t.FOLDERS, 'part % 10')} WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf/digital'
  ELSE CASE WHEN original_filename IS NULL THEN CASE extension WHEN '.pdf' THEN 'pdf/digital' WHEN '.html' THEN 'documents' WHEN '.csv' THEN 'documents' WHEN '.txt' THEN 'documents' WHEN '.jpg' THEN 'images' WHEN '.mp4' THEN 'video' WHEN '.zip' THEN 'archives' WHEN '.epub' THEN 'archives' ELSE 'other' END
  ELSE CASE extension WHEN '.pdf' THEN 'pdf/digital' WHEN '.epub' THEN 'ebooks' WHEN '.docx' THEN 'documents' WHEN '.html' THEN 'documents' WHEN '.csv' THEN 'documents' WHEN '.txt' THEN 'documents' WHEN '.jpg' THEN 'images' WHEN '.mp4' THEN 'video' WHEN '.json' THEN 'data' ELSE 'archives' END END END AS category FROM files""", "files"))
def p24c(spark, d):
    c = FN.categorize_file(F.col("mime_type"), F.col("extension"), "browser", F.col("original_filename"), F.expr(BROWSE_KEY))
    return t.files(spark, d).select("file_pk", c.alias("category"))


@query("P26_infer_extension", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE NULL END AS extension,
  CASE p_partkey % 4 WHEN 0 THEN 'page' || p_partkey || '.pdf' WHEN 1 THEN 'page' || p_partkey || '.pdf' WHEN 2 THEN 'page' || p_partkey || '.txt' ELSE 'page' || p_partkey END AS file_name FROM part""")
def p26(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'page' || p_partkey || '.php' WHEN 1 THEN 'page' || p_partkey WHEN 2 THEN 'page' || p_partkey || '.txt' ELSE 'page' || p_partkey END")
    mime = F.expr("CASE WHEN p_partkey % 4 = 3 THEN 'x/unknown' ELSE 'application/pdf' END")
    return read(spark, d, "part").select("p_partkey", FN.infer_extension(name, mime).alias("x")).select("p_partkey", "x.*")


@query("P27_admission", with_tables("""SELECT reject_reason, count(*) AS files FROM (SELECT CASE WHEN mime_type = 'text/html' THEN 'unexpected_html' WHEN extension NOT IN ('.pdf', '.docx', '.jpg', '.mp4') THEN 'extension_not_allowed'
  WHEN mime_type <> 'application/pdf' AND mime_type NOT LIKE 'image/%' THEN 'mime_not_allowed' END AS reject_reason FROM files) GROUP BY reject_reason""", "files"))
def p27(spark, d):
    reason = FN.reject_reason(F.col("mime_type"), F.col("extension"), ["pdf", ".docx", ".jpg", "mp4"], ["application/pdf", "image/*"])
    return t.files(spark, d).groupBy(reason.alias("reject_reason")).agg(F.count("*").alias("files"))


@query("P28_size_gate", with_tables("SELECT file_pk, CASE WHEN file_size > 9000000 THEN 'FILE_TOO_LARGE' ELSE 'INVALID_CONTENT' END AS error_code FROM (SELECT file_pk, CASE WHEN part % 97 = 0 THEN 0 ELSE file_size END AS file_size FROM files) WHERE file_size > 9000000 OR file_size = 0", "files"))
def p28(spark, d):
    size = F.expr("CASE WHEN part % 97 = 0 THEN 0 ELSE file_size END")
    return t.files(spark, d).select("file_pk", FN.size_error(size, 9000000).alias("error_code")).where("error_code IS NOT NULL")


@query("P29_error_classes", with_tables("""SELECT message LIKE '%503%' OR message LIKE '%401%' OR message LIKE '%403%' OR message LIKE '%429%' OR message LIKE '%500%' OR message LIKE '%502%' OR message LIKE '%504%' OR message LIKE '%Timeout%' OR message LIKE '%ConnectError%' OR message LIKE '%ConnectionReset%' AS retryable,
  CASE error_code WHEN 'FILE_TOO_LARGE' THEN 'FILE_TOO_LARGE' WHEN 'NOT_FOUND' THEN 'R2_UPLOAD_ERROR' ELSE 'NETWORK_ERROR' END AS code, count(*) AS errors FROM errors GROUP BY ALL""", "errors"))
def p29(spark, d):
    kind = F.expr("CASE error_code WHEN 'FILE_TOO_LARGE' THEN 'too_large' WHEN 'NOT_FOUND' THEN 'storage' ELSE 'network' END")
    return t.errors(spark, d).groupBy(FN.is_retryable(F.col("message")).alias("retryable"), FN.error_code(kind).alias("code")).agg(F.count("*").alias("errors"))


@query("P30_metadata_accessors", with_tables("""SELECT json_extract_string(metadata, '$.language.language') AS language_code, json_extract_string(metadata, '$.language.language_name') AS language_name,
  CASE WHEN json_extract_string(metadata, '$.kurdish_category.category') IN ('general', 'unknown') THEN NULL ELSE json_extract_string(metadata, '$.kurdish_category.category') END AS topic,
  count(*) AS files, count(nullif(CAST(json_extract_string(metadata, '$.quality.score') AS DOUBLE), 0)) AS scored, CAST(sum(CAST(json_extract_string(metadata, '$.quality.score') AS BIGINT)) AS BIGINT) AS total FROM files GROUP BY 1, 2, 3""", "files"))
def p30(spark, d):
    m = t.files(spark, d).select(FN.metadata_accessors(F.col("metadata")).alias("m")).select("m.*")
    return m.groupBy("language_code", "language_name", "topic").agg(
        F.count("*").alias("files"), F.count("quality_score").alias("scored"), F.coalesce(F.sum("quality_score"), F.lit(0)).cast("long").alias("total")
    )


ARTICLE = """CASE doc_id % 4 WHEN 0 THEN '{"headline":"H' || doc_id || '","content":"one two three","sourceUrl":"https://a/' || doc_id || '","lang":"fr"}'
  WHEN 1 THEN '{"title":"T' || doc_id || '","paragraphs":["p1","p2"],"body_text":"p1 p2","word_count":' || n_chars || ',"language":{"language":"ckb"}}'
  WHEN 2 THEN '{"extracted_text":"a b\\\\n\\\\nc ","qualityScore":7,"source_url":"u"}' ELSE '{"x":1}' END"""
ARTICLE_SQL = ARTICLE.replace("\\\\", "\\")


@query("P31_article_view", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'H' || doc_id WHEN 1 THEN 'T' || doc_id ELSE 'Scraped Document' END AS title,
  CASE doc_id % 4 WHEN 0 THEN 'https://a/' || doc_id WHEN 2 THEN 'u' END AS url, CASE doc_id % 4 WHEN 0 THEN 'one two three' WHEN 1 THEN 'p1|p2' WHEN 2 THEN 'a b|c ' ELSE '' END AS paragraphs,
  CAST(CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN n_chars = 0 THEN 2 ELSE n_chars END WHEN 2 THEN 3 ELSE 0 END AS INTEGER) AS word_count, CASE doc_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'ckb' END AS language, CASE doc_id % 4 WHEN 2 THEN 7::DOUBLE END AS quality_score FROM documents""")
def p31(spark, d):
    v = read(spark, d, "documents").select("doc_id", FN.article_view(F.expr(ARTICLE)).alias("v"))
    return v.select("doc_id", "v.title", "v.url", F.array_join("v.paragraphs", "|").alias("paragraphs"), "v.word_count", "v.language", "v.quality_score")


@query("P32_line_search", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id, line_no, line FROM l WHERE contains(lower(line), 'tion the')")
def p32(spark, d):
    return FN.search_lines(read(spark, d, "documents"), "doc_id", "text", "Tion The")


MS = "CAST(datediff('millisecond', started_at, completed_at) AS BIGINT)"


@query("P34_run_duration", with_tables(f"""WITH m AS (SELECT run_pk, {MS} AS ms FROM runs) SELECT run_pk, ms, CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's'
  ELSE (ms // 3600000) || 'h ' || (ms % 3600000 // 60000) || 'm' END AS duration FROM m""", "runs"))
def p34(spark, d):
    ms = FN.duration_ms(F.col("started_at"), F.col("completed_at"))
    r = t.runs(spark, d).select("run_pk", F.when(F.col("completed_at").isNotNull(), ms).alias("ms"))
    return r.select("run_pk", "ms", FN.duration_text(F.col("ms")).alias("duration"))


SIZES = "CASE WHEN part % 7 = 0 THEN part WHEN part % 7 = 1 THEN 0 WHEN part % 7 = 2 THEN file_size * 1024 * 1024 ELSE file_size END"


@query("P35_byte_text", with_tables(f"""WITH s AS (SELECT DISTINCT {SIZES} AS size FROM files), u AS (SELECT size, CASE WHEN size >= 1099511627776 THEN 4 WHEN size >= 1073741824 THEN 3 WHEN size >= 1048576 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS p FROM s)
SELECT size, CASE WHEN size = 0 THEN '0 B' ELSE regexp_replace(printf('%.1f', round(size / pow(1024.0, p), 1)), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS text FROM u""", "files"))
def p35(spark, d):
    s = t.files(spark, d).select(F.expr(SIZES).alias("size")).distinct()
    return s.select("size", FN.byte_text(F.col("size")).alias("text"))


MANGLED = "CASE n_nationkey % 6 WHEN 0 THEN 'www-site' || n_nationkey || '-com' WHEN 1 THEN 'tg-chan' || n_nationkey WHEN 2 THEN 'basnews-' || n_nationkey WHEN 3 THEN 'x' || n_nationkey || '-gov-krd' WHEN 4 THEN lower(n_name) ELSE 'good' || n_nationkey || '-org' END"


@query("P36_source_metadata", """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'Site' || n_nationkey WHEN 1 THEN 'Telegram: @chan' || n_nationkey WHEN 2 THEN 'BasNews' WHEN 3 THEN 'X' || n_nationkey || ' Gov' WHEN 4 THEN 'Nation ' || n_nationkey ELSE 'Given Name' END AS name,
  CASE n_nationkey % 6 WHEN 0 THEN 'https://www.site' || n_nationkey || '.com' WHEN 1 THEN 'https://t.me/chan' || n_nationkey WHEN 2 THEN 'https://basnews-' || n_nationkey WHEN 3 THEN 'https://x' || n_nationkey || '.gov.krd' WHEN 4 THEN 'https://' || lower(n_name) ELSE 'https://given.example.org' END AS base_url FROM nation""")
def p36(spark, d):
    name = F.expr("CASE n_nationkey % 6 WHEN 5 THEN 'Given Name' WHEN 4 THEN n_name WHEN 0 THEN 'WWW SITE' END")
    url = F.expr("CASE n_nationkey % 6 WHEN 5 THEN 'given.example.org' WHEN 0 THEN 'https://www-site-com.com' ELSE '' END")
    m = read(spark, d, "nation").select("n_nationkey", FN.source_metadata(F.expr(MANGLED), name, url).alias("m"))
    return m.select("n_nationkey", "m.name", "m.base_url")


@query("P37_file_ids", "SELECT l_partkey AS part, printf('RAW-%09d', l_partkey) AS file_id, l_partkey AS parsed FROM lineitem GROUP BY l_partkey")
def p37(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part")).distinct().withColumn("file_id", FN.format_file_id(F.col("part")))
    return p.withColumn("parsed", FN.parse_file_id(F.col("file_id")))


@query("P38_run_ids", with_tables("SELECT run_pk, run_id FROM runs", "runs"))
def p38(spark, d):
    return t.runs(spark, d).select("run_pk", FN.format_run_id(F.col("started_at"), F.col("n")).alias("run_id"))


@query("P40_presets", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.pdf,.epub,.mobi,.azw3,.fb2,.djvu,.doc,.docx,.odt,.rtf,.txt,.md,.pages' WHEN 2 THEN '.mp4,.mkv,.avi,.mov,.webm' ELSE '.html,.json' END AS extensions,
  'c' || c_custkey || '|x' AS channels FROM customer""")
def p40(spark, d):
    chosen = F.expr("CASE c_custkey % 4 WHEN 0 THEN array('books', 'all') WHEN 1 THEN array('documents', 'books') WHEN 2 THEN array('video') ELSE array('articles') END")
    channels = F.expr("'@c' || c_custkey || ',\n , x'")
    return read(spark, d, "customer").select(
        "c_custkey", F.array_join(FN.expand_presets(chosen), ",").alias("extensions"), F.array_join(FN.channel_list(channels), "|").alias("channels")
    )


# --- duplicates --------------------------------------------------------------


def _split(spark, d):
    files = t.text_files(spark, d)
    catalog = files.where("doc_id % 2 = 0").withColumn("status", F.expr("CASE WHEN doc_id % 10 = 0 THEN 'FAILED' ELSE 'UPLOADED' END"))
    return files.where("doc_id % 2 = 1"), catalog


_IN = "i AS (SELECT * FROM text_files WHERE doc_id % 2 = 1), c AS (SELECT * FROM text_files WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0)"


@query("D1_known_url_skip", with_tables(f"WITH {_IN} SELECT file_pk, EXISTS (SELECT 1 FROM c WHERE c.source_id = i.source_id AND c.source_url = i.source_url) AS known FROM i", "text_files"))
def d1(spark, d):
    new, catalog = _split(spark, d)
    return DD.known_urls(new, catalog).select("file_pk", F.lit(True).alias("known")).union(DD.new_urls(new, catalog).select("file_pk", F.lit(False)))


@query("D2_known_content_skip", with_tables(f"WITH {_IN} SELECT file_pk FROM i WHERE sha256 NOT IN (SELECT sha256 FROM c)", "text_files"))
def d2(spark, d):
    new, catalog = _split(spark, d)
    return DD.new_content(new, catalog).select("file_pk")


@query("W1_first_by_hash", with_tables("""SELECT file_pk, first_value(file_pk) OVER w AS first_pk, row_number() OVER w > 1 AS is_duplicate FROM files WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, file_pk)""", "files"))
def w1(spark, d):
    return DD.mark_duplicates(t.files(spark, d)).select("file_pk", "first_pk", "is_duplicate")


_PRINTED = "WITH p AS (SELECT doc_id AS page_id, doc_id % 4 AS run, sha256(lower(lang) || chr(10) || text || chr(10) || '[]') AS f FROM documents)"


def _printed(spark, d):
    """Documents as page records; their exact copies share a fingerprint."""
    none = F.array().cast("array<struct<tag:string,text:string>>")
    doc = read(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % 4).alias("run_pk"), H.content_fingerprint(F.col("lang"), F.col("text"), none).alias("content_fingerprint"))


@query("W2_in_run_fingerprint", f"{_PRINTED} SELECT min(page_id) AS page_id, run, f AS fingerprint FROM p GROUP BY run, f")
def w2(spark, d):
    return DD.dedup_in_run(_printed(spark, d)).select("page_id", F.col("run_pk").alias("run"), F.col("content_fingerprint").alias("fingerprint"))


@query("W2_across_runs", f"{_PRINTED} SELECT page_id FROM p WHERE page_id % 2 = 1 AND f NOT IN (SELECT f FROM p WHERE page_id % 2 = 0)")
def w2b(spark, d):
    p = _printed(spark, d)
    return DD.dedup_across_runs(p.where("page_id % 2 = 1"), p.where("page_id % 2 = 0")).select("page_id")


@query("W4_file_id_allocation", with_tables("SELECT file_pk, printf('RAW-%09d', row_number() OVER (ORDER BY created_at, file_pk) + (SELECT greatest(count(*), max(l_partkey)) FROM lineitem WHERE l_linenumber > 4)) AS file_id FROM files WHERE line <= 4", "files"))
def w4(spark, d):
    # numbering sorts and writes whole rows, so they are cut to what is asked for
    f = t.files(spark, d).select("file_pk", "created_at", "part", "line")
    catalog = f.where("line > 4").withColumn("file_id", FN.format_file_id(F.col("part")))
    return DD.allocate_file_ids(f.where("line <= 4").select("file_pk", "created_at"), catalog, [F.col("created_at"), F.col("file_pk")]).select("file_pk", "file_id")


@query("W5_run_sequence", with_tables("""WITH old AS (SELECT strftime(started_at, '%Y-%m-%d') AS day, max(n) AS last FROM runs WHERE n % 3 = 0 GROUP BY day), new AS (SELECT *, strftime(started_at, '%Y-%m-%d') AS day FROM runs WHERE n % 3 <> 0)
SELECT run_pk, new.day || printf('_run_%06d', coalesce(last, 0) + row_number() OVER (PARTITION BY new.day ORDER BY run_pk)) AS run_id FROM new LEFT JOIN old ON new.day = old.day""", "runs"))
def w5(spark, d):
    r = t.runs(spark, d)
    return DD.allocate_run_ids(r.where("n % 3 <> 0").drop("run_id"), r.where("n % 3 = 0"), [F.col("run_pk")]).select("run_pk", "run_id")


# --- lists, filters and look-ups ---------------------------------------------


@query("D3_run_list", with_tables("SELECT run_pk, c.name AS collector_name, c.type AS collector_type, s.name AS source_name, s.slug AS source_slug FROM runs r LEFT JOIN collectors c ON r.collector_id = c.collector_id LEFT JOIN sources s ON r.source_id = s.source_id", "runs", "collectors", "sources"))
def d3(spark, d):
    return CT.run_list(t.runs(spark, d), t.collectors(spark, d), t.sources(spark, d)).select("run_pk", "collector_name", "collector_type", "source_name", "source_slug")


@query("D4_file_detail", with_tables("SELECT file_pk, run_id, r.status AS run_status, s.name AS source_name, s.slug AS source_slug FROM files f LEFT JOIN runs r ON f.run_pk = r.run_pk LEFT JOIN sources s ON f.source_id = s.source_id", "files", "runs", "sources"))
def d4(spark, d):
    return CT.file_details(t.files(spark, d), t.runs(spark, d), t.sources(spark, d)).select("file_pk", "run_id", "run_status", "source_name", "source_slug")


@query("D5_collector_list", with_tables("SELECT collector_id, c.name, s.name AS source_name, slug AS source_slug FROM collectors c JOIN sources s ON c.source_id = s.source_id WHERE c.source_id = 'src-7'", "collectors", "sources"))
def d5(spark, d):
    return CT.collector_list(t.collectors(spark, d), t.sources(spark, d), "src-7").select("collector_id", "name", "source_name", "source_slug")


@query("D6_report_inputs", with_tables("""SELECT s.source_id, slug, (SELECT count(*) FROM collectors c WHERE c.source_id = s.source_id) AS collectors, (SELECT count(*) FROM runs r WHERE r.source_id = s.source_id) AS runs,
  (SELECT count(*) FROM files f WHERE f.source_id = s.source_id) AS files, (SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM files f WHERE f.source_id = s.source_id) AS bytes FROM sources s""", "sources", "collectors", "runs", "files"))
def d6(spark, d):
    return CT.report_inputs(t.sources(spark, d), t.collectors(spark, d), t.runs(spark, d), t.files(spark, d))


def _objects(spark, d):
    """Objects for two thirds of the files, and some objects without a row; a listing may name one twice."""
    f = t.files(spark, d)
    stored = f.where("part % 3 <> 0").select(F.col("storage_key").alias("key"), "sha256", F.col("file_size").alias("size"))
    loose = f.where("part % 5 = 0").select(
        F.concat(F.lit("/loose/"), "file_pk").alias("key"),
        F.when(F.col("line") > 3, F.col("sha256")).otherwise(F.sha2("file_pk", 256)).alias("sha256"), F.col("file_size").alias("size"),
    )
    return stored.unionByName(loose)


_OBJ = """o AS (SELECT DISTINCT storage_key AS key, CAST(NULL AS VARCHAR) AS sha FROM files WHERE part % 3 <> 0 UNION ALL SELECT DISTINCT 'loose/' || file_pk, CASE WHEN line > 3 THEN sha256 ELSE sha256(file_pk) END FROM files WHERE part % 5 = 0),
r AS (SELECT storage_key AS key, count(*) AS n FROM files GROUP BY storage_key),
j AS (SELECT coalesce(r.key, o.key) AS key, coalesce(n, 0) AS catalog_rows, CASE WHEN r.key IS NOT NULL AND o.key IS NOT NULL THEN 'synced' WHEN r.key IS NOT NULL THEN 'missing' WHEN o.sha IN (SELECT sha256 FROM files) THEN 'known_content' ELSE 'new' END AS state FROM r FULL JOIN o ON r.key = o.key)"""


@query("D12_reconciliation", with_tables(f"WITH {_OBJ} SELECT key, catalog_rows, state FROM j", "files"))
def d12(spark, d):
    return CT.reconcile(t.files(spark, d), _objects(spark, d)).select("key", "catalog_rows", "state")


@query("D12_differences", with_tables(f"WITH {_OBJ} SELECT key, CASE WHEN state = 'missing' THEN 'missing' ELSE 'new' END AS state FROM j WHERE state <> 'synced'", "files"))
def d12b(spark, d):
    catalog, storage = scratch_folder(spark), scratch_folder(spark)
    IX.write_key_index(t.files(spark, d), "storage_key", catalog)
    IX.write_key_index(_objects(spark, d), "key", storage)
    return IX.reconcile_indexes(spark, catalog, storage)


@query("A20_reconciliation_summary", with_tables(f"WITH {_OBJ} SELECT CAST(coalesce(sum(catalog_rows) FILTER (state = 'synced'), 0) + count(*) FILTER (state = 'new') AS BIGINT) AS synced, CAST(coalesce(sum(catalog_rows) FILTER (state = 'missing'), 0) AS BIGINT) AS missing, count(*) FILTER (state = 'new') AS indexed_new, CAST(sum(catalog_rows) + count(*) FILTER (state = 'new') AS BIGINT) AS total_checked FROM j", "files"))
def a20(spark, d):
    return CT.reconciliation_summary(CT.reconcile(t.files(spark, d), _objects(spark, d)))


@query("D13_category_lookup", with_tables(f"""WITH m AS (SELECT unnest([{', '.join(f"'{e}'" for e in rules.EXTENSION_CATEGORIES)}]) AS extension, unnest([{', '.join(f"'{c}'" for c in rules.EXTENSION_CATEGORIES.values())}]) AS category)
SELECT category, count(*) AS files FROM files f LEFT JOIN m ON f.extension = m.extension GROUP BY category""", "files"))
def d13(spark, d):
    table = spark.createDataFrame(list(rules.EXTENSION_CATEGORIES.items()), "extension string, category string")
    return CT.attach_extension_category(t.files(spark, d), table).groupBy("category").agg(F.count("*").alias("files"))


@query("D15_lookup_by_either_key", with_tables("""WITH w AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'SRC-' || (page_id % 30) WHEN 1 THEN 'nation_' || (page_id % 30) ELSE ' Nation_' || (page_id % 30) END AS wanted FROM pages)
SELECT page_id, CASE WHEN page_id % 30 < 25 THEN 'src-' || (page_id % 30) END AS source_id FROM w""", "sources"))
def d15(spark, d):
    w = F.expr("CASE page_id % 3 WHEN 0 THEN 'SRC-' || (page_id % 30) WHEN 1 THEN 'nation_' || (page_id % 30) ELSE ' Nation_' || (page_id % 30) END")
    pages = read(spark, d, "pages").select("page_id", w.alias("wanted"))
    return CT.resolve_keys(pages, "wanted", t.sources(spark, d), "source_id", "slug", "name").select("page_id", "source_id")


@query("F1_file_filter", with_tables("SELECT file_pk FROM files WHERE source_id = 'src-3' AND status = 'UPLOADED' AND approval_status = 'PENDING' AND extension IN ('.pdf', 'pdf')", "files"))
def f1(spark, d):
    f = CT.FileFilter(source_id="src-3", status="UPLOADED", approval_status="PENDING", extension="PDF")
    return CT.filter_files(t.files(spark, d), f).select("file_pk")


@query("F1_files_of_run", with_tables("SELECT file_pk FROM files f JOIN runs r ON f.run_pk = r.run_pk WHERE r.run_id = (SELECT max(run_id) FROM runs WHERE n = 7)", "files", "runs"))
def f1b(spark, d):
    runs = t.runs(spark, d).where("n = 7").select("run_pk")
    return t.files(spark, d).join(runs, "run_pk", "left_semi").select("file_pk")


_F2 = {
    "pdf": "extension = '.pdf' OR mime_type LIKE '%pdf%' OR storage_key LIKE '%/pdf/%'",
    "web_data": "storage_key LIKE '%/web_content/%'",
    "ebooks": "extension IN ('.epub', '.pdf')", "documents": "extension IN ('.pdf', '.docx', '.txt')",
    "video": "extension = '.mp4'", "images": "extension = '.jpg'", "datasets": "extension IN ('.json', '.csv')",
}


@query("F2_category_filter", with_tables(" UNION ALL ".join(f"SELECT '{k}' AS category, count(*) AS files FROM files WHERE {v}" for k, v in _F2.items()), "files"))
def f2(spark, d):
    return t.files(spark, d).agg(
        F.array(*[
            F.struct(F.lit(k).alias("category"), F.count_if(CT.category_predicate(a)).alias("files"))
            for k, a in zip(_F2, ["pdf", "articles", "books", "documents", "video", "images", "datasets"])
        ]).alias("x")
    ).select(F.inline("x"))


@query("F3_search", with_tables("SELECT file_pk FROM files WHERE (contains(lower(file_name), 'report 12') OR contains(lower(coalesce(original_filename, '')), 'report 12') OR contains(lower(source_url), 'report 12')) AND (extension = '.jpg')", "files"))
def f3(spark, d):
    return CT.filter_files(t.files(spark, d), CT.FileFilter(category="images", search=" Report 12")).select("file_pk")


@query("F3_reference_search", with_tables("SELECT file_pk FROM files WHERE contains(lower(file_name), 'report 12') OR contains(lower(coalesce(original_filename, '')), 'report 12') OR contains(lower(source_url), 'report 12')", "files"))
def f3b(spark, d):
    return CT.filter_files(t.files(spark, d), CT.FileFilter(category="images", search="REPORT 12", reference_search=True)).select("file_pk")


@query("F3_indexed_search", with_tables("""WITH f AS (SELECT file_pk, CASE WHEN line = 2 AND part % 3 = 0 THEN 'Memo 12' || part ELSE file_name END AS file_name, original_filename, source_url FROM files)
SELECT file_pk AS pk FROM f WHERE contains(lower(file_name), 'o 12') OR contains(lower(coalesce(original_filename, '')), 'o 12') OR contains(lower(source_url), 'o 12')""", "files"))
def f3c(spark, d):
    # all files, then a batch of renamed ones
    folder, files = scratch_folder(spark), t.files(spark, d)
    columns = ["file_name", "original_filename", "source_url"]
    IX.write_postings(files, "file_pk", columns, folder, "0")
    renamed = files.where("line = 2 AND part % 3 = 0").withColumn("file_name", F.concat(F.lit("Memo 12"), "part"))
    IX.write_postings(renamed, "file_pk", columns, folder, "1")
    return IX.search_postings(spark, folder, " O 12")


@query("F4_run_filter", with_tables("SELECT run_pk FROM runs WHERE collector_id = 'col-3' AND status = 'COMPLETED' AND approval_status = 'PENDING'", "runs"))
def f4(spark, d):
    return CT.filter_runs(t.runs(spark, d), collector_id="col-3", status="COMPLETED", approval_status="PENDING").select("run_pk")


@query("F5_active_sets", with_tables("SELECT 'runs' AS what, count(*) AS n FROM runs WHERE status IN ('RUNNING', 'PENDING') UNION ALL SELECT 'sources', count(*) FROM sources WHERE enabled UNION ALL SELECT 'collectors', count(*) FROM collectors WHERE enabled", "runs", "sources", "collectors"))
def f5(spark, d):
    n = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return n(CT.active_runs(t.runs(spark, d)), "runs").union(n(CT.enabled(t.sources(spark, d)), "sources")).union(n(CT.enabled(t.collectors(spark, d)), "collectors"))


def _manual(spark, d):
    return t.files(spark, d).withColumn("run_pk", F.when(F.col("line") != 2, F.col("run_pk")))


@query("F8_manual_files", with_tables("SELECT file_pk FROM files WHERE line = 2", "files"))
def f8(spark, d):
    return CT.manual_files(_manual(spark, d)).select("file_pk")


@query("F8_source_tree", with_tables(f"SELECT source_id, CASE WHEN line <> 2 THEN run_pk END AS run_pk, {sql_pick(t.FOLDERS, 'part % 10')} AS category, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY ALL", "files"))
def f8b(spark, d):
    return CT.source_tree(_manual(spark, d))


@query("L1_paged_list", with_tables("SELECT file_pk, created_at::VARCHAR AS created FROM files WHERE status = 'UPLOADED' ORDER BY created_at DESC, file_pk LIMIT 100 OFFSET 200", "files"))
def l1(spark, d):
    page = CT.list_page(t.files(spark, d).where("status = 'UPLOADED'"), "3", "1000")
    return page.select("file_pk", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("L1_keyset_page", with_tables("SELECT file_pk, created_at::VARCHAR AS created FROM files WHERE created_at < TIMESTAMP '1996-01-01' OR (created_at = TIMESTAMP '1996-01-01' AND file_pk > 'm') ORDER BY created_at DESC, file_pk LIMIT 50", "files"))
def l1k(spark, d):
    page = CT.list_after(t.files(spark, d), (datetime(1996, 1, 1), "m"), "50")
    return page.select("file_pk", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("L1_page_envelope", with_tables("SELECT count(*) AS total, 1 AS page, 20 AS page_size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM files WHERE status = 'UPLOADED'", "files"))
def l1b(spark, d):
    return CT.page_envelope(t.files(spark, d).where("status = 'UPLOADED'"), "abc", None)


@query("L2_recent_runs", with_tables("SELECT run_pk, status FROM runs ORDER BY created_at DESC, run_pk LIMIT 10", "runs"))
def l2(spark, d):
    return CT.recent_runs(t.runs(spark, d)).select("run_pk", "status")


@query("W6_latest_errors", with_tables("SELECT run_pk, error_id FROM errors QUALIFY row_number() OVER (PARTITION BY run_pk ORDER BY created_at DESC, error_id DESC) <= 5", "errors"))
def w6(spark, d):
    return CT.latest_errors(t.errors(spark, d), 5).select("run_pk", "error_id")


# --- integrity ---------------------------------------------------------------


def _broken(spark, d):
    runs = t.runs(spark, d).where("n % 10 <> 0")
    sources = t.sources(spark, d).where("source_id <> 'src-4'")
    return sources, t.collectors(spark, d), runs, t.files(spark, d), t.errors(spark, d)


@query("G1_referential_integrity", with_tables("""WITH s AS (SELECT source_id FROM sources WHERE source_id <> 'src-4'), r AS (SELECT * FROM runs WHERE n % 10 <> 0), v AS (
SELECT 'collector.source' AS relation, collector_id AS child_key, source_id AS parent_key FROM collectors WHERE source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'run.collector', run_pk, collector_id FROM r WHERE collector_id NOT IN (SELECT collector_id FROM collectors)
UNION ALL SELECT 'run.source', run_pk, source_id FROM r WHERE source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'file.run', file_pk, run_pk FROM files WHERE run_pk NOT IN (SELECT run_pk FROM r)
UNION ALL SELECT 'file.source', file_pk, source_id FROM files WHERE source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'error.run', error_id, run_pk FROM errors WHERE run_pk NOT IN (SELECT run_pk FROM r)) SELECT * FROM v""", "sources", "collectors", "runs", "files", "errors"))
def g1(spark, d):
    return IG.referential_violations(*_broken(spark, d))


@query("G2_uniqueness", with_tables("""SELECT 'file_url' AS column_name, source_url AS value, count(*) AS rows FROM files GROUP BY source_url HAVING count(*) > 1 UNION ALL SELECT 'slug', slug, count(*) FROM sources GROUP BY slug HAVING count(*) > 1
UNION ALL SELECT 'run_id', run_id, count(*) FROM runs GROUP BY run_id HAVING count(*) > 1""", "files", "sources", "runs"))
def g2(spark, d):
    return (
        IG.repeated_values(t.files(spark, d), "source_url", "file_url")
        .union(IG.repeated_values(t.sources(spark, d), "slug", "slug"))
        .union(IG.repeated_values(t.runs(spark, d), "run_id", "run_id"))
    )


@query("G3_lineage", with_tables("SELECT file_pk, array_to_string([x for x in [CASE WHEN part % 9 = 0 THEN 'source_url' END, CASE WHEN part % 6 = 0 THEN 'sha256' END, CASE WHEN line = 2 THEN 'run' END] if x IS NOT NULL], ',') AS missing FROM files WHERE status = 'UPLOADED' AND (part % 9 = 0 OR part % 6 = 0 OR line = 2)", "files"))
def g3(spark, d):
    f = _manual(spark, d).withColumns(
        {"source_url": F.when(F.col("part") % 9 != 0, F.col("source_url")), "sha256": F.when(F.col("part") % 6 != 0, F.col("sha256")).otherwise("")}
    )
    return IG.lineage_violations(f).select("file_pk", F.array_join("missing", ",").alias("missing"))
