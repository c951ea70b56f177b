"""Catalog tables derived from the test tables: each as a Spark plan and as SQL.

Both sides are plain projections of the given tables, so the SQL oracle states the
same input and only the operator under test differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".pdf", ".docx", ".epub", ".html", ".json", ".jpg", ".mp4", ".csv", ".txt", ".zip"]
MIMES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/epub+zip", "text/html", "application/json", "image/jpeg", "video/mp4",
    "text/csv", "text/plain", "application/zip",
]
FOLDERS = [
    "pdf/digital", "documents", "ebooks", "code", "data/web_content", "images", "video",
    "spreadsheets", "text", "archives",
]


def pick(values: list[str], index) -> "F.Column":
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} AS INTEGER) + 1]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark, d) -> DataFrame:
    n = read(spark, d, "nation")
    return n.select(
        F.concat(F.lit("src-"), "n_nationkey").alias("source_id"),
        F.col("n_name").alias("name"),
        F.lower("n_name").alias("slug"),
        F.concat(F.lit("https://"), F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")), F.lit(".example.com")).alias("base_url"),
        F.lit("").alias("description"),
        (F.col("n_regionkey") != 0).alias("enabled"),
        F.lit("RESPECT").alias("robots_policy"),
    )


SOURCES = """SELECT 'src-' || n_nationkey AS source_id, n_name AS name, lower(n_name) AS slug,
  'https://' || replace(lower(n_name), '_', '-') || '.example.com' AS base_url, '' AS description,
  n_regionkey <> 0 AS enabled, 'RESPECT' AS robots_policy FROM nation"""

TYPES = ["WEB", "TELEGRAM", "MEDIA", "MANUAL"]


def collectors(spark, d) -> DataFrame:
    s = read(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("col-"), "s_suppkey").alias("collector_id"),
        F.concat(F.lit("src-"), "s_nationkey").alias("source_id"),
        F.col("s_name").alias("name"),
        pick(TYPES, F.col("s_suppkey") % 4).alias("type"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        F.col("s_suppkey").alias("n"),
    )


COLLECTORS = f"""SELECT 'col-' || s_suppkey AS collector_id, 'src-' || s_nationkey AS source_id,
  s_name AS name, {sql_pick(TYPES, 's_suppkey % 4')} AS type, s_acctbal > 0 AS enabled, s_suppkey AS n
  FROM supplier"""

RUN_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'COMPLETED' WHEN 'F' THEN 'FAILED' ELSE 'RUNNING' END"
APPROVAL = (
    "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'APPROVED' WHEN '2' THEN 'REJECTED' ELSE 'PENDING' END"
)
_RUN_COMMON = f"""'run-' || o_orderkey AS run_pk,
  'col-' || (o_custkey % 10) AS collector_id,
  'src-' || (o_custkey % 25) AS source_id,
  {RUN_STATUS} AS status,
  {APPROVAL} AS approval_status,
  CAST(o_orderdate AS TIMESTAMP) AS started_at,
  o_orderkey % 200000 AS seconds,
  o_orderkey AS n,
  CAST(o_orderkey % 7 AS INTEGER) AS pages_crawled"""


def runs(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    done = F.col("o_orderstatus").isin("P", "F")
    return o.select(
        F.concat(F.lit("run-"), "o_orderkey").alias("run_pk"),
        F.concat(F.lit("col-"), F.col("o_custkey") % 10).alias("collector_id"),
        F.concat(F.lit("src-"), F.col("o_custkey") % 25).alias("source_id"),
        F.concat(day, F.format_string("_run_%06d", "o_orderkey")).alias("run_id"),
        F.expr(RUN_STATUS).alias("status"),
        F.expr(APPROVAL).alias("approval_status"),
        F.col("o_orderdate").alias("started_at"),
        F.when(done, F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 200000)")).alias("completed_at"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 7).cast("int").alias("pages_crawled"),
        F.col("o_orderkey").alias("n"),
    )


RUNS = f"""SELECT 'run-' || o_orderkey AS run_pk, 'col-' || (o_custkey % 10) AS collector_id,
  'src-' || (o_custkey % 25) AS source_id,
  strftime(o_orderdate, '%Y-%m-%d') || printf('_run_%06d', o_orderkey) AS run_id,
  {RUN_STATUS} AS status, {APPROVAL} AS approval_status, o_orderdate AS started_at,
  CASE WHEN o_orderstatus IN ('P', 'F') THEN o_orderdate + to_seconds(o_orderkey % 200000) END AS completed_at,
  o_orderdate AS created_at, CAST(o_orderkey % 7 AS INTEGER) AS pages_crawled, o_orderkey AS n FROM orders"""

FILE_STATUS = "CASE l_returnflag WHEN 'N' THEN 'UPLOADED' WHEN 'A' THEN 'DUPLICATE' ELSE 'FAILED' END"
LANGS = ["en", "ckb", "ar", "fr"]
LANG_NAMES = ["English", "Central Kurdish (Sorani)", "Arabic", "French"]
TOPICS = ["history", "general", "unknown", "law"]


def files(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem")
    kind = F.col("l_partkey") % 10
    ext = pick(EXTENSIONS, kind)
    src = F.col("l_suppkey") % 25
    size = F.round(F.col("l_extendedprice") * 100).cast("long")
    name = F.concat(F.lit("Report "), "l_partkey", F.lit(" - "), "l_linenumber", ext)
    lang = (F.col("l_partkey") % 4)
    meta = F.concat(
        F.lit('{"language":{"language":"'), pick(LANGS, lang), F.lit('","language_name":"'), pick(LANG_NAMES, lang),
        F.lit('"},"quality":{"score":'), F.col("l_suppkey") % 101, F.lit('},"kurdish_category":{"category":"'),
        pick(TOPICS, F.col("l_suppkey") % 4), F.lit('","confidence":0.5},"pdf_type":"'),
        F.when(F.col("l_linenumber") == 1, "ocr").otherwise("digital"), F.lit('"}'),
    )
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size.cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("file_pk"),
        F.concat(F.lit("run-"), "l_orderkey").alias("run_pk"),
        F.concat(F.lit("src-"), src).alias("source_id"),
        F.concat(F.lit("https://nation-"), src, F.lit(".example.com/"), pick(["docs", "media", "pub"], F.col("l_partkey") % 3), F.lit("/"), "l_partkey", ext).alias("source_url"),
        name.alias("file_name"),
        F.when(F.col("l_linenumber") != 3, name).alias("original_filename"),
        ext.alias("extension"),
        pick(MIMES, kind).alias("mime_type"),
        size.alias("file_size"),
        F.sha2(F.concat(F.lit("part-"), "l_partkey"), 256).alias("sha256"),
        F.concat(F.lit("00_raw/web/nation_"), src, F.lit("/run-"), "l_orderkey", F.lit("/"), pick(FOLDERS, kind), F.lit("/"), "l_partkey", F.lit("-"), "l_linenumber", ext).alias("storage_key"),
        F.expr(FILE_STATUS).alias("status"),
        F.when(F.col("l_linestatus") == "F", "APPROVED").when(F.col("l_linenumber") == 2, None).otherwise("PENDING").alias("approval_status"),
        meta.alias("metadata"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_partkey").alias("part"),
        F.col("l_linenumber").alias("line"),
    )


FILES = f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS file_pk,
  'run-' || l_orderkey AS run_pk, 'src-' || (l_suppkey % 25) AS source_id,
  'https://nation-' || (l_suppkey % 25) || '.example.com/' || {sql_pick(['docs', 'media', 'pub'], 'l_partkey % 3')} || '/' || l_partkey || {sql_pick(EXTENSIONS, 'l_partkey % 10')} AS source_url,
  'Report ' || l_partkey || ' - ' || l_linenumber || {sql_pick(EXTENSIONS, 'l_partkey % 10')} AS file_name,
  CASE WHEN l_linenumber <> 3 THEN 'Report ' || l_partkey || ' - ' || l_linenumber || {sql_pick(EXTENSIONS, 'l_partkey % 10')} END AS original_filename,
  {sql_pick(EXTENSIONS, 'l_partkey % 10')} AS extension, {sql_pick(MIMES, 'l_partkey % 10')} AS mime_type,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS file_size, sha256('part-' || l_partkey) AS sha256,
  '00_raw/web/nation_' || (l_suppkey % 25) || '/run-' || l_orderkey || '/' || {sql_pick(FOLDERS, 'l_partkey % 10')} || '/' || l_partkey || '-' || l_linenumber || {sql_pick(EXTENSIONS, 'l_partkey % 10')} AS storage_key,
  {FILE_STATUS} AS status,
  CASE WHEN l_linestatus = 'F' THEN 'APPROVED' WHEN l_linenumber = 2 THEN NULL ELSE 'PENDING' END AS approval_status,
  '{{"language":{{"language":"' || {sql_pick(LANGS, 'l_partkey % 4')} || '","language_name":"' || {sql_pick(LANG_NAMES, 'l_partkey % 4')} || '"}},"quality":{{"score":' || (l_suppkey % 101) || '}},"kurdish_category":{{"category":"' || {sql_pick(TOPICS, 'l_suppkey % 4')} || '","confidence":0.5}},"pdf_type":"' || CASE WHEN l_linenumber = 1 THEN 'ocr' ELSE 'digital' END || '"}}' AS metadata,
  l_shipdate AS created_at, l_partkey AS part, l_linenumber AS line FROM lineitem"""


def text_files(spark, d) -> DataFrame:
    """One file row per document."""
    doc = read(spark, d, "documents")
    return doc.select(
        F.concat(F.lit("doc-"), "doc_id").alias("file_pk"),
        F.col("doc_id"),
        F.concat(F.lit("run_"), F.col("doc_id") % 10).alias("run_pk"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), F.col("doc_id") % 500).alias("source_url"),
        F.concat("doc_id", F.lit(".txt")).alias("file_name"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.concat(F.lit("00_raw/web/"), "source", F.lit("/run_"), F.col("doc_id") % 10, F.lit("/text/"), "doc_id", F.lit(".txt")).alias("storage_key"),
        "text",
        "lang",
    )


TEXT_FILES = """SELECT 'doc-' || doc_id AS file_pk, doc_id, 'run_' || (doc_id % 10) AS run_pk, source AS source_id,
  'https://' || source || '.example.com/d/' || (doc_id % 500) AS source_url, doc_id || '.txt' AS file_name,
  sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS file_size,
  '00_raw/web/' || source || '/run_' || (doc_id % 10) || '/text/' || doc_id || '.txt' AS storage_key, text, lang FROM documents"""

LATIN = "abcdefghijklmnopqrstuvwxyz"
KURDISH_ALPHABET = "ابجدەفگهیژکلمنۆپقرستوڤوخێز"
ARABIC_ALPHABET = "بتثجحخدذرزسشصضطظعغفقلمهءةئ"
CYRILLIC_ALPHABET = "абцдефгхийклмнопярстувшжыз"


def scripted(spark, d) -> DataFrame:
    """Documents, each spelled in one of four scripts by a letter map."""
    doc = read(spark, d, "documents")
    text = F.lower("text")
    kind = F.col("doc_id") % 4
    return doc.select(
        "doc_id",
        F.when(kind == 1, F.translate(text, LATIN, KURDISH_ALPHABET))
        .when(kind == 2, F.translate(text, LATIN, ARABIC_ALPHABET))
        .when(kind == 3, F.translate(text, LATIN, CYRILLIC_ALPHABET))
        .otherwise(F.col("text"))
        .alias("text"),
    )


SCRIPTED = f"""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN translate(lower(text), '{LATIN}', '{KURDISH_ALPHABET}')
  WHEN 2 THEN translate(lower(text), '{LATIN}', '{ARABIC_ALPHABET}')
  WHEN 3 THEN translate(lower(text), '{LATIN}', '{CYRILLIC_ALPHABET}') ELSE text END AS text FROM documents"""


def messages(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    kind = F.expr("CASE role WHEN 'user' THEN CASE turn % 4 WHEN 0 THEN 'document' WHEN 2 THEN 'photo' END WHEN 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'audio' ELSE 'video' END END")
    name = F.expr("CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'Vol ' || conv_id || '.PDF' WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'clip ' || turn || '.mp4' END")
    return c.select(
        F.concat(F.lit("chan"), "conv_id").alias("channel"),
        F.col("turn").alias("message_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, turn * 37)").alias("ts"),
        "text",
        (F.length("text") % 13).alias("sender_id"),
        F.length("text").cast("long").alias("views"),
        (F.col("conv_id") % 5).alias("forwards"),
        F.when(F.col("turn") > 0, F.col("turn") - 1 - F.col("turn") % 2).alias("reply_to_id"),
        kind.alias("media_kind"),
        name.alias("media_name"),
        F.expr("CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'image/jpeg' END").alias("media_mime"),
    )


MESSAGES = """SELECT 'chan' || conv_id AS channel, turn AS message_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn * 37) AS ts, text, length(text) % 13 AS sender_id,
  CAST(length(text) AS BIGINT) AS views, conv_id % 5 AS forwards,
  CASE WHEN turn > 0 THEN turn - 1 - turn % 2 END AS reply_to_id,
  CASE role WHEN 'user' THEN CASE turn % 4 WHEN 0 THEN 'document' WHEN 2 THEN 'photo' END WHEN 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'audio' ELSE 'video' END END AS media_kind,
  CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'Vol ' || conv_id || '.PDF' WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'clip ' || turn || '.mp4' END AS media_name,
  CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'image/jpeg' END AS media_mime FROM conversations"""


def segments(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("medium_id"),
        F.col("turn").cast("int").alias("chunk_index"),
        (F.col("turn") * 30.0).alias("start_s"),
        (F.col("turn") * 30.0 + 30.0 - F.col("conv_id") % 3).alias("end_s"),
        F.col("text").alias("transcript"),
        F.when(F.col("role") != "system", F.col("role")).alias("speaker"),
        F.lit("fr").alias("language"),
        F.concat(F.lit("/tmp/audio/"), "conv_id", F.lit("_"), "turn", F.lit(".mp3")).alias("audio_file"),
        F.concat(F.lit("talk "), "conv_id").alias("title"),
        F.concat(F.lit("https://media.example.com/"), "conv_id").alias("source_url"),
    )


SEGMENTS = """SELECT 'm' || conv_id AS medium_id, CAST(turn AS INTEGER) AS chunk_index, CAST(turn * 30.0 AS DOUBLE) AS start_s,
  CAST(turn * 30.0 + 30.0 - conv_id % 3 AS DOUBLE) AS end_s, text AS transcript, CASE WHEN role <> 'system' THEN role END AS speaker,
  'fr' AS language, '/tmp/audio/' || conv_id || '_' || turn || '.mp3' AS audio_file, 'talk ' || conv_id AS title,
  'https://media.example.com/' || conv_id AS source_url FROM conversations"""

EVENT_KIND = "CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'found' WHEN 'purchase' THEN 'downloaded' WHEN 'signup' THEN 'duplicate' ELSE 'failed' END"


def run_events(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("run-"), "user_id").alias("run_id"),
        "ts",
        F.expr(EVENT_KIND).alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
        pick(FOLDERS, F.col("event_id") % 10).alias("category"),
        F.concat(F.lit("f"), "event_id", F.lit(".bin")).alias("file_name"),
    )


RUN_EVENTS = f"""SELECT event_id, 'run-' || user_id AS run_id, ts, {EVENT_KIND} AS kind,
  CAST(round(value * 100) AS BIGINT) AS bytes, {sql_pick(FOLDERS, 'event_id % 10')} AS category,
  'f' || event_id || '.bin' AS file_name FROM events"""

STATUS_MOVE = "CASE event_type WHEN 'signup' THEN 'RUNNING' WHEN 'click' THEN 'PAUSED' WHEN 'view' THEN 'RESUME' WHEN 'purchase' THEN 'COMPLETED' ELSE 'CANCEL_REQUESTED' END"


def status_events(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("run-"), F.col("event_id") % 1000).alias("run_id"),
        "ts",
        F.expr(STATUS_MOVE).alias("move"),
    )


STATUS_EVENTS = f"SELECT event_id, 'run-' || (event_id % 1000) AS run_id, ts, {STATUS_MOVE} AS move FROM events"

ERROR_KINDS = ["NETWORK_ERROR", "TIMEOUT", "HTTP_ERROR", "NOT_FOUND", "FILE_TOO_LARGE"]
ERROR_TEXTS = ["HTTP 503 for url", "ReadTimeout", "HTTP 404 for url", "SSL failure", "ConnectError"]


def errors(spark, d) -> DataFrame:
    """One error per failed file event."""
    e = read(spark, d, "events").where("event_type = 'error'")
    return e.select(
        F.concat(F.lit("err-"), "event_id").alias("error_id"),
        F.concat(F.lit("run-"), "user_id").alias("run_pk"),
        pick(ERROR_KINDS, F.col("event_id") % 5).alias("error_code"),
        F.concat(pick(ERROR_TEXTS, F.col("event_id") % 5), F.lit(" "), "event_id").alias("message"),
        F.concat(F.lit("https://x.example.com/"), "event_id").alias("url"),
        F.col("ts").alias("created_at"),
    )


ERRORS = f"""SELECT 'err-' || event_id AS error_id, 'run-' || user_id AS run_pk, {sql_pick(ERROR_KINDS, 'event_id % 5')} AS error_code,
  {sql_pick(ERROR_TEXTS, 'event_id % 5')} || ' ' || event_id AS message, 'https://x.example.com/' || event_id AS url,
  ts AS created_at FROM events WHERE event_type = 'error'"""

CTE = {
    "sources": SOURCES, "collectors": COLLECTORS, "runs": RUNS, "files": FILES,
    "text_files": TEXT_FILES, "scripted": SCRIPTED, "messages": MESSAGES, "segments": SEGMENTS,
    "run_events": RUN_EVENTS, "status_events": STATUS_EVENTS, "errors": ERRORS,
}


def with_tables(body: str, *names: str) -> str:
    """SQL with the named derived tables in scope; ``body`` may start with more CTEs."""
    parts = [f"{n} AS ({CTE[n]})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
