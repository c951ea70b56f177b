"""Message, media and run-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions import media as MD
from siftloom.operators import messages as MS
from siftloom.plans import tables as t
from siftloom.plans.registry import query
from siftloom.plans.tables import with_tables
from siftloom.streaming import runs as RN


@query("W3_latest_messages", with_tables("SELECT channel, message_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_id DESC) AS r FROM messages) WHERE r <= 3 AND ts >= TIMESTAMP '2024-01-01 01:00:00'", "messages"))
def w3(spark, d):
    m = MS.latest_messages(t.messages(spark, d), 3, F.expr("TIMESTAMP_NTZ '2024-01-01 01:00:00'"))
    return m.select("channel", "message_id")


@query("W3_large_limit", with_tables("SELECT channel, message_id FROM messages QUALIFY row_number() OVER (PARTITION BY channel ORDER BY message_id DESC) <= 5000", "messages"))
def w3b(spark, d):
    return MS.latest_messages(t.messages(spark, d), 5000).select("channel", "message_id")


@query("F7_media_filter", with_tables("""SELECT channel, message_id, CASE media_kind WHEN 'document' THEN 'Vol_' || substring(channel, 5) || '.pdf' WHEN 'photo' THEN 'photo_' || message_id || '.jpg' ELSE 'clip_' || message_id || '.mp4' END AS file_name,
  CASE media_kind WHEN 'document' THEN '.pdf' WHEN 'photo' THEN '.jpg' ELSE '.mp4' END AS extension FROM messages WHERE media_kind IN ('document', 'photo')""", "messages"))
def f7(spark, d):
    a = MS.message_artifacts(t.messages(spark, d), include_kinds=["document", "photo"], allowed_extensions=["pdf", ".jpg", ".mp4"])
    return a.select("channel", "message_id", "file_name", "extension")


@query("M14_message_artifacts", with_tables("""SELECT channel, message_id, 'media' AS artifact, 'https://t.me/' || channel || '/' || message_id AS url, CASE media_kind WHEN 'document' THEN '.pdf' WHEN 'photo' THEN '.jpg' ELSE '.mp4' END AS extension FROM messages WHERE media_kind IN ('document', 'photo', 'video')
UNION ALL SELECT channel, message_id, 'record', 'https://t.me/' || channel || '/' || message_id || '#message', '.json' FROM messages""", "messages"))
def m14(spark, d):
    return MS.message_artifacts(t.messages(spark, d), save_records=True).select("channel", "message_id", "artifact", "url", "extension")


@query("D14_reply_resolution", with_tables("SELECT m.channel, m.message_id, r.sender_id AS reply_sender, md5(r.text) AS reply_digest FROM messages m LEFT JOIN messages r ON m.channel = r.channel AND m.reply_to_id = r.message_id", "messages"))
def d14(spark, d):
    r = MS.resolve_replies(t.messages(spark, d))
    return r.select("channel", "message_id", "reply_sender", F.md5("reply_text").alias("reply_digest"))


@query("A21_channel_activity", with_tables("SELECT channel, count(*) AS messages, count(*) FILTER (media_kind IN ('document', 'photo', 'video')) AS media, CAST(sum(views) AS BIGINT) AS views, CAST(sum(forwards) AS BIGINT) AS forwards, max(message_id) AS last_message, 1 AS pages_crawled FROM messages GROUP BY channel", "messages"))
def a21(spark, d):
    return MS.channel_activity(t.messages(spark, d))


_STT = """SELECT medium_id, title || printf('_chunk_%03d', chunk_index) AS chunk_id, split_part(audio_file, '/', 4) AS audio_filename, end_s - start_s AS duration_seconds, transcript, coalesce(speaker, 'Speaker') AS speaker, chunk_index, start_s, end_s FROM segments"""


@query("X33_stt_records", with_tables(f"SELECT chunk_id, audio_filename, duration_seconds, speaker, md5(transcript) AS digest FROM ({_STT})", "segments"))
def x33(spark, d):
    return MD.stt_records(t.segments(spark, d)).select("chunk_id", "audio_filename", "duration_seconds", "speaker", F.md5("transcript").alias("digest"))


@query("P33_tts_records", with_tables(f"SELECT chunk_id AS id, audio_filename AS audio_reference, duration_seconds, speaker AS speaker_id, md5(transcript) AS digest FROM ({_STT})", "segments"))
def p33(spark, d):
    r = MD.tts_records(MD.stt_records(t.segments(spark, d)))
    return r.select("id", "audio_reference", "duration_seconds", "speaker_id", F.md5("text_prompt").alias("digest"))


@query("A14_full_transcript", with_tables(f"SELECT medium_id, chunk_index // 2 AS part_no, md5(string_agg('[' || printf('%.1f', start_s) || 's - ' || printf('%.1f', end_s) || 's] ' || speaker || ': ' || transcript, chr(10) ORDER BY chunk_index)) AS digest FROM ({_STT}) GROUP BY ALL", "segments"))
def a14(spark, d):
    parts = MD.transcript_parts(MD.stt_records(t.segments(spark, d)), part_size=2)
    return parts.select("medium_id", "part_no", F.md5("text").alias("digest"))


@query("X34_time_segments", """WITH s AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS dur FROM documents), c AS (SELECT doc_id, dur, unnest(range(0, CAST(ceil(dur / 30) AS BIGINT))) AS i FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, i * 30.0::DOUBLE AS start_s, round(least((i + 1) * 30.0::DOUBLE, dur), 2) AS end_s FROM c""")
def x34(spark, d):
    s = t.read(spark, d, "documents").select("doc_id", F.inline(MD.segments(F.col("n_chars") / 10.0, 30)))
    return s.select("doc_id", "chunk_index", "start_s", "end_s")


@query("W7_segment_chaining", with_tables("SELECT medium_id, chunk_index, CAST(sum(end_s - start_s) OVER w - (end_s - start_s) AS DOUBLE) AS start_s, CAST(sum(end_s - start_s) OVER w AS DOUBLE) AS end_s FROM segments WINDOW w AS (PARTITION BY medium_id ORDER BY chunk_index)", "segments"))
def w7(spark, d):
    s = t.segments(spark, d).select("medium_id", "chunk_index", (F.col("end_s") - F.col("start_s")).alias("duration_s"))
    return MD.chain_segments(s, block=2).select("medium_id", "chunk_index", "start_s", "end_s")


_FOLD = f"""o AS (SELECT run_id, move, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM status_events),
st AS (SELECT run_id, 0 AS n, 'PENDING' AS status FROM (SELECT DISTINCT run_id FROM o) UNION ALL SELECT o.run_id, o.n, CASE o.move
  WHEN 'CANCEL_REQUESTED' THEN CASE WHEN st.status IN ('PENDING', 'RUNNING', 'PAUSED', 'CANCEL_REQUESTED') THEN 'CANCEL_REQUESTED' ELSE st.status END
  WHEN 'PAUSED' THEN CASE WHEN st.status IN ('PENDING', 'RUNNING', 'CANCEL_REQUESTED', 'PAUSED') THEN 'PAUSED' ELSE st.status END
  WHEN 'RESUME' THEN CASE WHEN st.status = 'PAUSED' THEN 'RUNNING' ELSE st.status END
  WHEN 'RUNNING' THEN CASE WHEN st.status IN ('CANCEL_REQUESTED', 'CANCELLED', 'COMPLETED', 'FAILED', 'PAUSED') THEN st.status ELSE 'RUNNING' END ELSE o.move END FROM st JOIN o ON o.run_id = st.run_id AND o.n = st.n + 1)"""


@query("W9_T2_run_states", with_tables(f"WITH RECURSIVE {_FOLD} SELECT run_id, status, n AS moves FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1", "status_events").replace("WITH status_events", "WITH RECURSIVE status_events").replace(", RECURSIVE ", ", "))
def w9(spark, d):
    return RN.final_status(t.status_events(spark, d))


@query("W9_one_run", with_tables(f"WITH RECURSIVE {_FOLD.replace('PARTITION BY run_id ', '').replace('SELECT run_id, move', "SELECT 'all' AS run_id, move")} SELECT run_id, status, n AS moves FROM st ORDER BY n DESC LIMIT 1", "status_events").replace("WITH status_events", "WITH RECURSIVE status_events").replace(", RECURSIVE ", ", "))
def w9_one(spark, d):
    return RN.final_status(t.status_events(spark, d).withColumn("run_id", F.lit("all")), block=4)


@query("T5_error_log", with_tables("SELECT 'err-' || event_id AS error_id, run_id AS run_pk FROM run_events WHERE kind = 'failed'", "run_events"))
def t5(spark, d):
    return RN.error_log(t.run_events(spark, d)).select("error_id", "run_pk")


@query("T5_audit_log", with_tables("SELECT 'aud-' || event_id AS audit_id, CASE move WHEN 'PAUSED' THEN 'run.paused' WHEN 'RESUME' THEN 'run.resumed' ELSE 'run.cancel_requested' END AS action, run_id AS entity_id FROM status_events WHERE move IN ('PAUSED', 'RESUME', 'CANCEL_REQUESTED')", "status_events"))
def t5b(spark, d):
    return RN.audit_log(t.status_events(spark, d)).select("audit_id", "action", "entity_id")
