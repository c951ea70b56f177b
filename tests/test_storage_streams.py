import io
import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from siftloom.functions.media import stt_records
from siftloom.operators import dedup as DD
from siftloom.operators import reports as RP
from siftloom.sources import sinks as SN
from siftloom.sources import storage as ST
from siftloom.streaming import runs as RN


def put(root, key, body):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<c xmlns="x"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></c>',
    "O/c.opf": '<p xmlns:dc="d"><dc:title> My Book </dc:title><manifest><item href="a.xhtml"/><item href="s.css"/></manifest></p>',
    "O/a.xhtml": "<p>Chapter <b>one</b></p>",
}
DOCX = {
    "word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>Hello</w:t><w:t>there</w:t></w:p></w:d>',
    "docProps/core.xml": '<c xmlns:dc="d"><dc:title>Doc</dc:title></c>',
}


def test_jsonl_keeps_bad_lines(spark, folder):
    put(folder, "r/metadata.jsonl", '{"a":1}\n\n  \nnot json\n[2]\n')
    lines = {r.line for r in ST.read_jsonl(spark, folder).collect()}
    assert lines == {'{"a":1}', '{"raw":"not json"}', "[2]"}


def tree(spark, folder):
    put(folder, "00_raw/web/alpha/run_1/manifest.json", json.dumps({"run_id": "run_1", "source_slug": "Alpha", "stats": {"total_files": 4, "pages_visited": 7}}))
    put(folder, "00_raw/web/alpha/run_2/manifest.json", "broken {")
    put(folder, "00_raw/web/alpha/run_1/metadata.jsonl", "\n".join([
        json.dumps({"file_id": "RAW-UNKNOWN", "file_name": "m.pdf", "sha256": "AB", "file_size": 9, "r2_key": "00_raw/web/alpha/run_1/pdf/m.pdf"}),
        json.dumps({"file_id": "RAW-000000005", "file_name": "known.pdf", "sha256": "CD"}), "oops"]))
    put(folder, "00_raw/web/alpha/run_1/text/t.txt", b"caf\xc3\xa9 \xff ok")
    put(folder, "00_raw/web/alpha/run_1/ebooks/b.epub", zipped(**EPUB))
    put(folder, "00_raw/web/alpha/run_1/documents/d.docx", zipped(**DOCX))
    put(folder, "00_raw/web/alpha/run_1/documents/bad.docx", b"PK nonsense")
    put(folder, "00_raw/web/alpha/run_1/data/j.json", '{"title":"J"}')
    return ST.read_storage(spark, folder)


def test_storage_scan_and_texts(spark, folder):
    objects = tree(spark, folder)
    kinds = {r.key.rsplit("/", 1)[1]: (r.kind, r.size) for r in objects.collect()}
    assert kinds["manifest.json"][0] == "manifest" and kinds["metadata.jsonl"][0] == "metadata" and kinds["t.txt"] == ("content", 10)
    found = ST.extract_texts(objects.where("kind = 'content'")).collect()
    texts = {r.key.rsplit("/", 1)[1]: (r.text, r.title) for r in found}
    assert {r.key.rsplit("/", 1)[1]: r.error.split(":")[0] for r in found if r.error} == {"bad.docx": "BAD_ARCHIVE"}
    assert texts["t.txt"][0] == "café  ok" and texts["b.epub"] == (" Chapter  one  ".replace("  one  ", "  one  "), "My Book")
    assert texts["d.docx"] == ("Hello there", "Doc") and texts["bad.docx"] == (None, None)


def test_manifest_precedence(spark, folder):
    objects = tree(spark, folder)
    runs = spark.createDataFrame([("p1", "run_1", "alpha", "WEB", "gone/manifest.json"), ("p2", "run_2", "alpha", "WEB", None), ("p3", "run_3", "alpha", "WEB", None)],
                                 "run_pk string, run_id string, slug string, collector_type string, manifest_key string")
    got = {r.run_pk: r for r in ST.read_manifests(runs, objects).collect()}
    assert set(got) == {"p1", "p2"} and got["p1"].manifest.run_id == "run_1" and got["p2"].raw == "broken {"


def test_recovery(spark, folder):
    objects = tree(spark, folder)
    manifests = objects.where("kind = 'manifest'").select("key", F.decode("content", "UTF-8").alias("text"))
    none = spark.createDataFrame([], "run_id string, run_pk string")
    runs = ST.recover_runs(manifests, none).collect()
    assert [(r.run_id, r.source_slug, r.files_downloaded, r.pages_crawled, r.status) for r in runs] == [("run_1", "alpha", 4, 7, "COMPLETED")]
    known = spark.createDataFrame([("run_1", "x")], "run_id string, run_pk string")
    assert ST.recover_runs(manifests, known).count() == 0

    lines = ST.tolerant_lines(objects.where("kind = 'metadata'").select("key", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value")))
    candidates = ST.files_from_metadata(lines).unionByName(ST.files_from_objects(objects))
    catalog = spark.createDataFrame([("cd", "elsewhere"), (None, "/00_raw/web/alpha/run_1/text/t.txt")], "sha256 string, storage_key string")
    got = {r.file_name: r for r in ST.recover_files(candidates, catalog).collect()}
    assert set(got) == {"m.pdf", "b.epub", "d.docx", "bad.docx", "j.json"}
    assert got["m.pdf"].sha256 == "ab" and got["m.pdf"].file_id is None and got["m.pdf"].run_key == "run_1"
    assert got["j.json"].metadata == '{"title":"J"}' and got["j.json"].mime_type == "application/json"

    files = spark.createDataFrame([("f1", None, "00_raw/web/alpha/run_1/text/t.txt"), ("f2", "keep", "00_raw/web/alpha/run_1/a.txt")], "file_pk string, run_pk string, storage_key string")
    attached = ST.attach_orphans(files, spark.createDataFrame([("RUN_1", "pk1")], "run_id string, run_pk string"))
    assert {r.file_pk: r.run_pk for r in attached.collect()} == {"f1": "pk1", "f2": "keep"}


def test_json_preview(spark):
    files = spark.createDataFrame([("1", "k1", None, "a"), ("2", "k2", None, "b"), ("3", None, '{"m":1}', "c"), ("4", "gone", None, "d")],
                                  "file_pk string, storage_key string, metadata string, file_name string")
    objects = spark.createDataFrame([("k1", bytearray(b'{"x":1}')), ("k2", bytearray(b"plain"))], "key string, content binary")
    got = {r.file_pk: (r.is_json, r.data, r.raw) for r in ST.json_previews(files, objects).collect()}
    assert got["1"] == (True, '{"x":1}', None) and got["2"] == (False, None, "plain") and got["3"] == (True, '{"m":1}', None)
    assert json.loads(got["4"][1]) == {"file_name": "d", "storage_key": "gone"}


EVENTS = "event_id long, run_id string, ts timestamp_ntz, kind string, bytes long, category string, file_name string"


def event_rows(spark):
    kinds = ["found", "downloaded", "duplicate", "failed", "page"]
    rows = [(i, f"r{i % 3}", None, kinds[i % 5], i, "pdf/ocr", f"f{i}") for i in range(60)]
    return spark.createDataFrame(rows, EVENTS)


def test_sinks(spark, folder):
    events = event_rows(spark)
    SN.write_manifests(RP.run_manifest(events), folder + "/m")
    back = spark.read.text(folder + "/m/runs")
    assert {r.run for r in back.select("run").collect()} == {"r0", "r1", "r2"}
    assert json.loads(back.collect()[0].value)["categories"]["pdf/ocr"]["metadata_path"] == "pdf/ocr/metadata.jsonl"
    SN.write_category_manifests(RP.category_manifest(events), RP.category_manifest_parts(events), folder + "/c")
    assert spark.read.text(folder + "/c/files").count() == 3
    files = events.select(F.col("run_id").alias("run_pk"), "file_name", "category")
    SN.write_metadata(files, folder + "/meta")
    assert spark.read.json(folder + "/meta/runs").count() == 60 and spark.read.json(folder + "/meta/categories").count() == 60
    key = SN.key_category(F.lit("/00_raw/web/a/r1/pdf/ocr/x.pdf"), F.lit("00_raw/web/a/r1"))
    assert spark.range(1).select(key.alias("k")).collect()[0].k == "pdf/ocr"


def test_speech_datasets(spark, folder):
    rows = [("m", i, i * 30.0, i * 30.0 + 30, f"line {i}", None, "ku", f"/t/{i}.mp3", "Talk", "u") for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "medium_id string, chunk_index int, start_s double, end_s double, transcript string, speaker string, language string, audio_file string, title string, source_url string")
    first = stt_records(df).orderBy("chunk_index").collect()[0]
    assert (first.chunk_id, first.speaker, first.duration_seconds) == ("Talk_chunk_000", "Speaker", 30.0)
    SN.write_speech_datasets(df, folder)
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(folder + "/transcript").collect())
    assert text.startswith("Source: Talk\nURL: u\n\n[0.0s - 30.0s] Speaker: line 0\n[30.0s") and spark.read.json(folder + "/tts").count() == 3


def test_speech_datasets_of_many_media(spark, folder, monkeypatch):
    """Files of lines go by tasks, not by media; transcripts are dealt to tasks by their number, not by their bytes."""
    df = spark.range(600).select(
        F.expr("'m' || id DIV 2").alias("medium_id"), F.expr("CAST(id % 2 AS int)").alias("chunk_index"), F.expr("id % 2 * 30D").alias("start_s"), F.expr("id % 2 * 30D + 30").alias("end_s"),
        F.expr("'line ' || id").alias("transcript"), F.lit("a").alias("speaker"), F.lit("ku").alias("language"), F.lit("/t/a.mp3").alias("audio_file"), F.expr("'talk ' || id DIV 2").alias("title"), F.lit("u").alias("source_url")).repartition(4)
    SN.write_speech_datasets(df, folder)
    parts = lambda top: [os.path.join(d, n) for d, _, names in os.walk(f"{folder}/{top}") for n in names if n.startswith("part-")]
    assert len(parts("stt")) == 4 and len(parts("tts")) == 4 and len(parts("transcript")) == 300
    stt = spark.read.json(f"{folder}/stt").select("medium_id", "transcript")
    assert sorted(map(tuple, stt.collect())) == sorted((f"m{i // 2}", f"line {i}") for i in range(600))
    text = {r.medium_id: r.value for r in spark.read.text(f"{folder}/transcript", wholetext=True).collect()}
    assert text == {f"m{i}": f"Source: talk {i}\nURL: u\n\n[0.0s - 30.0s] a: line {2 * i}\n[30.0s - 60.0s] a: line {2 * i + 1}\n" for i in range(300)}
    # the first number of a file's name is that of its task
    assert len({re.search(r"part-(\d+)", p)[1] for p in parts("transcript")}) == 8
    monkeypatch.setattr(SN, "TASK_FOLDERS", 10)
    assert SN._tasks(df, "medium_id") > 25


# --- streams and their batch twins -------------------------------------------


def stream_of(spark, df, folder, name):
    """The rows as a file stream of several batches."""
    path = f"{folder}/{name}"
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counters_stream_equals_batch(spark, folder):
    events = event_rows(spark)
    latest = {}

    def sink(batch, _):
        latest.update({r.run_id: tuple(r) for r in batch.collect()})

    q = RN.start_counters(stream_of(spark, events, folder, "e"), folder + "/cp", sink)
    q.processAllAvailable()
    q.stop()
    assert latest == {r.run_id: tuple(r) for r in RP.run_counters(events).collect()}


@pytest.mark.parametrize("split", ["event_id % 3", "event_id DIV 20", "2 - event_id DIV 20", "0"])
def test_run_states_do_not_depend_on_batches(spark, folder, split):
    """Moves in any order and any batches end like the batch twin, with the same answers in event order."""
    draw = random.Random(9)
    moves = ["RUNNING", "PAUSED", "RESUME", "CANCEL_REQUESTED", "COMPLETED", "FORCE_CANCEL"]
    rows = [(f"r{i % 4}", i, i // 3 * 700 + i % 2, draw.choice(moves)) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id string, event_id long, ms long, move string").selectExpr(
        "run_id", "event_id", "timestamp_millis(1700000000000 + ms) AS ts", "move")
    for part in range(3):
        df.where(f"{split} = {part}").coalesce(1).write.mode("append").parquet(folder + "/s")
    # a later move of another run takes the watermark past all of them
    spark.sql("SELECT 'z' AS run_id, 99L AS event_id, timestamp_millis(1800000000000) AS ts, 'RUNNING' AS move").coalesce(1).write.mode("append").parquet(folder + "/s")
    seen = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/s")
    q = (RN.run_states(stream).writeStream.outputMode("append").option("checkpointLocation", folder + "/cp")
         .foreachBatch(lambda b, _: seen.extend(b.collect())).start())
    q.processAllAvailable()
    q.stop()
    want, current = [], {}
    for run, event_id, _, move in sorted(rows, key=lambda r: (r[2], r[1])):
        before = current.get(run, "PENDING")
        current[run], accepted = RN.next_status(before, move)
        want.append((run, event_id, move, before, current[run], accepted))
    assert sorted(map(tuple, seen)) == sorted(want)
    assert current == {r.run_id: r.status for r in RN.final_status(df).collect()}


def test_known_files_are_skipped(spark, folder):
    """Files of any batch, repeats included, are admitted as by a replay; a restart goes on."""
    draw = random.Random(12)
    rows = [(i, "s", draw.choice(["", None, *[f"u{k}" for k in range(90)]]), draw.choice(["", None, *[f"h{k}" for k in range(90)]])) for i in range(90)]
    stored = [("s", "u1", "zz", "UPLOADED"), ("s", "x", "h2", "UPLOADED"), ("s", "u3", "h3", "FAILED"), ("other", "u4", None, "UPLOADED")]
    catalog = spark.createDataFrame(stored, "source_id string, source_url string, sha256 string, status string")
    want, urls, hashes = [], {"u1"}, {"zz", "h2"}
    for i, _, url, sha in rows:
        if url not in urls and sha not in hashes:
            want.append(i)
            urls.update({url} - {None, ""})
            hashes.update({sha} - {None, ""})
    schema = "n long, source_id string, source_url string, sha256 string"
    for start in range(0, 90, 15):
        spark.createDataFrame(rows[start: start + 15], schema).coalesce(1).write.mode("append").parquet(folder + "/in")
        if start in (15, 45, 75):  # two files are there at each start, one per batch
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
            q = RN.start_known_file_skip(stream, lambda: catalog, folder + "/out", folder + "/cp", "n", merge=2)
            q.processAllAvailable()
            q.stop()
    out = spark.read.parquet(folder + "/out")
    assert out.select("batch").distinct().count() == 6
    assert sorted(r.n for r in out.collect()) == want
    files = spark.createDataFrame(rows, schema)
    assert sorted(r.n for r in DD.admitted(files, catalog, "n").collect()) == want


def test_page_ingestion_and_logs(spark, folder):
    good = "<title>T</title><main>" + "<p>Several useful words in one readable line here.</p><p>And another longer line of text.</p>" + "</main>"
    df = spark.createDataFrame([(1, "https://e.com/a", good), (2, "https://e.com/b", "<p>short</p>")], "page_id long, url string, html string")
    q = RN.start_page_ingestion(stream_of(spark, df, folder, "p"), folder + "/out", folder + "/cp")
    q.processAllAvailable()
    q.stop()
    assert [r.page_id for r in spark.read.parquet(folder + "/out").collect()] == [1]
    q = RN.start_log(RN.error_log(stream_of(spark, event_rows(spark), folder, "l")), folder + "/log", folder + "/cp2")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(folder + "/log").count() == 12
