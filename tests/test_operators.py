import random

import pytest
from pyspark.sql import functions as F

from siftloom.functions import conformance as C
from siftloom.functions import files as FN
from siftloom.operators import catalog as CT
from siftloom.operators import changes as CH
from siftloom.operators import frontier as FR
from siftloom.operators import messages as MS
from siftloom.operators import reports as RP
from siftloom.operators import skew as SK
from siftloom.streaming import runs as RN


# --- skew helpers against brute force ----------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are NULL."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(40)}", rng.randrange(1000)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, key string, v long")


@pytest.mark.parametrize("hot_rows", [10, 10_000_000])
def test_attach_per_key(skewed, hot_rows):
    rows, df = skewed
    lookup = df.where("key IS NOT NULL").groupBy("key").agg(F.min("v").alias("low"), F.count("*").alias("_n"))
    got = {r.id: r.low for r in SK.attach_per_key(df, lookup, ["key"], ["id"], hot_rows=hot_rows).collect()}
    low = {}
    for _, k, v in rows:
        if k is not None:
            low[k] = min(low.get(k, v), v)
    assert got == {i: low.get(k) for i, k, _ in rows}


def test_positions(skewed):
    rows, df = skewed
    order = [F.col("v"), F.col("id")]
    got = {r.id: r.position for r in SK.with_positions(df, order).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    keyed = df.where("key IS NOT NULL")
    got = {r.id: r.position for r in SK.with_positions_per_key(keyed, ["key"], order).collect()}
    seen, want = {}, {}
    for i, k, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[0])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert got == want


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_group(skewed, k):
    rows, df = skewed
    got = {r.id for r in SK.top_per_group(df, ["key"], [F.desc("v"), F.col("id")], k, spread=F.col("id")).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    want = {r[0] for g in groups.values() for r in sorted(g, key=lambda r: (-r[2], r[0]))[:k]}
    assert got == want


def test_group_limit_is_applied_before_the_shuffle(skewed):
    _, df = skewed
    plan = SK.keep_first(df, ["key"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --- graph -------------------------------------------------------------------


def test_frontier_walk(spark):
    base = "http://site.example.com"
    links = [("/", "/a"), ("/", "/one.pdf"), ("/a", "/"), ("/a", "/b#x"), ("/a", "/one.pdf?utm_source=q"), ("/b", "/two.pdf"),
             ("/b", "https://other.example.org/c"), ("/b", "/skip/me"), ("/b", "http://10.0.0.1/x"), ("/a", "https://usrfiles.com/ugd/k.pdf")]
    df = spark.createDataFrame([(base + s, d) for s, d in links], "page_url string, url string")
    start = spark.createDataFrame([(base,)], "url string")
    pages, files = FR.expand_frontier(df, start, domains=["site.example.com"], exclude=["/skip/"], max_depth=3)
    assert {(r.url, r.depth) for r in pages.collect()} == {(base + "/", 0), (base + "/a", 1), (base + "/b", 2)}
    assert {(r.url, r.depth) for r in files.collect()} == {
        (base + "/one.pdf", 0), (base + "/two.pdf", 2), ("https://usrfiles.com/ugd/k.pdf", 1)}
    pages, files = FR.expand_frontier(df, start, domains=["site.example.com"], max_depth=1)
    assert pages.count() == 2 and {r.url for r in files.collect()} == {base + "/one.pdf"}
    assert FR.expand_frontier(df, start, max_pages=2)[0].count() == 2


def allowed(spark, body, url, status=200, agent="Mozilla/5.0 (X11)"):
    robots = spark.createDataFrame([("e.com", status, body)], "host string, status int, body string")
    rows = spark.createDataFrame([(url,)], "url string")
    return FR.robots_allowed(rows, robots, agent).collect()[0].robots_allowed


@pytest.mark.parametrize("body,url,status,expected", [
    ("User-agent: *\nDisallow: /private/\n", "https://e.com/public/page", 200, True),
    ("User-agent: *\nDisallow: /private/\n", "https://e.com/private/page", 200, False),
    ("User-agent: *\nDisallow: /", "https://e.com/x", 404, True),
    ("User-agent: *\nDisallow: /", "https://none.com/x", 200, True),
    ("User-agent: *\nAllow: /a\nDisallow: /", "https://e.com/a", 200, True),
    ("User-agent: *\nDisallow: /\n\nUser-agent: mozilla\nDisallow: /m", "https://e.com/x", 200, True),
    ("User-agent: *\n\nDisallow: /", "https://e.com/x", 200, True),
    ("User-agent: a\nUser-agent: mozilla # me\nDisallow: /x?q", "https://e.com/x?q=1", 200, False),
    ("User-agent: mozilla\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /", "https://e.com/x", 200, True),
])
def test_robots(spark, body, url, status, expected):
    assert allowed(spark, body, url, status) is expected


# --- manifests, catalog ------------------------------------------------------


def test_manifest_counts(spark):
    kinds = ["found", "found", "downloaded", "skipped", "duplicate", "failed"]
    df = spark.createDataFrame([("r", k, 10, "/pdf/ocr/", f"{i}", i) for i, k in enumerate(kinds)],
                               "run_id string, kind string, bytes long, category string, file_name string, event_id long")
    m = RP.run_manifest(df).collect()[0]
    assert (m.files_found, m.files_downloaded, m.total_bytes) == (4, 1, 10)
    assert list(m.categories) == ["pdf/ocr"] and m.categories["pdf/ocr"].manifest_path == "pdf/ocr/manifest.json"


def test_category_lists_are_whole_and_split(spark):
    rows = [("r", "downloaded", 1, "hot", f"f{i}", i) for i in range(1000)] + [("r", "downloaded", 1, "small", "x", 5000)]
    df = spark.createDataFrame(rows, "run_id string, kind string, bytes long, category string, file_name string, event_id long")
    parts = RP.category_manifest_parts(df, part_size=100).collect()
    assert sum(len(p.files) for p in parts) == 1001 and max(len(p.files) for p in parts) < 200
    assert sum(p.category == "hot" for p in parts) == 10


FILES = ("file_pk string, file_id string, run_pk string, source_id string, source_url string, file_name string, original_filename string, "
         "canonical_filename string, extension string, mime_type string, file_size long, sha256 string, storage_key string, "
         "status string, metadata string, created_at int")


def file_rows(spark, *rows):
    names = [c.split()[0] for c in FILES.split(", ")]
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, FILES)


def test_process_twice_changes_nothing_more(spark):
    f = file_rows(
        spark,
        dict(file_pk="1", file_id="RAW-000000001", file_name="a b.pdf", original_filename="a b.pdf", sha256="x", status="UPLOADED", created_at=1),
        dict(file_pk="2", file_id="RAW-000000002", file_name="c.pdf", sha256="x", status="UPLOADED", metadata='{"k":1}', created_at=2),
        dict(file_pk="3", file_id="RAW-000000003", file_name="d.txt", original_filename="d.txt", sha256=" ", status="UPLOADED", created_at=3))
    once = CH.apply_processing(f)
    got = {r.file_pk: r for r in once.collect()}
    assert got["1"].file_name == "a_b-RAW-000000001.pdf" and got["1"].status == "UPLOADED"
    assert got["2"].status == "DUPLICATE" and '"k":1' in got["2"].metadata and got["3"].status == "UPLOADED"
    assert {r.file_pk: r.file_name for r in CH.apply_processing(once).collect()} == {k: r.file_name for k, r in got.items()}
    assert [r.file_pk for r in CH.preview_processing(f).collect()] == ["1", "2", "3"]


def test_metadata_approval_lines(spark):
    lines = spark.createDataFrame([('{"a":1}',), ("bad",), ('{"a":"x","approval_status":"PENDING"}',), ("{}",)], "value string")
    out = [r.value for r in CH.approve_metadata_lines(lines, "APPROVED", "R", F.lit("t")).collect()]
    tail = '"approval_status":"APPROVED","approved_by":"R","approved_at":"t"}'
    assert out == ['{"a":1,' + tail, "bad", '{"a":"x",' + tail, "{" + tail]


def test_file_filter_by_run_name(spark):
    f = file_rows(spark, dict(file_pk="1", run_pk="r1"), dict(file_pk="2", run_pk="r2"), dict(file_pk="3"))
    runs = spark.createDataFrame([("r1", "2024-01-01_run_000001")], "run_pk string, run_id string")
    assert [r.file_pk for r in CT.filter_files(f, CT.FileFilter(run="2024-01-01_run_000001"), runs).collect()] == ["1"]
    assert [r.file_pk for r in CT.filter_files(f, CT.FileFilter(run="r2"), runs).collect()] == ["2"]


@pytest.mark.parametrize("page,size,want", [(None, None, (1, 20)), ("0", "0", (1, 20)), ("-3", "500", (1, 100)), ("x", "y", (1, 20)), ("2", "50", (2, 50))])
def test_page_numbers(page, size, want):
    assert CT.page_numbers(page, size) == want


def test_unsafe_search_terms_are_plain_text(spark):
    f = file_rows(spark, dict(file_pk="1", file_name="100%_a.pdf"), dict(file_pk="2", file_name="100 a.pdf"))
    assert [r.file_pk for r in CT.filter_files(f, CT.FileFilter(search="%_A")).collect()] == ["1"]


def test_config_defaults(spark):
    df = spark.createDataFrame([("WEB", '{"startUrls":["https://a.example.com"]}'), ("TELEGRAM", '{"channels":["x"]}'), ("MEDIA", "{}"), ("WEB", "{}")], "k string, c string")
    got = [r.x for r in df.select(C.collector_config(F.col("k"), F.col("c")).alias("x")).collect()]
    assert '"maxDepth":5' in got[0].config and '"robotsEnabled":true' in got[0].config and got[0].violations == []
    assert '"messageLimit":500' in got[1].config and '"audioChunkSeconds":30' in got[2].config
    assert got[3].violations == ["startUrls:required"]


def test_message_rules(spark):
    rows = [("c", 5, None, "t5", 1, 2, 3, 4, "audio", "a.mp3", None), ("c", 6, None, "t6", 1, 2, 3, None, "document", "Book One.PDF", None),
            ("c", 7, None, None, 1, 2, 3, 6, None, None, None), ("c", 8, None, "t", 1, 1, 1, None, "document", None, "application/epub+zip")]
    df = spark.createDataFrame(rows, "channel string, message_id long, ts timestamp, text string, sender_id long, views long, forwards long, "
                                     "reply_to_id long, media_kind string, media_name string, media_mime string")
    got = {(r.message_id, r.artifact): r for r in MS.message_artifacts(df, allowed_extensions=["pdf", ".json"]).collect()}
    assert set(got) == {(5, "record"), (6, "media"), (6, "record"), (7, "record"), (8, "record")}
    assert got[(6, "media")].file_name == "Book_One.pdf" and got[(6, "record")].url.endswith("/6#message")
    assert '"has_media":false' in got[(5, "record")].body
    assert {r.message_id for r in MS.message_artifacts(df).collect()} == {6, 8}
    assert {r.message_id: r.reply_text for r in MS.resolve_replies(df).collect()} == {5: None, 6: None, 7: "t6", 8: None}


def test_state_rules_agree(spark):
    rng = random.Random(3)
    moves = ["RUNNING", "COMPLETED", "FAILED", "CANCELLED", *RN.USER_MOVES]
    rows = [(f"r{i % 5}", n, n, rng.choice(moves)) for n, i in enumerate(rng.randrange(50) for _ in range(400))]
    want = {}
    for run, _, _, move in rows:
        want[run] = RN.next_status(want.get(run, "PENDING"), move)[0]
    df = spark.createDataFrame(rows, "run_id string, event_id long, ts long, move string")
    for block in (3, 1000):
        assert {r.run_id: r.status for r in RN.final_status(df, block=block).collect()} == want
    assert RN.next_status("COMPLETED", "RUNNING") == ("COMPLETED", True)
    assert RN.next_status("COMPLETED", "PAUSED") == ("COMPLETED", False)
    assert RN.next_status("PAUSED", "RUNNING", RN.REFERENCE_PROTECTED) == ("RUNNING", True)


def test_source_names(spark):
    df = spark.createDataFrame([("diyako-yageyziman-com", None, None), ("gov-krd", "GOV KRD", "https://www-gov.krd"), ("rudaw-net", "Rudaw", "rudaw.net")],
                               "s string, n string, u string")
    got = [r.m for r in df.select(FN.source_metadata(F.col("s"), F.col("n"), F.col("u")).alias("m")).collect()]
    assert (got[0].name, got[0].base_url) == ("Diyako (Yagey Ziman)", "https://diyako.yageyziman.com")
    assert got[1].name == "Gov.krd (Kurdistan Regional Government)" and got[1].base_url == "https://gov.krd"
    assert (got[2].name, got[2].base_url) == ("Rudaw", "https://rudaw.net")
