"""Runs of any length, rows of one batch, samples, folders and pages."""

import pytest
from pyspark.sql import functions as F

from siftloom import session as SE
from siftloom.operators import catalog as CT
from siftloom.operators import changes as CH
from siftloom.operators import documents as D
from siftloom.operators import frontier as FR
from siftloom.operators import skew as SK
from siftloom.sources import storage as ST
from siftloom.streaming import runs as RN


def test_a_long_run_is_one_row(spark):
    moves = ["RUNNING", "PAUSED", "RESUME"]
    rows = [("r", i, i, moves[i % 3]) for i in range(3000)] + [("s", 0, 0, "PAUSED")]
    events = spark.createDataFrame(rows, "run_id string, event_id long, ts long, move string")
    got = {(r.run_id, r.status, r.moves) for r in RN.final_status(events, block=4).collect()}
    assert got == {("r", "RUNNING", 3000), ("s", "PAUSED", 1)}
    assert RN.final_status(events.limit(0)).collect() == []


FILES = "file_pk string, file_id string, run_pk string, source_id string, file_name string, original_filename string, canonical_filename string, extension string, sha256 string, storage_key string, status string, metadata string"


def test_upsert_sees_earlier_rows_of_its_batch(spark):
    files = spark.createDataFrame([("a", "RAW-000000001", "r0", "s", "a.txt", "a.txt", None, ".txt", "h1", "k1", "FAILED", "old")], FILES)
    incoming = spark.createDataFrame(
        [(1, "r1", "s", "b.txt", "h2", "k2", "UPLOADED", "first"), (2, "r2", "s", "c.txt", "h2", "k3", "FAILED", "second"),
         (3, "r3", "s", "d.txt", "h9", "k3", "UPLOADED", "third"), (4, "r4", "s", "e.txt", "h2", "k9", "DUPLICATE", "report"),
         (5, "r5", "s", "f.txt", None, None, "UPLOADED", "bare"), (6, "r6", "s", "g.txt", None, None, "UPLOADED", "bare too"),
         (7, "r7", "s", "a.txt", "h1", "k7", "UPLOADED", "known")],
        "seq long, run_pk string, source_id string, file_name string, sha256 string, storage_key string, status string, metadata string").withColumn("extension", F.lit(".txt"))
    rows = {r.file_name + "/" + r.metadata: (r.file_id, r.status, r.storage_key, r.run_pk) for r in CH.upsert_files(files, incoming).collect()}
    assert rows == {
        "a.txt/known": ("RAW-000000001", "UPLOADED", "k7", "r7"),
        "b.txt/third": ("RAW-000000002", "UPLOADED", "k3", "r3"),
        "e.txt/report": ("RAW-000000003", "DUPLICATE", "k9", "r4"),
        "f.txt/bare": ("RAW-000000004", "UPLOADED", None, "r5"),
        "g.txt/bare too": ("RAW-000000005", "UPLOADED", None, "r6")}


def test_uploads_of_one_hash(spark):
    files = spark.createDataFrame([("a", "RAW-000000001", None, "s", "a", None, None, None, "h1", None, "FAILED", None)], FILES)
    sources = spark.createDataFrame([("s", "slug")], "source_id string, slug string")
    uploads = spark.createDataFrame([(i, "s", f"n{i}.pdf", "application/pdf", 5, h) for i, h in enumerate(["h2", "h2", "h1", None, None, "h2"])],
                                    "n long, source_id string, file_name string, mime_type string, file_size int, sha256 string")
    rows = sorted((r.n, r.status, r.storage_key is None) for r in CH.manual_uploads(uploads, files, sources, [F.col("n")]).collect())
    assert [s for _, s, _ in rows] == ["UPLOADED", "DUPLICATE", "DUPLICATE", "UPLOADED", "UPLOADED", "DUPLICATE"]
    assert all((s == "DUPLICATE") == bare for _, s, bare in rows)


def test_samples_skip_leading_blanks(spark):
    pages = spark.createDataFrame([("d", 1, " " * 2100 + "first page text", False), ("d", 2, "  second", False), ("e", 1, "\n \t", True)],
                                  "doc_id string, page_no int, text string, has_images boolean")
    rows = {r.doc_id: r for r in D.classify_documents(pages).collect()}
    assert rows["d"].raw_text_sample == "first page text\n  second" and rows["e"].raw_text_sample == ""


def test_whole_texts_and_own_replacement_characters(spark):
    body = ("x" * 9000 + "\ufffd").encode() + b"\xff\xfe"
    row = spark.createDataFrame([(body,)], "content binary").select(ST.plain_text(F.col("content")).alias("t"), ST.plain_text(F.col("content"), 10).alias("p")).collect()[0]
    assert row.t == "x" * 9000 + "\ufffd" and row.p == "x" * 10


def test_frontier_without_budgets_goes_to_the_end(spark):
    links = spark.createDataFrame([(f"https://a.test/{i}", f"https://a.test/{i + 1}") for i in range(9)], "page_url string, url string")
    start = spark.createDataFrame([("https://a.test/0",)], "url string")
    assert FR.expand_frontier(links, start)[0].agg(F.max("depth")).first()[0] == 9
    patterns = spark.createDataFrame([("/[12]$",), ("/9",)], "pattern string")
    assert {r.url[-1] for r in FR.matching_patterns(links, patterns).collect()} == {"1", "2", "9"}
    assert FR.matching_patterns(links, patterns.limit(0)).collect() == []


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        SE.shared_folder(Session())
    Session.conf = Conf(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y"})
    assert SE.shared_folder(Session()) == "hdfs://x/y"
    assert SE.is_local("local[8]") and SE.is_local("local") and not SE.is_local("local-cluster[2,1,1024]")


def test_intermediate_tables_are_removed(spark):
    df = SE.cut_lineage(spark.range(3))
    path = df.inputFiles()[0]
    assert df.count() == 3 and SE.remove_intermediate(spark) >= 1
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_pages_after_a_row(spark):
    df = spark.createDataFrame([(f"f{i:02}", i // 3) for i in range(30)], "file_pk string, created_at int")
    seen, after = [], None
    while rows := CT.list_after(df, after, "7").collect():
        seen += [r.file_pk for r in rows]
        after = (rows[-1].created_at, rows[-1].file_pk)
    assert seen == [r.file_pk for r in df.orderBy(F.desc("created_at"), "file_pk").collect()]


def test_rows_without_a_key_match_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b")], "n int, k string")
    lookup = spark.createDataFrame([("a", 10), ("", 20)], "k string, v int")
    assert {r.n: r.v for r in SK.join_present(rows, lookup, "k", "n").collect()} == {1: 10, 2: None, 3: None, 4: None}


def test_a_round_of_the_walk_shuffles_only_its_targets(spark):
    links = spark.createDataFrame([(f"https://a.test/{i}", f"https://a.test/{i * 7 % 50}") for i in range(50)], "page_url string, url string")
    pages, files = FR.expand_frontier(links, spark.createDataFrame([("https://a.test/1",)], "url string"), max_depth=3)
    assert files.count() == 0 and sorted(r.depth for r in pages.collect()) == [0, 1, 2, 3]
    edges = spark.table(SE.write_bucketed(FR.prepare_edges(links), "src", 8))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FR.next_pages(edges, pages, 1)._jdf.queryExecution().sparkPlan().toString()
        executed = FR.next_pages(edges, pages, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Join") == 2 and executed.count("Exchange hashpartitioning(") == 1
