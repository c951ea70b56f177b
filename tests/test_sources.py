"""Catalog readers, record keys and conformance of reported runs."""

from pyspark.sql import functions as F

from siftloom.functions import conformance as C
from siftloom.operators import catalog as CT
from siftloom.operators import frontier as FR
from siftloom.sources import sinks as SN
from siftloom.sources import storage as ST


def test_catalog_is_read_with_its_schema(spark, folder):
    rows = spark.createDataFrame([("s1", "One", "one", True)], "source_id string, name string, slug string, enabled boolean")
    rows.write.parquet(f"{folder}/sources")
    got = ST.read_catalog(spark, folder, "sources")
    assert [f.name for f in got.schema][:3] == ["source_id", "name", "slug"] and "created_at" in got.columns
    assert tuple(got.select("slug", "enabled", "base_url").first()) == ("one", True, None)


def test_a_live_catalog_is_read_in_ranges(spark, folder):
    url, driver = f"jdbc:derby:{folder}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(100).selectExpr("id AS n", "concat('f', id) AS name")
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="files", driver=driver).save()
    got = ST.read_catalog_jdbc(spark, url, "files", "n", 0, 100, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r.name for r in got.where("n >= 90").collect()) == sorted(f"f{i}" for i in range(90, 100))


def test_record_keys_and_folders(spark, folder):
    records = spark.createDataFrame([("A title", "a.org", "text"), ("B: title", "b.org", "text")], "title string, source_domain string, body string")
    keyed = SN.record_keys(records, F.lit("runs/r1"))
    rows = {r.title: r for r in keyed.collect()}
    assert rows["A title"].storage_key == f"runs/r1/data/web_content/{rows['A title'].file_name}"
    assert rows["A title"].record_sha[:8] in rows["A title"].file_name and rows["A title"].record_sha != rows["B: title"].record_sha
    SN.write_records(keyed, folder)
    back = spark.read.json(f"{folder}/data/web_content")
    assert {(r.domain, r.title) for r in back.collect()} == {("a.org", "A title"), ("b.org", "B: title")}


def test_reported_runs(spark):
    rows = spark.createDataFrame([("RUNNING", 1, 2), ("NOPE", 0, -1), (None, 0, 0)], "status string, a int, b int")
    got = [r.v for r in rows.select(C.run_violations(F.col("status"), F.col("a"), F.col("b")).alias("v")).collect()]
    assert [sorted(v) for v in got] == [[], ["counters:negative", "status:value"], ["status:value"]]


def test_manifest_keys_of_runs_that_lack_one(spark):
    runs = spark.createDataFrame([("p1", "run_1", None), ("p2", "run_2", "own"), ("p3", "run_3", "")], "run_pk string, run_id string, manifest_key string")
    manifests = spark.createDataFrame([("x/long/manifest.json", '{"run_id": "run_1"}'), ("x/manifest.json", '{"run_id": "run_1"}'), ("y/manifest.json", '{"run_id": "run_2"}')], "key string, text string")
    got = {r.run_pk: r.manifest_key for r in ST.attach_manifest_keys(runs, manifests).collect()}
    assert got == {"p1": "x/manifest.json", "p2": "own", "p3": None}


def test_hot_keys_meet_their_tables(spark):
    asked = spark.createDataFrame([(i, "ALPHA " if i % 3 else f"x{i % 4}") for i in range(60)] + [(99, None)], "n int, wanted string")
    table = spark.createDataFrame([("s1", "alpha"), ("s2", "x0")], "source_id string, slug string")
    got = CT.resolve_keys(asked, "wanted", table, "source_id", "slug")
    assert got.columns == ["n", "wanted", "source_id"] and got.count() == 61
    assert {r.n: r.source_id for r in got.collect()} == {i: "s1" if i % 3 else "s2" if i % 4 == 0 else None for i in range(60)} | {99: None}
    rows = spark.createDataFrame([(i, "https://a.test/" if i % 2 else "https://b.test/") for i in range(20)] + [(99, None)], "n int, url string")
    allowed = spark.createDataFrame([("a.test",)], "domain string")
    assert sorted(r.n for r in FR.filter_allowed_hosts(rows, allowed).collect()) == list(range(1, 20, 2))
