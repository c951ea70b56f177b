"""Anti joins whose partitions are bounded by rows."""

from pyspark.sql import functions as F

from siftloom.operators import changes as CH
from siftloom.operators import integrity as IG
from siftloom.operators import skew as SK


def bounded(monkeypatch, rows):
    monkeypatch.setattr(SK, "FEW_KEYS", 10)
    monkeypatch.setattr(SK, "TASK_ROWS", rows)


def test_orphans_of_many_parents(spark, monkeypatch):
    bounded(monkeypatch, 1000)
    child = spark.createDataFrame([(f"c{i}", None if i % 7 == 0 else f"run-{i % 900}") for i in range(16_000)], "pk string, run_pk string")
    parent = spark.createDataFrame([(f"run-{i}",) for i in [*range(600), *range(50)]], "run_pk string")
    want = {(f"c{i}", f"run-{i % 900}") for i in range(16_000) if i % 7 and i % 900 >= 600}
    out = IG.missing_parents(child, "run_pk", "pk", parent, "x")
    assert sorted((r.child_key, r.parent_key) for r in out.collect()) == sorted(want)


def test_few_keys_and_null_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "n int, k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(r.n for r in SK.without(rows, keys, "k").collect()) == [2, 3]
    monkeypatch.setattr(SK, "FEW_KEYS", 0)
    assert sorted(r.n for r in SK.without(rows, keys, "k").collect()) == [2, 3]
    monkeypatch.setattr(SK, "TASK_ROWS", 1)
    assert SK.without(rows, keys, "k").columns == ["n", "k"]


def test_deleted_runs_in_partitions_of_bounded_rows(spark, monkeypatch):
    bounded(monkeypatch, 500)
    runs = spark.createDataFrame([(f"r{i}", "RUNNING" if i % 9 == 0 else "DONE") for i in range(300)], "run_pk string, status string")
    files = spark.createDataFrame([(f"f{i}", f"r{i % 300}") for i in range(5000)], "file_pk string, run_pk string")
    keys = runs.where("cast(substring(run_pk, 2) as int) < 200").select("run_pk")
    out = CH.cascade_delete_runs(keys, runs, files, files)
    want = sorted(f"f{i}" for i in range(5000) if i % 300 >= 200 or i % 300 % 9 == 0)
    assert sorted(r.file_pk for r in out["files"].collect()) == want
    assert out["files"].rdd.getNumPartitions() == 10


def test_lookup_of_attached_keys_is_computed_once(spark):
    """Hot and cold keys come from one aggregation, whose exchange the second read takes over."""
    from siftloom.operators.dedup import mark_duplicates

    files = spark.range(1000).selectExpr("concat('f', id) AS file_pk", "concat('h', id % 300) AS sha256", "timestamp_seconds(id) AS created_at").repartition(4)
    marked = mark_duplicates(files).select("file_pk", "first_pk", "is_duplicate")
    assert {r.file_pk: (r.first_pk, r.is_duplicate) for r in marked.collect()} == {f"f{i}": (f"f{i % 300}", i >= 300) for i in range(1000)}
    marked.collect()
    assert "ReusedExchange" in marked._jdf.queryExecution().executedPlan().toString()


def test_errors_of_a_timeline_in_partitions_of_bounded_rows(spark, monkeypatch):
    """Errors stay where they are; the runs they name meet the other runs in bounded partitions."""
    from siftloom.operators import reports as RP

    bounded(monkeypatch, 100)
    frame, parts = type(spark.range(0)), []
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *cols: parts.append((n, df.columns)) or real(df, n, *cols))
    runs = spark.createDataFrame(
        [(f"r{i}", f"id{i}", "A", "a", "WEB", "COMPLETED" if i % 2 else "RUNNING", i % 3, 0, 0, 0, 5) for i in range(2000)],
        "run_pk string, run_id string, source_name string, source_slug string, collector_type string, status string, "
        "pages_crawled long, files_found long, files_downloaded long, files_duplicate long, files_failed long",
    ).withColumns({c: F.lit(None).cast("timestamp") for c in ("started_at", "completed_at")})
    named = [f"r{i % 30}" for i in range(300)] + ["gone", "gone", None]
    errors = spark.createDataFrame([(f"e{i}", r, None if i == 0 else "X", f"m{i}", None) for i, r in enumerate(named)], "error_id string, run_pk string, error_code string, message string, created_at timestamp")
    line = RP.run_timeline(runs, errors)
    assert parts == [(20, ["run_pk"])]
    got = line.collect()
    assert sorted((r.run_pk, r.message) for r in got if r.seq == 8) == sorted(
        (r, f"[WORKER_ERROR] {'X' if i else 'Exception'}: m{i}") for i, r in enumerate(named[:300]))
    assert sorted(r.run_pk for r in got if r.seq == 7) == sorted(f"r{i}" for i in range(30, 2000))
    for seq, n in ((1, 2000), (2, 2000), (3, 1333), (4, 0), (5, 0), (6, 0), (9, 2000)):
        assert sum(r.seq == seq for r in got) == n
    counted = runs.join(RP.counted_errors(errors), "run_pk", "left")
    assert sorted(map(tuple, RP.run_timeline(counted, errors, runs.select("run_pk")).drop("at").collect())) == sorted(map(tuple, line.drop("at").collect()))
